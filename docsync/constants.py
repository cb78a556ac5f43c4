"""Values every other module agrees on."""

# File types, names and labels that decide what is delivered and how.
ALLOWED_EXTENSIONS = [
    "md",
    "txt",
    "pdf",
    "csv",
    "json",
    "yaml",
    "yml",
    "toml",
    "xml",
    "html",
    "htm",
    "rst",
    "log",
    "cfg",
    "ini",
    "conf",
    "py",
    "rs",
    "go",
    "js",
    "ts",
    "sh",
    "bat",
    "ps1",
]
TEXT_EXTENSIONS = [e for e in ALLOWED_EXTENSIONS if e != "pdf"]
MARKDOWN_EXTENSIONS = ["md", "txt"]
OS_FILES = [".DS_Store", "Thumbs.db", "desktop.ini", ".gitkeep"]
FENCE_LANGUAGES = {
    "py": "python",
    "rs": "rust",
    "go": "go",
    "js": "javascript",
    "ts": "typescript",
    "sh": "shell",
    "bat": "shell",
    "ps1": "shell",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "toml": "toml",
    "xml": "html",
    "html": "html",
    "htm": "html",
    "csv": "csv",
    "rst": "rst",
    "cfg": "ini",
    "ini": "ini",
    "conf": "ini",
    "log": "log",
}
RUN_COLORS = {
    "running": "text-sky-400",
    "error": "text-red-400",
    "completed": "text-emerald-400",
    "idle": "text-zinc-400",
    "unknown": "text-zinc-400",
}
IGNORE_FILE = ".ragignore"
DEFAULT_LABEL = "File Context"
DEFAULT_ROOT = "/rag"
DEFAULT_STORE_URL = "redis://127.0.0.1:6379/0"
DEFAULT_UPLOADS = 5
CONFIG_KEY = "config:global"
MAX_ATTEMPTS = 3
BACKOFF_MS = 500
POLL_MS = 2000
PAGE_SIZE = 10
PAGER_WIDTH = 5
CHUNK_TOKENS = 1500
CHUNK_OVERLAP = 150
BYTES_PER_TRACKED_FILE = 300
SIZING_TIERS = [("XS", 1_000), ("S", 5_000), ("M", 20_000), ("L", 100_000), ("XL", None)]

CONFIG_FIELDS = [
    "target_directory",
    "remote_url",
    "remote_token",
    "knowledge_id",
    "store_url",
    "context_header_label",
    "max_concurrent_uploads",
    "convert_to_markdown",
]
