"""Schemas of the relations the operators exchange."""

# One row per tracked file; `absolute_path` is null on a row that only carries context.
SYNC_STATE = (
    "kb_id string, file_key string, absolute_path string, content_hash string, "
    "remote_file_id string, context_text string, context_dirty boolean"
)
STATE_COLUMNS = [field.split()[0] for field in SYNC_STATE.split(", ")]
# Tracked state of a change stream: what is wanted by the latest change next to what was
# delivered. Content and notes have sequence marks of their own, so neither makes the other
# late. A deleted file keeps its row, so a late change cannot revive it.
STREAM_STATE = (
    SYNC_STATE + ", content_seq bigint, context_seq bigint, wanted_path string, "
    "wanted_hash string, is_deleted boolean"
)
# One row per directory entry; `kind` is file, dir, symlink or other, and `raw` the path as
# it is where it is not UTF-8.
LISTING = (
    "kb_id string, root string, path string, rel_path string, filename string, "
    "kind string, length bigint, mtime_us bigint, raw binary"
)
PATTERNS = "kb_id string, line_no bigint, pattern string"
REMOTE_FILES = "kb_id string, pos bigint, remote_file_id string, filename string"
# One row per change of a file; `op` is upsert, delete or context (its note was edited).
CHANGES = "kb_id string, file_key string, path string, content_hash string, op string, seq bigint"
# A change stream may also report what went through: `op` is delivered, with the hash and id.
DELIVERED_COLUMN = "remote_file_id"
# Remote files to delete: of a replaced delivery, or of a file that is gone.
DELETES = "kb_id string, file_key string, action string, remote_file_id string"
# What files had for bytes when they were last hashed, as a table of a snapshot store.
HASHES = (
    "kb_id string, file_key string, size bigint, mtime_us bigint, ctime_us bigint, content_hash string, "
    "hashed_at_us bigint"
)
