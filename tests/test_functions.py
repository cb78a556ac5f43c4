"""Column functions against known cases, all cases of a function in one job."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators.filters import filter_disposition, flag_ragignored
from docsync.sources.config import config_rows, resolve_config, with_default_root
from docsync.sources.ragignore import load_ragignore, parse_ragignore
from docsync.sources.remote_json import parse_kb_catalog, parse_kb_files, parse_status, parse_upload_resp


def evaluate(spark, inputs, schema, expression):
    """Value of `expression` per input, in order."""
    data = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(data, f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def by_name(spark, function, names):
    return evaluate(spark, names, "n string", function(F.col("n")))


ACCEPTED = [f"file.{e}" for e in C.ALLOWED_EXTENSIONS] + ["LOUD.MD", "two.dots.Py"]
REJECTED = "photo.webp clip.mov bundle.tar tool.dll blob.dat face.ttf Dockerfile .profile a. mdx".split()


def test_extension_allow_list(spark):
    assert by_name(spark, P.has_allowed_extension, ACCEPTED) == [True] * len(ACCEPTED)
    assert by_name(spark, P.has_allowed_extension, REJECTED) == [False] * len(REJECTED)


def test_os_files(spark):
    names = [*C.OS_FILES, "thumbs.db", "Desktop.ini", "DS_Store", "notes.md"]
    assert by_name(spark, P.is_os_ignored, names) == [True] * 4 + [False] * 4


def test_text_and_markdown(spark):
    text = [name for name in ACCEPTED if name != "file.pdf"]
    assert by_name(spark, P.is_text_file, text) == [True] * len(text)
    assert by_name(spark, P.is_text_file, ["file.pdf", "F.PDF", *REJECTED]) == [False] * (2 + len(REJECTED))
    names = ["a.md", "B.Txt", "c.py", "Dockerfile"]
    assert by_name(spark, P.is_markdown_file, names) == [True, True, False, False]


def test_name_parts(spark):
    names = ["x.tar.gz", ".profile", "a.", "Dockerfile", "note.md", ".a.b", "..x", "line\nbreak.md"]
    assert by_name(spark, S.file_ext, names) == ["gz", None, "", None, "md", "b", "x", "md"]
    assert by_name(spark, S.file_stem, names) == [
        "x.tar", ".profile", "a", "Dockerfile", "note", ".a", ".", "line\nbreak",
    ]
    assert by_name(spark, S.file_name, ["/a/b.md", "b.md"]) == ["b.md", "b.md"]


def test_rel_path(spark):
    pairs = [("/rag/a/b.md", "/rag"), ("/rag/a.md", "/rag/"), ("/ragged/a.md", "/rag"), ("/a.md", "/")]
    got = evaluate(spark, pairs, "p string, r string", S.rel_path(F.col("p"), F.col("r")))
    assert got == ["a/b.md", "a.md", None, "a.md"]


def test_visibility(spark):
    paths = ["a.md", ".a.md", "d/.a.md", ".d/a.md", "d.e/a.md", "d/..a"]
    assert by_name(spark, P.is_visible, paths) == [True, False, False, False, True, False]


def test_fence_language(spark):
    names = [f"f.{ext}" for ext in C.FENCE_LANGUAGES]
    assert by_name(spark, S.ext_to_lang, names) == list(C.FENCE_LANGUAGES.values())
    assert by_name(spark, S.ext_to_lang, ["f.PY", "f.png", "f.md", "f.pdf", "f"]) == [""] * 5


def test_fence_and_header(spark):
    fenced = evaluate(
        spark,
        [("x = 1", "python"), ("", "")],
        "t string, l string",
        S.markdown_fence(F.col("t"), F.col("l")),
    )
    assert fenced == ["```python\nx = 1\n```\n", "```\n\n```\n"]
    headers = evaluate(
        spark,
        [("note", "Lore"), ("two\nlines", ""), ("note", None), ("", "Lore"), (None, "Lore")],
        "t string, l string",
        S.context_header(F.col("t"), F.col("l")),
    )
    assert headers == [
        "> **Lore:**\n> note\n\n",
        "> **File Context:**\n> two\nlines\n\n",
        "> **File Context:**\n> note\n\n",
        "",
        "",
    ]


def test_upload_filename(spark):
    cases = [("a.py", True), ("a.py", False), ("a.md", True), ("a.TXT", True), ("a.pdf", True), ("x.tar.json", True)]
    got = evaluate(spark, cases, "n string, c boolean", S.upload_filename(F.col("n"), F.col("c")))
    assert got == ["a.md", "a.py", "a.md", "a.TXT", "a.pdf", "x.tar.md"]


def test_hash_and_key(spark):
    digests = evaluate(spark, ["", "hello", "hello"], "t string", S.content_hash(F.col("t")))
    assert digests[0] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert digests[1] == digests[2] == hashlib.sha256(b"hello").hexdigest()
    keys = by_name(spark, S.file_key, ["/rag/a.md", "/rag/b/a.md"])
    assert keys[0] == hashlib.sha256(b"/rag/a.md").hexdigest() + "_a.md"
    assert keys[0] != keys[1]


def test_lossy_text_replaces_like_python(spark):
    samples = [b"ok", b"\xff\xfe", b"a\xc3(b", b"\xe2\x82", b"\xf0\x9f\x98\x80"]
    got = evaluate(spark, samples, "b binary", S.lossy_text(F.col("b")))
    assert got == [s.decode("utf-8", "replace") for s in samples]


def test_small_strings(spark):
    assert by_name(spark, S.html_escape, ['<a href="x">&amp;</a>']) == [
        "&lt;a href=&quot;x&quot;&gt;&amp;amp;&lt;/a&gt;"
    ]
    assert by_name(spark, S.normalize_base_url, ["http://a//", "http://a", "/"]) == ["http://a", "http://a", ""]
    status = ["Idle", "Running", "Completed successfully", "Error: timed out", "Error", "?"]
    assert by_name(spark, S.run_status_phase, status) == ["idle", "running", "completed", "error", "error", "unknown"]
    labels = [("1", "", "d"), ("1", "n", ""), ("1", "n", "d"), ("1", None, None)]
    got = evaluate(
        spark, labels, "k string, n string, d string", S.kb_label(F.col("k"), F.col("n"), F.col("d"))
    )
    assert got == ["1", "n", "n — d", "1"]
    strips = evaluate(
        spark, [(1, 1), (1, 9), (3, 9), (4, 9), (9, 9)], "p bigint, t bigint", S.pager_window(F.col("p"), F.col("t"))
    )
    assert strips == [[1], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [2, 3, 4, 5, 6], [7, 8, 9]]


def test_verify_hash(spark):
    cases = [("h", "h", False), ("h", "h", None), ("h", "h", True), ("h", "g", False), (None, "h", False)]
    got = evaluate(
        spark, cases, "s string, c string, d boolean", P.verify_hash(F.col("s"), F.col("c"), F.col("d"))
    )
    assert got == [True, True, False, False, False]


def test_search_is_case_insensitive_and_literal(spark):
    df = spark.createDataFrame([("/A/b%c.md",), ("/a/bxc.md",)], "p string")
    assert df.filter(P.path_contains(F.col("p"), "B%C")).count() == 1
    assert df.filter(P.path_contains(F.col("p"), "")).count() == 2


def test_ignore_file_lines(spark, tmp_path):
    text = "# rules\nold\nlogs/*.log\r\n  tmp/plan.txt \n\n   \n#end\n"
    (tmp_path / ".ragignore").write_text(text)
    found = load_ragignore(spark, str(tmp_path), "k").orderBy("line_no").collect()
    assert [(r["line_no"], r["pattern"]) for r in found] == [
        (2, "old"),
        (3, "logs/*.log"),
        (4, "tmp/plan.txt"),
    ]
    assert load_ragignore(spark, str(tmp_path / "none"), "k").count() == 0
    assert parse_ragignore(spark.createDataFrame([("k", "")], "kb_id string, text string")).count() == 0


def ignored(spark, cases, dialect):
    files = spark.createDataFrame(
        [(str(i), p, p) for i, (p, _) in enumerate(cases)], "kb_id string, path string, rel_path string"
    )
    rules = spark.createDataFrame(
        [(str(i), 1, r) for i, (_, r) in enumerate(cases)],
        "kb_id string, line_no bigint, pattern string",
    )
    flagged = flag_ragignored(files, rules, dialect).orderBy(F.col("kb_id").cast("int")).collect()
    return [r["is_ragignored"] for r in flagged]


IGNORE_CASES = [
    ("old/one.md", "old"),
    ("new/one.md", "old"),
    ("logs/run.log", "logs/*"),
    ("docs/run.md", "logs/*"),
    ("tmp/plan.txt", "tmp/plan.txt"),
    ("tmp/other.txt", "tmp/plan.txt"),
    ("my/threshold.md", "old"),
    ("docs/old/one.md", "old"),
]


@pytest.mark.parametrize("big", [False, True])
def test_ignore_dialects(spark, monkeypatch, big):
    if big:
        monkeypatch.setattr("docsync.operators.filters.fits_broadcast", lambda df: False)
    substring = [True, False, False, False, True, False, True, True]
    prefix = [True, False, True, False, True, False, False, True]
    assert ignored(spark, IGNORE_CASES, "substring") == substring
    assert ignored(spark, IGNORE_CASES, "prefix") == prefix


def test_first_rule_names_the_disposition(spark):
    want = {
        "a/plan.md": "accepted",
        "a/scan.pdf": "accepted",
        "a/photo.webp": "unsupported_ext",
        "old/plan.md": "ragignored",
        "old/photo.webp": "ragignored",
        ".DS_Store": "hidden",
        "a/.old/plan.md": "hidden",
        "old/Thumbs.db": "os_file",
        "Dockerfile": "unsupported_ext",
        "a": "not_file",
    }
    files = spark.createDataFrame(
        [("k", f"/r/{p}", p, p.split("/")[-1], "dir" if p == "a" else "file") for p in want],
        "kb_id string, path string, rel_path string, filename string, kind string",
    )
    rules = spark.createDataFrame([("k", 1, "old")], "kb_id string, line_no bigint, pattern string")
    got = {r["rel_path"]: r["disposition"] for r in filter_disposition(files, rules).collect()}
    assert got == want


def test_config_defaults_and_round_trip(spark):
    kv = spark.createDataFrame(
        [
            ("all", "target_directory", "/data"),
            ("all", "context_header_label", "Field Notes"),
            ("all", "max_concurrent_uploads", "10"),
            ("all", "convert_to_markdown", "true"),
            ("bad", "max_concurrent_uploads", "ten"),
            ("bad", "convert_to_markdown", "TRUE"),
            ("bad", "context_header_label", ""),
            ("zero", "max_concurrent_uploads", "0"),
            ("neg", "max_concurrent_uploads", "-1"),
            ("huge", "max_concurrent_uploads", "4294967296"),
        ],
        "kb_id string, field string, value string",
    )
    typed = resolve_config(kv)
    got = {r["kb_id"]: r for r in typed.collect()}
    assert (got["all"]["max_concurrent_uploads"], got["all"]["convert_to_markdown"]) == (10, True)
    assert got["all"]["context_header_label"] == "Field Notes"
    assert (got["bad"]["max_concurrent_uploads"], got["bad"]["convert_to_markdown"]) == (5, False)
    assert (got["bad"]["context_header_label"], got["zero"]["context_header_label"]) == ("", "File Context")
    assert [got[k]["max_concurrent_uploads"] for k in ("zero", "neg", "huge")] == [0, 5, 5]
    assert {r["target_directory"] for r in with_default_root(typed).collect()} == {"/data", "/rag"}
    again = {r["kb_id"]: r for r in resolve_config(config_rows(typed)).collect()}
    assert again == got


def test_listing_json(spark):
    bodies = spark.createDataFrame(
        [
            ("k", '{"files":[{"id":"x","filename":"a.md"},{"id":"y","filename":"b.pdf"},{"id":"z"}]}'),
            ("none", '{"name":"x"}'),
            ("broken", "oops"),
        ],
        "kb_id string, body string",
    )
    got = [tuple(r) for r in parse_kb_files(bodies).orderBy("pos").collect()]
    assert got == [("k", 0, "x", "a.md"), ("k", 1, "y", "b.pdf"), ("k", 2, "z", "")]


def test_catalog_json(spark):
    bodies = spark.createDataFrame(
        [('{"items":[{"id":"a","name":"A"}]}',), ('[{"id":"b","description":"B"}]',), ('{"x":1}',), ("",), ("[]",)],
        "body string",
    )
    got = sorted(tuple(r) for r in parse_kb_catalog(bodies).collect())
    assert got == [("a", "A", ""), ("b", "", "B")]


def test_response_bodies(spark):
    bodies = spark.createDataFrame([('{"id":"f"}',), ('{"status":"completed"}',), ("no",)], "body string")
    assert [r["remote_file_id"] for r in parse_upload_resp(bodies).collect()] == ["f", None, None]
    assert [r["status"] for r in parse_status(bodies).collect()] == [None, "completed", None]
