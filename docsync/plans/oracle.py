"""The registered queries once more, as DuckDB SQL over the same tables.

Written phase by phase, so that it shares no shortcut with the DataFrame plans.
"""

from __future__ import annotations

import re

from docsync import constants as C
from docsync.plans.queries import SEARCH
from docsync.sources.tables import CONFIG_ROWS, PATTERN_ROWS


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _values(rows: str) -> str:
    return rows.replace("L,", ",")


LANGS = " ".join(f"WHEN '{ext}' THEN '{lang}'" for ext, lang in C.FENCE_LANGUAGES.items())

# Name of a path, its extension (NULL without one) and stem.
NAME = "list_extract(string_split(path, '/'), -1)"
HAS_EXT = "regexp_matches({n}, '^(?s:.)+[.][^.]*$')"
EXT = f"CASE WHEN {HAS_EXT} THEN regexp_extract({{n}}, '[.]([^.]*)$', 1) END"
STEM = f"CASE WHEN {HAS_EXT} THEN regexp_replace({{n}}, '[.][^.]*$', '') ELSE {{n}} END"


def ext(name: str) -> str:
    return EXT.format(n=name)


def ext_in(name: str, values: list[str]) -> str:
    return f"coalesce(lower({ext(name)}) IN ({_list(values)}), false)"


def fence_lang(name: str) -> str:
    return f"CASE {ext(name)} {LANGS} ELSE '' END"


def upload_name(name: str, convert: str) -> str:
    fenced = f"{convert} AND {ext_in(name, C.TEXT_EXTENSIONS)} AND NOT {ext_in(name, C.MARKDOWN_EXTENSIONS)}"
    return f"CASE WHEN {fenced} THEN {STEM.format(n=name)} || '.md' ELSE {name} END"


def header(text: str, label: str) -> str:
    return (
        f"CASE WHEN coalesce({text}, '') = '' THEN '' ELSE '> **' || coalesce(nullif({label}, ''), "
        f"'{C.DEFAULT_LABEL}') || ':**' || chr(10) || '> ' || {text} || chr(10) || chr(10) END"
    )


CTE: dict[str, str] = {}
CTE["docs"] = """
    SELECT lang AS kb_id, text, doc_id, '/rag/' || CASE WHEN doc_id % 23 = 0 THEN 'drafts/'
        WHEN doc_id % 29 = 0 THEN '.cache/' ELSE '' END || source || '/doc_' || doc_id ||
        CASE WHEN doc_id % 31 = 0 THEN '' ELSE '.' || list_extract(
            ['md','txt','py','json','pdf','png','PY','yaml','log','cfg'], CAST(doc_id % 10 + 1 AS INT)) END AS path
    FROM documents"""
CTE["contents"] = """
    SELECT kb_id, path, text FROM docs
    UNION ALL SELECT 'web', '/rag/web/page_' || page_id || '.html', html FROM pages
    UNION ALL SELECT 'bench', '/rag/bench/' || item_id || '/' || CASE item_id % 3
        WHEN 0 THEN 'Thumbs.db' WHEN 1 THEN 'desktop.ini' ELSE 'item.TXT' END, text FROM benchmark"""
CTE["disk"] = f"""
    SELECT kb_id, path, substr(path, 6) AS rel_path, {NAME} AS filename,
        sha256(path) || '_' || {NAME} AS file_key, sha256(text) AS content_hash FROM contents"""
CTE["state"] = f"""
    SELECT kb_id, sha256(path) || '_' || {NAME} AS file_key,
        CASE WHEN doc_id % 19 <> 0 THEN path END AS absolute_path,
        CASE WHEN doc_id % 19 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN sha256('stale') ELSE sha256(text) END
            END AS content_hash,
        CASE WHEN doc_id % 19 <> 0 THEN CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'fid-' || doc_id END
            END AS remote_file_id,
        CASE WHEN doc_id % 19 = 0 OR doc_id % 6 = 0 THEN 'note ' || doc_id END AS context_text,
        doc_id % 19 = 0 OR doc_id % 11 = 0 AS context_dirty
    FROM docs
    UNION ALL
    SELECT 'chat', sha256(path) || '_' || {NAME}, path, sha256(text), 'cid-' || conv_id || '-' || turn,
        CASE WHEN role = 'system' THEN role END, false
    FROM (SELECT *, '/rag/chat/conv_' || conv_id || '/turn_' || turn || '.txt' AS path FROM conversations)"""
CTE["remote"] = f"""
    SELECT kb_id, doc_id AS pos, 'fid-' || doc_id AS remote_file_id, {NAME} AS filename FROM docs
    UNION ALL SELECT 'chat', conv_id * 1000 + turn, 'cid-' || conv_id || '-' || turn, 'turn_' || turn || '.txt'
    FROM conversations"""
CTE["patterns"] = f"SELECT * FROM (VALUES {_values(PATTERN_ROWS)}) t(kb_id, line_no, pattern)"
CTE["config"] = (
    f"SELECT * FROM (VALUES {_values(CONFIG_ROWS)}) "
    "t(kb_id, target_directory, context_header_label, max_concurrent_uploads, convert_to_markdown)"
)
CTE["flags"] = f"""
    SELECT d.*, EXISTS (SELECT 1 FROM patterns p WHERE p.kb_id = d.kb_id AND contains(d.rel_path, p.pattern))
            AS ragignored,
        filename IN ({_list(C.OS_FILES)}) AS os_file,
        NOT {ext_in("filename", C.ALLOWED_EXTENSIONS)} AS bad_ext,
        rel_path LIKE '.%' OR contains(rel_path, '/.') AS hidden
    FROM disk d"""
CTE["disposed"] = """
    SELECT *, CASE WHEN hidden THEN 'hidden' WHEN os_file THEN 'os_file' WHEN ragignored THEN 'ragignored'
        WHEN bad_ext THEN 'unsupported_ext' ELSE 'accepted' END AS disposition FROM flags"""
CTE["accepted"] = "SELECT * FROM disposed WHERE disposition = 'accepted'"
CTE["first_path"] = """
    SELECT kb_id, filename, min(path) AS path FROM flags WHERE NOT hidden GROUP BY ALL"""


def _classified(state: str) -> str:
    return f"""
    SELECT a.*, s.remote_file_id AS old_id, s.context_text, CASE WHEN s.file_key IS NULL THEN 'NEW'
        WHEN coalesce(s.content_hash = a.content_hash, false) AND NOT coalesce(s.context_dirty, false)
        THEN 'SKIP' ELSE 'UPDATE' END AS action
    FROM accepted a LEFT JOIN {state} s ON s.kb_id = a.kb_id AND s.file_key = a.file_key"""


def _judged(state: str) -> str:
    return f"""
    SELECT s.kb_id, s.file_key, s.absolute_path, coalesce(s.remote_file_id, '') AS remote_file_id,
        CASE WHEN d.path IS NULL THEN 'missing' WHEN d.ragignored OR d.os_file OR d.bad_ext THEN 'filtered'
            ELSE 'kept' END AS reason
    FROM {state} s LEFT JOIN flags d ON d.kb_id = s.kb_id AND d.path = s.absolute_path
    WHERE s.absolute_path IS NOT NULL"""


def _log(inventory: str, state: str, remote: str) -> str:
    return f"""
    SELECT kb_id, file_key, path, filename, pos, previous_id, remote_file_id,
        previous_id IS DISTINCT FROM remote_file_id AS healed, was_dirty
    FROM (
        SELECT r.kb_id, f.path, r.filename, r.pos, r.remote_file_id, coalesce(s.context_dirty, false) AS was_dirty,
            sha256(f.path) || '_' || r.filename AS file_key,
            CASE WHEN row_number() OVER w = 1 THEN s.remote_file_id ELSE lag(r.remote_file_id) OVER w END
                AS previous_id
        FROM {remote} r JOIN {inventory} f ON f.kb_id = r.kb_id AND f.filename = r.filename
        LEFT JOIN {state} s ON s.kb_id = f.kb_id AND s.file_key = sha256(f.path) || '_' || r.filename
        WINDOW w AS (PARTITION BY r.kb_id, f.path ORDER BY r.pos))"""


def _healed(log: str, disk: str) -> str:
    return f"""
    SELECT l.kb_id, l.file_key, l.path, d.content_hash, l.remote_file_id
    FROM (SELECT kb_id, file_key, path, arg_max(remote_file_id, pos) AS remote_file_id FROM {log}
          GROUP BY ALL HAVING bool_or(healed)) l
    JOIN {disk} d ON d.kb_id = l.kb_id AND d.path = l.path"""


def _after_heal(state: str, healed: str) -> str:
    return f"""
    SELECT coalesce(s.kb_id, h.kb_id) AS kb_id, coalesce(s.file_key, h.file_key) AS file_key,
        coalesce(h.path, s.absolute_path) AS absolute_path, coalesce(h.content_hash, s.content_hash) AS content_hash,
        coalesce(h.remote_file_id, s.remote_file_id) AS remote_file_id, s.context_text,
        CASE WHEN h.file_key IS NOT NULL THEN false ELSE s.context_dirty END AS context_dirty
    FROM {state} s FULL JOIN {healed} h ON h.kb_id = s.kb_id AND h.file_key = s.file_key"""


CTE["classified"] = _classified("state")
CTE["judged"] = _judged("state")
CTE["heals"] = _log("first_path", "state", "remote")
CTE["healed"] = _healed("heals", "disk")
CTE["state1"] = _after_heal("state", "healed")
CTE["classified1"] = _classified("state1")
CTE["judged1"] = _judged("state1")
CTE["planned"] = f"""
    SELECT c.*, coalesce(g.convert_to_markdown, false) AS convert, g.context_header_label AS label,
        {upload_name("c.filename", "coalesce(g.convert_to_markdown, false)")} AS upload_filename,
        CASE WHEN action = 'UPDATE' THEN nullif(old_id, '') END AS delete_remote_id
    FROM classified c LEFT JOIN config g ON g.kb_id = c.kb_id"""
CTE["payloads"] = f"""
    SELECT p.*, {header("p.context_text", "p.label")} AS header,
        CASE WHEN NOT {ext_in("p.filename", C.TEXT_EXTENSIONS)} THEN t.text
        ELSE {header("p.context_text", "p.label")} || CASE
            WHEN p.convert AND NOT {ext_in("p.filename", C.MARKDOWN_EXTENSIONS)}
            THEN '```' || {fence_lang("p.filename")} || chr(10) || t.text || chr(10) || '```' || chr(10)
            ELSE t.text END END AS payload, strlen(t.text) AS content_bytes
    FROM planned p JOIN contents t ON t.kb_id = p.kb_id AND t.path = p.path WHERE p.action IN ('NEW', 'UPDATE')"""
CTE["run"] = """
    SELECT coalesce(d.kb_id, s.kb_id) AS kb_id, coalesce(d.file_key, s.file_key) AS file_key,
        coalesce(d.path, s.absolute_path) AS path,
        CASE WHEN c.action IS NOT NULL THEN c.action WHEN j.reason IN ('missing', 'filtered') THEN 'ORPHAN'
            WHEN j.reason = 'kept' THEN 'KEPT' WHEN s.file_key IS NOT NULL THEN 'CONTEXT' ELSE 'IGNORED' END AS action,
        CASE WHEN c.action IS NOT NULL THEN '' WHEN j.reason IN ('missing', 'filtered') THEN j.reason
            WHEN s.file_key IS NULL THEN d.disposition ELSE '' END AS reason,
        h.file_key IS NOT NULL AS healed,
        CASE WHEN c.action = 'UPDATE' OR (c.action IS NULL AND j.reason IN ('missing', 'filtered'))
            THEN nullif(s.remote_file_id, '') END AS delete_remote_id,
        s.file_key IS NOT NULL AS is_tracked
    FROM disposed d FULL JOIN state1 s ON s.kb_id = d.kb_id AND s.file_key = d.file_key
    LEFT JOIN classified1 c ON c.kb_id = d.kb_id AND c.file_key = d.file_key
    LEFT JOIN judged1 j ON j.kb_id = s.kb_id AND j.file_key = s.file_key
    LEFT JOIN healed h ON h.kb_id = s.kb_id AND h.file_key = s.file_key"""
CTE["listing"] = """
    SELECT a.kb_id, a.file_key, a.path, coalesce(s.context_text, '') AS context_text
    FROM accepted a LEFT JOIN state s ON s.kb_id = a.kb_id AND s.file_key = a.file_key"""
CTE["main_files"] = """
    SELECT 'main' AS kb_id, '/rag/' || source || '/n_' || (doc_id // 2) || '.md' AS path,
        'n_' || (doc_id // 2) || '.md' AS filename, sha256(text) AS content_hash, doc_id FROM documents"""
CTE["main_first"] = "SELECT kb_id, filename, min(path) AS path FROM main_files GROUP BY ALL"
CTE["main_state"] = """
    SELECT kb_id, sha256(path) || '_' || filename AS file_key, path AS absolute_path, content_hash,
        CASE WHEN doc_id % 4 <> 0 THEN 'rid-' || list_extract(
            ['click','view','error','purchase','signup'], CAST(doc_id % 5 + 1 AS INT)) END AS remote_file_id,
        CAST(NULL AS VARCHAR) AS context_text, doc_id % 11 = 0 AS context_dirty
    FROM main_files"""
CTE["main_remote"] = """
    SELECT 'main' AS kb_id, event_id AS pos, 'rid-' || event_type AS remote_file_id,
        'n_' || user_id || '.md' AS filename FROM events"""
CTE["main_log"] = _log("main_first", "main_state", "main_remote")
CTE["main_healed"] = _healed("main_log", "main_files")
CTE["settings"] = f"""
    SELECT 'c' || c_custkey AS kb_id,
        coalesce(CASE WHEN c_nationkey < 20 THEN '/' || lower(c_mktsegment) END, '') AS target_directory,
        'http://' || c_name || '/' AS remote_url,
        CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE '' END AS remote_token,
        'kb-' || c_custkey AS knowledge_id, '' AS store_url,
        CASE c_nationkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN '' ELSE '{C.DEFAULT_LABEL}' END
            AS context_header_label,
        CAST(CASE WHEN c_nationkey % 4 = 0 THEN c_nationkey ELSE {C.DEFAULT_UPLOADS} END AS BIGINT)
            AS max_concurrent_uploads,
        c_nationkey % 4 = 0 AS convert_to_markdown
    FROM customer"""
CTE["catalog"] = """
    SELECT 'kb-' || c_custkey AS id, CASE WHEN c_nationkey % 5 <> 0 THEN c_name ELSE '' END AS name,
        CASE WHEN c_nationkey % 3 <> 0 THEN c_mktsegment ELSE '' END AS description FROM customer"""
CTE["attempts"] = """
    SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS request_id, event_id AS seq,
        CASE event_type WHEN 'click' THEN 200 WHEN 'view' THEN 500 WHEN 'error' THEN 503
            WHEN 'purchase' THEN 429 ELSE 400 END AS code FROM events"""


def _outcomes(attempts: str) -> str:
    """Outcome and attempts used per request: the first attempt that is final, or the third."""
    return f"""
    SELECT request_id, least(coalesce(min(n) FILTER (WHERE done), 3), max(n), 3) AS attempts_used,
        arg_min(code, n) FILTER (WHERE done AND n <= 3) AS final_code, arg_max(code, n) FILTER (WHERE n <= 3) AS last_seen,
        max(n) AS logged
    FROM (SELECT *, code // 100 = 2 OR (code // 100 = 4 AND code <> 429) AS done,
            row_number() OVER (PARTITION BY request_id ORDER BY seq) AS n FROM {attempts})
    GROUP BY ALL"""


OUTCOME = """CASE WHEN final_code // 100 = 2 THEN 'success' WHEN final_code IS NOT NULL THEN 'fail_fast'
    WHEN logged >= 3 THEN 'exhausted' ELSE 'pending' END"""


def _polls(status: str) -> str:
    return f"""
    SELECT file_id, arg_min(verdict, seq) FILTER (WHERE verdict IS NOT NULL) AS verdict,
        min(seq) FILTER (WHERE verdict IS NOT NULL) AS decided_at
    FROM (SELECT file_id, seq, CASE WHEN status IN ('completed', 'failed') THEN status
            WHEN status IS NULL AND row_number() OVER (PARTITION BY file_id, island, status IS NULL ORDER BY seq) >= 3
            THEN 'error' END AS verdict
        FROM (SELECT *, count(status) OVER (PARTITION BY file_id ORDER BY seq) AS island FROM ({status})))
    GROUP BY ALL"""


POLL_STATUS = """
    SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS file_id, event_id AS seq,
        CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing'
            WHEN 'purchase' THEN 'completed' WHEN 'signup' THEN '{signup}' END AS status FROM events"""
CTE["outcomes"] = _outcomes("attempts")
CTE["polled"] = _polls(POLL_STATUS.format(signup="failed"))
CTE["upload_ok"] = _outcomes("(SELECT * REPLACE (CASE WHEN code = 400 THEN 201 ELSE code END AS code) FROM attempts)")
CTE["attach_ok"] = _outcomes(
    "(SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN 503 ELSE 200 END AS code) FROM attempts)"
)
CTE["poll_ok"] = _polls(POLL_STATUS.format(signup="pending"))
CTE["configured"] = "SELECT kb_id FROM config UNION SELECT 'c' || c_custkey FROM customer"
PAGE_COUNT = f"""
    SELECT kb_id, total, CAST(greatest(ceil(total / {C.PAGE_SIZE}), 1) AS BIGINT) AS total_pages
    FROM (SELECT kb_id, count(*) FILTER (WHERE found) AS total
        FROM (SELECT kb_id, {{hit}} AS found FROM listing UNION ALL SELECT kb_id, false FROM configured) GROUP BY ALL)"""
FOUND = f"contains(lower(path), lower('{SEARCH}'))"
CTE["page_count"] = PAGE_COUNT.format(hit="true")
CTE["found_count"] = PAGE_COUNT.format(hit=FOUND)
CTE["numbered"] = f"""
    SELECT *, (rank - 1) // {C.PAGE_SIZE} + 1 AS page
    FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY path) AS rank FROM listing)"""

CTE["answers"] = """
    SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS file_id, event_id AS seq, event_type <> 'error' AS answered,
        event_type NOT IN ('error', 'signup') OR (event_type = 'signup' AND event_id % 2 = 0) AS body_ok,
        CASE WHEN event_type = 'click' THEN 'pending' WHEN event_type = 'purchase' THEN 'completed'
            WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'failed' END AS status
    FROM events"""
CTE["poll_steps"] = """
    SELECT file_id, seq, answered, streak, CASE WHEN answered AND NOT body_ok THEN 'error'
        WHEN answered AND status IN ('completed', 'failed') THEN status
        WHEN NOT answered AND streak >= 3 THEN 'error' END AS verdict
    FROM (SELECT *, row_number() OVER (PARTITION BY file_id, island, answered ORDER BY seq) AS streak
        FROM (SELECT *, count(*) FILTER (answered) OVER (PARTITION BY file_id ORDER BY seq) AS island FROM answers))"""
CTE["changes"] = """
    SELECT 'main' AS kb_id, 'u' || user_id AS file_key, '/rag/u' || user_id || '.md' AS path, event_id AS seq,
        CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'context' ELSE 'upsert' END AS op,
        CASE WHEN event_type NOT IN ('error', 'signup') THEN sha256(event_type || event_id % 7) END AS content_hash
    FROM events"""
CTE["latest"] = """
    SELECT kb_id, file_key, c.seq AS new_content_seq, c.path AS new_path, c.content_hash AS new_hash, c.op AS new_op,
        n.seq AS new_context_seq
    FROM (SELECT DISTINCT kb_id, file_key FROM changes)
    LEFT JOIN (SELECT * FROM changes WHERE op <> 'context'
        QUALIFY row_number() OVER (PARTITION BY kb_id, file_key ORDER BY seq DESC) = 1) c USING (kb_id, file_key)
    LEFT JOIN (SELECT kb_id, file_key, max(seq) AS seq FROM changes WHERE op = 'context' GROUP BY ALL) n
        USING (kb_id, file_key)"""
CTE["known_files"] = """
    SELECT 'main' AS kb_id, 'u' || c_custkey AS file_key, path AS absolute_path, hash AS content_hash,
        CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'fid-' || c_custkey END AS remote_file_id,
        CASE WHEN c_nationkey % 3 = 0 THEN 'note ' || c_custkey END AS context_text, c_nationkey % 5 = 0 AS context_dirty,
        CASE c_custkey % 3 WHEN 1 THEN 10 WHEN 2 THEN 100000000 END AS content_seq,
        CASE c_custkey % 4 WHEN 1 THEN 5 WHEN 2 THEN 100000000 END AS context_seq, path AS wanted_path,
        CASE WHEN c_custkey % 8 = 0 THEN sha256('open') ELSE hash END AS wanted_hash,
        path IS NULL AND c_custkey % 2 = 0 AS is_deleted
    FROM (SELECT *, CASE WHEN path IS NOT NULL THEN sha256('click' || c_custkey % 7) END AS hash
        FROM (SELECT *, CASE WHEN c_nationkey % 4 <> 0 THEN '/rag/u' || c_custkey || '.md' END AS path FROM customer))"""
CTE["decided"] = """
    SELECT kb_id, file_key, absolute_path, content_hash, remote_file_id, context_text, dirty AS context_dirty,
        CAST(content_seq AS BIGINT) AS content_seq, CAST(context_seq AS BIGINT) AS context_seq, wanted_path, wanted_hash,
        dead AS is_deleted, fresh OR edited AS touched,
        CASE WHEN dead THEN CASE WHEN absolute_path IS NOT NULL THEN 'ORPHAN' END
            WHEN wanted_hash IS NULL THEN NULL
            WHEN content_hash IS NULL AND NOT dirty AND context_text IS NULL THEN 'NEW'
            WHEN dirty OR content_hash IS NULL OR content_hash <> wanted_hash THEN 'UPDATE'
            WHEN fresh OR edited THEN 'SKIP' END AS action
    FROM (SELECT * REPLACE (
                CASE WHEN fresh THEN new_path ELSE wanted_path END AS wanted_path,
                CASE WHEN fresh THEN new_hash ELSE wanted_hash END AS wanted_hash,
                CASE WHEN fresh THEN new_content_seq ELSE content_seq END AS content_seq,
                CASE WHEN edited THEN new_context_seq WHEN cut THEN greatest(coalesce(context_seq, -1), new_content_seq)
                    ELSE context_seq END AS context_seq),
            CASE WHEN fresh THEN new_op = 'delete' ELSE coalesce(is_deleted, false) END AS dead,
            coalesce(context_dirty, false) OR edited AS dirty
        FROM (SELECT *, coalesce(new_context_seq > coalesce(context_seq, -1)
                AND (NOT cut OR new_context_seq > new_content_seq), false) AS edited
            FROM (SELECT *, coalesce(fresh AND new_op = 'delete', false) AS cut
                FROM (SELECT *, coalesce(new_content_seq > coalesce(content_seq, -1), false) AS fresh
                    FROM known_files FULL JOIN latest USING (kb_id, file_key)))))"""

STATE = "kb_id, file_key, absolute_path, content_hash, remote_file_id, context_text, context_dirty"
NAMES = "SELECT kb_id, path FROM disk WHERE "

BODY: dict[str, str] = {
    "ragignore_patterns": """
        SELECT CAST(doc_id AS VARCHAR) AS kb_id, line_no, pattern
        FROM (SELECT doc_id, CAST(i AS BIGINT) AS line_no,
                regexp_replace(regexp_replace(list_extract(lines, i), '^[' || blank || ']+', ''),
                    '[' || blank || ']+$', '') AS pattern
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i,
                    '\\t\\n\\x0b\\f\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}'
                        AS blank
                FROM (SELECT doc_id, string_split(odd || replace(text, '. ', odd || chr(10) || odd || '#') || odd,
                        chr(10)) AS lines
                    FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN chr(160) WHEN 1 THEN chr(8195)
                        ELSE '' END AS odd FROM documents))))
        WHERE pattern <> '' AND NOT starts_with(pattern, '#')""",
    "tracked_state": """SELECT kb_id, file_key, absolute_path, coalesce(remote_file_id, '') AS remote_file_id
        FROM state WHERE absolute_path IS NOT NULL""",
    "list_tracked": """SELECT kb_id, file_key, absolute_path, coalesce(context_text, '') AS context_text
        FROM state WHERE absolute_path IS NOT NULL ORDER BY absolute_path""",
    "resolve_config": "SELECT * FROM settings",
    "merge_config": f"""
        SELECT 'c' || c_custkey AS kb_id,
            CASE WHEN c_nationkey % 2 = 1 THEN '/data'
                ELSE coalesce(nullif(target_directory, ''), '{C.DEFAULT_ROOT}') END AS target_directory,
            'https://' || c_name AS remote_url, '' AS remote_token, 'kb-' || c_custkey AS knowledge_id,
            '{C.DEFAULT_STORE_URL}' AS store_url,
            CASE WHEN c_nationkey % 5 = 0 THEN 'Lore'
                ELSE coalesce(nullif(context_header_label, ''), '{C.DEFAULT_LABEL}') END AS context_header_label,
            CAST(c_nationkey % 3 AS BIGINT) AS max_concurrent_uploads, c_nationkey % 2 = 1 AS convert_to_markdown
        FROM customer JOIN settings ON kb_id = 'c' || c_custkey""",
    "parse_kb_files": "SELECT kb_id, pos, remote_file_id, filename FROM main_remote",
    "parse_kb_catalog": "SELECT * FROM catalog",
    "upsert_state": """
        SELECT coalesce(d.kb_id, s.kb_id) AS kb_id, coalesce(d.file_key, s.file_key) AS file_key,
            coalesce(d.path, s.absolute_path) AS absolute_path, coalesce(d.content_hash, s.content_hash) AS content_hash,
            CASE WHEN d.path IS NOT NULL THEN 'up-' || d.filename ELSE s.remote_file_id END AS remote_file_id,
            s.context_text, CASE WHEN d.path IS NOT NULL THEN false ELSE s.context_dirty END AS context_dirty
        FROM disk d FULL JOIN state s ON s.kb_id = d.kb_id AND s.file_key = d.file_key""",
    "delete_state": f"""SELECT {STATE} FROM state s WHERE NOT EXISTS (SELECT 1 FROM judged j
        WHERE j.kb_id = s.kb_id AND j.file_key = s.file_key AND j.reason <> 'kept')""",
    "set_context": f"""
        SELECT coalesce(u.kb_id, s.kb_id) AS kb_id, coalesce(u.file_key, s.file_key) AS file_key,
            s.absolute_path, s.content_hash, s.remote_file_id,
            CASE WHEN u.file_key IS NOT NULL THEN u.note ELSE s.context_text END AS context_text,
            CASE WHEN u.file_key IS NOT NULL THEN true ELSE s.context_dirty END AS context_dirty
        FROM (SELECT d.kb_id, d.file_key, coalesce(q.note, d.filename) AS note FROM disk d LEFT JOIN (
                SELECT sha256(path) || '_' || {NAME} AS file_key, 'quality ' || quality AS note
                FROM docs JOIN labels USING (doc_id)) q ON q.file_key = d.file_key) u
        FULL JOIN state s ON s.kb_id = u.kb_id AND s.file_key = u.file_key""",
    "tracked_keys": """SELECT kb_id, file_key, path FROM disk d WHERE EXISTS (
        SELECT 1 FROM state s WHERE s.kb_id = d.kb_id AND s.file_key = d.file_key)""",
    "tracked_key_count": "SELECT kb_id, count(*) AS n_keys FROM state GROUP BY ALL",
    "sizing_tier": f"""
        SELECT kb_id, n_files, CASE WHEN n_files < 1000 THEN 'XS' WHEN n_files < 5000 THEN 'S'
            WHEN n_files < 20000 THEN 'M' WHEN n_files < 100000 THEN 'L' ELSE 'XL' END AS tier,
            n_files * {C.BYTES_PER_TRACKED_FILE} AS state_bytes
        FROM (SELECT kb_id, count(*) AS n_files FROM state WHERE absolute_path IS NOT NULL GROUP BY ALL)""",
    "filter_hidden": "SELECT kb_id, path FROM flags WHERE NOT hidden",
    "filter_os_files": "SELECT kb_id, path FROM flags WHERE NOT os_file",
    "filter_extension": "SELECT kb_id, path FROM flags WHERE NOT bad_ext",
    "filter_ragignore": "SELECT kb_id, path FROM flags WHERE NOT ragignored",
    "filter_ragignore_prefix": """
        SELECT kb_id, path, CASE kb_id WHEN 'en' THEN starts_with(rel_path, 'src1')
            WHEN 'fr' THEN starts_with(rel_path, 'src2') OR list_contains(string_split(rel_path, '/'), 'src2')
            WHEN 'de' THEN starts_with(rel_path, 'drafts') OR list_contains(string_split(rel_path, '/'), 'drafts')
            WHEN 'web' THEN starts_with(rel_path, 'web/page_2') ELSE false END AS is_ragignored
        FROM disk""",
    "filter_pattern_index": """
        SELECT kb_id, path, EXISTS (SELECT 1 FROM (
                SELECT lang AS kb_id, 'doc_' || doc_id || '.' AS pattern FROM documents WHERE doc_id % 3 = 0
                UNION ALL SELECT 'web', 'page_' || page_id || '.' FROM pages WHERE page_id % 5 = 0) p
            WHERE p.kb_id = d.kb_id AND contains(d.rel_path, p.pattern)) AS is_ragignored
        FROM disk d""",
    "filter_disposition": """SELECT kb_id, path, disposition, ragignored OR os_file OR bad_ext AS is_filtered
        FROM disposed""",
    "filter_summary": """
        SELECT kb_id, count(*) FILTER (WHERE disposition = 'accepted') AS found,
            count(*) FILTER (WHERE disposition = 'unsupported_ext') AS skipped_ext,
            count(*) FILTER (WHERE disposition = 'ragignored') AS skipped_ragignored
        FROM disposed GROUP BY ALL""",
    "is_text_file": f"SELECT kb_id, path, {ext_in('filename', C.TEXT_EXTENSIONS)} AS is_text FROM disk",
    "is_markdown_file": f"SELECT kb_id, path, {ext_in('filename', C.MARKDOWN_EXTENSIONS)} AS is_markdown FROM disk",
    "search_paths": NAMES + FOUND,
    "verify_hash": """
        SELECT d.kb_id, d.path, coalesce(s.content_hash = d.content_hash, false)
            AND NOT coalesce(s.context_dirty, false) AS verified
        FROM disk d LEFT JOIN state s ON s.kb_id = d.kb_id AND s.file_key = d.file_key""",
    "content_hash": "SELECT kb_id, path, content_hash FROM disk",
    "file_key": "SELECT kb_id, path, file_key FROM disk",
    "path_parts": f"""
        SELECT kb_id, path, filename, {ext("filename")} AS ext, {STEM.format(n="filename")} AS stem
        FROM (SELECT kb_id, path, {NAME} AS filename FROM disk
            UNION ALL SELECT 'url', path, {NAME} FROM (SELECT url AS path FROM pages))""",
    "ext_to_lang": f"SELECT kb_id, path, {fence_lang('filename')} AS fence_lang FROM disk",
    "upload_filename": f"""
        SELECT d.kb_id, d.path, {upload_name("d.filename", "coalesce(g.convert_to_markdown, false)")}
            AS upload_filename
        FROM disk d LEFT JOIN config g ON g.kb_id = d.kb_id""",
    "markdown_fence": f"""SELECT kb_id, path, '```' || {fence_lang(NAME)} || chr(10) || text || chr(10) || '```'
        || chr(10) AS fenced FROM contents""",
    "context_header": f"""SELECT s.kb_id, s.file_key, {header("s.context_text", "g.context_header_label")} AS header
        FROM state s LEFT JOIN config g ON g.kb_id = s.kb_id""",
    "lossy_text": "SELECT page_id, chr(65533) || html AS decoded FROM pages",
    "html_escape": """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'),
        '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""",
    "kb_label": """SELECT id, CASE WHEN name = '' THEN id WHEN description = '' THEN name
        ELSE name || ' — ' || description END AS label FROM catalog""",
    "run_status_phase": """
        SELECT event_id, detail, phase, CASE phase WHEN 'running' THEN 'text-sky-400'
            WHEN 'error' THEN 'text-red-400' WHEN 'completed' THEN 'text-emerald-400'
            ELSE 'text-zinc-400' END AS color
        FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'Running' WHEN 'view' THEN 'Completed successfully'
                WHEN 'error' THEN 'Error: ' || props WHEN 'purchase' THEN 'Idle' ELSE props END AS detail,
            CASE event_type WHEN 'click' THEN 'running' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'error'
                WHEN 'purchase' THEN 'idle' ELSE 'unknown' END AS phase FROM events)""",
    "normalize_base_url": """SELECT page_id, rtrim(url, '/') AS base_url, rtrim(url, '/') AS slashed_url
        FROM pages""",
    "filename_index": """SELECT kb_id, filename, count(*) AS n_paths, min(path) AS first_path
        FROM main_files GROUP BY ALL""",
    "filename_paths": """SELECT kb_id, filename, path,
        row_number() OVER (PARTITION BY kb_id, filename ORDER BY path) AS rank FROM main_files""",
    "first_local_path": "SELECT kb_id, filename, path AS first_path FROM main_first",
    "reconcile_match": """SELECT r.kb_id, r.pos, r.remote_file_id, r.filename, f.path AS first_path
        FROM main_remote r JOIN main_first f ON f.kb_id = r.kb_id AND f.filename = r.filename""",
    "reconcile_heals": "SELECT * FROM main_log",
    "heal_summary": """SELECT kb_id, count(*) AS compared, count(*) FILTER (WHERE healed) AS healed,
        count(*) FILTER (WHERE healed AND was_dirty) AS healed_dirty FROM main_log GROUP BY ALL""",
    "reconcile": _after_heal("main_state", "main_healed"),
    "untracked_remote": """
        SELECT r.kb_id, r.remote_file_id, r.filename, count(*) AS n_rows, bool_and(f.path IS NULL) AS is_ghost
        FROM remote r LEFT JOIN first_path f ON f.kb_id = r.kb_id AND f.filename = r.filename
        WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.kb_id = r.kb_id AND s.remote_file_id = r.remote_file_id)
        GROUP BY ALL""",
    "kb_file_counts": """SELECT kb_id, count(pos) AS n_files
        FROM (SELECT kb_id, pos FROM remote UNION ALL SELECT kb_id, NULL FROM configured) GROUP BY ALL""",
    "classify_files": """SELECT kb_id, file_key, path, action,
        CASE WHEN action = 'UPDATE' THEN nullif(old_id, '') END AS delete_remote_id FROM classified""",
    "ingest_plan": """SELECT kb_id, file_key, path, filename, content_hash, convert, upload_filename, action,
        delete_remote_id FROM planned""",
    "upload_collisions": f"""
        SELECT kb_id, upload_filename, count(*) AS n_files
        FROM (SELECT a.kb_id, {upload_name("a.short", "coalesce(g.convert_to_markdown, false)")} AS upload_filename
            FROM (SELECT kb_id, regexp_replace(filename, '_[0-9]+', '') AS short FROM accepted) a
            LEFT JOIN config g ON g.kb_id = a.kb_id)
        GROUP BY ALL HAVING count(*) > 1""",
    "build_payload": """SELECT kb_id, path, upload_filename, action,
        CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_hash FROM payloads""",
    "chunk_payloads": f"""
        SELECT kb_id, path, chunk_no, CAST(len(chunk) AS BIGINT) AS n_words,
            array_to_string(chunk, ' ') AS chunk_text, header_words <= {C.CHUNK_TOKENS} AS header_fits
        FROM (SELECT kb_id, path, chunk_no, header_words, list_slice(words, start + 1, start + {C.CHUNK_TOKENS}) AS chunk
            FROM (SELECT *, CAST(k AS BIGINT) AS chunk_no, k * {C.CHUNK_TOKENS - C.CHUNK_OVERLAP} AS start
                FROM (SELECT *, unnest(range(0, 1 + greatest(0, len(words) - {C.CHUNK_OVERLAP} - 1)
                        // {C.CHUNK_TOKENS - C.CHUNK_OVERLAP})) AS k
                    FROM (SELECT kb_id, path,
                        list_filter(string_split_regex(payload, '[ \\t\\r\\n\\f]+'), lambda w: w <> '') AS words,
                        len(list_filter(string_split_regex(header, '[ \\t\\r\\n\\f]+'), lambda w: w <> ''))
                            AS header_words FROM payloads)
                    WHERE len(words) > 0)))""",
    "payload_parts": """SELECT kb_id, path, greatest(1, (content_bytes + 999) // 1000) AS n_parts,
        CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_hash FROM payloads""",
    "orphans_missing": """SELECT kb_id, file_key, absolute_path, remote_file_id FROM judged
        WHERE reason = 'missing'""",
    "orphans": """SELECT *, remote_file_id <> '' AS delete_remote FROM judged WHERE reason <> 'kept'""",
    "full_sync": "SELECT kb_id, file_key, path, action, reason, healed, delete_remote_id FROM run",
    "full_sync_state": f"""
        SELECT {STATE} FROM (
            SELECT r.kb_id, r.file_key,
                CASE WHEN sent THEN r.path ELSE s.absolute_path END AS absolute_path,
                CASE WHEN sent THEN d.content_hash ELSE s.content_hash END AS content_hash,
                CASE WHEN sent THEN 'up-' || d.filename ELSE s.remote_file_id END AS remote_file_id,
                s.context_text,
                coalesce(s.context_dirty, false) AND NOT sent AS context_dirty
            FROM (SELECT *, action IN ('NEW', 'UPDATE') AS sent FROM run) r
            LEFT JOIN state1 s ON s.kb_id = r.kb_id AND s.file_key = r.file_key
            LEFT JOIN disk d ON d.kb_id = r.kb_id AND d.file_key = r.file_key
            WHERE r.action <> 'ORPHAN' AND (r.is_tracked OR sent))""",
    "delivery_work": """
        SELECT kb_id, file_key, path, action, step, work, remote_file_id,
            CASE WHEN lanes > 0 THEN CAST('0x' || file_key[:8] AS BIGINT) % lanes END AS lane
        FROM (SELECT w.*, CASE WHEN g.kb_id IS NOT NULL THEN length(w.kb_id) % 3 * 4 END AS lanes
            FROM (SELECT kb_id, file_key, path, action, 2 AS step, 'upload' AS work, NULL AS remote_file_id
                FROM run WHERE action IN ('NEW', 'UPDATE')
                UNION ALL SELECT kb_id, file_key, path, action, 1, 'delete', delete_remote_id
                FROM run WHERE delete_remote_id IS NOT NULL) w
            LEFT JOIN config g ON g.kb_id = w.kb_id)""",
    "response_bodies": "SELECT file_id, seq, body_ok, status, answered FROM answers",
    "poll_bodies_outcome": """SELECT file_id, coalesce(arg_min(verdict, seq) FILTER (verdict IS NOT NULL), 'pending')
        AS outcome, coalesce(min(seq) FILTER (verdict IS NOT NULL), -1) AS decided_at FROM poll_steps GROUP BY ALL""",
    "poll_wait": """
        SELECT file_id, count(*) AS n_polls, CAST(coalesce(sum(CASE WHEN verdict IS NULL THEN
            CASE WHEN answered THEN 2000 WHEN streak = 1 THEN 500 ELSE 1000 END END), 0) AS BIGINT) AS wait_ms
        FROM (SELECT *, min(CASE WHEN verdict IS NOT NULL THEN seq END) OVER (PARTITION BY file_id) AS last FROM poll_steps)
        WHERE last IS NULL OR seq <= last GROUP BY ALL""",
    "rejected_bodies": """
        SELECT CAST(page AS VARCHAR) AS kb_id, CASE WHEN page % 7 = 3 THEN 'not_json' ELSE 'no_id' END AS reason
        FROM (SELECT event_id // 50 AS page, bool_or(event_id % 97 = 5) AS missing FROM events GROUP BY ALL)
        WHERE page % 7 = 3 OR missing""",
    "valid_kb_files": """
        SELECT CAST(event_id // 150 AS VARCHAR) AS kb_id,
            (event_id // 50) % 3 * 50 + row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS pos,
            'f' || event_id AS remote_file_id, CASE WHEN user_id % 3 = 0 THEN '' ELSE 'n' || user_id END AS filename
        FROM events WHERE event_id // 150 NOT IN (
            SELECT event_id // 150 FROM events WHERE (event_id // 50) % 7 = 3 OR event_id % 397 = 5)""",
    "valid_kb_catalog": """
        SELECT 'kb-' || c_custkey AS id, '' AS name, CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE c_mktsegment END AS description
        FROM customer WHERE c_custkey // 50 NOT IN (SELECT c_custkey // 50 FROM customer WHERE c_custkey % 211 = 7)""",
    "latest_changes": "SELECT * FROM latest",
    "apply_changes": "SELECT * FROM decided",
    "stream_deletes": """SELECT kb_id, file_key, action, remote_file_id FROM decided
        WHERE action IN ('UPDATE', 'ORPHAN') AND remote_file_id <> ''""",
    "settle": """
        SELECT kb_id, file_key,
            CASE WHEN sent THEN wanted_path WHEN NOT dropped THEN absolute_path END AS absolute_path,
            CASE WHEN sent THEN wanted_hash WHEN NOT dropped THEN content_hash END AS content_hash,
            CASE WHEN sent THEN 'up-' || file_key WHEN NOT dropped THEN remote_file_id END AS remote_file_id,
            CASE WHEN NOT dropped THEN context_text END AS context_text,
            context_dirty AND NOT sent AND NOT dropped AS context_dirty, content_seq, context_seq,
            CASE WHEN NOT dropped THEN wanted_path END AS wanted_path,
            CASE WHEN NOT dropped THEN wanted_hash END AS wanted_hash, is_deleted
        FROM (SELECT *, coalesce(action IN ('NEW', 'UPDATE'), false) AND file_key NOT LIKE '%3' AS sent,
            coalesce(action = 'ORPHAN', false) AS dropped FROM decided)""",
    "sync_summary": "SELECT kb_id, action, reason, count(*) AS n_files FROM run GROUP BY ALL",
    "sync_actions": """
        SELECT kb_id, file_key, 'HEAL' AS action, remote_file_id, NULL AS reason FROM healed
        UNION ALL SELECT kb_id, file_key, action, CASE WHEN action = 'UPDATE' THEN nullif(old_id, '') END, NULL
        FROM classified1
        UNION ALL SELECT kb_id, file_key, 'ORPHAN', remote_file_id, reason FROM judged1 WHERE reason <> 'kept'""",
    "context_listing": "SELECT * FROM listing",
    "context_page_count": "SELECT * FROM found_count",
    "context_page": f"""
        SELECT n.kb_id, n.file_key, n.path, n.context_text, n.rank, c.total_pages, least(3, c.total_pages) AS page
        FROM (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY path) AS rank FROM listing WHERE {FOUND}) n
        JOIN found_count c ON c.kb_id = n.kb_id
        WHERE (n.rank - 1) // {C.PAGE_SIZE} + 1 = least(3, c.total_pages)""",
    "numbered_pages": "SELECT * FROM numbered",
    "pager_window": f"""
        SELECT kb_id, page, total_pages, unnest(range(start, least(start + {C.PAGER_WIDTH - 1}, total_pages) + 1))
            AS offered
        FROM (SELECT *, CASE WHEN page > 3 THEN page - 2 ELSE 1 END AS start
            FROM (SELECT kb_id, total_pages, unnest(range(1, total_pages + 1)) AS page FROM page_count))""",
    "get_context": f"""
        SELECT d.kb_id, d.path, {header("s.context_text", "g.context_header_label")} AS formatted
        FROM disk d LEFT JOIN state s ON s.kb_id = d.kb_id AND s.file_key = d.file_key
        LEFT JOIN config g ON g.kb_id = d.kb_id""",
    "delivery_outcome": f"""
        SELECT request_id, CAST(attempts_used AS BIGINT) AS attempts_used,
            CAST(coalesce(final_code, last_seen) AS BIGINT) AS last_code, {OUTCOME} AS outcome FROM outcomes""",
    "delivery_backoff": f"""
        SELECT request_id, CAST(CASE attempts_used WHEN 1 THEN 0 WHEN 2 THEN {C.BACKOFF_MS}
            ELSE {3 * C.BACKOFF_MS} END AS BIGINT) AS backoff_ms FROM outcomes""",
    "poll_outcome": "SELECT file_id, coalesce(verdict, 'pending') AS outcome, coalesce(decided_at, -1) AS decided_at FROM polled",
    "committable_uploads": f"""
        SELECT u.request_id AS file_id FROM upload_ok u
        JOIN poll_ok p ON p.file_id = u.request_id AND p.verdict = 'completed'
        JOIN attach_ok a ON a.request_id = u.request_id
        WHERE {OUTCOME.replace("final_code", "u.final_code").replace("logged", "u.logged")} = 'success'
            AND {OUTCOME.replace("final_code", "a.final_code").replace("logged", "a.logged")} = 'success'""",
}

BODY["chunk_payload_parts"] = BODY["chunk_payloads"]


def _needs(text: str, known: dict[str, str]) -> list[str]:
    """Names of the shared parts that `text` reads, directly or through one another."""
    found: list[str] = []
    for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
        if name in known and name not in found:
            found += [n for n in _needs(known[name], known) if n not in found] + [name]
    return list(dict.fromkeys(found))


def build() -> dict[str, str]:
    out = {}
    for key, body in BODY.items():
        parts = [f"{name} AS MATERIALIZED ({CTE[name]})" for name in _needs(body, CTE)]
        out[key] = (f"WITH {', '.join(parts)} " if parts else "") + body.strip()
    return out
