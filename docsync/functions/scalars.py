"""Column functions over paths, hashes and payload text. All run inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsync import constants as C


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _last_dot(filename: Column) -> Column:
    """1-based position of the last dot, 0 when there is none."""
    return F.char_length(filename) - F.char_length(F.substring_index(filename, ".", -1))


def has_ext(filename: Column) -> Column:
    """A dot in first place starts a hidden name, not an extension."""
    return _last_dot(filename) > 1


def file_ext(filename: Column) -> Column:
    """Text after the last dot; null without an extension, `""` for a trailing dot."""
    return F.when(has_ext(filename), F.substring_index(filename, ".", -1))


def file_stem(filename: Column) -> Column:
    return F.when(has_ext(filename), F.left(filename, _last_dot(filename) - 1)).otherwise(filename)


def rel_path(path: Column, root: Column) -> Column:
    """Path below root, null when the path is not inside it."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substr(path, F.char_length(base) + 1))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def file_key(path: Column, filename: Column | None = None) -> Column:
    name = file_name(path) if filename is None else filename
    return F.concat(F.sha2(path, 256), F.lit("_"), name)


def ext_to_lang(filename: Column) -> Column:
    """Fence language, matched with case as written; `""` when unknown."""
    table = F.create_map(*[F.lit(v) for pair in C.FENCE_LANGUAGES.items() for v in pair])
    return F.coalesce(F.try_element_at(table, file_ext(filename)), F.lit(""))


def upload_filename(filename: Column, convert: Column) -> Column:
    from docsync.functions.predicates import is_markdown_file, is_text_file

    fenced = convert & is_text_file(filename) & ~is_markdown_file(filename)
    return F.when(fenced, F.concat(file_stem(filename), F.lit(".md"))).otherwise(filename)


def lossy_text(content: Column) -> Column:
    """Bytes as UTF-8 text, each invalid sequence replaced by U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def markdown_fence(text: Column, lang: Column) -> Column:
    return F.concat(F.lit("```"), lang, F.lit("\n"), text, F.lit("\n```\n"))


def context_header(context_text: Column, label: Column) -> Column:
    shown = F.coalesce(F.nullif(label, F.lit("")), F.lit(C.DEFAULT_LABEL))
    header = F.concat(F.lit("> **"), shown, F.lit(":**\n> "), context_text, F.lit("\n\n"))
    return F.when(F.coalesce(context_text, F.lit("")) == "", F.lit("")).otherwise(header)


def html_escape(text: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else [])
    for raw, entity in pairs:
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def kb_label(kb_id: Column, name: Column, description: Column) -> Column:
    name, description = F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))
    return (
        F.when(name == "", kb_id)
        .when(description == "", name)
        .otherwise(F.concat(name, F.lit(" — "), description))
    )


def run_status_phase(detail: Column) -> Column:
    return (
        F.when(detail == "Running", "running")
        .when(detail == "Completed successfully", "completed")
        .when(F.startswith(detail, F.lit("Error")), "error")
        .when(detail == "Idle", "idle")
        .otherwise("unknown")
    )


def run_status_color(detail: Column) -> Column:
    """Style class a run status is shown with."""
    phase = run_status_phase(detail)
    color = F.lit(C.RUN_COLORS["unknown"])
    for name, style in C.RUN_COLORS.items():
        color = F.when(phase == name, style).otherwise(color)
    return color


def normalize_base_url(url: Column) -> Column:
    return F.rtrim(url, F.lit("/"))


def pager_window(page: Column, pages: Column) -> Column:
    """Page numbers on the pager strip around `page`."""
    start = F.when(page > 3, page - 2).otherwise(F.lit(1).cast("bigint"))
    return F.sequence(start, F.least(start + (C.PAGER_WIDTH - 1), pages))


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \t\r\n\f]+"), lambda w: w != "")


def word_windows(
    words: Column, size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP
) -> Column:
    """Array of overlapping slices of `words`, which should be a stored column, not
    an expression: it is read once per slice."""
    last = F.greatest(F.size(words) - overlap - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.transform(starts, lambda s: F.slice(words, s + 1, F.lit(size)))
