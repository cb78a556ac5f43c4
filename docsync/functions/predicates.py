"""Boolean column functions: what a file is and whether a row is in sync."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.functions.scalars import file_ext


def _ext_in(filename: Column, names: list[str]) -> Column:
    return F.coalesce(F.lower(file_ext(filename)).isin(names), F.lit(False))


def is_visible(rel_path: Column) -> Column:
    """No component of the path below the root starts with a dot."""
    return ~(F.startswith(rel_path, F.lit(".")) | F.contains(rel_path, F.lit("/.")))


def is_os_ignored(filename: Column) -> Column:
    return filename.isin(C.OS_FILES)


def has_allowed_extension(filename: Column) -> Column:
    return _ext_in(filename, C.ALLOWED_EXTENSIONS)


def is_text_file(filename: Column) -> Column:
    return _ext_in(filename, C.TEXT_EXTENSIONS)


def is_markdown_file(filename: Column) -> Column:
    return _ext_in(filename, C.MARKDOWN_EXTENSIONS)


def pattern_matches(rel_path: Column, pattern: Column, dialect: str = "substring") -> Column:
    """`substring`: pattern occurs anywhere. `prefix`: leading text (a trailing star
    is dropped) or one whole component."""
    if dialect == "substring":
        return F.contains(rel_path, pattern)
    if dialect == "prefix":
        rel = F.replace(rel_path, F.lit("\\"), F.lit("/"))
        star = F.endswith(pattern, F.lit("*"))
        lead = F.when(star, F.left(pattern, F.char_length(pattern) - 1)).otherwise(pattern)
        return F.startswith(rel, lead) | F.array_contains(F.split(rel_path, "/"), pattern)
    raise ValueError(f"unknown ignore dialect: {dialect}")


def path_contains(path: Column, search: str) -> Column:
    """Case-insensitive search; an empty search matches everything."""
    return F.contains(F.lower(path), F.lower(F.lit(search)))


def verify_hash(stored: Column, current: Column, dirty: Column) -> Column:
    return F.coalesce(stored == current, F.lit(False)) & ~F.coalesce(dirty, F.lit(False))
