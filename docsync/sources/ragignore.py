"""Ignore files: one pattern per line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.sources.doctree import read_contents


# The code points that Unicode calls white space.
WHITE_SPACE = "".join(
    map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def trim_line(line: Column) -> Column:
    """Trim white space of every script, not only blanks and tabs."""
    return F.trim(line, F.lit(WHITE_SPACE))


def is_pattern(trimmed: Column) -> Column:
    return (trimmed != "") & ~F.startswith(trimmed, F.lit("#"))


def parse_ragignore(texts: DataFrame) -> DataFrame:
    """Patterns of whole ignore files held in `(kb_id, text)`, with their line numbers."""
    lines = texts.select("kb_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    trimmed = trim_line(F.col("line"))
    return lines.filter(is_pattern(trimmed)).select(
        "kb_id", (F.col("line_no") + 1).cast("bigint").alias("line_no"), trimmed.alias("pattern")
    )


def readable_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the lines of each `content` that are not UTF-8; a dropped line stays as a blank one."""

    def decoded(line: bytes) -> str:
        try:
            return line.decode("utf-8")
        except UnicodeDecodeError:
            return ""

    for batch in batches:
        texts = ["\n".join(map(decoded, c.split(b"\n"))) for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("kb_id"), pa.array(texts, pa.string())], ["kb_id", "text"])


def load_ragignore(spark: SparkSession, root: str, kb_id: str) -> DataFrame:
    """Patterns of the ignore file in `root`; none when it is absent or unreadable.

    Spark's own text source skips names that start with a dot, so a task opens the file.
    """
    path = f"{root.rstrip('/')}/{C.IGNORE_FILE}"
    found = read_contents(spark.createDataFrame([(kb_id, path)], "kb_id string, path string"))
    return parse_ragignore(found.select("kb_id", "content").mapInArrow(readable_lines, "kb_id string, text string"))
