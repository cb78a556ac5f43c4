"""The bytes that are delivered: context header, optional fence, content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators.skew import broadcast_if_small, lookup_by_kb, set_down


def due(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("action").isin("NEW", "UPDATE"))


def with_header(plan: DataFrame, config: DataFrame) -> DataFrame:
    """Turn `context_text` of each planned file into its `header`."""
    labels = config.select("kb_id", "context_header_label")
    header = S.context_header(F.col("context_text"), F.col("context_header_label"))
    return (
        lookup_by_kb(plan, labels, F.col("path"))
        .withColumn("header", F.coalesce(header, F.lit("")))
        .drop("context_text", "context_header_label")
    )


def attach_content(plan: DataFrame, contents: DataFrame, plan_is_stored: bool = False) -> DataFrame:
    """Join a content table to the plan on path.

    Content outweighs the plan by far, so the plan is set down once and measured: when the
    changed files are few it is broadcast and no content moves. Beyond that both sides are
    shuffled, content of unplanned files included unless the session's runtime
    filters apply, which they do for scans of 10 GB and more.
    """
    if not plan_is_stored:
        plan = set_down(plan, "plan")
    return contents.join(broadcast_if_small(plan), ["kb_id", "path"])


def build_payload(rows: DataFrame) -> DataFrame:
    """Add `payload`, `payload_bytes` and `payload_hash` to rows with content and header.

    Text gets the header, and a fence when it is converted; anything else is delivered
    byte for byte. Only the fence decodes the content.
    """
    name = F.col("filename")
    fenced = F.col("convert") & ~P.is_markdown_file(name)
    wrapped = S.markdown_fence(S.lossy_text(F.col("content")), S.ext_to_lang(name))
    body = F.when(fenced, wrapped.cast("binary")).otherwise(F.col("content"))
    text = F.concat(F.col("header").cast("binary"), body)
    return (
        rows.withColumn("payload", F.when(P.is_text_file(name), text).otherwise(F.col("content")))
        .withColumn("payload_bytes", F.octet_length("payload").cast("bigint"))
        .withColumn("payload_hash", F.sha2("payload", 256))
        .drop("content")
    )


def chunk_payloads(
    payloads: DataFrame, size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP
) -> DataFrame:
    """Cut the text of each `payload` into overlapping word windows, one row each.

    `header_fits` tells whether every word of `header` lies within window 0. What is
    delivered byte for byte, such as a PDF, has no words to cut.
    """
    header_words = F.size(S.split_words(F.col("header")))
    windows = F.posexplode(S.word_windows(F.col("_words"), size, overlap)).alias("chunk_no", "_chunk")
    return (
        payloads.withColumn("_words", S.split_words(S.lossy_text(F.col("payload"))))
        .filter(F.size("_words") > 0)
        .select("kb_id", "path", (header_words <= size).alias("header_fits"), windows)
        .select(
            "kb_id",
            "path",
            F.col("chunk_no").cast("bigint"),
            F.size("_chunk").cast("bigint").alias("n_words"),
            F.array_join("_chunk", " ").alias("chunk_text"),
            "header_fits",
        )
    )
