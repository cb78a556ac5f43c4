"""Decide which accepted files are new, changed or already delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators.skew import lookup_by_kb


def with_convert(files: DataFrame, config: DataFrame) -> DataFrame:
    flags = config.select("kb_id", F.col("convert_to_markdown").alias("convert"))
    joined = lookup_by_kb(files, flags, F.col("path"))
    return joined.withColumn("convert", F.coalesce("convert", F.lit(False)))


def classify_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """Add `action`, `delete_remote_id` and the stored `context_text` to hashed files, by
    one left join on the key.

    A key that is not tracked is NEW, a verified hash is SKIP, all else is UPDATE, also
    for a row that so far only carries context. A file that could not be hashed is
    FAILED and comes up again next time.
    """
    stored = state.select(
        "kb_id",
        "file_key",
        F.col("content_hash").alias("_hash"),
        F.col("remote_file_id").alias("_id"),
        F.col("context_dirty").alias("_dirty"),
        "context_text",
        F.lit(True).alias("_tracked"),
    )
    action = (
        F.when(F.col("content_hash").isNull(), "FAILED")
        .when(F.col("_tracked").isNull(), "NEW")
        .when(P.verify_hash(F.col("_hash"), F.col("content_hash"), F.col("_dirty")), "SKIP")
        .otherwise("UPDATE")
    )
    return (
        files.join(stored, ["kb_id", "file_key"], "left")
        .withColumn("action", action)
        .withColumn(
            "delete_remote_id",
            F.when(F.col("action") == "UPDATE", F.nullif(F.col("_id"), F.lit(""))),
        )
        .drop("_hash", "_id", "_dirty", "_tracked")
    )


def plan_ingest(accepted: DataFrame, state: DataFrame, config: DataFrame) -> DataFrame:
    """The ingest plan: one row per accepted file, with the name it is uploaded under."""
    named = with_convert(accepted, config).withColumn(
        "upload_filename", S.upload_filename(F.col("filename"), F.col("convert"))
    )
    return classify_files(
        named.select(
            "kb_id", "file_key", "path", "filename", "content_hash", "convert", "upload_filename"
        ),
        state,
    )


def upload_collisions(plan: DataFrame) -> DataFrame:
    """Upload names that several files of a knowledge base share once converted."""
    return (
        plan.groupBy("kb_id", "upload_filename")
        .agg(F.count("*").alias("n_files"))
        .filter(F.col("n_files") > 1)
    )
