"""Tracked rows whose file is gone or no longer wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators.filters import flag_ragignored
from docsync.operators.skew import lookup_by_kb
from docsync.operators.state_ops import tracked_state


def orphans_missing(state: DataFrame, disk: DataFrame) -> DataFrame:
    """Tracked rows whose path is not in the unfiltered listing, whatever its kind."""
    present = disk.select("kb_id", F.col("path").alias("absolute_path"))
    return tracked_state(state).join(present, ["kb_id", "absolute_path"], "left_anti")


def judge_tracked(state: DataFrame, disk: DataFrame, patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """Every tracked row with `reason`: missing, then filtered, else kept.

    Being hidden is no reason: such a row is neither ingested again nor dropped.
    """
    present = disk.select(
        "kb_id", F.col("path").alias("absolute_path"), F.lit(True).alias("_present")
    )
    rows = lookup_by_kb(tracked_state(state), roots, F.col("absolute_path"))
    named = rows.withColumn("filename", S.file_name(F.col("absolute_path"))).withColumn(
        "rel_path", S.rel_path(F.col("absolute_path"), F.col("root"))
    )
    flagged = flag_ragignored(named, patterns)
    name = F.col("filename")
    filtered = F.col("is_ragignored") | P.is_os_ignored(name) | ~P.has_allowed_extension(name)
    return (
        flagged.withColumn("_filtered", filtered)
        .join(present, ["kb_id", "absolute_path"], "left")
        .withColumn(
            "reason",
            F.when(F.col("_present").isNull(), "missing")
            .when(F.col("_filtered"), "filtered")
            .otherwise("kept"),
        )
        .select("kb_id", "file_key", "absolute_path", "remote_file_id", "reason")
    )


def find_orphans(state: DataFrame, disk: DataFrame, patterns: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows to drop; `delete_remote` tells whether there is a remote file to delete."""
    return (
        judge_tracked(state, disk, patterns, roots)
        .filter(F.col("reason") != "kept")
        .withColumn("delete_remote", F.col("remote_file_id") != "")
    )
