"""Reads and writes of the tracked-state relation, each a DataFrame to DataFrame step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.schemas import STATE_COLUMNS

KEY = ["kb_id", "file_key"]


def tracked_state(state: DataFrame) -> DataFrame:
    """Rows that name a file, for cleanup. An absent remote id reads as blank."""
    return state.filter(F.col("absolute_path").isNotNull() & (F.col("file_key") != C.CONFIG_KEY)).select(
        *KEY, "absolute_path", F.coalesce("remote_file_id", F.lit("")).alias("remote_file_id")
    )


def list_tracked(state: DataFrame) -> DataFrame:
    """Every tracked file with its context text, by path."""
    return (
        state.filter(F.col("absolute_path").isNotNull() & (F.col("file_key") != C.CONFIG_KEY))
        .select(*KEY, "absolute_path", F.coalesce("context_text", F.lit("")).alias("context_text"))
        .orderBy("absolute_path")
    )


def tracked_keys(keys: DataFrame, state: DataFrame) -> DataFrame:
    return keys.join(state.select(*KEY), KEY, "left_semi")


def upsert_state(state: DataFrame, delivered: DataFrame) -> DataFrame:
    """Record path, hash and remote id of delivered files and clear the dirty mark.
    Context text is kept. `delivered` has one row per key."""
    new = delivered.select(
        *KEY,
        F.col("absolute_path").alias("_path"),
        F.col("content_hash").alias("_hash"),
        F.col("remote_file_id").alias("_id"),
        F.lit(True).alias("_new"),
    )

    def pick(new_value: str, old_value: str):
        return F.when(F.col("_new"), F.col(new_value)).otherwise(F.col(old_value)).alias(old_value)

    return state.join(new, KEY, "full").select(
        *KEY,
        pick("_path", "absolute_path"),
        pick("_hash", "content_hash"),
        pick("_id", "remote_file_id"),
        "context_text",
        F.when(F.col("_new"), False).otherwise(F.col("context_dirty")).alias("context_dirty"),
    )


def delete_state(state: DataFrame, orphans: DataFrame) -> DataFrame:
    """Drop orphan rows whole, context included, whatever became of the remote delete."""
    return state.join(orphans.select(*KEY).distinct(), KEY, "left_anti")


def set_context(state: DataFrame, updates: DataFrame) -> DataFrame:
    """Set context text and the dirty mark; of several updates to a key the highest
    `seq` wins. An unseen key gets a row that carries only context, a blank key none."""
    last = (
        updates.filter(F.coalesce("file_key", F.lit("")) != "")
        .groupBy(*KEY)
        .agg(F.max_by(F.coalesce("context_text", F.lit("")), "seq").alias("_text"))
        .withColumn("_new", F.lit(True))
    )
    joined = state.join(last, KEY, "full")
    text = F.when(F.col("_new"), F.col("_text")).otherwise(F.col("context_text"))
    dirty = F.when(F.col("_new"), True).otherwise(F.col("context_dirty"))
    return (
        joined.withColumn("context_text", text)
        .withColumn("context_dirty", dirty)
        .select(*STATE_COLUMNS)
    )


def merge_config(existing: DataFrame, form: DataFrame) -> DataFrame:
    """Config rows to save. A blank root, store url or label in `form` falls back to the
    existing row, then to a constant; every other field is saved as given."""
    defaults = {
        "target_directory": C.DEFAULT_ROOT,
        "store_url": C.DEFAULT_STORE_URL,
        "context_header_label": C.DEFAULT_LABEL,
    }
    old = existing.select("kb_id", *[F.col(c).alias(f"_{c}") for c in defaults])

    def filled(name: str):
        new, before = F.nullif(F.col(name), F.lit("")), F.nullif(F.col(f"_{name}"), F.lit(""))
        return F.coalesce(new, before, F.lit(defaults[name])).alias(name)

    return form.join(old, "kb_id", "left").select(
        "kb_id", *[filled(c) if c in defaults else c for c in C.CONFIG_FIELDS]
    )
