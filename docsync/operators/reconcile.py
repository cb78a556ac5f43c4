"""Repair tracked rows from what the remote knowledge base says it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators.skew import cut_into_runs, lookup_hot, ranked
from docsync.operators.state_ops import upsert_state


def visible_files(inventory: DataFrame) -> DataFrame:
    """The listing that names are matched against: the dot rule only, no other filter."""
    return inventory.filter((F.col("kind") == "file") & P.is_visible(F.col("rel_path")))


def filename_index(inventory: DataFrame) -> DataFrame:
    """Per file name: how many paths carry it and the first of them.

    The paths themselves stay rows of `inventory`; a name such as README.md can own
    any share of them, so they are never gathered into one array.
    """
    return (
        visible_files(inventory)
        .groupBy("kb_id", "filename")
        .agg(F.count("*").alias("n_paths"), F.min("path").alias("first_path"))
    )


def filename_paths(inventory: DataFrame) -> DataFrame:
    """Every path of every file name, numbered by path; number 1 is the one that names resolve to."""
    paths = visible_files(inventory).select("kb_id", "filename", "path")
    numbered = ranked(paths, ["kb_id", "filename"], "path")
    return numbered.withColumn("rank", F.col("rank").cast("bigint"))


def first_local_path(inventory: DataFrame) -> DataFrame:
    return filename_index(inventory).select("kb_id", "filename", "first_path")


def _on_name(remote: DataFrame, targets: DataFrame) -> DataFrame:
    """Join remote rows to one row per file name.

    A name may own a third of the listing, so the big join is on (name, run), a run being
    a stretch of the list cut by row count, however far apart positions lie. Each run is
    summed up first, by its last id; targets are laid out over those few summaries, which also
    yields `carried_id`, the id the list left on the name before the run began.
    """
    rows = cut_into_runs(remote, ["kb_id", "filename"], "pos")
    last = F.max_by("remote_file_id", "pos").alias("_last")
    runs = rows.groupBy("kb_id", "filename", "_run").agg(last)
    by_name = Window.partitionBy("kb_id", "filename").orderBy("_run")
    carried = runs.withColumn("carried_id", F.lag("_last").over(by_name)).drop("_last")
    laid_out = carried.join(targets, ["kb_id", "filename"])
    return rows.join(laid_out, ["kb_id", "filename", "_run"])


def reconcile_match(inventory: DataFrame, remote: DataFrame) -> DataFrame:
    """Remote rows with the local path their name resolves to."""
    return _on_name(remote, first_local_path(inventory)).drop("_run", "carried_id")


def _heal_targets(inventory: DataFrame, state: DataFrame) -> DataFrame:
    stored = state.select(
        "kb_id",
        "file_key",
        F.col("remote_file_id").alias("stored_id"),
        F.col("context_dirty").alias("was_dirty"),
    )
    return (
        first_local_path(inventory)
        .withColumnRenamed("first_path", "path")
        .withColumn("file_key", S.file_key(F.col("path")))
        .join(stored, ["kb_id", "file_key"], "left")
        .withColumn("was_dirty", F.coalesce("was_dirty", F.lit(False)))
    )


def heal_log(inventory: DataFrame, state: DataFrame, remote: DataFrame) -> DataFrame:
    """One row per matched remote row, in list order per path, with the id it met
    (`previous_id`) and whether it overwrote it (`healed`)."""
    within = Window.partitionBy("kb_id", "filename", "_run").orderBy("pos")
    previous = F.coalesce(F.lag("remote_file_id").over(within), "carried_id", "stored_id")
    return (
        _on_name(remote, _heal_targets(inventory, state))
        .withColumn("previous_id", previous)
        .withColumn("healed", ~F.col("previous_id").eqNullSafe(F.col("remote_file_id")))
        .select(
            "kb_id", "file_key", "path", "filename", "pos",
            "previous_id", "remote_file_id", "healed", "was_dirty",
        )
    )


def name_outcomes(inventory: DataFrame, remote: DataFrame) -> DataFrame:
    """What the whole remote listing leaves on each local path it names.

    Applying remote rows one after another leaves the last id, and changes something
    unless every id equals the stored one. Aggregates are enough for both, so the
    listing is combined before it is shuffled.
    """
    ids = remote.groupBy("kb_id", "filename").agg(
        F.max_by("remote_file_id", "pos").alias("last_id"),
        F.min("remote_file_id").alias("low_id"),
        F.max("remote_file_id").alias("high_id"),
    )
    return (
        first_local_path(inventory)
        .join(ids, ["kb_id", "filename"])
        .withColumn("file_key", S.file_key(F.col("first_path")))
        .select("kb_id", "file_key", "first_path", "last_id", "low_id", "high_id")
    )


def is_settled(stored_id: Column) -> Column:
    """Every remote id of the name equals the stored id."""
    return stored_id.eqNullSafe(F.col("low_id")) & (F.col("low_id") == F.col("high_id"))


def healed_rows(inventory: DataFrame, state: DataFrame, remote: DataFrame) -> DataFrame:
    """State rows that reconciliation overwrites, with the current hash of the file."""
    stored = state.select(
        "kb_id", "file_key", F.col("remote_file_id").alias("_stored"), "context_dirty"
    )
    current = inventory.select("kb_id", "file_key", "content_hash")
    return (
        name_outcomes(inventory, remote)
        .join(stored, ["kb_id", "file_key"], "left")
        .filter(~is_settled(F.col("_stored")))
        .join(current, ["kb_id", "file_key"], "left")
        .select(
            "kb_id",
            "file_key",
            F.col("first_path").alias("absolute_path"),
            F.coalesce("content_hash", F.lit("")).alias("content_hash"),
            F.col("last_id").alias("remote_file_id"),
            F.coalesce("context_dirty", F.lit(False)).alias("was_dirty"),
        )
    )


def reconcile(
    inventory: DataFrame, state: DataFrame, remote: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Reconciled state and the log of every comparison. A knowledge base without
    remote rows, or with a blank id, is left as it is.

    Remote names are matched to `filename`. Where files are uploaded under converted
    names, pass those as `filename` to have them matched too; keys come from the path.
    """
    remote = remote.filter(F.col("kb_id") != "")
    healed = healed_rows(inventory, state, remote)
    return upsert_state(state, healed), heal_log(inventory, state, remote)


def heal_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("kb_id").agg(
        F.count("*").alias("compared"),
        F.count_if("healed").alias("healed"),
        F.count_if(F.col("healed") & F.col("was_dirty")).alias("healed_dirty"),
    )


def untracked_remote(remote: DataFrame, inventory: DataFrame, state: DataFrame) -> DataFrame:
    """Remote ids that no tracked row holds; `is_ghost` marks names that no longer
    exist locally. Repeats are counted before the joins; a name with very many different ids is
    dealt over salts (see `lookup_hot`)."""
    held = state.filter("remote_file_id <> ''").select("kb_id", "remote_file_id").distinct()
    local = first_local_path(inventory).select("kb_id", "filename", F.lit(True).alias("_local"))
    ids = remote.groupBy("kb_id", "remote_file_id", "filename").agg(F.count("*").alias("n_rows"))
    rows = ids.join(held, ["kb_id", "remote_file_id"], "left_anti")
    return (
        lookup_hot(rows, local, ["kb_id", "filename"], F.col("remote_file_id"))
        .withColumn("is_ghost", F.col("_local").isNull())
        .select("kb_id", "remote_file_id", "filename", "n_rows", "is_ghost")
    )
