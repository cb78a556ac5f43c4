"""Joins and windows that stay bounded when one key holds a large share of the rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 128 * 1024 * 1024
SALTS = 64
# Rows of one key that may meet in one task.
HOT_ROWS = 1_000_000


def literal_bytes(df: DataFrame) -> int | None:
    """Bytes of literal rows, from their plan; None for anything else."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(str(plan.stats().sizeInBytes())) if plan.nodeName() == "LocalRelation" else None


def fits_broadcast(df: DataFrame) -> bool:
    """Measure a side before it is broadcast. Literal rows are sized from their plan;
    anything else costs one aggregation over that side."""
    size = literal_bytes(df)
    if size is not None:
        return size <= BROADCAST_BYTES
    width = F.lit(16 * len(df.columns))
    for field in df.schema.fields:
        if field.dataType.typeName() in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(field.name), F.lit(0))
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Mark a stored side for broadcast when its measured size allows it."""
    return F.broadcast(df) if fits_broadcast(df) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a single machine, as in
    tests, gets one of its own; on a cluster each machine would have another, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="docsync-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def set_down(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docsync/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def full_join_stored(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of a big table with a stored, usually small one, unique on `keys`.

    A full join always shuffles both sides. While `small` can be broadcast, the same rows
    come from a left join, plus the rows of `small` that met no partner, and `big` stays
    where it is.
    """
    if not fits_broadcast(small):
        return big.join(small, keys, "full")
    hits = big.select(*keys).join(F.broadcast(small.select(*keys)), keys, "left_semi")
    unmet = small.join(hits, keys, "left_anti")
    joined = big.join(F.broadcast(small), keys, "left")
    return joined.unionByName(unmet, allowMissingColumns=True)


def salted(df: DataFrame) -> DataFrame:
    """Repeat every row once per salt."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def with_salt(df: DataFrame, spread: Column) -> DataFrame:
    """Give every row one salt, from the hash of `spread`."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))


def lookup_by_kb(left: DataFrame, right: DataFrame, spread: Column) -> DataFrame:
    """Left join on `kb_id` with a table of one row per knowledge base.

    One knowledge base can own most of `left`, so a right side that is too big to
    broadcast is salted, and `left` is spread over the salts.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right), "kb_id", "left")
    joined = with_salt(left, spread).join(salted(right), ["kb_id", "_salt"], "left")
    return joined.drop("_salt")


def cut_into_runs(df: DataFrame, keys: list[str], order: str, runs: int | None = None) -> DataFrame:
    """Set `df` down with `_run`: the number of the range it falls in, in the order of `keys` and `order`.

    Ranges are cut by row count (Spark samples the rows), so a run holds about as many rows as
    any other however many rows a key has and however far apart its positions lie. Runs of a key
    have ascending numbers. `order` should be unique within a key. The table is written because
    a second reading would sample anew and cut elsewhere.
    """
    columns = [*keys, order]
    ranged = df.repartitionByRange(*columns) if runs is None else df.repartitionByRange(runs, *columns)
    return set_down(ranged.withColumn("_run", F.spark_partition_id().cast("bigint")), "runs")


def run_lag(df: DataFrame, keys: list[str], order: str, column: str, depth: int, runs: int | None = None) -> DataFrame:
    """Add `<column>_lag1..depth`: earlier values of `column` within `keys` by `order`.

    A window runs inside each run of a key (see `cut_into_runs`), so none holds more than a run.
    Only the first and last `depth` rows of each run meet in a second window, which carries
    values across run borders and holds a few rows per run of the key.
    """
    lags = [f"{column}_lag{i}" for i in range(1, depth + 1)]
    ordered = Window.partitionBy(*keys, "_run").orderBy(order)
    rows = (
        cut_into_runs(df, keys, order, runs)
        .withColumn("_from_start", F.row_number().over(ordered))
        .withColumn("_ahead", F.lead(order, depth).over(ordered))
    )
    for i, name in enumerate(lags, 1):
        rows = rows.withColumn(name, F.lag(column, i).over(ordered))
    head = F.col("_from_start") <= depth
    tail = F.col("_ahead").isNull()
    across = Window.partitionBy(*keys).orderBy(order)
    borders = rows.filter(head | tail)
    for i, name in enumerate(lags, 1):
        borders = borders.withColumn(name, F.lag(column, i).over(across))
    out = rows.filter(~head).unionByName(borders.filter(head))
    return out.drop("_run", "_from_start", "_ahead")


def ranked(df: DataFrame, keys: list[str], order: str, runs: int | None = None) -> DataFrame:
    """Add `rank`: exact 1-based position of each row within `keys` by `order`.

    Rows are dealt out by ranges of the order; a window ranks each range alone, and a table of range
    sizes, one row for each key and range, supplies how many rows come before. Nothing of
    the order passes through the driver or the plan.
    """
    cut = cut_into_runs(df, keys, order, runs)
    sizes = cut.groupBy(*keys, "_run").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_run", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    return (
        cut.withColumn("_local", local)
        .join(offsets, [*keys, "_run"])
        .withColumn("rank", F.col("_before") + F.col("_local"))
        .drop("_run", "_local", "_before")
    )


def lookup_hot(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join on `keys` with a table of one row per key, where few keys may own most of `left`.

    Keys are counted first, combined before the shuffle. One with more than `hot_rows` rows gets a salt
    for each `hot_rows` of them: its rows are dealt over the salts by the hash of `spread`, and its one
    row on the right is repeated.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_rows)
    salts = counts.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    # One row for each `hot_rows` rows of `left` at most.
    salts = broadcast_if_small(set_down(salts, "hot_keys"))
    n = F.coalesce("_salts", F.lit(1))
    dealt = left.join(salts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), n).cast("int"))
    repeated = right.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.drop("_salts").join(repeated.drop("_salts"), [*keys, "_salt"], "left").drop("_salt")
