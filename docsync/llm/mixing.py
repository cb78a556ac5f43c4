"""Mixing sources to target weights.

Every document gets a hash-random key. Keys are uniform, so equal key ranges cut a source into
buckets of about the same number of rows: a range sort within each source that
needs no sampling and splits a source of any size. Prefix sums of sizes over these buckets
tell where the source's budget ends; whole epochs come before the last, partial one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import WORD, prefix_sums, stored

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ROWS_PER_BUCKET = 10_000
SEED = 17


def word_count(text):
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(seed: int):
    """The hash-random key of a row; rows that differ have keys of their own."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text"))


def source_order(sources: DataFrame) -> DataFrame:
    """Add `place`, from 0: sources by code point, null last.

    Names are counted per leading characters first, so a window group holds only the sources
    that share them.
    """
    head = F.coalesce(F.substring("source", 1, 2), F.lit(""))
    cut = sources.withColumn("_null", F.col("source").isNull()).withColumn("_head", head)
    sums = cut.groupBy("_null", "_head").agg(F.count("*").alias("_n"))
    # Every head is two characters: a short table, whatever the number of sources.
    ahead = Window.partitionBy(F.lit(0)).orderBy("_null", "_head").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("_base", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    inside = Window.partitionBy("_null", "_head").orderBy("source")
    ranked = cut.withColumn("_in", F.row_number().over(inside)).join(base, ["_null", "_head"])
    return ranked.withColumn("place", F.col("_base") + F.col("_in") - 1).drop("_null", "_head", "_base", "_in")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add `target` to (source, source_size): weighted shares of the total, capped.

    A source stops at `epochs` times its size and the excess is shared among the others by
    weight. Each round caps what lies above its share; only two sums per round reach the driver,
    and a round that caps nothing is the last.
    """
    numbers = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = stored(
        source_order(sources).select(
            "source", "source_size", (F.col("source_size") * epochs).alias("_cap"),
            F.element_at(numbers, (F.col("place") % len(weights) + 1).cast("int")).alias("_weight"),
        ),
        "sources",
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = total, None
    while True:
        capped = F.lit(False) if weight is None else F.col("_cap") * weight <= F.col("_weight") * F.lit(float(rest))
        taken, free = weighed.agg(
            F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("_weight"))), F.lit(0)),
        ).first()
        if (total - taken, free) == (rest, weight) or not free:
            break
        rest, weight = total - taken, free
    if weight is None:
        return weighed.select("source", "source_size", F.lit(0.0).alias("target"))
    share = F.col("_weight") * F.lit(float(rest)) / F.lit(float(weight))
    cap = F.col("_cap").cast("double")
    return weighed.select("source", "source_size", F.least(cap, share).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    whole_documents: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, taken) for every row of `docs`.

    `taken` is the number of words the mix takes from a row, repeats counted: its size once per
    whole epoch, and in the last epoch what fits before the budget's end. The row in which the
    budget ends gives its first words up to it, so a source gives its target rounded
    down; with `whole_documents` that row comes in whole if at least half of it fits, else not.
    Null or empty text has size 0 and gives nothing; a null source is a source of its own; rows
    without doc_id take part; repeated rows count each. No rows give no rows. Other columns
    of `docs` play no part.
    """
    key = row_key(seed)
    sized = docs.select("doc_id", "source", key.alias("key"), word_count(F.col("text")).alias("size"))
    sized = stored(sized, "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sources = stored(sources, "source_sizes")
    plan = targets(sources.drop("_rows"), weights, epochs)
    buckets = F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_bucket)).cast("long")
    counts = sources.select(F.col("source").alias("_source"), buckets.alias("_buckets"))
    plan = plan.join(counts, F.col("source").eqNullSafe(F.col("_source"))).select(
        "_source", "_buckets", "source_size", "target"
    )
    plan = stored(plan, "targets")
    # The key's place in its range, times the number of buckets. AQE splits a hot source here.
    place = F.shiftrightunsigned("key", 33).cast("double") / F.lit(float(1 << 31))
    placed = sized.join(plan, sized["source"].eqNullSafe(plan["_source"]), "left").withColumn(
        "_bucket", F.floor(place * F.col("_buckets"))
    )
    # Ordered by bucket, then by the unsigned key inside it, which is the order of the keys.
    lot = F.shiftrightunsigned("key", 1)
    placed = stored(placed.withColumn("_lot", lot).drop("_source", "_buckets"), "placed")
    summed = prefix_sums(placed, ["source"], "_bucket", ["_lot", "key", "doc_id", "size"], "size", "_before")
    budget = F.floor("target")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    left = (budget - whole * F.col("source_size")) - F.col("_before")
    if whole_documents:
        last = F.when((left > 0) & (2 * left >= F.col("size")), F.col("size")).otherwise(0)
    else:
        last = F.greatest(F.lit(0), F.least(left, F.col("size")))
    return summed.select(
        "doc_id", "source", "key", "size", "source_size", "target",
        (whole * F.col("size") + last).cast("long").alias("taken"),
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of a mix, whole, once for each time they are taken.

    The mix is cut at whole documents. Rows keep their columns; a row taken twice
    appears twice. Rows of size 0 are not in the mix.
    """
    plan = mix(docs, whole_documents=True, **options).filter("taken > 0")
    times = plan.select(
        F.col("doc_id").alias("_id"), F.col("key").alias("_key"),
        (F.col("taken") / F.col("size")).cast("int").alias("_times"),
    )
    # The row travels as one column, so that no name of its own can clash.
    own = [F.struct("*").alias("_row"), "doc_id", "source", row_key(options.get("seed", SEED)).alias("_row_key")]
    keyed = docs.select(*own)
    # Repeated rows share a key; their takes add up and are dealt back evenly.
    dealt = times.groupBy("_id", "_key").agg(F.sum("_times").alias("_sum"), F.count("*").alias("_n"))
    on = keyed["_row_key"].eqNullSafe(dealt["_key"]) & keyed["doc_id"].eqNullSafe(dealt["_id"])
    out = keyed.join(dealt, on)
    each = F.col("_sum")
    alone = F.row_number().over(Window.partitionBy("_row_key", "doc_id").orderBy("source"))
    repeated = dealt.agg(F.max("_n")).first()[0]
    if repeated is not None and repeated > 1:
        out = out.withColumn("_nth", alone)
        each = F.floor(F.col("_sum") / F.col("_n")) + F.when(
            F.col("_nth") <= F.col("_sum") % F.col("_n"), 1
        ).otherwise(0)
        out = out.withColumn("_sum", each).filter("_sum > 0")
    return out.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int")))).select("_row.*")
