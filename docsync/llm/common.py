"""Helpers shared by the corpus operators: scratch tables, words, shingles, prefix sums."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docsync.operators.skew import shared_folder

# Words are runs of characters other than these six; bytes.split() splits at the same ones.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/docsync-llm/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back, which cuts its lineage for good."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def record_batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    """A batch of `rows` with the columns of a DDL string of long, int, double, boolean, string, binary."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in ddl.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a text, all at once.

    A word is a run of bytes outside `blanks`. Its hash is a polynomial over a random number
    for each byte, read off the running sums of the whole text, so no word becomes an object.
    With `fold`, A-Z hash like a-z. Texts are taken in parts of about `PART` bytes that end
    between words; words longer than that are hashed one by one.
    """

    PART = 1 << 18

    def __init__(self, blanks: bytes = BLANKS.encode(), fold: bool = False):
        self.value = np.random.default_rng(2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.blank = np.zeros(256, dtype=bool)
        self.blank[list(blanks)] = True
        self.value[self.blank] = 0
        self.fold = fold
        # Powers of the multiplier and of its inverse modulo 2**64.
        inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
        self.up = self.powers(MULTIPLIER)
        self.down = self.powers(inverse)

    def powers(self, base: np.uint64) -> np.ndarray:
        out = np.full(2 * self.PART + 1, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def of(self, text: bytes) -> np.ndarray:
        data = np.frombuffer(text, dtype=np.uint8)
        if len(data) <= 2 * self.PART:
            return self.of_part(data)
        blank, parts, at = self.blank[data], [], 0
        while at < len(data):
            # The part ends at the first blank from PART bytes on.
            ahead = blank[at + self.PART :]
            end = at + self.PART + int(ahead.argmax()) if len(ahead) and ahead.any() else len(data)
            if end - at > 2 * self.PART:
                before = np.flatnonzero(blank[at : at + self.PART])
                begin = at + int(before[-1]) + 1 if len(before) else at
                parts += [self.of_part(data[at:begin]), self.of_word(data[begin:end])]
            else:
                parts.append(self.of_part(data[at:end]))
            at = end
        return np.concatenate(parts)

    def of_word(self, data: np.ndarray) -> np.ndarray:
        import xxhash

        word = data.tobytes().lower() if self.fold else data.tobytes()
        return np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64)

    def of_part(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint64)
        blank = self.blank[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        bounds = np.concatenate([[0] * (not blank[0]), edge, [n] * (not blank[-1])]).astype(np.int64)
        starts, ends = bounds[0::2], bounds[1::2]
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=sums[1:])
        length = (ends - starts).astype(np.uint64)
        out = mixed((sums[ends] - sums[starts]) * self.down[starts] + length)
        for i in np.flatnonzero(ends - starts > self.PART).tolist():
            out[i] = self.of_word(data[starts[i] : ends[i]])[0]
        return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def windows(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` word ids; fewer words give one hash of them all."""
    width = min(width, len(ids))
    if not width:
        return ids
    total = np.zeros(len(ids) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = total * MULTIPLIER + ids[i : len(ids) - width + 1 + i]
    return mixed(total + np.uint64(width))


def prefix_sums(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before this one within `keys`.

    Rows of a key are ordered by `bucket`, then `order`. A window runs inside each
    (keys, bucket) only, so buckets bound its groups; a small table of bucket totals supplies
    what lies before each bucket. `df` should be stored, as it is read twice.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_in"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col(bucket).alias("_kb"),
        F.coalesce(F.sum("_in").over(ahead), F.lit(0)).cast("long").alias("_base"),
    )
    inside = (
        Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    on = ranked[bucket].eqNullSafe(base["_kb"])
    for i, k in enumerate(keys):
        on = on & ranked[k].eqNullSafe(base[f"_k{i}"])
    out = ranked.join(base, on, "left").withColumn(name, F.col("_base") + F.col("_inside"))
    return out.drop("_inside", "_base", "_kb", *[f"_k{i}" for i in range(len(keys))])
