"""How the sources of a language differ in their words, from exact counts.

Terms are counted per language and source; a language keeps those in enough of its documents.
Each group (language and source) and each language gives a kept term a smoothed share p in
billionths, and two shares differ by f(p, q) = floor((p - q)**2 / (p + q)).

Pairs of sources are compared over all kept terms, without meeting the terms that both lack: with
p0, q0 the shares of a term that does not occur,

    sum f(p, q) = V * f(p0, q0)
        + sum over terms of the one source   (f(p, q0) - f(p0, q0))
        + sum over terms of the other        (f(p0, q) - f(p0, q0))
        + sum over terms of both             (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

and the two middle sums need only how many terms of a source have each count.

The terms that stand out most in a group are found through a dominance skyband: f grows with the
group's count and falls with the language's, so a term is out once `k` others have at least its count
in the group, at most its count in the language, and stand before it in UTF-8. Every
partition keeps its skyband, these are merged in two steps, and what remains is ranked exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import record_batch, stored, text_bytes
from docsync.operators.skew import broadcast_if_small

MIN_DOCUMENTS = 10
RANKS = 10
BILLION = 1_000_000_000
# Distinct (language, source, term) a task remembers while it counts.
HELD_TERMS = 400_000
# Index pairs that are compared at once, and rows that wait for a comparison.
PAIRS_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 100_000
# Candidates of a group that wait until its skyband is taken again.
SKYBAND_ROWS = 4096
SALTS = 16

# Every byte that is no part of a term becomes a blank, and A-Z become a-z.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

COUNTS = "lang string, source string, term string, n long, docs long"
JOINT = "ga long, gb long, value long"
CANDIDATE = "gid long, term string, n long, lang_n long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by language and source; a row without a term for each
    group, so that groups without terms are known. What a task holds is passed on when it
    outgrows HELD_TERMS."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def counts() -> Iterator[pa.RecordBatch]:
        for (lang, source), (occurs, docs) in held.items():
            terms = list(occurs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1), pa.string()),
                    pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([*terms, None], pa.binary()).cast(pa.string()),
                    pa.array([*occurs.values(), 0], pa.int64()),
                    pa.array([*[docs[t] for t in terms], 0], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
        for group, text in zip(names, text_bytes(batch.column("text"))):
            occurs, docs = held.setdefault(group, (Counter(), Counter()))
            before = len(occurs)
            words = text.translate(TERM_BYTES).split()
            occurs.update(words)
            docs.update(set(words))
            size += len(occurs) - before
            if size > HELD_TERMS:
                yield from counts()
                held.clear()
                size = 0
    yield from counts()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 2) / (total + 2 * kept)), exactly at any size."""
    wide = "decimal(20,0)"
    whole = F.call_function("div", (n + 2).cast(wide) * F.lit(BILLION), (total + 2 * kept).cast(wide))
    return F.when(kept > 0, whole + 1)


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def joint_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ga, gb, value) with ga < gb: the last sum of the module's formula, over this task's terms.

    Rows (lang, term, gid, p, p0) come sorted by language and term, all of a term in one task.
    """
    sums: dict[tuple[int, int], int] = {}
    waiting: list[pa.RecordBatch] = []

    def compare(table: pa.Table) -> None:
        gid, p, p0 = (table.column(c).to_numpy() for c in ("gid", "p", "p0"))
        new = term_starts(table)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(gid))
        # Row i meets the rows behind it within its term.
        after = np.repeat(end, end - begin) - np.arange(len(gid)) - 1
        upto = np.concatenate([[0], np.cumsum(after)])
        at = 0
        while at < len(gid):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS_AT_ONCE, "right")) - 1)
            n = after[at:stop]
            a = np.repeat(np.arange(at, stop), n)
            b = np.arange(len(a)) - np.repeat(upto[at:stop] - upto[at], n) + a + 1
            value = gaps(p[a], p[b]) - gaps(p[a], p0[b]) - gaps(p0[a], p[b]) + gaps(p0[a], p0[b])
            groups, place = np.unique(gid, return_inverse=True)
            low, high = np.minimum(place[a], place[b]), np.maximum(place[a], place[b])
            keys, found = np.unique(low * len(groups) + high, return_inverse=True)
            total = np.zeros(len(keys), dtype=np.int64)
            np.add.at(total, found, value)
            for k, v in zip(keys.tolist(), total.tolist()):
                pair = (int(groups[k // len(groups)]), int(groups[k % len(groups)]))
                sums[pair] = sums.get(pair, 0) + v
            at = stop

    def term_starts(table: pa.Table) -> np.ndarray:
        new = np.ones(len(table), dtype=bool)
        for name in ("lang", "term"):
            column = table.column(name).combine_chunks()
            same = pa.compute.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            new[1:] = ~same if name == "lang" else new[1:] | ~same
        return new

    def settled(last: bool) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(waiting)
        waiting.clear()
        cut = len(table) if last else int(np.flatnonzero(term_starts(table))[-1])
        if cut:
            compare(table.slice(0, cut))
        waiting.extend(table.slice(cut).to_batches())
        if last or len(sums) > 500_000:
            rows = [(a, b, v) for (a, b), v in sums.items()]
            sums.clear()
            yield record_batch(rows, JOINT)

    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= ROWS_AT_ONCE:
            yield from settled(False)
    if waiting:
        yield from settled(True)


def skyband(n: np.ndarray, lang_n: np.ndarray, term: np.ndarray, k: int, block: int = 256) -> np.ndarray:
    """Places of the points that fewer than `k` others dominate.

    One dominates another with at least its `n`, at most its `lang_n` and a smaller `term`. In the
    order of descending n, ascending lang_n and term, no point dominates one before it, and
    whoever is dominated by `k` is so by `k` of the skyband: blocks are held against what was kept.
    """
    order = np.lexsort((term, lang_n, -n))
    kept = np.zeros(0, dtype=np.int64)
    for at in range(0, len(order), block):
        mine = order[at : at + block]
        for rivals in (kept, mine):
            ok = (n[rivals][None, :] >= n[mine][:, None]) & (lang_n[rivals][None, :] <= lang_n[mine][:, None])
            ok &= term[rivals][None, :] < term[mine][:, None]
            if rivals is kept:
                beaten = ok.sum(axis=1)
                mine, more = mine[beaten < k], beaten[beaten < k]
            else:
                mine = mine[ok.sum(axis=1) + more < k]
        kept = np.concatenate([kept, mine])
    return kept


def skybands(k: int):
    """The skyband of every group in this task; what waits is cut down as it grows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[tuple]] = {}
        size = 0

        def narrowed(rows: list[tuple]) -> list[tuple]:
            # UTF-8 order is that of the code points.
            place = {t: i for i, t in enumerate(sorted(r[0] for r in rows))}
            columns = np.array([(r[1], r[2], place[r[0]]) for r in rows], dtype=np.int64).T
            return [rows[i] for i in skyband(*columns, k).tolist()]

        def flushed() -> pa.RecordBatch:
            return record_batch([(g, *r) for g, rows in groups.items() for r in narrowed(rows)], CANDIDATE)

        for batch in batches:
            names = ("gid", "term", "n", "lang_n")
            for gid, *row in zip(*[batch.column(c).to_pylist() for c in names]):
                rows = groups.setdefault(gid, [])
                rows.append(tuple(row))
                size += 1
                if len(rows) % SKYBAND_ROWS == 0:
                    kept = narrowed(rows)
                    size -= len(rows) - len(kept)
                    groups[gid] = kept
            if size > 2_000_000:
                yield flushed()
                groups.clear()
                size = 0
        if groups:
            yield flushed()

    return run


def kept_counts(docs: DataFrame, min_documents: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, lang_n, first) of kept terms, and every (lang, source)."""
    thin = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = thin.mapInArrow(count_terms, COUNTS)
    by_term = counted.repartition("lang", "term").groupBy("lang", "source", "term")
    sums = by_term.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    counts = sums.select(
        "lang", "source", "term", "n",
        F.sum("n").over(term).alias("lang_n"),
        F.sum("docs").over(term).alias("lang_docs"),
        F.row_number().over(term.orderBy("source")).alias("nth"),
    )
    counts = counts.filter((F.col("lang_docs") >= min_documents) | F.col("term").isNull())
    counts = stored(counts.withColumn("first", F.col("nth") == 1).drop("nth", "lang_docs"), "term_counts")
    groups = counts.filter("term IS NULL").select("lang", "source").distinct()
    return counts.filter("term IS NOT NULL"), groups


def group_totals(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, lang, source, total, lang_total, kept, p0) of every group."""
    own = counts.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("firsts")
    )
    rows = groups.join(own, ["lang", "source"], "left").fillna(0, ["total", "firsts"])
    lang = Window.partitionBy("lang")
    rows = rows.select(
        "lang", "source", "total",
        F.sum("total").over(lang).alias("lang_total"),
        F.sum("firsts").over(lang).alias("kept"),
    )
    p0 = share(F.lit(0).cast("long"), F.col("total"), F.col("kept"))
    return stored(rows.withColumn("p0", p0).withColumn("gid", F.monotonically_increasing_id()), "groups")


def with_others(left: DataFrame, groups: DataFrame) -> DataFrame:
    """Every row of `left` (gid, lang, ...) with each other group of its language, (gb, p0_b, source_b).

    That is one row per pair of sources and row of `left`, as the result asks for. A table of groups
    that was measured as small is broadcast; else rows are spread over salts, as languages are few.
    """
    other = groups.select("lang", F.col("gid").alias("gb"), F.col("p0").alias("p0_b"), F.col("source").alias("source_b"))
    hint = broadcast_if_small(other)
    if hint is not other:
        joined = left.join(hint, "lang")
    else:
        salt = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
        spread = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.withColumn("_salt", salt).join(spread, ["lang", "_salt"]).drop("_salt")
    return joined.filter(F.col("gid") != F.col("gb"))


def pair_values(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(gid, gb, source_b, value) for every ordered pair of sources of a language."""
    sorted_terms = entries.select("lang", "term", "gid", "p", "p0").repartition("lang", "term")
    joint = sorted_terms.sortWithinPartitions("lang", "term").mapInArrow(joint_sums, JOINT)
    # How many terms of a source have each count.
    spectrum = entries.groupBy("gid", "lang", "p", "p0").agg(F.count("*").alias("terms"))
    alone = with_others(spectrum, groups).select(
        F.col("gid").alias("ga"), "gb",
        (F.col("terms") * (gap(F.col("p"), F.col("p0_b")) - gap(F.col("p0"), F.col("p0_b")))).alias("value"),
    )
    one_way = joint.unionByName(alone)
    both = one_way.unionByName(one_way.select(F.col("gb").alias("ga"), F.col("ga").alias("gb"), "value"))
    extra = both.groupBy("ga", "gb").agg(F.sum("value").alias("extra"))
    grid = with_others(groups.select("gid", "lang", "source", "kept", "p0"), groups)
    base = F.coalesce(F.col("kept") * gap(F.col("p0"), F.col("p0_b")), F.lit(0))
    out = grid.join(extra, (grid["gid"] == extra["ga"]) & (grid["gb"] == extra["gb"]), "left")
    return out.select(
        "lang", "source", F.col("source_b").alias("item"), (base + F.coalesce("extra", F.lit(0))).alias("value")
    )


def standing_terms(entries: DataFrame, ranks: int) -> DataFrame:
    """(gid, term, n, lang_n) of the terms that can be among the first `ranks` of a group."""
    schema = CANDIDATE
    above = entries.filter("p > q").select("gid", "term", "n", "lang_n")
    bands = above.mapInArrow(skybands(ranks), schema)
    salt = F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")
    bands = bands.withColumn("_salt", salt).repartition("gid", "_salt").drop("_salt").mapInArrow(skybands(ranks), schema)
    return bands.repartition("gid").mapInArrow(skybands(ranks), schema)


def source_divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs, and by which terms.

    Part `pair` ranks the other sources of the language by the sum of f over its kept terms; part
    `term` ranks the kept terms that a source has and uses more than its language does, to `ranks`.
    Terms are runs of letters of ASCII and of any code points beyond it; only A-Z are lower-cased.
    Null text, lang and source count as empty, and an empty name is a name like others. Repeated rows
    count each; a group whose language keeps no term has pairs of value 0 and no terms; no rows
    give none. Ties go by item in UTF-8. Other columns of `docs` play no part.
    """
    counts, groups = kept_counts(docs, min_documents)
    groups = group_totals(counts, groups)
    known = groups.select(
        "gid", F.col("lang").alias("_lang"), F.col("source").alias("_source"), "total", "lang_total", "kept", "p0"
    )
    entries = counts.join(broadcast_if_small(known), (F.col("lang") == F.col("_lang")) & (F.col("source") == F.col("_source")))
    entries = entries.select(
        "lang", "term", "gid", "n", "lang_n", "p0",
        share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    pairs = pair_values(entries, groups).withColumn("part", F.lit("pair"))
    top = standing_terms(entries, ranks).join(broadcast_if_small(known), "gid")
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    q = share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    terms = top.select(
        F.col("_lang").alias("lang"), F.col("_source").alias("source"), F.col("term").alias("item"),
        gap(p, q).alias("value"), F.lit("term").alias("part"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value)
    terms = terms.withColumn("rank", rank).filter(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).select(*columns).unionByName(terms.select(*columns))
