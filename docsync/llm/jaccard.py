"""Near-duplicate groups by a grouped prefix join on word shingles.

Shingles have a global order, common ones last, and two sets that are similar enough share one
within their first few. Documents with the same set are one; sets with the same
prefix and size are one group, and only groups meet in the join. Group pairs pass filters on size and
position before their members are expanded and compared in full.

Links inside large groups of near copies are found first, block by block around a leader, so
that the join proper only has to look for links between what is not yet connected: it decides
nothing by sampling, and no pair that could connect two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsync.llm.common import WordHasher, distinct, record_batch, stored, text_bytes, windows
from docsync.llm.components import components
from docsync.llm.sketch import SKETCH_BITS, dealt_by_token, frequency_classes, frequency_sketch, shared_only
from docsync.operators.skew import broadcast_if_small

SHINGLE = 5
PERCENT = 75
# Sets in a block around a leader, and how many of them a further set is compared with.
BLOCK = 2000
LOOK_BACK = 48

SET = "rk long, doc_id long, n long, gid long, grp long, n_cold int, prefix array<long>"


def shingle_hashes(width: int):
    """A function from a text to its sorted distinct shingles, A-Z lower-cased."""
    words = WordHasher(fold=True)
    return lambda text: distinct(windows(words.of(text), width))


def digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def probe_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


# Sets and their prefixes -------------------------------------------------------------------


def set_task(width: int, percent: int, bits: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, of_cell, shift = shingle_hashes(width), classes.value, np.uint64(64 - bits)
        for batch in batches:
            n, gid, grp, cold, parts = [], [], [], [], []
            for text in text_bytes(batch.column("text")):
                found = shingles(text)
                n.append(len(found))
                if not len(found):
                    gid.append(None)
                    grp.append(None)
                    cold.append(0)
                    parts.append(found)
                    continue
                gid.append(digest(found.tobytes()))
                kinds = of_cell[(found >> shift).astype(np.int64)]
                ordered = found
                if kinds.any():
                    # The sets are sorted by hash, so a stable sort by class keeps that order within.
                    order = np.argsort(kinds, kind="stable")
                    ordered, kinds = found[order], kinds[order]
                length = probe_length(len(found), percent)
                parts.append(ordered[:length])
                cold.append(int(np.count_nonzero(kinds[:length] == 0)))
                grp.append(digest(parts[-1].tobytes() + len(found).to_bytes(8, "little")))
            ends = np.cumsum([0, *map(len, parts)])
            values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            columns = [
                batch.column("rk"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gid, pa.int64()),
                pa.array(grp, pa.int64()), pa.array(cold, pa.int32()), prefix,
            ]
            names = [part.split()[0] for part in SET.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def postings(sets: DataFrame) -> DataFrame:
    """(tok, grp, n, pos) of the prefix tokens that at least two groups share, stored.

    Tokens the sketch knows to be common are dealt out over salts; they need no counting.
    """
    groups = sets.filter("n > 0").groupBy("grp").agg(
        F.first("n").alias("n"), F.first("n_cold").alias("n_cold"), F.first("prefix").alias("prefix")
    )
    rows = groups.select("grp", "n", "n_cold", F.posexplode("prefix").alias("pos", "tok"))
    # Size, place and whether the token is hot, in one number: this is the largest shuffle.
    hot = (F.col("pos") >= F.col("n_cold")).cast("long")
    place = F.shiftleft("n", 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(hot)
    dealt = dealt_by_token(rows.select("tok", "grp", place.alias("place")), "grp")
    kept = dealt.mapInArrow(shared_only, "tok long, grp long, place long")
    n = F.shiftright("place", 32).alias("n")
    pos = F.shiftright("place", 1).bitwiseAND(F.lit((1 << 31) - 1)).alias("pos")
    return stored(kept.select("tok", "grp", n, pos), "postings")


# Comparing sets ------------------------------------------------------------------------------


def full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sent = shingle_hashes(width), set()
        for batch in batches:
            rows = []
            for i, (gid, text) in enumerate(zip(batch.column("gid").to_pylist(), text_bytes(batch.column("text")))):
                if gid not in sent:
                    sent.add(gid)
                    rows.append((i, shingles(text).tobytes()))
            picked = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [picked.column("gid"), picked.column("places"), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["gid", "places", "members"])

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def link_blocks(percent: int, look_back: int):
    """Links inside blocks that start with their leader. With look_back 0 sets meet the leader alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, parent = None, [], {}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("hub", "salt", "gid", "members")]
            for hub, salt, gid, members in zip(*columns):
                own = np.frombuffer(members, dtype=np.uint64)
                if (hub, salt) != at:
                    at, block, parent = (hub, salt), [], {}
                if gid in parent:
                    continue
                parent[gid] = gid
                # The leader first, then the latest.
                for other, theirs in block[:1] + block[:0:-1]:
                    if root(other) != root(gid) and similar(own, theirs, percent):
                        out.append((gid, other))
                        parent[root(gid)] = root(other)
                if len(block) <= look_back:
                    block.append((gid, own))
                elif look_back:
                    block.pop(1)
                    block.append((gid, own))
            yield record_batch(out, "a long, b long")

    return run


def compare(docs: DataFrame, sets: DataFrame, blocks: DataFrame, width: int, percent: int, look_back: int) -> DataFrame:
    """Stored links (a, b) of blocks (gid, hub, salt, lead); `sets` has (gid, rk) of each set.

    A text is read again for the sets that take part, and each set travels once per block.
    """
    place = F.struct("hub", "salt", "lead")
    wanted = blocks.groupBy("gid").agg(F.collect_set(place).alias("places"))
    wanted = stored(wanted.join(sets.select("gid", "rk"), "gid"), "wanted")
    texts = docs.select("rk", "text").join(broadcast_if_small(wanted), "rk").select("gid", "places", "text")
    ddl = "gid long, places array<struct<hub:long,salt:int,lead:boolean>>, members binary"
    rows = texts.mapInArrow(full_sets(width), ddl)
    rows = rows.select("gid", F.explode("places").alias("p"), "members").select("gid", "p.*", "members")
    dealt = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("lead").desc(), "gid")
    found = dealt.mapInArrow(link_blocks(percent, look_back), "a long, b long")
    return stored(found, "links")


def in_salts(members: DataFrame, block: int) -> DataFrame:
    """Cut the members (gid, hub) of each hub into salts of about `block`, each with the hub as leader."""
    sizes = members.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    rows = members.join(sizes, "hub").select(
        "gid", "hub", F.pmod(F.xxhash64("gid"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("lead")
    )
    leads = sizes.select(
        F.col("hub").alias("gid"), "hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(True).alias("lead"),
    )
    return rows.filter("gid <> hub").unionByName(leads)


def size_steps(size: str, percent: int):
    """Logarithm of a size: sets that can be similar differ by at most 1."""
    return F.log(size) / F.lit(float(np.log(100 / percent)))


def may_be_similar(percent: int) -> str:
    """Bounds on what groups g and h can share, from `met`, the number of tokens both prefixes
    have, and the places of the first of them.

    Before its first shared token a set has none, and of tokens beyond the prefixes only as
    many can be shared as the longer rest holds.
    """
    least = f"(({percent} * (gn + hn) + {99 + percent}) div {100 + percent})"
    rest = f"greatest(({percent} * gn + 99) div 100, ({percent} * hn + 99) div 100) - 1"
    return f"least(gn - gp, hn - hp) >= {least} AND met + {rest} >= {least}"


def leaders(shared: DataFrame, percent: int) -> DataFrame:
    """(g, h): for each group g, the groups h that lead most of the tokens they share, where
    the two may be similar.

    The leader of a token among sets of about one size is the one that hashes lowest. Sizes are
    cut twice, half a step apart, so that no border parts sets of nearly the same size.
    """
    cut = shared.withColumn("grid", F.explode(F.array(F.lit(0.0), F.lit(0.5)))).withColumn(
        "band", F.floor(size_steps("n", percent) + F.col("grid"))
    )
    keys = ["tok", "grid", "band"]
    first = cut.groupBy(*keys).agg(F.min_by("grp", F.xxhash64("grp")).alias("hub"), F.count("*").alias("held"))
    votes = cut.join(first.filter("held > 1"), keys).filter("grp <> hub")
    votes = votes.groupBy("grp", "grid", "hub").agg(F.count("*").alias("votes"))
    best = F.max_by("hub", F.struct("votes", F.xxhash64("hub")))
    pairs = votes.groupBy("grp", "grid").agg(best.alias("h")).select(F.col("grp").alias("g"), "h").distinct()
    return bounded(pairs, shared, percent)


def bounded(pairs: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (g, h) that may be similar by all tokens that both prefixes have."""
    mine = shared.select("tok", F.col("grp").alias("g"), F.col("n").alias("gn"), F.col("pos").alias("gp"))
    theirs = shared.select("tok", F.col("grp").alias("h"), F.col("n").alias("hn"), F.col("pos").alias("hp"))
    rows = pairs.join(mine, "g").join(theirs, ["h", "tok"]).groupBy("g", "h").agg(
        F.count("*").alias("met"), F.first("gn").alias("gn"), F.first("hn").alias("hn"),
        F.min("gp").alias("gp"), F.min("hp").alias("hp"),
    )
    return rows.filter(may_be_similar(percent)).select("g", "h")


def open_pairs(shared: DataFrame, labelled: DataFrame, percent: int) -> DataFrame:
    """(a, b) sets of candidate group pairs that are not in one component yet."""
    spans = labelled.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    placed = shared.join(spans, "grp")
    tokens = placed.groupBy("tok").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi")).filter("_lo <> _hi")
    placed = stored(placed.join(tokens, "tok").drop("_lo", "_hi"), "open_postings")
    # The smaller set looks among those of its size band and the next.
    band = F.floor(size_steps("n", percent))
    small = placed.select(
        "tok", F.explode(F.array(band, band + 1)).alias("band"), F.col("grp").alias("g"), F.col("n").alias("gn"),
        F.col("pos").alias("gp"), F.col("lo").alias("glo"), F.col("hi").alias("ghi"),
    )
    large = placed.select(
        "tok", band.alias("band"), F.col("grp").alias("h"), F.col("n").alias("hn"), F.col("pos").alias("hp"),
        F.col("lo").alias("hlo"), F.col("hi").alias("hhi"),
    )
    close = f"""
        (gn < hn OR gn = hn AND g < h) AND 100 * gn >= {percent} * hn
        AND NOT (glo = ghi AND hlo = hhi AND glo = hlo)
        AND least(gn - gp, hn - hp) >= ({percent} * (gn + hn) + {99 + percent}) div {100 + percent}
    """
    # A similar pair passes at the first token it shares; only such pairs are counted through.
    pairs = small.join(large, ["tok", "band"]).filter(close).select("g", "h").distinct()
    pairs = bounded(pairs, placed, percent)
    mixed = spans.filter("lo <> hi").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    a = labelled.select(F.col("grp").alias("g"), F.col("gid").alias("a"), F.col("comp").alias("ca"))
    b = labelled.select(F.col("grp").alias("h"), F.col("gid").alias("b"), F.col("comp").alias("cb"))
    return pairs.unionByName(mixed).join(a, "g").join(b, "h").filter("ca <> cb AND (g <> h OR a < b)").select("a", "b")


def near_rows(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """(rk, doc_id, n_shingles, component_id) of every row of `docs`; see near_groups."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("rk", F.xxhash64("doc_id", "text"))
    classes = spark.sparkContext.broadcast(frequency_classes(frequency_sketch(rows, shingle_hashes, (width,), sketch_bits)))
    with_sets = rows.select("rk", "doc_id", "text").mapInArrow(set_task(width, percent, sketch_bits, classes), SET)
    with_sets = stored(with_sets, "sets")
    sets = with_sets.filter("n > 0").groupBy("gid").agg(
        F.min("rk").alias("rk"), F.min("doc_id").alias("doc_id"), F.min("grp").alias("grp")
    )
    sets = stored(sets, "distinct_sets")
    shared = postings(with_sets)

    # Links to the leader of a group of sets, and to the leader of similar groups.
    heads = sets.groupBy("grp").agg(F.min("gid").alias("head"), F.count("*").alias("held"))
    members = sets.join(heads.filter("held > 1"), "grp").select("gid", F.col("head").alias("hub"))
    led = leaders(shared, percent).join(heads.select(F.col("grp").alias("g"), F.col("head").alias("gid")), "g")
    led = led.join(heads.select(F.col("grp").alias("h"), F.col("head").alias("hub")), "h")
    members = members.unionByName(led.select("gid", "hub")).distinct()
    blocks = in_salts(stored(members, "members"), BLOCK)
    links = compare(rows, sets, blocks, width, percent, LOOK_BACK)
    found = components(links)

    # Every candidate pair that could still connect two components.
    labelled = sets.join(found, sets["gid"] == found["node"], "left").select(
        "gid", "grp", F.coalesce("component", "gid").alias("comp")
    )
    labelled = stored(labelled, "labelled")
    pairs = stored(open_pairs(shared, labelled, percent), "open_pairs")
    blocks = in_salts(pairs.select(F.col("b").alias("gid"), F.col("a").alias("hub")).distinct(), BLOCK)
    more = compare(rows, sets, blocks, width, percent, 0)
    if more.limit(1).count():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    of_set = sets.join(found, sets["gid"] == found["node"], "left").select(
        "gid", "doc_id", F.coalesce("component", "gid").alias("comp")
    )
    least = of_set.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    of_set = stored(of_set.join(least, "comp").select(F.col("gid").alias("_gid"), "component_id"), "of_set")
    out = with_sets.join(of_set, with_sets["gid"] == of_set["_gid"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("rk", "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def near_groups(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of `docs`.

    A text's set holds its distinct runs of `width` words; a shorter text is one run; a null or
    empty one has none and is linked with nothing. Two rows are linked when their sets
    share at least `percent` of their union; component_id is the least doc_id that links reach.
    Rows without doc_id link as others do but lend no id: a component of such rows alone has
    none. Repeated rows each give a row; no rows give none; other columns play no part.
    """
    return near_rows(docs, percent, width).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """The rows of `docs` whose doc_id is their component's, with their own columns.

    Rows that repeat doc_id and text are one document; one of them stays. Rows without words
    all stay, as do rows of a component without any doc_id.
    """
    # The row travels as one column, so that no name of its own can clash.
    marked = docs.select(F.struct("*").alias("_row"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("_rk"))
    judged = stored(near_rows(docs, percent, width), "judged")
    gone = judged.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("rk").alias("_rk")).distinct()
    out = marked.join(broadcast_if_small(stored(gone, "gone")), "_rk", "left_anti")
    twice = judged.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("rk").count().filter("count > 1")
    twice = stored(twice.select(F.col("rk").alias("_rk")), "twice")
    if twice.limit(1).count():
        again = out.join(broadcast_if_small(twice), "_rk", "left_semi").dropDuplicates(["_rk"])
        out = out.join(broadcast_if_small(twice), "_rk", "left_anti").unionByName(again)
    return out.select("_row.*")
