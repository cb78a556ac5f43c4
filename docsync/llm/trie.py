"""The prefix trie of conversations, from sorted shards of padded turn-id matrices.

A turn is known by 128 bits of a SHA-256 over its role and text, a conversation by those of its
turns in order. Conversations are range-partitioned by them, so every node of the trie owns a run of
neighbouring rows. A shard numbers its turns, lays its rows out as matrices of turn ids, padded
with 0 and `SLAB` turns wide (rows that go on longer meet in a next matrix), and sorts them by
numpy's lexsort. Where a column differs from the row above, or any column before it does, a node starts:
an OR-accumulated mask per matrix; `reduceat` over the starts of a column gives counts, least
ids and sums of its nodes.

Only nodes on the paths of a shard's first and last row can go on in another shard. They leave the
shard as parts under the digest of their path, with what lies below them summed as if it were whole,
and are put together by that digest. Sums below counted a node once per shard; as shards
follow the order of the trie, the nodes below another one are a stretch of (first shard, depth), and two
running sums over the shards give what must be taken back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync.llm.common import prefix_sums, stored
from docsync.operators.skew import broadcast_if_small

# Own turns that are replaced by those of the head conversation are at most 5.
HEADS, FAMILY = 6, 100
DIGEST = 16
SLAB = 32
TURNS_PER_SHARD = 200_000
# Ids of conversations to one row of a list that is hashed across shards.
IDS_PER_PART = 1000

# `key` and `shard` are set on parts of nodes that may go on elsewhere, `parent_key` on nodes
# whose parent may; `ids` only on rows that carry a part of the ids that end at a node.
NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, key binary, parent_key binary, shard long, points long, "
    "leaf long, part long, ids string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NOTHING = hashlib.sha256(b"").hexdigest()


def path_key(digests: bytes) -> bytes:
    return hashlib.blake2b(digests, digest_size=DIGEST).digest()


class Slab:
    """Turns `first` to `first + width` of the rows that have any, sorted, with the starts of nodes.

    `group` is the place of a row's node at depth `first` among those of the slab before.
    """

    def __init__(self, rows, group, first, shard):
        left = shard.length[rows] - first
        self.first, self.width = first, int(min(SLAB, left.max(initial=0)))
        column = np.arange(self.width)
        there = column[None, :] < left[:, None]
        place = np.where(there, shard.begin[rows][:, None] + first + column[None, :], 0)
        ids = np.where(there, shard.ids[place] if len(shard.ids) else 0, 0)
        # Rows that end at the lower border come before those that go on, as everywhere else.
        order = np.lexsort((shard.conv[rows], left > self.width, *ids.T[::-1], group))
        self.rows, self.group, self.ids, self.place = rows[order], group[order], ids[order], place[order]
        m = len(rows)
        change = np.ones((m, self.width), dtype=bool)
        change[1:] = self.ids[1:] != self.ids[:-1]
        self.new_group = np.ones(m, dtype=bool)
        self.new_group[1:] = self.group[1:] != self.group[:-1]
        if self.width:
            change[:, 0] |= self.new_group
        self.edge = np.logical_or.accumulate(change, axis=1)
        self.start = self.edge & (self.ids != 0)
        self.length = shard.length[self.rows]

    def next_rows(self):
        """Rows that go on behind this slab, and the number of their node at its last column."""
        on = self.length > self.first + self.width
        number = np.cumsum(self.edge[:, -1]) - 1 if self.width else np.zeros(len(on), dtype=np.int64)
        return self.rows[on], number[on]


class Shard:
    """The nodes of one shard's conversations."""

    def __init__(self, conv: np.ndarray, digests: list[bytes], points: np.ndarray, number: int):
        self.conv, self.points, self.number = conv, points, number
        self.length = np.array([len(d) // DIGEST for d in digests], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.flat = b"".join(digests)
        self.ids = self.numbered(np.frombuffer(self.flat, dtype=">u8").reshape(-1, 2))
        self.out: list[dict] = []
        self.parts: list[tuple] = []

    @staticmethod
    def numbered(pairs: np.ndarray) -> np.ndarray:
        """Dense ids from 1, in the order of the digests."""
        high, low = pairs[:, 0].astype(np.uint64), pairs[:, 1].astype(np.uint64)
        order = np.lexsort((low, high))
        new = np.ones(len(order), dtype=np.int64)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        ids = np.empty(len(order), dtype=np.int64)
        ids[order] = np.cumsum(new)
        return ids

    def key(self, row: int, depth: int) -> bytes:
        at = int(self.begin[row]) * DIGEST
        return path_key(self.flat[at : at + depth * DIGEST])

    def slabs(self) -> list[Slab]:
        slabs, rows = [], np.arange(len(self.conv))
        group = np.zeros(len(rows), dtype=np.int64)
        while len(rows) and (not slabs or slabs[-1].width == SLAB):
            slabs.append(Slab(rows, group, slabs[-1].first + SLAB if slabs else 0, self))
            rows, group = slabs[-1].next_rows()
        return slabs

    def nodes(self) -> None:
        slabs = self.slabs()
        self.on_border = dict(zip((slab.first for slab in slabs), zip(*self.borders(slabs))))
        below = None
        for above, slab in reversed(list(zip([None, *slabs], slabs))):
            below = self.slab_nodes(slab, above, below)
        ends = slab.rows[slab.length == 0]
        children, leaves, saved = (int(x[0]) for x in below[:3])
        leaf = np.array([children == 0], dtype=np.int64)
        self.emit(
            depth=0, conv=np.array([self.conv.min()]), n=np.array([len(self.conv)]), children=np.array([children]),
            leaf=leaf, leaves=leaves + leaf, saved=np.array([saved]), points=np.zeros(1, dtype=np.int64),
            parent=None, keys={0: path_key(b"")}, parent_keys={}, ends=[self.conv[ends]],
        )

    @staticmethod
    def borders(slabs: list[Slab]) -> tuple[list[bool], list[bool]]:
        """Whether the paths of the shard's first and last row go on in each slab."""
        first, last = [True], [True]
        for slab, after in zip(slabs, slabs[1:]):
            end, node = slab.first + slab.width, np.cumsum(slab.edge[:, -1])
            # The first row ends where one of its node does; the last goes on if one of its node does.
            ends_here = (slab.length[node == 1] == end).any()
            goes_on = (slab.length[node == node[-1]] > end).any()
            first.append(bool(first[-1] and slab.ids[0, -1] and not ends_here))
            last.append(bool(last[-1] and slab.ids[-1, -1] and goes_on))
        return first, last

    def slab_nodes(self, slab: Slab, above: Slab | None, below):
        """Emit the nodes of a slab. Returns, per node at its upper border that goes on in it: children,
        leaves, saved tokens, and the node's number there; `below` is that of the next slab."""
        m, conv = len(slab.rows), self.conv[slab.rows]
        leaves, saved = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        starts = [np.flatnonzero(slab.edge[:, c]) for c in range(slab.width)]
        least = [np.minimum.reduceat(conv, s) for s in starts]
        children = None
        if below is not None:
            # One entry for each node of the last column that has something behind it.
            children = np.zeros(len(starts[-1]), dtype=np.int64)
            places = below[3]
            children[places] = below[0]
            leaves[starts[-1][places]], saved[starts[-1][places]] = below[1], below[2]
        for c in range(slab.width - 1, -1, -1):
            seg, depth = starts[c], slab.first + c + 1
            has = slab.ids[seg, c] != 0
            n = np.diff(np.append(seg, m))
            if c + 1 < slab.width:
                children = np.add.reduceat(slab.start[:, c + 1].astype(np.int64), seg)
            elif children is None:
                children = np.zeros(len(seg), dtype=np.int64)
            leaf = ((children == 0) & has).astype(np.int64)
            points = np.where(has, self.points[slab.place[seg, c]] if len(self.points) else 0, 0)
            leaves[seg] += leaf
            saved[seg] += np.where(has, (n - 1) * points, 0)
            # Rows whose node ends at this depth come first in its run.
            n_ends = np.add.reduceat((slab.length == depth).astype(np.int64), seg)
            if c:
                parent = np.searchsorted(starts[c - 1], seg, "right") - 1
                parent_conv = least[c - 1][parent]
                parent_keys = self.border_keys(slab, c - 1)
            elif above is not None:
                parent = slab.group[seg]
                nodes = np.flatnonzero(above.edge[:, -1])
                parent_conv = np.minimum.reduceat(self.conv[above.rows], nodes)[parent]
                parent_keys = self.border_keys(above, above.width - 1)
            else:
                parent, parent_conv, parent_keys = np.zeros(len(seg), dtype=np.int64), None, {0: path_key(b"")}
            keys = self.border_keys(slab, c)
            keep = np.flatnonzero(has)
            self.emit(
                depth=depth, conv=least[c][keep], n=n[keep], children=children[keep], leaf=leaf[keep],
                leaves=np.add.reduceat(leaves, seg)[keep], saved=np.add.reduceat(saved, seg)[keep],
                points=points[keep], parent=None if parent_conv is None else parent_conv[keep],
                keys={int(np.searchsorted(keep, k)): v for k, v in keys.items()},
                parent_keys={int(i): parent_keys[p] for i, p in enumerate(parent[keep].tolist()) if p in parent_keys},
                ends=[conv[a : a + e] for a, e in zip(seg[keep].tolist(), n_ends[keep].tolist())],
            )
        groups = np.flatnonzero(slab.new_group)
        count = (
            np.add.reduceat(slab.start[:, 0].astype(np.int64), groups)
            if slab.width
            else np.zeros(len(groups), dtype=np.int64)
        )
        return count, np.add.reduceat(leaves, groups), np.add.reduceat(saved, groups), slab.group[groups]

    def border_keys(self, slab: Slab, c: int) -> dict[int, bytes]:
        """Keys of the nodes of a column that are on a border path of the shard, by their number."""
        first, last = self.on_border[slab.first]
        out = {}
        for path, number, row in ((first, 0, 0), (last, int(slab.edge[:, c].sum()) - 1, -1)):
            if path and slab.ids[row, c] != 0:
                out[number] = self.key(slab.rows[row], slab.first + c + 1)
        return out

    def emit(self, *, depth, conv, n, children, leaf, leaves, saved, points, parent, keys, parent_keys, ends) -> None:
        digests = [hashlib.sha256(",".join(map(str, e.tolist())).encode()).hexdigest() if len(e) else NOTHING for e in ends]
        size = len(conv)
        self.out.append(
            {
                "conv_id": conv, "depth": np.full(size, depth), "parent_conv_id": parent, "n_convs": n,
                "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": digests,
                "key": [keys.get(i) for i in range(size)] if keys else [None] * size,
                "parent_key": [parent_keys.get(i) for i in range(size)] if parent_keys else [None] * size,
                "points": points, "leaf": leaf,
            }
        )
        for i, key in keys.items():
            ids = ends[i].tolist()
            for part, at in enumerate(range(0, len(ids), IDS_PER_PART)):
                self.parts.append((key, part, ",".join(map(str, ids[at : at + IDS_PER_PART]))))

    def batches(self) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        fields = [f.split() for f in NODE.split(", ")]
        for rows in self.out:
            size = len(rows["conv_id"])
            rows["shard"] = np.full(size, self.number)
            columns = []
            for name, kind in fields:
                values = rows.get(name)
                columns.append(pa.nulls(size, kinds[kind]) if values is None else pa.array(values, kinds[kind]))
            yield pa.RecordBatch.from_arrays(columns, names=[f[0] for f in fields])
        for at in range(0, len(self.parts), 64):
            rows = self.parts[at : at + 64]
            made = {
                "key": [r[0] for r in rows], "part": [r[1] for r in rows], "ids": [r[2] for r in rows],
                "shard": [self.number] * len(rows),
            }
            columns = [pa.array(made[n], kinds[k]) if n in made else pa.nulls(len(rows), kinds[k]) for n, k in fields]
            yield pa.RecordBatch.from_arrays(columns, names=[f[0] for f in fields])


def shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        conv = table.column("conv_id").to_numpy()
        points = table.column("points").combine_chunks().flatten().to_numpy().astype(np.int64)
        shard = Shard(conv, table.column("seq").to_pylist(), points, table.column("shard")[0].as_py())
        shard.nodes()
        yield from shard.batches()


def hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each list, which come in order; only its state is held."""
    at, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["_key", "ends"]
        )

    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != at:
                if at is not None:
                    yield closed()
                at, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if at is not None:
        yield closed()


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, points): the digests of a conversation's turns in order, and their lengths.

    The first crc32(id) % 6 turns are those of the conversation that heads its hundred.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct("turn", F.substring(whole, 1, 2 * DIGEST).alias("digest"), F.char_length(text).alias("points"))
    head_id = F.col("conv_id") - F.col("conv_id") % FAMILY
    rows = conversations.filter("conv_id IS NOT NULL").select("conv_id", head_id.alias("head"), turn.alias("turn"))
    own = rows.repartition("head").groupBy("head", "conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    heads = own.filter("conv_id = head").select("head", F.slice("turns", 1, HEADS - 1).alias("first"))
    n = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    joined = own.join(heads, "head", "left").withColumn("n", n)
    none = F.filter("turns", lambda t: F.lit(False))
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("n"))
    turns = F.concat(first, F.slice("turns", F.col("n") + 1, F.size("turns")))
    return joined.select("conv_id", turns.alias("turns")).select(
        "conv_id",
        F.unhex(F.array_join("turns.digest", "")).alias("seq"),
        F.col("turns.points").alias("points"),
    )


def merged_parts(parts: DataFrame, lists: DataFrame) -> DataFrame:
    """Whole nodes from the parts that shards have of the nodes on their border paths."""
    whole = stored(
        parts.groupBy("key").agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
            F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
            F.max("ends_sha256").alias("ends_sha256"), F.max("points").alias("points"), F.sum("leaf").alias("leaf"),
            F.count("*").alias("held"), F.min("shard").alias("from_shard"), F.max("shard").alias("to_shard"),
        ),
        "border_nodes",
    )
    shared = whole.filter("held > 1")
    # A child that several shards hold was counted by each; so were a leaf and what a turn saves.
    again = shared.groupBy(F.col("parent_key").alias("_parent")).agg(F.sum(F.col("held") - 1).alias("again"))
    children = F.col("n_children") - F.coalesce("again", F.lit(0))
    shared = shared.join(again, shared["key"] == again["_parent"], "left").withColumn("n_children", children)
    own_leaf = F.when(F.col("n_children") == 0, 1).otherwise(0) - F.col("leaf")
    shared = shared.drop("_parent", "again").withColumns(
        {"d_leaves": own_leaf, "d_saved": (F.col("held") - 1) * F.col("points")}
    )
    shared = stored(shared, "shared_nodes")
    # Nodes that begin in one shard and go on behind it lie on one path, so depth orders them.
    deeper = Window.partitionBy("from_shard").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    by_shard = shared.groupBy("from_shard").agg(F.sum("d_leaves").alias("t_leaves"), F.sum("d_saved").alias("t_saved"))
    marks = shared.select(F.col("to_shard").alias("from_shard")).distinct().withColumns(
        {"t_leaves": F.lit(0).cast("long"), "t_saved": F.lit(0).cast("long")}
    )
    line = by_shard.unionByName(marks).groupBy("from_shard").agg(F.sum("t_leaves").alias("t_leaves"), F.sum("t_saved").alias("t_saved"))
    line = stored(line.withColumn("bucket", F.expr("from_shard div 10000")), "shard_sums")
    line = prefix_sums(line, [], "bucket", ["from_shard"], "t_leaves", "b_leaves")
    line = prefix_sums(line, [], "bucket", ["from_shard"], "t_saved", "b_saved")
    line = stored(line.select("from_shard", "t_leaves", "t_saved", "b_leaves", "b_saved"), "shard_prefixes")
    start = line.select(
        "from_shard", (F.col("t_leaves") + F.col("b_leaves")).alias("s_leaves"), (F.col("t_saved") + F.col("b_saved")).alias("s_saved")
    )
    end = line.select(F.col("from_shard").alias("to_shard"), "b_leaves", "b_saved")
    rows = shared.withColumns({"o_leaves": F.sum("d_leaves").over(deeper), "o_saved": F.sum("d_saved").over(deeper)})
    rows = rows.join(start, "from_shard").join(end, "to_shard")
    hashed = lists.join(broadcast_if_small(shared.select("key")), "key").select("key", "shard", "part", "ids")
    hashed = hashed.repartition("key").sortWithinPartitions("key", "shard", "part")
    hashed = hashed.mapInArrow(hash_lists, "_key binary, ends string")
    rows = rows.join(hashed, rows["key"] == hashed["_key"], "left")
    fixed = rows.withColumns(
        {
            "n_leaves": F.col("n_leaves") + F.col("o_leaves") + F.col("b_leaves") - F.col("s_leaves"),
            "saved_tokens": F.col("saved_tokens") + F.col("o_saved") + F.col("b_saved") - F.col("s_saved"),
            "ends_sha256": F.coalesce("ends", F.lit(NOTHING)),
        }
    )
    kept = ["key", "parent_key", *[c for c in COLUMNS if c != "parent_conv_id"]]
    return stored(whole.filter("held = 1").select(*kept).unionByName(fixed.select(*kept)), "whole_nodes")


def prefix_trie(conversations: DataFrame, turns_per_shard: int = TURNS_PER_SHARD) -> DataFrame:
    """One row per node of the prefix trie of rebuilt conversations, as COLUMNS says.

    Turns stand by `turn`, null first, and turns of one number by a digest of role and text; null role
    or text counts as empty; repeated rows are turns of their own. Rows without conv_id belong to
    no conversation. A conversation left without turns ends at the root. No rows give no nodes, not
    even a root. Other columns play no part. One task holds the digests of a conversation,
    24 bytes a turn, however long its texts.
    """
    rows = stored(rebuilt(conversations), "rebuilt")
    total = rows.agg(F.sum(F.size("points") + 1)).first()[0] or 0
    shards = max(1, -(-total // turns_per_shard))
    sharded = rows.repartitionByRange(shards, "seq", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    nodes = stored(sharded.mapInArrow(shard_nodes, NODE), "nodes")
    whole = merged_parts(nodes.filter("key IS NOT NULL AND ids IS NULL"), nodes.filter("ids IS NOT NULL"))
    inner = nodes.filter("key IS NULL").select("parent_key", *COLUMNS)
    known = inner.filter("parent_key IS NULL").select(*COLUMNS)
    open_ended = inner.drop("parent_conv_id").unionByName(whole.drop("key")).filter("parent_key IS NOT NULL")
    names = whole.select(F.col("key").alias("_key"), F.col("conv_id").alias("parent_conv_id"))
    named = open_ended.join(broadcast_if_small(names), F.col("parent_key") == F.col("_key")).select(*COLUMNS)
    root = whole.filter("parent_key IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*COLUMNS)
    return known.unionByName(named).unionByName(root)
