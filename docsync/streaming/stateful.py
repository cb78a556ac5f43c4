"""Change classification with per-file state inside the streaming engine.

Needs the RocksDB state store:
`spark.sql.streaming.stateStore.providerClass` =
`org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docsync.schemas import CHANGES, DELIVERED_COLUMN

FILE_STATE = (
    "content_hash string, remote_file_id string, dirty boolean, content_seq bigint, context_seq bigint, "
    "remote_seq bigint"
)
OPEN_STATE = "remote_file_id string, seq bigint, since bigint"
DECISIONS = (
    "kb_id string, file_key string, seq bigint, content_hash string, action string, delete_remote_id string"
)


class File(NamedTuple):
    """What is known of one file; `remote_seq` is the mark of the report that named the remote file."""

    content_hash: str | None = None
    remote_file_id: str | None = None
    dirty: bool = False
    content_seq: int = -1
    context_seq: int = -1
    remote_seq: int = -1


class Report(NamedTuple):
    content_hash: str | None
    remote_file_id: str
    seq: int


# Hash to (remote id, seq): without an id a decided delivery that was not reported yet, with one
# a report whose change has not come.
Open = dict[str | None, tuple[str | None, int]]
Decision = tuple[int, str | None, str, str | None]


def decide(file: File, change: tuple[int, str, str | None] | None, note: int) -> tuple[File, Decision | None]:
    """State and decision after the latest content change (seq, op, hash) and note edit of a batch."""
    if change is not None and change[0] <= file.content_seq:
        change = None
    context_at = file.context_seq
    deleted = change is not None and change[1] == "delete"
    if deleted:
        # A note from before the delete went with the file.
        context_at = max(context_at, change[0])
    edited = note > context_at
    if change is None and not edited:
        return file, None
    newest = max([note] * edited + ([] if change is None else [change[0]]))
    marks = (file.content_seq if change is None else change[0], max(note, context_at))
    dirty = file.dirty or edited
    wanted = file.content_hash if change is None else change[2]
    if deleted:
        after = File(None, None, edited, *marks)
        return after, (newest, wanted, "ORPHAN", None) if file.content_hash is not None else None
    if wanted is None:
        return File(None, None, dirty, *marks), None
    if file.content_hash is None:
        action = "UPDATE" if dirty else "NEW"
    else:
        action = "SKIP" if wanted == file.content_hash and not dirty else "UPDATE"
    return File(wanted, None, False, *marks), (newest, wanted, action, None)


def settle_reports(before: File, file: File, opened: Open, reports: Iterable[Report]) -> tuple[File, Open, list[Report]]:
    """Which report names the file's remote copy, which wait, and whose remote files are to go.

    Of reports for the wanted content from after the last note edit the latest counts. A report goes if
    it is older than that or than the last change, or if its delivery was decided and is replaced;
    else its change is still to come, and it waits. None of this looks at the order of arrival.
    """
    opened = dict(opened)
    current = [Report(before.content_hash, before.remote_file_id, before.remote_seq)] if before.remote_file_id else []
    waiting = [Report(h, i, s) for h, (i, s) in opened.items() if i]
    for report in waiting:
        del opened[report.content_hash]
    found = {r.remote_file_id: r for r in sorted([*current, *waiting, *reports], key=lambda r: r.seq) if r.remote_file_id}
    mine = [r for r in found.values() if r.content_hash == file.content_hash is not None and r.seq > file.context_seq]
    best = max(mine, key=lambda r: (r.seq, r.remote_file_id), default=None)
    horizon = max(file.content_seq, file.context_seq, best.seq if best else -1)
    gone = []
    for report in found.values():
        if report is best:
            continue
        in_flight = report.content_hash in opened and opened[report.content_hash][0] is None
        decided = in_flight and report.content_hash != file.content_hash
        replaced = report.remote_file_id == before.remote_file_id or report in mine
        if decided:
            del opened[report.content_hash]
        if decided or replaced or report.seq < horizon:
            gone.append(report)
        else:
            # Of two reports for one content that wait, the later one may count.
            other = opened.get(report.content_hash)
            rivals = [report, *([Report(report.content_hash, *other)] if other else [])]
            *less, last = sorted(rivals, key=lambda r: (r.seq, r.remote_file_id))
            gone += less
            opened[report.content_hash] = (last.remote_file_id, last.seq)
    if best is not None:
        opened.pop(file.content_hash, None)
        file = file._replace(remote_file_id=best.remote_file_id, remote_seq=best.seq)
    return file, opened, sorted(gone, key=lambda r: (r.seq, r.remote_file_id))


def advance(
    file: File, opened: Open, change: tuple[int, str, str | None] | None, note: int, reports: Iterable[Report]
) -> tuple[File, Open, list[Decision]]:
    """One batch of a file: state, open deliveries, and rows for what to deliver and to delete."""
    after, decision = decide(file, change, note)
    opened = dict(opened)
    if decision and decision[2] in ("NEW", "UPDATE") and not opened.get(decision[1], (None,))[0]:
        opened[decision[1]] = (None, decision[0])
    after, opened, gone = settle_reports(file, after, opened, reports)
    out = []
    if decision:
        drop = None
        if decision[2] in ("UPDATE", "ORPHAN") and gone:
            # The row names the file it replaces, where that is known.
            drop = next((r for r in gone if r.remote_file_id == file.remote_file_id), gone[-1])
            gone = [r for r in gone if r is not drop]
        out.append((*decision[:3], drop.remote_file_id if drop else None))
    out += [(r.seq, r.content_hash, "DROP", r.remote_file_id) for r in gone]
    return after, opened, out


def last_per_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the latest content change and note edit of each key of a batch of rows, and every remote
    file that is reported, once."""
    for batch in batches:
        rows = batch.select(["kb_id", "file_key", "op", "seq", DELIVERED_COLUMN]).to_pandas()
        kind = rows["op"].where(rows["op"].isin(["context", "delivered"]), "content")
        remote = rows[DELIVERED_COLUMN].where(kind == "delivered", None)
        group = rows.groupby([rows["kb_id"], rows["file_key"], kind, remote], dropna=False)
        yield batch.take(pa.array(group["seq"].idxmax(), pa.int64()))


class FileProcessor(StatefulProcessor):
    """Remembers hash, remote id, dirty mark and sequence marks of one file, which never expire, and
    its open deliveries by hash, which timers give up. Content and notes are late by their own
    mark only."""

    def __init__(self, give_up_ms: int | None):
        self.give_up_ms = give_up_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", FILE_STATE)
        self.open = handle.getMapState("open", "content_hash string", OPEN_STATE)

    def opened(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}

    def rows_of(self, key, decisions: list[Decision]) -> Iterator[pd.DataFrame]:
        if decisions:
            names = [part.split()[0] for part in DECISIONS.split(", ")]
            yield pd.DataFrame([(key[0], key[1], *d) for d in decisions], columns=names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        file = File(*self.file.get()) if self.file.exists() else File()
        held = self.opened()
        change, note, reports = None, -1, []
        for chunk in rows:
            content = chunk[chunk["op"].isin(["upsert", "delete"])]
            if len(content):
                last = content.loc[content["seq"].idxmax()]
                if change is None or last["seq"] > change[0]:
                    change = (int(last["seq"]), last["op"], last["content_hash"])
            notes = chunk[chunk["op"] == "context"]["seq"]
            note = max(note, int(notes.max())) if len(notes) else note
            told = chunk[(chunk["op"] == "delivered") & chunk[DELIVERED_COLUMN].notna()]
            columns = (told["content_hash"], told[DELIVERED_COLUMN], told["seq"])
            reports += [Report(h, i, int(s)) for h, i, s in zip(*columns) if i]
        after, opened, decisions = advance(file, {k: v[:2] for k, v in held.items()}, change, note, reports)
        if after != file:
            self.file.update(tuple(after))
        now = -1 if self.give_up_ms is None else timerValues.getCurrentProcessingTimeInMs()
        for gone in held.keys() - opened.keys():
            self.open.removeKey((gone,))
        for content_hash, entry in opened.items():
            if content_hash not in held or held[content_hash][:2] != entry:
                self.open.updateValue((content_hash,), (*entry, now))
                if self.give_up_ms is not None:
                    self.handle.registerTimer(now + self.give_up_ms)
        yield from self.rows_of(key, decisions)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A report that no change has claimed names a remote file that nobody wants; a delivery that
        nobody has reported is forgotten."""
        decisions = []
        for content_hash, (remote_id, seq, since) in self.opened().items():
            if since + self.give_up_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.removeKey((content_hash,))
                if remote_id:
                    decisions.append((seq, content_hash, "DROP", remote_id))
        yield from self.rows_of(key, decisions)

    def close(self) -> None:
        pass


def classify_stream(changes: DataFrame, give_up_ms: int | None = None) -> DataFrame:
    """NEW, UPDATE, SKIP or ORPHAN for each file a batch of changes touches, taking each
    decision as delivered.

    Changes may include reports with `op` delivered and a `remote_file_id` column, before, with or after
    the change they belong to. UPDATE and ORPHAN rows then name the remote file to delete, and
    DROP rows any other remote file that a report named and no content wants: each one that is
    reported is in the end either the file's own or named for deletion. A report whose change has
    not come waits, and so does a delivery for its report: for good, or for `give_up_ms` of processing
    time. Timers make Spark run empty batches; with an availableNow trigger, which would go on with
    them for ever, set spark.sql.streaming.noDataMicroBatches.enabled to false. Changes are thinned out
    in every batch of rows before the shuffle, so a key with very many of them sends a few rows of each.
    """
    if DELIVERED_COLUMN not in changes.columns:
        changes = changes.withColumn(DELIVERED_COLUMN, F.lit(None).cast("string"))
    names = [part.split()[0] for part in CHANGES.split(", ")]
    schema = f"{CHANGES}, {DELIVERED_COLUMN} string"
    thinned = changes.select(*names, DELIVERED_COLUMN).mapInArrow(last_per_key, schema)
    return thinned.groupBy("kb_id", "file_key").transformWithStateInPandas(
        statefulProcessor=FileProcessor(give_up_ms),
        outputStructType=DECISIONS,
        outputMode="Append",
        timeMode="none" if give_up_ms is None else "processingTime",
    )
