"""Quality rules: a linear-chain conditional random field over the lines of a document.

Viterbi decoding marks every line as content or boilerplate; the share of words in content
lines decides whether the document stays. Lines have no labels of their own, so the field is
fitted on evidence: lines of good documents are more likely content, lines of bad ones
boilerplate, and so are lines that stand among ever other neighbours throughout the corpus. What
each line is stays hidden, and the field maximises the likelihood of the evidence over all
sequences of states. So the lines of one document can fall on both sides. Those of the sample's
lines that roam the corpus are part of the model, a feature of a line like any other.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docsync.llm.common import BLANKS, WordHasher, record_batch, text_bytes, windows

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
# Good documents may hold a few short sentences among boilerplate; bad ones have next to no content lines.
MIN_CONTENT_SHARE = 0.25
REPEAT_WIDTH = 8
# Bounds of the training sample: documents of each label, and lines of a document.
SAMPLE_DOCS = 1500
SAMPLE_LINES = 64
# Log odds that a line is content: by the quality of its document, and if it stands all over the corpus.
DOCUMENT_EVIDENCE = 3.0
REPEAT_EVIDENCE = 5.0
# Such a line has this many different neighbourhoods, and as many as half of its places.
MIN_NEIGHBOURHOODS = 10

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b"!\"'()+,-./:;=?@[\\]^_`{}~"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
CONTINUATION = bytes(range(0x80, 0xC0))
N_FEATURES = 13
# How strongly weights are drawn to zero. Steps more than features: two boilerplate lines must not
# outweigh a line of prose between them.
HOLD, STEP_HOLD = 1e-4, 5e-2

VERDICT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, n_lines long, content_words long, kept boolean"
)


@dataclass(frozen=True)
class Field:
    """Scores of the two states, boilerplate 0 and content 1, and of the steps between them."""

    emission: np.ndarray  # (N_FEATURES, 2)
    step: np.ndarray  # (2, 2), from the earlier line's state to the later one's
    roaming: frozenset[int] = frozenset()  # marks of the sample's lines that stand all over the corpus


def count(data: bytes, chars: bytes) -> int:
    return len(data) - len(data.translate(None, chars))


def line_mark(line: bytes) -> int:
    """What Spark's xxhash64 gives for the line, so that the JVM and Python know it by the same number."""
    import xxhash

    mark = xxhash.xxh64_intdigest(line, 42)
    return mark - (mark >> 63 << 64)


def line_features(line: bytes, repeated: bool, roams: bool) -> tuple[tuple[float, ...], int]:
    """Features of one line, and its number of words."""
    words = line.split()
    n = len(words)
    chars = max(1, len(line) - count(line, BLANKS.encode() + CONTINUATION))
    upper, lower = count(line, UPPER), count(line, LOWER)
    features = (
        1.0,
        min(n, 50) / 50,
        1.0 if n < 5 else 0.0,
        min(chars / max(n, 1), 20) / 20,
        count(line, SYMBOLS) / chars,
        count(line, PUNCTUATION) / chars,
        count(line, DIGITS) / chars,
        upper / max(upper + lower, 1),
        1.0 if words and words[-1][-1:] in b".!?" else 0.0,
        1.0 if repeated else 0.0,
        min(len(set(words)), 50) / max(min(n, 50), 1) if n <= 50 else len(set(words)) / n,
        line.count(b"!!") / max(n, 1),
        1.0 if roams else 0.0,
    )
    return features, n


def lines_of(text: bytes, roaming: frozenset[int] = frozenset()) -> tuple[list[tuple[float, ...]], list[int], int]:
    """Features and word counts of the lines that have a word, and how many repeat an earlier one."""
    seen: set[bytes] = set()
    features, counts, repeats = [], [], 0
    for line in text.split(b"\n"):
        if not line.strip():
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        row, n = line_features(line, again, bool(roaming) and line_mark(line) in roaming)
        features.append(row)
        counts.append(n)
    return features, counts, repeats


def repeated_words(ids: np.ndarray) -> int:
    """Words inside a window of REPEAT_WIDTH words that occurs twice or more in the text."""
    if len(ids) < REPEAT_WIDTH + 1:
        return 0
    marks = windows(ids, REPEAT_WIDTH)
    ordered = np.sort(marks)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(marks, twice)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    edges[: len(starts)] += starts
    edges[REPEAT_WIDTH : REPEAT_WIDTH + len(starts)] -= starts
    return int(np.count_nonzero(np.cumsum(edges) > 0))


def viterbi(scores: list[list[float]], step: list[list[float]]) -> list[int]:
    """The best sequence of states; a tie goes to content."""
    best = scores[0]
    back = []
    for now in scores[1:]:
        came = [0 if best[0] + step[0][s] > best[1] + step[1][s] else 1 for s in (0, 1)]
        back.append(came)
        best = [best[came[s]] + step[came[s]][s] + now[s] for s in (0, 1)]
    state = 0 if best[0] > best[1] else 1
    path = [state]
    for came in reversed(back):
        state = came[state]
        path.append(state)
    return path[::-1]


def beliefs(score: np.ndarray, step: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each line's state, (lines, docs, 2), and the sum of those of each step, (2, 2).

    Forward and backward messages are kept as chances that add up to 1, so nothing overflows.
    """
    local = np.exp(score - score.max(axis=2, keepdims=True))
    move = np.exp(step - step.max())
    forward, backward = local.copy(), np.ones_like(local)
    forward[0] /= forward[0].sum(axis=1, keepdims=True)
    for t in range(1, len(score)):
        now = (forward[t - 1] @ move) * local[t]
        forward[t] = np.where(there[t, :, None], now / now.sum(axis=1, keepdims=True), forward[t - 1])
    for t in range(len(score) - 2, -1, -1):
        now = (local[t + 1] * backward[t + 1]) @ move.T
        backward[t] = np.where(there[t + 1, :, None], now / now.sum(axis=1, keepdims=True), 1.0)
    node = forward * backward
    node *= there[:, :, None] / node.sum(axis=2, keepdims=True)
    pair = forward[:-1, :, :, None] * move * (local * backward)[1:, :, None, :]
    pair *= there[1:, :, None, None] / pair.sum(axis=(2, 3), keepdims=True)
    return node, pair.sum(axis=(0, 1))


def likelihood_gradient(x: np.ndarray, evidence: np.ndarray, there: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, by line, of the log likelihood of the evidence over all sequences of states.

    x (lines, docs, features); evidence (lines, docs) the log odds that a line is content; there a mask.
    It is what the states are believed to be with the evidence, less what they are without.
    """
    score = x @ field.emission
    told = score.copy()
    told[:, :, 1] += evidence
    known, known_steps = beliefs(told, field.step, there)
    free, free_steps = beliefs(score, field.step, there)
    lines = there.sum()
    return np.tensordot(x, known - free, ((0, 1), (0, 1))) / lines, (known_steps - free_steps) / lines


def fit(documents: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100) -> Field | None:
    """Fit on (line features, evidence) of documents; None unless evidence points both ways."""
    documents = [d for d in documents if len(d[0])]
    if len({bool(e > 0) for _, evidence in documents for e in evidence}) < 2:
        return None
    lines = max(len(f) for f, _ in documents)
    x = np.zeros((lines, len(documents), N_FEATURES))
    told = np.zeros((lines, len(documents)))
    there = np.zeros((lines, len(documents)), dtype=bool)
    for i, (features, evidence) in enumerate(documents):
        x[: len(features), i] = features
        told[: len(features), i] = evidence
        there[: len(features), i] = True
    # Adam, from zero: the result depends on the sample alone. Steps join when features have a say,
    # or they would only learn that a document's evidence is the same throughout.
    shape = (N_FEATURES * 2 + 4,)
    theta, mean, square = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    hold = np.repeat([HOLD, STEP_HOLD], [N_FEATURES * 2, 4])

    def field() -> Field:
        return Field(theta[:-4].reshape(N_FEATURES, 2).copy(), theta[-4:].reshape(2, 2).copy())

    for i in range(1, rounds + 1):
        emission, step = likelihood_gradient(x, told, there, field())
        slope = np.concatenate([emission.ravel(), step.ravel() * (2 * i > rounds)]) - hold * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta = theta + 0.2 * (mean / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return field()


SAMPLE = "doc_id long, quality int, features binary, marks binary"


def sample_features(max_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            texts = text_bytes(batch.column("text"))
            for doc_id, text, label in zip(batch.column("doc_id").to_pylist(), texts, batch.column("quality").to_pylist()):
                features = np.array(lines_of(text)[0][:max_lines], dtype=np.float64)
                lines = itertools.islice(filter(bytes.strip, text.split(b"\n")), max_lines)
                marks = np.array([line_mark(line) for line in lines], dtype=np.int64)
                rows.append((doc_id, label, features.tobytes(), marks.tobytes()))
            yield record_batch(rows, SAMPLE)

    return run


def roaming_lines(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of `marks` whose lines stand between ever other lines throughout `texts`.

    A line of a text that was copied, whole or with edits, keeps its neighbours in most of its
    places, so copies make no line roam. `marks` must be bounded: it is broadcast.
    """
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.trim(F.translate(line, BLANKS, "")) != "")
    around = texts.select(lines.alias("l")).select(
        F.explode(
            F.transform(
                "l",
                lambda line, i: F.struct(
                    F.xxhash64(line).alias("mark"),
                    F.xxhash64(F.get("l", i - 1), F.get("l", i + 1)).alias("around"),
                ),
            )
        ).alias("p")
    )
    places = around.select("p.*").join(F.broadcast(marks), "mark").groupBy("mark", "around").agg(F.count("*").alias("n"))
    found = places.groupBy("mark").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"))
    return found.filter((F.col("kinds") >= MIN_NEIGHBOURHOODS) & (2 * F.col("kinds") >= F.col("n"))).select("mark")


def train(
    docs: DataFrame, labels: DataFrame, max_docs: int = SAMPLE_DOCS, max_lines: int = SAMPLE_LINES
) -> Field | None:
    """Fit a field on at most `max_docs` labelled documents of each quality, `max_lines` lines each.

    The documents are those whose ids hash lowest, so the sample is the same in every run. Where
    its lines stand is counted over all of `docs`.
    """
    picked = None
    for quality in (0, 1):
        some = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull())
        some = some.select("doc_id", F.col("quality").cast("int")).distinct()
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = texts.mapInArrow(sample_features(max_lines), SAMPLE)
    # A repeated doc_id cannot widen the sample: at most twice max_docs rows are fetched.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(2 * max_docs).collect()
    marks = [np.frombuffer(r.marks, dtype=np.int64) for r in rows]
    every = np.unique(np.concatenate([*marks, np.zeros(0, np.int64)]))  # at most 2 * max_docs * max_lines
    if not len(every) or len({r.quality for r in rows}) < 2:
        return None
    asked = docs.sparkSession.createDataFrame(pd.DataFrame({"mark": every}))
    roaming = frozenset(r.mark for r in roaming_lines(docs, asked).collect())
    sample = []
    for r, own in zip(rows, marks):
        features = np.frombuffer(r.features).reshape(-1, N_FEATURES).copy()
        features[:, -1] = [mark in roaming for mark in own.tolist()]
        evidence = (DOCUMENT_EVIDENCE if r.quality == 1 else -DOCUMENT_EVIDENCE) - REPEAT_EVIDENCE * features[:, -1]
        sample.append((features, evidence))
    field = fit(sample)
    return field and replace(field, roaming=roaming)


def judge(field: Field | None, min_share: float, carried: bool):
    step = [[0.0, 0.0], [0.0, 0.0]] if field is None else field.step.tolist()
    roaming = frozenset() if field is None else field.roaming

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        skip = BLANKS.encode() + CONTINUATION
        for batch in batches:
            out = []
            ids, texts = (pc.struct_field(batch.column("_row"), n) for n in ("doc_id", "text"))
            for doc_id, text in zip(ids.cast(pa.int64()).to_pylist(), text_bytes(texts)):
                words = text.split()
                features, counts, repeats = lines_of(text, roaming)
                states = [1] * len(counts)
                if field is not None and counts:
                    states = viterbi((np.array(features) @ field.emission).tolist(), step)
                content = sum(n for n, state in zip(counts, states) if state)
                again = repeated_words(hasher.of(text))
                failed = len(words) < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * len(words)
                kept = not failed and content >= min_share * len(words)
                out.append(
                    (doc_id, len(words), len(text.translate(None, skip)), count(text, SYMBOLS), repeats, again,
                     failed, len(counts), content, kept)
                )
            made = record_batch(out, VERDICT)
            columns = [batch.column("_row")] * carried + list(made.columns)
            yield pa.RecordBatch.from_arrays(columns, names=["_row"] * carried + [f"_v_{n}" for n in made.schema.names])

    return run


def with_verdicts(docs: DataFrame, field: Field | None, min_share: float = MIN_CONTENT_SHARE, carried: bool = False) -> DataFrame:
    """The verdict columns with a leading `_v_`, behind the whole row as `_row` if it is carried.

    A row passes through Python once, as one struct that the text is read from, so that no
    name of its own can clash and no text stands twice in a batch.
    """
    row = F.struct("*") if carried else F.struct("doc_id", "text")
    rows = docs.select(row.alias("_row"))
    schema = StructType(rows.schema.fields[:] if carried else [])
    for part in VERDICT.split(","):
        name, kind = part.split()
        schema = schema.add(f"_v_{name}", kind)
    return rows.mapInArrow(judge(field, min_share, carried), schema)


LINE = "doc_id long, line int, start long, size long, n_words long, content boolean"


def labelled_lines(field: Field | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                features, counts, _ = lines_of(text, frozenset() if field is None else field.roaming)
                states = [1] * len(counts)
                if field is not None and counts:
                    states = viterbi((np.array(features) @ field.emission).tolist(), field.step.tolist())
                judged, at = zip(counts, states), 0
                for i, line in enumerate(text.split(b"\n")):
                    if line.strip():
                        n, state = next(judged)
                        out.append((doc_id, i, at, len(line), n, bool(state)))
                    at += len(line) + 1
                if len(out) > 50_000:
                    yield record_batch(out, LINE)
                    out = []
            yield record_batch(out, LINE)

    return run


def line_labels(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, line, start, size, n_words, content), one row per line that has a word.

    `line` counts \\n-split lines from 0; start and size are in bytes of the UTF-8 text. Without a
    field every line is content. Null and empty texts have no lines; repeated rows give theirs again.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(labelled_lines(field), LINE)


def quality_verdicts(docs: DataFrame, labels: DataFrame, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """One row per document: counts, base_failed and kept.

    Null counts as empty; a text without words has counts of 0 and fails. Lines without a word
    are no lines. Without labelled documents of both qualities every line is content. Repeated
    rows are judged alike; no rows give no rows; other columns of `docs` play no part.
    """
    out = with_verdicts(docs, train(docs, labels), min_share)
    return out.select(*[F.col(c).alias(c.removeprefix("_v_")) for c in out.columns])


def good_documents(docs: DataFrame, labels: DataFrame, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows of `docs` that are kept, with their own columns."""
    out = with_verdicts(docs, train(docs, labels), min_share, carried=True)
    return out.filter("_v_kept").select("_row.*")
