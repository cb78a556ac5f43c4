"""Token counts kept in a digest cache.

A text is known by the digest of its normalised content, a tokenizer by the digest of its file
and the version of its library. Texts whose digests are in the cache are never encoded; of the
others one per digest is, and its count is appended.
"""

from __future__ import annotations

import base64
import hashlib
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsync.llm.common import record_batch, scratch_path, text_bytes
from docsync.operators.skew import shared_folder

# The pre-tokenizer's pattern of byte-level vocabularies, and its special token.
BYTE_LEVEL_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a letter: printable ones as themselves, the rest
    as the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def fast_engine(model: dict):
    """tiktoken over the vocabulary of a byte-level .json, or None where it would differ."""
    import tiktoken

    kind, pre = model["model"], model.get("pre_tokenizer") or {}
    plain = kind.get("type", "BPE") == "BPE" and not kind.get("byte_fallback") and not kind.get("dropout")
    plain = plain and not kind.get("ignore_merges") and not kind.get("end_of_word_suffix")
    if not (plain and model.get("normalizer") is None and model.get("truncation") is None):
        return None
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    letters = byte_letters()
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in model.get("added_tokens", [])):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in kind["vocab"].items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in kind["merges"]]
    made = [kind["vocab"].get("".join(m)) for m in merges]
    # Ids must follow the order of the merges, or ranks would merge in another order.
    if any(b <= a for a, b in zip(made, made[1:])):
        return None
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=added)


class Encoder:
    """Ids of texts as the library of a tokenizer file gives them, without added tokens.

    Byte-level vocabularies are read by tiktoken, which gives the same ids several times faster.
    Nothing of a text is remembered, so what a worker holds does not grow with what it has read.
    """

    def __init__(self, path: str):
        self.path, self.fast, self.pieces, self.library = path, None, None, None
        if path.endswith(".model"):
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            with open(path, encoding="utf-8") as f:
                self.fast = fast_engine(json.load(f))

    def by_library(self, text: str) -> list[int]:
        if self.pieces is not None:
            return self.pieces.encode(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.no_truncation()
            self.library.no_padding()
        return self.library.encode(text, add_special_tokens=False).ids

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
            except BaseException as e:  # its regular expressions give up on some very long runs
                if type(e).__name__ not in ("ValueError", "PanicException"):
                    raise
        return np.array(self.by_library(text), dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    """One encoder per worker and file. Functions travel by value, so the encoders hang on a
    module that a worker imports once."""
    import tiktoken

    return vars(sys.modules[tiktoken.__name__]).setdefault("_docsync_encoders", Encoders())[path]


class Encoders(dict):
    def __missing__(self, path: str) -> Encoder:
        made = self[path] = Encoder(path)
        return made


def tokenizer_version(path: str) -> str:
    """Digest of a tokenizer: its file and the versions of the libraries that may read it."""
    import sentencepiece
    import tiktoken
    import tokenizers

    library = sentencepiece.__version__ if path.endswith(".model") else f"{tokenizers.__version__} {tiktoken.__version__}"
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read())
    digest.update(library.encode())
    return base64.b16encode(digest.digest()).decode().lower()


def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop what this task has had already."""
    seen: set[str] = set()
    for batch in batches:
        fresh = []
        for digest in batch.column("digest").to_pylist():
            fresh.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(fresh, pa.bool_()))


def count_distinct(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        encode = encoder(path)
        for batch in batches:
            out = []
            for digest, text in zip(batch.column("digest").to_pylist(), text_bytes(batch.column("text"))):
                if digest not in seen:
                    seen.add(digest)
                    out.append((digest, len(encode.packed(text.decode("utf-8", "replace"))) // 4))
            yield record_batch(out, "digest string, n_tokens long")

    return run


def kept_cache(spark: SparkSession) -> str:
    """A cache that outlives the run, in the folder all executors share. One run appends at a time."""
    return f"{shared_folder(spark)}/docsync-llm-kept/token-counts"


def read_cache(docs: DataFrame, path: str, version: str) -> DataFrame | None:
    """Stored counts of one tokenizer; None while nothing was ever stored there."""
    spark = docs.sparkSession
    try:
        rows = spark.read.schema("tokenizer string, digest string, n_tokens long").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # Jobs that ran at the same time may both have stored a digest; the counts agree.
    rows = rows.filter(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of `docs`.

    Null text counts as empty and has no tokens. Special strings inside texts are read as the
    library does by default; none are added. Texts of any length are encoded whole. Repeated
    rows each get a row; no rows give none; other columns of `docs` play no part. `cache` is a
    folder all executors share; without one a new folder is used. Byte-level and piece
    tokenizers take the content as it is, so normalising means null to empty only.
    """
    version = tokenizer_version(tokenizer)
    cache = cache or scratch_path(docs.sparkSession, "token-cache")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(text, 256)
    known = read_cache(docs, cache, version)
    texts = docs.select(digest.alias("digest"), text.alias("text"))
    missing = texts.mapInArrow(first_seen, "digest string, text string")
    if known is not None:
        missing = missing.join(known, "digest", "left_anti")
    counted = missing.repartition("digest").mapInArrow(count_distinct(tokenizer), "digest string, n_tokens long")
    counted = counted.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
    counted.write.mode("append").parquet(cache)
    known = read_cache(docs, cache, version)
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(known, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
