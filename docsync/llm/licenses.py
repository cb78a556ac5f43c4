"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle
containment verifies them.

Windows are half as long again as the templates they look for and start every half template, so
every copy lies whole in a window whose shingles it makes up at least half of. With 24 bands of
two rows such a window meets its template with probability 1 - (1 - 0.5**2)**24 > 0.998.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docsync.llm.common import WordHasher, distinct, mixed, record_batch, text_bytes, windows

SHINGLE = 3
BANDS, ROWS = 24, 2
MIN_CONTAINMENT = 0.8
# Templates of one scale are at least this share of its length.
SCALE_STEP = 0.75
# Templates travel with the task; their number is bounded, whatever the size of the data.
MAX_TEMPLATE_WORDS = 1_000_000
PART = 1 << 16
LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

FOUND = "doc_id long, template string, containment double, start_word long, n_words long"

# Common notices, shortened to the sentences that files carry.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction"
    ),
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation"
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-condition": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met"
    ),
    "as-is-disclaimer": (
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not "
        "limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"
    ),
}


def token_hasher() -> WordHasher:
    """Words are runs of letters a-z, either case, and digits."""
    return WordHasher(bytes(b for b in range(256) if b not in LETTERS), fold=True)


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(11).integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), made[1]


class Templates:
    """Shingle sets of the templates, and their bands by scale."""

    def __init__(self, notices: dict[str, str]):
        hasher = token_hasher()
        words = {name: hasher.of(text.encode()) for name, text in notices.items()}
        words = {name: w for name, w in words.items() if len(w)}
        if sum(map(len, words.values())) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates have more than {MAX_TEMPLATE_WORDS} words")
        self.names = sorted(words, key=lambda name: (-len(words[name]), name))
        self.sets = [distinct(windows(words[name], SHINGLE)) for name in self.names]
        self.lengths = [len(words[name]) for name in self.names]
        a, b = hash_family()
        self.scales: dict[int, dict[int, list[int]]] = {}
        scale = None
        for i, length in enumerate(self.lengths):
            if scale is None or length < SCALE_STEP * scale:
                scale = length
            low = (self.sets[i][None, :] * a[:, None] + b[:, None]).min(axis=1)
            bands = self.scales.setdefault(scale, {})
            for key in band_keys(low[:, None])[:, 0].tolist():
                bands.setdefault(key, []).append(i)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band from minima (BANDS * ROWS, windows)."""
    rows = low.reshape(BANDS, ROWS, -1)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        total = mixed(total + rows[:, r])
    return total


class Part(NamedTuple):
    """A stretch of a text's shingles: of document `row`, from shingle `at` on."""

    row: int
    at: int
    marks: np.ndarray


def block_minima(hashed: np.ndarray, step: int) -> np.ndarray:
    """Least value of every `step` values; an incomplete last block is left out."""
    n = len(hashed) // step
    out = hashed[: n * step : step].copy()
    for k in range(1, step):
        np.minimum(out, hashed[k : n * step : step], out=out)
    return out


def retrieved(parts: list[Part], scales: dict[int, dict[int, list[int]]], family) -> set[tuple[int, int, int, int]]:
    """(row, scale, template, first shingle) of windows that share a band with a template.

    The parts stand in one array, each followed by a gap as long as the longest window, so that no
    window holds shingles of two.
    """
    gap = 3 * max(max(1, scale // 2) for scale in scales)
    ends = np.cumsum([len(p.marks) + gap for p in parts])
    begins = ends - [len(p.marks) + gap for p in parts]
    marks = np.zeros(int(ends[-1]) + gap, dtype=np.uint64)
    empty = np.ones(len(marks), dtype=bool)
    for part, begin in zip(parts, begins.tolist()):
        marks[begin : begin + len(part.marks)] = part.marks
        empty[begin : begin + len(part.marks)] = False
    empty = np.flatnonzero(empty)
    low: dict[int, list[np.ndarray]] = {scale: [] for scale in scales}
    for a, b in zip(*family):
        hashed = marks * a + b
        hashed[empty] = np.iinfo(np.uint64).max
        for scale in scales:
            low[scale].append(block_minima(hashed, max(1, scale // 2)))
    out = set()
    for scale, bands in scales.items():
        step, blocks = max(1, scale // 2), np.stack(low[scale])
        wide = np.minimum(np.minimum(blocks[:, :-2], blocks[:, 1:-1]), blocks[:, 2:])
        keys = band_keys(wide)
        known = np.fromiter(bands, dtype=np.uint64, count=len(bands))
        near = np.zeros(1 << 16, dtype=bool)
        near[(known & np.uint64(0xFFFF)).astype(np.int64)] = True
        band, window = np.nonzero(near[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        for i, j in zip(band.tolist(), window.tolist()):
            for template in bands.get(int(keys[i, j]), ()):
                start = j * step
                own = int(np.searchsorted(ends, start, side="right"))
                if own < len(parts) and start >= begins[own] + len(parts[own].marks):
                    own += 1  # it begins in the gap before the next part
                if own < len(parts):
                    out.add((parts[own].row, scale, template, parts[own].at + max(0, start - int(begins[own]))))
    return out


def scan_task(notices: dict[str, str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, family, hasher = Templates(notices), hash_family(), token_hasher()
        longest = max(templates.scales, default=0)

        def found(texts: dict[int, np.ndarray], parts: list[Part]) -> dict[tuple[int, int], tuple]:
            best: dict[tuple[int, int], tuple] = {}
            hits = retrieved(parts, templates.scales, family) if parts and templates.scales else ()
            for row, scale, template, first in sorted(hits):
                marks, step, size = texts[row], max(1, scale // 2), len(templates.sets[template])
                begin, end = max(0, first - step), first + 4 * step + SHINGLE
                near = np.isin(marks[begin:end], templates.sets[template])
                share = len(distinct(marks[begin:end][near])) / size
                if share >= least and share > best.get((row, template), (0.0,))[0]:
                    places = np.flatnonzero(near)
                    words = int(places[-1] - places[0]) + min(SHINGLE, templates.lengths[template])
                    best[row, template] = (share, begin + int(places[0]), words)
            return best

        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            texts: dict[int, np.ndarray] = {}
            parts: list[Part] = []
            held = 0

            def flush() -> None:
                for (row, t), value in sorted(found(texts, parts).items()):
                    out.append((ids[row], templates.names[t], *value))
                texts.clear()
                parts.clear()

            for row, text in enumerate(text_bytes(batch.column("text"))):
                texts[row] = marks = windows(hasher.of(text), SHINGLE)
                # Long texts are scanned in parts that overlap by more than a window.
                for at in range(0, len(marks), PART):
                    parts.append(Part(row, at, marks[at : at + PART + 2 * longest]))
                held += len(marks)
                if held >= PART:
                    flush()
                    held = 0
            flush()
            yield record_batch(out, FOUND)

    return run


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, least: float = MIN_CONTAINMENT) -> DataFrame:
    """(doc_id, template, containment, start_word, n_words) of the templates that rows contain.

    containment is the share of a template's distinct shingles of three words (fewer where it is
    shorter) found together near one place of the text, at least `least`; the best place counts,
    and of equal ones the first. Words are runs of a-z and 0-9 after lower-casing. Null
    or empty text contains nothing; repeated rows give their rows again; no rows or no templates
    give none. Other columns play no part, and no rows are shuffled.
    """
    thin = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return thin.mapInArrow(scan_task(NOTICES if notices is None else notices, least), FOUND)
