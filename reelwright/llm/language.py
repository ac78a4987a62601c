"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte n-grams: A-Z lower-cased, every run of
ASCII characters other than letters taken as one space, n-grams of two to four bytes, hashed into
``DIMS`` cells; a cell weighs the square root of its count times its inverse document frequency.
Per language several centroids are fitted by spherical k-means. A text gets the language of the
centroid with the highest cosine, which is also its score.

Rejection goes by distance: a text farther from every centroid than its winner's radius is
``rejected``; it keeps its prediction. Radii are learned from rows that the centroids have not seen,
one for each language and length, as short texts lie farther off: pieces of 8, 16, 32 bytes and so on
of the rows left out, the cosine that a tenth of them stay below, and ``RADIUS_PART`` of that cosine
as the least one kept. A text goes by the longest piece that is no longer than itself. Texts of under
8 bytes, and languages of fewer than ``LEAST_ROWS`` fitted rows, have no radius.

The fit uses at most ``PER_LANGUAGE`` rows of each language, those with the least hash of their
text, and reads them whole. Everything else covers all rows. The model is a matrix of a few hundred
kilobytes and goes to the workers with the function.

Defined results: null texts, and texts without any letter, are ``und`` with score 0, and rejected.
Ties between centroids go to the language first in order. With no labelled row at all, every text
is ``und``. Repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.llm.sampling import least_hashed

DIMS = 4096
SIZES = (2, 3, 4)
PER_LANGUAGE = 300
CENTROIDS = 4
UNKNOWN = "und"
LEFT_OUT = 5  # one fitted row in so many sets the radii, not the centroids
LEAST_ROWS = 20
PIECE_SIZES = tuple(1 << k for k in range(3, 13))
PIECES = 3  # of a size, per row left out
LOW_QUANTILE = 0.1
RADIUS_PART = 0.5
ROWS_AT_ONCE = 128
BYTES_AT_ONCE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")


def _letter_table() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    for c in range(256):
        if 65 <= c <= 90:
            table[c] = c + 32
        elif 97 <= c <= 122 or c >= 128:
            table[c] = c
    return table


LETTERS = _letter_table()


def gram_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed n-grams, one row per text."""
    counts = np.zeros(len(texts) * DIMS, np.float32)
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (until == at or size + len(texts[until]) <= BYTES_AT_ONCE):
            size += len(texts[until])
            until += 1
        _add_counts(texts[at:until], counts[at * DIMS:until * DIMS])
        at = until
    return counts.reshape(len(texts), DIMS)


def _add_counts(texts: list[bytes], counts: np.ndarray) -> None:
    """Spaces around each text keep n-grams from crossing into the next."""
    data = LETTERS[np.frombuffer(b" " + b"   ".join(texts) + b" ", np.uint8)]
    sizes = np.array([len(t) + 3 for t in texts])
    row = np.repeat(np.arange(len(texts)), sizes)[:len(data)]
    if len(row) < len(data):
        row = np.concatenate((row, np.full(len(data) - len(row), len(texts) - 1)))
    kept = np.ones(len(data), bool)
    kept[1:] = (data[1:] != 32) | (data[:-1] != 32)
    data, row = data[kept].astype(np.uint32), row[kept]
    for n in SIZES:
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x9E3779B1) + data[k:len(data) - n + 1 + k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x85EBCA6B)
        cell = (code >> np.uint32(32 - 12)).astype(np.int64) + row[:len(code)] * DIMS
        counts += np.bincount(cell, minlength=len(counts)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return bool(text) and LETTER.search(text) is not None


@dataclass(frozen=True)
class Model:
    """Languages of the centroids, the centroids, the IDF weights, the least cosine not rejected by centroid and length."""

    langs: tuple[str, ...]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.sqrt(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of the winning centroid and its cosine."""
        cosines = self.vectors(gram_counts(texts)) @ self.centroids.T
        best = np.argmax(cosines, axis=1)
        return best, np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0)

    def least_for(self, texts: list[bytes], best: np.ndarray) -> np.ndarray:
        """The least cosine that keeps each text: by its winner and its length."""
        place = np.searchsorted(PIECE_SIZES, [len(t) for t in texts], side="right")
        return self.least[best, place]


def _clusters(v: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    centroids = [v.mean(0) / max(np.linalg.norm(v.mean(0)), 1e-12)]
    while len(centroids) < min(k, len(v)):
        centroids.append(v[np.argmin((v @ np.array(centroids).T).max(1))])
    c = np.array(centroids)
    for _ in range(20):
        owner = np.argmax(v @ c.T, axis=1)
        sums = np.array([v[owner == j].sum(0) if (owner == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _pieces(text: bytes, h: int) -> list[tuple[int, bytes]]:
    """(place of the size, piece): up to ``PIECES`` of each size, from starts that the hash sets."""
    found = []
    for place, size in enumerate(PIECE_SIZES, 1):
        room = len(text) - size + 1
        starts = {(h * (2 * j + 1) + j * size) % room for j in range(PIECES)} if room > 0 else ()
        found += [(place, text[s:s + size]) for s in sorted(starts)]
    return found


def _least_cosines(vectors: np.ndarray, places: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The least cosine kept, by length; a longer text is never let off with less than a shorter one."""
    least = np.zeros(len(PIECE_SIZES) + 1, np.float32)
    for place in set(places.tolist()):
        nearest = (vectors[places == place] @ centroids.T).max(1)
        least[place] = RADIUS_PART * np.quantile(nearest, LOW_QUANTILE)
    return np.maximum.accumulate(least)


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE,
        centroids: int = CENTROIDS) -> Model:
    """Fit on at most ``per_language`` rows of each language; only their n-gram counts reach the driver."""
    usable = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = usable.select("lang", "text", F.xxhash64("text").alias("h"))
    chosen = least_hashed(hashed, "lang", "h", per_language)
    # Copies of a text count once.
    sample = hashed.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                parts = [(0, text)] + (_pieces(text, h) if h % LEFT_OUT == 0 else [])
                counts = gram_counts([t for _, t in parts])
                cells = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(parts)), pa.array([h] * len(parts), pa.int64()), pa.array([p for p, _ in parts], pa.int32()),
                    pa.array([i.astype("<u2").tobytes() for i in cells], pa.binary()),
                    pa.array([c[i].astype("<f4").tobytes() for c, i in zip(counts, cells)], pa.binary()),
                ], ["lang", "h", "place", "cells", "counts"])

    counted = sample.select("lang", "h", F.col("text").cast("binary").alias("text")).mapInArrow(
        of_batches, "lang string, h long, place int, cells binary, counts binary")
    got = sorted({tuple(r) for r in counted.toLocalIterator()})
    if not got:
        return Model((), np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), np.zeros((0, len(PIECE_SIZES) + 1), np.float32))
    counts = np.zeros((len(got), DIMS), np.float32)
    for row, (_, _, _, cells, values) in zip(counts, got):
        row[np.frombuffer(cells, "<u2")] = np.frombuffer(values, "<f4")
    owner = np.array([r[0] for r in got])
    place = np.array([r[2] for r in got])
    names, sizes = np.unique(owner[place == 0], return_counts=True)
    large = np.isin(owner, names[sizes >= LEAST_ROWS])
    left_out = large & (np.array([r[1] for r in got]) % LEFT_OUT == 0)
    fitted = ~left_out & (place == 0)
    idf = np.log((1 + fitted.sum()) / (1 + (counts[fitted] > 0).sum(0))).astype(np.float32) + 1
    vectors = Model((), np.zeros((0, DIMS)), idf, np.zeros(0)).vectors(counts)
    langs, all_centroids, least = [], [], []
    for lang in names[np.isin(names, owner[fitted])].tolist():
        c = _clusters(vectors[fitted & (owner == lang)], centroids)
        pieces = left_out & (owner == lang) & (place > 0)
        langs += [lang] * len(c)
        all_centroids.append(c)
        least += [_least_cosines(vectors[pieces], place[pieces], c)] * len(c)
    return Model(tuple(langs), np.concatenate(all_centroids).astype(np.float32), idf, np.array(least, np.float32))


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The ``keep`` columns (all by default) with lang_pred, score and rejected."""
    kept = docs.select(*(keep if keep is not None else ["*"]))
    names = [f"k{i}" for i in range(len(kept.columns))]
    if keep is None:  # the text is among them, and goes to the workers once
        narrow, at_text, sent = kept.toDF(*names), docs.columns.index(text_col), len(names)
    else:
        narrow = docs.select(*keep, F.col(text_col).alias("_text")).toDF(*names, "_text")
        at_text = sent = len(names)
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema.fields))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column(at_text).to_pylist()
                lettered = np.array([has_letter(t) and bool(model.langs) for t in texts], bool)
                langs, scores, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                rows = np.flatnonzero(lettered)
                if len(rows):
                    lettered_texts = [texts[i].encode() for i in rows]
                    best, cosine = model.predict(lettered_texts)
                    scores[rows], far[rows] = cosine, cosine < model.least_for(lettered_texts, best)
                    for i, b in zip(rows.tolist(), best.tolist()):
                        langs[i] = model.langs[b]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:sent], pa.array(langs), pa.array(scores), pa.array(far)],
                    [*names, "lang_pred", "score", "rejected"])

    schema = ", ".join(x for x in (types, "lang_pred string, score double, rejected boolean") if x)
    return narrow.mapInArrow(of_batches, schema).toDF(*kept.columns, "lang_pred", "score", "rejected")


def without_rejected(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is recognised."""
    marked = identify(docs, model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = marked.toDF(*names, "lang_pred", "score", "rejected").where("not rejected")
    return kept.select(*names).toDF(*docs.columns)
