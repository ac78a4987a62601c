"""Toxicity by a weighted lexicon matched with Aho-Corasick.

A text is folded first: lower-cased, look-alike letters of other scripts and digits and signs that
stand for letters replaced by plain letters, everything else that is no letter taken as a space.
The lexicon holds whole words and word beginnings; both begin at a space, so one automaton finds
all of them in one pass. A match that lies in an exception phrase does not count. The evidence of a
text is the summed weight of its matches, seen as such and per word (normalised by length); a
logistic function of both is the score.

Everything is learned from labelled rows: at most ``FIT_ROWS`` of each label, those with the least
hash of their text, read whole. An entry needs a significant share of toxic rows (``LEAST_G``, a
likelihood ratio) and weighs its log odds; of nested beginnings only one stays, and an entry stays only if it
tells toxic rows that the entries before it miss. Words under an entry that are typical of clean rows become exceptions, beside the ones passed in. The lexicon holds at most ``ENTRIES`` entries and goes to the workers with the function.

Defined results: null and empty texts have no match and the score of a text without evidence, below
0.5 if any row is labelled clean. Equal texts have equal scores. Rows with a null label, and
unlabelled rows, teach nothing; a label row that repeats counts once, and with differing labels the
larger holds. Without labelled rows of both kinds every score is 0. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelwright.llm.sampling import least_hashed
from reelwright.session import written

FIT_ROWS = 3000
ENTRIES = 2000
LEAST_G = 30.0
NEW_G = 10.0
LEAST_ODDS = 3.0
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.7
#: Phrases in which a word of abuse is none.
EXCEPTIONS = ("clown fish", "clown nose", "trash can", "trash bin", "idiot proof", "village idiot", "pond scum")

#: Look-alikes of plain letters, pair by pair: Cyrillic, Greek, and signs. Fixed values.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
}


class _Folding(dict):
    """Translation table: look-alikes, letters as they are, full-width letters made plain, spaces for the rest."""

    def __missing__(self, code: int) -> int:
        char = chr(code)
        if char in LOOK_ALIKES:
            to = ord(LOOK_ALIKES[char])
        elif 0xFF41 <= code <= 0xFF5A:
            to = code - 0xFF41 + ord("a")
        else:
            to = code if char.isalpha() else 32
        self[code] = to
        return to


FOLDING = _Folding()


def fold(text: str | None) -> str:
    """Folded words between single spaces, one at each end."""
    words = (text or "").lower().translate(FOLDING).split()
    return f" {' '.join(words)} "


@dataclass(frozen=True)
class Lexicon:
    """Entries (with their leading space; whole words also end in one) and weights, exceptions, logistic weights."""

    entries: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    bias: float = 0.0
    per_sum: float = 0.0
    per_rate: float = 0.0
    fitted: bool = False

    def found(self, folded: str) -> list[str]:
        """The different entries that occur."""
        automaton = _automaton(self)
        return sorted({folded[end - size + 1:end + 1] for end, (size, _) in automaton.iter(folded)}) if automaton else []

    def evidence(self, folded: str) -> tuple[float, int]:
        """Summed weight of the matches outside exceptions, and their number."""
        automaton = _automaton(self)
        if automaton is None:
            return 0.0, 0
        hits, spared = [], []
        for end, (size, weight) in automaton.iter(folded):
            (hits if weight is not None else spared).append((end - size + 1, end, weight))
        if spared:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in spared)]
        # A word counts once: of matches from the same place, the heaviest.
        best: dict[int, float] = {}
        for start, _, weight in hits:
            best[start] = max(weight, best.get(start, 0.0))
        return sum(best.values()), len(best)

    def features(self, text: str | None) -> tuple[float, float, int]:
        folded = fold(text)
        total, n = self.evidence(folded)
        return math.log1p(total), math.log1p(100.0 * total / max(1, folded.count(" ") - 1)), n

    def score(self, text: str | None) -> tuple[float, int]:
        total, rate, n = self.features(text)
        if not self.fitted:
            return 0.0, n
        z = self.bias + self.per_sum * total + self.per_rate * rate
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), n


@lru_cache(4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for entry, weight in lexicon.entries:
        automaton.add_word(entry, (len(entry), weight))
    for phrase in lexicon.exceptions:
        folded = fold(phrase)
        automaton.add_word(folded, (len(folded), None))
    if not len(automaton):
        return None
    automaton.make_automaton()
    return automaton


def _candidates(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def _g(a: int, b: int, n1: int, n0: int) -> float:
    """Likelihood ratio of a of n1 rows against b of n0."""
    p = (a + b) / (n1 + n0)
    parts = ((a, n1 * p), (n1 - a, n1 * (1 - p)), (b, n0 * p), (n0 - b, n0 * (1 - p)))
    return 2 * sum(x * math.log(x / e) for x, e in parts if x > 0 and e > 0)


def _odds(a: int, b: int, n1: int, n0: int) -> float:
    return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))


def _entries(toxic: Counter, clean: Counter, n1: int, n0: int) -> dict[str, float]:
    """Telling entries and their weights; of nested ones the shortest, drawn out as far as it stays as common."""
    found = [e for e, a in toxic.items() if _odds(a, clean[e], n1, n0) >= LEAST_ODDS
             and _g(a, clean[e], n1, n0) >= LEAST_G]
    drawn: dict[str, str] = {}
    for entry in sorted(found, key=lambda e: (len(e), e)):
        short = next((entry[:k] for k in range(2, len(entry)) if entry[:k] in drawn), entry)
        if short == entry or toxic[entry] >= 0.9 * toxic[short]:
            drawn[short] = entry
    ranked = sorted(drawn.values(), key=lambda e: (-_g(toxic[e], clean[e], n1, n0), e))[:ENTRIES]
    return {e: round(_odds(toxic[e], clean[e], n1, n0), 6) for e in ranked}


def _needed(entries: dict[str, float], matched: list[tuple[int, list[str]]]) -> list[str]:
    """Entries in order of their weight of evidence that still tell toxic rows apart which those before missed.

    Words that only go along with abuse, as in copies of one toxic text, add no row and drop out.
    """
    rows: dict[str, list[int]] = {e: [] for e in entries}
    for i, (_, found) in enumerate(matched):
        for e in found:
            rows[e].append(i)
    n = Counter(y for y, _ in matched)
    covered: set[int] = set()
    kept = []
    for e in entries:
        new = Counter(matched[i][0] for i in rows[e] if i not in covered)
        if new[1] and _odds(new[1], new[0], n[1], n[0]) >= LEAST_ODDS / 3 and _g(new[1], new[0], n[1], n[0]) >= NEW_G:
            kept.append(e)
            covered.update(rows[e])
            n -= new
            if not n[0] or not n[1]:
                break
    return kept


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (bias, sum, rate) by Newton steps; both labels weigh alike; a small ridge keeps them finite."""
    w = np.zeros(3)
    x = np.hstack((np.ones((len(x), 1)), x))
    per_row = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    ridge = np.diag([1e-4, 1e-4, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (per_row * p * (1 - p))[:, None]).T @ x + ridge,
                               x.T @ (per_row * (p - y)) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        fit_rows: int = FIT_ROWS, exceptions: Sequence[str] = EXCEPTIONS) -> Lexicon:
    """Learn from the ``docs`` that have a 0/1 label; at most ``fit_rows`` different texts of each label are used.

    Only ids and hashes of texts are joined with the labels; the chosen texts are then read from ``docs``.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    texts = texts.where("text is not null")
    kinds = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    labelled = texts.select("id", "h").join(kinds.where("y in (0, 1)"), "id").select("y", "h")
    chosen = F.broadcast(least_hashed(labelled, "y", "h", fit_rows))
    met = texts.select("h", "text").join(chosen, "h").groupBy("y", "h").agg(F.first("text").alias("text"))
    sample = written(met.select("y", "h", "text"), "toxicity-sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        n = Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                n[y] += 1
                seen[y].update(_candidates(fold(text.as_py())))
        for y, c in seen.items():
            items = [("", n[y]), *c.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([y] * len(items), pa.int32()), pa.array([k for k, _ in items]),
                 pa.array([v for _, v in items], pa.int64())], ["y", "entry", "n"])

    totals = sample.mapInArrow(counts, "y int, entry string, n long").groupBy("entry").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("clean"))
    # What cannot reach the likelihood ratio stays away; the empty entry holds the numbers of rows.
    got = totals.where("entry = '' or toxic >= 4").collect()
    toxic = Counter({r.entry: r.toxic for r in got})
    clean = Counter({r.entry: r.clean for r in got})
    n1, n0 = toxic.pop("", 0), clean.pop("", 0)
    if not n1 or not n0:
        return Lexicon((), tuple(exceptions))
    telling = _entries(toxic, clean, n1, n0)
    first = Lexicon(tuple(sorted(telling.items())), ())

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [first.found(fold(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], ["y", "h", "found"])

    matches = sorted(sample.mapInArrow(matched, "y int, h long, found array<string>").collect())
    kept = _needed(telling, [(m.y, m.found) for m in matches])
    # An entry as common as the needed ones is one of them, though no row may depend on it.
    common = max((toxic[e] for e in kept), default=0) / 2
    kept += [e for e in telling if e not in kept and toxic[e] >= common and not clean[e]]
    entries = sorted((e, telling[e]) for e in kept)
    begins = tuple(e for e, _ in entries if not e.endswith(" "))
    spared = [e.strip() for e in clean if e.endswith(" ") and clean[e] > toxic[e] and e.startswith(begins)] if begins else []
    draft = Lexicon(tuple(entries), tuple(sorted({*exceptions, *spared})))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [draft.features(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in f], pa.float64()),
                 pa.array([x[1] for x in f], pa.float64())], ["y", "h", "total", "rate"])

    points = sorted(sample.mapInArrow(measured, "y int, h long, total double, rate double").collect())
    w = _logistic(np.array([[p.total, p.rate] for p in points]), np.array([p.y for p in points], float))
    return Lexicon(draft.entries, draft.exceptions, *map(float, w), fitted=True)


def toxicity(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[Column] | None = None,
             threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns (all by default) with score, predicted and matches."""
    kept = docs.select(*(keep if keep is not None else ["*"]))
    names = [f"k{i}" for i in range(len(kept.columns))]
    narrow = docs.select(*(keep if keep is not None else ["*"]), F.col(text_col).alias("_text")).toDF(*names, "_text")
    types = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, kept.schema.fields))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([s for s, _ in found], pa.float64()),
                 pa.array([int(s >= threshold) for s, _ in found], pa.int32()),
                 pa.array([n for _, n in found], pa.int32())], [*names, "score", "predicted", "matches"])

    schema = ", ".join(x for x in (types, "score double, predicted int, matches int") if x)
    return narrow.mapInArrow(of_batches, schema).toDF(*kept.columns, "score", "predicted", "matches")
