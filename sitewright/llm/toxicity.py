"""Toxicity by a weighted lexicon (operator 3).

Texts are folded first: case and accents go, letters of other scripts that look like Latin ones become those, digits
and signs that stand for letters become letters, everything else separates words. An Aho-Corasick automaton finds the
lexicon's entries, whole words or word beginnings, in one pass; hits inside exception phrases don't count. The weights
of the hits, as a sum normalised by length, as a logarithm and as a maximum, enter a logistic curve.

Lexicon and curve are learned from labelled rows, of which at most `bound` of each label (on average; the choice is by
a hash of doc_id) are looked at, so the model's size and the cost of training don't grow with the corpus. Every term that
enough of these texts support and that tells enough enters the lexicon. Seven in ten sampled rows give the lexicon, the others the curve, with
the weight of the rows they stand for.

Nulls: a null text is an empty text and gets a score. A row without a doc_id is not held out, and can't be trained on.
Labels that are null, or of which a document has two, don't count; of a repeated doc_id one text is learned from. Without labels of both kinds the lexicon is empty and
the score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import map_batches, text_of, written

BOUND = 4000
SUPPORT = 5
LEAST_WEIGHT = math.log(8)
STEMS = range(3, 11)
FOLDS = 5
SCALE = 1_000_000
#: Phrases in which a lexicon word is harmless, folded like texts.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "clown car", "class clown", "pond scum", "soap scum", "sore loser", "the idiot box")
# Letters that look like Latin ones, and digits and signs used in their place.
HOMOGLYPHS = dict(zip("авсеһіјкмнорѕтухԁԛԝ", "abcehijkmhopstuxdqw")) | dict(zip("αβεηικνορτυχω", "abenikvoptuxw")) | {"ı": "i", "ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"}
DIGITS = dict(zip("013456789", "oieasgtbg"))
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
_SIGN = re.compile(r"(?<=\w)[@$!|](?=[a-z])|[@$](?=[a-z])")


class _Letters(dict):
    """What each code point becomes; filled as texts need it."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        found = HOMOGLYPHS.get(letter) or DIGITS.get(letter)
        if found is None:
            plain = "".join(c for c in unicodedata.normalize("NFKD", letter).lower() if not unicodedata.combining(c))
            plain = "".join(HOMOGLYPHS.get(c, c) for c in plain)
            found = plain if plain and plain.isalpha() else " "
        self[code] = found
        return found


_LETTERS = _Letters()


def folded(text: str) -> str:
    """Folded words, each with a space before and after."""
    low = text.lower()
    if "@" in low or "$" in low or "!" in low or "|" in low:
        low = _SIGN.sub(lambda m: SIGNS[m[0]], low)
    return f" {' '.join(low.translate(_LETTERS).split())} "


def stems(line: str) -> set[str]:
    """What may enter a lexicon: words (with both spaces) and their beginnings (with the space before)."""
    out = set()
    for word in set(line.split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in STEMS if k <= len(word))
    return out


class Model(NamedTuple):
    """bias and slopes of (log of the sum, sum by root of length, maximum) of the hits' weights."""

    lexicon: dict[str, float]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term, weight in self.lexicon.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            line = folded(phrase)
            if not self.lexicon.get(line):
                found.add_word(line, (len(line), None))
        if len(found):
            found.make_automaton()
        return found


def features(line: str, automaton: ahocorasick.Automaton) -> tuple[float, float, float]:
    if not len(automaton):
        return 0.0, 0.0, 0.0
    hits, harmless = [], []
    for end, (size, weight) in automaton.iter(line):
        (harmless if weight is None else hits).append((end + 1 - size, end, weight))
    if harmless:
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in harmless)]
    if not hits:
        return 0.0, 0.0, 0.0
    total = sum(h[2] for h in hits)
    return math.log1p(total), total / math.sqrt(line.count(" ")), max(h[2] for h in hits)


def probability(curve: tuple[float, ...], found: tuple[float, float, float]) -> float:
    z = curve[0] + sum(c * f for c, f in zip(curve[1:], found))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", key: str = "doc_id", bound: int = BOUND, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key)).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("other")).where("y = other").select("id", "y")
    counts = {y: n for y, n in known.groupBy("y").count().collect()}
    if not counts.get(0) or not counts.get(1):
        prior = counts.get(1, 0) / max(1, sum(counts.values()))
        return Model({}, (700.0 if prior == 1 else -800.0, 0.0, 0.0, 0.0), exceptions)
    share = {y: min(1.0, bound / n) for y, n in counts.items()}
    draw = F.pmod(F.xxhash64("id"), F.lit(SCALE))
    chosen = known.where(F.when(F.col("y") == 1, draw < int(share[1] * SCALE)).otherwise(draw < int(share[0] * SCALE)))
    # At most `bound` numbers of each label on average: small enough to send everywhere. One text for each, so that a
    # repeated doc_id doesn't swell the sample; written, so that the documents are read once.
    sample = docs.select(F.col(key).cast("long").alias("id"), text_of(text).alias("t")).join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    rows = written(sample, "sample").select("y", "t", (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10)) < 7).alias("first"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([s[t] for t in terms], pa.int64()) for s in seen)], names=["term", "clean", "toxic"])
            seen[0].clear(), seen[1].clear()
            return batch

        for batch in batches:
            for y, t, first in zip(*(c.to_pylist() for c in batch.columns)):
                if first:
                    line = folded(t)
                    seen[y].update(stems(line))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield out()
        yield out()

    total = map_batches(rows, count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {y: n for y, n in rows.where("first").groupBy("y").count().collect()}
    weight = F.log((F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1)) - F.log((F.col("clean") + 0.5) / (sizes.get(0, 0) + 1))
    # Only terms of the lexicon's kind come to the driver: the sample's size bounds how many have support.
    kept = total.withColumn("weight", weight).where((F.col("toxic") >= SUPPORT) & (F.col("weight") >= LEAST_WEIGHT)).collect()
    lexicon = chosen_terms([(r.term, r.toxic, r.weight) for r in kept])
    model = Model(lexicon, (0.0,) * 4, exceptions)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = [(y, *features(folded(t), automaton)) for y, t, first in zip(*(c.to_pylist() for c in batch.columns)) if not first]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.float64()) for k in range(4)], names=["y", "a", "b", "c"])

    points = np.array([tuple(r) for r in map_batches(rows, measure, "y double, a double, b double, c double").collect()]).reshape(-1, 4)  # bounded like the sample
    return model._replace(curve=logistic(points[:, 1:], points[:, 0], np.where(points[:, 0] == 1, 1 / share[1], 1 / share[0])))


def chosen_terms(terms: list[tuple[str, int, float]]) -> dict[str, float]:
    """Weights of terms (term, toxic texts, log odds); of a word's beginnings, the most telling one only."""
    rated = sorted((-toxic * weight, -len(term.rstrip()), len(term), term, weight) for term, toxic, weight in terms)  # of equals the longest beginning, whole word or not
    found: dict[str, float] = {}
    begun: set[str] = set()
    for *_, term, weight in rated:
        if term not in begun and not any(term[:k] in found for k in range(2, len(term))):
            found[term] = weight
            begun.update(term[:k] for k in range(2, len(term)))
    return found


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)]) * max(1.0, weight.sum() / 1000)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, beta))


def scores(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            found = pa.array([probability(model.curve, features(folded(t), automaton)) for t in batch.column(2).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key).alias("held_out"), text_of(text).alias("t"))
    return map_batches(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", reject: float = 0.5) -> DataFrame:
    """docs whose score stays below `reject`, with all their columns."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            yield batch.filter(pa.array([probability(model.curve, features(folded(t or ""), automaton)) < reject for t in batch.column(place).to_pylist()], pa.bool_()))

    return map_batches(docs, run, docs.schema)
