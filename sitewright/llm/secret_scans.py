"""Secret scans (operator 1): fixed patterns, and a randomness test battery for everything they don't name.

Strings of 20 or more characters from the base64, URL and hex alphabets that mix character classes are candidates, also
those behind `NAME=` and beside a fixed pattern's span. The
encoding is inferred from the characters used. Three tests look at each candidate:

- chi-squared: how evenly the alphabet is used;
- runs: how often the class of characters (lower, upper, digit, sign) changes;
- serial correlation of neighbouring characters' places in the alphabet.

Each test first asks whether the string could be random at all; a string that any of them rejects at `VETO` is no
secret. Then each asks how likely ordinary text or identifiers would look as random as this, and Simes' rule combines the
three answers to one p-value. What counts as a finding is decided by false-discovery control
(Benjamini-Hochberg) over all candidates of the corpus, in strata by encoding and octave of the length, since short
strings can't give small p-values and would otherwise drown in, or ride on, the long ones. The strata's histograms are
summed over the whole corpus; their size is fixed (encodings x octaves x steps of p).

Nulls: a null text is empty and has no spans. Repeated rows give repeated results, but each counts as a test. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import map_batches, text_of, written

RATE = 0.01
LEAST = 20
VETO = 1e-4
STEPS, PER_DECADE = 300, 10
_ROW = "__row"
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PIECE = re.compile(r"([A-Za-z0-9+/_-]{%d,})(={1,2}(?![A-Za-z0-9+/_=-]))?" % LEAST)
PLACEHOLDER = "<SECRET>"
# Encodings in the order in which they are tried: name, alphabet.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"), ("hex_upper", DIGITS + "ABCDEF"), ("base32", UPPER + "234567"), ("base36", DIGITS + LOWER), ("base36_upper", DIGITS + UPPER),
    ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"), ("base64any", UPPER + LOWER + DIGITS + "+/-_"),
)
# Ordinary text: sums of squares and cubes of its letters' shares, and how often the class changes from one character to the next.
TEXT_SQUARES, TEXT_CUBES, TEXT_CHANGES = 0.065, 0.0055, 0.15
# Identifiers made of words: mean of the serial correlation (0.16 to 0.23 by their style), and its spread at length 1.
TEXT_SERIAL, TEXT_SERIAL_SPREAD = 0.2, 0.45
HEX_SQUARES, HEX_CUBES = 0.15, 0.027


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def base_spans(text: str, low: str | None = None) -> list[Span]:
    """The spans of the fixed patterns, by start, then kind."""
    found = []
    low = text.lower() if low is None else low
    if any(word in low for word in KEYWORDS):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for run in RUN.finditer(text):  # both patterns below stay inside such runs
        at, piece = run.start(), run[0]
        if "AKIA" in piece:
            found += [Span(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(piece) if len(m[0]) >= 16]
        if len(piece) >= 32:
            found += [Span(at + m.start(), 2, at + m.end()) for m in HEX.finditer(piece)]
    return sorted(found)


def encoding_of(piece: str) -> int | None:
    """The first encoding whose alphabet holds the string, if it mixes classes of characters; padding is left off."""
    used = set(piece)
    if sum((any(c in LOWER for c in used), any(c in UPPER for c in used), any(c in DIGITS for c in used))) < 2:
        return None
    return next((k for k, (_, alphabet) in enumerate(ENCODINGS) if used <= set(alphabet)), None)


_PLACES = [{c: k for k, c in enumerate(alphabet)} for _, alphabet in ENCODINGS]
_NORMAL = NormalDist()
_CLASS = {c: k for k, group in enumerate((LOWER, UPPER, DIGITS, "+/-_")) for c in group}


def p_value(piece: str, encoding: int) -> float:
    """How likely ordinary text looks as random as this; 1 if it isn't random."""
    size, n = len(ENCODINGS[encoding][1]), len(piece)
    codes = np.fromiter((_PLACES[encoding][c] for c in piece), np.int64, n)
    classes = np.fromiter((_CLASS[c] for c in piece), np.int64, n)
    counts = np.bincount(codes, minlength=size)
    chi = size / n * float(np.square(counts).sum()) - n
    changes = int((classes[1:] != classes[:-1]).sum())
    shares = np.bincount([_CLASS[c] for c in ENCODINGS[encoding][1]]) / size
    switch = 1 - float(np.square(shares).sum())
    centred = codes - (size - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / ((n - 1) * (size * size - 1) / 12)
    # Could it be random? Wilson and Hilferty's cube root for chi-squared, normal limits for the others.
    freedom = size - 1
    z_chi = ((max(chi, 0) / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    z_runs = abs(changes - (n - 1) * switch) / math.sqrt((n - 1) * switch * (1 - switch))
    z_serial = abs(serial) * math.sqrt(n - 1)
    if _NORMAL.cdf(-z_chi) < VETO or 2 * _NORMAL.cdf(-z_runs) < VETO or 2 * _NORMAL.cdf(-z_serial) < VETO:
        return 1.0
    # Would text be as even, change its class as often, and have neighbours as far apart?
    squares, cubes = (HEX_SQUARES, HEX_CUBES) if size == 16 else (TEXT_SQUARES, TEXT_CUBES)
    mean = size + size * (n - 1) * squares - n
    spread = size * math.sqrt(4 * n * (cubes - squares**2) + 2 * squares)
    p_chi = _NORMAL.cdf((chi - mean) / spread)
    p_runs = binomial_tail(n - 1, changes, TEXT_CHANGES)
    p_serial = _NORMAL.cdf((serial - TEXT_SERIAL) * math.sqrt(n - 1) / TEXT_SERIAL_SPREAD)
    return min(1.0, *(3 / k * p for k, p in enumerate(sorted((p_chi, p_runs, p_serial)), 1)))


def binomial_tail(n: int, least: int, p: float) -> float:
    """P(at least `least` of n), in logarithms where factorials are large."""
    if least <= 0:
        return 1.0
    if least <= n * p:
        return 0.5  # not rare; the exact value doesn't matter
    log = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    first, total, ratio, k = log(least), 1.0, 1.0, least
    while k < n and ratio > 1e-12:
        ratio *= (n - k) / (k + 1) * p / (1 - p)
        total += ratio
        k += 1
    return min(1.0, math.exp(first) * total)


class Candidate(NamedTuple):
    start: int
    end: int
    stratum: int
    step: int


def candidates(text: str, taken: list[Span]) -> list[Candidate]:
    """Strings to test: runs cut at '=' and at the edges of the spans already found. step: -10 log10 p, rounded down.

    Padding at the end of a run belongs to its string but isn't tested.
    """
    found = []
    for run in PIECE.finditer(text):
        for start, end in outside(run.start(1), run.end(1), taken):
            encoding = encoding_of(text[start:end]) if end - start >= LEAST else None
            if encoding is None:
                continue
            p = p_value(text[start:end], encoding)
            padded = run.end() if end == run.end(1) and not any(s.start <= end < s.end for s in taken) else end
            found.append(Candidate(start, padded, encoding * 64 + (end - start).bit_length(), min(STEPS, int(-PER_DECADE * math.log10(max(p, 1e-300))))))
    return found


def outside(start: int, end: int, taken: list[Span]) -> Iterator[tuple[int, int]]:
    """The parts of start..end that no span touches."""
    for s in taken:
        if s.start >= end:
            break
        if s.start > start:
            yield start, s.start
        start = max(start, s.end)
    if start < end:
        yield start, end


def findings_from(histogram: dict[int, dict[int, int]], rate: float = RATE) -> dict[int, int]:
    """The least step that counts as a finding in each stratum (Benjamini-Hochberg on binned p-values)."""
    least = {}
    for stratum, steps in histogram.items():
        tests, passed = sum(steps.values()), 0
        for step in sorted(steps, reverse=True):
            passed += steps[step]
            if step > 0 and 10 ** (-step / PER_DECADE) * tests <= rate * passed:
                least[stratum] = step
    return least


def _scanned(docs: DataFrame, text: str, key: str) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    test = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("step", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tests = [], []
            for t in batch.column(1).to_pylist():
                spans = base_spans(t)
                base.append([s._asdict() for s in spans])
                tests.append([c._asdict() for c in candidates(t, spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(tests, test)], names=["doc_id", "base", "tests"])

    schema = "doc_id long, base array<struct<start:long,kind:int,end:long>>, tests array<struct<start:long,end:long,stratum:int,step:int>>"
    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t")), run, schema)


def _thresholds(scanned: DataFrame, rate: float) -> dict[int, int]:
    """From all candidates of the corpus; the histogram has at most 9 encodings x 32 octaves x 301 steps."""
    histogram: dict[int, dict[int, int]] = {}
    for stratum, step, count in scanned.select(F.explode("tests").alias("t")).groupBy("t.stratum", "t.step").count().collect():
        histogram.setdefault(stratum, {})[step] = count
    return findings_from(histogram, rate)


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", rate: float = RATE) -> DataFrame:
    """(doc_id, base, spans) for each row: arrays of (start, kind, end), where kind is a place in KINDS."""
    scanned = written(_scanned(docs, text, key), "scanned")
    least = _thresholds(scanned, rate)
    keep = " or ".join(f"(x.stratum = {stratum} and x.step >= {step})" for stratum, step in sorted(least.items())) or "false"
    added = F.expr(f"transform(filter(tests, x -> {keep}), x -> struct(x.start as start, {KINDS.index('random')} as kind, x.end as end))")
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", rate: float = RATE, placeholder: str = PLACEHOLDER) -> DataFrame:
    """docs with every span of a secret replaced; a text without secrets, a null one too, stays as it is."""
    least = _thresholds(_scanned(docs.withColumn(_ROW, F.lit(None).cast("long")), text, _ROW), rate)
    fields, place = docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t and without_secrets(t, least, placeholder) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if k == place else batch.column(k) for k in range(len(fields))], names=fields)

    return map_batches(docs, run, docs.schema)


def without_secrets(text: str, least: dict[int, int], placeholder: str = PLACEHOLDER) -> str:
    spans = base_spans(text)
    spans = sorted([*spans, *(Span(c.start, 3, c.end) for c in candidates(text, spans) if c.step >= least.get(c.stratum, STEPS + 1))])
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], placeholder]
        at = max(at, s.end)
    return "".join([*out, text[at:]]) if spans else text


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined, of an array of spans."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)), ',')")
