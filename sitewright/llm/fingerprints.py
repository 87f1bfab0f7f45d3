"""Document fingerprints by SimHash, and the search for near ones (operator 6).

The terms of a text are its lower-cased words and pairs of neighbouring words. Each term's 128-bit hash votes, with the
weight of the term, on 128 signed bits; the signs are the fingerprint. A pair weighs more than a word, and repetition
counts by its logarithm, so that common words of a language don't make strangers look alike. The likeness of two
fingerprints is the cosine that the share of differing bits stands for, at least 0.

`near` and `near_counts` find all fingerprints within a Hamming radius r. 128 bits are cut into blocks, and a table for each
block (or each choice of two or three blocks, where there are very many fingerprints) has them permuted to the front: equal
fronts give the candidates, which are checked in full. With r + k blocks and fronts of k of them, no near fingerprint can
miss every table. Equal fingerprints are one entry with a count. A front that very many entries share is cut into runs that
meet in tasks of their own.

`with_next` gives each row of a table its successor by doc_id without bringing the table together: rows are dealt by
ranges of doc_id and a hash of the text, so many rows of one doc_id, or without one, are split too, and sorted there; the last row of a range, whose successor is elsewhere, is handed on as an exception.

`near_counts` gives how many rows each query has within the radius, not the pairs: the tables' runs are searched in place,
and a pair counts in the first table where its blocks agree. The radius of 7 is the widest that blocks of 16 bits serve.

Nulls: a null text is an empty text, with no terms and the fingerprint of all zeros. Rows without a doc_id come first
in the order. Rows with the same doc_id follow each other in the order of their texts' XXH64, then of the texts. A table of one row is its own
successor. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.common import map_batches, shuffle_partitions, text_of, written

BITS = 128
PAIR_WEIGHT, WORD_WEIGHT = 4, 1
TILE = 2048
RADIUS = 7
FRONT = 1024
_TABLE = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), 1, -1).astype(np.int32)


def terms(text: str) -> Counter:
    words = text.lower().split()
    found = Counter(words)
    found.update(zip(words, words[1:]))
    return found


def votes(counts: Counter) -> np.ndarray:
    """Signed votes on each bit; damped counts keep the weights whole numbers."""
    if not counts:
        return np.zeros(BITS, np.int64)
    digest = xxhash.xxh3_128_digest
    hashes = np.frombuffer(b"".join(digest(t if type(t) is str else f"{t[0]} {t[1]}") for t in counts), np.uint8).reshape(-1, BITS // 8)
    weights = np.fromiter(((WORD_WEIGHT if type(t) is str else PAIR_WEIGHT) * n.bit_length() for t, n in counts.items()), np.float64, len(counts))
    out = np.empty(BITS, np.int64)
    for k in range(BITS // 8):  # votes by value of the byte, then by bit
        out[8 * k : 8 * k + 8] = np.bincount(hashes[:, k], weights, 256).astype(np.int64) @ _TABLE
    return out


def fingerprint(text: str) -> bytes:
    return np.packbits(votes(terms(text)) > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal fingerprints; the cosine of the angle that the differing bits stand for, not below 0."""
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return max(0.0, math.cos(math.pi * apart / BITS))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the following text (or all it has)."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


# --- successors


def _described(doc: int | None, text: str, following: str, following_print: bytes | None = None, own: bytes | None = None) -> tuple:
    new = edited(text, following)
    own = own or fingerprint(text)
    changed = own if new == text else fingerprint(new)
    return doc, len(text), hashlib.sha256(new.encode()).hexdigest(), own.hex(), changed.hex(), likeness(own, changed), likeness(own, following_print or fingerprint(following))


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) of each row, as 32 hex digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t).hex() for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t")), run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to both neighbours: see FIELDS."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t"), F.xxhash64(text_of(text)).alias("h"))
    sorted_rows = rows.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "t")
    schema = pa.schema([*FIELDS, ("place", pa.int64()), ("head", pa.string()), ("tail", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        before: tuple | None = None
        head: str | None = None
        for batch in batches:
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fingerprint(t)
                if before is None:
                    head = t
                else:
                    out.append((*_described(*before[:2], t, own, before[2]), None, None, None))
                before = (doc, t, own)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        if before is not None:  # one row for each range: its first text, and its last row with the text
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((before[0], None, None, None, None, None, None, place, head, before[1]), schema)], schema=schema)

    found = written(map_batches(sorted_rows, run, f"{SCHEMA}, place long, head string, tail string"), "successors")
    ends = found.where("place is not null").select("place", "doc_id", "head", "tail")
    # Only the numbers of the ranges come together here, never rows; there are as many as shuffle partitions.
    order = ends.select("place", F.coalesce(F.lead("place").over(Window.orderBy("place")), F.min("place").over(Window.partitionBy())).alias("next_place"))
    open_rows = ends.select("place", "doc_id", "tail").join(order, "place").join(ends.select(F.col("place").alias("next_place"), F.col("head").alias("following")), "next_place").select("doc_id", "tail", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_described(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(FIELDS)], names=[n for n, _ in FIELDS])

    return found.where("place is null").drop("place", "head", "tail").unionByName(map_batches(open_rows, close, SCHEMA))


# --- search


def tables_for(entries: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """(number of blocks, the blocks in front in each table): as few tables as leave evenly spread entries some FRONT to a front, up to three blocks."""
    agree = 1
    while agree < 3 and entries >> (BITS * agree // (radius + agree)) > FRONT:
        agree += 1
    return radius + agree, list(combinations(range(radius + agree), agree))


def near_counts(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, tile: int = TILE, front: int | None = None) -> DataFrame:
    """prints, queries (fingerprint string, in hex) -> (fingerprint, near): rows of prints within the radius of each different query.

    front: how many blocks stand in front, instead of as many as the number of entries asks for.
    """
    if not 1 <= radius <= 15:
        raise ValueError("radius 1 to 15, for blocks of 8 to 64 bits")
    spark = prints.sparkSession

    def entries(df: DataFrame, asked: bool) -> DataFrame:
        return df.where(F.col("fingerprint").rlike(f"^[0-9a-f]{{{BITS // 4}}}$")).groupBy(F.unhex("fingerprint").alias("fp")).agg(F.count("*").alias("rows")).select("fp", "rows", F.lit(asked).alias("asked"))

    all_entries = written(entries(prints, False).unionByName(entries(queries, True)), "entries")
    many, tables = (radius + front, list(combinations(range(radius + front), front))) if front else tables_for(all_entries.count(), radius)

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = blocks_of(batch.column(0).to_pylist(), many)
            keys = []
            for number, chosen in enumerate(tables):
                key = np.full(batch.num_rows, number, np.uint64)
                for k in chosen:  # strangers whose fronts fall together are told apart by their bits
                    key = (key ^ blocks[k]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(32)
                keys.append(key.view(np.int64))
            each = pa.array(np.repeat(np.arange(batch.num_rows), len(tables)))
            yield pa.RecordBatch.from_arrays([*(c.take(each) for c in batch.columns), pa.array(np.stack(keys, 1).ravel()), pa.array(np.tile(np.arange(len(tables), dtype=np.int16), batch.num_rows))], names=["fp", "rows", "asked", "front", "number"])

    dealt = map_batches(all_entries, fronts, "fp binary, rows long, asked boolean, front long, number smallint")
    place = ["front", "number", "run"]
    crowded = dealt.where("not asked").groupBy("front").count().where(F.col("count") > tile).select("front", F.ceil(F.col("count") / tile).alias("runs"))
    runs = F.coalesce("runs", F.lit(1))
    every = F.sequence(F.lit(0).cast("long"), runs - 1)
    # A query goes to each run of its front, an entry to one.
    placed = dealt.join(crowded, "front", "left").select("fp", "rows", "asked", "front", "number", F.explode(F.when(F.col("asked"), every).otherwise(F.array(F.pmod(F.xxhash64("fp"), runs)))).alias("run"))
    together = placed.repartition(shuffle_partitions(spark), *place).sortWithinPartitions(*place)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            fps, found = rows.column(0).to_pylist(), []
            words = np.frombuffer(b"".join(fps), ">u8").reshape(-1, 2)
            weight, asked, number = (rows.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 4))
            where = np.stack([rows.column(k).to_numpy() for k in (3, 4, 5)], 1)
            cuts = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(1), True])
            has = np.add.reduceat(asked.astype(np.int64), cuts[:-1])
            for k in np.flatnonzero((has > 0) & (has < np.diff(cuts))):
                here = np.arange(cuts[k], cuts[k + 1])
                entry, ask = here[~asked[here]], here[asked[here]]
                chosen = tables[number[cuts[k]]]
                blocks, base = blocks_of(None, many, words[here]), cuts[k]
                for q in ask:
                    near = entry[np.bitwise_count(words[entry] ^ words[q]).sum(1, dtype=np.int64) <= radius]
                    if len(near):
                        same = np.stack([blocks[b][near - base] == blocks[b][q - base] for b in range(chosen[-1] + 1)])
                        near = near[same[list(chosen)].all(0) & (same.sum(0) == len(chosen))]  # no table before this one has both in one front
                    if len(near):
                        found.append((fps[q], int(weight[near].sum())))
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["fp", "near"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16384:  # all rows of a run stay together
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                where = np.stack([rows.column(k).to_numpy() for k in (3, 4, 5)], 1)
                cut = int(np.argmax((where == where[-1]).all(1)))
                if cut:
                    yield out(rows.slice(0, cut))
                held = [rows.slice(cut)]
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    found = map_batches(together, search, "fp binary, near long").groupBy("fp").agg(F.sum("near").alias("near"))
    wanted = all_entries.where("asked").select("fp")
    return wanted.join(found, "fp", "left").select(F.lower(F.hex("fp")).alias("fingerprint"), F.coalesce("near", F.lit(0)).alias("near"))


def blocks_of(fps: list[bytes] | None, many: int, words: np.ndarray | None = None) -> list[np.ndarray]:
    """The blocks of fingerprints, each as a number of at most 64 bits."""
    words = np.frombuffer(b"".join(fps), ">u8").reshape(-1, 2) if words is None else words
    high, low = words[:, 0].astype(np.uint64), words[:, 1].astype(np.uint64)
    cuts = [BITS * k // many for k in range(many + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        value = np.zeros(len(words), np.uint64)
        for word, start in ((high, 0), (low, 64)):
            x, y = max(a, start), min(b, start + 64)
            if x < y:
                part = (word >> np.uint64(start + 64 - y)) & np.uint64((1 << (y - x)) - 1)
                value = (value << np.uint64(y - x)) | part
        out.append(value)
    return out


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """prints, queries (fingerprint string) -> (query, fingerprint, distance): the pairs within the radius.

    Both are taken as sets; a fingerprint finds itself at distance 0 where it is in both. Malformed or null
    fingerprints are left out. radius + 1 blocks of whole hex digits are used, so radius is 0 to 31.
    """
    digits = BITS // 4
    if not 0 <= radius < digits:
        raise ValueError(f"radius 0 to {digits - 1}")
    sound = F.col("fingerprint").rlike(f"^[0-9a-f]{{{digits}}}$")
    cuts = [digits * k // (radius + 1) for k in range(radius + 2)]

    def tables(df: DataFrame) -> DataFrame:
        blocks = [F.concat(F.lit(f"{k}:"), F.substring("fingerprint", cuts[k] + 1, cuts[k + 1] - cuts[k])) for k in range(radius + 1)]
        return df.where(sound).select("fingerprint").distinct().select("fingerprint", F.explode(F.array(*blocks)).alias("front"))

    entries, asked = tables(prints), tables(queries)
    crowded = entries.groupBy("front").count().where(F.col("count") > tile).select("front", F.ceil(F.col("count") / tile).alias("runs"))
    runs = F.coalesce("runs", F.lit(1))
    entries = entries.join(crowded, "front", "left").select("fingerprint", "front", F.pmod(F.xxhash64("fingerprint"), runs).alias("run"))
    asked = asked.join(crowded, "front", "left").select(F.col("fingerprint").alias("query"), "front", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias("run"))
    half = lambda name, k: F.conv(F.substring(name, 16 * k + 1, 16), 16, -10).cast("long")
    apart = sum((F.bit_count(half("query", k).bitwiseXOR(half("fingerprint", k))) for k in range(2)), F.lit(0)).cast("int")
    return asked.join(entries, ["front", "run"]).select("query", "fingerprint", apart.alias("distance")).where(F.col("distance") <= radius).distinct()
