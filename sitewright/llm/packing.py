"""Best-fit packing of documents into training sequences under conflicts (operator 4).

A sequence (bin) of `capacity` units never holds two documents of one source or two of one duplicate cluster: copies of
one text or, with the clusters of `near_clusters`, near copies too. Documents
longer than a bin are cut: full pieces are bins of their own, and the rest is packed like any other document.

Bins are kept in the order of what is left in them. Each bin carries a bitmap of its sources and one of its duplicate
clusters; nodes of a tree over the residuals carry the AND of the bitmaps below, so the search for the tightest
compatible bin walks on from successor to successor but passes over whole ranges in which every bin conflicts. The
longest documents go first (best-fit decreasing).

Documents are dealt to shards of about `shard` rows by a hash, so a source or a cluster that holds a third of all rows
is spread over every shard, and each shard is packed by a task of its own, within bounded memory. Each shard leaves a few
bins that more rows could have filled. No text is shuffled: a shard gets numbers, lengths, sources and text hashes.

Nulls: a null text has no units. A document without units gets one row with no bin. A null source is a source of its own.
Rows without a doc_id are packed like others. Repeated rows are copies of each other and go to different bins. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import joined_apart, map_batches, shuffle_partitions, text_of, written
from sitewright.llm.simhash_dedup import near_duplicates

CAPACITY = 8192
SHARD = 16384


class Residuals:
    """Open bins by what is left in them, under a tree of conjunctions of their bitmaps.

    bins[r] holds, for each pair of bitmaps, the numbers of the bins with r units left.
    """

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity.bit_length())
        self.bins: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(self.size)]
        self.all: list[tuple[int, int] | None] = [None] * (2 * self.size)

    def _update(self, left: int) -> None:
        node, keys = self.size + left, self.bins[left]
        value = None
        for s, c in keys:
            value = (s, c) if value is None else (value[0] & s, value[1] & c)
        while True:
            if self.all[node] == value:
                return
            self.all[node] = value
            if node == 1:
                return
            other = self.all[node ^ 1]
            value = other if value is None else value if other is None else (value[0] & other[0], value[1] & other[1])
            node >>= 1

    def add(self, left: int, source: int, cluster: int, number: int) -> None:
        self.bins[left].setdefault((source, cluster), []).append(number)
        self._update(left)

    def take(self, need: int, source: int, cluster: int) -> tuple[int, int, int, int] | None:
        """Remove and return (left, sources, clusters, number) of the tightest bin that fits and doesn't conflict."""
        node = self.size + need
        while True:
            if self._open(node, source, cluster):
                if node < self.size:
                    node *= 2
                    continue
                left = node - self.size
                for (s, c), numbers in self.bins[left].items():  # at least one may fit: no bit is set in all of them
                    if not s & source and not c & cluster:
                        number = numbers.pop()
                        if not numbers:
                            del self.bins[left][s, c]
                        self._update(left)
                        return left, s, c, number
            while node & 1:  # on to the successor: the next subtree to the right
                node >>= 1
            if not node:
                return None
            node += 1

    def _open(self, node: int, source: int, cluster: int) -> bool:
        both = self.all[node]
        return both is not None and not both[0] & source and not both[1] & cluster


def pack(lengths: list[int], sources: list[str | None], clusters: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, offset) of each item of 1 to `capacity` units; the longest first, in the given order where equal."""
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    copies = Counter(clusters)
    cluster_bit = {c: 1 << k for k, c in enumerate(c for c, n in copies.items() if n > 1)}  # a text without copies can't conflict
    residuals, out, bins = Residuals(capacity), [(0, 0)] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need, s, c = lengths[k], source_bit[sources[k]], cluster_bit.get(clusters[k], 0)
        found = residuals.take(need, s, c)
        if found is None:
            found = (capacity, 0, 0, bins)
            bins += 1
        left, in_sources, in_clusters, number = found
        out[k] = (number, capacity - left)
        if left > need:
            residuals.add(left - need, in_sources | s, in_clusters | c, number)
    return out


def near_clusters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cluster, component, copies): for each text's hash the component of near-duplicates that it lies in, and how many rows have it."""
    hashed = docs.select(F.xxhash64(text_of(text)).alias("text_hash"), F.col(text).alias("whole"))
    found = near_duplicates(hashed, "whole", "text_hash")
    return written(found.groupBy(F.col("doc_id").alias("cluster")).agg(F.min("component_id").alias("component"), F.count("*").alias("copies")), "clusters")


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", units: Column | None = None, capacity: int = CAPACITY, shard: int = SHARD, clusters: DataFrame | None = None) -> DataFrame:
    """One row for each piece: (doc_id, part, part_start, part_units, bin_shard, bin, bin_offset).

    units: what a document takes; UTF-8 bytes by default, as a byte-level model reads them. (bin_shard, bin) is a sequence.
    clusters: those of `near_clusters`; without them only equal texts are one cluster.
    """
    units = F.octet_length(text_of(text)) if units is None else units
    items = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(units, F.lit(0)).cast("long").alias("units"), F.col(source).cast("string").alias("source"), F.xxhash64(text_of(text)).alias("cluster"))
    items = written(items.withColumn("row", F.monotonically_increasing_id()), "items")
    if clusters is not None:
        items = joined_apart(items, clusters, ["cluster"], "copies").select("doc_id", "units", "source", F.col("component").alias("cluster"), "row")
    shards = max(1, -(-items.count() // shard))
    dealt = items.withColumn("bin_shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column(5).to_numpy()
            cuts = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1), len(number)]
            for a, b in zip(cuts, cuts[1:]):
                piece = batch.slice(a, b - a)
                if held and held[0].column(5)[0].as_py() != number[a]:
                    yield _packed_shard(pa.Table.from_batches(held), capacity)
                    held = []
                held.append(piece)
        if held:
            yield _packed_shard(pa.Table.from_batches(held), capacity)

    together = dealt.repartition(min(shards, max(shuffle_partitions(docs.sparkSession), 1)), "bin_shard").sortWithinPartitions("bin_shard", "doc_id", "row")
    return map_batches(together.select("doc_id", "units", "source", "cluster", "row", "bin_shard"), run, "doc_id long, part int, part_start long, part_units long, bin_shard long, bin long, bin_offset long")


def _packed_shard(rows: pa.Table, capacity: int) -> pa.RecordBatch:
    ids, units, sources, clusters, _, shard = (c.to_pylist() for c in rows.columns)
    rest = [k for k in range(len(ids)) if units[k] % capacity]
    places = pack([units[k] % capacity for k in rest], [sources[k] for k in rest], [clusters[k] for k in rest], capacity)
    after = dict(zip(rest, places))
    full = max((b for b, _ in places), default=-1) + 1  # whole bins are numbered after the shared ones
    out: list[tuple] = []
    for k, doc in enumerate(ids):
        for part in range(units[k] // capacity):
            out.append((doc, part, part * capacity, capacity, shard[k], full, 0))
            full += 1
        if k in after:
            part = units[k] // capacity
            out.append((doc, part, part * capacity, units[k] % capacity, shard[k], *after[k]))
        elif not units[k]:
            out.append((doc, 0, 0, 0, shard[k], None, None))
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "part", "part_start", "part_units", "bin_shard", "bin", "bin_offset"])
