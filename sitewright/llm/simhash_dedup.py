"""Near-duplicates by SimHash and a Gray-order hierarchical index (operator 5).

Fingerprints of 64 bits come from 3-word shingles. Distinct fingerprints are dealt to shards by each of their four
16-bit blocks (two fingerprints that differ in at most three bits agree on one block at least), so no link is lost. Where
there are very many, more and smaller blocks are used, and shards by each choice of all but three of them.
Inside a shard the fingerprints are sorted by Gray rank; runs of neighbours share a masked bit pattern, which is kept
in their upper node only; a search walks down, adds up the differences found in the patterns on its way, and leaves a
whole group as soon as the sum exceeds the radius. A block value that very many fingerprints have is cut into runs of
`tile` rows, and each pair of runs meets in a task of its own. A shard returns a spanning forest of its links and never
the pairs themselves.

`near_copies` is the operator's general form, for near-duplicates of a given similarity (0.8 on sets of 5-word
shingles). At that similarity some ten of 64 bits differ, which no exact table of blocks can serve. Its fingerprints
have 256 bits and only find candidates: the radius is the mean distance at the similarity and three standard deviations
more, and tables of sampled bits, as many as catch 99 of 100 pairs right at the threshold (nearly all above it), deal the
fingerprints to shards; a shard's index searches the first 64 bits, and pairs are checked on all 256. Every true link that
is found lies in one component of candidates, so the sets of shingles go there once, and links are those of Jaccard
similarity, counted on the sets. Links of the exact form count besides.

Nulls: a null text is an empty text, with fingerprint zero, which links like any other. Rows with a null doc_id get a
fingerprint and take part in links; component_id is the smallest doc_id that is not null (null if there is none).
Repeated rows give repeated results. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import joined_apart, map_batches, shuffle_partitions, text_of, written
from sitewright.llm.components import components, forest

RADIUS = 3
SHINGLE = 3
TILE = 2048
SEED = 42
FANOUT = 8
VOTES_AT_A_TIME = 65536
QUERIES_AT_A_TIME = 512
SIMILARITY, COPY_SHINGLE = 0.8, 5
WORDS = 4
WIDE = ("w0", "w1", "w2", "w3")
FIRST_RADIUS = 24
MISSED = 0.01
DEVIATIONS = 3
_TEXT = "__text"
SHINGLES_OF_A_RUN = 250_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `size` words; A-Z are lowered and words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter((digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[size - 1 :])), np.uint64, len(words) - size + 1)


def simhash(text: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    hashes = shingle_hashes(text, size)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), VOTES_AT_A_TIME):
        part = hashes[at : at + VOTES_AT_A_TIME]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(t, size) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("t")), run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray order: the prefix XOR of its bits."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under nodes of FANOUT children.

    all_bits of a node are those on which everything below agrees; own_bits lack what its parent holds already.
    """

    def __init__(self, codes: np.ndarray) -> None:
        ands, ors = [codes], [codes]
        while len(ands[-1]) > 1:
            cuts = np.arange(0, len(ands[-1]), FANOUT)
            ands.append(np.bitwise_and.reduceat(ands[-1], cuts))
            ors.append(np.bitwise_or.reduceat(ors[-1], cuts))
        self.pattern = ands
        self.own_bits = []
        for level, (a, o) in enumerate(zip(ands, ors)):
            all_bits = ~(a ^ o)
            if level + 1 < len(ands):
                above = ~(ands[level + 1] ^ ors[level + 1])
                all_bits = all_bits & ~np.repeat(above, FANOUT)[: len(a)]
            self.own_bits.append(all_bits)

    def links(self, codes: np.ndarray, start: np.ndarray, stop: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of places in one shard (start <= place < stop) that differ in at most radius bits, some queries at a time."""
        query = np.flatnonzero(stop - start > 1)
        height = len(self.pattern) - 1
        for at in range(0, len(query), QUERIES_AT_A_TIME):
            q = query[at : at + QUERIES_AT_A_TIME]
            level, node, total = height, np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
            while True:
                total = total + np.bitwise_count((codes[q] ^ self.pattern[level][node]) & self.own_bits[level][node])
                span = FANOUT**level
                keep = (total <= radius) & (node * span < stop[q]) & ((node + 1) * span > np.maximum(q + 1, start[q]))
                q, node, total = q[keep], node[keep], total[keep]
                if level == 0 or not len(q):
                    break
                level -= 1
                q, total = np.repeat(q, FANOUT), np.repeat(total, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < len(self.pattern[level])
                q, node, total = q[inside], node[inside], total[inside]
            if level == 0 and len(q):
                yield q, node


def shard_forest(shard: np.ndarray, fp: np.ndarray, radius: int, words: np.ndarray | None = None, wide_radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside each shard: pairs of places. words: all words of the fingerprints, to be checked besides."""
    order = np.lexsort((gray_rank(fp), shard))
    shard, fp = shard[order], fp[order]
    words = None if words is None else words[order]
    first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    sizes = np.diff(np.r_[first, len(shard)])
    root = np.arange(len(fp))
    for i, j in GrayIndex(fp).links(fp, np.repeat(first, sizes), np.repeat(first + sizes, sizes), radius):
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if words is not None and len(i):
            near = np.bitwise_count(words[i] ^ words[j]).sum(1, dtype=np.int64) <= wide_radius
            i, j = i[near], j[near]
        if len(i):
            root = forest(len(fp), root[i], root[j])[root]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return order[moved], order[root[moved]]


def shard_links(shard: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest as pairs of fingerprints."""
    i, j = shard_forest(shard, fp, radius)
    return fp[i], fp[j]


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """The bits of each choice of blocks - radius blocks: fingerprints within the radius agree on one choice at least."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(parts, blocks - radius)]


def blocks_for(codes: int, radius: int = RADIUS) -> int:
    """As few blocks as keep shards of evenly spread fingerprints to some 512: 4 up to 3e7, 5 up to 1e10, then 6."""
    blocks = radius + 1
    while blocks < radius + 3 and codes >> (64 * (blocks - radius) // blocks) > 512:
        blocks += 1
    return blocks


def near_links(codes: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """codes(fp long, distinct) -> links (a, b) whose components are those of all pairs within the radius.

    A shard is a choice of blocks and their bits, a tile a shard or a pair of its runs. Both are named by a hash; if two
    fall together, strangers meet and are told apart by their bits.
    """
    spark = codes.sparkSession
    masks = block_masks(blocks or blocks_for(codes.count(), radius), radius)
    shards = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for k, m in enumerate(masks)]
    dealt = codes.select("fp", F.explode(F.array(*shards)).alias("shard"))
    # Written, so that its size is known when the join is planned: it goes to every task if it is small, and is shuffled otherwise.
    crowded = written(dealt.groupBy("shard").count().where(F.col("count") > tile).select("shard", F.ceil(F.col("count") / tile).alias("runs")), "crowded")
    runs = F.coalesce("runs", F.lit(1))
    dealt = dealt.join(crowded, "shard", "left").select("fp", "shard", runs.alias("runs"), F.pmod(F.xxhash64("fp"), runs).alias("run"))
    tiles = dealt.select("fp", "shard", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("other"))
    tiles = tiles.select("fp", F.xxhash64("shard", F.least("run", "other"), F.greatest("run", "other")).alias("tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out(t: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = shard_links(t, f.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            held.append((batch.column(1).to_numpy(), batch.column(0).to_numpy()))
            rows += batch.num_rows
            if rows >= 32768:  # all rows of a tile stay together
                t, f = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(t, t[-1]))
                if cut:
                    yield out(t[:cut], f[:cut])
                held, rows = [(t[cut:], f[cut:])], len(t) - cut
        if rows:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    together = tiles.repartition(shuffle_partitions(spark), "tile").sortWithinPartitions("tile")
    return map_batches(together, run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS, size: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs."""
    prints = written(fingerprints(docs, text, key, size), "fingerprints")
    codes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "codes")
    roots = written(components(near_links(codes.select("fp"), radius, tile)), "roots")
    linked = written(codes.join(roots, codes.fp == roots.node).select("fp", "root", "first_id", "rows"), "linked")
    named = joined_apart(linked, written(linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "named"), ["root"], "members")
    of_code = codes.join(named.select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "rows")
    return joined_apart(prints, written(of_code, "of_code"), ["fp"], "rows").select("doc_id", "fp", "component_id")


# --- copies of a given similarity


def wide_simhash(text: bytes, size: int = COPY_SHINGLE) -> np.ndarray:
    """256 bits, as four words, from the set of a text's shingles."""
    return wide_of(np.unique(shingle_hashes(text, size)))


def wide_of(hashes: np.ndarray) -> np.ndarray:
    votes = np.zeros((WORDS, 64), np.int64)
    for word in range(WORDS):
        for at in range(0, len(hashes), VOTES_AT_A_TIME):
            x = (hashes[at : at + VOTES_AT_A_TIME] ^ np.uint64(word)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            votes[word] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints of sets with this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_radius(similarity: float) -> int:
    """The mean distance of fingerprints at this similarity, and DEVIATIONS standard deviations more."""
    n, p = 64 * WORDS, differing(similarity)
    return min(n, round(n * p + DEVIATIONS * math.sqrt(n * p * (1 - p))))


def tables_for(codes: int, similarity: float) -> tuple[int, int]:
    """(bits of a table's key, tables): some 64 fingerprints a key, and at most MISSED of the pairs at the threshold beyond the radius or without a meeting."""
    bits = min(32, max(8, codes.bit_length() - 6))
    n, p = 64 * WORDS, differing(similarity)
    apart = [(math.comb(n, d) * p**d * (1 - p) ** (n - d), 1 - (1 - d / n) ** bits) for d in range(wide_radius(similarity) + 1)]
    beyond, tables = 1 - sum(share for share, _ in apart), 1
    while beyond + sum(share * fails**tables for share, fails in apart) > MISSED:
        tables += 1
    return bits, tables


def table_keys(words: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """n x tables: the sampled bits of each table, beside the table's number."""
    flags = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
    out = np.empty((len(words), tables), np.int64)
    for table in range(tables):
        chosen = np.random.default_rng([SEED, table]).choice(64 * WORDS, bits, replace=False)
        out[:, table] = (flags[:, chosen].astype(np.int64) << np.arange(bits)).sum(1) | table << 32
    return out


def similar_links(codes: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """codes(uid, w0..w3) -> links (a, b) of uids whose components are those of the candidate pairs that meet."""
    spark = codes.sparkSession
    bits, tables = tables_for(codes.count(), similarity)
    radius = wide_radius(similarity)
    words_of = lambda batch, at: np.stack([batch.column(at + k).to_numpy() for k in range(WORDS)], 1).view(np.uint64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = table_keys(np.ascontiguousarray(words_of(batch, 1)), bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["uid", *WIDE, "keys"])

    kinds = "uid long, w0 long, w1 long, w2 long, w3 long"
    each = map_batches(codes.select("uid", *WIDE), keyed, f"{kinds}, keys array<long>").select("uid", *WIDE, F.explode("keys").alias("key"))
    crowded = written(each.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).alias("runs")), "crowded")
    runs = F.coalesce("runs", F.lit(1))
    each = each.join(crowded, "key", "left").select("uid", *WIDE, "key", runs.alias("runs"), F.pmod(F.xxhash64("uid"), runs).alias("run"))
    tiles = each.select("uid", *WIDE, "key", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("other"))
    place = ["key", "low", "high"]
    tiles = tiles.select("uid", *WIDE, "key", F.least("run", "other").alias("low"), F.greatest("run", "other").alias("high"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            where = np.stack([rows.column(k).to_numpy() for k in range(5, 8)], 1)
            shard = np.cumsum(np.r_[True, (where[1:] != where[:-1]).any(1)])
            words = np.ascontiguousarray(words_of(rows, 1))
            i, j = shard_forest(shard, words[:, 0], FIRST_RADIUS, words, radius)
            uid = rows.column(0).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(uid[j])], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 16384:  # all rows of a tile stay together
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                where = np.stack([rows.column(k).to_numpy() for k in range(5, 8)], 1)
                cut = int(np.argmax((where == where[-1]).all(1)))
                if cut:
                    yield out(rows.slice(0, cut))
                held = [rows.slice(cut)]
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    together = tiles.repartition(shuffle_partitions(spark), *place).sortWithinPartitions(*place)
    return map_batches(together, run, "a long, b long")


def set_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of sets whose Jaccard similarity is at least this: pairs of places."""
    sizes = np.array([len(x) for x in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    holders, tokens = owner[order], tokens[order]
    new = np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(tokens)])
    token = np.empty(len(tokens), np.int64)
    token[order] = np.cumsum(new) - 1
    ends = np.cumsum(sizes)
    root = np.arange(len(sets))
    for k in range(len(sets)):
        if (root == root[0]).all():
            break
        mine = token[ends[k] - sizes[k] : ends[k]]
        many = count[mine]
        at = np.arange(many.sum()) + np.repeat(first[mine] - np.cumsum(many) + many, many)
        shared = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero((shared / np.maximum(sizes[k] + sizes - shared, 1) >= similarity) & (root != root[k]))
        if len(near):
            root[np.isin(root, root[near])] = root[k]
    moved = np.flatnonzero(root != np.arange(len(sets)))
    return moved, root[moved]


def verified_links(candidates: DataFrame, shingles: DataFrame, similarity: float = SIMILARITY, most: int = SHINGLES_OF_A_RUN) -> DataFrame:
    """candidates(node, root, n), shingles(uid, shingles) -> links (a, b) whose components are those of all similar pairs of each root.

    A root with many shingles is cut into runs, and each pair of runs meets in a task of its own.
    """
    spark = candidates.sparkSession
    crowded = written(candidates.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("root", F.ceil(F.col("n") / most).alias("runs")), "crowded")
    runs = F.coalesce("runs", F.lit(1))
    dealt = candidates.join(crowded, "root", "left").select("node", "root", runs.alias("runs"), F.pmod(F.xxhash64("node"), runs).alias("run"))
    tiles = dealt.select("node", "root", "run", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("other"))
    tiles = tiles.select(F.col("node").alias("uid"), F.xxhash64("root", F.least("run", "other"), F.greatest("run", "other")).alias("tile"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, uids, sets, links = None, [], [], []

        def close() -> None:
            if len(sets) > 1:
                i, j = set_links(sets, similarity)
                uid = np.array(uids)
                links.append((uid[i], uid[j]))
            uids.clear()
            sets.clear()

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*links))
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            hashes = batch.column(2)
            values, ends = hashes.values.to_numpy(), hashes.offsets.to_numpy()
            for k, (t, uid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if t != tile:
                    close()
                    tile = t
                uids.append(uid)
                sets.append(values[ends[k] : ends[k + 1]])
            if links:
                yield out()
        close()
        if links:
            yield out()

    together = tiles.join(shingles, "uid").select("tile", "uid", "shingles").repartition(shuffle_partitions(spark), "tile").sortWithinPartitions("tile")
    return map_batches(together, run, "a long, b long")


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, component_id) for each row: components of links of either form."""
    return rows_of_copies(docs, text, key, similarity, tile).select("doc_id", "component_id")


def rows_of_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(doc_id, text_hash, root, component_id) for each row: root names the component even where doc_ids repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            narrow = np.array([simhash(t) for t in texts], np.uint64).view(np.int64)
            sets = [np.unique(shingle_hashes(t, COPY_SHINGLE)) for t in texts]
            wide = np.array([wide_of(x) for x in sets], np.uint64).reshape(-1, WORDS).view(np.int64)
            digest = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            sets = [np.unique(x.astype(np.uint32)) for x in sets]
            sizes = np.array([len(x) for x in sets], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.uint32)]).view(np.int32)))
            columns = [batch.column(0), batch.column(2), pa.array(narrow), pa.array(digest), pa.array(sizes), *(pa.array(wide[:, k]) for k in range(WORDS)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp", "digest", "n", *WIDE, "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("t"), F.xxhash64(text_of(text)).alias("text_hash"))
    kinds = "doc_id long, text_hash long, fp long, digest long, n long, w0 long, w1 long, w2 long, w3 long, shingles array<int>"
    prints = written(map_batches(rows, run, kinds).withColumn("row", F.monotonically_increasing_id()), "prints")
    of_text = [F.min(c).alias(c) for c in ("n", *WIDE)]
    codes = written(prints.groupBy("fp", "digest").agg(F.min("doc_id").alias("first_id"), F.min("row").alias("uid"), F.count("*").alias("rows"), *of_text), "codes")
    exact = written(components(near_links(codes.select("fp").distinct(), RADIUS, tile)), "exact")
    grouped = written(codes.join(exact, codes.fp == exact.node, "left").select("uid", F.coalesce("root", "fp").alias("g")), "grouped")
    of_group = written(grouped.groupBy("g").agg(F.min("uid").alias("b"), F.count("*").alias("n")).where("n > 1"), "of_group")
    of_print = joined_apart(grouped, of_group, ["g"], "n").select(F.col("uid").alias("a"), "b")
    # Texts with one set of shingles are one entry of the similarity search.
    sets = written(codes.groupBy("digest").agg(F.min("uid").alias("uid"), *of_text), "sets")
    of_set = codes.join(sets.select("digest", F.col("uid").alias("b")), "digest").select(F.col("uid").alias("a"), "b")
    near = components(similar_links(sets, similarity, tile))
    candidates = written(near.join(sets, near.node == sets.uid).select("node", "root", "n"), "candidates")
    similar = verified_links(candidates, prints.select(F.col("row").alias("uid"), "shingles"), similarity)
    roots = written(components(of_print.unionByName(of_set).unionByName(similar)), "roots")
    named = written(codes.join(roots, codes.uid == roots.node, "left").select("fp", "digest", "first_id", "rows", F.coalesce("root", "uid").alias("root")), "named")
    of_root = written(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")), "of_root")
    known = written(joined_apart(named, of_root, ["root"], "members").select("fp", "digest", "root", "component_id", "rows"), "known")
    return joined_apart(prints.select("fp", "digest", "doc_id", "text_hash"), known, ["fp", "digest"], "rows").select("doc_id", "text_hash", "root", "component_id")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest doc_id stays, once.

    Rows are told apart by doc_id and text, so a doc_id that repeats with different texts stays once for each component in
    which it is the smallest. Rows without a doc_id can't be told apart from here and stay.
    """
    found = rows_of_copies(docs, similarity=similarity).where("doc_id = component_id").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = found.groupBy("root", "doc_id").agg(F.min(F.struct("text_hash", "rows")).alias("x"))
    ids = written(first.select("doc_id", F.col("x.text_hash").alias(_TEXT), "x.rows"), "kept")
    place = ["doc_id", _TEXT]
    # Texts are dealt by doc_id and text at every size: the ids that stay are most of the table, so sending them everywhere has no bound.
    kept = docs.withColumn(_TEXT, F.xxhash64(text_of("text"))).join(ids.select(place).hint("shuffle_hash"), place, "left_semi")
    twice = ids.where("rows > 1").select(place)
    if not twice.isEmpty():
        again = kept.join(twice, place, "left_semi").groupBy(place).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("x")).select("x.*")
        kept = kept.join(twice, place, "left_anti").select(docs.columns).unionByName(again)
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))
