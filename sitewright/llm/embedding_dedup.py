"""Near-duplicate embeddings by cross-polytope hashing (operator 8).

A vector is turned by three rounds of random signs and fast Hadamard transforms; the nearest vertex of the
cross-polytope (the largest coordinate and its sign) is its hash. `depth` hashes make a key, several tables of keys
are kept, and each vector also goes to its next-best keys (multiprobe). Every pair that shares a key is verified by
cosine in double precision. Depth and tables follow the number of distinct vectors, so that a bucket holds a few hundred
of them; the chance to meet at cosine 0.95 stays above 0.97 in each setting (tests measure it).

Equal vectors are one vector with a multiplicity. Crowded buckets are cut into runs, and each pair of runs meets in a
task of its own. A pair that shares several keys counts at the smallest shared one only, so link counts can be summed
from the buckets; what leaves a bucket is a count per vector and a spanning forest, never the pairs.

Vectors of single precision are kept as they are, all others in double precision. Each is scaled by its largest component
before its length is taken, so that very large and very small ones neither overflow nor vanish.

Nulls: vectors that are null, empty, all zero, or hold a null, NaN or infinite component link with nothing. Vectors of
different lengths don't link. A row without a vec_id takes no part: n_links 0, component_id null, kept true. Repeated
rows count as rows of their own, so each is a link of the other. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from sitewright.llm.common import map_batches, shuffle_partitions, written
from sitewright.llm.components import components, forest

LEAST_COSINE = 0.95
TILE = 1024
BUCKET = 512
#: Tables and keys for each table, by depth.
TABLES = {1: (3, 2), 2: (5, 3), 3: (8, 4)}
ROUNDS = 3


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width, half = len(x), x.shape[1], 1
    while half < width:
        pairs = x.reshape(n, -1, 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def keys_of(x: np.ndarray, depth: int, tables: int, probes: int, seed: int = 0) -> np.ndarray:
    """n x (tables * probes) distinct-by-table keys of unit vectors; the first of each table is the vector's own."""
    n, dim = x.shape
    width = 1 << max(1, (dim - 1).bit_length())
    wide = np.zeros((n, width))
    wide[:, :dim] = x
    out = np.empty((n, tables, probes), np.int64)
    for table in range(tables):
        first, second, gaps = [], [], []
        for k in range(depth):
            turned = wide
            for signs in np.random.default_rng([seed, table, k, width]).choice([-1.0, 1.0], size=(ROUNDS, width)):
                turned = hadamard(turned * signs)
            size = np.abs(turned)
            best = np.argpartition(-size, 1, axis=1)[:, :2]
            value = np.take_along_axis(size, best, 1)
            swap = value[:, 0] < value[:, 1]
            best[swap], value[swap] = best[swap][:, ::-1], value[swap][:, ::-1]
            code = best * 2 + (np.take_along_axis(turned, best, 1) < 0)
            first.append(code[:, 0])
            second.append(code[:, 1])
            gaps.append(value[:, 0] - value[:, 1])
        scale = (2 * width) ** np.arange(depth)
        own = sum(f * s for f, s in zip(first, scale))
        order = np.argsort(np.stack(gaps, 1), axis=1)  # where the second vertex is nearly as near
        moves = np.stack([(b - a) * s for a, b, s in zip(first, second, scale)], 1)
        for probe in range(probes):
            key = own if probe == 0 else own + np.take_along_axis(moves, order[:, probe - 1 : probe], 1)[:, 0]
            out[:, table, probe] = ((key * tables + table) << 16) + min(dim, 65535)
    return out.reshape(n, -1)


def depth_for(vectors: int, dim: int) -> int:
    """So that a key of one table has about BUCKET vectors at most."""
    depth = 1
    while depth < max(TABLES) and vectors / (2 * max(2, dim)) ** depth > BUCKET:
        depth += 1
    return depth


def unit(rows: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of rows that aren't zero."""
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def unit_vectors(values: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The same from the bytes of vectors of one length."""
    return unit(np.frombuffer(b"".join(values.to_pylist()), kind).reshape(len(values), -1))


def bucket_links(tile: np.ndarray, side: np.ndarray, uid: np.ndarray, weight: np.ndarray, keys: np.ndarray, unit: np.ndarray, key: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, links, root uid) of the vectors that have links, in rows ordered by tile. side: -1 in a tile of one run, else which run."""
    links, all_i, all_j = np.zeros(len(uid), np.int64), [], []
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    for start, stop in zip(first, np.r_[first[1:], len(tile)]):
        if stop - start < 2:
            continue
        x = unit[start:stop]
        for at in range(0, len(x), 512):
            i, j = np.nonzero(x[at : at + 512] @ x.T >= least)
            i += at
            apart = (i < j) & ((side[start + i] < 0) | (side[start + i] != side[start + j]))
            i, j = i[apart] + start, j[apart] + start
            for cut in range(0, len(i), 65536):  # a pair counts at its smallest common key
                a, b = i[cut : cut + 65536], j[cut : cut + 65536]
                common = np.full(len(a), np.iinfo(np.int64).max)
                for column in range(keys.shape[1]):
                    k = keys[a, column]
                    common = np.where((keys[b] == k[:, None]).any(1), np.minimum(common, k), common)
                here = common == key[a]
                a, b = a[here], b[here]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                all_i.append(a)
                all_j.append(b)
    if not all_i:
        return (np.empty(0, np.int64),) * 3
    root = forest(len(uid), np.concatenate(all_i), np.concatenate(all_j))
    some = np.flatnonzero(links)
    return uid[some], links[some], uid[root[some]]


def near_duplicates(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", least: float = LEAST_COSINE, tile: int = TILE, depth: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    spark = vectors.sparkSession
    kind = "float" if isinstance(getattr(vectors.schema[column].dataType, "elementType", None), FloatType) else "double"
    number = np.float32 if kind == "float" else np.float64
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast(f"array<{kind}>").alias("v"))
    sound = f"vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < cast('infinity' as {kind})) and exists(v, x -> x <> 0)"
    good = F.coalesce(F.expr(sound), F.lit(False))
    grouped = rows.where(good).groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    distinct = written(grouped.select(F.monotonically_increasing_id().alias("uid"), "first_id", "copies", "v"), "vectors")
    count, dim = distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    depth = depth or depth_for(count, dim or 1)
    tables, probes = TABLES[depth]
    probes = min(probes, depth + 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, copies, v = batch.column(0), batch.column(1), batch.column(2)
            sizes = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(number)
            starts = np.r_[0, np.cumsum(sizes)]
            for width in np.unique(sizes):
                pick = np.flatnonzero(sizes == width)
                x = np.stack([flat[starts[k] : starts[k + 1]] for k in pick])
                keys = keys_of(unit(x), depth, tables, probes)
                yield pa.RecordBatch.from_arrays([uid.take(pa.array(pick)), copies.take(pa.array(pick)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["uid", "copies", "x", "keys"])

    dealt = written(map_batches(distinct.select("uid", "copies", "v"), hashed, "uid long, copies long, x binary, keys array<long>"), "keys")
    each = dealt.select("uid", "copies", "x", "keys", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = dealt.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).alias("runs"))
    runs = F.coalesce("runs", F.lit(1))
    each = each.join(crowded, "key", "left").select("uid", "copies", "x", "keys", "key", runs.alias("runs"), F.pmod(F.xxhash64("uid"), runs).alias("run"))
    tiles = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("other"))
    tiles = tiles.select("uid", "copies", "x", "keys", "key", F.least("run", "other").alias("low"), F.greatest("run", "other").alias("high"), F.when(F.col("run") == F.col("other"), F.lit(-1)).otherwise(F.col("run")).cast("long").alias("side"))
    # In the tile of runs i < j each row is there once, from either run; in the tile of i = j all rows are of one run.

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            sizes = np.array([len(b) for b in table["x"].to_pylist()])
            for width in np.unique(sizes):
                part = table.filter(pa.array(sizes == width)).combine_chunks()
                get = lambda name: part[name].to_numpy()
                places = np.stack((get("key"), get("low"), get("high")), 1)
                place_of = np.cumsum(np.r_[True, (places[1:] != places[:-1]).any(1)])
                keys = np.stack(get("keys"))
                found = bucket_links(place_of, get("side"), get("uid"), get("copies"), keys, unit_vectors(part["x"], number), get("key"), least)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["uid", "links", "root"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 4 * tile:  # all rows of a tile stay together
                table = pa.Table.from_batches(held)
                last = tuple(table[c][-1].as_py() for c in ("key", "low", "high"))
                same = np.ones(table.num_rows, bool)
                for c, value in zip(("key", "low", "high"), last):
                    same &= table[c].to_numpy() == value
                cut = int(np.argmax(same))
                if cut:
                    yield from out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    place = ["key", "low", "high"]
    together = tiles.repartition(shuffle_partitions(spark), *place).sortWithinPartitions(*place)
    found = written(map_batches(together, run, "uid long, links long, root long"), "links")
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    named = distinct.select("uid", "first_id").join(roots, F.col("uid") == F.col("node"), "left").select("uid", "first_id", F.coalesce("root", "uid").alias("root"))
    of_root = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = written(named.join(of_root, "root").join(links, "uid", "left").select("uid", F.coalesce("links", F.lit(0)).alias("links"), "component_id"), "known")
    by_vector = distinct.join(known, "uid").select("v", "copies", "links", "component_id")
    linked = rows.where(good).join(by_vector, "v").select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    alone = rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
