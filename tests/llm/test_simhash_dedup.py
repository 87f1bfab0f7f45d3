import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sitewright.llm import queries, simhash_dedup
from sitewright.llm.components import components, forest
from tests.llm.fixtures import as_rows, docs, words


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(found[k : k + 3]) for k in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Smallest id by id, of links of at most 3 bits, all pairs."""
    parent = {k: k for k in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in prints}


def test_gray_order_and_index():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**63, 500, dtype=np.uint64)
    rank = simhash_dedup.gray_rank(codes)
    assert all(int(r) ^ (int(r) >> 1) == int(c) for r, c in zip(rank, codes))
    near = np.concatenate([codes, codes[:200] ^ (np.uint64(1) << rng.integers(0, 63, 200, dtype=np.uint64)), codes[:100] ^ np.uint64(0b1011), codes[:100] ^ np.uint64(0b11011)])
    near = np.unique(near)
    order = np.argsort(simhash_dedup.gray_rank(near))
    near = near[order]
    n = len(near)
    i, j = (np.concatenate(x) for x in zip(*simhash_dedup.GrayIndex(near).links(near, np.zeros(n, int), np.full(n, n), 3)))
    brute = {(a, b) for a in range(n) for b in range(a + 1, n) if int(near[a] ^ near[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == brute


def test_index_keeps_to_shards():
    codes = np.array([0, 1, 0, 1, 3], np.uint64)
    a, b = simhash_dedup.shard_links(np.array([1, 1, 2, 3, 3]), codes, 3)
    assert sorted(zip(a.tolist(), b.tolist())) in ([(0, 1), (1, 3)], [(0, 1), (3, 1)], [(1, 0), (1, 3)], [(1, 0), (3, 1)])


def test_links_whatever_the_tile(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {k: centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for k in range(150)} | {k: rng.getrandbits(64) for k in range(150, 250)}
    codes = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in set(prints.values())], "fp long")
    expected = {}
    for k, root in classes(dict(enumerate(sorted(set(prints.values()))))).items():
        expected.setdefault(root, set()).add(sorted(set(prints.values()))[k])
    groups = sorted(sorted(g) for g in expected.values() if len(g) > 1)
    for tile, blocks in ((8, None), (64, 5), (2048, 4), (2048, 6)):
        found = {}
        for r in components(simhash_dedup.near_links(codes, tile=tile, blocks=blocks)).collect():
            found.setdefault(r.root, set()).add(r.node % 2**64)
        assert sorted(sorted(g) for g in found.values()) == groups


def test_blocks():
    assert [simhash_dedup.blocks_for(n) for n in (0, 10**6, 10**8, 10**11)] == [4, 4, 5, 6]
    assert [len(simhash_dedup.block_masks(b)) for b in (4, 5, 6)] == [4, 10, 20]
    rng = random.Random(9)
    for blocks in (4, 5, 6):
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << k for k in rng.sample(range(64), 3))
            assert any(a & m == b & m for m in simhash_dedup.block_masks(blocks))


def test_components_on_chains_and_hubs(spark):
    chain = [(k, k + 1) for k in range(200)]
    hub = [(1000, k) for k in range(1001, 1400)]
    rows = chain + hub + [(5, 5), (7, 6), (None, 3)]
    found = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert forest(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]


def test_table_by_brute_force(spark, tmp_path):
    frame = docs(spark, clash=True)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.queries()["op5_simhash_near_dedup"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in docs(spark).collect() if r.doc_id is not None}
    prints = {d: plain_print(t) for d, t in texts.items()}
    expected = classes(prints)
    assert len(rows) == frame.count()
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == expected[r.doc_id] for r in rows if r.doc_id is not None)


def copy_classes(texts):
    """Smallest id by id, of all pairs: at most 3 bits apart, or 256-bit fingerprints as near as similarity 0.8 has them."""
    prints = {d: plain_print(t) for d, t in texts.items()}
    wide = {d: simhash_dedup.wide_simhash((t or "").encode()) for d, t in texts.items()}
    radius = round(256 * simhash_dedup.differing(0.8))
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or int(np.bitwise_count(wide[a] ^ wide[b]).sum()) <= radius):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in texts}


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join("zz" if rng.random() < share else w for w in text.split())


def test_similar_copies(spark):
    """Nearly all copies of similarity 0.8 and more are found, whatever the tile; strangers stay apart."""
    rows = [(k, words(1000 + k, 300)) for k in range(60)]
    rows += [(100 + k, edited(rows[k][1], share, k)) for k, share in enumerate([0.003, 0.01, 0.015] * 20)]
    shingles = {d: {" ".join(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}
    jaccard = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for tile in (16, 2048):
        found = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs(spark, rows), tile=tile).collect()}
        similar = [k for k in range(60) if jaccard(k, 100 + k) >= 0.85]
        assert len(similar) > 40 and sum(found[100 + k] == k for k in similar) >= 0.9 * len(similar)
        assert all(found[k] == k for k in range(60))
        assert all(found[d] in (d, d - 100) for d in found if d >= 100)


def shingle_sets(rows):
    return {d: {" ".join(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for d, t in rows}


def test_similarity_is_checked_on_shingles(spark):
    """Pairs on both sides of 0.8, each with no other copy: just those of 0.8 and more (and of the exact form) are linked, but for a rare one that meets nowhere."""
    rows = [(k, words(5000 + k, 300)) for k in range(200)]
    rows += [(1000 + k, edited(t, 0.01 + 0.02 * k / 200, k)) for k, t in rows]
    sets = shingle_sets(rows)
    near = {k for k in range(200) if len(sets[k] & sets[1000 + k]) >= 0.8 * len(sets[k] | sets[1000 + k])}
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs(spark, rows)).collect()}
    linked = {k for k in range(200) if found[1000 + k] == k}
    exact = {k for k in range(200) if (plain_print(rows[k][1]) ^ plain_print(rows[200 + k][1])).bit_count() <= 3}
    assert 50 < len(near) < 150 and linked <= near | exact and len(near - linked) <= 0.03 * len(near)


def test_set_links_whatever_the_runs(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**62), 2**62, 60)
    sets = {k: np.unique(np.r_[rng.permutation(base)[: 60 - k % 9], rng.integers(-(2**62), 2**62, k % 7)]) for k in range(60)} | {60: np.empty(0, np.int64)}
    parent = np.arange(61)
    for a in sets:
        for b in range(a):
            if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) > 0:
                parent[parent == parent[a]] = parent[b]
    shingles = spark.createDataFrame([(k, x.tolist()) for k, x in sets.items()], "uid long, shingles array<long>")
    candidates = spark.createDataFrame([(k, 0, len(x)) for k, x in sets.items()], "node long, root long, n long")
    for most in (10**6, 400):
        found = {r.node: r.root for r in components(simhash_dedup.verified_links(candidates, shingles, 0.8, most)).collect()}
        label = [found.get(k, k) for k in range(61)]
        assert all((label[a] == label[b]) == (parent[a] == parent[b]) for a in range(61) for b in range(a))


def test_wide_fingerprints_measure_similarity():
    bits, tables = simhash_dedup.tables_for(10**6, 0.8)
    assert bits == 14 and 1 - (1 - (1 - simhash_dedup.differing(0.8)) ** bits) ** tables >= 0.95
    for seed, share in enumerate((0.0, 0.01, 0.02, 0.04)):
        text = words(seed, 3000)
        other = edited(text, share, seed)
        a, b = ({" ".join(t.lower().split()[k : k + 5]) for k in range(len(t.split()) - 4)} for t in (text, other))
        expected = simhash_dedup.differing(len(a & b) / len(a | b))
        measured = int(np.bitwise_count(simhash_dedup.wide_simhash(text.encode()) ^ simhash_dedup.wide_simhash(other.encode())).sum()) / 256
        assert abs(measured - expected) < 0.08


def test_one_of_each(spark):
    frame = docs(spark)
    kept = simhash_dedup.one_of_each(frame)
    expected = copy_classes({r.doc_id: r.text for r in frame.collect() if r.doc_id is not None})
    assert as_rows(kept, "doc_id") == sorted([(d,) for d in set(expected.values())] + [(None,)], key=repr)
    assert kept.columns == frame.columns
    assert simhash_dedup.one_of_each(frame.where("false")).count() == 0


def test_one_of_each_where_a_doc_id_repeats(spark):
    a, b, c = (words(9000 + k, 80) for k in range(3))
    rows = [(1, a), (5, a), (5, b), (6, b), (7, b), (7, c), (7, c + " more"), (7, c), (8, c)]
    kept = as_rows(simhash_dedup.one_of_each(docs(spark, rows)), "doc_id", "text")
    assert kept in (sorted([(1, a), (5, b), (7, x)], key=repr) for x in (c, c + " more"))
    same = [(3, a), (3, b), (3, None), (3, ""), (3, b)]
    assert len(as_rows(simhash_dedup.one_of_each(docs(spark, same)), "doc_id", "text")) == 3


def test_one_of_equal_rows_is_always_the_same(spark):
    frame = docs(spark, [(1, "a b c"), (1, "a b c")]).withColumn("source", F.expr("concat('s', monotonically_increasing_id())"))
    assert as_rows(frame.sort("source").transform(simhash_dedup.one_of_each)) == as_rows(frame.sort(F.desc("source")).transform(simhash_dedup.one_of_each))


def test_recall_right_at_the_threshold(spark):
    """Of pairs with a similarity from 0.80 to 0.85 on their 5-word shingles, 0.95 or more are linked, and none below 0.8."""
    rows = [(k, words(20000 + k, 250)) for k in range(500)]
    rows += [(1000 + k, edited(t, 0.018 + 0.006 * (k % 5) / 5, k)) for k, t in rows]
    sets = shingle_sets(rows)
    similarity = {k: len(sets[k] & sets[1000 + k]) / len(sets[k] | sets[1000 + k]) for k in range(500)}
    found = {r.doc_id: r.component_id for r in simhash_dedup.near_copies(docs(spark, rows)).collect()}
    exact = {k for k in range(500) if (plain_print(rows[k][1]) ^ plain_print(rows[500 + k][1])).bit_count() <= 3}
    close = [k for k, x in similarity.items() if 0.8 <= x < 0.85]
    assert len(close) >= 100 and sum(found[1000 + k] == k for k in close) >= 0.95 * len(close)
    assert not any(found[1000 + k] == k for k, x in similarity.items() if x < 0.8 and k not in exact)


def test_long_texts_in_parts(monkeypatch):
    text = words(4, 500).encode()
    whole = simhash_dedup.simhash(text)
    monkeypatch.setattr(simhash_dedup, "VOTES_AT_A_TIME", 7)
    assert simhash_dedup.simhash(text) == whole == plain_print(text.decode())
