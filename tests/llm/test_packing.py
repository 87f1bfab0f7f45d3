import random
from collections import defaultdict

from pyspark.sql import functions as F

from sitewright.llm import packing, queries
from sitewright.llm.simhash_dedup import near_duplicates
from tests.llm.fixtures import docs, words


def naive(lengths, sources, clusters, capacity):
    bins, out = [], [None] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        fits = [b for b, (left, s, c) in enumerate(bins) if left >= lengths[k] and sources[k] not in s and clusters[k] not in c]
        best = min(fits, key=lambda b: bins[b][0], default=None)
        if best is None:
            bins.append([capacity, set(), set()])
            best = len(bins) - 1
        out[k] = (best, bins[best][0])
        bins[best][0] -= lengths[k]
        bins[best][1].add(sources[k])
        bins[best][2].add(clusters[k])
    return out


def test_each_step_takes_the_tightest_compatible_bin():
    """Replays the packing: whichever of several equal bins it took, none that was tighter would have done."""
    rng = random.Random(2)
    for _ in range(200):
        capacity, n = rng.choice((1, 16, 50, 128)), rng.randint(0, 80)
        lengths = [rng.randint(1, capacity) for _ in range(n)]
        sources = [rng.choice([*"aaabcdefghij", None]) for _ in range(n)]
        clusters = [rng.choice([1, 1, 2, *range(3, 100)]) for _ in range(n)]
        got = packing.pack(lengths, sources, clusters, capacity)
        bins = {}
        for k in sorted(range(n), key=lambda k: -lengths[k]):
            fits = [left for left, s, c in bins.values() if left >= lengths[k] and sources[k] not in s and clusters[k] not in c]
            number, offset = got[k]
            left, s, c = bins.get(number, (capacity, set(), set()))
            assert capacity - offset == left == min(fits, default=capacity) and (number in bins) == bool(fits)
            bins[number] = (left - lengths[k], s | {sources[k]}, c | {clusters[k]})
        if len(set(zip(sources, clusters))) == 1 or n < 3:
            assert len(bins) == len({b for b, _ in naive(lengths, sources, clusters, capacity)})


def test_table(spark):
    frame = docs(spark, clash=True)
    rows = packing.packed(frame, capacity=300).collect()
    sizes = defaultdict(list)
    for d in docs(spark).collect():
        sizes[d.doc_id].append(len((d.text or "").encode()))
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r.doc_id] += r.part_units
        if r.bin is not None:
            bins[r.bin_shard, r.bin].append(r)
    assert dict(got) == {d: sum(x) for d, x in sizes.items()}
    assert {r.doc_id for r in rows if r.bin is None} == {d for d, x in sizes.items() if not sum(x)}
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.part_units
        assert at <= 300
    copies = {r.doc_id: (r.bin_shard, r.bin) for r in rows if r.doc_id in (14, 15)}
    assert copies[14] != copies[15]


def test_hot_source_and_shards(spark):
    rows = [(k, "hot copy" if k % 3 == 0 else f"text number {k} " * (k % 9 + 1)) for k in range(900)]
    frame = docs(spark, rows)
    packed = packing.packed(frame, capacity=256, shard=100).collect()
    assert len({r.bin_shard for r in packed}) == 9 and len(packed) == 900
    hot = [(r.bin_shard, r.bin) for r in packed if r.doc_id % 3 == 0]
    assert len(hot) == len(set(hot))


def test_query_keeps_conflicts_apart(spark, tmp_path):
    """No bin of the whole table holds two rows of one source, or two of one component of near-duplicates."""
    base = [words(k, 120) for k in range(30)]
    rows = [(k, base[k % 30] + (f" extra{k}" if k % 4 == 1 else "")) for k in range(240)] + [(500, None), (501, ""), (None, "no id"), (7, base[7])]
    frame = docs(spark, rows).withColumn("source", F.expr("case when doc_id % 3 = 0 then 'hot' when doc_id % 7 <> 1 then concat('s', doc_id) end"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.queries()["op4_best_fit_packing"](spark, str(tmp_path)).collect()
    source = {r.doc_id: r.source for r in frame.collect()}
    component = {r.doc_id: r.component_id for r in near_duplicates(docs(spark, [r for r in rows if r[0] is not None])).collect()}
    assert any(component[d] != d for d, t in rows if d is not None and "extra" in (t or ""))
    bins = defaultdict(list)
    for r in found:
        if r.bin is not None:
            bins[r.bin_shard, r.bin].append(r.doc_id)
    for members in bins.values():
        assert len({source[d] for d in members}) == len(members)
        clusters = [component[d] for d in members if d is not None]
        assert len(set(clusters)) == len(clusters)
    assert sum(r.part_units for r in found) == sum(len((t or "").encode()) for _, t in rows) and any(len(m) > 3 for m in bins.values())


def test_bins_of_shards_against_one_shard(spark):
    """Cutting the table into shards costs few bins."""
    frame = docs(spark, [(k, words(k, random.Random(k).randint(1, 400))) for k in range(1200)]).withColumn("source", F.expr("concat('s', doc_id % 200)"))
    many = lambda shard: packing.packed(frame, shard=shard).select("bin_shard", "bin").where("bin is not null").distinct().count()
    one, four = many(10**6), many(300)
    assert one <= four <= one * 1.05 + 4


def test_empty(spark):
    assert packing.packed(docs(spark).where("false")).count() == 0
