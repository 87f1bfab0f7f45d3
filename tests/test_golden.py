"""Cases with known results."""

import math
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitewright.config import BulkConfig, CallConfig, MatrixConfig, tuned
from sitewright.errors import DimensionMismatch, EmptyData, InvalidConfig, InvalidInput, ReferenceLookup, ThreadSetup
from sitewright.functions import editing as ED
from sitewright.functions import tags as T
from sitewright.functions.editing import EditingType
from sitewright.operators import editing_calls as E
from sitewright.operators import intervals as I
from sitewright.operators import legacy as L
from sitewright.operators import pileup as P
from sitewright.operators import sites as S
from sitewright.operators import sparse as X
from sitewright.operators import umi as U
from sitewright.operators.bases import base_class, explode_reads, is_standard_contig, usable_bases
from sitewright.operators.container import SiteMatrix, assemble, numbered, triplet_layers
from tests.helpers import tuples


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_tiles(spark):
    assert tuples(I.tiles(spark.createDataFrame([("c", 0, 120), ("e", 5, 5)], "contig string, start long, stop long"), 50)) == [("c", 0, 50), ("c", 50, 100), ("c", 100, 120)]
    assert tuples(I.header_tiles(spark.createDataFrame([("c", 7), ("d", 0)], "contig string, length long"), 5)) == [("c", 0, 5), ("c", 5, 7)]
    with pytest.raises(InvalidInput):
        I.tiles(spark.range(1), 0)


def covered(rows):
    return {(c, p) for c, a, b in rows for p in range(a, b)}


def test_merges_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("abc"), s, s + rng.choice((0, 1, 3, 40, 300))) for s in (rng.randint(0, 2000) for _ in range(150))]
    frame = spark.createDataFrame(rows, "contig string, start long, stop long")
    for touching in (True, False):
        expected = {}
        for c, a, b in sorted(r for r in rows if r[2] > r[1]):
            runs = expected.setdefault(c, [])
            if runs and (a <= runs[-1][1] if touching else a < runs[-1][1]):
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for size in (16, 64, 1 << 20):
            assert tuples(I.merge_overlaps(frame, touching, size)) == sorted((c, a, b) for c, runs in expected.items() for a, b in runs), (touching, size)
    assert covered(tuples(I.tiles(I.merge_overlaps(frame), 13))) == covered(rows)


def test_restrictions(spark):
    header = spark.createDataFrame([("a", 100), ("b", 50)], "contig string, length long")
    bed = spark.createDataFrame([("a", 10, 20), ("a", 15, 30)], "contig string, start long, stop long")
    vcf = spark.createDataFrame([("b", 3, 4), ("a", 10, 11)], "contig string, start long, stop long")
    count = lambda df: len(covered(tuples(df.select("contig", "start", "stop"))))
    assert [count(I.work_intervals(header, *x)) for x in ((None, None), (bed, None), (None, vcf), (bed, vcf))] == [150, 20, 2, 21]
    positions = spark.createDataFrame([("a", 9), ("a", 10), ("a", 29), ("a", 30), ("b", 10)], "contig string, pos long")
    assert tuples(I.restrict(positions, bed, 4)) == [("a", 10), ("a", 29)]
    assert I.known_contigs(bed, header) is bed
    for bad in ([("z", 1, 2)], [("a", 5, 2)]):
        with pytest.raises(InvalidInput):
            I.known_contigs(spark.createDataFrame(bad, "contig string, start long, stop long"), header)


def chunks(spark, rows, weight, hot=2):
    frame = spark.createDataFrame([("c", k, *r) for k, r in enumerate(rows)], "contig string, pos long, DEPTH long, REF_SKIP long, FAIL long, NEAR_MAX_DEPTH boolean")
    found = sorted(map(tuple, I.chunk_plan(frame, weight, hot).select("pos", "chunk").collect()))
    return [sum(1 for _, c in found if c == k) for k in range(max(c for _, c in found) + 1)]


def test_chunks(spark):
    assert chunks(spark, [(5, 0, 0, False), (3, 0, 0, False), (4, 1, 0, False), (6, 0, 1, False)], 10) == [3, 1]
    assert chunks(spark, [(10, 1, 4, False), (15, 2, 1, False), (8, 0, 2, False)], 30) == [2, 1]
    assert chunks(spark, [(1, 0, 0, False), (9, 0, 0, True), (9, 0, 0, True), (9, 0, 0, True), (0, 0, 0, False), (0, 0, 0, False)], 100) == [1, 2, 1, 2]


def test_near_max_depth(spark):
    row = lambda depth, fail, cap, raw: spark.createDataFrame([(depth, 0, fail)], "DEPTH long, REF_SKIP long, FAIL long").select(P.near_max_depth(cap, raw).alias("x")).first().x
    assert [row(d, f, c, False) for d, f, c in ((99200, 900, 100000), (100000, 0, 100000), (98500, 900, 100000), (5, 0, 0))] == [True, True, False, False]
    assert row(98500, 900, 100000, True)


def test_classes_and_pileup(spark):
    rows = [("A", 40, False, False, 255, True), ("a", 40, False, False, 255, False), ("C", 10, False, False, 255, True), ("T", None, False, False, 255, False), (None, None, True, False, 255, True), (None, None, False, True, 255, False), ("G", 40, False, False, 3, True), (None, None, True, True, 3, False), ("R", 99, False, False, 255, False)]
    bases = spark.createDataFrame([("chr1", 5, b, q, d, s, m, i) for b, q, d, s, m, i in rows], "contig string, pos long, base string, baseq int, is_del boolean, is_refskip boolean, mapq int, ins_after boolean")
    kinds = [r.k for r in bases.select(base_class(F.col("mapq") >= 255).alias("k")).collect()]
    assert kinds == ["A", "N", "N", "N", "del", "refskip", "fail", "fail", "N"]
    assert P.pileup(bases).first().asDict() == {"contig": "chr1", "pos": 5, "DEPTH": 6, "A": 1, "C": 0, "G": 0, "T": 0, "N": 4, "INS": 2, "DEL": 1, "REF_SKIP": 1, "FAIL": 2}
    assert P.pileup(bases, min_baseq=None).first().C == 1 and P.pileup(bases, passes=F.lit(True)).first().FAIL == 0


def test_cigars(spark):
    rows = [("r", 10, 255, 0, "2S3M1I2M2D1M3N2M1H", "ttACGGTAGAC", "IIIIII!IIII"), ("q", 0, 255, 16, "2M", "AC", None), ("x", 0, 255, 4, "2M", "AC", None), ("y", 0, 255, 0, None, "AC", None), ("d", 0, 255, 1024, "2M", "AC", "II")]
    reads = spark.createDataFrame(rows, "contig string, start long, mapq int, flag int, cigar string, seq string, qual string")
    out = explode_reads(reads).orderBy("contig", "pos").collect()
    r = [x for x in out if x.contig == "r"]
    assert [(x.pos, x.base, x.baseq, x.is_del, x.is_refskip, x.ins_after) for x in r] == [
        (10, "A", 40, False, False, False), (11, "C", 40, False, False, False), (12, "G", 40, False, False, True), (13, "T", 0, False, False, False), (14, "A", 40, False, False, False),
        (15, None, None, True, False, False), (16, None, None, True, False, False), (17, "G", 40, False, False, False), (18, None, None, False, True, False), (19, None, None, False, True, False), (20, None, None, False, True, False),
        (21, "A", 40, False, False, False), (22, "C", 40, False, False, False),
    ]
    assert [(x.contig, x.pos, x.baseq, x.is_reverse) for x in out if x.contig != "r"] == [("q", 0, None, True), ("q", 1, None, True)]


def test_cigars_by_brute_force(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for k in range(60):
        ops = [(rng.choice("MIDNS=XHP"), rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]
        size = sum(n for o, n in ops if o in "MIS=X")
        seq = "".join(rng.choice("ACGT") for _ in range(size))
        at, q, out = 100, 0, []
        for o, n in ops:
            for _ in range(n):
                if o in "M=X":
                    out.append([at, seq[q], False, False, False])
                elif o in "DN":
                    out.append([at, None, o == "D", o == "N", False])
                at += o in "M=XDN"
                q += o in "MIS=X"
            if o == "I" and out:
                out[-1][4] = True
        rows.append((k, "c", 100, 60, 0, "".join(f"{n}{o}" for o, n in ops), seq, None))
        expected[k] = [tuple(x) for x in out]
    reads = spark.createDataFrame(rows, "read_id long, contig string, start long, mapq int, flag int, cigar string, seq string, qual string")
    got = {k: [] for k in range(60)}
    for x in explode_reads(reads).orderBy("read_id", "pos").collect():
        got[x.read_id].append((x.pos, x.base, x.is_del, x.is_refskip, x.ins_after))
    assert got == expected


def base_rows(spark, rows):
    """(pos, cb, umi, base, reverse)"""
    return spark.createDataFrame([("chr1", p, c, u, b, r, 255, 40, False, False) for p, c, u, b, r in rows], "contig string, pos long, cb string, umi string, base string, is_reverse boolean, mapq int, baseq int, is_del boolean, is_refskip boolean")


def test_long_reads_cost_as_long_as_they_are(spark):
    """One read of 100,000 bases in few or very many operations."""
    rng = random.Random(9)
    n = 100_000
    seq = "".join(rng.choice("ACGT") for _ in range(n))
    for cigar in (f"{n}M", "4M1I" * (n // 5)):
        frame = spark.createDataFrame([("c", 5, 255, 0, cigar, seq, "I" * n, "x", "u")], "contig string, start long, mapq int, flag int, cigar string, seq string, qual string, cb string, umi string")
        began = time.time()
        found = explode_reads(frame).agg(F.count("*"), F.max("pos"), F.count_if(F.col("base") == "A"), F.count_if("ins_after")).first()
        places = [k for k in range(n) if cigar.startswith(str(n)) or k % 5 < 4]
        assert tuple(found) == (len(places), 4 + len(places), sum(seq[k] == "A" for k in places), 0 if len(places) == n else n // 5)
        assert time.time() - began < 20


def test_molecules(spark):
    rows = [(1, "X", "u1", "A", False), (1, "X", "u1", "A", False), (1, "X", "u2", "A", False), (1, "X", "u2", "G", False), (1, "X", "u2", "A", False), (1, "X", "u3", "A", False), (1, "X", "u3", "A", True), (1, "Z", "u1", "A", False), (1, "X", None, "C", False), (1, "X", "u4", "N", False)]
    cells = spark.createDataFrame([("X", 0)], "barcode string, cell_id long")
    cons = lambda stranded: U.umi_consensus(U.join_cells(usable_bases(base_rows(spark, rows)), cells), stranded)
    assert tuples(cons(True), "umi", "code") == [("u1", 0)] and tuples(cons(False), "umi", "code") == [("u1", 0), ("u3", 0)]
    pooled = L.position_counts(base_rows(spark, rows), cells, stranded=False).first()
    assert (pooled.A1, pooled.C1, pooled.G1) == (2, 1, 0)
    nothing = L.position_counts(base_rows(spark, [(1, "X", "u", "A", False), (1, "X", "u", "N", False)]), cells, stranded=False).first()
    assert nothing.A1 == 0


def test_quality_of_missing_bases(spark):
    rows = base_rows(spark, [(1, "X", "u", "A", False)]).withColumn("baseq", F.lit(None).cast("int"))
    assert usable_bases(rows).count() == 0 and usable_bases(rows, missing_baseq_passes=True).count() == 1


COUNTS = "contig string, pos long, cell_id long, A1 long, T1 long, G1 long, C1 long, A0 long, T0 long, G0 long, C0 long"


def golden_matrix(spark, parts=1):
    counts = [("chr1", 1, 0, 2, 0, 1, 0, 0, 0, 0, 0), ("chr1", 1, 1, 0, 1, 0, 0, 0, 0, 0, 2), ("chr1", 2, 0, 0, 0, 0, 0, 1, 0, 0, 0), ("chr1", 2, 1, 3, 0, 0, 0, 0, 0, 0, 0)]
    frame = spark.createDataFrame(counts[::-1] if parts > 1 else counts, COUNTS).repartition(parts)
    cells = spark.createDataFrame([("AAAC", 0), ("GGGG", 1), ("TTTT", 2)], "barcode string, cell_id long")
    return assemble(frame, spark.createDataFrame([("chr1", 1), ("chr1", 2), ("chr1", 2)], "contig string, pos long"), cells, True)


def test_assembly(spark):
    for parts in (1, 3):
        m = golden_matrix(spark, parts).validate()
        assert tuples(m.var, "site_id", "site") == [(0, "chr1:1"), (1, "chr1:2")] and tuples(m.obs, "cell_id", "barcode") == [(0, "AAAC"), (1, "GGGG")]
        assert tuples(triplet_layers(m)) == sorted([("A1", 0, 0, 2), ("A1", 1, 1, 3), ("T1", 1, 0, 1), ("G1", 0, 0, 1), ("A0", 0, 1, 1), ("C0", 1, 0, 2)])
    assert tuples(m.total_coverage()) == [(0, 4), (1, 6)] and tuples(m.row_sums("A1")) == [(0, 2), (1, 3)] and tuples(m.col_sums("C0")) == [(0, 2), (1, 0)]
    assert m.row_sums("nope") is None and m.layer("nope") is None and tuples(m.layer("T1")) == [(1, 0, 1)]
    assert m.without_empty_layers().layers == ("A1", "T1", "G1", "A0", "C0")
    assert tuples(m.with_coverage().entries, "cell_id", "site_id", "coverage") == [(0, 0, 3), (0, 1, 1), (1, 0, 3), (1, 1, 3)]
    assert m.with_cells(m.obs.where("cell_id = 1")).entries.count() == 2


def test_layers_follow_a0_alone(spark):
    m = golden_matrix(spark)
    without = SiteMatrix(m.obs, m.var, m.entries, tuple(x for x in m.layers if x != "A0"))
    assert not without.stranded and sum(r[2] for r in tuples(without.with_coverage().entries, "cell_id", "site_id", "coverage")) == 7


def test_containers(spark):
    m = SiteMatrix.empty_of_size(spark, 2, 3)
    assert tuples(m.obs, "barcode") == [("cell_0",), ("cell_1",)] and tuples(m.var, "site") == [("gene_0",), ("gene_1",), ("gene_2",)] and m.validate() is m
    stray = SiteMatrix(m.obs, m.var, spark.createDataFrame([(9, 0, 1)], "cell_id long, site_id long, A1 long"), ("A1",))
    for bad, error in ((stray, DimensionMismatch), (SiteMatrix(m.obs.where("false"), m.var, m.entries, ()), EmptyData), (SiteMatrix(m.obs.union(m.obs), m.var, m.entries, ()), DimensionMismatch), (SiteMatrix(m.obs, m.var, m.entries, ("A1",)), DimensionMismatch)):
        with pytest.raises(error):
            bad.validate()


def test_numbers_in_order(spark):
    import random

    rows = [(c, p) for c in ("b", "a", None) for p in random.Random(3).sample(range(0, 3000, 3), 80)]
    frame = spark.createDataFrame(rows, "c string, p long").repartition(7)
    expected = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for width in (1, 64, 1 << 16):
        assert [tuple(r) for r in numbered(frame, ["c", "p"], "n", width).orderBy("n").select("c", "p", "n").collect()] == [(*r, k) for k, r in enumerate(expected)]
    assert numbered(frame.where("false"), ["c", "p"], "n").count() == 0


TRIPLETS = "row long, col long, value long"


def test_sparse(spark):
    a = spark.createDataFrame([(2, 5, 1), (1, 3, 2), (2, 5, 4), (0, 0, 7), (1, 3, 5), (3, 1, 6)], TRIPLETS)
    m = X.from_triplets(a, 4, 6)
    assert tuples(m) == [(0, 0, 7), (1, 3, 7), (2, 5, 5), (3, 1, 6)]
    b = spark.createDataFrame([(0, 0, 2), (2, 5, 0), (3, 3, 1)], TRIPLETS)
    assert tuples(X.mask(m, b)) == [(0, 0, 7)] and tuples(X.add(m, b)) == [(0, 0, 9), (1, 3, 7), (2, 5, 5), (3, 1, 6), (3, 3, 1)]
    assert tuples(X.matvec(m, spark.createDataFrame([(0, 2), (5, 3)], "col long, weight long"), spark.createDataFrame([(r,) for r in range(5)], "row long"))) == [(0, 14), (1, 0), (2, 15), (3, 0), (4, 0)]
    assert tuples(X.density(m, 0, 0)) == [(0.0, 4, 0)] and tuples(X.threshold(m, 7)) == [(0, 0, 7), (1, 3, 7)]
    big = spark.createDataFrame([(0, 0, 4294967295), (0, 0, 5), (0, 1, 3)], TRIPLETS)
    assert tuples(X.from_triplets(big)) == [(0, 0, 4294967295), (0, 1, 3)] and tuples(X.row_sums(big)) == [(0, 4294967295)]
    with pytest.raises(DimensionMismatch):
        X.add(m, b, ((4, 6), (4, 7)))
    with pytest.raises(Exception, match="outside the matrix"):
        X.from_triplets(a, 3, 6).collect()


def places(spark, path, n):
    """n different places and as many again that repeat, in files; with their sums."""
    spark.range(2 * n).selectExpr(f"id % {n} AS row", f"id % {n} * 7 % 1009 AS col", f"id % {n} % 5 + 1 AS value").write.parquet(str(path))
    return spark.read.parquet(str(path)), sorted((k, k * 7 % 1009, 2 * (k % 5 + 1)) for k in range(n))


def most_in_a_task(df):
    return max(n for _, n in df.groupBy(F.spark_partition_id()).count().collect())


def test_tasks_that_sum_places_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 1 << 13, raising=False)
    most = {}
    for n in (5_000, 20_000):
        a, expected = places(spark, tmp_path / str(n), n)
        m = X.from_triplets(a)
        added = X.add(m, X.transpose(m))
        sums = Counter()
        for row, col, value in expected:
            sums[row, col] += value
            sums[col, row] += value
        assert tuples(m) == expected and tuples(added) == sorted((*k, v) for k, v in sums.items())
        most[n] = most_in_a_task(m), most_in_a_task(added)
    assert all(large < 2 * small for small, large in zip(*most.values(), strict=True)), most


def test_tasks_that_mask_do_not_grow_with_the_input(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "PIECE", 1 << 13, raising=False)
    most = {}
    for n in (5_000, 20_000):
        a, expected = places(spark, tmp_path / str(n), n)
        masked = X.mask(X.from_triplets(a), X.from_triplets(a.where("row % 3 = 0 OR value = 5")))
        # places of both sides are dealt alike, so the join moves nothing again
        assert masked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert tuples(masked) == [x for x in expected if x[0] % 3 == 0 or x[2] == 10]
        most[n] = most_in_a_task(masked)
    assert most[20_000] < 2 * most[5_000], most


def test_pieces_where_sizes_are_unknown(spark, tmp_path):
    frame = spark.createDataFrame([(1, 2, 3)], TRIPLETS)  # an RDD's rows: no size
    kept = spark.range(10).selectExpr("id AS row", "id AS col", "id AS value").cache()
    a, _ = places(spark, tmp_path / "a", 10)
    many = X.from_triplets(a).crossJoin(spark.range(3))  # the planner's estimate is a product; the files' sizes aren't
    assert [X.pieces(x) for x in (frame, kept, a.union(frame), many)] == [4] * 4
    kept.unpersist()


def test_editing_types():
    assert {EditingType.parse(x) for x in ("ag", "AG", "Ag")} == {EditingType.AG} and str(EditingType.CT) == "ct" and len(EditingType) == 6
    with pytest.raises(InvalidInput):
        EditingType.parse("invalid")
    table = {"ag": ("AT", "GC"), "ac": ("AT", "CG"), "at": ("AT", "TA"), "ca": ("CG", "AT"), "cg": ("CG", "GC"), "ct": ("CG", "TA")}
    for name, (refs, alts) in table.items():
        e = EditingType(name)
        assert e.allowed_refs == tuple(refs) and [e.alt_of(r) for r in refs] == list(alts) and e.alt_of("N") == "N"
        assert all(e.alt_of(b) == "N" and not e.is_valid_ref(b) for b in set("ACGT") - set(refs)) and e.is_valid_ref(refs[0].lower())
    assert all(ED.COMPLEMENT[ED.COMPLEMENT[b]] == b for b in "ACGT")


def small(spark, ref, **layers):
    names = tuple(layers)
    obs, var = spark.createDataFrame([("X", 0)], "barcode string, cell_id long"), spark.createDataFrame([(0, "chr1:1", "chr1", 1, ref)], "site_id long, site string, contig string, pos long, ref string")
    return SiteMatrix(obs, var, spark.createDataFrame([(0, 0, *layers.values())], f"cell_id long, site_id long, {', '.join(f'{n} long' for n in names)}"), names)


def test_split(spark):
    m = E.ref_alt_others(small(spark, "A", A1=2, A0=3, G1=4, G0=5), EditingType.AG)
    assert tuples(m.entries, "ref", "alt", "others") == [(5, 9, 0)] and m.x == "alt" and tuples(m.layer("alt")) == [(0, 0, 9)]
    assert tuples(E.ref_alt_others(small(spark, "A", A0=7), EditingType.AG).entries, "ref", "alt", "others") == [(7, 0, 0)]
    assert tuples(E.ref_alt_others(small(spark, "N", A1=1, C1=2), EditingType.AG).entries, "ref", "alt", "others") == [(0, 0, 3)]
    with pytest.raises(EmptyData):
        E.ref_alt_others(SiteMatrix(m.obs, m.var, m.entries, ("ref",)), EditingType.AG)
    with pytest.raises(EmptyData):
        E.sites_of_type(small(spark, "C", A1=1), EditingType.AG)


def test_index(spark):
    rows = spark.createDataFrame([(0, 0), (1, 3), (0, 5)], "ref long, alt long")
    nan = [r.x for r in rows.select(E.cei_column(F.col("ref"), F.col("alt")).alias("x")).collect()]
    assert math.isnan(nan[0]) and nan[1:] == [0.75, 1.0]
    assert [r.x for r in rows.select(E.cei_column(F.col("ref"), F.col("alt"), "zero").alias("x")).collect()] == [0.0, 0.75, 1.0]


def test_mismatch_classes(spark):
    cases = [("A", 90, 0, 10, 0, "AG"), ("A", 90, 1, 8, 1, "-"), ("A", 0, 0, 10, 0, "-"), ("N", 90, 0, 10, 0, "-"), ("A", 0, 0, 0, 0, "-"), ("A", 90, 5, 5, 0, "-"), ("T", 0, 99, 0, 1, "TC"), (None, 9, 9, 0, 0, "-"), ("A", 98, 1, 1, 0, "AT"), ("GT", 0, 0, 90, 9, "GC")]
    var = spark.createDataFrame([(*c[:5], sum(c[1:5]), c[5]) for c in cases], "ref string, A long, T long, G long, C long, Coverage long, expected string")
    assert all(r.Mismatch == r.expected for r in E.with_mismatch(var).collect())
    assert one(spark, T.float_limit(0.07, F.col("n")), n=100) == 7
    stats = E.site_stats(spark.createDataFrame([(0, 7, 0, 2)], "A long, T long, G long, C long"), EditingType.AG).first()
    assert (stats.AG_ref, stats.AG_alt, stats.AG_others) == (0, 0, 9)


def test_strand_specificity(spark):
    var = spark.createDataFrame([(10, 0), (0, 0), (10, 1), (3, 2)], "CoverageP long, CoverageN long")
    assert tuple(L.strand_specificity(var).first()) == (4, 2, 2, 2, 2)


def test_tags(spark):
    values = {"AAAC-1": "AAAC", "-": None, "": None, " AAAC ": "AAAC", "\tA B\n-x": "A B", "NO": "NO"}
    rows = spark.createDataFrame([(k,) for k in values], "t string").select("t", T.clean_tag(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == values
    assert [one(spark, T.decode_base(F.col("b")), b=b) for b in ("a", "T", "n", "x")] == ["A", "T", "N", "N"]
    codes = spark.createDataFrame([(b, r) for b in "ATGCN" for r in (False, True)], "b string, r boolean").select("b", "r", T.base_code(F.col("b"), F.col("r"), True).alias("s"), T.base_code(F.col("b"), F.col("r"), False).alias("u"))
    coded = codes.select("*", T.decoded_base(F.col("s"), True).alias("back"), T.decoded_strand(F.col("s"), True).alias("strand")).collect()
    assert [(r.s, r.u) for r in coded] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3), (None, None), (None, None)]
    assert all(r.back == r.b and r.strand == ("0" if r.r else "1") for r in coded if r.s is not None)
    assert one(spark, T.infer_ref(F.col("n")), n="chr1:100|a-") == "A" and one(spark, T.infer_ref(F.col("n")), n="chr1:5") is None
    assert one(spark, is_standard_contig(F.col("c")), c="CHRx") and not one(spark, is_standard_contig(F.col("c")), c="1")
    assert spark.createDataFrame([({"Ref": "A", "X": "1"},)], "m map<string,string>").select(T.lower_keys(F.col("m")).alias("x")).first().x == {"ref": "A", "x": "1"}
    assert [one(spark, T.float_to_u32(F.col("f")), f=f) for f in (2.7, -1.0, float("nan"), 1e12)] == [2, 0, 0, 4294967295]


def test_annotation(spark):
    m = golden_matrix(spark)
    notes = spark.createDataFrame([("chr1:1", {"REF": "a", "Stranded": "True", "mismatch_plus": "3"}), ("x", {"ref": "C"})], "site string, entry map<string,string>")
    with pytest.raises(ReferenceLookup):
        L.annotate_var(m, notes, 1)
    row = L.annotate_var(m, notes, 5).var.collect()
    assert [(r.site, r.filter, r.ref, r.Stranded, r.Mismatch, r.Mismatch_P, r.Mismatch_N) for r in row] == [("chr1:1", True, "A", True, False, 3, 0)]
    with pytest.raises(InvalidInput):
        L.ref_alt_matrix(m, "GA")
    with pytest.raises(InvalidInput):
        L.downsample_by_group(m.obs, "gene")
    with pytest.raises(InvalidInput):
        L.coverage_layer(SiteMatrix(m.obs, m.var, m.entries, ("A1",)))
    masks = L.one_hot(F.col("r"))
    assert one(spark, L.masked_sum({b: F.lit(k) for k, b in enumerate("ATGC")}, masks), r="G") == 2


def test_empty_results_raise(spark):
    m = golden_matrix(spark)
    with pytest.raises(EmptyData):
        S.filter_by_coverage(m, 100)
    with pytest.raises(EmptyData):
        S.filter_known(spark.createDataFrame([("chr1:1", "chr1")], "site string, contig string"), 9)


def test_settings(spark):
    assert CallConfig().validate().min_coverage == 5 and MatrixConfig().max_depth == 65536 and BulkConfig().edited_only
    for bad in (CallConfig(max_other_threshold=1.5), CallConfig(min_ref_threshold=float("nan")), CallConfig(min_coverage=0), CallConfig(cei_fill="x"), BulkConfig(editing_threshold=0), MatrixConfig(missing_umi="x")):
        with pytest.raises(InvalidConfig):
            bad.validate()
    with pytest.warns(UserWarning):
        CallConfig(chunk_size=200_000).validate()
    with pytest.raises(ThreadSetup):
        tuned(spark, 0)
    for bad in ((0, 20), (20, 0)):
        with pytest.raises(InvalidInput):
            P.edited_site(10, *bad)


def test_scripts_from_bases_to_index(spark):
    from sitewright.plans.legacy import script_call, script_matrix

    rows = [(1, "X", f"u{k}", "G" if k % 4 == 0 else "A", k % 2 == 0) for k in range(12)] + [(2, "X", f"u{k}", "C", False) for k in range(12)] + [(1, "Y", "u", "C", False)]
    cells = spark.createDataFrame([("X", 0), ("Y", 1)], "barcode string, cell_id long")
    sites = spark.createDataFrame([("chr1", 1), ("chr1", 2)], "contig string, pos long")
    m = script_matrix(base_rows(spark, rows), sites, cells, stranded=True)
    notes = spark.createDataFrame([("chr1:1", {"ref": "A"}), ("chr1:2", {"ref": "C"})], "site string, entry map<string,string>")
    called = script_call(m, notes, "AG")
    assert tuples(called.var, "site", "ref", "CoverageP", "CoverageN") == [("chr1:1", "A", 7, 6)]
    assert tuples(called.obs, "barcode", "ref", "alt", "others", "CEI") == [("X", 9, 3, 0, 0.25), ("Y", 0, 0, 1, 0.0)]


def test_contigs_and_positions(spark):
    from sitewright.operators.bases import filter_positions, standard_contigs

    header = spark.createDataFrame([(0, "chr1"), (1, "CHRM"), (2, "GL1")], "tid long, contig string")
    assert tuples(standard_contigs(header), "tid") == [(0,), (1,)] and tuples(filter_positions(header, F.col("contig") != "chr1"), "tid") == [(1,), (2,)]
