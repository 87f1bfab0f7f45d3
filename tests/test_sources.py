"""Files in and out, and the commands from files to files."""

import gzip
import io
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from sitewright import cli
from sitewright.config import CallConfig, validate_output
from sitewright.errors import EmptyData, InvalidConfig, InvalidInput, MissingFile, ParseFailure, UnsupportedFormat
from sitewright.sources import bam, fasta, matrices, tables
from tests.bam_writer import block, write_bam
from tests.helpers import tuples


def file(tmp_path, name, text):
    path = tmp_path / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text[: len(text) // 2].encode()) + gzip.compress(text[len(text) // 2 :].encode()))  # two members
    else:
        path.write_text(text)
    return str(path)


HEADER = "CHR\tPOS\tDEPTH\tA\tINS\tDEL\tREF_SKIP\tFAIL\tNEAR_MAX_DEPTH\n"


@pytest.mark.parametrize("name", ["m.tsv", "m.tsv.gz"])
def test_manifest(spark, tmp_path, name):
    text = HEADER + "chr2\t5\t9\t1\t0\t0\t1\t2\tfalse\n#note\n\nchr10\t7\t9\t1\t0\t0\t1\t2\tTRUE\nchr10\t3\t9\t1\t0\t0\t1\t2\t\nchr1\tx\t9\t1\t0\t0\t1\t2\ttrue\nchr1\t1.5\t9\t1\t0\t0\t1\t2\ttrue\nchr1\t1\t\t1\t0\t0\t1\t2\ttrue\n"
    rows = [tuple(r) for r in tables.read_manifest(spark, file(tmp_path, name, text)).select("contig", "pos", "DEPTH", "NEAR_MAX_DEPTH").collect()]
    assert rows == [("chr10", 3, 9, False), ("chr10", 7, 9, True), ("chr2", 5, 9, False)]
    with pytest.raises(InvalidInput):
        tables.read_manifest(spark, file(tmp_path, "bad.tsv", "CHR\tPOS\nchr1\t1\n"))
    with pytest.raises(MissingFile):
        tables.read_manifest(spark, str(tmp_path / "none.tsv"))


@pytest.mark.parametrize("name", ["b.txt", "b.txt.gz"])
def test_barcodes(spark, tmp_path, name):
    path = file(tmp_path, name, " GGG-1 \n\nAAA-1\nGGG-2\n-x\nCCC\n")
    assert tuples(tables.read_barcodes(spark, path).orderBy("cell_id"), "cell_id", "barcode") == [(0, "GGG"), (1, "AAA"), (2, "CCC")]
    assert tuples(tables.barcodes_from(spark, ["a", "b", "a"])) == [("a", 2), ("b", 1)]


def test_known_sites(spark, tmp_path):
    path = file(tmp_path, "k.tsv.gz", "chr1\t99\tfirst line goes\nchr1\t5\tx\nchr1\t5\ty\nchr2\t+7\nchr1\t -3\nchr1\t2.5\nchr3\nchrX\t007\n")
    assert tuples(tables.read_known_sites(spark, path), "site", "pos") == [("chr1:5", 5), ("chr2:+7", 7), ("chrX:007", 7)]
    assert tables.check_known_sites(spark, path) == (4, 3)
    for name, text in (("e.tsv", ""), ("h.tsv", "a\tb\n"), ("n.tsv", "a\tb\nchr1\tx\n")):
        with pytest.raises((EmptyData, InvalidInput)):
            tables.read_known_sites(spark, file(tmp_path, name, text))
    with pytest.raises(MissingFile):
        tables.read_known_sites(spark, str(tmp_path / "none"))


def test_intervals(spark, tmp_path):
    bed = file(tmp_path, "a.bed", "track x\n#c\nchr1\t5\t9\tname\nchr2\t0\t1\n\n")
    assert tuples(tables.read_bed(spark, bed)) == [("chr1", 5, 9), ("chr2", 0, 1)]
    vcf = file(tmp_path, "a.vcf", "##x\n#CHROM\tPOS\nchr1\t5\t.\nchr2\t1\t.\n")
    assert tuples(tables.read_vcf(spark, vcf)) == [("chr1", 4, 5), ("chr2", 0, 1)]
    with pytest.raises(Exception, match="position from 1"):
        tables.read_vcf(spark, file(tmp_path, "b.vcf", "chr1\t0\t.\n")).collect()
    header = b'##fileformat=VCFv4.2\n##contig=<ID=chr1,length=9>\n##contig=<ID=chrB,IDX=5>\n#CHROM\n\0'
    records = b"".join(struct.pack("<IIii", 12, 3, c, p) + b"rest" + b"xyz" for c, p in ((0, 4), (5, 0), (5, 8)))
    (tmp_path / "a.bcf").write_bytes(block(b"BCF\2\2" + struct.pack("<I", len(header)) + header + records[:20]) + block(records[20:]) + block(b""))
    assert tuples(tables.read_vcf(spark, f"{tmp_path}/a.bcf")) == [("chr1", 4, 5), ("chrB", 0, 1), ("chrB", 8, 9)]
    (tmp_path / "b.bcf").write_bytes(block(b"BAM\1"))
    with pytest.raises(Exception, match="no BCF file"):
        tables.read_vcf(spark, f"{tmp_path}/b.bcf").collect()
    assert tuples(tables.read_site_list(spark, file(tmp_path, "s.tsv", "REF\tPOS\nchr1\t3\n"))) == tuples(tables.read_site_list(spark, file(tmp_path, "s.csv", "REF,POS\nchr1,3\n"))) == [("chr1", 3)]


def test_annotations(spark, tmp_path):
    listed = file(tmp_path, "a.json", json.dumps([{"site": "s1", "ref": "A", "n": 3}, {"id": "s2"}, {"x": 1}]))
    keyed = file(tmp_path, "b.json", json.dumps({"s1": {"ref": "A"}, "s2": None}))
    text = file(tmp_path, "c.tsv", "name\tref\tflag\ns1\tA\t\ns2\t\tx\n")
    read = lambda path: {r.site: r.entry for r in tables.read_annotations(spark, path).collect()}
    assert read(listed) == {"s1": {"ref": "A", "n": "3"}, "s2": {}} and read(keyed) == {"s1": {"ref": "A"}, "s2": {}} and read(text) == {"s1": {"ref": "A"}, "s2": {"flag": "x"}}
    spark.createDataFrame([(5, "C", float("nan"))], "pos long, ref string, v double").write.parquet(f"{tmp_path}/d.parquet")
    assert read(f"{tmp_path}/d.parquet") == {"5": {"ref": "C"}}
    for name, error in (("e.xml", UnsupportedFormat), ("f.csv", InvalidInput)):
        with pytest.raises(error):
            tables.read_annotations(spark, file(tmp_path, name, "q,r\n1,2\n"))


def test_standard_streams(spark, monkeypatch, capsys):
    for data in (b"CHR\tPOS\nchr1\t5\nchr2\t7\n", gzip.compress(b"CHR\tPOS\nchr1\t5\n") + gzip.compress(b"chr2\t7\n")):
        monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(data)))
        frame = tables.read_tsv(spark, "-")
        assert tuples(frame) == [("chr1", "5"), ("chr2", "7")]
    tables.write_tsv(frame.withColumn("ok", F.lit(True)), "-", order=["POS"])
    assert capsys.readouterr().out.endswith("CHR\tPOS\tok\nchr1\t5\ttrue\nchr2\t7\ttrue\n")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", 2, 'x"y'), ("a", 1, None)], "CHR string, POS long, v string")
    tables.write_tsv(df, f"{tmp_path}/o", gzipped=True, order=["CHR"])
    assert tuples(tables.read_tsv(spark, f"{tmp_path}/o")) == [("a", "1", None), ("b", "2", 'x"y')]
    assert tables.gz_path("a.tsv") == "a.tsv.gz" and tables.gz_path("a.bgzf") == "a.bgzf" and not tables.is_gzipped("gz") and tables.is_gzipped("x.GZ")
    path = tables.write_skipped(spark.createDataFrame([("c", 5, 9)], "contig string, pos long, DEPTH long"), f"{tmp_path}/out.matrix")
    assert path == f"{tmp_path}/out_skiped_sites.txt" and tuples(tables.read_tsv(spark, path), "CHR", "POS", "DEPTH") == [("c", "5", "9")]
    tables.make_parent(spark, f"{tmp_path}/p/q/r")
    assert (tmp_path / "p/q").is_dir()


FASTA = ">chr1 first\nATCGATCG\nATCG\n>chr2\nGCTAgctaNNNN\n>chr3 a>b\nAC\n"


def test_fasta(spark, tmp_path):
    path = file(tmp_path, "r.fa", FASTA)
    blocks = fasta.read_fasta(spark, path, block=5)
    assert tuples(blocks) == [("chr1", 0, "ATCGA"), ("chr1", 1, "TCGAT"), ("chr1", 2, "CG"), ("chr2", 0, "GCTAG"), ("chr2", 1, "CTANN"), ("chr2", 2, "NN"), ("chr3", 0, "AC")]
    sites = ["chr1:1", "chr1:4", "chr2:2", "chr2:7", "chr2:9", "chr1:0", "chr1:13", "chr9:1", "chr1", "a:b:c", "chr1:-1", "chr1:x"]
    got = {r.site: r.base for r in fasta.bases_of_sites(spark.createDataFrame([(s,) for s in sites], "site string"), blocks, 5).collect()}
    assert got == dict(zip(sites, "AGCTNNNNNNNN"))
    rng = random.Random(2)
    genome = {f"c{k}": "".join(rng.choice("ACGTn") for _ in range(rng.choice((0, 1, 59, 60, 61, 500, 3000)))) for k in range(40)}
    text = "".join(f">{name} x\n" + "".join(seq[a : a + 60] + rng.choice(("\n", "\r\n")) for a in range(0, len(seq), 60)) + "\n" * (int(name[1:]) % 3) for name, seq in genome.items())
    path = file(tmp_path, "g.fa", text)
    for size in ("777", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        for block in (7, 100, 4096):
            found = {(r.contig, r.block): r.seq for r in fasta.read_fasta(spark, path, block).collect()}
            assert found == {(name, a // block): seq[a : a + block].upper() for name, seq in genome.items() for a in range(0, len(seq), block)}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    fai = file(tmp_path, "r.fa.fai", "chr1\t12\t6\t12\t13\nchr2\t12\t25\t12\t13\n")
    assert tuples(fasta.contig_names(spark, fai)) == [(0, "chr1", 12), (1, "chr2", 12)]
    with pytest.raises(EmptyData):
        fasta.contig_names(spark, file(tmp_path, "e.fai", "\n"))
    with pytest.raises(MissingFile):
        fasta.read_fasta(spark, str(tmp_path / "none.fa"))


CONTIGS = [("chr1", 1000), ("chr2", 500)]
READS = [
    ("chr1", 10, 255, 0, [(4, "M")], "ACGT", "IIII", [("CB", "Z", "AAA-1"), ("NM", "i", 3), ("UB", "Z", "U1")]),
    ("chr1", 12, 255, 16, [(2, "M"), (1, "I"), (1, "M")], "GTAN", None, [("UB", "B", b"U2"), ("CB", "Z", "CCC")]),
    ("chr2", 0, 30, 1024, [(3, "M")], "ACG", "!5I", []),
    (None, -1, 0, 4, [], "AC", "II", []),
]
ROWS = [("chr1", 10, 255, 0, "4M", "ACGT", "IIII", "AAA-1", "U1"), ("chr1", 12, 255, 16, "2M1I1M", "GTAN", None, "CCC", "U2"), ("chr2", 0, 30, 1024, "3M", "ACG", "!5I", None, None), (None, -1, 0, 4, None, "AC", "II", None, None)]


@pytest.mark.parametrize("size", [17, 64, 60000])
def test_bam(spark, tmp_path, size):
    path = f"{tmp_path}/x.bam"
    write_bam(path, CONTIGS, READS, size, index=True)
    columns = [c for c in bam.COLUMNS if c != "read_id"]
    expected = sorted(ROWS, key=repr)
    assert sorted(tuples(bam.read_bam(spark, path), *columns), key=repr) == expected
    assert tuples(bam.bam_header(spark, path)) == [(0, "chr1", 1000), (1, "chr2", 500)]
    spark.dataSource.register(bam.BamSource)
    for every in (1, 50, 1 << 20):
        df = spark.read.format("bam").option("splitBytes", every).load(path)
        assert sorted(tuples(df, *columns), key=repr) == expected
        assert df.select("read_id").distinct().count() == len(ROWS)
    assert spark.read.format("bam").option("contigs", "chr2").load(path).count() == 1
    with pytest.raises(UnsupportedFormat):
        bam.read_bam(spark, "x.cram")


def test_regions_of_an_indexed_bam(spark, tmp_path):
    """Only the ranges of the file that regions need are read, and just the records that overlap them come."""
    rng = random.Random(6)
    contigs = [("chr1", 3_000_000), ("chr2", 500_000), ("GL1", 100_000)]
    reads = []
    for name, length in contigs:
        for start in sorted(rng.randrange(length - 3000) for _ in range(600)):
            cigar = rng.choice([[(20, "M")], [(5, "S"), (10, "M"), (2000, "N"), (5, "M")], [(8, "M"), (3, "D"), (12, "M")]])
            size = sum(n for n, op in cigar if op in "MS")
            reads.append((name, start, 255, 0, cigar, "".join(rng.choice("ACGT") for _ in range(size)), "I" * size, [("XC", "Z", f"C{start % 7}-1"), ("XU", "Z", "U")]))
    path = f"{tmp_path}/x.bam"
    write_bam(path, contigs, reads, 1000, index=True)
    stop = lambda r: r[1] + sum(n for n, op in r[4] if op in "MDN")
    size = os.path.getsize(path)
    spans = lambda **options: sum((p.end >> 16) - (p.begin >> 16) + 1000 for p in bam.BamReader({"path": path, **options}).partitions())
    for regions in ([("chr1", 100_000, 120_000)], [("chr1", 0, 1), ("chr1", 2_999_000, 3_000_000), ("chr2", 70_000, 70_100), ("chr2", 70_050, 90_000)], [("GL1", 0, 100_000)], [("chrX", 5, 6)]):
        expected = sorted((r[0], r[1]) for r in reads if any(r[0] == c and r[1] < b and stop(r) > a for c, a, b in regions))
        for every in (500, 1 << 20):
            spark.dataSource.register(bam.BamSource)
            found = spark.read.format("bam").option("regions", json.dumps(regions)).option("splitBytes", every).load(path)
            assert tuples(found, "contig", "start") == expected
        assert spans(regions=json.dumps(regions)) < size / 2
        assert tuples(bam.open_bam(spark, path, regions=regions), "contig", "start") == expected
    assert tuples(bam.open_bam(spark, path, contigs=["GL1"]), "contig", "start") == sorted((r[0], r[1]) for r in reads if r[0] == "GL1") and spans(contigs="GL1") < size / 2
    first = bam.open_bam(spark, path, "XC", "XU", ["chr1"], [("chr1", 0, 3_000_000)]).first()
    assert first.cb.endswith("-1") and first.umi == "U" and bam.open_bam(spark, path).count() == len(reads) == bam.read_bam(spark, path).count()
    assert bam.read_bam(spark, path, "XC", "XU").first().umi == "U" and bam.read_bam(spark, path).first().umi is None


def test_long_header(spark, tmp_path):
    contigs = [(f"contig{k}", k + 1) for k in range(30_000)]
    write_bam(f"{tmp_path}/x.bam", contigs, [], 60_000)
    assert bam.bam_header(spark, f"{tmp_path}/x.bam", 1000).count() == 30_000


def test_damaged_bam(tmp_path):
    path = f"{tmp_path}/x.bam"
    write_bam(path, CONTIGS, READS, 60000)
    data = open(path, "rb").read()
    for bad in (b"", data[:-40], b"BAM\1"):
        with pytest.raises((ParseFailure, Exception)):
            list(bam.parse_bam(bad))
    with pytest.raises(ParseFailure):
        bam.record_starts(b"xxxx")
    assert bam.cut_points([], 10) == [] and bam.cut_points([5 << 16, 9 << 16, 200 << 16], 300, 100) == [(5 << 16, 200 << 16), (200 << 16, -1)]


def test_sam(spark, tmp_path):
    path = file(tmp_path, "x.sam", "@HD\tVN:1\nr\t0\tchr1\t11\t255\t4M\t*\t0\t0\tACGT\tIIII\tCB:Z:AAA-1\tUB:Z:U1\nq\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    assert sorted(tuples(bam.read_sam(spark, path), *(c for c in bam.COLUMNS if c != "read_id")), key=repr) == sorted([ROWS[0], (None, -1, 0, 4, None, None, None, None, None)], key=repr)


def reads_for_commands():
    """Site chr1:12 with A and G in two cells; 12 molecules each."""
    out = []
    for k in range(24):
        base = "G" if k % 3 == 0 else "A"
        out.append(("chr1", 10, 255, 0, [(3, "M")], f"C{base}T", "IIII"[:3], [("CB", "Z", ("AAA" if k % 2 else "CCC") + "-1"), ("UB", "Z", f"U{k}")]))
    return out


def test_commands_from_files_to_files(spark, tmp_path):
    write_bam(f"{tmp_path}/x.bam", CONTIGS, reads_for_commands(), 500)
    assert cli.main(["bulk", f"{tmp_path}/x.bam", "-o", f"{tmp_path}/sites.tsv", "-t", "4"]) == 0
    sites = tables.read_manifest(spark, f"{tmp_path}/sites.tsv.gz")
    assert tuples(sites, "contig", "pos", "DEPTH") == [("chr1", 12, 24)]
    barcodes = file(tmp_path, "b.txt", "AAA-1\nCCC-1\nTTT-1\n")
    for name, extra in (("one", ["--tsv", f"{tmp_path}/sites.tsv.gz"]), ("two", ["--two-pass"])):
        assert cli.main(["bam2mtx", "--bam", f"{tmp_path}/x.bam", "--barcodes", barcodes, "-o", f"{tmp_path}/{name}", "-t", "4", *extra]) == 0
    one, two = (matrices.read_matrix(spark, f"{tmp_path}/{n}") for n in ("one", "two"))
    assert tuples(one.entries, "cell_id", "A1", "G1") == tuples(two.entries, "cell_id", "A1", "G1") == [(0, 8, 4), (1, 8, 4)] and tuples(one.obs, "barcode") == [("AAA",), ("CCC",)]
    assert tuples(tables.read_manifest(spark, f"{tmp_path}/1pass.tsv.gz"), "contig", "pos", "DEPTH") == [("chr1", 12, 24)]  # the first pass leaves its sites
    other = [("GL1", *r[1:2], 10, *r[3:7], [("XC", "Z", r[7][0][2]), ("XU", "Z", r[7][1][2])]) for r in reads_for_commands()]
    write_bam(f"{tmp_path}/y.bam", [("GL1", 1000)], other, 500, index=True)
    base = ["bam2mtx", "--bam", f"{tmp_path}/y.bam", "--barcodes", barcodes, "-t", "4", "--two-pass", "-A", "--umi-tag", "XU", "--cb-tag", "XC", "--chunk-size-max-depth", "3", "--matrix-density", "0.1"]
    assert cli.main([*base, "-o", f"{tmp_path}/three", "-q", "10", "--tsv", f"{tmp_path}/pass.tsv.gz", "-d", "24"]) == 0
    three = matrices.read_matrix(spark, f"{tmp_path}/three")
    assert tuples(three.entries, "cell_id", "A1", "G1") == tuples(one.entries, "cell_id", "A1", "G1") and tuples(three.var, "site") == [("GL1:12",)]
    assert tuples(tables.read_manifest(spark, f"{tmp_path}/pass.tsv.gz"), "contig", "pos") == [("GL1", 12)]
    assert cli.main([*base, "-o", f"{tmp_path}/four", "-q", "10", "-d", "25"]) == 0 and spark.read.parquet(f"{tmp_path}/four/var").count() == 0  # too little depth for one more
    assert cli.main([*base, "-o", f"{tmp_path}/five", "-q", "10", "-et", "2"]) == 0 and spark.read.parquet(f"{tmp_path}/five/var").count() == 0  # G is no more than half
    fa = file(tmp_path, "r.fa", ">chr1\n" + "N" * 11 + "A" + "N" * 20 + "\n")
    file(tmp_path, "r.fa.fai", "chr1\t32\t6\t32\t33\n")
    known = file(tmp_path, "k.tsv", "c\tp\nchr1\t12\n")
    args = ["call", "--input", f"{tmp_path}/one", "--output", f"{tmp_path}/called", "--fa", fa, "--site-white-list", known, "--threads", "4"]
    assert cli.main([*args, "--dry-run"]) == 0 and not (tmp_path / "called").exists()
    assert cli.main(args) == 0
    called = matrices.read_matrix(spark, f"{tmp_path}/called")
    assert called.layers == ("ref", "alt", "others", "coverage") and tuples(called.entries, "cell_id", *called.layers) == [(0, 8, 4, 0, 12), (1, 8, 4, 0, 12)]
    assert tuples(called.var, "site", "ref", "Mismatch", "is_editing_site", "AG_ref", "AG_alt") == [("chr1:12", "A", "AG", True, 16, 8)]
    assert all(abs(r.CEI - 1 / 3) < 1e-6 for r in called.obs.collect())
    with pytest.raises(InvalidConfig):
        validate_output(spark, f"{tmp_path}/called")
    with pytest.raises(MissingFile):
        cli.main([*args[:1], "--input", f"{tmp_path}/nothing", *args[3:], "--overwrite"])
    assert cli.main([*args, "--overwrite"]) == 0 and CallConfig().editing_type == "ag"


def test_matrices(spark, tmp_path):
    from tests.test_golden import golden_matrix

    m = golden_matrix(spark)
    matrices.write_matrix(m, f"{tmp_path}/m")
    back = matrices.read_matrix(spark, f"{tmp_path}/m")
    assert back.layers == m.layers and tuples(back.entries) == tuples(m.entries) and tuples(back.var, "site") == tuples(m.var, "site")
    m.entries.withColumn("A1", F.col("A1") + 0.7).write.mode("overwrite").parquet(f"{tmp_path}/m/entries")
    assert tuples(matrices.read_matrix(spark, f"{tmp_path}/m").entries, "A1") == tuples(m.entries, "A1")
    m.obs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/m/obs")
    with pytest.raises(EmptyData):
        matrices.read_matrix(spark, f"{tmp_path}/m")
    with pytest.raises(UnsupportedFormat):
        matrices.write_h5ad(m, f"{tmp_path}/x.h5ad")
    with pytest.raises(MissingFile):
        matrices.read_matrix(spark, f"{tmp_path}/none")


def test_h5ad_by_a_stand_in(spark, tmp_path, monkeypatch):
    """What goes into and comes out of the library, which isn't installed here, by a stand-in for it."""
    import sys
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from tests.test_golden import golden_matrix

    class Sparse:
        def __init__(self, content, shape):
            self.data, (self.row, self.col) = np.array(content[0]), map(np.array, content[1])

        def tocoo(self):
            return self

        def astype(self, kind):
            return self

    files = {}

    class AnnData:
        def __init__(self, X=None, obs=None, var=None, layers=None):
            self.X, self.obs, self.var, self.layers, self.n_obs, self.n_vars = X, obs, var, layers, len(obs), len(var)

        def write_h5ad(self, path):
            files[path] = self
            open(path, "w").close()

    monkeypatch.setitem(sys.modules, "anndata", SimpleNamespace(AnnData=AnnData, read_h5ad=files.__getitem__))
    sparse = SimpleNamespace(csr_matrix=Sparse)
    monkeypatch.setitem(sys.modules, "scipy", SimpleNamespace(sparse=sparse))
    monkeypatch.setitem(sys.modules, "scipy.sparse", sparse)
    m = golden_matrix(spark)
    path = f"{tmp_path}/m.h5ad"
    matrices.write_matrix(m, path)
    back = matrices.read_matrix(spark, path)
    assert back.layers == m.layers and tuples(back.var, "site") == tuples(m.var, "site") and tuples(back.obs, "barcode") == tuples(m.obs, "barcode")
    named = lambda x: sorted((r.barcode, r.site, *(r[c] for c in m.layers)) for r in x.entries.where(" + ".join(m.layers) + " > 0").join(x.obs, "cell_id").join(x.var, "site_id").collect())
    assert named(back) == named(m)
    files[path] = AnnData(None, pd.DataFrame(index=[]), pd.DataFrame(index=["a:1"]), {})
    with pytest.raises(EmptyData):
        matrices.read_matrix(spark, path)
    monkeypatch.setattr(matrices, "MOST_ENTRIES", 0)
    with pytest.raises(UnsupportedFormat, match="too many"):
        matrices.write_matrix(m, path)


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    from sitewright import catalog
    from sitewright.operators.pileup import pileup
    from sitewright.streaming.incremental import start_counts, stream_bases, streaming_pileup, streaming_umi_calls
    from tests.test_golden import base_rows

    assert catalog.queries()
    rows = base_rows(spark, [(p % 5, "X", f"u{p % 3}", "ACGT"[p % 4], p % 2 == 0) for p in range(40)]).withColumn("cell_id", F.lit(0))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = stream_bases(spark, f"{tmp_path}/in", rows.schema, 1)
    for name, counts, batch in (("piles", streaming_pileup(stream, 255, 30), pileup(rows)), ("calls", streaming_umi_calls(stream, True), streaming_umi_calls(rows, True))):
        query = start_counts(counts, name, f"{tmp_path}/{name}")
        query.processAllAvailable()
        query.stop()
        assert tuples(spark.table(name)) == tuples(batch)
