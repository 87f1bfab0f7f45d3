"""Text tables: site manifests, barcodes, known sites, intervals, annotations; and the writers."""

from __future__ import annotations

import gzip
import re
import struct
import sys
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import path_exists
from sitewright.errors import EmptyData, InvalidInput, MissingFile, ParseFailure, UnsupportedFormat
from sitewright.functions.tags import INTEGER
from sitewright.operators.container import numbered
from sitewright.schema import MANIFEST_REQUIRED
from sitewright.sources.bam import Buffer, blocks_of

GZIP_SUFFIXES = ("gz", "gzip", "bgzf")


def is_gzipped(path: str) -> bool:
    return path.rpartition(".")[2].lower() in GZIP_SUFFIXES and "." in path


def gz_path(path: str) -> str:
    return path if is_gzipped(path) else f"{path}.gz"


def make_parent(spark: SparkSession, path: str) -> None:
    parent = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    if parent is not None:
        parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(parent)


def read_tsv(spark: SparkSession, path: str | None, header: bool = True, comment: str | None = None) -> DataFrame:
    """Tab-separated strings; gzip by the file's name, all members of block-gzipped files. None or `-` is the standard input.

    Standard input comes through the driver, so it must fit there.
    """
    if path in (None, "-"):
        data = sys.stdin.buffer.read()
        lines = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode().splitlines()
        path = spark.sparkContext.parallelize(lines, max(1, len(data) >> 24))
    elif not path_exists(spark, path):
        raise MissingFile(path)
    reader = spark.read.option("sep", "\t").option("header", header).option("quote", "").option("inferSchema", False)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def integer(name: str):
    """A bigint, null unless the text is digits with an optional plus."""
    return F.when(F.col(name).rlike(INTEGER), F.col(name).try_cast("bigint"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos, DEPTH, INS, DEL, REF_SKIP, FAIL, NEAR_MAX_DEPTH) of a site table, in order of contig and position.

    Rows in which a number is missing or isn't one are dropped; a missing flag is false.
    """
    rows = read_tsv(spark, path, comment="#")
    missing = [c for c in MANIFEST_REQUIRED if c not in rows.columns]
    if missing:
        raise InvalidInput(f"columns missing in {path}: {missing}")
    numbers = [c for c in MANIFEST_REQUIRED if c not in ("CHR", "NEAR_MAX_DEPTH")]
    typed = rows.select("CHR", *(integer(c).alias(c) for c in numbers), F.coalesce(F.trim("NEAR_MAX_DEPTH").try_cast("boolean"), F.lit(False)).alias("NEAR_MAX_DEPTH"))
    return typed.dropna(subset=["CHR", *numbers]).select(F.col("CHR").alias("contig"), F.col("POS").alias("pos"), *numbers[1:], "NEAR_MAX_DEPTH").orderBy("contig", "pos")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block, line): lines with what their order in the files follows."""
    if not path_exists(spark, path):
        raise MissingFile(path)
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_barcodes(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """(barcode, cell_id): the text before the first hyphen of each line; numbered in order of first appearance."""
    lines = _lines(spark, path)
    cleaned = F.regexp_replace("value", r"^\s+|\s+$", "") if trim else F.col("value")
    kept = lines.select(F.substring_index(cleaned, "-", 1).alias("barcode"), F.struct("file", "block", "line").alias("place")).where("barcode <> ''")
    first = kept.groupBy("barcode").agg(F.min("place").alias("place"))
    return numbered(first.select("barcode", "place.*"), ["file", "block", "line"], "cell_id").select("barcode", "cell_id")


def barcodes_from(spark: SparkSession, barcodes: list[str]) -> DataFrame:
    """(barcode, cell_id) of an explicit list, as it stands; of a barcode given twice the last place counts."""
    return spark.createDataFrame([(b, k) for b, k in {b: k for k, b in enumerate(barcodes)}.items()], "barcode string, cell_id bigint")


def read_known_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site, contig, pos): distinct `contig:pos`, with the text of the position as it stands. The first line is left out, whatever it says."""
    rows = read_tsv(spark, path)
    if len(rows.columns) < 2:
        raise EmptyData(f"no known sites in {path}")
    contig, pos = rows.columns[:2]
    sites = rows.where(F.col(contig).isNotNull() & F.col(pos).rlike(INTEGER)).select(F.concat_ws(":", contig, pos).alias("site"), F.col(contig).alias("contig"), F.col(pos).try_cast("bigint").alias("pos")).where("pos is not null").distinct()
    if sites.isEmpty():
        raise EmptyData(f"no known sites in {path}")
    return sites


def check_known_sites(spark: SparkSession, path: str, lines: int = 100) -> tuple[int, int]:
    """(valid, invalid) among the first data lines; none valid is an error."""
    rows = read_tsv(spark, path)
    if len(rows.columns) < 2:
        raise EmptyData(path)
    seen = [r[1] for r in rows.limit(lines).collect()]
    valid = sum(1 for p in seen if p and p.removeprefix("+").isascii() and p.removeprefix("+").isdigit())
    if not valid:
        raise InvalidInput(f"none of the first {len(seen)} lines of {path} names a site")
    return valid, len(seen) - valid


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, stop) of a BED file."""
    if not path_exists(spark, path):
        raise MissingFile(path)
    fields = F.split("value", r"\t")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    return rows.select(F.get(fields, F.lit(0)).alias("contig"), F.get(fields, F.lit(1)).try_cast("bigint").alias("start"), F.get(fields, F.lit(2)).try_cast("bigint").alias("stop")).where("start is not null and stop is not null")


def bcf_sites(data: bytes) -> Iterator[tuple[str, int]]:
    """(contig, position from 0) of each record of a BCF file of version 2."""
    buffer = Buffer(blocks_of(data))
    if buffer.take(3) != b"BCF" or buffer.take(2)[:1] != b"\2":
        raise ParseFailure("no BCF file of version 2")
    names: dict[int, str] = {}
    for line in buffer.take(buffer.number()).rstrip(b"\0").decode().splitlines():
        if line.startswith("##contig=<"):
            fields = dict(re.findall(r"([A-Za-z]+)=(\"[^\"]*\"|[^,>]*)", line[len("##contig=<") :]))
            names[int(fields.get("IDX", len(names)))] = fields["ID"]
    while buffer.tell() is not None:
        shared, single = buffer.number(), buffer.number()
        contig, pos = struct.unpack_from("<ii", buffer.take(shared))
        buffer.take(single)
        if contig not in names:
            raise ParseFailure(f"a record names contig {contig}, which the header lacks")
        yield names[contig], pos


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(contig, start, stop) of one position for each record of a VCF or, by the name's end, BCF file; positions below 1 raise.

    A BCF file is read by one task.
    """
    if not path_exists(spark, path):
        raise MissingFile(path)
    if path.lower().endswith(".bcf"):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    sites = bcf_sites(content.as_py())
                    while some := list(islice(sites, 10_000)):
                        if min(p for _, p in some) < 0:
                            raise ParseFailure("a record without a position from 1")
                        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in some]), pa.array([p for _, p in some], pa.int64()), pa.array([p + 1 for _, p in some], pa.int64())], names=["contig", "start", "stop"])

        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "contig string, start bigint, stop bigint")
    fields = F.split("value", r"\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.col("value") != ""))
    pos = F.get(fields, F.lit(1)).try_cast("bigint")
    checked = F.when(pos >= 1, pos).otherwise(F.raise_error(F.lit("a record without a position from 1")).cast("bigint"))
    return rows.select(F.get(fields, F.lit(0)).alias("contig"), (checked - 1).alias("start"), checked.alias("stop"))


def read_site_list(spark: SparkSession, path: str) -> DataFrame:
    """(contig, pos) of the older scripts' list, whose column REF is the contig; tabs only if the name ends in .tsv."""
    rows = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    return rows.select(F.col("REF").alias("contig"), integer("POS").alias("pos")).dropna()


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(site, entry): a map of strings for each site, from JSON (a list or an object of objects), a text table or Parquet."""
    if not path_exists(spark, path):
        raise MissingFile(path)
    suffix = path.rpartition(".")[2].lower()
    if suffix in ("json", "jsonl"):
        whole = spark.read.option("wholetext", True).text(path)
        as_list = F.from_json("value", "array<map<string,string>>")
        as_map = F.from_json("value", "map<string,map<string,string>>")
        is_list = F.ltrim("value").startswith("[")
        listed = whole.where(is_list).select(F.explode(as_list).alias("entry")).select(F.coalesce(*(F.nullif(F.try_element_at("entry", F.lit(k)), F.lit("")) for k in ("site", "id", "name"))).alias("site"), F.map_filter("entry", lambda k, v: ~k.isin("site", "id", "name")).alias("entry"))
        keyed = whole.where(~is_list).select(F.explode(as_map).alias("site", "entry")).select("site", F.coalesce("entry", F.create_map().cast("map<string,string>")).alias("entry"))
        return listed.where("site is not null").unionByName(keyed)
    if suffix in ("tsv", "csv", "txt"):
        rows = spark.read.option("header", True).option("sep", "," if suffix == "csv" else "\t").csv(path)
    elif suffix in ("parquet", "pq"):
        rows = spark.read.parquet(path)
    else:
        raise UnsupportedFormat(f"annotations in {suffix}")
    key = next((c for c in ("site", "id", "name", "position", "pos") if c in rows.columns), None)
    if key is None:
        raise InvalidInput("no column names the sites")
    rest = [c for c in rows.columns if c != key]
    pairs = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*(F.col(c).cast("string") for c in rest))) if rest else F.create_map().cast("map<string,string>")
    return rows.select(F.col(key).cast("string").alias("site"), F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != "NaN")).alias("entry"))


# --- writers


def write_tsv(df: DataFrame, path: str, header: bool = True, gzipped: bool = False, order: list[str] | None = None) -> None:
    """A folder of tab-separated parts; with an order, the parts follow each other in it. `-` is the standard output, written row by row."""
    out = df.orderBy(*order) if order else df
    if path == "-":
        if header:
            print(*out.columns, sep="\t")
        for row in out.toLocalIterator():
            print(*("" if v is None else str(v).lower() if isinstance(v, bool) else v for v in row), sep="\t")
        return
    out.write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "\u0000").option("compression", "gzip" if gzipped else "none").csv(path)


def skipped_path(output: str) -> str:
    """Where the list of skipped sites goes: beside the output. The spelling is the format's own."""
    folder, _, name = output.rpartition("/")
    return f"{folder}/{name.partition('.')[0]}_skiped_sites.txt" if folder else f"{name.partition('.')[0]}_skiped_sites.txt"


def write_skipped(skipped: DataFrame, output: str) -> str:
    """CHR, POS (from 1) and DEPTH of the skipped sites; returns the path."""
    path = skipped_path(output)
    write_tsv(skipped.select(F.col("contig").alias("CHR"), F.col("pos").alias("POS"), "DEPTH"), path, order=["CHR", "POS"])
    return path
