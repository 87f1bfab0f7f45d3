"""python -m sitewright.cli bulk|bam2mtx|call ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright import schema as S
from sitewright.config import BulkConfig, CallConfig, MatrixConfig, tuned
from sitewright.operators.bases import standard_contigs
from sitewright.plans.bulk import run_bulk
from sitewright.plans.call import run_call
from sitewright.plans.matrix import run_matrix
from sitewright.sources.bam import bam_header, open_bam, read_sam
from sitewright.sources.tables import read_barcodes, read_bed, read_manifest

WINDOW = 1 << 14


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sitewright")
    commands = top.add_subparsers(dest="command", required=True)
    bulk = commands.add_parser("bulk", help="counts for each site of all reads")
    bulk.add_argument("bam")
    bulk.add_argument("-o", "--output", required=True)
    bulk.add_argument("-t", "--threads", type=int, default=10)
    bulk.add_argument("-c", "--chunksize", type=int, default=S.TILE)
    bulk.add_argument("-Q", "--min-baseq", type=int, default=S.MIN_BASEQ)
    bulk.add_argument("-q", "--mapquality", type=int, default=S.MIN_MAPQ)
    bulk.add_argument("-z", "--zero-base", action="store_true")
    bulk.add_argument("-D", "--max-depth", type=int, default=S.BULK_MAX_DEPTH)
    bulk.add_argument("-d", "--min-depth", type=int, default=S.MIN_DEPTH)
    bulk.add_argument("-n", "--max-n-fraction", type=int, default=S.MAX_N_FRACTION)
    bulk.add_argument("-a", "--all", action="store_true")
    bulk.add_argument("-et", "--editing-threshold", type=int, default=S.EDITING_THRESHOLD)
    bulk.add_argument("-A", "--allcontigs", action="store_true")
    bulk.add_argument("--bed")
    matrix = commands.add_parser("bam2mtx", help="cell-by-site matrix")
    matrix.add_argument("--bam", required=True)
    matrix.add_argument("--tsv")
    matrix.add_argument("--barcodes", required=True)
    matrix.add_argument("--two-pass", action="store_true")
    matrix.add_argument("-o", "--output", required=True)
    matrix.add_argument("-t", "--threads", type=int, default=10)
    matrix.add_argument("-q", "--min-mapq", type=int, default=S.MIN_MAPQ)
    matrix.add_argument("-Q", "--min-baseq", type=int, default=S.MIN_BASEQ)
    matrix.add_argument("-D", "--max-depth", type=int, default=S.MATRIX_MAX_DEPTH)
    matrix.add_argument("-d", "--min-depth", type=int, default=S.MIN_DEPTH)
    matrix.add_argument("-n", "--max-n-fraction", type=int, default=S.MAX_N_FRACTION)
    matrix.add_argument("-et", "--editing-threshold", type=int, default=S.EDITING_THRESHOLD)
    matrix.add_argument("--umi-tag", default="UB")
    matrix.add_argument("--cb-tag", default="CB")
    matrix.add_argument("-r", "--reference", help="for CRAM, which isn't read")
    matrix.add_argument("-c", "--chunksize", type=int, default=S.CHUNK_WEIGHT, help="weight of a chunk of sites; Spark's partitions take its place")
    matrix.add_argument("--chunk-size-max-depth", type=int, default=S.HOT_CHUNK, help="as --chunksize, near the depth cap")
    matrix.add_argument("--matrix-density", type=float, default=0.005, help="accepted; nothing is sized beforehand")
    matrix.add_argument("-S", "--stranded", action="store_true")
    matrix.add_argument("-A", "--allcontigs", action="store_true")
    call = commands.add_parser("call", help="editing calls on a matrix")
    call.add_argument("--input", required=True)
    call.add_argument("--output", required=True)
    call.add_argument("--fa", required=True)
    call.add_argument("--site-white-list", required=True)
    call.add_argument("--editingtype", default="ag")
    call.add_argument("--max-other-threshold", type=float, default=0.01)
    call.add_argument("--min-edited-threshold", type=float, default=0.01)
    call.add_argument("--min-ref-threshold", type=float, default=0.01)
    call.add_argument("--min-coverage", type=int, default=S.MIN_COVERAGE)
    call.add_argument("-c", "--chunksize", type=int, default=100_000)
    call.add_argument("-t", "--threads", type=int, default=2)
    call.add_argument("-v", "--verbose", action="store_true")
    call.add_argument("--dry-run", action="store_true")
    call.add_argument("--overwrite", action="store_true")
    return top


def reads_of(spark: SparkSession, path: str, all_contigs: bool, sites: DataFrame | None = None, cb: str = "CB", umi: str = "UB") -> DataFrame:
    """Reads of a SAM or BAM file; of an indexed one only those of the contigs that count, and near the sites where some are given.

    Sites (contig, start, stop) are brought together as windows of WINDOW positions, of which a genome has 190,000.
    """
    if path.endswith((".sam", ".sam.gz")):
        return read_sam(spark, path, cb, umi)
    regions = None
    if sites is not None:
        first, last = (F.floor(F.col(c) / WINDOW) for c in ("start", "end"))
        windows = sites.where("stop > start").withColumn("end", F.col("stop") - 1).select("contig", F.explode(F.sequence(first, last)).alias("k")).distinct()
        regions = [(r.contig, r.k * WINDOW, (r.k + 1) * WINDOW) for r in windows.collect()]
    contigs = None if all_contigs else [r.contig for r in standard_contigs(bam_header(spark, path)).collect()]
    return open_bam(spark, path, cb, umi, contigs, regions)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = tuned(SparkSession.builder.appName(f"sitewright-{args.command}").getOrCreate(), args.threads)
    if args.command == "bulk":
        config = BulkConfig(args.mapquality, args.min_baseq, args.min_depth, args.max_n_fraction, args.editing_threshold, args.max_depth, args.all, args.allcontigs, args.zero_base, args.chunksize)
        bed = read_bed(spark, args.bed) if args.bed else None
        run_bulk(reads_of(spark, args.bam, args.allcontigs, bed), args.output, config, bed)
    elif args.command == "bam2mtx":
        if not args.two_pass and not args.tsv:
            parser().error("--tsv or --two-pass")
        thresholds = BulkConfig(min_depth=args.min_depth, max_n_fraction=args.max_n_fraction, editing_threshold=args.editing_threshold)
        config = MatrixConfig(args.min_mapq, args.min_baseq, args.max_depth, args.stranded, args.allcontigs, two_pass=args.two_pass, chunk_weight=args.chunksize, hot_chunk=args.chunk_size_max_depth, umi_tag=args.umi_tag, cb_tag=args.cb_tag, bulk=thresholds).validate()
        header = bam_header(spark, args.bam) if args.bam.endswith(".bam") else None
        manifest = None if args.two_pass else read_manifest(spark, args.tsv)
        sites = None if manifest is None else manifest.select("contig", (F.col("pos") - 1).alias("start"), F.col("pos").alias("stop"))
        reads = reads_of(spark, args.bam, args.allcontigs, sites, config.cb_tag, config.umi_tag)
        run_matrix(reads, read_barcodes(spark, args.barcodes), manifest, args.output, config, header, args.tsv)
    else:
        config = CallConfig(args.editingtype, args.max_other_threshold, args.min_edited_threshold, args.min_ref_threshold, args.min_coverage, args.chunksize, args.threads)
        if args.verbose:
            spark.sparkContext.setLogLevel("INFO")
        run_call(spark, args.input, args.fa, args.site_white_list, args.output, config, args.dry_run, args.overwrite)
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except BrokenPipeError:
        sys.exit(0)
