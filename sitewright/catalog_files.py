"""Queries that go through files: rows of the driver's tables are written in a format and read back by its reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright import catalog as C
from sitewright.functions.tags import lower_keys
from sitewright.operators import pileup as P
from sitewright.operators import umi as U
from sitewright.operators.bases import explode_reads, standard_contigs, usable_bases
from sitewright.operators.intervals import known_contigs
from sitewright.plans.bulk import as_table, bulk_sites
from sitewright.schema import BASE_LAYERS
from sitewright.sources import bam, fasta, matrices, tables
from sitewright.stages import stage_path


def lines(df: DataFrame, *order: str) -> str:
    """The column `value` as a text file, in order if one is given; returns its path."""
    path = stage_path(df.sparkSession, "lines")
    (df.repartition(1).sortWithinPartitions(*order) if order else df).select("value").write.text(path)
    return path


@C.query("manifest_file", C.sql(C.PILE, select=f"SELECT contig, pos, DEPTH, INS, DEL, REF_SKIP, FAIL, {C.NEAR_RAW.format(cap=8000)} AS NEAR_MAX_DEPTH FROM pile WHERE {C.STANDARD} AND {C.EDITED}"))
def _(spark, d):
    path = tables.gz_path(stage_path(spark, "manifest"))
    tables.make_parent(spark, path)
    tables.write_tsv(as_table(bulk_sites(C.base_rows(spark, d)), zero_base=True), path, gzipped=tables.is_gzipped(path), order=["CHR", "POS"])
    return tables.read_manifest(spark, path)


@C.query("skipped_file", C.sql(f"depth AS (SELECT contig AS CHR, pos AS POS, {C.N('true')} AS DEPTH FROM bases GROUP BY contig, pos)", select="SELECT * FROM depth WHERE DEPTH >= 40"))
def _(spark, d):
    path = tables.write_skipped(P.split_by_depth(C.base_rows(spark, d), 40)[1], stage_path(spark, "matrix"))
    return tables.read_tsv(spark, path).select("CHR", F.col("POS").cast("bigint").alias("POS"), F.col("DEPTH").cast("bigint").alias("DEPTH"))


@C.query("barcodes_file", C.SQL["barcode_ids"])
def _(spark, d):
    rows = C.table(spark, d, "customer").select("c_custkey", F.concat(F.lit(" "), "c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string")).alias("value"))
    return tables.read_barcodes(spark, lines(rows, "c_custkey"))


@C.query("barcodes_list", "SELECT n_name AS barcode, cast(max(n_nationkey) AS bigint) AS cell_id FROM nation GROUP BY n_name")
def _(spark, d):
    names = C.table(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 rows
    return tables.barcodes_from(spark, [r.n_name for r in names])


@C.query("known_sites_file", f"SELECT DISTINCT concat({C.CONTIG.format(k='p_partkey')}, ':', cast(p_partkey + 1 AS string)) AS site, {C.CONTIG.format(k='p_partkey')} AS contig, p_partkey + 1 AS pos FROM part WHERE p_size <= 10")
def _(spark, d):
    path = stage_path(spark, "known")
    tables.write_tsv(C.known_sites(spark, d).select(F.col("contig").alias("CHR"), F.split("site", ":")[1].alias("POS")), path)
    return tables.read_known_sites(spark, path)


@C.query("bed_file", f"WITH {C.INTERVALS} SELECT contig, start, stop FROM iv")
def _(spark, d):
    rows = C.intervals(spark, d).select(F.concat_ws("\t", "contig", "start", "stop", F.lit("name")).alias("value"))
    header = spark.range(25).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("contig"))
    return known_contigs(tables.read_bed(spark, lines(rows)), header)


@C.query("vcf_file", f"WITH {C.INTERVALS} SELECT contig, start, start + 1 AS stop FROM iv")
def _(spark, d):
    rows = C.intervals(spark, d).select(F.concat_ws("\t", "contig", F.col("start") + 1, F.lit("."), F.lit("A"), F.lit("G")).alias("value"))
    return tables.read_vcf(spark, lines(rows.union(spark.range(1).select(F.lit("##fileformat=VCFv4.2").alias("value")))))


@C.query("site_list_file", f"SELECT {C.CONTIG.format(k='p_partkey')} AS contig, p_partkey AS pos FROM part")
def _(spark, d):
    path = f"{stage_path(spark, 'sites')}.tsv"
    tables.write_tsv(C.table(spark, d, "part").selectExpr(f"{C.CONTIG.format(k='p_partkey')} AS REF", "p_partkey AS POS"), path)
    return tables.read_site_list(spark, path)


@C.query("annotations_file", f"SELECT concat({C.CONTIG.format(k='p_partkey')}, ':', cast(p_partkey + 1 AS string)) AS site, {C.REF.format(k='p_partkey')} AS ref, cast(p_size AS string) AS size FROM part")
def _(spark, d):
    path = f"{stage_path(spark, 'notes')}.tsv"
    k = "p_partkey"
    tables.write_tsv(C.table(spark, d, "part").selectExpr(f"concat({C.CONTIG.format(k=k)}, ':', cast({k} + 1 AS string)) AS name", f"{C.REF.format(k=k)} AS REF", "p_size AS Size"), path)
    entry = tables.read_annotations(spark, path).select("site", lower_keys(F.col("entry")).alias("entry"))
    return entry.select("site", F.col("entry")["ref"].alias("ref"), F.col("entry")["size"].alias("size"))


GENOME = f"genome AS (SELECT concat('s', cast(p_size AS string)) AS contig, cast(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS bigint) AS pos, {C.REF.format(k='p_partkey')} AS base FROM part)"


@C.query("fasta_bases", f"WITH {GENOME} SELECT contig, pos, base FROM genome UNION ALL SELECT contig, max(pos) + 1 AS pos, 'N' AS base FROM genome GROUP BY contig")
def _(spark, d):
    parts = C.table(spark, d, "part").selectExpr("p_size", "p_partkey", f"{C.REF.format(k='p_partkey')} AS base")
    whole = parts.groupBy("p_size").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "base"))), lambda x: x.base), "").alias("seq"))
    rows = whole.select("p_size", "seq", F.explode(F.sequence(F.lit(-60), F.length("seq") - 1, F.lit(60))).alias("at"))
    path = lines(rows.withColumn("value", F.when(F.col("at") < 0, F.concat(F.lit(">s"), F.col("p_size").cast("string"), F.lit(" of a size"))).otherwise(F.lower(F.substring("seq", F.col("at") + 1, F.lit(60))))), "p_size", "at")
    asked = whole.select(F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("contig"), F.explode(F.sequence(F.lit(1).cast("bigint"), (F.length("seq") + 1).cast("bigint"))).alias("pos"))
    return fasta.as_reference(fasta.read_fasta(spark, path, 64), asked, 64).select("contig", "pos", "base")


@C.query("fai_contigs", "SELECT cast(n_nationkey AS bigint) AS tid, n_name AS contig, cast(n_regionkey + 100 AS bigint) AS length FROM nation")
def _(spark, d):
    rows = C.table(spark, d, "nation").select("n_nationkey", F.concat_ws("\t", "n_name", F.col("n_regionkey") + 100, F.lit("6"), F.lit("60"), F.lit("61")).alias("value"))
    return fasta.contig_names(spark, lines(rows, "n_nationkey")).select("tid", "contig", "length")


@C.query("matrix_files", C.matrix_sql(select=f"SELECT site, cell_id, {', '.join(BASE_LAYERS)} FROM counts"))
def _(spark, d):
    path = stage_path(spark, "matrix")
    matrices.write_matrix(C.stored(spark, d), path)
    return C.with_names(matrices.read_matrix(spark, path), *BASE_LAYERS)


@C.query("sam_pileup", C.sql(C.PILE.replace("FROM bases)", "FROM bases WHERE NOT is_del AND NOT is_refskip)", 1), select=f"SELECT {C.PILE_COLUMNS} FROM pile"))
def _(spark, d):
    """Base rows as reads of one base, in SAM."""
    rows = C.base_rows(spark, d).where("not is_del and not is_refskip")
    fields = [F.lit("r"), F.when(F.col("is_reverse"), "16").otherwise("0"), "contig", F.col("pos").cast("string"), F.col("mapq").cast("string"), F.lit("1M"), F.lit("*"), F.lit("0"), F.lit("0"), "base", F.char(F.col("baseq") + 33), F.concat(F.lit("CB:Z:"), "cb"), F.concat(F.lit("UB:Z:"), "umi")]
    reads = bam.read_sam(spark, lines(rows.select(F.concat_ws("\t", *fields).alias("value"))))
    return P.pileup(explode_reads(reads)).select(F.col("contig"), (F.col("pos") + 1).alias("pos"), *P.COUNTS)


@C.query("sam_tags", C.sql(select=f"SELECT concat('CELL', cast(cell_id AS string)) AS cb, umi, {C.N('true')} AS n FROM bases GROUP BY cell_id, umi"))
def _(spark, d):
    rows = C.base_rows(spark, d).select(F.concat_ws("\t", F.lit("r"), F.lit("0"), "contig", F.col("pos").cast("string"), F.lit("255"), F.lit("1M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("A"), F.lit("I"), F.concat(F.lit("XC:Z:"), "cb"), F.concat(F.lit("XU:Z:"), "umi")).alias("value"))
    return C.with_clean_tags(bam.read_sam(spark, lines(rows), "XC", "XU")).groupBy("cb", "umi").agg(F.count("*").alias("n"))


@C.query("standard_contig_header", f"SELECT tid, contig FROM (SELECT {C.CONTIG.format(k='p_partkey')} AS contig, min(p_partkey) AS tid FROM part GROUP BY 1) x WHERE {C.STANDARD}")
def _(spark, d):
    header = C.table(spark, d, "part").groupBy(F.expr(C.CONTIG.format(k="p_partkey")).alias("contig")).agg(F.min("p_partkey").alias("tid"))
    return standard_contigs(header).select("tid", "contig")


@C.query("usable_bases_missing_quality", C.sql(select=f"SELECT contig, pos, {C.N('true')} AS n FROM bases WHERE mapq >= 255 AND NOT is_del AND NOT is_refskip AND (pos % 5 = 0 OR baseq >= 30) AND base IN ('A', 'C', 'G', 'T') GROUP BY contig, pos"))
def _(spark, d):
    rows = C.base_rows(spark, d).withColumn("baseq", F.when(F.col("pos") % 5 != 0, F.col("baseq")))
    return usable_bases(rows, missing_baseq_passes=True).groupBy("contig", "pos").agg(F.count("*").alias("n"))


@C.query("cells_without_umi", C.sql("ok AS (SELECT contig, pos, cell_id, CASE WHEN pos % 5 = 0 THEN '-' ELSE umi END AS umi, base, is_reverse FROM bases WHERE mapq >= 255 AND NOT is_del AND NOT is_refskip AND baseq >= 30 AND base IN ('A', 'C', 'G', 'T'))", select=f"SELECT contig, pos, cell_id, umi, {C.N('true')} AS n FROM ok GROUP BY contig, pos, cell_id, umi"))
def _(spark, d):
    rows = C.with_clean_tags(C.base_rows(spark, d)).withColumn("umi", F.when(F.col("pos") % 5 != 0, F.col("umi")))
    return U.join_cells(usable_bases(rows, missing_umi="pool"), C.barcodes(spark)).groupBy("contig", "pos", "cell_id", "umi").agg(F.count("*").alias("n"))
