"""Queries over the driver's tables, one for each operator, and the same in SQL.

The tables hold no sequencing data. `lineitem` stands for base rows (a part is a site, a supplier a cell, a quantity a
molecule), `orders` for intervals, `part` for known sites and references, `customer` for cells with groups.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import BulkConfig, CallConfig, MatrixConfig
from sitewright.functions.editing import EditingType
from sitewright.functions.tags import clean_tag, float_to_u32, infer_ref, site_contig, site_id, site_pos
from sitewright.operators import editing_calls as E
from sitewright.operators import intervals as I
from sitewright.operators import legacy as L
from sitewright.operators import pileup as P
from sitewright.operators import sites as S
from sitewright.operators import sparse as X
from sitewright.operators import umi as U
from sitewright.operators.bases import is_standard_contig, usable_bases, with_clean_tags
from sitewright.operators.container import SiteMatrix, assemble, numbered, triplet_layers
from sitewright.plans.bulk import bulk_sites
from sitewright.plans.call import call_editing
from sitewright.plans.matrix import cell_matrix, two_pass_matrix
from sitewright.schema import BASE_LAYERS, BASES, FORWARD_LAYERS, STANDARD_CONTIGS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

CONTIG = "CASE WHEN {k} % 50 = 0 THEN 'chrUn_1' WHEN {k} % 50 = 25 THEN 'GL000192' ELSE concat('chr', cast(1 + {k} % 22 AS string)) END"
REF = "CASE {k} % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END"
BASE_ROWS = f"""
    SELECT contig, pos, cell_id, umi, mapq, baseq, is_reverse, is_del, is_refskip, ref,
           CASE WHEN disc <= 6 THEN ref
                WHEN disc <= 8 THEN CASE ref WHEN 'A' THEN 'G' WHEN 'G' THEN 'A' WHEN 'C' THEN 'T' ELSE 'C' END
                WHEN disc = 9 THEN CASE ref WHEN 'A' THEN 'C' WHEN 'C' THEN 'A' WHEN 'G' THEN 'T' ELSE 'G' END
                ELSE 'N' END AS base
    FROM (SELECT {CONTIG.format(k='l_partkey')} AS contig, l_partkey + 1 AS pos, cast(l_suppkey % 10 AS bigint) AS cell_id,
                 concat('U', cast(cast(l_quantity AS int) % 4 AS string)) AS umi,
                 CASE WHEN l_tax > 0.075 THEN 3 ELSE 255 END AS mapq, 20 + cast(l_quantity AS int) AS baseq,
                 l_linestatus = 'F' AS is_reverse, day(l_shipdate) = 1 AS is_del, day(l_shipdate) = 2 AS is_refskip,
                 {REF.format(k='l_partkey')} AS ref, cast(round(l_discount * 100) AS int) AS disc
          FROM lineitem) x
"""


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def base_rows(spark: SparkSession, d: str) -> DataFrame:
    """Base rows with tags as reads carry them."""
    rows = spark.sql(BASE_ROWS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    return rows.withColumns({"cb": F.concat(F.lit("CELL"), F.col("cell_id").cast("string"), F.lit("-1"))}).drop("cell_id")


def barcodes(spark: SparkSession) -> DataFrame:
    return spark.range(10).select(F.concat(F.lit("CELL"), F.col("id").cast("string")).alias("barcode"), F.col("id").alias("cell_id"))


def reference(spark: SparkSession, d: str) -> DataFrame:
    """(contig, pos, base) for most sites; every seventh is missing."""
    k = "p_partkey"
    return table(spark, d, "part").where(f"{k} % 7 <> 0").selectExpr(f"{CONTIG.format(k=k)} AS contig", f"{k} + 1 AS pos", f"{REF.format(k=k)} AS base")


def known_sites(spark: SparkSession, d: str) -> DataFrame:
    k = "p_partkey"
    return table(spark, d, "part").where("p_size <= 10").selectExpr(f"concat({CONTIG.format(k=k)}, ':', cast({k} + 1 AS string)) AS site", f"{CONTIG.format(k=k)} AS contig")


def usable(spark: SparkSession, d: str) -> DataFrame:
    return U.join_cells(usable_bases(with_clean_tags(base_rows(spark, d))), barcodes(spark))


def counts(spark: SparkSession, d: str, stranded: bool) -> DataFrame:
    return U.cell_site_counts(U.umi_consensus(usable(spark, d), stranded), stranded)


def matrix(spark: SparkSession, d: str, stranded: bool = True, stored: bool = False) -> SiteMatrix:
    sites = base_rows(spark, d).select("contig", "pos").distinct()
    return assemble(counts(spark, d, stranded), sites, barcodes(spark), stranded, stored)


def stored(spark: SparkSession, d: str) -> SiteMatrix:
    """The stranded matrix, written once: for queries that read it more than once."""
    return matrix(spark, d, stored=True)


def with_names(m: SiteMatrix, *columns: str) -> DataFrame:
    """Entries with the site's name in place of its number."""
    return m.entries.join(m.var.select("site_id", "site"), "site_id").select("site", "cell_id", *columns)


def intervals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("concat('c', cast(o_custkey % 25 AS string)) AS contig", "o_orderkey % 7919 AS start", "o_orderkey % 7919 + cast(floor(o_totalprice) AS bigint) % 20 + 1 AS stop")


def triplets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_suppkey AS row", "l_partkey AS col", "cast(l_linenumber AS bigint) AS value")


# --- the same in SQL: named pieces

def usable_sql(mapq: int = 255, baseq: int = 30) -> str:
    return f"usable AS (SELECT * FROM bases WHERE mapq >= {mapq} AND NOT is_del AND NOT is_refskip AND baseq >= {baseq} AND base IN ('A', 'C', 'G', 'T'))"


USABLE = usable_sql()
CODE = "CASE base WHEN 'A' THEN 0 WHEN 'T' THEN 1 WHEN 'G' THEN 2 ELSE 3 END"
N = lambda test: f"cast(count(CASE WHEN {test} THEN 1 END) AS bigint)"


def calls(stranded: bool) -> str:
    code = f"2 * {CODE} + CASE WHEN is_reverse THEN 1 ELSE 0 END" if stranded else CODE
    return f"calls AS (SELECT contig, pos, cell_id, umi, min({code}) AS low, max({code}) AS high FROM usable GROUP BY contig, pos, cell_id, umi), cons AS (SELECT contig, pos, cell_id, umi, low AS code FROM calls WHERE low = high)"


def counted(stranded: bool) -> str:
    layers = {name: (2 * k if stranded else k) for k, name in enumerate(FORWARD_LAYERS)}
    if stranded:
        layers |= {b + "0": 2 * k + 1 for k, b in enumerate(BASES)}
    return f"counts AS (SELECT concat(contig, ':', cast(pos AS string)) AS site, contig, pos, cell_id, {', '.join(f'{N(f"code = {c}")} AS {n}' for n, c in layers.items())} FROM cons GROUP BY contig, pos, cell_id)"


def sql(*parts: str, select: str) -> str:
    return f"WITH bases AS ({BASE_ROWS}), {', '.join((*parts, ''))}".rstrip(", ") + f" {select}"


def matrix_sql(*parts: str, select: str, stranded: bool = True) -> str:
    return sql(USABLE, calls(stranded), counted(stranded), *parts, select=select)


def pile_sql(mapq: int = 255, baseq: int = 30) -> str:
    kind = f"CASE WHEN mapq < {mapq} THEN 'fail' WHEN is_refskip THEN 'refskip' WHEN is_del THEN 'del' WHEN baseq < {baseq} THEN 'N' ELSE base END"
    return f"""kinds AS (SELECT contig, pos, {kind} AS kind FROM bases),
    pile AS (SELECT contig, pos, {N("kind NOT IN ('fail', 'refskip')")} AS DEPTH, {', '.join(f'{N(f"kind = '{b}'")} AS {b}' for b in 'ACGTN')}, cast(0 AS bigint) AS INS,
                    {N("kind = 'del'")} AS DEL, {N("kind = 'refskip'")} AS REF_SKIP, {N("kind = 'fail'")} AS FAIL FROM kinds GROUP BY contig, pos)"""


def edited_sql(depth: int = 10, n_fraction: int = 20, threshold: int = 1000) -> str:
    return f"DEPTH >= {depth} AND N <= greatest(DEPTH // {n_fraction}, 2) AND (" + " + ".join(f"CASE WHEN {b} > greatest(DEPTH // {threshold}, 2) THEN 1 ELSE 0 END" for b in "ATGC") + ") >= 2"


PILE, EDITED = pile_sql(), edited_sql()
STANDARD = f"lower(contig) IN ({', '.join(repr(c.lower()) for c in STANDARD_CONTIGS)})"
NEAR_RAW = "(DEPTH + REF_SKIP + FAIL) * 101 >= {cap} * 100"
ALL8 = " + ".join(BASE_LAYERS)
COVERED = f"cov AS (SELECT site, contig, pos, sum({ALL8}) AS cov FROM counts GROUP BY site, contig, pos), kept AS (SELECT * FROM cov WHERE site LIKE 'chr%' AND cov >= 5)"
LEVELS = "levels AS (SELECT site, contig, pos, " + ", ".join(f"cast(sum({b}1) AS bigint) AS {b}" for b in BASES) + ", cast(sum(A1 + T1 + G1 + C1) AS bigint) AS Coverage FROM counts SEMI JOIN kept USING (site) GROUP BY site, contig, pos)"
REFERENCE = f"reference AS (SELECT {CONTIG.format(k='p_partkey')} AS contig, p_partkey + 1 AS pos, {REF.format(k='p_partkey')} AS base FROM part WHERE p_partkey % 7 <> 0)"
KNOWN = f"known AS (SELECT DISTINCT concat({CONTIG.format(k='p_partkey')}, ':', cast(p_partkey + 1 AS string)) AS site, {CONTIG.format(k='p_partkey')} AS contig FROM part WHERE p_size <= 10)"
NAMED = "named AS (SELECT levels.*, coalesce(reference.base, 'N') AS ref FROM levels LEFT JOIN reference USING (contig, pos))"
LIMIT = "ceil(cast(cast(0.01 AS float) * cast(Coverage AS float) AS float))"
CLASSED = f"""sided AS (SELECT *, CASE ref WHEN 'A' THEN A WHEN 'T' THEN T WHEN 'G' THEN G WHEN 'C' THEN C ELSE 0 END AS own,
        greatest({', '.join(f"CASE WHEN ref = '{b}' THEN -1 ELSE {b} END" for b in BASES)}) AS top FROM named),
    classed AS (SELECT *, CASE WHEN ref = 'N' OR Coverage < 1 OR own < greatest({LIMIT}, 1) OR A + T + G + C - own - top > {LIMIT} OR top < greatest({LIMIT}, 1) THEN '-'
        ELSE concat(ref, CASE {' '.join(f"WHEN ref <> '{b}' AND {b} = top THEN '{b}'" for b in BASES)} END) END AS Mismatch FROM sided)"""


def alt_sql(editing: EditingType) -> str:
    return "CASE ref " + " ".join(f"WHEN '{b}' THEN '{editing.alt_of(b)}'" for b in editing.allowed_refs) + " ELSE 'N' END"


def split_sql(editing: EditingType) -> str:
    refs = ", ".join(f"'{b}'" for b in editing.allowed_refs)
    pick = lambda test: "cast(" + " + ".join(f"CASE WHEN {test(b)} THEN {b}1 + {b}0 ELSE 0 END" for b in BASES) + " AS bigint)"
    alt = alt_sql(editing)
    return f"""typed AS (SELECT * FROM classed WHERE ref IN ({refs})),
        split AS (SELECT site, cell_id, {pick(lambda b: f"ref = '{b}'")} AS ref, {pick(lambda b: f"ref <> '{b}' AND {alt} = '{b}'")} AS alt, {pick(lambda b: f"ref <> '{b}' AND {alt} <> '{b}'")} AS others
                  FROM counts JOIN (SELECT site, ref FROM typed) t USING (site))"""


CALL = (COVERED, LEVELS, REFERENCE, NAMED, CLASSED)
CELLS = "cells AS (SELECT DISTINCT cell_id FROM counts), sums AS (SELECT cell_id, cast(coalesce(sum(ref), 0) AS bigint) AS ref, cast(coalesce(sum(alt), 0) AS bigint) AS alt, cast(coalesce(sum(others), 0) AS bigint) AS others FROM cells LEFT JOIN split USING (cell_id) GROUP BY cell_id)"
INTERVALS = "iv AS (SELECT concat('c', cast(o_custkey % 25 AS string)) AS contig, o_orderkey % 7919 AS start, o_orderkey % 7919 + cast(floor(o_totalprice) AS bigint) % 20 + 1 AS stop FROM orders)"
# Equal rows would get other places in each of the two windows, so each row is taken once.
MERGED = """ordered AS (SELECT *, max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT contig, start, stop FROM {src}) different),
    marked AS (SELECT *, sum(CASE WHEN start <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY contig ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM ordered),
    merged AS (SELECT contig, min(start) AS start, max(stop) AS stop FROM marked GROUP BY contig, island)"""
TRIPLETS = "trip AS (SELECT l_suppkey AS row, l_partkey AS col, cast(sum(l_linenumber) AS bigint) AS value FROM lineitem GROUP BY l_suppkey, l_partkey)"


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            SQL[name] = oracle
        return f

    return keep


# --- pileup and bulk

PILE_COLUMNS = "contig, pos, DEPTH, A, C, G, T, N, INS, DEL, REF_SKIP, FAIL"


@query("pileup_counts", sql(PILE, select=f"SELECT {PILE_COLUMNS} FROM pile"))
def _(spark, d):
    return P.pileup(base_rows(spark, d))


@query("bulk_sites", sql(PILE, select=f"SELECT {PILE_COLUMNS}, {NEAR_RAW.format(cap=8000)} AS NEAR_MAX_DEPTH FROM pile WHERE {STANDARD} AND {EDITED}"))
def bulk(spark, d):
    return bulk_sites(base_rows(spark, d))


@query("bulk_sites_all", sql(PILE, select=f"SELECT {PILE_COLUMNS}, {NEAR_RAW.format(cap=8000)} AS NEAR_MAX_DEPTH FROM pile WHERE {STANDARD} AND DEPTH >= 10"))
def _(spark, d):
    return bulk_sites(base_rows(spark, d), BulkConfig(all_sites=True))


@query("bulk_sites_all_contigs", sql(PILE, select=f"SELECT {PILE_COLUMNS}, {NEAR_RAW.format(cap=8000)} AS NEAR_MAX_DEPTH FROM pile WHERE {EDITED}"))
def _(spark, d):
    return bulk_sites(base_rows(spark, d), BulkConfig(all_contigs=True))


@query("bulk_sites_canonical", sql(select=f"SELECT contig, cast(count(DISTINCT pos) AS bigint) AS sites FROM bases WHERE {STANDARD} GROUP BY contig"))
def _(spark, d):
    return base_rows(spark, d).where(is_standard_contig()).groupBy("contig").agg(F.count_distinct("pos").alias("sites"))


@query("near_max_raw", sql(PILE, select=f"SELECT contig, pos, DEPTH, {NEAR_RAW.format(cap=35)} AS near FROM pile"))
def _(spark, d):
    return P.pileup(base_rows(spark, d)).select("contig", "pos", "DEPTH", P.near_max_depth(35).alias("near"))


@query("near_max_filtered", sql(PILE, select="SELECT contig, pos, DEPTH, DEPTH * 101 >= 35 * 100 AS near FROM pile"))
def _(spark, d):
    return P.pileup(base_rows(spark, d)).select("contig", "pos", "DEPTH", P.near_max_depth(35, raw=False).alias("near"))


@query("positions_as_bed", sql(PILE, select="SELECT contig AS chrom, pos AS chromStart, pos + 1 AS chromEnd, '' AS name, DEPTH AS score FROM pile"))
def _(spark, d):
    return P.as_ranges(P.pileup(base_rows(spark, d)))


@query("read_filter", sql(select=f"SELECT mapq >= 255 AS passes, {N('true')} AS n FROM bases GROUP BY mapq >= 255"))
def _(spark, d):
    return base_rows(spark, d).groupBy((F.col("mapq") >= 255).alias("passes")).agg(F.count("*").alias("n"))


@query("skipped_sites", sql(f"depth AS (SELECT contig, pos, {N('true')} AS DEPTH FROM bases GROUP BY contig, pos)", select="SELECT * FROM depth WHERE DEPTH >= 40"))
def _(spark, d):
    return P.split_by_depth(base_rows(spark, d), 40)[1]


# --- molecules


@query("usable_bases", sql(USABLE, select=f"SELECT contig, pos, cell_id, base, {N('true')} AS n FROM usable GROUP BY contig, pos, cell_id, base"))
def _(spark, d):
    return usable(spark, d).groupBy("contig", "pos", "cell_id", "base").agg(F.count("*").alias("n"))


for _stranded, _name in ((True, "stranded"), (False, "unstranded")):

    @query(f"umi_consensus_{_name}", sql(USABLE, calls(_stranded), select="SELECT contig, pos, cell_id, umi, cast(code AS int) AS code FROM cons"))
    def _(spark, d, stranded=_stranded):
        return U.umi_consensus(usable(spark, d), stranded)

    @query(f"umi_conflict_rate_{_name}", sql(USABLE, calls(_stranded), select=f"SELECT {N('true')} AS molecules, {N('low <> high')} AS conflicts FROM calls"))
    def _(spark, d, stranded=_stranded):
        return U.umi_calls(usable(spark, d), stranded).agg(F.count("*").alias("molecules"), F.count_if(F.col("low") != F.col("high")).alias("conflicts"))

    @query(f"cell_site_counts_{_name}", matrix_sql(select=f"SELECT contig, pos, cell_id, {', '.join(BASE_LAYERS if _stranded else FORWARD_LAYERS)} FROM counts", stranded=_stranded))
    def _(spark, d, stranded=_stranded):
        return counts(spark, d, stranded)

    @query(f"call_counts_{_name}", sql(USABLE, calls(_stranded), select=f"SELECT contig, pos, cell_id, cast(code AS int) AS code, {N('true')} AS n FROM cons GROUP BY contig, pos, cell_id, code"))
    def _(spark, d, stranded=_stranded):
        return U.call_counts(U.umi_consensus(usable(spark, d), stranded))


@query("barcode_clean", "SELECT c_custkey, nullif(trim(split_part(CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_name, ' -1') WHEN 1 THEN concat(c_mktsegment, '-', c_name) WHEN 2 THEN '-1' ELSE c_name END, '-', 1)), '') AS tag FROM (SELECT c_custkey, replace(c_name, '#', ':') AS c_name, c_mktsegment FROM customer) x")
def _(spark, d):
    rows = table(spark, d, "customer").withColumn("c_name", F.replace("c_name", F.lit("#"), F.lit(":")))
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat(' ', c_name, ' -1') WHEN 1 THEN concat(c_mktsegment, '-', c_name) WHEN 2 THEN '-1' ELSE c_name END")
    return rows.select("c_custkey", clean_tag(raw).alias("tag"))


@query("barcode_ids", "SELECT c_mktsegment AS barcode, cast(row_number() OVER (ORDER BY min(c_custkey)) - 1 AS bigint) AS cell_id FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    return numbered(table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("barcode")).agg(F.min("c_custkey").alias("place")), ["place"], "cell_id").select("barcode", "cell_id")


@query("barcode_join", sql(select=f"SELECT cell_id, {N('true')} AS n FROM bases WHERE cell_id < 7 GROUP BY cell_id"))
def _(spark, d):
    return U.join_cells(with_clean_tags(base_rows(spark, d)), barcodes(spark).where("cell_id < 7")).groupBy("cell_id").agg(F.count("*").alias("n"))


@query("site_join", sql(KNOWN, select=f"SELECT contig, pos, {N('true')} AS n FROM bases WHERE concat(contig, ':', cast(pos AS string)) IN (SELECT site FROM known) GROUP BY contig, pos"))
def _(spark, d):
    sites = known_sites(spark, d).select(site_contig(F.col("site")).alias("contig"), site_pos(F.col("site")).alias("pos"))
    return U.join_sites(base_rows(spark, d), sites).groupBy("contig", "pos").agg(F.count("*").alias("n"))


# --- the matrix


@query("coverage_layer", matrix_sql(select=f"SELECT site, cell_id, cast({ALL8} AS bigint) AS coverage FROM counts"))
def _(spark, d):
    return with_names(matrix(spark, d).with_coverage(), "coverage")


@query("total_coverage_by_cell", matrix_sql(select=f"SELECT cell_id, cast(sum({ALL8}) AS bigint) AS total FROM counts GROUP BY cell_id"))
def _(spark, d):
    return matrix(spark, d).total_coverage()


@query("coverage_filter", matrix_sql(COVERED, select="SELECT site FROM kept"))
def _(spark, d):
    return S.filter_by_coverage(stored(spark, d), must_keep=False).var.select("site")


@query("layer_row_sums", matrix_sql(select="SELECT cell_id, cast(sum(G1) AS bigint) AS total FROM counts GROUP BY cell_id"))
def _(spark, d):
    return matrix(spark, d).row_sums("G1")


@query("layer_col_sums", matrix_sql("allsites AS (SELECT DISTINCT concat(contig, ':', cast(pos AS string)) AS site FROM bases)", select="SELECT site, cast(coalesce(sum(G0), 0) AS bigint) AS total FROM allsites LEFT JOIN counts USING (site) GROUP BY site"))
def _(spark, d):
    m = matrix(spark, d)
    return m.col_sums("G0").join(m.var.select("site_id", "site"), "site_id").select("site", "total")


@query("base_levels_forward", matrix_sql(COVERED, LEVELS, select="SELECT site, A, T, G, C, Coverage FROM levels"))
def _(spark, d):
    return S.base_levels(S.filter_by_coverage(stored(spark, d), must_keep=False)).var.select("site", *BASES, "Coverage")


@query("base_levels_both", matrix_sql(COVERED, select="SELECT site, " + ", ".join(f"cast(sum({b}1 + {b}0) AS bigint) AS {b}" for b in BASES) + f", cast(sum({ALL8}) AS bigint) AS Coverage FROM counts SEMI JOIN kept USING (site) GROUP BY site"))
def _(spark, d):
    return S.base_levels(S.filter_by_coverage(stored(spark, d), must_keep=False), "both").var.select("site", *BASES, "Coverage")


@query("strand_levels", matrix_sql(COVERED, select="SELECT site, " + ", ".join(f"cast(sum({b}{s}) AS bigint) AS {b}_{n}" for b in BASES for s, n in (("1", "P"), ("0", "N"))) + ", cast(sum(A1 + T1 + G1 + C1) AS bigint) AS CoverageP, cast(sum(A0 + T0 + G0 + C0) AS bigint) AS CoverageN FROM counts SEMI JOIN kept USING (site) GROUP BY site"))
def _(spark, d):
    var = S.strand_levels(S.filter_by_coverage(stored(spark, d), must_keep=False)).var
    return var.select("site", *(f"{b}_{s}" for b in BASES for s in "PN"), "CoverageP", "CoverageN")


@query("known_site_flag", sql(KNOWN, "allsites AS (SELECT DISTINCT concat(contig, ':', cast(pos AS string)) AS site FROM bases)", select="SELECT site, site IN (SELECT site FROM known) AS is_editing_site FROM allsites"))
def _(spark, d):
    return S.mark_known_sites(matrix(spark, d), known_sites(spark, d)).var.select("site", "is_editing_site")


@query("known_site_filtered", f"WITH {KNOWN} SELECT site, contig FROM known WHERE length(contig) >= 5 AND contig IN ('chr1', 'chr10', 'chr11', 'chr20')")
def _(spark, d):
    return S.filter_known(known_sites(spark, d).distinct(), 5, ["chr1", "chr10", "chr11", "chr20"])


@query("ref_base_lookup", sql(REFERENCE, "allsites AS (SELECT DISTINCT contig, pos FROM bases)", select="SELECT contig, pos, coalesce(base, 'N') AS ref FROM allsites LEFT JOIN reference USING (contig, pos)"))
def _(spark, d):
    return S.add_reference(matrix(spark, d), reference(spark, d)).var.select("contig", "pos", "ref")


@query("valid_positions", sql(REFERENCE, "allsites AS (SELECT DISTINCT contig, pos FROM bases)", select="SELECT contig, pos, base IS NOT NULL AS valid FROM allsites LEFT JOIN reference USING (contig, pos)"))
def _(spark, d):
    return S.valid_positions(base_rows(spark, d).select("contig", "pos").distinct(), reference(spark, d))


def noted(spark: SparkSession, d: str) -> SiteMatrix:
    m = S.add_reference(S.base_levels(S.filter_by_coverage(stored(spark, d), must_keep=False).written("covered")), reference(spark, d))
    return replace(m, var=E.with_mismatch(m.var))


@query("mismatch_class", matrix_sql(*CALL, select="SELECT site, ref, Coverage, Mismatch FROM classed"))
def _(spark, d):
    return noted(spark, d).var.select("site", "ref", "Coverage", "Mismatch")


@query("mismatch_distribution", matrix_sql(*CALL, select=f"SELECT Mismatch, {N('true')} AS sites FROM classed GROUP BY Mismatch"))
def _(spark, d):
    return noted(spark, d).var.groupBy("Mismatch").agg(F.count("*").alias("sites"))


for _type in EditingType:

    @query(f"editing_sites_{_type}", matrix_sql(*CALL, split_sql(_type), select=f"SELECT site, ref, {alt_sql(_type)} AS alt FROM typed"))
    def _(spark, d, editing=_type):
        return E.sites_of_type(noted(spark, d), editing, must_keep=False).var.select("site", "ref", editing.alt_column(F.col("ref")).alias("alt"))


_AG = EditingType.AG


def split(spark: SparkSession, d: str, editing: EditingType = _AG) -> SiteMatrix:
    return E.ref_alt_others(E.sites_of_type(noted(spark, d), editing, must_keep=False), editing)


@query("ref_alt_others", matrix_sql(*CALL, split_sql(_AG), select="SELECT site, cell_id, ref, alt, others FROM split"))
def _(spark, d):
    return with_names(split(spark, d), "ref", "alt", "others")


@query("ref_alt_others_ct", matrix_sql(*CALL, split_sql(EditingType.CT), select="SELECT site, cell_id, ref, alt, others FROM split"))
def _(spark, d):
    return with_names(split(spark, d, EditingType.CT), "ref", "alt", "others")


@query("obs_sums", matrix_sql(*CALL, split_sql(_AG), CELLS, select="SELECT cell_id, ref, alt, others FROM sums"))
def _(spark, d):
    return E.cell_sums(split(spark, d)).obs.select("cell_id", "ref", "alt", "others")


for _fill, _empty in (("nan", "'NaN'"), ("zero", "0")):

    @query(f"cei_{_fill}", matrix_sql(*CALL, split_sql(_AG), CELLS, select=f"SELECT cell_id, cast(CASE WHEN ref + alt = 0 THEN cast({_empty} AS float) ELSE cast(alt AS float) / cast(ref + alt AS float) END AS float) AS CEI FROM sums"))
    def _(spark, d, fill=_fill):
        return E.editing_index(E.cell_sums(split(spark, d)), fill).obs.select("cell_id", "CEI")


@query("site_mismatch_stats", matrix_sql(*CALL, select="SELECT site, A AS AG_ref, G AS AG_alt, T + C AS AG_others FROM classed"))
def _(spark, d):
    return E.site_stats(noted(spark, d).var, _AG).select("site", "AG_ref", "AG_alt", "AG_others")


@query("call_pipeline", matrix_sql(*CALL, KNOWN, split_sql(_AG), "bysite AS (SELECT site, cast(sum(ref) AS bigint) AS ref_total, cast(sum(alt) AS bigint) AS alt_total, cast(sum(others) AS bigint) AS others_total FROM split GROUP BY site)",
       select="SELECT site, ref, A, T, G, C, Coverage, Mismatch, site IN (SELECT site FROM known) AS is_editing_site, A AS AG_ref, G AS AG_alt, T + C AS AG_others, coalesce(ref_total, 0) AS ref_total, coalesce(alt_total, 0) AS alt_total, coalesce(others_total, 0) AS others_total FROM typed LEFT JOIN bysite USING (site)"))
def _(spark, d):
    m = call_editing(stored(spark, d), known_sites(spark, d), reference(spark, d), CallConfig(), check=False)
    totals = m.entries.groupBy("site_id").agg(*(F.sum(x).alias(f"{x}_total") for x in E.SPLITS))
    columns = ["site", "ref", *BASES, "Coverage", "Mismatch", "is_editing_site", "AG_ref", "AG_alt", "AG_others"]
    return m.var.join(totals, "site_id", "left").select(*columns, *(F.coalesce(f"{x}_total", F.lit(0)).cast("bigint").alias(f"{x}_total") for x in E.SPLITS))


@query("two_pass_matrix", sql(PILE, f"chosen AS (SELECT contig, pos FROM pile WHERE {STANDARD} AND {EDITED})", USABLE.replace("FROM bases", "FROM bases SEMI JOIN chosen USING (contig, pos)"), calls(False), counted(False), select="SELECT site, cell_id, A1, T1, G1, C1 FROM counts"))
def _(spark, d):
    m, _skipped = two_pass_matrix(with_clean_tags(base_rows(spark, d)), barcodes(spark), MatrixConfig())
    return with_names(m, *FORWARD_LAYERS)


@query("two_pass_matrix_settings", sql(pile_sql(3, 25), f"chosen AS (SELECT contig, pos FROM pile WHERE {edited_sql(12, 15, 8)})", usable_sql(3, 25).replace("FROM bases", "FROM bases SEMI JOIN chosen USING (contig, pos)"), calls(True), counted(True), select=f"SELECT site, cell_id, {', '.join(BASE_LAYERS)} FROM counts"))
def _(spark, d):
    settings = MatrixConfig(min_mapq=3, min_baseq=25, all_contigs=True, stranded=True, bulk=BulkConfig(min_depth=12, max_n_fraction=15, editing_threshold=8))
    m, _skipped = two_pass_matrix(with_clean_tags(base_rows(spark, d)), barcodes(spark), settings)
    return with_names(m, *BASE_LAYERS)


@query("matrix_sites", sql(f"depth AS (SELECT contig, pos, {N('true')} AS n FROM bases WHERE {STANDARD} GROUP BY contig, pos)", select="SELECT concat(contig, ':', cast(pos AS string)) AS site, cast(row_number() OVER (ORDER BY contig, pos) - 1 AS bigint) AS site_id FROM depth WHERE n < 40"))
def _(spark, d):
    bases = with_clean_tags(base_rows(spark, d))
    m, _skipped = cell_matrix(bases, bases.select("contig", "pos"), barcodes(spark), MatrixConfig(max_depth=40))
    return m.var.select("site", "site_id")


@query("matrix_stats", matrix_sql("size AS (SELECT (SELECT count(DISTINCT cell_id) FROM counts) * (SELECT count(*) FROM (SELECT DISTINCT contig, pos FROM bases) s) AS n)", select=" UNION ALL ".join(f"SELECT '{x}' AS layer, {N(f'{x} > 0')} AS nnz, count(CASE WHEN {x} > 0 THEN 1 END) / cast(max(size.n) AS double) AS density FROM counts, size" for x in BASE_LAYERS)))
def _(spark, d):
    return matrix(spark, d).stats()


@query("layers_long", matrix_sql(select=" UNION ALL ".join(f"SELECT '{x}' AS layer, site, cell_id, {x} AS value FROM counts WHERE {x} > 0" for x in BASE_LAYERS)))
def _(spark, d):
    m = matrix(spark, d)
    return triplet_layers(m).join(m.var.select(F.col("site_id").alias("col"), "site"), "col").select("layer", "site", F.col("row").alias("cell_id"), "value")


# --- sparse algebra


@query("sparse_from_triplets", f"WITH {TRIPLETS} SELECT * FROM trip")
def _(spark, d):
    return X.from_triplets(triplets(spark, d))


@query("sparse_add", f"WITH {TRIPLETS}, twice AS (SELECT * FROM trip UNION ALL SELECT col AS row, row AS col, value FROM trip) SELECT row, col, cast(sum(value) AS bigint) AS value FROM twice GROUP BY row, col")
def _(spark, d):
    a = X.from_triplets(triplets(spark, d))
    return X.add(a, X.transpose(a))


@query("sparse_mask", f"WITH {TRIPLETS} SELECT * FROM trip WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = row AND l_partkey = col AND l_quantity > 25)")
def _(spark, d):
    other = table(spark, d, "lineitem").where("l_quantity > 25").selectExpr("l_suppkey AS row", "l_partkey AS col", "cast(l_quantity AS bigint) AS value")
    return X.mask(X.from_triplets(triplets(spark, d)), X.from_triplets(other))


@query("sparse_matvec", f"WITH {TRIPLETS} SELECT s_suppkey AS row, cast(coalesce(sum(value * p_size), 0) AS bigint) AS total FROM supplier LEFT JOIN trip ON row = s_suppkey LEFT JOIN part ON p_partkey = col GROUP BY s_suppkey")
def _(spark, d):
    vector = table(spark, d, "part").selectExpr("p_partkey AS col", "cast(p_size AS bigint) AS weight")
    return X.matvec(X.from_triplets(triplets(spark, d)), vector, table(spark, d, "supplier").selectExpr("s_suppkey AS row"))


@query("sparse_transpose", f"WITH {TRIPLETS} SELECT col AS row, row AS col, value FROM trip")
def _(spark, d):
    return X.transpose(X.from_triplets(triplets(spark, d)))


@query("sparse_row_sums", f"WITH {TRIPLETS} SELECT c_custkey AS row, cast(coalesce(sum(value), 0) AS bigint) AS total FROM customer LEFT JOIN trip ON row = c_custkey GROUP BY c_custkey")
def _(spark, d):
    return X.row_sums(X.from_triplets(triplets(spark, d)), table(spark, d, "customer").selectExpr("c_custkey AS row"))  # more customers than suppliers: rows without entries


@query("sparse_col_sums", f"WITH {TRIPLETS} SELECT o_orderkey AS col, cast(coalesce(sum(value), 0) AS bigint) AS total FROM orders LEFT JOIN trip ON col = o_orderkey GROUP BY o_orderkey")
def _(spark, d):
    return X.col_sums(X.from_triplets(triplets(spark, d)), table(spark, d, "orders").selectExpr("o_orderkey AS col"))  # more orders than parts: columns without entries


SHAPE = ", shape AS (SELECT (SELECT count(*) FROM supplier) * (SELECT count(*) FROM part) AS places)"


def axes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "supplier").selectExpr("s_suppkey AS row"), table(spark, d, "part").selectExpr("p_partkey AS col")


@query("sparse_density", f"WITH {TRIPLETS}{SHAPE} SELECT count(*) / cast(max(places) AS double) AS density, {N('true')} AS nnz, max(places) AS total FROM trip, shape")
def _(spark, d):
    return X.density(X.from_triplets(triplets(spark, d)), *axes(spark, d))


@query("sparse_threshold", f"WITH {TRIPLETS} SELECT * FROM trip WHERE value >= 5")
def _(spark, d):
    return X.threshold(X.from_triplets(triplets(spark, d)), 5)


@query("sparse_filter_columns", f"WITH {TRIPLETS}, keep AS (SELECT p_partkey AS old, cast(row_number() OVER (ORDER BY p_partkey) - 1 AS bigint) AS new FROM part WHERE p_size <= 10) SELECT row, new AS col, value FROM trip JOIN keep ON col = old")
def _(spark, d):
    keep = numbered(table(spark, d, "part").where("p_size <= 10").selectExpr("p_partkey AS old"), ["old"], "new")
    return X.filter_columns(X.from_triplets(triplets(spark, d)), keep)


@query("sparsity_percentiles", f"WITH {TRIPLETS}{SHAPE}, p AS (SELECT unnest([90.0, 95.0, 99.0, 99.9, 99.99, 99.999]::double[]) AS percentage), q AS (SELECT unnest(quantile_cont(cast(value AS double), [0.9, 0.95, 0.99, 0.999, 0.9999, 0.99999])) AS value, count(*) / cast((SELECT places FROM shape) AS double) AS stored FROM trip) SELECT percentage, value, stored FROM (SELECT percentage, row_number() OVER (ORDER BY percentage) AS k FROM p) JOIN (SELECT value, stored, row_number() OVER (ORDER BY value) AS k FROM q) USING (k)")
def _(spark, d):
    return X.sparsity_percentiles(X.from_triplets(triplets(spark, d)), *axes(spark, d))


# --- intervals


@query("interval_tiles", f"WITH {INTERVALS}, cut AS (SELECT contig, unnest(generate_series(start, stop - 1, 5)) AS start, stop FROM iv) SELECT contig, start, least(start + 5, stop) AS stop FROM cut")
def _(spark, d):
    return I.tiles(intervals(spark, d), 5)


@query("interval_header_tiles", "WITH cut AS (SELECT concat('p', cast(p_partkey AS string)) AS contig, unnest(generate_series(0, p_size - 1, 7)) AS start, p_size AS stop FROM part) SELECT contig, cast(start AS bigint) AS start, cast(least(start + 7, stop) AS bigint) AS stop FROM cut")
def _(spark, d):
    return I.header_tiles(table(spark, d, "part").selectExpr("concat('p', cast(p_partkey AS string)) AS contig", "p_size AS length"), 7)


@query("interval_merge", f"WITH {INTERVALS}, {MERGED.format(src='iv')} SELECT * FROM merged")
def _(spark, d):
    return I.merge_overlaps(intervals(spark, d), bin_size=1000)


_POINTS = "points AS (SELECT concat('c', cast(l_suppkey % 25 AS string)) AS contig, l_partkey % 8000 AS start, l_partkey % 8000 + 1 AS stop FROM lineitem)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("concat('c', cast(l_suppkey % 25 AS string)) AS contig", "l_partkey % 8000 AS start", "l_partkey % 8000 + 1 AS stop")


@query("interval_union_merge", f"WITH {INTERVALS}, {_POINTS}, u AS (SELECT * FROM iv UNION ALL SELECT * FROM points), {MERGED.format(src='u')} SELECT * FROM merged")
def _(spark, d):
    return I.union_merge(intervals(spark, d), points(spark, d))


@query("interval_restrict", f"WITH {INTERVALS}, {_POINTS}, asked AS (SELECT DISTINCT contig, start AS pos FROM points) SELECT contig, pos FROM asked WHERE EXISTS (SELECT 1 FROM iv WHERE iv.contig = asked.contig AND asked.pos >= iv.start AND asked.pos < iv.stop)")
def _(spark, d):
    asked = points(spark, d).selectExpr("contig", "start AS pos").distinct()
    return I.restrict(asked, intervals(spark, d), 64)


@query("chunk_plan", sql(PILE, f"""rows AS (SELECT contig, pos, {NEAR_RAW.format(cap=35)} AS near, CASE WHEN {NEAR_RAW.format(cap=35)} THEN 1 ELSE greatest(DEPTH + REF_SKIP + FAIL, 1) END AS weight, row_number() OVER (PARTITION BY contig ORDER BY pos) AS k FROM pile),
    walk AS (SELECT contig, pos, near, weight, k, cast(0 AS bigint) AS chunk, weight AS total FROM rows WHERE k = 1
             UNION ALL
             SELECT r.contig, r.pos, r.near, r.weight, r.k, cast(CASE WHEN w.total >= CASE WHEN w.near THEN 2 ELSE 100 END OR w.near <> r.near THEN w.chunk + 1 ELSE w.chunk END AS bigint),
                    CASE WHEN w.total >= CASE WHEN w.near THEN 2 ELSE 100 END OR w.near <> r.near THEN r.weight ELSE w.total + r.weight END
             FROM walk w JOIN rows r ON r.contig = w.contig AND r.k = w.k + 1)""", select="SELECT contig, pos, near, chunk, cast(weight AS bigint) AS weight FROM walk").replace("WITH bases", "WITH RECURSIVE bases", 1))  # fmt: skip
def _(spark, d):
    return I.chunk_plan(P.pileup(base_rows(spark, d)).withColumn("NEAR_MAX_DEPTH", P.near_max_depth(35)), 100, 2)


# --- variants of the scripts


@query("strand_specificity", sql("levels AS (SELECT contig, pos, count(CASE WHEN NOT (is_reverse AND pos % 3 = 0) THEN 1 END) AS p, count(CASE WHEN is_reverse AND pos % 3 = 0 THEN 1 END) AS n FROM bases GROUP BY contig, pos)", select=f"SELECT {N('true')} AS total, {N('p = 0 OR n = 0')} AS strict, " + ", ".join(f"{N(f'(p >= {k} * n OR n >= {k} * p) AND p + n > 0')} AS x{k}" for k in (10, 5, 2)) + " FROM levels"))
def _(spark, d):
    reverse = F.col("is_reverse") & (F.col("pos") % 3 == 0)
    var = base_rows(spark, d).groupBy("contig", "pos").agg(F.count_if(~reverse).alias("CoverageP"), F.count_if(reverse).alias("CoverageN"))
    return L.strand_specificity(var)


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey AS cell_id", "c_mktsegment AS gene", "cast(abs(c_acctbal) AS bigint) AS UMI_count", "c_acctbal / 5000 AS BUILDING")


@query("filter_by_gene", "SELECT cell_id FROM (SELECT c_custkey AS cell_id, c_mktsegment AS gene, floor(abs(c_acctbal)) AS umis, c_acctbal / 5000 AS score FROM customer) x WHERE umis >= 500 AND (gene = 'BUILDING' AND score < 0.5 OR gene = 'MACHINERY' AND score > 0.5)")
def _(spark, d):
    return L.filter_by_gene(cells(spark, d), "BUILDING", "BUILDING", "MACHINERY", umi_threshold=500, kd_threshold=0.5).select("cell_id")


@query("downsample_by_group", "SELECT cell_id, gene FROM (SELECT c_custkey AS cell_id, c_mktsegment AS gene, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(cast(c_custkey AS string), ':2025')), c_custkey) AS k FROM customer) x WHERE k <= 20")
def _(spark, d):
    return L.downsample_by_group(cells(spark, d), n=20).select("cell_id", "gene")


@query("downsample_sizes", "SELECT c_mktsegment AS gene, cast(least(count(*), 20) AS bigint) AS cells FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    return L.downsample_by_group(cells(spark, d), n=20).groupBy("gene").agg(F.count("*").alias("cells"))


_NAMES = "CASE p_partkey % 6 WHEN 0 THEN concat('chr1:', cast(p_partkey AS string), ':a') WHEN 1 THEN concat('chr1|', cast(p_partkey AS string), '|A|g') WHEN 2 THEN concat('chr2:', cast(p_partkey AS string), '-CT') WHEN 3 THEN concat('chr3:', cast(p_partkey AS string)) WHEN 4 THEN concat('T:', cast(p_partkey AS string), ': c :') ELSE 'xyz' END"


@query("infer_ref", f"SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'G' WHEN 2 THEN 'C' WHEN 4 THEN 'C' END AS ref FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", infer_ref(F.expr(_NAMES)).alias("ref"))


@query("site_names", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'chr1' END AS contig, CASE p_partkey % 4 WHEN 0 THEN p_partkey END AS pos FROM part WHERE p_partkey > 0")
def _(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('chr1:', cast(p_partkey AS string)) WHEN 1 THEN concat('chr1:-', cast(p_partkey AS string)) WHEN 2 THEN 'a:b:c' ELSE concat('chr1: ', cast(p_partkey AS string)) END")
    return table(spark, d, "part").where("p_partkey > 0").select("p_partkey", site_contig(name).alias("contig"), site_pos(name).alias("pos"))


@query("float_to_u32", "SELECT p_partkey, cast(CASE p_partkey % 4 WHEN 0 THEN floor(p_retailprice) WHEN 1 THEN 0 WHEN 2 THEN 4294967295 ELSE 0 END AS bigint) AS value FROM part")
def _(spark, d):
    x = F.expr("CASE p_partkey % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN -p_retailprice WHEN 2 THEN p_retailprice * 1e10D ELSE cast('NaN' AS double) END")
    return table(spark, d, "part").select("p_partkey", float_to_u32(x).alias("value"))


@query("script_position_counts", sql("ok AS (SELECT * FROM bases WHERE mapq >= 255 AND NOT is_del AND NOT is_refskip AND baseq >= 30)", "calls AS (SELECT contig, pos, cell_id, umi, min(concat(base, CASE WHEN is_reverse THEN '0' ELSE '1' END)) AS low, max(concat(base, CASE WHEN is_reverse THEN '0' ELSE '1' END)) AS high FROM ok GROUP BY contig, pos, cell_id, umi)", select="SELECT contig, pos, cell_id, " + ", ".join(f"{N(f"low = high AND low = '{x}'")} AS {x}" for x in BASE_LAYERS) + " FROM calls GROUP BY contig, pos, cell_id"))
def _(spark, d):
    return L.position_counts(with_clean_tags(base_rows(spark, d)), barcodes(spark), stranded=True)


def annotations(spark: SparkSession, d: str) -> DataFrame:
    k = "p_partkey"
    rows = table(spark, d, "part").selectExpr(f"concat({CONTIG.format(k=k)}, ':', cast({k} + 1 AS string)) AS site", f"{REF.format(k=k)} AS ref", "p_size")
    entry = F.map_filter(F.create_map(F.lit("REF"), F.col("ref"), F.lit("Stranded"), F.when(F.col("p_size") > 25, "True").otherwise("False"), F.lit("mismatch_plus"), F.col("p_size").cast("string")), lambda k, v: v.isNotNull())
    return rows.select("site", entry.alias("entry"))


@query("annotate_var", matrix_sql(COVERED, f"notes AS (SELECT concat({CONTIG.format(k='p_partkey')}, ':', cast(p_partkey + 1 AS string)) AS site, {REF.format(k='p_partkey')} AS ref, p_size FROM part)", select="SELECT site, true AS filter, ref, p_size > 25 AS Stranded, false AS Mismatch, cast(p_size AS bigint) AS Mismatch_P, cast(0 AS bigint) AS Mismatch_N FROM kept JOIN notes USING (site)"))
def _(spark, d):
    return L.annotate_var(stored(spark, d), annotations(spark, d)).var.select("site", "filter", "ref", "Stranded", "Mismatch", "Mismatch_P", "Mismatch_N")


@query("script_ref_alt_sums", matrix_sql(*CALL, split_sql(EditingType.CT), CELLS, select="SELECT cell_id, ref, alt, others FROM sums"))
def _(spark, d):
    return L.ref_alt_sums(noted(spark, d), "CU").select("cell_id", "ref", "alt", "others")


@query("site_ids", sql(select=f"SELECT DISTINCT contig, pos, concat(contig, ':', cast(pos AS string)) AS site FROM bases"))
def _(spark, d):
    return base_rows(spark, d).select("contig", "pos", site_id(F.col("contig"), F.col("pos")).alias("site")).distinct()


from sitewright import catalog_files  # noqa: E402, F401  (registers its queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
