"""Operators on a matrix's sites: known sites, coverage, levels of each base, reference bases."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.errors import EmptyData
from sitewright.functions.tags import as_u32, first_base
from sitewright.operators.container import SiteMatrix
from sitewright.schema import BASES, MIN_COVERAGE


def mark_known_sites(matrix: SiteMatrix, known: DataFrame) -> SiteMatrix:
    """Adds is_editing_site to var; no row goes. known: (site)."""
    flags = known.select("site").distinct().withColumn("__known", F.lit(True))
    var = matrix.var.join(flags, "site", "left").withColumn("is_editing_site", F.coalesce("__known", F.lit(False))).drop("__known")
    return replace(matrix, var=var)


def filter_by_coverage(matrix: SiteMatrix, min_coverage: int = MIN_COVERAGE, must_keep: bool = True) -> SiteMatrix:
    """Sites of contigs named chr* whose coverage is enough. The layer `coverage` is added if it isn't there."""
    matrix = matrix if "coverage" in matrix.layers else matrix.with_coverage()
    covered = matrix.entries.groupBy("site_id").agg(as_u32(F.sum("coverage")).alias("__cov")).where(F.col("__cov") >= min_coverage)
    candidates = matrix.var.where(F.startswith("site", F.lit("chr"))).select("site_id")
    keep = candidates.join(covered, "site_id", "left_semi") if min_coverage > 0 else candidates
    if must_keep and keep.isEmpty():
        raise EmptyData("no site has enough coverage")
    return matrix.with_sites(keep)


def base_levels(matrix: SiteMatrix, strand_mode: str = "forward") -> SiteMatrix:
    """Adds A, T, G, C and Coverage to var, from the forward layers, or with strand_mode='both' from both."""
    count = {b: matrix.value(b + "1") + (matrix.value(b + "0") if strand_mode == "both" else F.lit(0)) for b in BASES}
    sums = matrix.entries.groupBy("site_id").agg(*(as_u32(F.sum(count[b])).alias(b) for b in BASES))
    var = matrix.var.drop(*BASES, "Coverage").join(sums, "site_id", "left")
    var = var.withColumns({b: F.coalesce(b, F.lit(0).cast("bigint")) for b in BASES})
    return replace(matrix, var=var.withColumn("Coverage", as_u32(sum((F.col(b) for b in BASES), F.lit(0)))))


def strand_levels(matrix: SiteMatrix) -> SiteMatrix:
    """Adds A_P ... C_N, A ... C of both strands, CoverageP and CoverageN to var."""
    sums = matrix.entries.groupBy("site_id").agg(*(F.sum(matrix.value(b + layer)).alias(f"{b}_{name}") for layer, name in (("1", "P"), ("0", "N")) for b in BASES))
    names = [f"{b}_{s}" for s in "PN" for b in BASES]
    var = matrix.var.drop(*names, *BASES, "CoverageP", "CoverageN").join(sums, "site_id", "left")
    var = var.withColumns({n: F.coalesce(n, F.lit(0).cast("bigint")) for n in names})
    var = var.withColumns({b: F.col(f"{b}_P") + F.col(f"{b}_N") for b in BASES})
    return replace(matrix, var=var.withColumns({f"Coverage{s}": sum((F.col(f"{b}_{s}") for b in BASES), F.lit(0)) for s in "PN"}))


def add_reference(matrix: SiteMatrix, reference: DataFrame) -> SiteMatrix:
    """Adds ref to var from reference (contig, pos, base), pos counted from 1; N where it has none."""
    bases = reference.select("contig", "pos", first_base(F.upper("base")).alias("ref")).dropDuplicates(["contig", "pos"])
    var = matrix.var.drop("ref").join(bases, ["contig", "pos"], "left")
    return replace(matrix, var=var.withColumn("ref", F.when(F.col("ref").isin(*BASES), F.col("ref")).otherwise("N")))


def valid_positions(positions: DataFrame, reference: DataFrame) -> DataFrame:
    """positions (contig, pos) with `valid`: whether the reference has a base there."""
    bases = reference.where(F.upper("base").isin(*BASES)).select("contig", "pos").dropDuplicates().withColumn("__there", F.lit(True))
    return positions.join(bases, ["contig", "pos"], "left").withColumn("valid", F.coalesce("__there", F.lit(False))).drop("__there")


def filter_known(known: DataFrame, min_name_length: int = 0, allowed: list[str] | None = None) -> DataFrame:
    """Known sites (site, contig) whose contig is allowed and whose name is long enough; none left is an error."""
    kept = known.where(F.length("contig") >= min_name_length)
    kept = kept if allowed is None else kept.where(F.col("contig").isin(*allowed))
    if kept.isEmpty():
        raise EmptyData("no known site is left")
    return kept
