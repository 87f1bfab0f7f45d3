"""Variants of the older scripts, where they differ from the commands."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.errors import InvalidInput, ReferenceLookup
from sitewright.functions.editing import EditingType
from sitewright.functions.tags import infer_ref, lower_keys
from sitewright.operators import sites, umi
from sitewright.operators.bases import usable_bases
from sitewright.operators.container import SiteMatrix
from sitewright.operators.editing_calls import cell_sums, ref_alt_others, sites_of_type
from sitewright.schema import BASES, FORWARD_LAYERS, MIN_COVERAGE, REVERSE_LAYERS


def position_counts(bases: DataFrame, barcodes: DataFrame, stranded: bool = True) -> DataFrame:
    """Counts for each (contig, pos, cell): bases without a umi are one molecule, N takes part in conflicts, and a cell stays even with no count left."""
    cells = umi.join_cells(usable_bases(bases, missing_umi="pool", drop_n=False), barcodes)
    calls = umi.umi_calls(cells, stranded, keep_n=True).select(*umi.SITE, "cell_id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("code"))
    return umi.cell_site_counts(calls, stranded, keep_empty=True)


def coverage_layer(matrix: SiteMatrix) -> SiteMatrix:
    """Coverage over all eight layers, each of which must be there."""
    missing = [layer for layer in (*FORWARD_LAYERS, *REVERSE_LAYERS) if layer not in matrix.layers]
    if missing:
        raise InvalidInput(f"layers missing: {missing}")
    return matrix.with_coverage()


def filter_base_matrix(matrix: SiteMatrix, min_coverage: int = MIN_COVERAGE) -> SiteMatrix:
    return sites.filter_by_coverage(coverage_layer(matrix), min_coverage, must_keep=False)


def strand_specificity(var: DataFrame) -> DataFrame:
    """One row: sites in all, with one strand only, and with one strand at least 10, 5 or 2 times the other."""
    plus, minus = F.col("CoverageP"), F.col("CoverageN")
    ratio = lambda k: F.count_if(((plus >= k * minus) | (minus >= k * plus)) & (plus + minus > 0))
    return var.agg(F.count("*").alias("total"), F.count_if((plus == 0) | (minus == 0)).alias("strict"), ratio(10).alias("x10"), ratio(5).alias("x5"), ratio(2).alias("x2"))


def downsample_by_group(obs: DataFrame, group: str = "gene", n: int = 50, seed: int = 2025, key: str = "cell_id") -> DataFrame:
    """At most n rows of each group: those with the least MD5 of `key:seed`, then key, so the same on any cluster.

    The n least hashes of a group need no more than n rows at a time: each of 64 parts keeps its own n first.
    """
    if group not in obs.columns:
        raise InvalidInput(f"no column {group!r}")
    rows = obs.withColumn("__hash", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    local = Window.partitionBy(group, "__part").orderBy("__hash", key)
    first = rows.withColumn("__part", F.pmod(F.xxhash64("__hash"), F.lit(64))).withColumn("__k", F.row_number().over(local)).where(F.col("__k") <= n)
    final = Window.partitionBy(group).orderBy("__hash", key)
    return first.withColumn("__k", F.row_number().over(final)).where(F.col("__k") <= n).drop("__hash", "__part", "__k")


# Names and defaults of the parameters are fixed values: calls give them by name.
def filter_by_gene(obs: DataFrame, score: str, gene: str, nt: str = "non-targeting", umi_threshold: int = 5000, gene_col: str = "gene", umi_col: str = "UMI_count", kd_threshold: float = -0.5, nt_threshold: float = 0.5) -> DataFrame:
    """Cells with enough molecules that are knocked down, or controls that aren't. score: the gene's own column."""
    down = (F.col(gene_col) == gene) & (F.col(score) < kd_threshold)
    control = (F.col(gene_col) == nt) & (F.col(score) > nt_threshold)
    return obs.where((F.col(umi_col) >= umi_threshold) & (down | control))


def one_hot(ref: Column, categories: tuple[str, ...] = BASES) -> dict[str, Column]:
    return {c: F.when(ref == c, 1).otherwise(0).cast("bigint") for c in categories}


def masked_sum(counts: dict[str, Column], mask: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a + b, (counts[c] * mask[c] for c in mask))


def ref_alt_matrix(matrix: SiteMatrix, kind: str) -> SiteMatrix:
    """The split for 'AG' or 'CU' (transitions of either strand), with sums of cells."""
    names = {"AG": EditingType.AG, "CU": EditingType.CT}
    if kind not in names:
        raise InvalidInput(f"{kind!r}: AG or CU")
    return cell_sums(ref_alt_others(sites_of_type(matrix, names[kind], must_keep=False), names[kind]))


def ref_alt_sums(matrix: SiteMatrix, kind: str) -> DataFrame:
    """Only the sums of cells (the blockwise variant keeps no layers)."""
    return ref_alt_matrix(matrix, kind).obs


def first_key(entry: Column, *names: str) -> Column:
    """The first of several keys that a map of strings has."""
    return F.coalesce(*(F.try_element_at(entry, F.lit(n)) for n in names))


def as_flag(text: Column) -> Column:
    return F.coalesce(~F.lower(text).isin("", "0", "0.0", "false", "none", "nan"), F.lit(False))


def annotate_var(matrix: SiteMatrix, annotations: DataFrame, min_coverage: int = MIN_COVERAGE, check: bool = True) -> SiteMatrix:
    """Adds filter, levels by strand, ref and Stranded, Mismatch, Mismatch_P, Mismatch_N to the sites that pass.

    annotations: (site, entry), entry a map of strings whose keys count in any case. The reference base is the entry's, or
    else the one in the site's name; a site with neither is an error.
    """
    entries = annotations.select("site", lower_keys(F.col("entry")).alias("entry")).dropDuplicates(["site"])
    passing = sites.strand_levels(filter_base_matrix(matrix, min_coverage))
    var = passing.var.join(entries, "site", "left")
    number = lambda *names: F.coalesce(F.floor(first_key(F.col("entry"), *names).try_cast("double")), F.lit(0)).cast("bigint")
    var = var.withColumns({
        "filter": F.col("entry").isNotNull(),
        "ref": F.upper(F.coalesce(F.nullif(F.try_element_at("entry", F.lit("ref")), F.lit("")), F.nullif(F.try_element_at("entry", F.lit("reference")), F.lit("")), F.try_element_at("entry", F.lit("ref_base")), infer_ref(F.col("site")))),
        "Stranded": as_flag(first_key(F.col("entry"), "stranded", "strand_specific")),
        "Mismatch": as_flag(first_key(F.col("entry"), "mismatch", "is_mismatch")),
        "Mismatch_P": number("mismatch_p", "mismatch_plus"),
        "Mismatch_N": number("mismatch_n", "mismatch_minus"),
    }).drop("entry")
    if check and (lost := var.where("ref is null").select("site").first()):
        raise ReferenceLookup(f"no reference base for {lost.site}")
    return replace(passing, var=var)
