"""Counts for each position and the predicates on sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.errors import InvalidInput
from sitewright.operators.bases import base_class, read_passes
from sitewright.schema import EDITING_THRESHOLD, MAX_N_FRACTION, MIN_BASEQ, MIN_DEPTH, MIN_MAPQ

COUNTS = ("DEPTH", "A", "C", "G", "T", "N", "INS", "DEL", "REF_SKIP", "FAIL")


def pileup(bases: DataFrame, passes: Column | None = None, min_mapq: int = MIN_MAPQ, min_baseq: int | None = MIN_BASEQ) -> DataFrame:
    """One row for each (contig, pos) with the counts; DEPTH = A + C + G + T + N + DEL.

    passes: which reads count (the others are FAIL). A single aggregation, combined on the map side.
    """
    kinds = bases.select("contig", "pos", base_class(read_passes(min_mapq) if passes is None else passes, min_baseq).alias("kind"), (F.col("ins_after") if "ins_after" in bases.columns else F.lit(False)).alias("ins"))
    n = lambda *names: F.count_if(F.col("kind").isin(*names)).alias
    return kinds.groupBy("contig", "pos").agg(
        n("A", "C", "G", "T", "N", "del")("DEPTH"), n("A")("A"), n("C")("C"), n("G")("G"), n("T")("T"), n("N")("N"),
        F.count_if(F.col("ins") & F.col("kind").isin("A", "C", "G", "T", "N")).alias("INS"), n("del")("DEL"), n("refskip")("REF_SKIP"), n("fail")("FAIL"),
    )


def near_max_depth(max_depth: int, raw: bool = True) -> Column:
    """Whether a depth comes within a hundredth of the cap: of all reads of the column (raw), or of those that count."""
    if max_depth <= 0:
        return F.lit(False)
    depth = F.greatest(F.col("DEPTH") + F.col("REF_SKIP") + F.col("FAIL"), F.col("DEPTH")) if raw else F.col("DEPTH")
    return depth * 101 >= max_depth * 100


def edited_site(min_depth: int = MIN_DEPTH, max_n_fraction: int = MAX_N_FRACTION, editing_threshold: int = EDITING_THRESHOLD) -> Column:
    """Two bases at least above depth / editing_threshold (and above 2), enough depth, few N."""
    if min(max_n_fraction, editing_threshold) <= 0:
        raise InvalidInput("divisors must be positive")
    least = F.greatest(F.expr(f"DEPTH div {editing_threshold}"), F.lit(2))
    alleles = sum((F.when(F.col(b) > least, 1).otherwise(0) for b in "ATGC"), F.lit(0))
    return (alleles >= 2) & (F.col("DEPTH") >= min_depth) & (F.col("N") <= F.greatest(F.expr(f"DEPTH div {max_n_fraction}"), F.lit(2)))


def covered_site(min_depth: int = MIN_DEPTH) -> Column:
    return F.col("DEPTH") >= min_depth


def raw_depth(bases: DataFrame) -> DataFrame:
    """(contig, pos, DEPTH): every base row of a column, before any filter."""
    return bases.groupBy("contig", "pos").agg(F.count("*").alias("DEPTH"))


def split_by_depth(bases: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(sites to process, skipped sites): sites whose raw depth reaches the cap are left out and listed."""
    depth = raw_depth(bases)
    return depth.where(F.col("DEPTH") < max_depth).select("contig", "pos"), depth.where(F.col("DEPTH") >= max_depth)


def as_ranges(positions: DataFrame) -> DataFrame:
    """Positions as BED rows: name empty, score the depth."""
    return positions.select(F.col("contig").alias("chrom"), F.col("pos").alias("chromStart"), (F.col("pos") + 1).alias("chromEnd"), F.lit("").alias("name"), F.col("DEPTH").alias("score"))
