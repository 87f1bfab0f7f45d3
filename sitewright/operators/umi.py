"""Molecules: one call for each (site, cell, umi), and counts of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.tags import base_code
from sitewright.schema import FORWARD_LAYERS, REVERSE_LAYERS

SITE = ("contig", "pos")


def join_sites(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """Bases at listed sites. Listed twice is listed once."""
    return bases.join(sites.select(*SITE).dropDuplicates(), list(SITE), "left_semi")


def join_cells(bases: DataFrame, barcodes: DataFrame, tag: str = "cb") -> DataFrame:
    """Bases of listed barcodes (barcode, cell_id); adds cell_id."""
    return bases.join(barcodes.select(F.col("barcode").alias(tag), "cell_id"), tag)


def umi_calls(bases: DataFrame, stranded: bool, keep_n: bool = False) -> DataFrame:
    """(contig, pos, cell_id, umi, low, high): the least and greatest call; they differ where reads of a molecule disagree.

    Minimum and maximum combine on the map side and don't depend on order. A hot site is spread over its molecules. Other
    bases have no code, which minimum and maximum pass over; molecules without any go last, so that no filter repeats the code.
    """
    code = base_code(F.col("base"), F.col("is_reverse"), stranded)
    if keep_n:
        code = F.coalesce(code, F.lit(100) + (F.col("is_reverse").cast("int") if stranded else F.lit(0)))
    return bases.select(*SITE, "cell_id", "umi", code.alias("code")).groupBy(*SITE, "cell_id", "umi").agg(F.min("code").alias("low"), F.max("code").alias("high")).where("low is not null")


def umi_consensus(bases: DataFrame, stranded: bool, keep_n: bool = False) -> DataFrame:
    """(contig, pos, cell_id, umi, code) of the molecules whose reads agree."""
    return umi_calls(bases, stranded, keep_n).where("low = high").select(*SITE, "cell_id", "umi", F.col("low").alias("code"))


def call_counts(consensus: DataFrame) -> DataFrame:
    """(contig, pos, cell_id, code, n)."""
    return consensus.groupBy(*SITE, "cell_id", "code").agg(F.count("*").alias("n"))


def cell_site_counts(consensus: DataFrame, stranded: bool, keep_empty: bool = False) -> DataFrame:
    """One row for each (contig, pos, cell_id) with a column for each layer: A1, T1, G1, C1 and with strands A0, T0, G0, C0."""
    layers = [(name, k << 1 if stranded else k) for k, name in enumerate(FORWARD_LAYERS)]
    if stranded:  # the low bit of a code says reverse
        layers += [(name, (k << 1) + 1) for k, name in enumerate(REVERSE_LAYERS)]
    out = consensus.groupBy(*SITE, "cell_id").agg(*(F.count_if(F.col("code") == code).alias(name) for name, code in layers))
    return out if keep_empty else out.where(" + ".join(name for name, _ in layers) + " > 0")
