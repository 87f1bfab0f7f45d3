"""Site counts of all reads together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.config import BulkConfig
from sitewright.operators import intervals as I
from sitewright.operators.bases import explode_reads, is_standard_contig
from sitewright.operators.pileup import covered_site, edited_site, near_max_depth, pileup
from sitewright.schema import BULK_COLUMNS
from sitewright.sources.tables import gz_path, is_gzipped, write_tsv


def bulk_sites(bases: DataFrame, config: BulkConfig | None = None, passes: Column | None = None, regions: DataFrame | None = None) -> DataFrame:
    """(contig, pos, counts, NEAR_MAX_DEPTH) of the sites that qualify; pos as bases have it.

    One aggregation. Contigs and regions are filtered before it.
    """
    config = (config or BulkConfig()).validate()
    bases = bases if config.all_contigs else bases.where(is_standard_contig())
    bases = bases if regions is None else I.restrict(bases, regions)
    counts = pileup(bases, passes, config.min_mapq, config.min_baseq).withColumn("NEAR_MAX_DEPTH", near_max_depth(config.max_depth, raw=True))
    return counts.where(edited_site(config.min_depth, config.max_n_fraction, config.editing_threshold) if config.edited_only else covered_site(config.min_depth))


def as_table(sites: DataFrame, zero_base: bool = False) -> DataFrame:
    """The columns of the written table; positions from 1 unless zero_base. sites: pos from 0."""
    shown = sites.withColumn("CHR", F.col("contig")).withColumn("POS", F.col("pos") + (0 if zero_base else 1))
    return shown.select(*BULK_COLUMNS)


def run_bulk(reads: DataFrame, output: str | None = None, config: BulkConfig | None = None, regions: DataFrame | None = None) -> DataFrame:
    """From reads to the table; written in order of contig and position if there is an output."""
    config = config or BulkConfig()
    table = as_table(bulk_sites(explode_reads(reads), config, regions=regions), config.zero_base)
    if output:
        write_tsv(table, gz_path(output) if not is_gzipped(output) else output, gzipped=True, order=["CHR", "POS"])
    return table
