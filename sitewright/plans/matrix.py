"""Cell-by-site matrices of molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.config import MatrixConfig
from sitewright.operators import umi
from sitewright.operators.bases import explode_reads, is_standard_contig, usable_bases, with_clean_tags
from sitewright.operators.container import SiteMatrix, assemble
from sitewright.operators.pileup import split_by_depth
from sitewright.plans.bulk import as_table, bulk_sites
from sitewright.sources.matrices import write_matrix
from sitewright.sources.tables import is_gzipped, read_manifest, write_skipped, write_tsv


def cell_matrix(bases: DataFrame, sites: DataFrame, barcodes: DataFrame, config: MatrixConfig | None = None, header: DataFrame | None = None) -> tuple[SiteMatrix, DataFrame]:
    """(matrix, skipped sites). bases, sites: (contig, pos) counted alike; bases with cb and umi tags, cleaned.

    A semi-join with the sites, a join with the barcodes, one aggregation by molecule and one by cell and site. The
    molecules spread a hot site over many keys. header (tid, contig) gives the order of the columns.
    """
    config = (config or MatrixConfig()).validate()
    sites = sites if config.all_contigs else sites.where(is_standard_contig())
    here = umi.join_sites(bases, sites)
    processed, skipped = split_by_depth(here, config.max_depth)
    usable = usable_bases(here, config.min_mapq, config.min_baseq, missing_umi=config.missing_umi)
    cells = umi.join_cells(umi.join_sites(usable, processed), barcodes)
    counts = umi.cell_site_counts(umi.umi_consensus(cells, config.stranded), config.stranded)
    if header is not None:
        processed = processed.join(header.select("contig", "tid"), "contig", "left")
    return assemble(counts, processed, barcodes, config.stranded), skipped


def two_pass_matrix(bases: DataFrame, barcodes: DataFrame, config: MatrixConfig | None = None, header: DataFrame | None = None, manifest: str | None = None) -> tuple[SiteMatrix, DataFrame]:
    """The sites come from a bulk pass over the same bases, under the settings of the matrix.

    manifest: where the first pass leaves its table of sites (bases then count positions from 1); it is read from there.
    Without it the first pass is a part of the same plan.
    """
    config = (config or MatrixConfig()).validate()
    sites = bulk_sites(bases, config.first_pass())
    if manifest:
        write_tsv(as_table(sites, zero_base=True), manifest, gzipped=is_gzipped(manifest), order=["CHR", "POS"])  # positions count from 1 already
        sites = read_manifest(bases.sparkSession, manifest)
    return cell_matrix(bases, sites.select("contig", "pos"), barcodes, config, header)


def manifest_path(output: str) -> str:
    """Where the first pass leaves its sites if nothing else is said: beside the output."""
    folder, mark, _ = output.rstrip("/").rpartition("/")
    return f"{folder}{mark}1pass.tsv.gz"


def run_matrix(reads: DataFrame, barcodes: DataFrame, manifest: DataFrame | None, output: str | None = None, config: MatrixConfig | None = None, header: DataFrame | None = None, first_pass: str | None = None) -> tuple[SiteMatrix, DataFrame]:
    """From reads; manifest (contig, pos from 1), or None for two passes. Writes the matrix and the list of skipped sites.

    first_pass: where the first of two passes leaves its sites; 1pass.tsv.gz beside the output if nothing is said.
    """
    bases = with_clean_tags(explode_reads(reads)).withColumn("pos", F.col("pos") + 1)
    if manifest is None:
        matrix, skipped = two_pass_matrix(bases, barcodes, config, header, first_pass or (manifest_path(output) if output else None))
    else:
        matrix, skipped = cell_matrix(bases, manifest.select("contig", "pos"), barcodes, config, header)
    if output:
        write_matrix(matrix, output)
        write_skipped(skipped, output)
    return matrix, skipped
