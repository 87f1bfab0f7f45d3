"""Editing calls on a matrix."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import CallConfig, validate_call_inputs, validate_output
from sitewright.functions.editing import EditingType
from sitewright.operators import editing_calls as E
from sitewright.operators import sites as S
from sitewright.operators.container import SiteMatrix
from sitewright.sources.fasta import as_reference, read_fasta
from sitewright.sources.matrices import read_matrix, write_called
from sitewright.sources.tables import read_known_sites


def annotate(matrix: SiteMatrix, known: DataFrame, reference: DataFrame, config: CallConfig, check: bool = True) -> SiteMatrix:
    """Known sites marked, coverage filtered, levels counted, reference bases and mismatch classes added.

    check: run a job to see that sites are left, and raise if none is. What the coverage filter keeps is written once, since
    every later step reads it more than once.
    """
    marked = S.mark_known_sites(matrix, known)
    covered = S.base_levels(S.filter_by_coverage(marked, config.min_coverage, must_keep=check).written("covered"))
    named = S.add_reference(covered, reference)
    return replace(named, var=E.with_mismatch(named.var, config.max_other_threshold, config.min_edited_threshold, config.min_ref_threshold))


def call_editing(matrix: SiteMatrix, known: DataFrame, reference: DataFrame, config: CallConfig | None = None, check: bool = True) -> SiteMatrix:
    """The whole call. Neither a known site nor a mismatch class removes a row unless only_known_sites is set."""
    config = (config or CallConfig()).validate()
    editing = EditingType.parse(config.editing_type)
    noted = annotate(matrix, known, reference, config, check)
    if config.only_known_sites:
        noted = noted.with_sites(noted.var.where("is_editing_site").select("site_id"))
    split = E.ref_alt_others(E.sites_of_type(noted, editing, must_keep=check), editing)
    indexed = E.editing_index(E.cell_sums(split), config.cei_fill)
    return replace(indexed, var=E.site_stats(indexed.var, editing))


def run_call(spark: SparkSession, matrix: str, fasta: str, known_sites: str, output: str, config: CallConfig | None = None, dry_run: bool = False, overwrite: bool = False) -> SiteMatrix | None:
    """From paths to the written result; a dry run only checks."""
    config = (config or CallConfig()).validate()
    validate_call_inputs(spark, matrix, fasta, known_sites)
    validate_output(spark, output, overwrite)
    if dry_run:
        return None
    source = read_matrix(spark, matrix)
    reference = as_reference(read_fasta(spark, fasta), source.var.select("contig", F.col("pos")))
    result = call_editing(source, read_known_sites(spark, known_sites), reference, config)
    write_called(result, output)
    return result
