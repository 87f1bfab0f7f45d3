"""The older scripts as plans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sitewright.operators import legacy as L
from sitewright.operators import umi
from sitewright.operators.container import SiteMatrix, assemble
from sitewright.operators.editing_calls import editing_index


def script_matrix(bases: DataFrame, sites: DataFrame, barcodes: DataFrame, stranded: bool = True) -> SiteMatrix:
    counts = L.position_counts(umi.join_sites(bases, sites), barcodes, stranded)
    return assemble(counts, sites, barcodes, stranded)


def script_call(matrix: SiteMatrix, annotations: DataFrame, kind: str = "AG", min_coverage: int = 5) -> SiteMatrix:
    """Annotated, split and indexed; cells without a count have the index 0."""
    noted = L.annotate_var(matrix, annotations, min_coverage)
    return editing_index(L.ref_alt_matrix(noted, kind), "zero")
