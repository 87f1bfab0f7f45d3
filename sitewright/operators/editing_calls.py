"""Reference, alternate and other counts of an editing type, indices of cells, classes of sites."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.errors import EmptyData
from sitewright.functions.editing import EditingType
from sitewright.functions.tags import as_u32, first_base, float_limit
from sitewright.operators.container import SiteMatrix, collapsed
from sitewright.schema import BASES

SPLITS = ("ref", "alt", "others")


def sites_of_type(matrix: SiteMatrix, editing: EditingType, must_keep: bool = True) -> SiteMatrix:
    """Sites whose reference base can be edited on either strand."""
    keep = matrix.var.where(editing.valid_column(F.coalesce("ref", F.lit("N")))).select("site_id")
    if must_keep and keep.isEmpty():
        raise EmptyData(f"no site for {editing}")
    return matrix.with_sites(keep)


def split_columns(counts: dict[str, Column], ref: Column, editing: EditingType) -> dict[str, Column]:
    """Each base's count goes to ref if it is the reference, to alt if it is what editing makes of it, else to others."""
    alt = editing.alt_column(ref)
    pick = lambda test: sum((F.when(test(b), counts[b]).otherwise(0) for b in BASES), F.lit(0)).cast("bigint")
    return {"ref": pick(lambda b: ref == b), "alt": pick(lambda b: (ref != b) & (alt == b)), "others": pick(lambda b: (ref != b) & (alt != b))}


def ref_alt_others(matrix: SiteMatrix, editing: EditingType) -> SiteMatrix:
    """Adds the layers ref, alt and others; alt becomes the main matrix. One pass over wide entries, one join with var."""
    if not any(b + s in matrix.layers for b in BASES for s in "10"):
        raise EmptyData("no base layers")
    refs = matrix.var.select("site_id", first_base(F.col("ref")).alias("__ref"))
    entries = matrix.entries.drop(*SPLITS).join(refs, "site_id")
    splits = split_columns(collapsed(matrix), F.col("__ref"), editing)
    entries = entries.withColumns({name: as_u32(c) for name, c in splits.items()}).drop("__ref")
    return replace(matrix, entries=entries, layers=(*(x for x in matrix.layers if x not in SPLITS), *SPLITS), x="alt")


def cell_sums(matrix: SiteMatrix) -> SiteMatrix:
    """Adds the sums of ref, alt and others to obs; cells without entries have 0."""
    sums = matrix.entries.groupBy("cell_id").agg(*(as_u32(F.sum(name)).alias(name) for name in SPLITS))
    obs = matrix.obs.drop(*SPLITS).join(sums, "cell_id", "left")
    return replace(matrix, obs=obs.withColumns({name: F.coalesce(name, F.lit(0).cast("bigint")) for name in SPLITS}))


def cei_column(ref: Column, alt: Column, fill: str = "nan") -> Column:
    """alt / (ref + alt) in single precision; where both are 0, NaN or 0."""
    empty = F.lit(float("nan") if fill == "nan" else 0.0).cast("float")
    total = (ref + alt).cast("float")
    return F.when(ref + alt == 0, empty).otherwise((alt.cast("float") / F.nullif(total, F.lit(0.0).cast("float"))).cast("float"))


def editing_index(matrix: SiteMatrix, fill: str = "nan") -> SiteMatrix:
    """Adds CEI to obs."""
    return replace(matrix, obs=matrix.obs.withColumn("CEI", cei_column(F.col("ref"), F.col("alt"), fill)))


def site_stats(var: DataFrame, editing: EditingType) -> DataFrame:
    """Adds XY_ref, XY_alt and XY_others, X and Y being the type's own bases at every site, whatever its reference."""
    x, y = editing.bases
    total = sum((F.col(b) for b in BASES), F.lit(0))
    return var.withColumns({f"{x}{y}_ref": F.col(x), f"{x}{y}_alt": F.col(y), f"{x}{y}_others": F.greatest(total - F.col(x) - F.col(y), F.lit(0)).cast("bigint")})


def mismatch_class(ref: Column, coverage: Column, max_other: float, min_edited: float, min_ref: float) -> Column:
    """`RA`: the reference and the commonest other base, or `-`.

    Limits are computed in single precision. Equal counts are told apart by the order A, T, G, C.
    """
    base = first_base(ref)
    known = base.isin(*BASES)
    own = sum((F.when(base == b, F.col(b)).otherwise(0) for b in BASES), F.lit(0))
    other = {b: F.when(base == b, F.lit(-1).cast("bigint")).otherwise(F.col(b)) for b in BASES}
    top = F.greatest(*other.values())
    label = F.coalesce(*(F.when(other[b] == top, F.lit(b)) for b in BASES))
    others = sum((F.col(b) for b in BASES), F.lit(0)) - own - top
    fails = ~known | (coverage < 1) | (own < float_limit(min_ref, coverage, 1)) | (others > float_limit(max_other, coverage)) | (top < float_limit(min_edited, coverage, 1))
    return F.when(F.coalesce(fails, F.lit(True)), "-").otherwise(F.concat(base, label))


def with_mismatch(var: DataFrame, max_other: float = 0.01, min_edited: float = 0.01, min_ref: float = 0.01) -> DataFrame:
    return var.withColumn("Mismatch", mismatch_class(F.col("ref"), F.col("Coverage"), max_other, min_edited, min_ref))
