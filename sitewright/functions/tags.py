"""Barcodes, bases, positions and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.schema import U32_MAX

INTEGER = r"^\+?[0-9]+$"


#: All that counts as white space.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def clean_tag(raw: Column) -> Column:
    """The text before the first hyphen, trimmed of all white space; null if nothing is left."""
    return F.nullif(F.btrim(F.substring_index(raw, "-", 1), F.lit(WHITE)), F.lit(""))


def decode_base(raw: Column) -> Column:
    upper = F.upper(raw)
    return F.when(upper.isin("A", "C", "G", "T"), upper).otherwise("N")


def base_code(base: Column, is_reverse: Column, stranded: bool) -> Column:
    """A, T, G, C as 0 to 3; with strands twice that plus 1 for reverse. Null for any other base."""
    code = F.when(base == "A", 0).when(base == "T", 1).when(base == "G", 2).when(base == "C", 3)
    return (F.shiftleft(code, 1) + is_reverse.cast("int")) if stranded else code


def decoded_base(code: Column, stranded: bool) -> Column:
    return F.element_at(F.array(*map(F.lit, "ATGC")), (F.shiftright(code, 1) if stranded else code) + 1)


def decoded_strand(code: Column, stranded: bool) -> Column:
    """1 for forward, 0 for reverse; unstranded codes count as forward."""
    return F.when((code % 2) == 1, F.lit("0")).otherwise("1") if stranded else F.lit("1")


def site_id(contig: Column, pos: Column) -> Column:
    return F.concat_ws(":", F.coalesce(contig, F.lit("unknown")), pos.cast("string"))


def site_contig(site: Column) -> Column:
    """Contig of `contig:pos`; null unless there are just two parts and the second is a positive integer."""
    parts = F.split(site, ":")
    return F.when(_is_site(site), F.get(parts, F.lit(0)))


def site_pos(site: Column) -> Column:
    return F.when(_is_site(site), F.get(F.split(site, ":"), F.lit(1)).try_cast("bigint"))


def _is_site(site: Column) -> Column:
    parts = F.split(site, ":")
    pos = F.get(parts, F.lit(1))
    return (F.size(parts) == 2) & pos.rlike(INTEGER) & (pos.try_cast("bigint") > 0)


def as_u32(x: Column) -> Column:
    """Clamped to what 32 unsigned bits hold."""
    return F.least(F.greatest(x.cast("bigint"), F.lit(0)), F.lit(U32_MAX)).cast("bigint")


def float_to_u32(x: Column) -> Column:
    """Truncated and saturated; NaN is 0. (A plain cast raises where the value doesn't fit.)"""
    d = x.cast("double")
    return F.when(F.isnan(d) | (d <= 0), F.lit(0)).when(d >= float(U32_MAX), F.lit(U32_MAX)).otherwise(F.floor(F.greatest(F.least(d, F.lit(float(U32_MAX))), F.lit(0.0)))).cast("bigint")


def first_base(ref: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(ref, 1, 1), F.lit("")), F.lit("N"))


def infer_ref(name: Column) -> Column:
    """The reference base in a site's name: of its parts between colons, bars and hyphens, the last that is one base, or two letters that begin with one."""
    parts = F.transform(F.reverse(F.split(F.upper(name), r"[:|\-]")), lambda p: F.trim(p))
    return F.get(F.transform(F.filter(parts, lambda p: p.rlike("^[ACGT].?$")), lambda p: F.substring(p, 1, 1)), F.lit(0))


def lower_keys(entry: Column) -> Column:
    return F.transform_keys(entry, lambda k, v: F.lower(k))


def float_limit(threshold: float, coverage: Column, least: int | None = None) -> Column:
    """ceil(threshold x coverage) in single precision, at least `least`."""
    limit = F.ceil((F.lit(threshold).cast("float") * coverage.cast("float")).cast("float")).cast("bigint")
    return limit if least is None else F.greatest(limit, F.lit(least).cast("bigint"))
