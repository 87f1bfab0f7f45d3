"""From reads to one row for each base, and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.arrays import let, running
from sitewright.functions.tags import clean_tag, decode_base
from sitewright.schema import MIN_BASEQ, MIN_MAPQ, SKIPPED_FLAGS, STANDARD_CONTIGS

_REF = ("M", "=", "X", "D", "N")
_QUERY = ("M", "=", "X", "I", "S")
PIECE = 256


def cigar_segments(cigar: str = "cigar", start: str = "start") -> Column:
    """Array of (op, len, at, query, ins_after): where each operation that covers the reference begins there and in the read."""
    ops = F.transform(F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)), lambda x: F.struct(F.right(x, F.lit(1)).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("len")))
    taken = lambda ops, letters: F.transform(ops, lambda x: F.when(x.op.isin(*letters), x.len).otherwise(F.lit(0).cast("bigint")))

    def placed(ops: Column, ref: Column, query: Column) -> Column:
        before = lambda ends, k: F.coalesce(F.when(k > 0, F.get(ends, k - 1)), F.lit(0))
        each = F.transform(ops, lambda x, k: F.struct(x.op.alias("op"), x.len.alias("len"), (F.col(start) + before(ref, k)).cast("bigint").alias("at"), before(query, k).cast("bigint").alias("query")))
        return F.filter(each, lambda x: x.op.isin(*_REF, "I"))

    after = lambda kept, k: F.coalesce(F.get(kept, k + 1).op == "I", F.lit(False))
    noted = lambda kept: F.transform(kept, lambda x, k: F.struct(x.op.alias("op"), x.len.alias("len"), x.at.alias("at"), x.query.alias("query"), after(kept, k).alias("ins_after")))
    found = let(ops, lambda ops: let(running(taken(ops, _REF)), lambda ref: let(running(taken(ops, _QUERY)), lambda query: let(placed(ops, ref, query), noted))))
    return F.filter(found, lambda x: x.op != "I")


def explode_reads(reads: DataFrame, skipped_flags: int = SKIPPED_FLAGS) -> DataFrame:
    """One row for each reference position a read covers.

    reads: contig, start (0-based), mapq, flag, cigar, seq, qual (phred + 33, may be null), cb, umi, and any other columns,
    which stay. Adds pos (0-based), base, baseq, is_del, is_refskip, ins_after, is_reverse. An insertion counts at the
    position before it. A read without a cigar covers nothing.

    Letters and qualities are taken as bytes, in pieces of PIECE positions, so a row carries no more than its piece and the
    work is linear in the length of a read.
    """
    kept = reads.where((F.col("flag").bitwiseAND(skipped_flags) == 0) & F.col("cigar").isNotNull())
    rest = [c for c in reads.columns if c not in ("cigar", "seq", "qual", "start", "flag")]
    bytes_of = [F.col(c).cast("binary").alias(c) for c in ("seq", "qual")]
    segments = kept.select(*rest, *bytes_of, (F.col("flag").bitwiseAND(16) != 0).alias("is_reverse"), F.explode(cigar_segments()).alias("s"))
    pieces = segments.where("s.len > 0").select(*rest, "seq", "qual", "is_reverse", "s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("s.len") - 1, F.lit(PIECE).cast("bigint"))).alias("first"))
    place = (F.col("s.query") + F.col("first") + 1).cast("int")
    part = lambda c: F.when(~F.col("s.op").isin("D", "N"), F.substring(c, place, F.lit(PIECE))).alias(c)
    pieces = pieces.select(*rest, "is_reverse", "s", "first", part("seq"), part("qual"))
    each = pieces.select(*rest, "seq", "qual", "is_reverse", "s", "first", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + PIECE, F.col("s.len")) - 1)).alias("k"))
    at = (F.col("k") - F.col("first") + 1).cast("int")
    aligned = ~F.col("s.op").isin("D", "N")
    letter = lambda c: F.substring(c, at, F.lit(1)).cast("string")
    return each.select(
        *rest,
        "is_reverse",
        (F.col("s.at") + F.col("k")).alias("pos"),
        F.when(aligned, decode_base(letter("seq"))).alias("base"),
        F.when(aligned & F.col("qual").isNotNull(), F.ascii(letter("qual")) - 33).alias("baseq"),
        (F.col("s.op") == "D").alias("is_del"),
        (F.col("s.op") == "N").alias("is_refskip"),
        (F.col("s.ins_after") & (F.col("k") == F.col("s.len") - 1)).alias("ins_after"),
    )


def read_passes(min_mapq: int = MIN_MAPQ) -> Column:
    """The read filter: mapping quality only. Any other Column can take its place."""
    return F.col("mapq") >= min_mapq


def base_class(passes: Column, min_baseq: int | None = MIN_BASEQ) -> Column:
    """fail, refskip, del, or the base as it counts: N for low quality and for anything but A, C, G, T."""
    known = F.when(F.col("base").isin("A", "C", "G", "T"), F.col("base")).otherwise("N")
    low = F.lit(False) if min_baseq is None else F.coalesce(F.col("baseq"), F.lit(0)) < min_baseq
    return F.when(~F.coalesce(passes, F.lit(False)), "fail").when(F.col("is_refskip"), "refskip").when(F.col("is_del"), "del").when(low, "N").otherwise(known)


def is_standard_contig(contig: Column | str = "contig") -> Column:
    return F.lower(contig if isinstance(contig, Column) else F.col(contig)).isin(*(c.lower() for c in STANDARD_CONTIGS))


def standard_contigs(header: DataFrame) -> DataFrame:
    """The contigs (tid, contig) of a header whose names are standard."""
    return header.where(is_standard_contig("contig"))


def filter_positions(positions: DataFrame, keep: Column) -> DataFrame:
    """Positions whose contig passes a predicate."""
    return positions.where(keep)


def usable_bases(bases: DataFrame, min_mapq: int = MIN_MAPQ, min_baseq: int = MIN_BASEQ, missing_baseq_passes: bool = False, missing_umi: str = "drop", drop_n: bool = True) -> DataFrame:
    """Bases a cell's molecules may vote with: mapped well, aligned, good, known; cell and umi tags cleaned.

    A missing base quality counts as 0, or passes with missing_baseq_passes. missing_umi 'pool' puts bases without a umi
    into one molecule '-'; drop_n=False lets N take part.
    """
    quality = F.col("baseq").isNull() | (F.col("baseq") >= min_baseq) if missing_baseq_passes else F.coalesce(F.col("baseq"), F.lit(0)) >= min_baseq
    kept = bases.where(read_passes(min_mapq)).where(~F.col("is_del") & ~F.col("is_refskip")).where(quality)
    if drop_n:
        kept = kept.where(F.col("base").isin("A", "C", "G", "T"))
    return kept.where(F.col("umi").isNotNull()) if missing_umi == "drop" else kept.withColumn("umi", F.coalesce("umi", F.lit("-")))


def with_clean_tags(bases: DataFrame, cell: str = "cb", umi: str = "umi") -> DataFrame:
    return bases.withColumn(cell, clean_tag(F.col(cell))).withColumn(umi, clean_tag(F.col(umi)))
