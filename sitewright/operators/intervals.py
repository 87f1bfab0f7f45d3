"""Genomic intervals (contig, start, stop), 0-based and half-open, and the cutting of work."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.errors import InvalidInput
from sitewright.schema import CHUNK_WEIGHT, HOT_CHUNK, TILE


def tiles(intervals: DataFrame, size: int = TILE) -> DataFrame:
    """Each interval cut into pieces of at most `size`; empty intervals give none."""
    if size <= 0:
        raise InvalidInput("a tile has a positive size")
    keep = [c for c in intervals.columns if c not in ("start", "stop")]
    starts = intervals.where("stop > start").select(*keep, "stop", F.explode(F.sequence(F.col("start"), F.col("stop") - 1, F.lit(size).cast("bigint"))).alias("start"))
    return starts.select(*keep, "start", F.least(F.col("start") + size, F.col("stop")).alias("stop"))


def header_tiles(header: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of whole contigs (contig, length)."""
    return tiles(header.select("contig", F.lit(0).cast("bigint").alias("start"), F.col("length").cast("bigint").alias("stop")), size)


def merge_overlaps(intervals: DataFrame, touching: bool = True, bin_size: int = 1 << 20) -> DataFrame:
    """The union of the intervals as disjoint ones; touching ones become one unless touching=False.

    A window by contig alone would put a chromosome into one task. Intervals are cut at bins of `bin_size` first and
    merged inside each; only runs that reach a bin's edges meet again, and those are few (one or two for each bin).
    """
    kept = intervals.where("stop > start").select("contig", "start", "stop")
    gap = F.lit(0) if touching else F.lit(-1)
    first_bin, last_bin = F.expr(f"start div {bin_size}"), F.expr(f"(stop - 1) div {bin_size}")
    cut = kept.select("contig", "start", "stop", F.explode(F.sequence(first_bin, last_bin)).alias("bin"))
    # Inside a bin the original ends decide what belongs together; a cut end is one that the edge made.
    in_bin = cut.select("contig", "bin", F.greatest("start", F.col("bin") * bin_size).alias("start"), F.least("stop", (F.col("bin") + 1) * bin_size).alias("stop"), (F.col("start") < F.col("bin") * bin_size).alias("from_left"), (F.col("stop") > (F.col("bin") + 1) * bin_size).alias("to_right"))
    local = _islands(in_bin, ["contig", "bin"], gap).groupBy("contig", "bin", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.max("from_left").alias("from_left"), F.max("to_right").alias("to_right"))
    inside = (F.col("start") > F.col("bin") * bin_size) & (F.col("stop") < (F.col("bin") + 1) * bin_size)
    inner = local.where(inside).select("contig", "start", "stop")
    edge = local.where(~inside).select("contig", "start", "stop", "from_left", "to_right")
    order = Window.partitionBy("contig").orderBy("start", "stop")
    before_stop, before_right = F.lag("stop").over(order), F.lag("to_right").over(order)
    joins = (F.col("start") == before_stop) & (F.lit(touching) | F.col("from_left") | before_right)
    run = F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    outer = edge.withColumn("island", run).groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("contig", "start", "stop")
    return inner.unionByName(outer)


def _islands(df: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Numbers islands by where they start. Intervals that start together are in one, so their order doesn't matter."""
    order = Window.partitionBy(*keys).orderBy("start")
    reach = F.max("stop").over(order.rangeBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") > reach + gap), F.col("start"))
    return df.withColumn("__begins", begins).withColumn("island", F.max("__begins").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("__begins")


def union_merge(a: DataFrame, b: DataFrame, merge: bool = True, touching: bool = True) -> DataFrame:
    both = a.select("contig", "start", "stop").unionByName(b.select("contig", "start", "stop"))
    return merge_overlaps(both, touching) if merge else both


def work_intervals(header: DataFrame, bed: DataFrame | None = None, vcf: DataFrame | None = None, size: int = TILE, merge: bool = True) -> DataFrame:
    """What to look at: both restrictions merged, or the one that is given, or every contig; cut into tiles."""
    if bed is not None and vcf is not None:
        chosen = union_merge(bed, vcf, merge)
    elif bed is not None or vcf is not None:
        chosen = bed if bed is not None else vcf
        chosen = merge_overlaps(chosen) if merge else chosen
    else:
        return header_tiles(header, size)
    return tiles(chosen, size)


def known_contigs(intervals: DataFrame, header: DataFrame) -> DataFrame:
    """The intervals; raises if one's contig isn't in the header or one ends before it starts."""
    if not intervals.where("stop < start").isEmpty():
        raise InvalidInput("an interval ends before it starts")
    strange = intervals.join(header.select("contig"), "contig", "left_anti").select("contig").limit(1).collect()
    if strange:
        raise InvalidInput(f"contig {strange[0].contig!r} isn't in the header")
    return intervals


def restrict(positions: DataFrame, intervals: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Positions (contig, pos) inside any interval: a range join on bins, so no contig is one task."""
    bins = intervals.where("stop > start").select("contig", "start", "stop", F.explode(F.sequence(F.expr(f"start div {bin_size}"), F.expr(f"(stop - 1) div {bin_size}"))).alias("__bin"))
    asked = positions.withColumn("__bin", F.expr(f"pos div {bin_size}"))
    inside = (asked["contig"] == bins["contig"]) & (asked["__bin"] == bins["__bin"]) & (asked["pos"] >= bins["start"]) & (asked["pos"] < bins["stop"])
    return asked.join(bins, inside, "left_semi").drop("__bin")


def chunk_plan(positions: DataFrame, weight: int = CHUNK_WEIGHT, hot: int = HOT_CHUNK) -> DataFrame:
    """The positions with a chunk number within their contig: (contig, pos, ..., chunk, weight).

    Positions are taken in order; a chunk ends when the kind (near the depth cap or not) changes, when its weight
    (DEPTH + REF_SKIP + FAIL, 1 at least) reaches the limit, or at `hot` positions near the cap. Each step depends on the
    one before, so a contig is walked by one task; it holds a batch of rows and three numbers. Spark's own partitioning
    makes the walk unnecessary except for a report.
    """
    step = F.when(F.col("NEAR_MAX_DEPTH"), F.lit(1)).otherwise(F.greatest(F.col("DEPTH") + F.col("REF_SKIP") + F.col("FAIL"), F.lit(1))).cast("bigint")
    rows = positions.select("contig", F.col("pos").cast("bigint").alias("pos"), F.col("NEAR_MAX_DEPTH").alias("near"), step.alias("weight"))
    return rows.repartition("contig").sortWithinPartitions("contig", "pos").mapInArrow(_walker(max(1, weight), max(1, hot)), "contig string, pos bigint, near boolean, chunk bigint, weight bigint")


def _walker(limit: int, hot: int):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, chunk, total, before, begun = None, 0, 0, None, False
        for batch in batches:
            out = []
            for contig, near, weight in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if contig != here or not begun:
                    here, chunk, total, before, begun = contig, 0, 0, near, True
                if near != before and total:
                    chunk, total = chunk + 1, 0
                out.append(chunk)
                total += weight
                if total >= (hot if near else limit):
                    chunk, total = chunk + 1, 0
                before = near
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64()), batch.column(3)], names=["contig", "pos", "near", "chunk", "weight"])

    return walk
