"""Sparse matrices as long tables (row, col, value): one row for each entry that is stored.

Axes are tables with one column of numbers, or plain sizes. Sums are clamped to what 32 unsigned bits hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.errors import DimensionMismatch
from sitewright.functions.tags import as_u32

ENTRY = ("row", "col", "value")

#: Bytes of input files for each task that sums places: some hundred thousand entries.
PIECE = 4 << 20
#: Estimates above this stand for sizes that the planner doesn't know.
UNKNOWN = 1 << 50


def pieces(df: DataFrame) -> int:
    """How many tasks sum the places of df: by the size of what it reads, so that the memory of one doesn't grow with it.

    Nothing is run for it. What has no known size, as rows of an RDD or a cache, gets the session's number of partitions at least.
    """
    spark, leaves = df.sparkSession, df._jdf.queryExecution().optimizedPlan().collectLeaves()
    found = [(leaf.nodeName(), int(leaf.stats().sizeInBytes())) for leaf in map(leaves.apply, range(leaves.size()))]
    known = [size for name, size in found if name not in ("LogicalRDD", "InMemoryRelation") and size < UNKNOWN]
    least = spark.sparkContext.defaultParallelism if len(known) == len(found) else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sum(known) // PIECE))


def from_triplets(triplets: DataFrame, n_rows: int | None = None, n_cols: int | None = None) -> DataFrame:
    """Equal places summed. With sizes given, a place outside them raises when the table is used.

    Places are dealt out before they are summed: where few of them repeat, sums on the map side save nothing, and the number
    of tasks is then the session's and, with adaptive execution, that of the cores, however many places there are.
    """
    if n_rows is not None or n_cols is not None:
        inside = F.lit(True)
        for name, size in (("row", n_rows), ("col", n_cols)):
            if size is not None:
                inside = inside & F.col(name).between(0, size - 1)
        checked = F.when(inside, F.col("row")).otherwise(F.raise_error(F.lit("an entry lies outside the matrix")).cast("bigint"))
        triplets = triplets.withColumn("row", checked)
    return triplets.repartition(pieces(triplets), "row", "col").groupBy("row", "col").agg(as_u32(F.sum("value")).alias("value"))


def add(a: DataFrame, b: DataFrame, shapes: tuple[tuple[int, int], tuple[int, int]] | None = None) -> DataFrame:
    """Element-wise sum; shapes, where known, must agree."""
    if shapes and shapes[0] != shapes[1]:
        raise DimensionMismatch(f"{shapes[0]} and {shapes[1]}")
    return from_triplets(a.select(*ENTRY).unionByName(b.select(*ENTRY)))


def mask(a: DataFrame, b: DataFrame) -> DataFrame:
    """a's own values at the places where b is above 0 (a mask, not a product)."""
    return a.join(b.where("value > 0").select("row", "col"), ["row", "col"], "left_semi").select(*ENTRY)


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


def _sums(a: DataFrame, axis: str, numbers: DataFrame | None) -> DataFrame:
    sums = a.groupBy(axis).agg(as_u32(F.sum("value")).alias("total"))
    if numbers is None:
        return sums
    return numbers.select(axis).join(sums, axis, "left").select(axis, F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))


def row_sums(a: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, total); with the table of rows, empty rows have 0."""
    return _sums(a, "row", rows)


def col_sums(a: DataFrame, cols: DataFrame | None = None) -> DataFrame:
    """(col, total); with the table of columns, empty columns have 0."""
    return _sums(a, "col", cols)


def matvec(a: DataFrame, vector: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(row, total) of a times a vector (col, weight)."""
    return _sums(a.join(vector.select("col", "weight"), "col").select("row", (F.col("value") * F.col("weight")).alias("value")), "row", rows)


def threshold(a: DataFrame, least: float) -> DataFrame:
    return a.where(F.col("value") >= least)


def filter_columns(a: DataFrame, keep: DataFrame) -> DataFrame:
    """Only the columns in keep (old, new), renumbered."""
    return a.join(keep.select(F.col("old").alias("col"), "new"), "col").select("row", F.col("new").alias("col"), "value")


def with_size(one: DataFrame, rows: DataFrame | int, cols: DataFrame | int) -> DataFrame:
    """A table of one row with `total`, the number of places of a matrix; axes as tables of numbers, or sizes."""
    for name, axis in (("__rows", rows), ("__cols", cols)):
        one = one.withColumn(name, F.lit(axis)) if isinstance(axis, int) else one.crossJoin(axis.agg(F.count("*").alias(name)))  # one row each
    return one.withColumn("total", F.col("__rows").cast("bigint") * F.col("__cols")).drop("__rows", "__cols")


def density(a: DataFrame, rows: DataFrame | int, cols: DataFrame | int) -> DataFrame:
    """One row: density (0 for an empty shape), nnz, total. rows, cols: the axes as tables of numbers, or their sizes."""
    sized = with_size(a.agg(F.count("*").alias("nnz")), rows, cols)
    return sized.select(F.when(F.col("total") > 0, F.col("nnz") / F.col("total")).otherwise(0.0).alias("density"), "nnz", "total")


# The percentages are fixed values.
def sparsity_percentiles(a: DataFrame, rows: DataFrame | int, cols: DataFrame | int, percentages: tuple[float, ...] = (90, 95, 99, 99.9, 99.99, 99.999)) -> DataFrame:
    """(percentage, value) of the stored values, with linear interpolation, and the share of places that are stored."""
    points = F.array(*(F.lit(p / 100) for p in percentages))
    counted = a.agg(F.percentile("value", points).alias("v"), F.count_if(F.col("value") != 0).alias("nnz"))
    found = with_size(counted, rows, cols).select("v", F.when(F.col("total") > 0, F.col("nnz") / F.col("total")).otherwise(0.0).alias("stored"))
    return found.select(F.explode(F.arrays_zip(F.array(*(F.lit(float(p)) for p in percentages)).alias("percentage"), F.col("v").alias("value"))).alias("x"), "stored").select(F.col("x")["percentage"].alias("percentage"), F.col("x")["value"].alias("value"), "stored")


def layers_long(entries: DataFrame, layers: tuple[str, ...], row: str = "cell_id", col: str = "site_id") -> DataFrame:
    """(layer, row, col, value) of wide entries; zeros aren't stored."""
    return entries.unpivot([row, col], list(layers), "layer", "value").where("value > 0").select("layer", F.col(row).alias("row"), F.col(col).alias("col"), "value")
