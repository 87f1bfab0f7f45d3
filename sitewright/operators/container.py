"""The matrix of cells and sites: three tables that share their axes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.errors import DimensionMismatch, EmptyData
from sitewright.functions.tags import as_u32, site_id
from sitewright.schema import BASE_LAYERS, BASES, FORWARD_LAYERS, KNOWN_LAYERS, REVERSE_LAYERS
from sitewright.stages import written


@dataclass(frozen=True)
class SiteMatrix:
    """obs (cell_id, barcode, ...), var (site_id, site, contig, pos, ...), entries (cell_id, site_id, a column for each layer).

    layers: the layers that are present. x: the layer that is the main matrix.
    """

    obs: DataFrame
    var: DataFrame
    entries: DataFrame
    layers: tuple[str, ...]
    x: str | None = None

    @classmethod
    def empty_of_size(cls, spark: SparkSession, n_obs: int, n_vars: int) -> SiteMatrix:
        obs = spark.range(n_obs).select(F.col("id").alias("cell_id"), F.concat(F.lit("cell_"), "id").alias("barcode"))
        var = spark.range(n_vars).select(F.col("id").alias("site_id"), F.concat(F.lit("gene_"), "id").alias("site"))
        return cls(obs, var, spark.createDataFrame([], "cell_id bigint, site_id bigint"), ())

    @property
    def stranded(self) -> bool:
        """Decided by layer A0 alone."""
        return REVERSE_LAYERS[0] in self.layers

    @property
    def counted_layers(self) -> tuple[str, ...]:
        """The layers that coverage adds up: all eight if A0 is there, else the forward ones."""
        return tuple(layer for layer in (BASE_LAYERS if self.stranded else FORWARD_LAYERS) if layer in self.layers)

    def value(self, layer: str) -> Column:
        """A layer of entries; 0 where it isn't present."""
        return F.coalesce(F.col(layer), F.lit(0)).cast("bigint") if layer in self.layers else F.lit(0).cast("bigint")

    def written(self, name: str = "matrix") -> SiteMatrix:
        """The same matrix with sites and entries from tables in the shared folder."""
        return replace(self, var=written(self.var, f"{name}-var"), entries=written(self.entries, f"{name}-entries"))

    def layer(self, name: str) -> DataFrame | None:
        """(row, col, value) of one layer, or None."""
        if name not in self.layers:
            return None
        return self.entries.select(F.col("cell_id").alias("row"), F.col("site_id").alias("col"), F.col(name).alias("value")).where("value <> 0")

    def row_sums(self, layer: str) -> DataFrame | None:
        """(cell_id, total) over all cells."""
        return self._sums("cell_id", self.obs, layer)

    def col_sums(self, layer: str) -> DataFrame | None:
        """(site_id, total) over all sites."""
        return self._sums("site_id", self.var, layer)

    def _sums(self, axis: str, names: DataFrame, layer: str) -> DataFrame | None:
        if layer not in self.layers:
            return None
        sums = self.entries.groupBy(axis).agg(as_u32(F.sum(self.value(layer))).alias("total"))
        return names.select(axis).join(sums, axis, "left").select(axis, F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))

    def total_coverage(self) -> DataFrame:
        """(cell_id, total) over the counted layers."""
        total = sum((self.value(layer) for layer in self.counted_layers), F.lit(0))
        sums = self.entries.groupBy("cell_id").agg(as_u32(F.sum(total)).alias("total"))
        return self.obs.select("cell_id").join(sums, "cell_id", "left").select("cell_id", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))

    def with_coverage(self) -> SiteMatrix:
        """Adds the layer `coverage`; without base layers it is 0."""
        total = sum((self.value(layer) for layer in self.counted_layers), F.lit(0).cast("bigint"))
        return replace(self, entries=self.entries.withColumn("coverage", as_u32(total)), layers=(*(x for x in self.layers if x != "coverage"), "coverage"))

    def with_sites(self, keep: DataFrame) -> SiteMatrix:
        """Only the sites in keep (site_id): in var and every layer."""
        ids = keep.select("site_id")
        return replace(self, var=self.var.join(ids, "site_id", "left_semi"), entries=self.entries.join(ids, "site_id", "left_semi"))

    def with_cells(self, keep: DataFrame) -> SiteMatrix:
        ids = keep.select("cell_id")
        return replace(self, obs=self.obs.join(ids, "cell_id", "left_semi"), entries=self.entries.join(ids, "cell_id", "left_semi"))

    def validate(self) -> SiteMatrix:
        """Raises where names repeat, an axis is empty, or an entry has no name on either axis."""
        for names, key in ((self.obs, "cell_id"), (self.var, "site_id")):
            rows, different = names.agg(F.count("*"), F.count_distinct(key)).first()
            if not rows:
                raise EmptyData(f"no {key}")
            if rows != different:
                raise DimensionMismatch(f"{key} repeats")
            if not self.entries.join(names.select(key), key, "left_anti").isEmpty():
                raise DimensionMismatch(f"an entry has a {key} without a name")
        missing = [layer for layer in self.layers if layer not in self.entries.columns]
        if missing:
            raise DimensionMismatch(f"layers without a column: {missing}")
        return self

    def without_empty_layers(self) -> SiteMatrix:
        counts = self.entries.agg(*(F.count_if(self.value(layer) != 0).alias(layer) for layer in self.layers)).first() if self.layers else {}
        kept = tuple(layer for layer in self.layers if counts[layer])
        return replace(self, entries=self.entries.drop(*(set(self.layers) - set(kept))), layers=kept)

    def stats(self) -> DataFrame:
        """(layer, nnz, density) of each layer: what its storage depends on."""
        size = self.obs.agg(F.count("*").alias("n_obs")).crossJoin(self.var.agg(F.count("*").alias("n_vars")))  # one row each
        counts = self.entries.agg(*(F.count_if(self.value(layer) != 0).alias(layer) for layer in self.layers))
        long = counts.unpivot([], list(self.layers), "layer", "nnz")
        return long.crossJoin(F.broadcast(size)).select("layer", "nnz", (F.col("nnz") / F.greatest(F.col("n_obs") * F.col("n_vars"), F.lit(1))).alias("density"))


def known_layers(columns: list[str]) -> tuple[str, ...]:
    return tuple(layer for layer in KNOWN_LAYERS if layer in columns)


def assemble(counts: DataFrame, sites: DataFrame, barcodes: DataFrame, stranded: bool, stored: bool = False) -> SiteMatrix:
    """The matrix of cell-site counts (contig, pos, cell_id, layers).

    sites (contig, pos[, tid]): every processed site becomes a column, counts or none; site_id follows header order
    (tid, then position; names where there is no tid). Only cells with a count become rows; cell_id is the whitelist's.

    stored: sites and entries are written as soon as they are known, so that what made them runs once, whatever is asked of
    the matrix after.
    """
    keep = written if stored else lambda df, name: df
    layers = BASE_LAYERS if stranded else FORWARD_LAYERS
    order = ["tid", "pos"] if "tid" in sites.columns else ["contig", "pos"]
    var = keep(numbered(sites.dropDuplicates(["contig", "pos"]), order, "site_id").withColumn("site", site_id(F.col("contig"), F.col("pos"))), "sites")
    entries = keep(counts.join(var.select("contig", "pos", "site_id"), ["contig", "pos"]).select("cell_id", "site_id", *layers), "entries")
    obs = barcodes.join(entries.select("cell_id").distinct(), "cell_id", "left_semi")
    return SiteMatrix(obs, var, entries, tuple(layers), FORWARD_LAYERS[0])


def numbered(df: DataFrame, order: list[str], name: str, width: int = 1 << 16) -> DataFrame:
    """Consecutive numbers from 0 in the order of the columns, the last of which is a whole number, as positions are.

    Rows are cut into bins of `width` by that column. A window numbers each bin; the bins' sizes are added up on a table
    with one row for each bin, which one task does: some 50,000 rows for the sites of a human genome. Nothing depends on a
    sample or on how tasks fall, so a retried task gives the same numbers.
    """
    bins = [*(F.col(c).alias(f"__{k}") for k, c in enumerate(order[:-1])), F.floor(F.col(order[-1]) / width).alias("__bin")]
    binned = df.withColumn("__at", F.struct(*bins))
    before = Window.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("__at").agg(F.count("*").alias("__n")).select("__at", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = binned.withColumn("__k", F.row_number().over(Window.partitionBy("__at").orderBy(*order)))
    return local.join(starts, "__at").withColumn(name, (F.col("__start") + F.col("__k") - 1).cast("bigint")).drop("__at", "__start", "__k")


def triplet_layers(matrix: SiteMatrix) -> DataFrame:
    """(layer, row, col, value) of all base layers."""
    present = tuple(layer for layer in BASE_LAYERS if layer in matrix.layers)
    return matrix.entries.unpivot(["cell_id", "site_id"], list(present), "layer", "value").where("value > 0").select("layer", F.col("cell_id").alias("row"), F.col("site_id").alias("col"), "value")


def collapsed(matrix: SiteMatrix) -> dict[str, Column]:
    """Counts of each base on both strands."""
    return {b: matrix.value(b + "1") + matrix.value(b + "0") for b in BASES}
