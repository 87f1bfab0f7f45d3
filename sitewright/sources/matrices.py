"""Matrices as three Parquet tables, or by a name that ends in .h5ad as one file, where the library anndata is installed.

An h5ad file is read and written by the driver alone, so its matrix must fit there.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import require_files
from sitewright.errors import EmptyData, UnsupportedFormat
from sitewright.functions.tags import float_to_u32, site_contig, site_pos
from sitewright.operators.container import SiteMatrix, known_layers
from sitewright.schema import CALL_LAYERS

PARTS = ("obs", "var", "entries")
MOST_ENTRIES = 200_000_000


def write_matrix(matrix: SiteMatrix, path: str, layers: tuple[str, ...] | None = None) -> None:
    """obs, var and entries under path; entries by site, so that neighbours lie together. Zeros in all layers aren't stored."""
    kept = tuple(x for x in (layers or matrix.layers) if x in matrix.layers)
    if path.endswith(".h5ad"):
        write_h5ad(replace(matrix, layers=kept, x=matrix.x if matrix.x in kept else None), path)
        return
    entries = matrix.entries.select("cell_id", "site_id", *kept)
    if kept:
        entries = entries.where(" or ".join(f"`{x}` <> 0" for x in kept))
    matrix.obs.write.mode("overwrite").parquet(f"{path}/obs")
    matrix.var.write.mode("overwrite").parquet(f"{path}/var")
    entries.repartitionByRange("site_id").write.mode("overwrite").parquet(f"{path}/entries")


def write_called(matrix: SiteMatrix, path: str) -> None:
    """The result of calling: the layers ref, alt, others and coverage only."""
    write_matrix(matrix, path, CALL_LAYERS)


def read_matrix(spark: SparkSession, path: str, check: bool = True) -> SiteMatrix:
    """Known layers only; values become whole numbers of 32 bits. No cells or no sites is an error."""
    if path.endswith(".h5ad"):
        matrix = read_h5ad(spark, path)
        return matrix.validate() if check else matrix
    require_files(spark, *(f"{path}/{part}" for part in PARTS))
    obs, var, entries = (spark.read.parquet(f"{path}/{part}") for part in PARTS)
    if obs.isEmpty() or var.isEmpty():
        raise EmptyData(f"{path} has no cells or no sites")
    layers = known_layers(entries.columns)
    types = dict(entries.dtypes)
    entries = entries.select("cell_id", "site_id", *(float_to_u32(F.col(x)).alias(x) if types[x] in ("float", "double") else F.col(x).cast("bigint").alias(x) for x in layers))
    matrix = SiteMatrix(obs, var, entries, layers, "alt" if "alt" in layers else layers[0] if layers else None)
    return matrix.validate() if check else matrix


def read_h5ad(spark: SparkSession, path: str) -> SiteMatrix:
    """An h5ad file on a path that the driver can open: names of cells and sites, their columns, and the known layers."""
    require_files(spark, path)
    try:
        import anndata
    except ImportError:
        raise UnsupportedFormat("h5ad needs anndata; convert to Parquet") from None
    data = anndata.read_h5ad(path)
    if not data.n_obs or not data.n_vars:
        raise EmptyData(f"{path} has no cells or no sites")
    layers = known_layers([str(x) for x in data.layers.keys()])

    def axis(table, number: str, name: str) -> DataFrame:
        rest = [c for c in table.columns if c not in (number, name, "contig", "pos")]
        return spark.createDataFrame(pa.table({number: pa.array(range(len(table)), pa.int64()), name: pa.array([str(x) for x in table.index], pa.string())} | {str(c): pa.array(table[c].tolist()) for c in rest}))

    var = axis(data.var, "site_id", "site").withColumns({"contig": site_contig(F.col("site")), "pos": site_pos(F.col("site"))})
    parts = []
    for name in layers:
        found = data.layers[name].tocoo()
        part = spark.createDataFrame(pa.table({"cell_id": pa.array(found.row, pa.int64()), "site_id": pa.array(found.col, pa.int64()), "value": pa.array(found.data, pa.float64())}))
        parts.append(part.select("cell_id", "site_id", *((float_to_u32(F.col("value")) if x == name else F.lit(0).cast("bigint")).alias(x) for x in layers)))
    entries = reduce(DataFrame.unionByName, parts).groupBy("cell_id", "site_id").agg(*(F.sum(x).alias(x) for x in layers)) if parts else spark.createDataFrame([], "cell_id bigint, site_id bigint")
    return SiteMatrix(axis(data.obs, "cell_id", "barcode"), var, entries, layers, "alt" if "alt" in layers else layers[0] if layers else None)


def write_h5ad(matrix: SiteMatrix, path: str) -> None:
    """For matrices that fit one machine, of at most MOST_ENTRIES entries; needs the library anndata."""
    try:
        import anndata
        import scipy.sparse
    except ImportError:
        raise UnsupportedFormat("h5ad needs anndata and scipy; write Parquet instead") from None
    if (n := matrix.entries.count()) > MOST_ENTRIES:
        raise UnsupportedFormat(f"{n} entries are too many for one machine; write Parquet instead")
    obs, var = matrix.obs.orderBy("cell_id").toPandas(), matrix.var.orderBy("site_id").toPandas()
    rows, cols = ({v: k for k, v in enumerate(t[c])} for t, c in ((obs, "cell_id"), (var, "site_id")))
    entries = matrix.entries.toPandas()
    at = (entries.cell_id.map(rows), entries.site_id.map(cols))
    layers = {x: scipy.sparse.csr_matrix((entries[x], at), (len(obs), len(var))) for x in matrix.layers}
    main = layers.get(matrix.x)
    anndata.AnnData(X=None if main is None else main.astype("float32"), obs=obs.set_index("barcode"), var=var.set_index("site"), layers=layers).write_h5ad(path)
