"""Tables written between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from sitewright.errors import InvalidConfig

CHECKPOINT_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is named, a local one serves a local master; any other master is refused."""
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise InvalidConfig(f"{CHECKPOINT_CONF} must name a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local:
        _local[application] = "file://" + tempfile.mkdtemp(prefix="sitewright-")
    return _local[application]


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path below stages/<application id>, a folder that goes when the driver's engine ends."""
    folder = f"{shared_dir(spark)}/stages/{spark.sparkContext.applicationId}"
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        store.mkdirs(p)
        store.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark, schema = df.sparkSession, df.schema
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a lost executor costs no recomputation.

    Results read such tables when they are used, so they stay until the application ends.
    """
    return written_at(df, name)[0]


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a stage that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
