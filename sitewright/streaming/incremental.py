"""Site and molecule counts as Structured Streaming queries: the aggregations are commutative, so each micro-batch updates the last state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sitewright.operators.pileup import pileup
from sitewright.operators.umi import umi_calls


def stream_bases(spark: SparkSession, path: str, schema: StructType, files_a_batch: int = 100) -> DataFrame:
    """Base rows of Parquet files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def streaming_pileup(bases: DataFrame, min_mapq: int, min_baseq: int) -> DataFrame:
    return pileup(bases, min_mapq=min_mapq, min_baseq=min_baseq)


def streaming_umi_calls(bases: DataFrame, stranded: bool) -> DataFrame:
    return umi_calls(bases, stranded)


def start_counts(counts: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Into a memory table of that name, whole after each batch; for tests and small targets."""
    return counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
