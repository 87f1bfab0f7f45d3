"""Helpers that all training-data operators share: the shared folder, written stages, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.stages import drop_path, shared_dir, written, written_at

__all__ = ["drop_path", "joined_apart", "map_batches", "shared_dir", "shuffle_partitions", "table", "text_of", "written", "written_at"]
ROWS_AT_A_TIME, BYTES_AT_A_TIME = 1000, 16 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT = 1000


def joined_apart(many: DataFrame, one: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """many with the columns of one, which has one row for each key and in `rows` how many rows of many have it. Both are written tables.

    Keys with more than a HOT-th of all rows, of which there can be HOT at most, are sent to every task; the rest is dealt
    by key, so no task gets more than a HOT-th of the rows for one key.
    """
    total = one.agg(F.sum(rows)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(rows) * HOT > total).drop(rows))
    cold = one.where(F.col(rows) * HOT <= total).drop(rows)
    return many.join(hot, keys).unionByName(many.join(hot.select(keys), keys, "left_anti").join(cold, keys))


def text_of(column: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df by mapInArrow. What fn sees at a time is bounded here, in rows and bytes, and not by the session's settings; the engine's own bound on a batch is 64 MB."""

    def some_at_a_time(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = max(1, min(ROWS_AT_A_TIME, batch.num_rows * BYTES_AT_A_TIME // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)

    return df.mapInArrow(lambda batches: fn(some_at_a_time(batches)), schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
