"""Connected components of a link table, by alternating large and small stars.

Every step is a minimum per node (combined on the map side) and a join that adaptive execution may split where a node
has very many links; nothing is collected, and each round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import drop_path, written_at


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node, root): each node that has a link, and the smallest node it can reach.

    Self-links, repeated links and either direction are allowed; nulls are dropped; no links give an empty table.
    """
    spark = links.sparkSession
    first = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, path = written_at(first, "links")
    before = _digest(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x")).select("x.a", F.col("x.m").alias("b")).where("a > b").distinct()
        newer, newer_path = written_at(small, "links")
        after = _digest(newer)
        drop_path(spark, path)
        stars, path = newer, newer_path
        if after == before:
            break
        before = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a") % 1_000_003)).first())


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels 0..n-1: the smallest index that each index reaches by the links i-j."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for ends in (i, j):
            np.minimum.at(new, label[ends], low)
            np.minimum.at(new, ends, low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
    return label
