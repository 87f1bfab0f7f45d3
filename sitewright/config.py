"""Settings of the three commands and their checks."""

from __future__ import annotations

import math
import os
import re
import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from sitewright import schema as S
from sitewright.errors import InvalidConfig, MissingFile, ThreadSetup


def _threshold(name: str, value: float) -> None:
    if not math.isfinite(value) or not 0 <= value <= 1:
        raise InvalidConfig(f"{name} must be a finite number from 0 to 1, not {value}")


def _positive(name: str, value: int) -> None:
    if value <= 0:
        raise InvalidConfig(f"{name} must be positive, not {value}")


@dataclass
class BulkConfig:
    min_mapq: int = S.MIN_MAPQ
    min_baseq: int = S.MIN_BASEQ
    min_depth: int = S.MIN_DEPTH
    max_n_fraction: int = S.MAX_N_FRACTION
    editing_threshold: int = S.EDITING_THRESHOLD
    max_depth: int = S.BULK_MAX_DEPTH
    all_sites: bool = False
    all_contigs: bool = False
    zero_base: bool = False
    tile: int = S.TILE

    def validate(self) -> BulkConfig:
        for name in ("max_n_fraction", "editing_threshold", "tile"):
            _positive(name, getattr(self, name))
        return self

    @property
    def edited_only(self) -> bool:
        return not self.all_sites


@dataclass
class MatrixConfig:
    min_mapq: int = S.MIN_MAPQ
    min_baseq: int = S.MIN_BASEQ
    max_depth: int = S.MATRIX_MAX_DEPTH
    stranded: bool = False
    all_contigs: bool = False
    missing_umi: str = "drop"
    two_pass: bool = False
    chunk_weight: int = S.CHUNK_WEIGHT
    hot_chunk: int = S.HOT_CHUNK
    umi_tag: str = "UB"
    cb_tag: str = "CB"
    bulk: BulkConfig = field(default_factory=BulkConfig)  # the thresholds of the first pass

    def validate(self) -> MatrixConfig:
        if self.missing_umi not in ("drop", "pool"):
            raise InvalidConfig("missing_umi is drop or pool")
        self.chunk_weight, self.hot_chunk = max(1, self.chunk_weight), max(1, self.hot_chunk)
        for name in ("umi_tag", "cb_tag"):
            if not re.fullmatch("[A-Za-z][A-Za-z0-9]", getattr(self, name)):
                raise InvalidConfig(f"{name} is a letter and a letter or digit, not {getattr(self, name)!r}")
        self.bulk.validate()
        return self

    def first_pass(self) -> BulkConfig:
        """The settings of the first of two passes: thresholds of `bulk`, and the filters and contigs of the matrix."""
        return replace(self.bulk, min_mapq=self.min_mapq, min_baseq=self.min_baseq, all_contigs=self.all_contigs, all_sites=False, zero_base=False)


@dataclass
class CallConfig:
    editing_type: str = "ag"
    max_other_threshold: float = 0.01
    min_edited_threshold: float = 0.01
    min_ref_threshold: float = 0.01
    min_coverage: int = S.MIN_COVERAGE
    chunk_size: int = 100_000
    threads: int = 2
    cei_fill: str = "nan"
    only_known_sites: bool = False

    def validate(self) -> CallConfig:
        for name in ("max_other_threshold", "min_edited_threshold", "min_ref_threshold"):
            _threshold(name, getattr(self, name))
        for name in ("min_coverage", "chunk_size", "threads"):
            _positive(name, getattr(self, name))
        if self.chunk_size > 100_000:
            warnings.warn("chunk_size above 100000 needs much memory", stacklevel=2)
        if self.threads > 2 * (os.cpu_count() or 1):
            warnings.warn("more threads than twice the processors", stacklevel=2)
        if self.cei_fill not in ("nan", "zero"):
            raise InvalidConfig("cei_fill is nan or zero")
        return self


def path_exists(spark: SparkSession, path: str) -> bool:
    """In whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def require_files(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not path_exists(spark, path):
            raise MissingFile(path)


def validate_call_inputs(spark: SparkSession, matrix: str, fasta: str, known_sites: str) -> None:
    """The matrix (an h5ad file, or the folder with its three tables), the FASTA with its index, and the list of known sites exist."""
    parts = [matrix] if matrix.endswith(".h5ad") else [f"{matrix}/{part}" for part in ("obs", "var", "entries")]
    require_files(spark, *parts, fasta, f"{fasta}.fai", known_sites)


def validate_output(spark: SparkSession, path: str, overwrite: bool = False) -> None:
    """An existing output is an error unless it may be replaced. Nothing is deleted here, so a dry run is safe."""
    if not overwrite and path_exists(spark, path):
        raise InvalidConfig(f"{path} exists")


def tuned(spark: SparkSession, threads: int) -> SparkSession:
    """Shuffle partitions for a number of threads."""
    if threads <= 0:
        raise ThreadSetup("at least one thread is needed")
    spark.conf.set("spark.sql.shuffle.partitions", str(threads))
    return spark
