"""Fixed names, types and defaults."""

from __future__ import annotations

from pyspark.sql import types as T

BASES = ("A", "T", "G", "C")
FORWARD, REVERSE = "1", "0"
FORWARD_LAYERS = tuple(b + FORWARD for b in BASES)
REVERSE_LAYERS = tuple(b + REVERSE for b in BASES)
BASE_LAYERS = FORWARD_LAYERS + REVERSE_LAYERS
CALL_LAYERS = ("ref", "alt", "others", "coverage")
KNOWN_LAYERS = BASE_LAYERS + CALL_LAYERS
STANDARD_CONTIGS = tuple(f"chr{n}" for n in (*range(1, 23), "X", "Y", "M"))
U32_MAX = 4294967295
TILE = 500_000

#: Defaults of the commands.
MIN_MAPQ, MIN_BASEQ = 255, 30
MIN_DEPTH, MAX_N_FRACTION, EDITING_THRESHOLD = 10, 20, 1000
BULK_MAX_DEPTH, MATRIX_MAX_DEPTH = 8000, 65536
CHUNK_WEIGHT, HOT_CHUNK = 100_000, 2
MIN_COVERAGE = 5
#: Reads the pileup of the SAM tools leaves out: unmapped, secondary, failed, duplicate.
SKIPPED_FLAGS = 0x704

_long = lambda *names: [T.StructField(n, T.LongType()) for n in names]

READS = T.StructType([T.StructField("read_id", T.LongType()), T.StructField("contig", T.StringType()), T.StructField("start", T.LongType()), T.StructField("mapq", T.IntegerType()), T.StructField("flag", T.IntegerType()), T.StructField("cigar", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()), T.StructField("cb", T.StringType()), T.StructField("umi", T.StringType())])
BULK = T.StructType([T.StructField("CHR", T.StringType()), *_long("POS", "DEPTH", "A", "C", "G", "T", "N", "INS", "DEL", "REF_SKIP", "FAIL"), T.StructField("NEAR_MAX_DEPTH", T.BooleanType())])
BULK_COLUMNS = tuple(f.name for f in BULK)
MANIFEST_REQUIRED = ("CHR", "POS", "DEPTH", "INS", "DEL", "REF_SKIP", "FAIL", "NEAR_MAX_DEPTH")
RANGES = T.StructType([T.StructField("CHR", T.StringType()), *_long("POS", "END", "DEPTH")])
INTERVALS = T.StructType([T.StructField("contig", T.StringType()), *_long("start", "stop")])
SKIPPED = T.StructType([T.StructField("CHR", T.StringType()), *_long("POS", "DEPTH")])
