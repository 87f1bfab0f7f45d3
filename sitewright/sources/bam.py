"""Aligned reads from BAM and SAM.

`open_bam` picks the way: the data source `bam` for indexed files on a path that executors can open, which cuts a file where
its index says that a record begins and reads only the ranges in which regions or contigs can have records; and `read_bam`,
which works in any store Spark reads, but has one task and at most 2 GB for each file. Formats follow the public SAM
specification. CRAM isn't read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sitewright.errors import ParseFailure, UnsupportedFormat
from sitewright.schema import READS

# Fixed values of the format.
CIGAR_LETTERS = "MIDNSHP=X"
SEQ_LETTERS = "=ACMGRSVTWYHKDBN"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
PAIRS = [a + b for a in SEQ_LETTERS for b in SEQ_LETTERS]
SPLIT_BYTES = 64 << 20
COUNTS_BIN, WINDOW_BITS = 37450, 14
# First bin and width in bits of each level of the index.
BIN_LEVELS = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14))
COLUMNS = tuple(f.name for f in READS)
ARROW = pa.schema([("read_id", pa.int64()), ("contig", pa.string()), ("start", pa.int64()), ("mapq", pa.int32()), ("flag", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("cb", pa.string()), ("umi", pa.string())])


def blocks_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each member of a block-gzipped file."""
    at = 0
    while at < len(data):
        member = zlib.decompressobj(31)
        size = struct.unpack_from("<H", data, at + 16)[0] + 1 if data[at + 12 : at + 14] == b"BC" else len(data) - at
        yield at, member.decompress(data[at : at + size])
        if not member.eof:
            raise ParseFailure("a block ends early")
        at += size - len(member.unused_data)


def file_blocks(file: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(place, content) of each block of an open file, from where it stands."""
    while True:
        at, head = file.tell(), file.read(18)
        if len(head) < 18:
            return
        yield at, zlib.decompressobj(31).decompress(head + file.read(struct.unpack_from("<H", head, 16)[0] + 1 - 18))


class Buffer:
    """Bytes on demand from a stream of blocks."""

    def __init__(self, blocks: Iterator[tuple[int, bytes]]) -> None:
        self.blocks, self.place, self.data, self.at = blocks, 0, b"", 0

    def tell(self) -> int | None:
        """The virtual offset of the next byte; None at the end."""
        while self.at == len(self.data):
            more = next(self.blocks, None)
            if more is None:
                return None
            (self.place, self.data), self.at = more, 0
        return self.place << 16 | self.at

    def take(self, n: int) -> bytes:
        parts = []
        while n:
            if self.tell() is None:
                raise ParseFailure("the file ends inside a record")
            parts.append(self.data[self.at : self.at + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def read_header(buffer: Buffer) -> list[tuple[str, int]]:
    """(contig, length) in the file's order."""
    if buffer.take(4) != b"BAM\1":
        raise ParseFailure("no BAM file")
    buffer.take(buffer.number())
    out = []
    for _ in range(buffer.number()):
        name = buffer.take(buffer.number())[:-1].decode()
        out.append((name, buffer.number()))
    return out


def tags_of(data: bytes) -> dict[str, str]:
    """String tags and byte arrays, as text."""
    found, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode("ascii", "replace"), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            found[name] = data[at:end].decode("utf-8", "replace")
            at = end + 1
        elif kind == "B":
            item, n = chr(data[at]), struct.unpack_from("<I", data, at + 1)[0]
            size = TAG_SIZES[item]
            if item in "cC":
                found[name] = data[at + 5 : at + 5 + n].decode("utf-8", "replace")
            at += 5 + n * size
        else:
            at += TAG_SIZES[kind]
    return found


def parse_record(data: bytes, contigs: list[str], number: int, cb: str = "CB", umi: str = "UB") -> tuple:
    """A row of READS; cb and umi name the tags of cell and molecule."""
    tid, pos, name_size, mapq, _, n_cigar, flag, size = struct.unpack_from("<iiBBHHHi", data)
    at = 32 + name_size
    cigar = "".join(f"{x >> 4}{CIGAR_LETTERS[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", data, at))
    at += 4 * n_cigar
    half = (size + 1) // 2
    seq = "".join(map(PAIRS.__getitem__, data[at : at + half]))[:size]
    at += half
    qual = data[at : at + size]
    tags = tags_of(data[at + size :])
    text = None if not size or qual[0] == 255 else bytes(q + 33 for q in qual).decode("latin-1")
    return number, contigs[tid] if tid >= 0 else None, pos, mapq, flag, cigar or None, seq or None, text, tags.get(cb), tags.get(umi)


def batches_of(rows: Iterator[tuple], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held)
            held = []
    if held:
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ARROW)], schema=ARROW)


def records_of(buffer: Buffer, contigs: list[str], first: int = 0, end: int = -1, cb: str = "CB", umi: str = "UB") -> Iterator[tuple]:
    """Records that begin before the virtual offset `end`, if there is one."""
    while (at := buffer.tell()) is not None and (end < 0 or at < end):
        yield parse_record(buffer.take(buffer.number()), contigs, first, cb, umi)
        first += 1


def parse_bam(data: bytes, cb: str = "CB", umi: str = "UB") -> Iterator[tuple]:
    buffer = Buffer(blocks_of(data))
    contigs = [name for name, _ in read_header(buffer)]
    yield from records_of(buffer, contigs, cb=cb, umi=umi)


def read_bam(spark: SparkSession, path: str, cb: str = "CB", umi: str = "UB") -> DataFrame:
    """READS of one or more BAM files below 2 GB each."""
    if path.lower().endswith(".cram"):
        raise UnsupportedFormat("CRAM isn't read; convert to BAM")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from batches_of(parse_bam(content.as_py(), cb, umi))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, READS)


def bam_header(spark: SparkSession, path: str, piece: int = 1 << 18) -> DataFrame:
    """(tid, contig, length). Only the beginning of the file comes to the driver, as much as the header takes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        data = b""
        while True:
            more = bytes(stream.readNBytes(piece))
            data, piece = data + more, 2 * piece
            try:
                header = read_header(Buffer(blocks_of(data)))
                break
            except (ParseFailure, IndexError, struct.error, zlib.error):
                if not more:
                    raise ParseFailure(f"{path} has no whole header") from None
    finally:
        stream.close()
    return spark.createDataFrame([(k, name, length) for k, (name, length) in enumerate(header)], "tid bigint, contig string, length bigint")


def open_bam(spark: SparkSession, path: str, cb: str = "CB", umi: str = "UB", contigs: list[str] | None = None, regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """READS of a BAM file, by its index where executors can open both. contigs, regions (0-based, half-open): read these only.

    Regions say which ranges of the file are read and which records come; without an index every record does, so a filter
    by position is needed all the same.
    """
    local = path.removeprefix("file://")
    if path.lower().endswith(".cram") or "://" in local or not os.path.exists(f"{local}.bai"):
        return read_bam(spark, path, cb, umi)
    spark.dataSource.register(BamSource)
    reader = spark.read.format("bam").option("cbTag", cb).option("umiTag", umi)
    if contigs is not None:
        reader = reader.option("contigs", ",".join(contigs))
    if regions is not None:
        reader = reader.option("regions", json.dumps(regions))
    return reader.load(path)


def read_sam(spark: SparkSession, path: str, cb: str = "CB", umi: str = "UB") -> DataFrame:
    """READS of a text SAM file, in DataFrame expressions."""
    fields = F.split("value", "\t")
    get = lambda k: F.get(fields, F.lit(k))
    tag = lambda name: F.nullif(F.regexp_extract("value", f"\\t{name}:Z:([^\\t]*)", 1), F.lit(""))
    known = lambda c: F.nullif(c, F.lit("*"))
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.col("value") != ""))
    return rows.select(F.monotonically_increasing_id().alias("read_id"), known(get(2)).alias("contig"), (get(3).cast("bigint") - 1).alias("start"), get(4).cast("int").alias("mapq"), get(1).cast("int").alias("flag"), known(get(5)).alias("cigar"), known(get(9)).alias("seq"), known(get(10)).alias("qual"), tag(cb).alias("cb"), tag(umi).alias("umi"))


# --- indexed files


class Index(NamedTuple):
    """An index of the format BAI: for each contig its bins with chunks of virtual offsets, and the first offset of each window."""

    bins: list[dict[int, list[tuple[int, int]]]]
    windows: list[tuple[int, ...]]

    def starts(self) -> list[int]:
        """Virtual offsets at which a record begins."""
        found = {a for bins in self.bins for chunks in bins.values() for a, _ in chunks}
        return sorted(found | {x for windows in self.windows for x in windows if x})

    def chunks(self, tid: int, start: int, stop: int) -> list[tuple[int, int]]:
        """Ranges of virtual offsets that hold all records of the contig that overlap start..stop."""
        if tid >= len(self.bins):
            return []
        windows = self.windows[tid]
        first = min(start >> WINDOW_BITS, len(windows) - 1)
        least = windows[first] if windows and first >= 0 else 0
        wanted = {first_bin + (at >> shift) for first_bin, shift in BIN_LEVELS for at in range(start >> shift << shift, max(stop, start + 1), 1 << shift)} if stop - start < 1 << 26 else self.bins[tid].keys()
        return [(a, b) for number in wanted for a, b in self.bins[tid].get(number, ()) if b > least]


def read_index(index: bytes) -> Index:
    if index[:4] != b"BAI\1":
        raise ParseFailure("no index of the format BAI")
    at, found = 4, Index([], [])

    def numbers(kind: str, n: int) -> tuple:
        nonlocal at
        out = struct.unpack_from(f"<{n}{kind}", index, at)
        at += struct.calcsize(f"<{n}{kind}")
        return out

    for _ in range(numbers("i", 1)[0]):
        bins = {}
        for _ in range(numbers("i", 1)[0]):
            number, chunks = numbers("I", 1)[0], numbers("i", 1)[0]
            ends = numbers("Q", 2 * chunks)
            if number != COUNTS_BIN:
                bins[number] = list(zip(ends[::2], ends[1::2]))
        found.bins.append(bins)
        found.windows.append(numbers("Q", numbers("i", 1)[0]))
    return found


def record_starts(index: bytes) -> list[int]:
    """Virtual offsets at which a record begins, by an index of the format BAI."""
    return read_index(index).starts()


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_ranges(ranges: list[tuple[int, int]], starts: list[int], every: int) -> list[tuple[int, int]]:
    """Ranges cut into pieces of about `every` compressed bytes, at places where records begin."""
    out = []
    for a, b in ranges:
        while (b >> 16) - (a >> 16) > every:
            k = bisect_left(starts, ((a >> 16) + every) << 16)
            if k == len(starts) or starts[k] >= b:
                break
            out.append((a, starts[k]))
            a = starts[k]
        out.append((a, b))
    return out


def covered(cigar: str | None) -> int:
    """How many reference positions a cigar covers."""
    return sum(int(n) for n, op in re.findall("([0-9]+)([MIDNSHP=X])", cigar or "") if op in "MDN=X")


class Regions:
    """Disjoint regions by contig; asked whether a record overlaps one."""

    def __init__(self, regions: list[tuple[str, int, int]]) -> None:
        by_contig: dict[str, list[tuple[int, int]]] = {}
        for contig, start, stop in regions:
            if stop > start:
                by_contig.setdefault(contig, []).append((start, stop))
        self.of = {contig: united(ranges) for contig, ranges in by_contig.items()}
        self.starts = {contig: [a for a, _ in ranges] for contig, ranges in self.of.items()}

    def hold(self, row: tuple) -> bool:
        _, contig, pos, _, _, cigar, *_ = row
        if contig not in self.of:
            return False
        k = bisect_right(self.starts[contig], pos) - 1
        if k >= 0 and self.of[contig][k][1] > pos:
            return True
        return k + 1 < len(self.starts[contig]) and self.starts[contig][k + 1] < pos + max(covered(cigar), 1)


def cut_points(starts: list[int], size: int, every: int = SPLIT_BYTES) -> list[tuple[int, int]]:
    """Ranges of virtual offsets of about `every` compressed bytes that begin at records; the last is open (-1)."""
    cuts, at = [], 0
    while starts and at < size:
        k = bisect_left(starts, at << 16)
        if k == len(starts):
            break
        if not cuts or starts[k] != cuts[-1]:
            cuts.append(starts[k])
        at = max(at + every, starts[k] >> 16) if at else every
    return list(zip(cuts, [*cuts[1:], -1]))


class BamRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int, number: int) -> None:
        self.path, self.begin, self.end, self.number = path, begin, end, number


class BamReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.every = int(options.get("splitBytes", SPLIT_BYTES))
        self.tags = options.get("cbTag", "CB"), options.get("umiTag", "UB")
        self.contigs = set(options["contigs"].split(",")) if "contigs" in options else None
        self.regions = Regions([tuple(r) for r in json.loads(options["regions"])]) if "regions" in options else None

    def partitions(self) -> list[BamRange]:
        try:
            with open(f"{self.path}.bai", "rb") as file:
                index = read_index(file.read())
        except FileNotFoundError:
            return [BamRange(self.path, 0, -1, 0)]
        if self.contigs is None and self.regions is None:
            ranges = cut_points(index.starts(), os.path.getsize(self.path), self.every) or [(0, -1)]
        else:
            with open(self.path, "rb") as file:
                header = read_header(Buffer(file_blocks(file)))
            wanted = []
            for tid, (contig, length) in enumerate(header):
                if self.contigs is None or contig in self.contigs:
                    for start, stop in [(0, length)] if self.regions is None else self.regions.of.get(contig, []):
                        wanted += index.chunks(tid, start, stop)
            ranges = cut_ranges(united(wanted), index.starts(), self.every) or [(0, 0)]  # a range without records
        return [BamRange(self.path, a, b, k) for k, (a, b) in enumerate(ranges)]

    def read(self, partition: BamRange) -> Iterator[pa.RecordBatch]:
        with open(partition.path, "rb") as file:
            buffer = Buffer(file_blocks(file))
            contigs = [name for name, _ in read_header(buffer)]
            if partition.begin:
                file.seek(partition.begin >> 16)
                buffer = Buffer(file_blocks(file))
                buffer.tell()
                buffer.at = partition.begin & 0xFFFF
            rows = records_of(buffer, contigs, partition.number << 40, partition.end, *self.tags)
            if self.contigs is not None:
                rows = (row for row in rows if row[1] in self.contigs)
            if self.regions is not None:
                rows = filter(self.regions.hold, rows)
            yield from batches_of(rows)


class BamSource(DataSource):
    """spark.dataSource.register(BamSource); spark.read.format("bam").option("contigs", "chr1,chr2").load(path)

    Options: contigs; regions, a JSON list of [contig, start, stop]; cbTag, umiTag; splitBytes. The index gives the ranges
    of the file that contigs and regions need; nothing else is read.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self):
        return READS

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)
