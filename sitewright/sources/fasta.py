"""Reference sequences as blocks (contig, block, seq), and bases at positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.config import path_exists
from sitewright.errors import EmptyData, MissingFile
from sitewright.functions.tags import site_contig, site_pos

BLOCK = 4096


def read_fasta(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(contig, block, seq): block k of a contig holds its bases from k x size, in capitals. Any store Spark reads will do.

    The file is read by lines, so a chromosome is spread over all its splits and no task holds one. A first pass counts the
    bases before the first and after the last header of each split; from these the second knows where each split begins.
    Blocks that two splits share are joined; all others go out as they are cut.
    """
    if not path_exists(spark, path):
        raise MissingFile(path)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}  # (bases before the first header, last contig, bases after the last header)
        for batch in batches:
            for file, split, line in zip(*(c.to_pylist() for c in batch.columns)):
                seen = found.setdefault((file, split), [0, None, 0])
                if line.startswith(">"):
                    seen[1:] = [name_of(line), 0]
                elif seen[1] is None:
                    seen[0] += len("".join(line.split()))
                else:
                    seen[2] += len("".join(line.split()))
        rows = [(*key, *seen) for key, seen in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], names=["file", "split", "head", "contig", "tail"])

    # One row for each split of the file.
    splits = sorted(map(tuple, lines.mapInArrow(count, "file string, split bigint, head bigint, contig string, tail bigint").collect()), key=lambda r: r[:2])
    begins, contig, place, here = {}, "", 0, None
    for file, split, head, last, tail in splits:
        if file != here:
            contig, place, here = "", 0, file
        begins[file, split] = contig, place
        contig, place = (contig, place + head) if last is None else (last, tail)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, contig, place, held, size = None, "", 0, [], 0
        out: list[tuple] = []

        def flush(all_of_it: bool) -> None:
            """Bases held from `place` on go out in blocks; the last one, if it isn't whole, only when nothing follows."""
            nonlocal place, held, size
            seq, at = "".join(held), 0
            while at < len(seq):
                step = block - place % block
                if len(seq) - at < step and not all_of_it:
                    break
                part = seq[at : at + step]
                out.append((contig, place // block, place % block, part))
                at, place = at + len(part), place + len(part)
            held = [seq[at:]] if at < len(seq) else []
            size = len(seq) - at

        def batch_of() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["contig", "block", "at", "seq"])
            out.clear()
            return batch

        for batch in batches:
            for *now, line in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    flush(True)
                    key = now
                    contig, place = begins[tuple(now)]
                if line.startswith(">"):
                    flush(True)
                    contig, place = name_of(line), 0
                    continue
                held.append("".join(line.split()).upper())
                size += len(held[-1])
                if size >= 16 * block:
                    flush(False)
                if len(out) >= 512:
                    yield batch_of()
        flush(True)
        yield batch_of()

    parts = lines.mapInArrow(cut, "contig string, block bigint, at int, seq string")
    whole = (F.col("at") == 0) & (F.length("seq") == block)
    joined = parts.where(~whole).groupBy("contig", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda x: x.seq), "").alias("seq"))
    return parts.where(whole).select("contig", "block", "seq").unionByName(joined)


def name_of(line: str) -> str:
    """The contig that a header line names."""
    return (line[1:].split() or [""])[0]


def contig_names(spark: SparkSession, fai: str) -> DataFrame:
    """(tid, contig, length) of a FASTA index, in its order."""
    if not path_exists(spark, fai):
        raise MissingFile(fai)
    lines = spark.read.text(fai).collect()  # one line for each contig
    rows = [(k, *r.value.split("\t")[:2]) for k, r in enumerate(x for x in lines if x.value.strip())]
    if not rows:
        raise EmptyData(f"no contigs in {fai}")
    return spark.createDataFrame([(k, name, int(length)) for k, name, length in rows], "tid bigint, contig string, length bigint")


def bases_at(positions: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """positions (contig, pos from 1, ...) with base: A, C, G or T, and N for anything else or anywhere outside.

    Positions go to their block, never blocks to all positions.
    """
    asked = positions.withColumn("block", F.when(F.col("pos") > 0, F.expr(f"(pos - 1) div {block}")))
    found = asked.join(blocks.select("contig", "block", "seq"), ["contig", "block"], "left")
    letter = F.substring("seq", (F.pmod(F.col("pos") - 1, F.lit(block)) + 1).cast("int"), F.lit(1))
    return found.withColumn("base", F.when(letter.isin("A", "C", "G", "T"), letter).otherwise("N")).drop("block", "seq")


def bases_of_sites(sites: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """sites (site `contig:pos`) with base; N where the name isn't one."""
    parsed = sites.withColumns({"contig": site_contig(F.col("site")), "pos": site_pos(F.col("site"))})
    return bases_at(parsed, blocks, block)


def as_reference(blocks: DataFrame, positions: DataFrame, block: int = BLOCK) -> DataFrame:
    """(contig, pos, base) at the positions asked for, as `add_reference` takes it."""
    return bases_at(positions.select("contig", "pos").dropDuplicates(), blocks, block)
