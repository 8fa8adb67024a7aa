"""Alignment files in BAM as a reads table.

This is the way for stores that only Spark can read: the files come as rows of its own binary reader, each decoded by one task, of 2 GB at most. Indexed files
of any size in other stores are read by many tasks, and only where they are needed (`bam`). CRAM needs a reference-based codec that is not at hand.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.sources.tables import READS

# The letters of 4-bit bases, and of CIGAR operations.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Records of a batch.
BATCH = 20_000
_PAIRS = np.array([a + b for a in BASES for b in BASES])


def decode_bases(packed: bytes, n: int) -> str:
    """n bases of a record, two in a byte, the first in the upper half."""
    return "".join(_PAIRS[np.frombuffer(packed, np.uint8)])[:n]


def records(stream: io.BufferedIOBase) -> Iterator[tuple]:
    """(qname, flag, chrom, pos, end_pos, mapq, tlen, cigar, seq, qual) of each aligned record of an uncompressed BAM stream; what is cut off at the end is left out."""
    if stream.read(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.read(struct.unpack("<i", stream.read(4))[0])
    names = []
    for _ in range(struct.unpack("<i", stream.read(4))[0]):
        names.append(stream.read(struct.unpack("<i", stream.read(4))[0])[:-1].decode())
        stream.read(4)
    while len(size := stream.read(4)) == 4:
        body = stream.read(struct.unpack("<i", size)[0])
        if len(body) < struct.unpack("<i", size)[0]:
            return
        if struct.unpack_from("<i", body)[0] >= 0:
            yield record(body, names)


def record(body: bytes, names: list[str]) -> tuple:
    """(qname, flag, chrom, pos, end_pos, mapq, tlen, cigar, seq, qual) of an aligned record's bytes."""
    ref, pos, n_name, mapq, _, n_ops, flag, n_seq, _, _, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32 + n_name
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    at += 4 * n_ops
    cigar = [(OPERATIONS[x & 15], x >> 4) for x in ops]
    seq = decode_bases(body[at : at + (n_seq + 1) // 2], n_seq)
    at += (n_seq + 1) // 2
    span = sum(n for op, n in cigar if op in "MDN=X")
    return body[32 : 32 + n_name - 1].decode(), flag, names[ref], pos, pos + span, mapq, tlen, cigar, seq, list(body[at : at + n_seq])


def batch_of(sample: str, rows: list[tuple]) -> pa.RecordBatch:
    """Records of a sample with the columns of READS; `chr` goes from contigs."""
    cigar = pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), cigar, pa.string(), pa.list_(pa.int32())]
    columns = list(zip(*rows, strict=True))
    columns[7] = [[{"op": op, "len": n} for op, n in x] for x in columns[7]]
    columns[2] = [x.removeprefix("chr") for x in columns[2]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([[sample] * len(rows), *columns], kinds, strict=True)], names=[f.split(" ")[0] for f in READS.split(", ")])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """The records of one or many BAM files, with the columns of READS; the sample is the file's name without its ending, and `chr` goes from contigs."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows: list[tuple] = []
                for row in records(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                    rows.append(row)
                    if len(rows) == BATCH:
                        yield batch_of(sample, rows)
                        rows = []
                if rows:
                    yield batch_of(sample, rows)

    files = spark.read.format("binaryFile").load(path)
    sample = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.bam$", "")
    return files.select(sample.alias("sample"), "content").mapInArrow(decode, READS)
