"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

Pieces of one length are interchangeable, so the packing of the whole corpus is decided from its histogram of lengths
(as many rows as a sequence has tokens, whatever the corpus): best-fit decreasing runs over the lengths, the segment tree finds
the tightest open remaining capacity in logarithmic time, and bins that have been filled alike are kept as one range. The
plan has one row per range and layer, bounded by the sequence length alone, and each piece finds its place from its rank among the pieces of
its length. Ranks come from counts by (length, bucket), so no task holds all pieces of a common length.

Defined cases: a null or empty text is one piece that holds the end id only; a repeated row is packed again; a null
doc_id is packed like any other; no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraloom.llm.common import cut, read_table, trim
from paraloom.llm.tokens import END_ID, crc_of, encoder, vocabulary_path

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
#: Pieces of a bucket as long as there are few, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 1000, 4096
#: Bytes of texts that are encoded together, and units whose ids a worker keeps: few, for this stage shares its workers with others.
CHUNK_BYTES, KEPT_UNITS = 1_500_000, 120_000


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity: which have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, remaining: int, bins: int) -> None:
        k = remaining + self.size
        while k:
            self.open[k] += bins
            k >>= 1

    def tightest(self, needed: int) -> int | None:
        """The smallest remaining capacity of needed or more that has an open bin."""
        k = needed + self.size
        if self.open[k]:
            return needed
        while k > 1:
            if not k & 1 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(length, first rank, pieces, first bin, offset) rows in order of length and rank, and the number of bins."""
    tree, ranges, plan, bins = CapacityTree(capacity), {}, [], 0

    def keep(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            ranges.setdefault(remaining, []).append((first, count))
            tree.add(remaining, count)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first, count = capacity, bins, -(-left // (capacity // length))
                bins += count
            else:
                first, count = ranges[remaining].pop()
                tree.add(remaining, -count)
            each = remaining // length
            full = min(count, left // each)
            rest = min(left - full * each, each - 1) if full < count else 0
            for layer in range(each):
                if full:
                    plan.append((length, rank, full, first, capacity - remaining + layer * length))
                    rank += full
            for layer in range(rest):
                plan.append((length, rank, 1, first + full, capacity - remaining + layer * length))
                rank += 1
            left -= full * each + rest
            keep(remaining - each * length, first, full)
            if rest:
                keep(remaining - rest * length, first + full, 1)
            keep(remaining, first + full + bool(rest), count - full - bool(rest))
    return sorted(plan), bins


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids with the end id, cut where they exceed capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    end = np.array([END_ID], dtype="<u4")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, KEPT_UNITS)
        for batch in batches:
            held = batch.column(0).to_pylist()
            ids = enc.encode(batch.column(1), CHUNK_BYTES)
            for k in range(0, batch.num_rows, 2048):
                columns = [[] for _ in names]
                for doc in held[k : k + 2048]:
                    whole = np.concatenate([next(ids), end])
                    for n, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        for column, value in zip(columns, (doc, n, start, len(part), crc_of(part), part.tobytes() if with_ids else None), strict=False):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)
        trim()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length and more) with sequence_id and offset; pieces must give the same rows whenever read."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if histogram and max(histogram) > capacity:
        raise ValueError("a piece is longer than a sequence")
    plan, _ = plan_packing(histogram, capacity)
    table = np.array(plan, dtype=np.int64).reshape(-1, 5)
    starts = table[:, 0] << 48 | table[:, 1]
    buckets = min(MOST_BUCKETS, 1 + sum(histogram.values()) // BUCKET_ROWS)
    order = [F.col(c) for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    held = pieces.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    below = Window.partitionBy("length").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = held.groupBy("length", "__b").agg(F.count("*").alias("__n")).select("length", "__b", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__first"))
    own = Window.partitionBy("length", "__b").orderBy(*order)
    ranked = held.join(first, ["length", "__b"]).withColumn("__rank", F.col("__first") + F.row_number().over(own) - 1)

    columns = list(pieces.columns)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rank = x["__rank"].to_numpy(np.int64)
            at = np.searchsorted(starts, x["length"].to_numpy(np.int64) << 48 | rank, side="right") - 1
            yield x[columns].assign(sequence_id=table[at, 3] + rank - table[at, 1], offset=table[at, 4])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*pieces.columns, "__rank").mapInPandas(place, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut(token_pieces(docs, path or vocabulary_path(VOCABULARY), capacity=capacity)), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)
