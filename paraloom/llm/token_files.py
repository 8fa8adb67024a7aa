"""Token files: Re-Pair grammar compression of token ids, by shard, with random access.

Documents go to ranges of ascending doc_id; each range is written as blocks of about BLOCK_IDS ids. A block's payload
holds the grammar (pairs that became nonterminals and the length each expands to), where each document starts, and the rest of
the sequence. A round replaces the most frequent pairs and rounds go on until no pair occurs LEAST_COUNT times; a pair that occurs less
never comes back, since only new nonterminals make new pairs, so it is counted no more. No pair crosses a document's end, so a document is
decoded from its own symbols alone. Spark's Parquet writer commits the blocks, so a lost task leaves no half file.

Payload, little-endian: `RPB2`, then u32 documents, rules, symbols and end id's symbol E; documents x i64 ids and u8 null marks; (documents + 1) x u32
first symbols; packed pairs, expansion lengths and symbols. A symbol below E is an id, E is the end id, others are rules from E + 1 on.
Packed numbers: u8 width, the low 16 bits of each, then one bit plane for each further bit.

Defined cases: a null or empty text is its end id alone; rows that share a doc_id stand in order of a hash of their text, and rows that share both are alike; a null
doc_id comes before all others; no documents give no blocks; other columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paraloom.llm.common import read_table, scratch_folder
from paraloom.llm.tokens import END_ID, crc_of, encoder, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 1 << 20
#: Pairs that a round replaces (the most frequent first; the others have their turn in the next), and how often a pair must occur to pay for its rule.
ROUND_PAIRS, LEAST_COUNT = 8192, 8
MAGIC = b"RPB2"
_GOLDEN = {4: np.uint32(0x9E3779B1), 8: np.uint64(0x9E3779B97F4A7C15)}


def _slots(pairs: np.ndarray, bits: int) -> np.ndarray:
    """A place below 2 ** bits for each pair, by multiplication."""
    width = pairs.dtype.itemsize
    return (pairs * _GOLDEN[width] >> pairs.dtype.type(8 * width - bits)).view(np.int64 if width == 8 else np.int32)


def compress(symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with frequent pairs replaced, the pairs (rule k stands for symbol end + 1 + k), and the length each expands to."""
    symbols = symbols.astype(np.uint32)
    rules, size = [np.zeros((0, 2), np.uint32)], np.ones(end + 1, dtype=np.uint32)
    live = symbols != end  # whether the pair that starts here may be frequent
    live[:-1] &= live[1:]
    live[-1:] = False
    while True:
        at = np.flatnonzero(live)
        half = 16 if len(size) + ROUND_PAIRS <= 1 << 16 else 32
        kind = np.uint32 if half == 16 else np.uint64
        pairs = symbols.take(at).astype(kind, copy=False) << kind(half) | symbols.take(at + 1)
        bits = max(8, len(at).bit_length())
        slot = _slots(pairs, bits)
        maybe = (np.bincount(slot, minlength=1 << bits) >= LEAST_COUNT).take(slot)
        live[at] = maybe
        chosen = np.flatnonzero(maybe)
        at, pairs, slot = at.take(chosen), pairs.take(chosen), slot.take(chosen)
        ordered = np.sort(pairs)
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
        count = np.diff(starts, append=len(ordered))
        often = np.flatnonzero(count >= LEAST_COUNT)
        if not len(often):
            break
        often = often[np.argsort(count[often], kind="stable")][-ROUND_PAIRS:]
        found = ordered[starts[often]]
        table = np.full(1 << bits, -1, dtype=np.int32)  # of pairs that share a slot the most frequent has it
        table[_slots(found, bits)] = np.arange(len(found))
        rule = table.take(slot)
        hit = np.flatnonzero(rule >= 0)
        rule = rule.take(hit)
        same = np.flatnonzero(found.take(rule) == pairs.take(hit))
        at, rule = at.take(hit.take(same)), rule.take(same)
        # of overlapping pairs every other one, from the left
        first = np.r_[True, np.diff(at) > 1][: len(at)]
        place = np.arange(len(at), dtype=np.int32)
        taken = np.flatnonzero((place - np.maximum.accumulate(place * first)) & 1 == 0)
        at, rule = at.take(taken), rule.take(taken)
        pays = np.bincount(rule, minlength=len(found)) >= LEAST_COUNT
        if not pays.any():
            break
        kept = np.flatnonzero(pays.take(rule))
        at, rule = at.take(kept), rule.take(kept)
        symbols[at] = (np.cumsum(pays) - 1 + len(size)).take(rule)
        left = np.ones(len(symbols), dtype=bool)
        left[at + 1] = False
        live[at] = True
        live[at - (at > 0)] = True
        still = np.flatnonzero(left)
        symbols, live = symbols.take(still), live.take(still)
        fresh = np.flatnonzero(symbols >= len(size))  # new symbols and their neighbours: no pair crosses a document's end
        live[fresh] &= symbols.take(np.minimum(fresh + 1, len(symbols) - 1)) != end
        before = fresh[fresh > 0] - 1
        live[before] &= symbols.take(before) != end
        live[-1] = False
        made = found[pays]
        a, b = (made >> kind(half)).astype(np.int64), (made & kind((1 << half) - 1)).astype(np.int64)
        rules.append(np.stack([a, b], 1).astype(np.uint32))
        size = np.concatenate([size, size[a] + size[b]])
    return symbols, np.concatenate(rules), size[end + 1 :]


def expand(symbols: np.ndarray, rules: np.ndarray, end: int) -> np.ndarray:
    """The ids that symbols stand for."""
    while len(at := np.flatnonzero(symbols > end)):
        size = np.ones(len(symbols), dtype=np.int64)
        size[at] = 2
        place = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.uint32)
        out[place] = symbols
        pair = rules[symbols[at] - (end + 1)]
        out[place[at]], out[place[at] + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return np.where(symbols == end, np.uint32(END_ID), symbols).astype("<u4")


def pack_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 in as few bits as the largest needs, 16 at least."""
    width = max(16, int(values.max()).bit_length()) if len(values) else 16
    planes = [np.packbits((values >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes() for k in range(16, width)]
    return b"".join([bytes([width]), values.astype("<u2").tobytes(), *planes])


def unpack_numbers(payload: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """n numbers from a place in the payload, and the place after them."""
    width, at = payload[at], at + 1
    values = np.frombuffer(payload, "<u2", n, at).astype(np.uint32)
    at += 2 * n
    for k in range(16, width):
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, -(-n // 8), at), count=n)
        values |= bits.astype(np.uint32) << np.uint32(k)
        at += -(-n // 8)
    return values, at


def write_block(doc_ids: list[int | None], ids: list[np.ndarray], end: int) -> bytes:
    """The payload of documents whose ids, all below end, are given without the end id."""
    last = np.array([end], dtype=np.uint32)
    symbols, rules, lengths = compress(np.concatenate([x for each in ids for x in (each, last)]), end)
    starts = np.r_[0, np.flatnonzero(symbols == end) + 1]
    null = np.array([x is None for x in doc_ids], dtype=np.uint8)
    parts = [
        MAGIC, struct.pack("<IIII", len(doc_ids), len(rules), len(symbols), end), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), null.tobytes(),
        starts.astype("<u4").tobytes(), pack_numbers(rules.ravel()), pack_numbers(lengths), pack_numbers(symbols),
    ]
    return b"".join(parts)


class Block:
    """Reads a payload; documents are decoded one by one or all together."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a block of token ids")
        docs, rules, symbols, self.end = struct.unpack_from("<IIII", payload, 4)
        ids, null = np.frombuffer(payload, "<i8", docs, 20), np.frombuffer(payload, "u1", docs, 20 + 8 * docs)
        self.doc_ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        at = 20 + 9 * docs
        self.starts, at = np.frombuffer(payload, "<u4", docs + 1, at), at + 4 * (docs + 1)
        pairs, at = unpack_numbers(payload, at, 2 * rules)
        self.rules = pairs.reshape(-1, 2)
        self.lengths, at = unpack_numbers(payload, at, rules)
        self.symbols, at = unpack_numbers(payload, at, symbols)

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, its end id included; nothing else is expanded."""
        return expand(self.symbols[self.starts[k] : self.starts[k + 1]], self.rules, self.end)

    def _each(self) -> np.ndarray:
        """Ids of each symbol, from the expansion lengths alone."""
        size = np.concatenate([np.ones(self.end + 1, dtype=np.int64), self.lengths])
        return size[self.symbols]

    def sizes(self) -> np.ndarray:
        """Ids of each document, from the expansion lengths alone."""
        total = np.r_[0, np.cumsum(self._each())]
        return np.diff(total[self.starts])

    def documents(self) -> Iterator[np.ndarray]:
        """The ids of all documents; every rule is expanded once."""
        ids = np.arange(self.end + 1, dtype="<u4")
        ids[self.end] = END_ID
        known = np.concatenate([ids, expand(np.arange(self.end + 1, self.end + 1 + len(self.rules), dtype=np.uint32), self.rules, self.end)])
        first = np.concatenate([np.arange(self.end + 1), self.end + 1 + np.cumsum(self.lengths, dtype=np.int64) - self.lengths])
        each = self._each()
        place = np.repeat(first[self.symbols] - (np.cumsum(each) - each), each)
        place += np.arange(len(place))
        flat, at = known.take(place), 0
        for n in self.sizes().tolist():
            yield flat[at : at + n]
            at += n


def write_token_files(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents, in ascending order of the id, to the folder's files (shard, block, n_docs, n_ids, payload)."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, block = encoder(path), TaskContext.get().partitionId(), 0
        held: tuple[list[int | None], list[np.ndarray]] = ([], [])
        size = 0

        def flush() -> pa.RecordBatch:
            row = [[shard], [block], [len(held[0])], [size], [write_block(*held, enc.size)]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1)), strict=True):
                held[0].append(doc)
                held[1].append(ids)
                size += len(ids) + 1
                if size >= block_ids:
                    yield flush()
                    held, size, block = ([], []), 0, block + 1
        if size:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # an id that many rows share, or none, is dealt to several ranges by its texts; a number tells rows that are alike apart
    order = ["id", "hash", "row"]
    rows = rows.select("id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(blocks, "shard int, block int, n_docs long, n_ids long, payload binary").write.parquet(folder)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    files = spark.read.parquet(folder)
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sizes = files.select("shard", "block", "n_ids")
    # one row a shard, and there are as many shards as tasks that wrote
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before().orderBy("shard")), F.lit(0)).alias("shard_start"))
    firsts = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(before("shard").orderBy("block")), F.lit(0))).join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("block_start")).alias("first"))
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["shard", "block", "doc_id", "before", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, payload = (batch.column(c)[row].as_py() for c in range(3))
                read = Block(payload)
                ids, size = list(read.documents()), read.sizes()
                n = len(ids)
                columns = [[shard] * n, [block] * n, read.doc_ids, np.cumsum(size) - size, size, list(map(crc_of, ids))]
                if with_ids:
                    columns.append([x.tobytes() for x in ids])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    schema = "shard int, block int, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    found = files.select("shard", "block", "payload").mapInArrow(decode, schema)
    return found.join(firsts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), folder, vocabulary_path(VOCABULARY))
    return read_token_files(spark, folder)
