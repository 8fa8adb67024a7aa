"""Byte-level BPE by a lexicon of frequent words and exact merges.

A first pass counts the words of all texts; the frequent ones (a bounded number) are merged once and compiled into a minimal acyclic transducer
(transducer.py), a file in the shared folder that Spark hands to every executor and that its workers map into memory. A second pass splits texts into words,
looks the distinct ones of a chunk up in the automaton and merges the others exactly: all words at once in numpy, each step doing in every word the
merge of lowest rank, and long pieces one by one with a heap. The lexicon saves work only: without it, or with another one, ids are the same.

Texts are split where tokens.UnitEncoder splits them; texts it would give whole to the library are cut by the public pattern here. The spelling of a special
token is that token, as the library has it by default.

Defined cases: a null text is empty and has no ids; a null doc_id and repeated rows are rows as any other; pieces of any length are merged; ids that
do not make up UTF-8 decode with replacement characters; no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm.common import cut, kept, read_table, scratch_folder
from paraloom.llm.tokens import _LETTERS, CHUNK_BYTES, UnitEncoder, encoded_whole, vocabulary_path
from paraloom.llm.transducer import Transducer, compile_words

VOCABULARY = "byte_bpe_50k.json"
#: The public pattern that cuts a text into pieces, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words of the lexicon at most, and bytes of the longest.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 48
#: Longer pieces are merged with a heap.
LONG_PIECE = 256
#: Ids whose bytes are gathered at once.
GATHERED = 1 << 20
_NEVER = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class PairTable:
    """Ranks of pairs of ids: hash tables one after the other, each holding what the ones before had no room for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels, bits = [], max(8, len(keys).bit_length() + 2)
        while len(keys):
            factor = np.uint64(0x9E3779B97F4A7C15 + 2 * 0x51ED27 * len(self.levels))
            slot = keys * factor >> np.uint64(64 - bits)
            names, held = np.full(1 << bits, ~np.uint64(0)), np.zeros(1 << bits, dtype=np.int32)
            names[slot] = keys
            held[slot] = values
            self.levels.append((factor, np.uint64(64 - bits), names, held))
            out = names[slot] != keys
            keys, values, bits = keys[out], values[out], max(8, bits - 3)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, out = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), np.full(len(left), _NEVER)
        at = np.arange(len(keys))
        for factor, shift, names, held in self.levels:
            slot = keys * factor >> shift
            hit = names[slot] == keys
            out[at[hit]] = held[slot[hit]]
            at, keys = at[~hit], keys[~hit]
        return out


class Merges:
    """The merges and the bytes of a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            known = json.load(file)
        model, letters = known["model"], byte_letters()
        names = model["vocab"] | {x["content"]: x["id"] for x in known["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in known["added_tokens"]}
        self.bytes = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            self.bytes[k] = name.encode() if k in self.special.values() else bytes(map(letters.__getitem__, name))
        self.of_byte = np.array([names[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], dtype=np.int32)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        left, right = (np.array([names[p[k]] for p in pairs], dtype=np.uint64) for k in (0, 1))
        self.made = np.array([names[a + b] for a, b in pairs], dtype=np.int32)
        keys = left << np.uint64(32) | right
        # a pair that stands twice has its first rank
        keys, first = np.unique(keys, return_index=True)
        self.ranks = PairTable(keys, first.astype(np.int32))
        self.rank_of = dict(zip(keys.tolist(), first.tolist(), strict=True))
        self.byte_lengths, self.byte_flat = self._spans(self.bytes)
        self.digit_lengths, self.digit_flat = self._spans([b"%d," % k for k in range(len(self.bytes))])

    @staticmethod
    def _spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.frombuffer(b"".join(parts), dtype=np.uint8)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of pieces one after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        long = np.flatnonzero(lengths > LONG_PIECE).tolist()
        found = [self._merge_long(pieces[k]) for k in long]
        short = [b"" if n > LONG_PIECE else x for x, n in zip(pieces, lengths.tolist(), strict=True)] if long else pieces
        symbols = self.of_byte[np.frombuffer(b"".join(short), dtype=np.uint8)]
        word = np.repeat(np.arange(len(pieces)), np.where(lengths > LONG_PIECE, 0, lengths))
        done = [(np.full(len(x), k), np.array(x, dtype=np.int32)) for k, x in zip(long, found, strict=True)]
        rank = np.full(len(symbols), _NEVER)
        same = np.flatnonzero(word[:-1] == word[1:])
        rank[same] = self.ranks.find(symbols[same], symbols[same + 1])
        while len(word):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            open_ = least != _NEVER
            if not open_.all():
                done.append((word[~open_], symbols[~open_]))
                word, symbols, rank, least = word[open_], symbols[open_], rank[open_], least[open_]
            at = np.flatnonzero(rank == least)
            # of pairs that overlap, as in aaa, the first, the third and so on
            run = np.concatenate([[True], np.diff(at) != 1])[: len(at)]
            at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(word), dtype=bool)
            stays[at + 1] = False
            now = np.cumsum(stays) - 1
            at = now[at]
            word, symbols, rank = word[stays], symbols[stays], rank[stays]
            new = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[new] = _NEVER
            new = new[new + 1 < len(word)]
            new = new[word[new] == word[new + 1]]
            rank[new] = self.ranks.find(symbols[new], symbols[new + 1])
        every = np.concatenate([x[0] for x in done] or [np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        return np.concatenate([x[1] for x in done] or [np.zeros(0, np.int32)])[order].astype(np.uint32), np.bincount(every, minlength=len(pieces))

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long piece: a heap of pairs by rank and place."""
        ids = self.of_byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        rank = lambda a, b: self.rank_of.get(ids[a] << 32 | ids[b])
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := rank(k, k + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, left, right = heapq.heappop(heap)
            n = after[k]
            if ids[k] != left or n < 0 or ids[n] != right:
                continue
            ids[k], ids[n] = int(self.made[r]), -1
            after[k] = after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := rank(a, b)) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def _gather(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.cumsum(lengths) - lengths
        for k in range(0, len(ids), GATHERED):
            some = ids[k : k + GATHERED]
            n = lengths[some]
            place = np.repeat(starts[some] - (np.cumsum(n) - n), n)
            place += np.arange(len(place))
            yield flat[place]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8, special tokens included."""
        data = b"".join(x.tobytes() for x in self._gather(ids, self.byte_lengths, self.byte_flat))
        return data.decode("utf-8", "replace").encode()

    def spelled_sha256(self, ids: np.ndarray) -> str:
        """Hex digest of the ids in decimals, joined by commas."""
        made, rest = hashlib.sha256(), b""
        for x in self._gather(ids, self.digit_lengths, self.digit_flat):
            made.update(rest)
            made.update(x[:-1])
            rest = b","
        return made.hexdigest()


class LexiconEncoder(UnitEncoder):
    """Encodes texts by a transducer (or none) and exact merges; what a chunk is split into is UnitEncoder's."""

    def __init__(self, merges: Merges, lexicon: Transducer | None = None):
        self.merges, self.lexicon, self.ends_words = merges, lexicon, False
        self.whole = encoded_whole(False, list(merges.special))
        self.cut = regex.compile(PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None

    @staticmethod
    def words_of(units: pa.Array) -> pa.Array:
        """Units as they stand in the text, with the blank before them."""
        starts = lambda x: pc.starts_with(units, x)
        own = pc.if_else(starts("\0"), pc.utf8_slice_codeunits(units, 1), pc.if_else(starts("\n"), units, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), units, pa.scalar("", pa.large_string()))))
        for mark, sign in (("\x01", ","), ("\x02", ".")):
            own = pc.if_else(pc.equal(units, mark), pa.scalar(sign, pa.large_string()), own)
        return own

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)

    def ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, lengths, ids) of distinct words: by the lexicon, else merged."""
        known, lengths, flat = self.lexicon.lookup(words) if self.lexicon else (np.zeros(len(words), bool), np.zeros(len(words), np.int64), np.zeros(0, np.uint32))
        starts, new = np.cumsum(lengths) - lengths, np.flatnonzero(~known)
        if len(new):
            names = words.take(pa.array(new))
            plain = pc.match_substring_regex(names, rf"\A ?{_LETTERS}\z").to_numpy(zero_copy_only=False)
            split = [[x] if one else self.pieces(x) for x, one in zip(names.to_pylist(), plain.tolist(), strict=True)]
            ids, each = self.merges.merge([p.encode() for some in split for p in some])
            counts = np.fromiter(map(len, split), np.int64, len(split))
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])[np.concatenate([np.zeros(1, np.int64), np.cumsum(counts)])]
            starts[new], lengths[new] = len(flat) + ends[:-1], np.diff(ends)
            flat = np.concatenate([flat, ids])
        return starts, lengths, flat

    def _table(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids_of(self.words_of(units))

    def parts(self, text: str) -> list[str]:
        """A text's special tokens and the pieces between them."""
        if not self.at_special:
            return self.pieces(text)
        return [p for k, x in enumerate(self.at_special.split(text)) for p in ([x] if k % 2 else self.pieces(x))]

    def _batch(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:  # few, and long ones among them: one at a time
            parts = pa.array(self.parts(text), pa.large_string()).dictionary_encode()
            starts, lengths, flat = self.ids_of(parts.dictionary)
            for name, k in self.merges.special.items():
                at = pc.index(parts.dictionary, pa.scalar(name, pa.large_string())).as_py()
                if at >= 0:
                    starts[at], lengths[at], flat = len(flat), 1, np.append(flat, np.uint32(k))
            at = parts.indices.to_numpy(zero_copy_only=False)
            n = lengths[at]
            place = np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield flat[place].astype("<u4").tobytes()

    def word_counts(self, texts: pa.Array) -> Iterator[tuple[pa.Array, pa.Array]]:
        """(words, times) chunk by chunk: the words that encode() looks up."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            done = size[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(size, done + CHUNK_BYTES, side="right")))
            some = texts.slice(first, end - first)
            whole = pc.match_substring_regex(some, self.whole)
            split = self._split(some.filter(pc.invert(whole))).flatten().dictionary_encode()
            yield self.words_of(split.dictionary), pa.array(np.bincount(split.indices.to_numpy(zero_copy_only=False), minlength=len(split.dictionary)))
            for text in some.filter(whole).to_pylist():
                named = pa.array(self.parts(text), pa.large_string()).value_counts()
                yield named.field(0), named.field(1)
            first = end


def frequent_words(docs: DataFrame, path: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[str]:
    """At most so many words of all texts: those that occur more often than a bound taken from the histogram of their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = LexiconEncoder(kept(("merges", path), lambda: Merges(path)))
        for batch in batches:
            for words, times in enc.word_counts(batch.column(0)):
                short = pc.and_(pc.less_equal(pc.binary_length(words), LEXICON_BYTES), pc.greater(pc.binary_length(words), 0))
                yield pa.RecordBatch.from_arrays([words.filter(short).cast(pa.string()), times.filter(short).cast(pa.int64())], names=["word", "n"])

    counted = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = cut(counted.where("n > 1").withColumn("bin", F.floor(4 * F.log2("n")).cast("int")))
    bins, total, lowest = {r["bin"]: r["w"] for r in counted.groupBy("bin").agg(F.count("*").alias("w")).collect()}, 0, None  # 256 bins at most
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > most:
            break
        lowest = b
    if lowest is None:
        return []
    return [r["word"] for r in counted.where(F.col("bin") >= lowest).select("word").collect()]


def build_lexicon(words: list[str], known: Merges) -> bytes:
    """The transducer of words and their ids; words that are special tokens stay out."""
    enc = LexiconEncoder(known)
    names = [x.decode() for x in sorted({w.encode() for w in words if w and w not in known.special})]
    starts, lengths, flat = enc.ids_of(pa.array(names, pa.large_string()))
    ids = flat.tolist()
    return compile_words((w.encode(), tuple(ids[s : s + n])) for w, s, n in zip(names, starts.tolist(), lengths.tolist(), strict=True))


def publish(spark: SparkSession, data: bytes) -> str:
    """Write a file to the shared folder and have Spark hand it to every executor, late ones too; the name by which they get it."""
    folder = scratch_folder(spark, "lexicon")
    name = folder.rpartition("/")[2] + ".fst"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    stream = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path)
    stream.write(bytearray(data))
    stream.close()
    context.addFile(f"{folder}/{name}")
    return name


def encode_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", most: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every text."""
    path = path or vocabulary_path(VOCABULARY)
    lexicon = publish(docs.sparkSession, build_lexicon(frequent_words(docs, path, text_col, most), Merges(path)))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.list_(pa.int64()), pa.string()] * with_ids]
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import SparkFiles

        enc = kept(("lexicon", path, lexicon), lambda: LexiconEncoder(Merges(path), Transducer.from_file(SparkFiles.get(lexicon))))
        for batch in batches:
            columns: list[list] = [[] for _ in names[1:]]
            for ids in enc.encode(batch.column(1)):
                decoded = enc.merges.decode(ids)
                found = (len(ids), enc.merges.spelled_sha256(ids), hashlib.sha256(decoded).hexdigest(), *((ids.tolist(), decoded.decode()) if with_ids else ()))
                for column, x in zip(columns, found, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds[1:], strict=True)]], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(encode, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"))
