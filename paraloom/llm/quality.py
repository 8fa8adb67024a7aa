"""Quality rules: hashed n-gram log-likelihood ratio between the trusted texts and the raw corpus, beside counted rules.

Words and pairs of words are hashed into BUCKETS; two multinomials are counted, one over all texts (with add-one smoothing) and one over the texts that labels call good
(quality 1, toxic 0), which has the first as its prior with a weight of PRIOR n-grams, so few trusted texts say little. A text's score is the mean of log p_trusted - log p_raw over its n-grams, and a text whose score is below the
threshold is dropped; the threshold is one number, whatever the corpus. Counting is one pass that gives BUCKETS rows a task at most; scoring is another. The trusted ids
are broadcast while they are few (counted first), and joined by shuffle beyond that.

Defined cases: a null or empty text has no words, fails the base rules and scores 0; a text of one word is scored by the word alone; repeated rows
count as often as they stand; a document with several labels is trusted if one row says so, and a label row with a null says nothing; without trusted texts every score is
0 and only the base rules drop; columns of any name pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm.common import SPACES, numbered, read_table, small

BUCKETS = 1 << 14
#: Mean log-likelihood ratio that a kept text has at least.
LEAST_RATIO = -0.06
PRIOR = BUCKETS
#: n-grams that are counted together.
COUNTED = 4_000_000
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS = "#*$%&|<>"
#: Trusted ids that are broadcast at most (about 100 bytes each as a hashed relation); more are joined by shuffle.
BROADCAST_IDS = 500_000
_MIX_A, _MIX_B, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - 14)


def buckets(text: str) -> np.ndarray:
    """The buckets of a text's words and pairs of words, A-Z in lower case."""
    words = np.array([zlib.crc32(w) for w in text.encode("utf-8", "surrogatepass").lower().split()], dtype=np.uint64)
    pairs = words[:-1] * _MIX_A + words[1:] * _MIX_B
    return (np.concatenate([words * _MIX_A, pairs]) >> _SHIFT).astype(np.int64)


def repeated_words(words: list) -> int:
    """Words in three-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict = {}
    a = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    if len(number) < 1 << 21:
        keys = a[:-2] << 42 | a[1:-1] << 21 | a[2:]
    else:
        _, pair = np.unique(a[:-1] * len(number) + a[1:], return_inverse=True)
        keys = pair[:-1] * len(number) + a[2:]
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    again = n[at] > 1
    covered = np.zeros(len(a), dtype=bool)
    for k in range(3):
        covered[k : len(a) - 2 + k] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    seen.update(lines)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(seen), repeated_words(words)


def _counts(parts: tuple[list, list]) -> np.ndarray:
    return np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *x]), minlength=BUCKETS) for x in parts])


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> np.ndarray:
    """log p_trusted - log p_raw of every bucket."""
    trusted = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__id"), F.lit(True).alias("__good")).distinct()
    trusted = small(trusted, broadcast_ids)
    rows = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).join(trusted, F.col("__i") == F.col("__id"), "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in batches:
            parts, size = ([], []), 0
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = buckets(text.as_py())
                parts[good].append(found)
                size += len(found)
                if size > COUNTED:
                    total += _counts(parts)
                    parts, size = ([], []), 0
            total += _counts(parts)
        total[0] += total[1]
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "trusted"])

    counted = rows.select("text", F.coalesce("__good", F.lit(False)).alias("good")).mapInArrow(count, "bucket long, raw long, trusted long")
    table = np.zeros((2, BUCKETS))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).collect():  # BUCKETS rows at most
        table[:, r["bucket"]] = r["raw"], r["trusted"]
    raw = (table[0] + 1) / (table[0] + 1).sum()
    good = (table[1] + PRIOR * raw) / (table[1].sum() + PRIOR)
    return np.log(good) - np.log(raw)


def judge(docs: DataFrame, ratios: np.ndarray, least_ratio: float = LEAST_RATIO, text_col: str = "text", out: str = "quality_rules") -> DataFrame:
    """docs with the struct column `out` (counts, ratio, base_failed, kept); a column of that name is replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ratio = np.zeros((batch.num_rows, 5), dtype=np.int64), np.zeros(batch.num_rows)
            for k, x in enumerate(batch.column(0)):
                text = x.as_py() or ""
                counts[k], found = base_counts(text), buckets(text)
                ratio[k] = ratios[found].mean() if len(found) else 0.0
            failed = (counts[:, 0] < LEAST_WORDS) | (100 * counts[:, 4] > MOST_REPEATED * counts[:, 0])
            kept = ~failed & (ratio >= least_ratio)
            rules = pa.StructArray.from_arrays([*map(pa.array, np.ascontiguousarray(counts.T)), pa.array(ratio), pa.array(failed), pa.array(kept)], [*names, "ratio", "base_failed", "kept"])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rules], names=[*batch.schema.names[1:], "found"])

    kept = [c for c in docs.columns if c != out]
    rows = numbered(docs, [text_col, *kept])
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[1:])
    rules = ",".join(f"{x}:bigint" for x in names) + ",ratio:double,base_failed:boolean,kept:boolean"
    found = rows.mapInArrow(compute, f"{fields}found struct<{rules}>")
    return found.select(*[F.col(f"c{k + 1}").alias(c) for k, c in enumerate(kept)], F.col("found").alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, log_ratios(docs, read_table(spark, sf_dir, "labels")))
    q = F.col("quality_rules")
    return out.select("doc_id", *[q[x].alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")])
