"""Approximate text search: semi-global distance and local mapping, bit-parallel (Myers, 1999).

Rows of similar text length go side by side: the bits of all their patterns are arrays of 64-bit words with carries between them, and one step takes the next character
of every text. Few rows, and those left over, are searched one by one with Python's long integers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from paraloom.functions.scalar import reverse_complement
from paraloom.operators.match import qgram_seeds


def best_end(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the pattern's best occurrence in the text with `most` edits or fewer; the leftmost end of equals.

    Bit-parallel over Python's long integers, so a pattern may have any length.
    """
    m = len(pattern)
    if m == 0:
        return (0, 0)
    peq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, None
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right_up = down | (mask & ~(diagonal | up))
        right_down = up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = right_up << 1 & mask, right_down << 1 & mask
        up, down = right_down | (mask & ~(diagonal | right_up)), right_up & diagonal
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


#: Rows that are worth going side by side, and cells of their tables of characters and of patterns at most.
ROWS, CELLS = 48, 1 << 22
#: Characters of queries in a task of local mapping, and of references that go to every task; a row counts for QUERY_CHARS more.
TASK_CHARS, FEW_CHARS, QUERY_CHARS = 1 << 18, 1 << 20, 64


def _side_by_side(patterns: list[str], texts: list[str], most: int) -> list[tuple[int, int] | None]:
    """best_end of rows with patterns that are not empty, all at once; the longest texts come first."""
    n = len(patterns)
    codes = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    size, length = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    words = -(-int(size.max()) // 64)
    flat, row = np.concatenate([codes(p) for p in patterns]), np.repeat(np.arange(n), size)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    letters, letter = np.unique(flat, return_inverse=True)
    equal = np.zeros((len(letters) + 1, n, words), dtype=np.uint64)  # the last letter stands for those of no pattern
    np.bitwise_or.at(equal, (letter, row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    table = np.full((int(length.max()), n), len(letters), dtype=np.int32)
    for k, t in enumerate(texts):
        own = codes(t)
        at = np.searchsorted(letters, own)
        at[at == len(letters)] = 0
        table[: len(own), k] = np.where(letters[at] == own, at, len(letters))
    bits = np.clip(size[:, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
    ones = ~np.uint64(0)
    mask = np.where(bits == 64, ones, (np.uint64(1) << (bits & np.uint64(63))) - np.uint64(1))
    last, top = (size - 1) >> 6, np.uint64(1) << ((size - 1) & 63).astype(np.uint64)
    up, down, score = mask.copy(), np.zeros_like(mask), size.copy()
    best, end, one, high = np.full(n, most + 1), np.zeros(n, dtype=np.int64), np.uint64(1), np.uint64(63)
    every = np.arange(n)

    def moved(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        out = x << one
        out[:, 1:] |= x[:, :-1] >> high
        return out & m

    active = n
    for step in range(int(length.max())):
        while active and length[active - 1] <= step:
            active -= 1
        some = slice(0, active)
        eq, u, d, m = equal[table[step, some], every[some]], up[some], down[some], mask[some]
        both, carry = eq & u, np.zeros(active, dtype=np.uint64)
        total = np.empty_like(u)
        for w in range(words):
            part = both[:, w] + u[:, w]
            total[:, w] = part + carry
            carry = ((part < u[:, w]) | (total[:, w] < part)).astype(np.uint64)
        diagonal = ((total ^ u) | eq | d) & m
        right_up, right_down = (d | ~(diagonal | u)) & m, u & diagonal
        rows = every[some]
        gain, loss = right_up[rows, last[some]] & top[some], right_down[rows, last[some]] & top[some]
        score[some] += (gain != 0).astype(np.int64) - (loss != 0)
        right_up, right_down = moved(right_up, m), moved(right_down, m)
        up[some], down[some] = (right_down | ~(diagonal | right_up)) & m, right_up & diagonal
        better = score[some] < best[some]
        best[some] = np.where(better, score[some], best[some])
        end[some] = np.where(better, step + 1, end[some])
    return [(int(b), int(e)) if b <= most else None for b, e in zip(best, end, strict=True)]


def best_ends(patterns: list[str], texts: list[str], most: int) -> list[tuple[int, int] | None]:
    """best_end of each row."""
    out: list[tuple[int, int] | None] = [None] * len(patterns)
    order = sorted((k for k in range(len(patterns)) if patterns[k]), key=lambda k: -len(texts[k]))
    for k in range(len(patterns)):
        if not patterns[k]:
            out[k] = (0, 0)
    at = 0
    while at < len(order):
        longest, most_words, stop = max(1, len(texts[order[at]])), 1, at
        while stop < len(order) and 2 * len(texts[order[stop]]) >= longest:
            most_words = max(most_words, -(-len(patterns[order[stop]]) // 64))
            if stop - at >= ROWS and (stop - at + 1) * max(longest, 64 * most_words) > CELLS:
                break
            stop += 1
        stop = max(stop, at + 1)
        some = order[at:stop]
        if len(some) >= ROWS:
            found = _side_by_side([patterns[k] for k in some], [texts[k] for k in some], most)
        else:
            found = [best_end(patterns[k], texts[k], most) for k in some]
        for k, x in zip(some, found, strict=True):
            out[k] = x
        at = stop
    return out


_FOUND = StructType([StructField("distance", IntegerType()), StructField("end", IntegerType())])


def semi_global(pattern, text, most: int):
    """struct(distance, end) of a pattern column's best occurrence in a text column, null where it needs more edits."""

    @F.pandas_udf(_FOUND)
    def search(p: pd.Series, t: pd.Series) -> pd.DataFrame:
        whole = [k for k, (a, b) in enumerate(zip(p, t, strict=True)) if isinstance(a, str) and isinstance(b, str)]
        found: list[tuple[int, int] | None] = [None] * len(p)
        pairs = [(p.iloc[k], t.iloc[k]) for k in whole]
        once = list(dict.fromkeys(pairs))  # a batch's equal pairs are searched once
        best = dict(zip(once, best_ends([a for a, _ in once], [b for _, b in once], most), strict=True))
        for k, x in zip(whole, pairs, strict=True):
            found[k] = best[x]
        return pd.DataFrame({"distance": pd.array([x and x[0] for x in found], "Int32"), "end": pd.array([x and x[1] for x in found], "Int32")})

    return search(pattern, text)


def map_locally(queries: DataFrame, query_id: str, query: str, refs: DataFrame, ref_id: str, ref: str, q: int, most: int, apart: int = 10, task_chars: int = TASK_CHARS) -> DataFrame:
    """(query_id, ref_id, strand, end, distance): seeds verified in their window on both strands; of hits within `apart` the better stays.

    Queries are dealt by query_id into tasks of about task_chars characters before their seeds are cut. Where the references are few they stay there until
    their hits are verified; what is found is dealt into as many. So a task holds the hits of its own queries only, however many there are in however few files.
    """
    size = queries.agg(F.sum(F.coalesce(F.char_length(query), F.lit(0)) + QUERY_CHARS)).first()[0] or 0
    few = (refs.agg(F.sum(F.coalesce(F.char_length(ref), F.lit(0)) + QUERY_CHARS)).first()[0] or 0) <= FEW_CHARS
    tasks = 1 + size // task_chars
    dealt = queries.select(query_id, F.col(query).alias("__q")).repartition(tasks, query_id)
    strands = F.array(F.struct(F.lit("+").alias("strand"), F.col("__q").alias("q")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("__q")).alias("q")))
    both = dealt.select(query_id, F.explode(strands).alias("s")).select(query_id, F.col("s.strand").alias("strand"), F.col("s.q").alias("__q"))
    seeds = qgram_seeds(both, [query_id, "strand", "__q"], "__q", refs, ref_id, ref, q, most, few_places=few)
    texts = refs.select(ref_id, F.col(ref).alias("__r"))
    placed = seeds.join(F.broadcast(texts) if few else texts, ref_id)
    start = F.greatest(F.col("diagonal") - 2 * most, F.lit(0))
    window = F.substring("__r", (start + 1).cast("int"), (F.col("diagonal") + F.char_length("__q") + 2 * most - start).cast("int"))
    # out of an array, so that the filter does not search once more
    hit = placed.select(query_id, ref_id, "strand", start.alias("__s"), F.explode(F.array(semi_global(F.col("__q"), window, most))).alias("__h")).where("__h.distance is not null")
    found = hit.select(query_id, ref_id, "strand", (F.col("__s") + F.col("__h.end")).alias("end"), F.col("__h.distance").alias("distance"))
    found = found.repartition(tasks, query_id)  # a Python function leaves its rows where they are, but Spark no longer knows it
    order = Window.partitionBy(query_id, ref_id, "strand").orderBy("end")
    cluster = F.sum(F.when(F.col("end") - F.lag("end").over(order) <= apart, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    best = Window.partitionBy(query_id, ref_id, "strand", "__c").orderBy("distance", "end")
    return found.withColumn("__c", cluster).withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__c", "__k")
