"""Windows of k characters found in whole texts as 64-bit numbers.

A batch of texts is one array of code points. Hashes of all its windows come from those of half their width, so k characters cost log k passes over the array and no
window is ever cut out as a string. What is looked for is a sorted array of hashes with a bitmap before it; a hit is compared character by
character, so hashes that collide change nothing. Long texts are taken in pieces that overlap by k - 1, which bounds a task's memory.

Defined cases: null texts and texts shorter than k have no windows; an empty panel gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Grams that go to the workers at most, code points that are hashed at once, and bits of the bitmap.
PANEL_GRAMS, PIECE, BITMAP_BITS = 500_000, 1 << 20, 22
_FACTOR = 0x9E3779B97F4A7C15


def hashes(codes: np.ndarray, k: int, factor: int = _FACTOR) -> np.ndarray:
    """The hash of every window of k code points: a polynomial in `factor` modulo 2^64."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, width, rest = None, 0, k
    power, size, step = codes.astype(np.uint64), 1, np.uint64(factor)  # windows of `size`, and factor ** size
    while rest:
        if rest & 1:
            part = power[width : width + n]
            out = part.copy() if out is None else out * step + part
            width += size
        rest >>= 1
        if rest:
            power = power[: len(power) - size] * step + power[size:]
            size, step = 2 * size, np.uint64(int(step) ** 2 % (1 << 64))
    return out


class Panel:
    """The grams that are looked for, all of k characters."""

    def __init__(self, grams: list[str], k: int):
        self.k, self.factor = k, _FACTOR
        self.names = sorted(grams)
        table = np.array([np.frombuffer(g.encode("utf-32-le"), dtype="<u4") for g in self.names], dtype=np.uint32).reshape(-1, k)
        while True:
            own = hashes(table.ravel(), k, self.factor)[::k] if len(table) else np.zeros(0, dtype=np.uint64)
            if len(np.unique(own)) == len(own):
                break
            self.factor += 2  # another polynomial
        order = np.argsort(own)
        self.keys, self.table = own[order], table[order]
        self.names = [self.names[i] for i in order]
        self.bitmap = np.zeros(1 << BITMAP_BITS, dtype=bool)
        self.bitmap[self.keys >> np.uint64(64 - BITMAP_BITS)] = True

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, grams): where windows of the code points are grams of the panel."""
        own = hashes(codes, self.k, self.factor)
        at = np.flatnonzero(self.bitmap[own >> np.uint64(64 - BITMAP_BITS)])
        place = np.searchsorted(self.keys, own[at])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == own[at] if len(self.keys) else np.zeros(0, dtype=bool)
        at, place = at[hit], place[hit]
        same = (codes[at[:, None] + np.arange(self.k)] == self.table[place]).all(axis=1)
        return at[same], place[same]

    def scan(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place, gram) of all hits, a piece of texts at a time; the hits of one text may come in several pieces."""
        codes, owner, begins, size = [], [], [], 0
        for row, text in enumerate(texts):
            whole = np.frombuffer((text or "").encode("utf-32-le"), dtype="<u4")
            for start in range(0, max(len(whole) - self.k + 1, 0), PIECE):
                part = whole[start : start + PIECE + self.k - 1]
                codes.append(part)
                owner.append(row)
                begins.append((size, start, len(part)))
                size += len(part)
                if size >= PIECE:
                    yield self._found(codes, owner, begins)
                    codes, owner, begins, size = [], [], [], 0
        if codes:
            yield self._found(codes, owner, begins)

    def _found(self, codes: list, owner: list, begins: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, gram = self.find(np.concatenate(codes))
        first, start, length = np.array(begins, dtype=np.int64).T
        part = np.searchsorted(first, at, side="right") - 1
        inside = at - first[part] + self.k <= length[part]  # not over the end of a part
        at, gram, part = at[inside], gram[inside], part[inside]
        return np.array(owner)[part], at - first[part] + start[part], gram


def known_grams(grams: DataFrame, most: int = PANEL_GRAMS) -> list[str] | None:
    """The distinct grams (column gram) if they are few enough for the workers."""
    found = [r["gram"] for r in grams.select("gram").distinct().limit(most + 1).collect()]
    return found if len(found) <= most else None


def occurrences(texts: DataFrame, keys: list[str], text: str, grams: list[str], k: int, places: bool = False) -> DataFrame:
    """(keys, gram, n): how often each gram stands in a row's text, once for each row and gram that met; with places (keys, at, gram) for each occurrence."""
    panel = texts.sparkSession.sparkContext.broadcast(Panel(grams, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = panel.value
        names = pa.array(own.names, pa.string())
        for batch in batches:
            found = [(np.zeros(0, dtype=np.int64),) * 3, *own.scan(batch.column(batch.num_columns - 1).to_pylist())]
            row, at, gram = (np.concatenate([x[c] for x in found]) for c in range(3))
            if not places:
                both, n = np.unique(row.astype(np.int64) << 32 | gram, return_counts=True)
                row, gram, at = both >> 32, both & 0xFFFFFFFF, n
            made = [pa.array(at, pa.int64()), names.take(pa.array(gram))]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[:-1]), *(made if places else made[::-1])], names=[*keys, *(("at", "gram") if places else ("gram", "n"))])

    fields = "".join(f"`{c}` {texts.schema[c].dataType.simpleString()}, " for c in keys)
    return texts.select(*keys, text).mapInArrow(run, fields + ("at long, gram string" if places else "gram string, n long"))
