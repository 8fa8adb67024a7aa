"""A minimal acyclic transducer from byte strings to sequences of ids, in flat arrays that a file holds and workers map into memory.

Words are added in order (Mihov and Maurel, 2001): what a new word shares with the last one stays open, the rest of the last word is frozen, and a
frozen state that equals an earlier one (same arcs, outputs and end) is that state, so words share their suffixes as well as their prefixes. Outputs
stand as near to the start as they can. Lookup takes many words at once, one byte of each in a step.

File, little-endian: eight i64 (MAGIC, root, arcs, states, ids, 0, 0, 0), then u32 keys (state * 256 + byte, ascending), targets, starts of outputs, and lengths of arcs;
i32 lengths (-1: no end) and u32 starts of final outputs of states; u32 ids.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa

MAGIC = 0x31545041


def _shared(a, b) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def compile_words(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of a transducer for distinct, non-empty words in ascending order."""
    known: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(node: list) -> int:
        made = (node[0], tuple(map(tuple, node[1])))
        at = known.setdefault(made, len(frozen))
        if at == len(frozen):
            frozen.append(made)
        return at

    # an open node: its final output (None: no word ends here), and its arcs [byte, target, output]
    path, last = [[None, []]], b""
    for word, out in words:
        if word <= last:
            raise ValueError("words must be distinct, not empty, and in order")
        same = _shared(last, word)
        for depth in range(len(last), same, -1):
            path[depth - 1][1][-1][1] = freeze(path.pop())
        for depth in range(same):
            arc, node = path[depth][1][-1], path[depth + 1]
            n = _shared(arc[2], out)
            rest, arc[2], out = arc[2][n:], arc[2][:n], out[n:]
            if rest:
                node[0] = node[0] if node[0] is None else rest + node[0]
                for other in node[1]:
                    other[2] = rest + other[2]
        for byte in word[same:]:
            path[-1][1].append([byte, -1, out])
            path.append([None, []])
            out = ()
        path[-1][0], last = (), word
    while len(path) > 1:
        node = path.pop()
        path[-1][1][-1][1] = freeze(node)
    root = freeze(path[0])
    pool: dict[tuple, int] = {}
    ids: list[int] = []

    def place(out: tuple) -> int:
        at = pool.setdefault(out, len(ids))
        if at == len(ids):
            ids.extend(out)
        return at

    arcs = [(state << 8 | byte, target, place(out), len(out)) for state, (_, some) in enumerate(frozen) for byte, target, out in some]
    ends = [(-1, 0) if final is None else (len(final), place(final)) for final, _ in frozen]
    if len(frozen) >= 1 << 24:
        raise ValueError("too many states")
    columns = [np.array(c, dtype="<u4") for c in (zip(*arcs, strict=True) if arcs else [()] * 4)]
    parts = [np.array([MAGIC, root, len(arcs), len(frozen), len(ids), 0, 0, 0], dtype="<i8"), *columns, np.array([x[0] for x in ends], dtype="<i4"), np.array([x[1] for x in ends], dtype="<u4"), np.array(ids, dtype="<u4")]
    return b"".join(x.tobytes() for x in parts)


class Transducer:
    """Looks words up in a file's bytes, which may be a memory map."""

    def __init__(self, data: np.ndarray):
        magic, self.root, arcs, self.states, ids = data[:40].view("<i8").tolist()
        if magic != MAGIC:
            raise ValueError("not a transducer")
        at, parts = 64, []
        for n, kind in [(arcs, "<u4")] * 4 + [(self.states, "<i4"), (self.states, "<u4"), (ids, "<u4")]:
            parts.append(data[at : at + 4 * n].view(kind))
            at += 4 * n
        self.keys, self.targets, self.starts, self.lengths, self.final_lengths, self.final_starts, self.ids = parts

    @classmethod
    def from_file(cls, path: str) -> Transducer:
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, lengths, ids): which words it knows, how many ids each has (0 if unknown), and all ids one word after the other."""
        words = words.cast(pa.large_binary())
        ends = np.frombuffer(words.buffers()[1], dtype=np.int64, count=len(words) + 1, offset=8 * words.offset)
        size = np.diff(ends)
        text = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)
        state = np.full(len(words), self.root, dtype=np.int64)
        live, steps, step = np.arange(len(words)), [], 0
        while len(live) and len(self.keys):
            live = live[size[live] > step]
            key = state[live] << 8 | text[ends[live] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            state[live[~hit]] = -1
            live, at, step = live[hit], at[hit], step + 1
            state[live] = self.targets[at]
            out = self.lengths[at] > 0
            if out.any():
                steps.append((live[out], self.starts[at[out]].astype(np.int64), self.lengths[at[out]].astype(np.int64)))
        found = np.flatnonzero((state >= 0) & (size > 0) & bool(len(self.keys)))
        found = found[self.final_lengths[state[found]] >= 0]
        steps.append((found, self.final_starts[state[found]].astype(np.int64), self.final_lengths[state[found]].astype(np.int64)))
        known = np.zeros(len(words), dtype=bool)
        known[found] = True
        lengths = np.zeros(len(words), dtype=np.int64)
        for word, _, n in steps:
            lengths[word] += n
        lengths[~known] = 0
        cursor, flat = np.cumsum(lengths) - lengths, np.empty(int(lengths.sum()), dtype=np.uint32)
        for word, start, n in steps:
            some = known[word]
            word, start, n = word[some], start[some], n[some]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(cursor[word], n) + within] = self.ids[np.repeat(start, n) + within]
            cursor[word] += n
        return known, lengths, flat
