"""Token ids of whole texts as little-endian unsigned 32-bit integers, by the tokenizers library.

Both vocabularies treat what stands between two blanks independently of its surroundings, so a text is encoded unit by
unit: Arrow splits a chunk of texts and numbers its distinct units, each worker keeps the ids of units that it has met (a
fixed number of them), and one gather writes the ids of the chunk. Texts with runs of blanks or other white space than
blank and line feed, and texts that hold the spelling of a special token, take the plain way: the library encodes them whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from paraloom.llm.common import kept

#: Units whose ids a worker keeps, and the bytes of the longest that it keeps; both bound its memory.
KEPT_UNITS, KEPT_CHARS = 500_000, 48
#: Bytes of the texts whose units are looked up together; a longer text is a chunk of its own.
CHUNK_BYTES = 8_000_000
END_ID = 0
#: Signs that go off a unit before it is looked up, and what stands for them then.
_SIGNS = {"\x01": ",", "\x02": "."}
#: Runs of blanks and white space other than blank and line feed: what keeps a text from being told apart into units.
_ODD = "  |\n\n| \n|\n |[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Letters that stay one letter in lower case, and a unit of them with what stands before and the signs after them.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_SIGNED = re.compile(f"([\n\0]?)({_LETTERS})([!-/:-@\\[-`{{-~]+)")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_whole(ends_words: bool, special: list[str]) -> str:
    """The pattern of texts that are not told apart into units."""
    # a sign that goes off stands behind a letter or a digit, else it is part of a longer run of signs
    return "|".join(["[\0-\x02]", r"(?:\A|[^\pL\pN]|\x{130})[,.](?: |\n)", *[_ODD] * (not ends_words), *map(re.escape, special)])


class UnitEncoder:
    """Encodes texts with the tokenizer in a file.

    A unit is what stands between two blanks; its first character tells what it starts with: a line feed, nothing (NUL, at the
    start of a text) or a blank. A comma or full stop at its end is a unit of its own, and a vocabulary without case has units in lower case.
    special_text: spellings of special tokens are ordinary text; else they are the special tokens, as the library has it.
    """

    def __init__(self, path: str, kept_units: int = KEPT_UNITS, special_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_text
        self.kept_units = kept_units
        #: All ids are below this.
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        # a vocabulary that ends words drops white space and case; else a unit starts with the blank before it
        self.ends_words = self.tokenizer.model.end_of_word_suffix is not None
        self.whole = encoded_whole(self.ends_words, [x.content for x in self.tokenizer.get_added_tokens_decoder().values()])
        self.line = self._batch(["\n"])[0]
        self.spelled = self._letters()
        self.blank = "" if self.ends_words else self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")[0][0][:-1]
        marks = self._batch(list(_SIGNS.values()))
        self.known = pa.array(["", "\0", *_SIGNS], pa.large_string())
        self.lengths, self.flat = self._joined([b"" if self.ends_words else self._batch([" "])[0], b"", *marks])

    @staticmethod
    def _joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), dtype="<u4")

    def _batch(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self) -> dict[int, str]:
        """How the library spells each byte of the letters in units for its model."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        spelled = {}
        for c in filter(str.isalpha, map(chr, range(0x250))):
            spelled.update(zip(c.encode(), cut(c)[0][0], strict=True))
        return spelled

    def _words(self, words: list[str], blank: bool) -> list[bytes]:
        """Ids of words of letters only, each after a blank or not: the library's model alone, for a word is one piece to it."""
        lead = self.blank if blank else ""
        split = list(map(self.tokenizer.model.tokenize, [lead + (x if x.isascii() else (x.lower() if self.ends_words else x).encode().decode("latin-1").translate(self.spelled)) for x in words]))
        ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) * 4).tolist()
        flat = np.array([x.id for some in split for x in some], dtype="<u4").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn(self, units: list[str]) -> list[bytes]:
        """The ids of units that are not known."""
        out: list[bytes] = [b""] * len(units)
        plain = pc.match_substring_regex(pa.array(units, pa.large_string()), rf"\A[\n\x00]?{_LETTERS}\z").to_numpy(zero_copy_only=False)
        bare = np.fromiter(map("\x0b".__gt__, units), bool, len(units))  # a word after a line feed or at the start has no blank before it
        for some in (plain & ~bare, plain & bare):
            at = np.flatnonzero(some).tolist()
            if at:
                names = [units[k] for k in at]
                found = self._words([x[1:] for x in names], False) if bare[at[0]] else self._words(names, True)
                for k, x in zip(at, found, strict=True):
                    out[k] = x if units[k][0] != "\n" else self.line + x
        odd = [(k, units[k]) for k in np.flatnonzero(~plain).tolist()]
        signed = [(k, m.groups()) for k, u in odd if (m := _SIGNED.fullmatch(u))]
        if signed:
            words = list({lead + word for _, (lead, word, _) in signed})
            ids = dict(zip(words, self._learn(words), strict=True))
            runs = list({x[2] for _, x in signed})
            ends = dict(zip(runs, self._batch(runs), strict=True))
            for k, (lead, word, signs) in signed:
                out[k] = ids[lead + word] + ends[signs]
        others = [k for k, _ in odd if not out[k]]
        if others:
            spelled = [u if self.ends_words or u[0] == "\n" else u[1:] if u[0] == "\0" else f" {u}" for u in map(units.__getitem__, others)]
            for k, x in zip(others, self._batch(spelled), strict=True):
                out[k] = x
        return out

    def _table(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each of some distinct units begins in an array of ids, and how many it has; what is new is learned, and kept while there is room."""
        place = pc.fill_null(pc.index_in(units, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        starts = np.cumsum(self.lengths) - self.lengths
        new = np.flatnonzero(place < 0)
        if not len(new):
            return starts[place], self.lengths[place], self.flat
        long = pc.binary_length(units).to_numpy(zero_copy_only=False)[new] > KEPT_CHARS
        new = np.concatenate([new[~long], new[long]])
        names = units.take(pa.array(new))
        lengths, flat = self._joined(self._learn(names.to_pylist()))
        place[new] = len(self.lengths) + np.arange(len(new))
        every = np.concatenate([self.lengths, lengths])
        ids = np.concatenate([self.flat, flat])
        starts = np.cumsum(every) - every
        out = starts[place], every[place], ids
        room = self.kept_units - len(self.known)
        if room > 0:
            some = min(room, int((~long).sum()))
            self.known = pa.concat_arrays([self.known, names.slice(0, some)])
            self.lengths = every[: len(self.known)]
            self.flat = ids[: int(self.lengths.sum())]
        return out

    def encode(self, texts: pa.Array | Iterable[str | None], chunk_bytes: int | None = None) -> Iterator[np.ndarray]:
        """The ids of each text in order; a null text has none. chunk_bytes (CHUNK_BYTES by default) bounds the memory beside a longest text's."""
        chunk_bytes = chunk_bytes or CHUNK_BYTES
        texts = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(texts):
            done = size[first - 1] if first else 0
            end = max(first + 1, int(np.searchsorted(size, done + chunk_bytes, side="right")))
            yield from self._chunk(texts.slice(first, end - first))
            pa.default_memory_pool().release_unused()
            first = end

    def _split(self, texts: pa.Array) -> pa.Array:
        """The units of texts that can be told apart into units."""
        if self.ends_words:
            texts = pc.replace_substring(pc.ascii_lower(texts), "\n", " ")
        else:
            nothing = pa.scalar("", pa.large_string())
            texts = pc.replace_substring(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), texts, nothing), "\n", " \n")
        for mark, sign in _SIGNS.items():
            texts = pc.replace_substring(texts, f"{sign} ", f" {mark} ")
        return pc.split_pattern(texts, " ")

    def _chunk(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False)
        others = iter(self._batch(texts.filter(pa.array(whole)).to_pylist()) if whole.any() else [])
        rest = texts.filter(pa.array(~whole)) if whole.any() else texts
        units = self._split(rest)
        numbered = units.flatten().dictionary_encode()
        starts, lengths, flat = self._table(numbered.dictionary)
        at = numbered.indices.to_numpy(zero_copy_only=False)
        each = lengths[at]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        kind = np.int32 if max(before[-1], len(flat)) < 1 << 31 else np.int64
        place = np.repeat((starts[at] - before[:-1]).astype(kind), each)
        place += np.arange(len(place), dtype=kind)
        out = flat.take(place)
        last = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.list_value_length(units).to_numpy(zero_copy_only=False))])
        bounds, k = before[last].tolist(), 0
        for odd in whole.tolist():
            if odd:
                yield np.frombuffer(next(others), dtype="<u4")
            else:
                yield out[bounds[k] : bounds[k + 1]]
                k += 1


def encoder(path: str, kept_units: int = KEPT_UNITS) -> UnitEncoder:
    """The worker's encoder for a file; it outlives a task."""
    return kept(("encoder", path, kept_units), lambda: UnitEncoder(path, kept_units))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
