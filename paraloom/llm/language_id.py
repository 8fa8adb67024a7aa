"""Language ID by cross-parsing: a text takes few phrases from the language that it is written in.

For each language one suffix automaton is built over a sample of its labelled texts. A text is parsed greedily into the longest phrases that the automaton
knows (a letter that it does not know is a phrase), and the language with the fewest phrases for each character wins. Texts are first reduced to lower-case letters and
single blanks. Stretches of a text are parsed side by side from the automaton's root; then each is parsed again from the state in which its
predecessor ended until both parses stand in the same state, so the count is that of one parse of the whole text.

The sample is bounded, the languages are not: TRAIN_DOCS rows of each label, in order of a hash, texts of TEXT_CHARS characters or fewer first and of longer
ones TEXT_CHARS characters; an automaton takes TRAIN_CHARS characters at most. Predictions see the text only.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled rows every text is; ties go to
the first language by name; a null doc_id counts as the text `null` and is never held out unless its checksum says so; repeated rows are predicted alike;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.llm.common import kept, numbered, read_table, trim

UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
TRAIN_DOCS, TEXT_CHARS, TRAIN_CHARS = 40, 10_000, 40_000
#: Characters of a stretch, stretches parsed side by side, and characters of texts that are predicted together (a longer text is a batch of its own).
STRETCH, LANES, BATCH_CHARS = 256, 4096, 1_000_000
#: Cells of the tables of all languages together; beyond that all automata are lists of edges, which answer alike.
TABLE_CELLS = 32_000_000
#: The stage takes a label for wrong if another language wins by this score and the label's own wins in less than this share of the text's pieces, of so many characters.
SURE, PART, PIECE = 0.1, 0.1, 100


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("null"))) % FOLDS == HELD_OUT


def letters(text: str) -> str:
    """The text in lower case with one blank for every run of characters that are no letters."""
    low = text.lower()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _letter_table()[np.minimum(codes, 0x10FFFF)]
    out = np.where(kind, codes, 32)
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = kind[1:] | kind[:-1]
    return out[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


@functools.cache
def _letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Automaton:
    """A suffix automaton over one language's letters: its edges, or a table of the next state and whether a phrase begins for each state and letter."""

    def __init__(self, text: str, alphabet: dict[str, int]):
        own = {c: k for k, c in enumerate(sorted(set(text)))}
        length, link, moves = [0], [-1], [{}]
        last = 0
        for c in map(own.__getitem__, text):
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = now
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    twin = len(length)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        # letters of other languages are the last one here
        self.states, self.width = len(length), len(own) + 1
        self.letter = np.full(len(alphabet) + 1, len(own), dtype=np.int32)
        self.letter[[alphabet[c] for c in own]] = np.arange(len(own))
        self.keys = np.fromiter((s * self.width + c for s, out in enumerate(moves) for c in sorted(out)), np.int64)
        self.nexts = np.fromiter((out[c] for out in moves for c in sorted(out)), np.int32)
        self.fresh = np.zeros(self.width, dtype=np.int32)
        self.fresh[list(moves[0])] = list(moves[0].values())
        self.table: np.ndarray | None = None

    def tabulate(self) -> None:
        """Make the table: twice the next state, and one more where a phrase begins."""
        steps = np.broadcast_to(self.fresh * 2 + 1, (self.states, self.width)).copy()
        steps.reshape(-1)[self.keys] = self.nexts * 2
        steps[0] = self.fresh * 2 + 1
        self.table = steps.reshape(-1)

    def step(self, state: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Twice the next state, and one more where a phrase begins with the letter."""
        at = state * self.width + letter
        if self.table is not None:
            return self.table[at]
        k = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return np.where((self.keys[k] == at) & (state > 0), self.nexts[k] * 2, self.fresh[letter] * 2 + 1)

    def phrases(self, symbols: np.ndarray, length: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that begin in each row of symbols. Rows are columns of the array, longest first; after[k] is the row that row k goes on from, or -1."""
        n, width = len(length), int(length[0])
        letter = self.letter[symbols]
        states, begun = np.zeros((width, n), dtype=np.int32), np.zeros((width, n), dtype=bool)
        state, end = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        live = n - np.searchsorted(length[::-1], np.arange(width), side="right")  # rows that have a k-th symbol
        for k in range(width):
            m = int(live[k])
            move = self.step(state[:m], letter[k, :m])
            state = (move >> 1).astype(np.int64)
            states[k, :m], begun[k, :m] = state, move & 1
            end[:m] = state
        lanes = np.flatnonzero(after >= 0)
        entered = np.zeros(n, dtype=np.int64)
        while len(lanes):
            # from the state in which the row before ended, until the parse meets the one that is known
            begin = end[after[lanes]]
            todo = begin != entered[lanes]
            lanes, begin = lanes[todo], begin[todo]
            entered[lanes] = begin
            state, rows, changed = begin, lanes, []
            for k in range(width):
                inside = length[rows] > k
                rows, state = rows[inside], state[inside]
                if not len(rows):
                    break
                move = self.step(state, letter[k, rows])
                begun[k, rows] = move & 1
                state = (move >> 1).astype(np.int64)
                apart = state != states[k, rows]
                rows, state = rows[apart], state[apart]
                states[k, rows] = state
                closed = rows[length[rows] == k + 1]
                end[closed] = states[k, closed]
                changed.append(closed)
            lanes = np.flatnonzero(np.isin(after, np.concatenate(changed))) if changed else lanes[:0]
        return begun.sum(axis=0)


class Model:
    """The automata of all languages; a text's letters are numbered once for all of them."""

    def __init__(self, samples: list[tuple[str, str]], table_cells: int = TABLE_CELLS):
        self.languages = [x for x, _ in samples]
        texts = dict(samples)
        self.alphabet = {c: k for k, c in enumerate(sorted({c for t in texts.values() for c in t}))}
        self.codes = np.full(0x110000, len(self.alphabet), dtype=np.int32)
        for c, k in self.alphabet.items():
            self.codes[ord(c)] = k
        self.automata = [Automaton(texts[name], self.alphabet) for name in self.languages]
        if sum(a.states * a.width for a in self.automata) <= table_cells:
            for a in self.automata:
                a.tabulate()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        plain = [letters(x).strip() if x else "" for x in texts]
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [k for k, x in enumerate(plain) if x] if self.languages else []
        if not known:
            return out
        sizes = np.array([len(plain[k]) for k in known])
        flat = self.codes[np.frombuffer("".join(plain[k] for k in known).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        first, pieces = np.cumsum(sizes) - sizes, -(-sizes // STRETCH)
        before = np.cumsum(pieces) - pieces
        counts = np.zeros((len(self.languages), len(known)), dtype=np.int64)
        begin = 0
        while begin < len(known):
            # whole texts of about LANES stretches
            stop = max(begin + 1, int(np.searchsorted(before + pieces, before[begin] + LANES, side="right")))
            owner = np.repeat(np.arange(begin, stop), pieces[begin:stop])
            inner = np.arange(len(owner)) - (before[owner] - before[begin])
            start = first[owner] + inner * STRETCH
            length = np.minimum(STRETCH, sizes[owner] - inner * STRETCH)
            order = np.argsort(-length, kind="stable")
            place = np.empty(len(order), dtype=np.int64)
            place[order] = np.arange(len(order))
            after = np.where(inner > 0, np.r_[-1, place[:-1]], -1)[order]
            at = np.arange(int(length.max()), dtype=np.int32)[:, None] + start[order][None, :].astype(np.int32 if len(flat) < 1 << 30 else np.int64)
            symbols = flat.take(at, mode="clip")
            del at
            for m, automaton in enumerate(self.automata):
                counts[m, begin:stop] = np.bincount(owner[order] - begin, automaton.phrases(symbols, length[order], after), stop - begin)
            begin = stop
        rate = counts / sizes[None, :]
        ordered, best = np.sort(rate, axis=0), np.argmin(rate, axis=0)
        score = 1 - ordered[0] / ordered[1] if len(self.languages) > 1 else np.ones(len(known))
        for k, b, x in zip(known, best.tolist(), score.tolist(), strict=True):
            out[k] = (self.languages[b], min(1.0, max(0.0, x)))
        return out


    def share(self, text: str, language: str) -> float:
        """The share of a text's pieces in which a language wins."""
        plain = letters(text).strip()
        found = self.predict([plain[k : k + PIECE] for k in range(0, len(plain), PIECE)])
        return sum(x == language for x, _ in found) / max(1, len(found))


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> list[tuple[str, str]]:
    """(language, sample text) for each language, by name."""
    text = F.col(text_col)
    rows = docs.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & text.isNotNull()).select(
        F.col(label_col).alias("lang"), (F.char_length(text) > TEXT_CHARS).alias("long"), F.xxhash64(F.lit(5), F.col(id_col)).alias("h"), F.substring(text, 1, TEXT_CHARS).alias("text")
    )
    picked = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "text"))).where(F.col("k") <= TRAIN_DOCS)
    found = sorted((r["lang"], r["k"], r["text"]) for r in picked.select("lang", "k", "text").collect())  # TRAIN_DOCS texts of TEXT_CHARS characters a language
    samples: dict[str, str] = {}
    for lang, _, text in found:
        plain, so_far = letters(text).strip(), samples.setdefault(lang, "")
        if len(so_far) + len(plain) < TRAIN_CHARS:
            samples[lang] = f"{so_far} {plain}".strip()
    return sorted((lang, x) for lang, x in samples.items() if x)


def predict(docs: DataFrame, samples: list[tuple[str, str]], text_col: str = "text", out: str = "language", label_col: str | None = None) -> DataFrame:
    """docs with the struct column `out` (lang, score[, label_share]); a column of that name is replaced.

    With a column of labels, label_share has the share of a text's pieces in which the label's language wins, for texts that go to another one.
    """
    key, known = hash(tuple(samples)), {x for x, _ in samples}

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = kept(("language", key), lambda: Model(samples))
        for batch in batches:
            texts, found, size = [], [], 0
            first = 1 if label_col is None else 2
            for x in batch.column(0):
                texts.append(x.as_py())
                size += len(texts[-1] or "")
                if size >= BATCH_CHARS:
                    found += model.predict(texts)
                    texts, size = [], 0
            found += model.predict(texts)
            parts = {"lang": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())}
            if label_col is not None:
                shares: list[float | None] = [None] * len(found)
                for k, (label, (lang, _)) in enumerate(zip(batch.column(1).to_pylist(), found, strict=True)):
                    if label in known and lang not in (label, UNKNOWN):
                        shares[k] = model.share(batch.column(0)[k].as_py(), label)
                parts["label_share"] = pa.array(shares, pa.float64())
            language = pa.StructArray.from_arrays(list(parts.values()), list(parts))
            yield pa.RecordBatch.from_arrays([*batch.columns[first:], language], names=[*batch.schema.names[first:], "found"])
        trim()

    others = [c for c in docs.columns if c != out]
    lead = [text_col] if label_col is None else [text_col, label_col]
    rows = numbered(docs, [*lead, *others])
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema.fields[len(lead) :])
    found = rows.mapInArrow(compute, f"{fields}found struct<lang:string,score:double{',label_share:double' if label_col else ''}>")
    return found.select(*[F.col(f"c{k + len(lead)}").alias(c) for k, c in enumerate(others)], F.col("found").alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = predict(rows, training_sample(docs))
    return out.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told and is not plainly another than their label says; a null label is filled with the prediction.

    Those without a letter go (nulls and empty texts too), and all if no language was learned. A text of several languages keeps the label of any that
    has its part in it, and a label that was not learned is not judged. Repeated rows are judged alike; columns of any name pass through unchanged, but for the nulls of `lang`.
    """
    found, told = predict(docs, training_sample(docs), out="__language", label_col="lang"), F.col("__language.lang")
    wrong = (F.col("__language.label_share") < PART) & (F.col("__language.score") >= SURE)
    out = found.where((told != UNKNOWN) & ~F.coalesce(wrong, F.lit(False)))
    return out.select(*[F.coalesce("lang", told).alias(c) if c == "lang" else F.col(c) for c in docs.columns])
