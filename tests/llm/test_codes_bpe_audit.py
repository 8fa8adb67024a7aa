"""Vector codes, BPE by a lexicon and the filter audit against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest


from paraloom.llm import bpe, filter_audit, transducer, vector_codes
from paraloom.llm.tokens import vocabulary_path
from tests.llm.test_sql import same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- vector codes ----


def plain_codes(rows, entries=256, rounds=4):
    rows = [(k, [int(np.floor(1024 * np.float64(x))) for x in v], label) for k, v, label in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    w = len(rows[0][1]) // 4
    part = lambda v, p: v[p * w : (p + 1) * w]
    first = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))[:entries]
    books = [[part(r[1], p) for r in first] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, p: min((far(part(v, p), c), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        met = defaultdict(list)
        for _, v, _ in rows:
            for p in range(4):
                met[p, best(v, p)[1]].append(part(v, p))
        for (p, i), some in met.items():
            books[p][i] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    found = [(k, label, [best(v, p) for p in range(4)]) for k, v, label in rows]
    of_label = Counter()
    for _, label, b in found:
        of_label[label] += sum(d for d, _ in b)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted([(k, "".join(f"{i:02x}" for _, i in b), sum(d for d, _ in b), of_label[label], digest) for k, label, b in found], key=repr)


def vectors(n=400, size=8, seed=4):
    r = np.random.default_rng(seed)
    rows = [(k, (r.normal(size=size) * (0.01 if k % 3 else 30)).astype(np.float32).tolist(), None if k % 7 == 0 else k % 3) for k in range(n)]
    rows += [(3, rows[3][1], 1), (900, rows[0][1], 2), (None, rows[5][1], 0), (901, None, 1), (902, [], 1), (903, [1.0] * (size - 1) + [None], 1), (904, [float("inf")] * size, 0), (905, [0.0] * size, 0)]
    return rows


def test_codes(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).selectExpr("*", "1 as code", "2 as id", "3 as v", "'x' as error")
    assert sorted(map(tuple, vector_codes.compress(df).collect()), key=repr) == plain_codes(rows)
    # vectors of another length fit no book; without rows there are none
    other = spark.createDataFrame([(2000, [1.0] * 12, 1), (2001, [1.0] * 7, 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vector_codes.compress(df.select("vec_id", "embedding", "label").unionByName(other), broadcast_rows=0).collect()), key=repr) == plain_codes(rows)
    none = vector_codes.compress(df.where("false"))
    assert none.count() == 0 and none.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


def test_codes_sql(spark, tmp_path):
    out = same(spark, tmp_path, vector_codes.query, vector_codes.ORACLE_SQL, {"embeddings": spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")})
    assert len({x[0] for x in out}) > 50


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 20, 1 << 27])
def test_nearest(spread):
    r = np.random.default_rng(spread)
    book = r.integers(-spread, spread + 1, size=(256, 16))
    x = np.concatenate([r.integers(-spread, spread + 1, size=(300, 16)), book[:40], book[:40] + r.integers(-1, 2, size=(40, 16))])
    far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    index, least = vector_codes.nearest(x, book)
    assert (index == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
    row, entry = vector_codes.screened(x, book)
    assert {(k, int(i)) for k, i in enumerate(far.argmin(axis=1))} <= set(zip(row.tolist(), entry.tolist(), strict=True))


def test_large_components_are_bounded(spark):
    rows = [(k, [3e38 if k == 2 else float(k)] * 64, 0) for k in range(5)]
    out = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert [r["error"] for r in out] == [0] * 5 and len({r["code"] for r in out}) == 5


def test_codes_decode(spark):
    df = spark.createDataFrame(vectors(200), "id long, v array<float>, label int")
    books, size = vector_codes.train(df, entries=64)
    coded = vector_codes.encode(df, books, size)
    back = vector_codes.decode(coded, books).collect()
    assert len(back) == 204
    for r in back:
        at = [int(r["code"][2 * p : 2 * p + 2], 16) for p in range(4)]
        assert r["vector"] == [(x + 0.5) / 1024 for p, k in enumerate(at) for x in books[p][k].tolist()]


# ---- BPE by a lexicon ----


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(vocabulary_path(bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(bpe.VOCABULARY))


def odd_texts(seed=3, n=400):
    r = random.Random(seed)
    letters = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000] + ["😀", "𝒳"]
    plain = ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(1, 12))) for _ in range(500)]
    out = [None, "", "a", " ", "  a  b", "don't, I've. said: x_y=3 (foo)", "<|endoftext|>ab<|endoftext|> <|endoftext|", "a" * 5000, "abab" * 900 + " " + "x" * 257, "\n\n a\n b \n", "aaa aaaa aaaaa", "\0\x01, \x02."]
    out += ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(n)]
    out += ["".join(r.choices("ab cd'e,.\n\t 12é中 s t", k=r.randint(1, 80))) for _ in range(n)]
    return out + [" ".join(r.choices(plain, k=60)) for _ in range(60)] + [" ".join(r.choices(plain, k=30_000))]


def test_encoding_is_the_librarys(merges, library):
    texts = odd_texts()
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    words = {w for t in texts for w in bpe.LexiconEncoder(merges).pieces(t or "")}
    some = transducer.Transducer(np.frombuffer(bpe.build_lexicon(sorted(words)[::3], merges), dtype=np.uint8))
    for lexicon in (None, some, transducer.Transducer(np.frombuffer(bpe.build_lexicon([], merges), dtype=np.uint8))):
        assert [x.tolist() for x in bpe.LexiconEncoder(merges, lexicon).encode(texts)] == want
    for ids in want:
        assert merges.decode(np.array(ids, dtype=np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)
        assert merges.spelled_sha256(np.array(ids, dtype=np.uint32)) == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    r = random.Random(1)
    for ids in [r.choices(range(50257), k=20) for _ in range(100)]:  # not UTF-8 as a rule
        assert merges.decode(np.array(ids, dtype=np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_gathering_in_parts(merges, monkeypatch):
    monkeypatch.setattr(bpe, "GATHERED", 7)
    ids = np.arange(100, 250, dtype=np.uint32)
    assert merges.decode(ids) == b"".join(merges.bytes[100:250]).decode("utf-8", "replace").encode()
    assert merges.spelled_sha256(ids) == hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


@pytest.mark.parametrize("long", [3, 256])
def test_merges(merges, monkeypatch, long):
    monkeypatch.setattr(bpe, "LONG_PIECE", long)
    r = random.Random(long)
    pieces = ["".join(r.choices("aethin rs", k=r.randint(0, 30))).encode() for _ in range(400)] + [b"a" * k for k in range(12)]

    def slow(piece):
        ids = merges.of_byte[list(piece)].tolist()
        while True:
            ranks = [(merges.rank_of.get(a << 32 | b, 1 << 60), k) for k, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            if not ranks or min(ranks)[0] == 1 << 60:
                return ids
            rank, k = min(ranks)
            ids[k : k + 2] = [int(merges.made[rank])]

    flat, lengths = merges.merge(pieces)
    ends = np.cumsum(lengths)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, lengths, strict=True)] == [slow(p) for p in pieces]


def right_languages(words):
    """How many states a smallest automaton without outputs has: one for each different set of endings."""
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    return len({frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes})


def test_transducer_is_minimal():
    r = random.Random(2)
    words = sorted({("".join(r.choices("abc", k=r.randint(1, 5))) + r.choice(["", "ing", "ed", "s"])).encode() for _ in range(150)})
    plain = transducer.Transducer(np.frombuffer(transducer.compile_words((w, ()) for w in words), dtype=np.uint8))
    assert plain.states == right_languages(words)
    # a stem and a suffix with ids of their own: suffixes stay shared
    told = {w + s: (k, 99 + len(s)) for k, w in enumerate([b"walk", b"talk", b"jump", b"look"]) for s in (b"ed", b"ing", b"s")}
    made = transducer.Transducer(np.frombuffer(transducer.compile_words(sorted(told.items())), dtype=np.uint8))
    assert made.states < 20
    asked = [b"walked", b"walk", b"", b"talks", b"jumping", b"x", b"lookss", *sorted(told)]
    known, lengths, flat = made.lookup(pa.array(asked, pa.large_binary()))
    ends = np.cumsum(lengths)
    assert known.tolist() == [w in told for w in asked]
    assert [tuple(flat[e - n : e].tolist()) for e, n in zip(ends, lengths, strict=True)] == [told.get(w, ()) for w in asked]
    with pytest.raises(ValueError):
        transducer.compile_words([(b"b", ()), (b"a", ())])


def test_random_outputs():
    r = random.Random(8)
    told = {"".join(r.choices("ab", k=r.randint(1, 9))).encode(): tuple(r.choices(range(4), k=r.randint(0, 4))) for _ in range(300)}
    made = transducer.Transducer(np.frombuffer(transducer.compile_words(sorted(told.items())), dtype=np.uint8))
    names = sorted(told)
    known, lengths, flat = made.lookup(pa.array(names, pa.large_binary()).slice(0))
    ends = np.cumsum(lengths)
    assert known.all() and [tuple(flat[e - n : e].tolist()) for e, n in zip(ends, lengths, strict=True)] == [told[w] for w in names]


def test_bpe_query(spark, tmp_path, library):
    rows = [(k if k != 8 else None, t) for k, t in enumerate(odd_texts(n=40))]
    rows += [rows[20], rows[20]]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "'x' as word", "2 as n")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = bpe.query(spark, str(tmp_path)).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(k, library.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    want = [(k, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))) for k, ids in want]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    words = bpe.frequent_words(df, vocabulary_path(bpe.VOCABULARY), most=50)
    assert 0 < len(words) <= 50
    assert bpe.encode_texts(df.where("false")).count() == 0


def test_bpe_gives_ids_and_texts(spark):
    df = spark.createDataFrame([(1, "some words, some more"), (2, None)], "doc_id long, text string")
    out = {r["doc_id"]: (len(r["ids"]), r["decoded"]) for r in bpe.encode_texts(df, with_ids=True).collect()}
    assert out == {1: (5, "some words, some more"), 2: (0, "")}


# ---- filter audit ----


def plain_audit(rows, labels):
    least, good, toxic = {}, set(), set()
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    for k, q, x in labels:
        if k is not None:
            good |= {k} if q == 1 else set()
            toxic |= {k} if x == 1 else set()
    parts = defaultdict(list)
    for k, t, lang in rows:
        t, w = t or "", WORD.findall(t or "")
        upper = sum("A" <= c <= "Z" for c in t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * upper > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": k is not None and k > least[t]}
        parts[lang or ""].append((k, {f for f, bad in fails.items() if bad}))
    out = []
    for part, docs in parts.items():
        made = {}
        for order in permutations("ABCDE"):
            alive = docs
            for step, f in enumerate(order):
                gone = [d for d in alive if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                redundant = sum(f in d[1] and bool(d[1] & set(order[:step])) for d in docs)
                made["".join(order), step + 1] = (len(alive), len(gone), redundant, sum(d[1] == {f} for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone))
        total = Counter()
        for (order, step), x in made.items():
            total[order[step - 1]] += x[1]
        out += [(part, order, step, *x, total[order[step - 1]]) for (order, step), x in made.items()]
    return sorted(out)


def audited(n=60, seed=6):
    r = random.Random(seed)
    base = [" ".join(r.choices(["alpha", "beta", "gamma", "Delta", "x#y"] + [f"w{k}" for k in range(300)], k=r.choice([20, 120, 400]))) for _ in range(n)]
    texts = [None, "", "   ", *base, *base[::2], *[base[1]] * 9, base[3] + "!", base[3][:-1] + "?", " ".join(["ABC", "DEF"] * 30_000), " ".join(["ABC", "DEF"] * 29_999 + ["ABC", "DEG"]), " ".join(["ABC", "DEF"] * 30_000)]
    r.shuffle(texts)
    rows = [(k if k not in (5, 6) else None, t, ["en", "fr", None, ""][k % 4]) for k, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (rows[9][0], "another text", "en")]


def test_audit(spark, tmp_path):
    rows = audited()
    labels = [(k, k % 2, k % 5 == 0) for k in range(0, len(rows), 2)] + [(4, 0, False), (4, 1, False), (None, 1, True), (8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as id", "2 as mask", "3 as part", "4 as t", "5 as c0")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) as toxic")
    want = plain_audit(rows, labels)
    assert sorted(map(tuple, filter_audit.audit(docs, marks).collect())) == want
    # blocks of no length and one for all of a text: hashes that collide are settled by whole texts
    assert sorted(map(tuple, filter_audit.audit(docs, marks, blocks=(3,), broadcast_rows=0).collect())) == want
    out = same(spark, tmp_path, filter_audit.query, filter_audit.ORACLE_SQL, {"documents": docs.select("doc_id", "text", "lang"), "labels": marks})
    assert len(out) == 3 * 600
    assert filter_audit.audit(docs.where("false"), marks).count() == 0


def test_copies_survive_colliding_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "_block_hashes", lambda text, blocks: [F.lit(0)] * (len(blocks) + 1))
    rows = audited(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    least = {}
    for k, t, _ in rows:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    want = sorted(k for k, t, _ in rows if k is not None and k > least[t or ""])
    for limit in (0, 1000):
        assert sorted(r["id"] for r in filter_audit.copies(docs, broadcast_rows=limit).collect()) == want
