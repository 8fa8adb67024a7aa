"""Pair search with a cutoff, and windows of texts as numbers, against plain Python."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from paraloom.operators import grams
from paraloom.operators import match as M
from paraloom.operators import reads as R
from paraloom.operators.pair_search import Profiles


def plain_pairs(rows, with_other):
    """{(key, a, b): total} of rows (key, read, item, value, other, copies)."""
    reads = {}
    for key, read, item, value, other, copies in rows:
        reads.setdefault((key, read), ({}, other, copies))[0][item] = value
    out = {}
    for (key, _), (of, other, copies) in reads.items():
        for a in of:
            for b in of:
                if a <= b:
                    n = copies if with_other else 2
                    for k in [n] if a == b else range(1, max(n - 1, 1) + 1):
                        mixed = k * math.exp(of[a]) + (n - k) * math.exp(of[b])
                        mixed = (mixed + math.exp(other)) / (n + 1) if with_other else mixed / 2
                        out.setdefault((key, a, b), {}).setdefault(k, []).append(math.log(mixed))
    return {x: max(sum(v) for v in by_split.values()) for x, by_split in out.items()}


def loglik(seed=4, items=14, lacking=0.0):
    r = random.Random(seed)
    rows = []
    for key, copies in (("s", 3), ("t", 1), ("u", 2)):
        for read in range(60):
            level = [r.choice([-0.1, -5.0, -9.0]) for _ in range(items)]
            rows += [(key, read % 50, f"i{k:02d}", level[k], -1.0 - read % 50 % 3, copies) for k in range(items) if read < 50 and r.random() >= lacking]
    return rows


@pytest.mark.parametrize("lacking", [0.0, 0.3])
@pytest.mark.parametrize("most", [None, 20, 3])
def test_pairs(spark, lacking, most):
    rows = loglik(lacking=lacking)
    df = spark.createDataFrame(rows, "key string, read int, item string, v double, lo double, cn int").repartition(5)
    for with_other in (True, False):
        found = R.paralog_mixture(df, ["key"], "read", "item", "v", "lo", "cn", most) if with_other else M.pair_mixture(df, ["key"], "read", "item", "v", most)
        want = plain_pairs(rows, with_other)
        got = {(r["key"], r["a"], r["b"]): r["total"] for r in found.collect()}
        if most is None:
            assert got.keys() == want.keys()
        for key in ("s", "t", "u"):
            best = sorted((t for (k, _, _), t in want.items() if k == key), reverse=True)[: most or 10**6]
            assert sorted((t for (k, _, _), t in got.items() if k == key), reverse=True) == pytest.approx(best, abs=1e-9)
        assert all(t == pytest.approx(want[x], abs=1e-9) for x, t in got.items())


def test_pairs_far_apart_and_equal():
    values = np.array([[-1.0, -900.0, -2000.0], [-2000.0, -1.0, -1500.0]])
    for other in (None, np.array([-1800.0, -1700.0])):
        got = {(a, b): t for a, b, t in Profiles(values, np.array([2, 1]), other, 2).pairs(None)}
        third = -np.inf if other is None else other[1]
        scale = np.log(1.0 if other is None else 3.0)
        whole = 1.0 if other is None else 2.0
        want = 2 * (-900 + np.log(whole) - scale) + (np.logaddexp(-1 + np.log(whole), third) - scale)
        assert got[1, 1] == pytest.approx(want) and np.isfinite(list(got.values())).all()
    same = Profiles(np.zeros((4, 12)), np.ones(4), None, 0)
    assert [x[:2] for x in same.pairs(5)] == [(0, k) for k in range(5)]


def test_a_large_sample_stays_small():
    r = np.random.default_rng(1)
    base = r.integers(0, 2, size=(213, 40))
    values = np.zeros((5000, 213))
    other = np.zeros(5000)
    for p in range(5000):
        shown = base[(3, 77)[p % 2]] if p % 10 < 7 else 1 - base[5]
        at = r.choice(40, size=1 + p % 4, replace=False)
        values[p] = np.where(base[:, at] == shown[at], math.log(0.99), math.log(0.003)).sum(axis=1)
        other[p] = np.where((1 - base[5])[at] == shown[at], math.log(0.99), math.log(0.003)).sum()
    search = Profiles(values, np.ones(5000), other, 4)
    tracemalloc.start()
    best = search.pairs(20)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert best[0][:2] == (3, 77) and [x[:2] for x in best] == [x[:2] for x in search.pairs(None)[:20]]


# ---- windows as numbers ----


@pytest.mark.parametrize("k", [1, 2, 3, 7, 12, 16, 31])
def test_hashes(k):
    r = random.Random(k)
    codes = np.array([r.randint(0, 0x10FFFF) for _ in range(100)], dtype=np.uint32)
    want = [sum(int(c) * grams._FACTOR ** (k - 1 - j) for j, c in enumerate(codes[i : i + k])) % (1 << 64) for i in range(100 - k + 1)]
    assert grams.hashes(codes, k).tolist() == want
    assert len(grams.hashes(codes[: k - 1], k)) == 0


@pytest.mark.parametrize(("k", "piece"), [(3, grams.PIECE), (5, 7), (2, 1)])
def test_occurrences(spark, monkeypatch, k, piece):
    r = random.Random(k)
    texts = [None, "", "ab", "é😀ab" * 5, "a" * 40] + ["".join(r.choices("abN😀", k=r.randint(0, 60))) for _ in range(80)]
    panel = sorted({"".join(r.choices("abN😀", k=k)) for _ in range(30)} | {"a" * k})
    own = grams.Panel(panel, k)
    monkeypatch.setattr(grams, "PIECE", piece)
    found = [(int(row), int(at), own.names[g]) for part in own.scan(texts) for row, at, g in zip(*part, strict=True)]
    want = [(n, i, t[i : i + k]) for n, t in enumerate(texts) for i in range(len(t or "") - k + 1) if t[i : i + k] in set(panel)]
    assert sorted(found) == want and want
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = {(x["id"], x["gram"]): x["n"] for x in grams.occurrences(df, ["id"], "text", panel, k).collect()}
    assert got == Counter((n, g) for n, _, g in want)
    assert sorted((x["id"], x["at"], x["gram"]) for x in grams.occurrences(df, ["id"], "text", panel, k, places=True).collect()) == want
    assert grams.occurrences(df, ["id"], "text", [], k).count() == 0 and grams.occurrences(df.where("false"), ["id"], "text", panel, k).count() == 0
    # a panel too large for the workers gives the same rows
    marked = spark.createDataFrame([(g, n % 3) for n, g in enumerate(panel)], "kmer string, source int")
    for most in (10**6, 3):
        hits = {(x["id"], x["kmer"], x["source"]): x["n"] for x in M.kmer_hits(df, ["id"], "text", marked, k, panel_kmers=most).collect()}
        assert hits == {(i, g, panel.index(g) % 3): n for (i, g), n in Counter((n, g) for n, _, g in want).items() if "N" not in g}


def test_colliding_factor(spark, monkeypatch):
    # with a factor of 1 all orders of the same letters collide
    monkeypatch.setattr(grams, "_FACTOR", 1)
    own = grams.Panel(["abc", "cba", "bac"], 3)
    assert own.factor != 1
    own = grams.Panel(["abc"], 3)
    own.factor = 1
    own.keys = grams.hashes(own.table.ravel(), 3, 1)
    own.bitmap[own.keys >> np.uint64(64 - grams.BITMAP_BITS)] = True
    assert [x.tolist() for x in own.find(np.array([ord(c) for c in "cbabc"], dtype=np.uint32))] == [[2], [0]]


def test_seeds_with_a_large_panel(spark):
    r = random.Random(5)
    refs = spark.createDataFrame([(k, "".join(r.choices("ab", k=50))) for k in range(20)], "rid int, ref string")
    queries = spark.createDataFrame([(k, "".join(r.choices("ab", k=12))) for k in range(20)], "qid int, q string")
    out = [sorted(map(tuple, M.qgram_seeds(queries, "qid", "q", refs, "rid", "ref", 4, 2, panel_grams=n).collect())) for n in (10**6, 2)]
    assert out[0] == out[1] and len(out[0]) > 20


# ---- two-sided tests without tables, and fragments against candidates ----


def plain_fisher(a, b, c, d):
    n, row, col = a + b + c + d, a + b, a + c
    if n == 0:
        return 1.0
    p = lambda k: math.comb(row, k) * math.comb(n - row, col - k) / math.comb(n, col)
    return min(1.0, sum(x for k in range(max(0, row + col - n), min(row, col) + 1) if (x := p(k)) <= p(a) + 1e-12))


def test_two_sided():
    from paraloom.operators.models import two_sided

    r = random.Random(1)
    rows = [[r.randint(0, 40) for _ in range(4)] for _ in range(1500)] + [[r.choice([0, 1, 300]) for _ in range(4)] for _ in range(60)] + [[0] * 4, [0, 5, 0, 5], [5, 0, 0, 7], [1, 0, 0, 0]]
    assert two_sided(*np.array(rows).T) == pytest.approx([plain_fisher(*x) for x in rows], abs=1e-11)
    large = np.array([[500_000, 500_000, 500_000, 500_000], [500_000, 500_600, 500_700, 500_000], [501_500, 500_000, 500_000, 501_500], [10, 10**6, 10**6, 5]] * 50)
    tracemalloc.start()
    got = two_sided(*large.T)
    assert tracemalloc.get_traced_memory()[1] < 5e6  # no table as long as a margin
    tracemalloc.stop()
    # against the normal distribution of the same mean and spread, with its correction
    for x, p in zip(large[:3], got, strict=False):
        a, b, c, d = map(float, x)
        n, row, col = a + b + c + d, a + b, a + c
        spread = math.sqrt(row * col * (n - row) * (n - col) / n / n / (n - 1))
        assert p == pytest.approx(min(1.0, math.erfc(max(0.0, abs(a - row * col / n) - 0.5) / spread / math.sqrt(2))), abs=2e-3)
    assert got[3] < 1e-9 and (got[:4] == got[4:8]).all()


def test_fisher_nulls(spark):
    from paraloom.operators import models

    df = spark.createDataFrame([(0, 0, 0, 0), (3, 1, 0, 5), (None, 1, 2, 3)], "a int, b int, c int, d int")
    got = [(x["p_value"], x["odds_ratio"]) for x in models.fisher_exact(df, "a", "b", "c", "d").orderBy("b", "a").collect()]
    assert (1.0, None) in got and (None, None) in got and any(p == pytest.approx(plain_fisher(3, 1, 0, 5)) for p, _ in got if p)


def test_phasing_scores(spark):
    from paraloom.operators import evidence as E

    stars = spark.createDataFrame([("*1", []), ("*2", ["x", "y"]), ("*3", ["x"]), ("*4", ["y"]), ("*9", ["z"])], "name string, parts array<string>")
    modes = [("s", "x:1,y:1", 8), ("s", "x:1,y:0", 1), ("s", "x:0,y:0", 50), ("t", "x:1,y:0", 4), ("t", "x:0,y:1", 5), ("u", "x:0,y:0", 3), ("w", "z:1,y:1", 5)]
    calls = [("s", "*3/*4;*1/*2"), ("t", "*1/*2;*3x2/*9+*4;*5"), ("u", "*1/*2"), ("v", "*1/*2"), ("w", "*1/*9 ; *4/*9+*4"), ("none", None)]
    out = E.phasing_scores(spark.createDataFrame(modes, "sample_id string, pattern string, n long"), spark.createDataFrame(calls, "sample_id string, genotype string"), stars)
    got = {(r["sample_id"], r["candidate"]): tuple(r)[3:] for r in out.collect()}
    assert got["s", "*1/*2"] == (1, 1, 8, 1, pytest.approx(math.log(8)), True, "Phasing_prefers_*1_*2")
    assert got["s", "*3/*4"] == (1, 1, 1, 8, pytest.approx(-math.log(8)), False, None)
    # *9+*4 has y and z, so a read with y alone is of its side though it does not cover z
    assert got["t", "*3x2/*9+*4"] == (2, 0, 9, 0, 10.0, True, "Phasing_prefers_*3x2_*9+*4") and got["t", "*1/*2"] == (0, 2, 0, 9, -10.0, False, None)
    assert got["t", "*5"] == (0, 0, 0, 0, 0.0, False, None)
    assert got["u", "*1/*2"] == (0, 0, 0, 0, 0.0, True, None)
    assert got["w", "*1/*9"][4] == -10.0 and got["w", "*4/*9+*4"][4:] == (10.0, True, "Phasing_prefers_*4_*9+*4")
    assert {s for s, _ in got} == {"s", "t", "u", "w"}
