"""Operators against values that are known and against plain Python."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paraloom.functions import scalar as S
from paraloom.operators import aggregates as A
from paraloom.operators import align
from paraloom.operators import calls as C
from paraloom.operators import intervals as I
from paraloom.operators import match as M
from paraloom.operators import models as P
from paraloom.operators import reads as R
from paraloom.operators import segment as G


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_center_and_mad(spark):
    df = spark.createDataFrame([("a", x) for x in (3.0, 1.0, 2.0)] + [("b", x) for x in (4.0, 1.0, 3.0, 2.0)] + [("c", x) for x in (1.0, 2.0, 3.0, 4.0, 5.0)], "k string, v double")
    got = {r["k"]: r for r in A.center(df, ["k"], "v").collect()}
    assert (got["a"]["median"], got["b"]["median"], got["b"]["mean"]) == (2.0, 2.5, 2.5)
    assert {r["k"]: r["mad"] for r in A.mad(df, ["k"], "v").collect()}["c"] == pytest.approx(1.4826)


def test_modal_support(spark):
    df = spark.createDataFrame([("a", x) for x in (2, 2, 1, None)] + [("b", 1), ("b", 3)] + [("c", None)], "k string, v int")
    assert {r["k"]: (r["v"], r["support"]) for r in A.modal(df, ["k"], "v", 2).collect()} == {"a": (2, 2), "b": (None, 1), "c": (None, 0)}


def test_round3(spark):
    got = one(spark, *[S.round3(F.lit(x)).alias(f"x{k}") for k, x in enumerate((0.0005, 0.0015, 2.0004999999999, 1.2344))])
    assert list(got) == [0.0, 0.002, 2.0, 1.234]


def test_variant_names(spark):
    names = ["g.42128945C>T", "g.42128945delC", "g.42128945delCT", "g.1_2insA", None]
    got = [r["v"] for r in spark.createDataFrame([(x,) for x in names], "n string").select(S.parse_variant(F.col("n")).alias("v")).collect()]
    assert tuple(got[0]) == (42128945, "C", "T", False) and tuple(got[1]) == (42128945, "C", "-", True) and got[2]["ref"] == "CT" and got[3:] == [None, None]


def test_count_strings(spark):
    got = [tuple(one(spark, S.alt_count(F.lit(x)).alias("a"), S.ref_count(F.lit(x)).alias("b"))) for x in ("26,0", "0(0:0),81", "1(1:0),106")]
    assert got == [(26, 0), (0, 81), (1, 106)]


def test_scalar_names(spark):
    got = one(
        spark, S.multiset_key(F.array(*map(F.lit, ["b", "a", "NA", "b"]))).alias("k"), S.multiset_key(F.array().cast("array<string>")).alias("e"), S.main_allele(F.lit("*4.013")).alias("m"), S.without_copies(F.lit("*2x2")).alias("x"),
        S.star_parts(F.lit("*36x2+*10/*1;*10")).alias("p"), S.reverse_complement(F.lit("ACGTN")).alias("r"), S.sort_pair(F.lit("*10/*2")).alias("s"), S.sort_pair(F.lit("*10")).alias("t"),
        S.base_code(F.lit("g")).alias("g"), S.base_code(F.lit("N")).alias("n"), S.allele_state(F.lit("ac"), F.lit("ACG"), F.lit("T")).alias("al"),
    )
    assert (got["k"], got["e"], got["m"], got["x"], got["p"], got["r"], got["s"], got["t"], got["g"], got["n"], got["al"]) == ("a_b_b", "NA", "*4", "*2", ["*1", "*10", "*36"], "NACGT", "*2/*10", "*10", 2, 4, True)


@pytest.mark.parametrize(("score", "band"), [(None, "Indeterminate"), (0.0, "Poor Metabolizer"), (0.1, "Unknown"), (0.25, "Intermediate Metabolizer"), (1.0, "Intermediate Metabolizer"), (1.1, "Unknown"), (2.25, "Normal Metabolizer"), (2.5, "Ultrarapid Metabolizer")])
def test_bands(spark, score, band):
    assert one(spark, S.phenotype_band(F.lit(score).cast("double")).alias("b"))["b"] == band


def test_base_likelihood(spark):
    got = one(spark, S.log10_base(F.lit(30.0), F.lit(True)).alias("m"), S.log10_base(F.lit(30.0), F.lit(False)).alias("x"))
    assert -0.01 < got["m"] <= 0 and got["x"] < -2


def test_point_in_interval(spark):
    r = random.Random(1)
    points, spans = [(k, r.randint(0, 1000)) for k in range(200)], [(k, a, a + r.randint(0, 90)) for k in range(40) for a in [r.randint(0, 1000)]]
    got = I.point_in_interval(spark.createDataFrame(points, "p int, pos int"), spark.createDataFrame(spans, "s int, a int, b int"), "pos", "a", "b", 37)
    want = {(p, s) for p, x in points for s, a, b in spans if a <= x < b}
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted(want)
    counts = I.interval_counts(spark.createDataFrame(points, "p int, pos int"), spark.createDataFrame(spans, "s int, a int, b int"), ["s"], "pos", "a", "b", 37)
    assert {r["s"]: r["n"] for r in counts.collect()} == {s: sum(a <= x < b for _, x in points) for s, a, b in spans}


READS = "sample_id string, qname string, flag int, chrom string, pos long, end_pos long, mapq int, tlen long, cigar array<struct<op:string,len:int>>, seq string, qual array<int>"


def read(q, pos, cigar, seq, flag=0, mapq=60, tlen=300):
    span = sum(n for op, n in cigar if op in "M=XDN")
    return ("s1", q, flag, "22", pos, pos + span, mapq, tlen, cigar, seq, [30] * len(seq))


def test_pileup_counts(spark):
    rows = [
        read("r1", 100, [("M", 10)], "AAAAACAAAA"), read("r1", 95, [("M", 20)], "A" * 10 + "C" + "A" * 9, flag=16), read("r2", 100, [("M", 3), ("D", 4), ("M", 5)], "AAAAAAAA"), read("r3", 100, [("S", 2), ("M", 3), ("I", 2), ("M", 6)], "TTAAATTAACAAA"),
        read("dup", 100, [("M", 10)], "AAAAACAAAA", flag=0x400), read("sec", 100, [("M", 10)], "AAAAACAAAA", flag=0x100), read("low", 100, [("M", 10)], "AAAAACAAAA", mapq=5), read("end", 100, [("M", 6)], "AAAAAT"), read("two", 100, [("M", 6)], "AAAAAC"),
    ]
    sites = spark.createDataFrame([(0, "22", 105, ["C"], ["T", "CA"])], "idx int, chrom string, pos long, alleles1 array<string>, alleles2 array<string>")
    reads = spark.createDataFrame(rows, READS)
    got = I.supporting_counts(I.allele_reads(I.site_bases(reads, sites, min_mapq=10), ["sample_id"]), ["sample_id"]).first()
    # CA fits r1 and r3 beside C; "two" ends on the C
    assert (got["n1"], got["n2"], got["n1_fwd"], got["n1_rev"]) == (3, 3, 3, 1)
    regions = spark.createDataFrame([("22", 100, 101, "here"), ("22", 500, 600, "none")], "chrom string, start long, end long, name string")
    assert {r["name"]: r["count"] for r in I.region_read_counts(reads, regions, ["sample_id"]).collect()} == {"here": 7, "none": 0}


def test_gmm(spark):
    means, priors = {2: 1.0, 3: 1.5}, {0: 0.001, 1: 0.001, 2: 0.005, 3: 0.07, 4: 0.79, 5: 0.12, 6: 0.01}
    states = P.gmm_states(0.985, means, priors, 0.056)
    values = [2.0, 3.97, 4.0, 4.5, 0.0, 30.0]
    got = [r for r in P.gmm_call(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double"), "v", states, 0.985).orderBy("k").collect()]

    def plain(v):
        x = v / 2 / 0.985
        w = [p * math.exp(-((x - m) ** 2) / (2 * sd * sd)) / sd for _, m, sd, p in states]
        k = max(range(11), key=lambda i: w[i])
        tail = 0.5 * math.erfc(abs(x - states[k][1]) / states[k][2] / math.sqrt(2))
        return k if sum(w) and w[k] / sum(w) >= 0.95 and tail >= 1e-3 else None

    assert [r["cn"] for r in got] == [plain(v) for v in values] and got[1]["depth"] == round(3.97 / 0.985, 3)


def test_poisson_posterior(spark):
    def plain(cn, n1, n2, least):
        if cn is None:
            return None
        if cn == 0:
            return (0, 1.0, None)
        if cn == 1 and n1 > least:
            return (1, 1.0, None)
        n = n1 + n2
        if n == 0:
            return None
        k = min(n1, n2)
        rate = [n * 0.1 / 3 if i == 0 else n * 0.9 if i == cn else n * i / cn for i in range(cn + 1)]
        w = [math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for x in rate]
        p = [x / sum(w) for x in w]
        p = p[::-1] if n2 < n1 else p
        order = sorted(range(cn + 1), key=lambda i: -p[i])
        if order[0] != 0 and n1 <= least and n2 >= least:
            return (0, 1.0, None)
        return (order[0], 1.0, None) if p[order[0]] >= 0.9 else (order[0], round(p[order[0]], 3), order[1])

    r = random.Random(2)
    rows = [(k, r.choice([None, 0, 1, 2, 3, 4, 6]), r.randint(0, 60), r.randint(0, 60)) for k in range(300)]
    got = P.poisson_call(spark.createDataFrame(rows, "k int, cn int, n1 long, n2 long"), "cn", "n1", "n2", 2).collect()
    for x in got:
        want, c = plain(x["cn"], x["n1"], x["n2"], 2), x["cn_call"]
        assert (c and (c["cn1"], c["cn2"])) == (want and (want[0], want[2])), x
        assert c is None or abs(c["p1"] - want[1]) < 0.0011


def test_fisher(spark):
    def plain(a, b, c, d):
        n, r, k = a + b + c + d, a + b, a + c
        p = {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, r + k - n), min(r, k) + 1)}
        return min(1.0, sum(v for v in p.values() if v <= p[a] + 1e-12))

    r = random.Random(3)
    rows = [tuple(r.randint(0, m) for _ in range(4)) for m in (3, 10, 40, 200) for _ in range(25)] + [(0, 0, 0, 0), (3, 1, 1, 3)]
    for x in P.fisher_exact(spark.createDataFrame(rows, "a int, b int, c int, d int"), "a", "b", "c", "d").collect():
        assert x["p_value"] == pytest.approx(plain(*x[:4]), abs=1e-9)
        assert x["odds_ratio"] == (pytest.approx(x["a"] * x["d"] / (x["b"] * x["c"])) if x["b"] * x["c"] else None)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    for _ in range(20):
        obs, valid = r.uniform(0, 3, 5), r.random(5) > 0.2
        got = G.best_path(obs, valid, 3, 0.3)

        def score(path):
            s = 0.0
            for t, cn in enumerate(path):
                sd = 0.15 if cn == 0 else 0.3 * math.sqrt(cn)
                s += (-0.5 * math.log(2 * math.pi * sd**2) - (obs[t] - cn) ** 2 / (2 * sd**2)) if valid[t] else 0
                s += math.log(0.995 if cn == path[t - 1] else 0.0025) if t else 0
            return s

        assert score(got) == pytest.approx(max(map(score, itertools.product(range(3), repeat=5))))
    step = G.best_path(np.r_[np.full(20, 2.0), np.full(20, 1.0)], np.ones(40, bool), 5, 0.3)
    assert set(step[:15]) == {2} and set(step[25:]) == {1}
    noisy = G.best_path(np.r_[np.full(10, 2.0), 999.0, np.full(10, 2.0)], np.r_[np.ones(10, bool), False, np.ones(10, bool)], 5, 0.3)
    assert set(noisy) == {2}


def test_segments(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([2, 2, 2, 1, 1, 1])], "k string, i int, v int")
    assert [(r["v"], r["first"], r["last"]) for r in G.islands(df, ["k"], "i", "v").orderBy("island").collect()] == [(2, 0, 2), (1, 3, 5)]
    r = np.random.default_rng(2)
    v = np.r_[r.normal(0.7, 0.03, 30), r.normal(0.3, 0.03, 25)]
    assert G.segments_of(v, np.isfinite(v), 4.0, 5) == [(0, 30), (30, 55)]
    rows = spark.createDataFrame([("s", k, float(x)) for k, x in enumerate(v)] + [("t", k, 0.5) for k in range(20)], "k string, i int, v double")
    got = G.changepoints(rows, ["k"], "i", "v").collect()
    assert sorted((x["k"], x["first"], x["last"]) for x in got) == [("s", 0, 29), ("s", 30, 54), ("t", 0, 19)]
    assert {x["k"]: x["split"] for x in G.best_split(rows, ["k"], "i", "v", 5).collect()}["s"] == 30
    cuts = rows.sparkSession.createDataFrame([("a", 0, 0.7, 30), ("a", 1, 0.3, 25), ("b", 0, 0.7, 30), ("b", 1, 0.6, 25), ("c", 0, 0.7, 30), ("c", 1, 0.3, 4), ("d", 0, None, 0)], "k string, segment int, mean double, n_valid int")
    assert {r["k"]: (r["stepped"], r["n_segments"], r["first_mean"]) for r in G.stepped(cuts, ["k"]).collect()} == {"a": (True, 2, 0.7), "b": (False, 2, 0.7), "c": (False, 2, 0.7), "d": (False, 1, 0.0)}


def test_lowess():
    x = np.linspace(0, 1, 50)
    assert np.allclose(G.smooth(x, 3 * x + 1), 3 * x + 1, atol=1e-6)
    y = 3 * x + 1
    y[10] += 100
    assert np.abs(np.delete(G.smooth(x, y) - (3 * x + 1), 10)).max() < 0.5
    assert np.allclose(G.smooth(np.zeros(10), np.arange(10.0), rounds=0), 4.5, atol=3)


def test_semi_global_distance():
    def plain(p, t, most):
        row, best = list(range(len(p) + 1)), None
        for j, c in enumerate(t):
            new = [0]
            for i, d in enumerate(p):
                new.append(min(row[i] + (d != c), row[i + 1] + 1, new[i] + 1))
            row = new
            if row[-1] <= most and (best is None or row[-1] < best[0]):
                best = (row[-1], j + 1)
        return best

    r = random.Random(4)
    for _ in range(300):
        p, t = "".join(r.choices("ACG", k=r.randint(1, 12))), "".join(r.choices("ACG", k=r.randint(0, 30)))
        assert align.best_end(p, t, 3) == plain(p, t, 3)
    long = "".join(r.choices("ACGT", k=130))
    assert align.best_end(long, "TT" + long[:60] + long[61:] + "AA", 4)[0] == 1
    assert align.best_end("AAAA", "CCCC", 1) is None


def test_local_mapping(spark):
    r = random.Random(5)
    ref = "".join(r.choices("ACGT", k=400))
    turn = str.maketrans("ACGT", "TGCA")
    queries = [(0, ref[50:90]), (1, ref[120:135] + "A" + ref[136:160]), (2, ref[200:240].translate(turn)[::-1]), (3, "".join(r.choices("ACGT", k=40)))]
    got = align.map_locally(spark.createDataFrame(queries, "q long, t string"), "q", "t", spark.createDataFrame([(7, ref)], "r long, s string"), "r", "s", 8, 2).collect()
    found = {(x["q"], x["strand"], x["end"]) for x in got}
    assert {(0, "+", 90), (1, "+", 160), (2, "-", 240)} <= found and not any(x["q"] == 3 for x in got)


ITEMS = [(0, "*1", []), (1, "*2", ["a", "b"]), (2, "*3", ["a"]), (3, "*4.1", ["b"]), (4, "*34", ["a", "b"]), (5, "*4", ["c"])]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "ord int, name string, parts array<string>")


def combos(pattern):
    out = {}
    for m, n, ordered in pattern:
        for (i, a, p), (j, b, q) in itertools.product(ITEMS, ITEMS):
            if not ordered or i <= j:
                key = "_".join(sorted(p * m + q * n)) or "NA"
                out.setdefault(key, set()).add("_".join(sorted([a] * m + [b] * n)))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("pattern", [[(1, 1, True)], [(1, 2, False)], [(2, 2, True), (1, 3, False)]])
def test_dictionaries(items, pattern):
    assert {r["key"]: r["candidates"] for r in M.pair_dictionary(items, pattern).collect()} == combos(pattern)


def test_single_and_triple_dictionary(spark, items):
    assert {r["key"]: r["candidates"] for r in M.single_dictionary(items).collect()} == {"NA": ["*1"], "a_b": ["*2"], "a": ["*3"], "b": ["*4.1"], "c": ["*4"]}
    seen = [("s", ["a", "b", "c"]), ("t", ["a", "a", "a"]), ("u", ["z"]), ("v", [])]
    got = {r["s"]: r["candidates"] for r in M.triple_matches(spark.createDataFrame(seen, "s string, names array<string>"), items, ["s"]).collect()}
    want = {}
    for s, names in seen:
        for x in itertools.combinations_with_replacement(ITEMS, 3):
            if sorted(v for _, _, p in x for v in p) == sorted(names):
                want.setdefault(s, set()).add("_".join(sorted(n for _, n, _ in x)))
    assert got == {k: sorted(v) for k, v in want.items()}


def test_match_classes(spark, items):
    rows = spark.createDataFrame([("u", ["c", "c"]), ("r", ["a", "b"]), ("n", ["q"])], "s string, names array<string>")
    got = {r["s"]: (r["call_info"], r["star_call"]) for r in M.exact_match(rows, M.pair_dictionary(items, [(1, 1, True)]), "names").collect()}
    assert got == {"u": ("unique_match", ["*4_*4"]), "r": ("more_than_one_match", ["*1_*2", "*3_*4"]), "n": ("no_match", [])}
    both = spark.createDataFrame([("k", ["*4_*4.013", "*4.1_*4"]), ("l", ["*1_*2", "*34_*5"])], "s string, candidates array<string>")
    assert {r["s"]: (r["call_info"], r["star_call"]) for r in M.classify(both).collect()} == {"k": ("unique_star", ["*4_*4"]), "l": ("pick_common_allele", ["*1_*2"])}


def test_fuzzy(spark, items):
    tables = M.pair_dictionary(items, [(1, 1, True)])
    r = random.Random(6)
    rows = [(str(k), r.choices("abcd", k=r.randint(0, 5))) for k in range(40)]

    def score(o, c):
        both = sum((Counter(o) & Counter(c)).values())
        return both - 0.5 * (len(c) - both) - 0.3 * (len(o) - both) if len(c) - both <= 2 and len(o) - both <= 2 else -9

    want = {}
    for s, o in rows:
        best = max(((round(score(o, k.split("_")), 6), k) for k in combos([(1, 1, True)]) if k != "NA"), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
        if best[0] >= 1:
            want[s] = best[::-1]
    assert {r["s"]: (r["key"], r["score"]) for r in M.fuzzy_match(spark.createDataFrame(rows, "s string, names array<string>"), tables, ["s"], "names").collect()} == want


def test_knn(spark):
    train = spark.createDataFrame([(k, [float(k)], k // 5) for k in range(20)], "id int, t array<double>, label int")
    got = M.nearest(spark.createDataFrame([(0, [1.0]), (1, [17.0])], "q int, v array<double>"), "q", "v", train, "t", "label", "id").collect()
    assert {x["q"]: (x["label"], x["confidence"]) for x in got} == {0: (0, 1.0), 1: (3, 1.0)}


def test_knn_searches_the_whole_table(spark, tmp_path):
    from paraloom.plans import match_queries

    r = random.Random(6)
    rows = [(k, [float(r.randint(0, 3)) for _ in range(3)], r.randint(0, 3)) for k in range(150)]
    want = {}
    for q, v, _ in rows:
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(v, t, strict=True)) ** 0.5, 6), o, label) for o, t, label in rows)[:5]
        n = Counter(label for *_, label in near)
        want[q] = (min(c for c in n if n[c] == max(n.values())), max(n.values()) / 5)
    e = spark.createDataFrame([*rows, (200, None, 1), (201, [9.0] * 3, None)], "vec_id long, embedding array<float>, label int")
    for block in (4096, 40):
        got = M.nearest(e.where("vec_id < 200"), "vec_id", "embedding", e.withColumnRenamed("embedding", "t"), "t", "label", "vec_id", block=block)
        assert {x["vec_id"]: (x["label"], x["confidence"]) for x in got.collect()} == want
    e.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {x["vec_id"]: (x["label"], x["confidence"]) for x in match_queries.j16_knn(spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in want.items() if k % 100 == 0}


def test_kmer_join_takes_all_windows_of_all_items(spark, tmp_path):
    from paraloom.plans import match_queries

    r = random.Random(9)
    items = [(k, "".join(r.choices("abcé ", k=60))) for k in range(8)]
    items += [(8, items[0][1]), (9, items[1][1][:12] + "other end of it"), (10, "short"), (11, None), (12, "z" * 30)]
    docs = [(k, f"x{items[k][1][20:50]}y{items[k][1][20:40]}") for k in range(8)] + [(20, "z" * 20), (21, None), (22, ""), (None, items[2][1]), (23, "no hit at all, none")]
    grams = lambda t: [t[i : i + 12] for i in range(len(t or "") - 11)]
    want = {(q, o): n for q, t in docs for o, u in items if (n := sum(w in set(grams(u)) for w in grams(t)))}
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    for most in (500_000, 3):
        got = M.shared_kmers(docs, ["doc_id"], "text", items, "item_id", "text", 12, panel_kmers=most)
        assert {(x["doc_id"], x["item_id"]): x["n"] for x in got.collect()} == want
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {(x["doc_id"], x["item_id"]): x["n"] for x in match_queries.j12_kmer_join(spark, str(tmp_path)).collect()} == want


# ---- decisions ----


def events(e9, mid, far, up):
    n = Counter()
    n["star13intron1"] += max(far - up, 0) + max(mid - far, 0)
    n["star68"] += max(up - far, 0)
    n["star13"] += max(e9 - mid, 0)
    n["exon9hyb"] += max(mid - e9, 0)
    n["star5"] += max(2 - e9, 0)
    n["dup"] += max(e9 - 2, 0)
    return sorted(n.elements())


def tag_of(e9, mid, far, up):
    e = events(e9, mid, far, up)
    gain = sum(x in C.GAINS for x in e) - sum(x in C.LOSSES for x in e)
    if e and 2 + gain == up:
        whole = "_".join(e)
        for a, b in (("exon9hyb", "star5"), ("dup", "star13")):
            while whole != f"{min(a, b)}_{max(a, b)}" and a in e and b in e:
                e.remove(a)
                e.remove(b)
        if e and set(e) == {"dup"}:
            return f"cn{len(e) + 2}"
        return "cn4" if whole == "dup_dup_exon9hyb_star13intron1" else "_".join(e)
    return "cn2" if (mid, far, up) == (2, 2, 2) else None


def test_structural_tags(spark):
    rows = [(*x, x[3] + 2) for x in itertools.product(range(5), repeat=4)]
    got = C.structural_tag(spark.createDataFrame(rows, "exon9 int, exon9_intron4 int, intron4_intron1 int, intron1_up int, total_cn int")).collect()
    assert all(r["tag"] == tag_of(*r[:4]) for r in got)
    for tag, total, e9, mid, up in C.TAG_COPIES:
        if "star68" not in tag and "star13" not in tag and "_star5" not in tag:
            assert tag_of(e9, mid, mid, up) == tag and total == up + 2


@pytest.mark.parametrize(
    ("forms", "tag", "spacer", "want"),
    [
        (["*1_*2", "*3_*4"], "cn2", 2, "*1/*2;*3/*4"), ([], "cn3", 3, ""), (["*10_*10_*4.013", "*10_*36_*4"], "exon9hyb", 2, "*4/*36+*10"), (["*4"], "star5_star68", 1, "*5/*68+*4"), (["*2"], "star5_star68", 1, "*68/*2"),
        (["*4"], "star13_star68", 1, "*13/*68+*4"), (["*2"], "star13_star68", 1, "*13_*2_*68"), (["*1_*2"], "cn2", 2, "*1/*2"), (["*2_*41"], "star13intron1", 2, "*13/*41"), (["*1_*41"], "star13intron1", 2, None),
        (["*1_*2_*2"], "dup_star13intron1", 3, "*13+*2/*1"), (["*1_*1_*1"], "dup_star13intron1", 3, "*13+*1/*1"), (["*1_*2_*3"], "dup_star13intron1", 3, None), (["*1_*2"], "dup_star13", 1, "*1_*2_*13"), (["*1_*2"], "dup_star13", 2, "*1/*2"),
        (["*1"], "star5", 1, "*1/*5"), (["*1"], "star13", 1, "*1/*13"), (["*1_*2_*2"], "cn3", 3, "*1/*2x2"), (["*1_*1_*1"], "cn3", 3, "*1/*1x2"), (["*1_*1_*1_*1"], "cn4", 4, "*1x2/*1x2"), (["*1_*1_*1_*1_*1"], "cn5", 5, "*1x2/*1x3"),
        (["*1_*1_*1_*1_*1_*1"], "cn6", 6, "*1x3/*1x3"), (["*1_*2_*3"], "cn3", 3, "*1_*2_*3"), (["*10_*10"], "exon9hyb_star5", 3, "*5/*36+*10"), (["*10_*10"], "exon9hyb_star5", 2, None), (["*4_*4"], "exon9hyb_star5", 3, "*5/*4.013+*4"),
        (["*1_*10"], "exon9hyb_star5", 2, "*1/*10"), (["*1_*10_*36"], "exon9hyb", 2, "*1/*36+*10"), (["*10_*36_*36"], "exon9hyb", 2, "*36/*36+*10;*10/*36x2"), (["*1_*36_*36"], "exon9hyb", 2, "*36x2/*1"), (["*1_*2_*10_*36"], "dup_exon9hyb", 3, "*1+*2/*36+*10"),
        (["*1_*1_*10_*36"], "dup_exon9hyb", 3, "*1x2/*36+*10"), (["*10_*10_*10_*36"], "dup_exon9hyb", 3, "*10x2/*36+*10"), (["*10_*10_*36_*36"], "exon9hyb_exon9hyb", 5, "*5/*36x2+*10x2"), (["*10_*10_*36_*36"], "exon9hyb_exon9hyb", 4, "*36+*10/*36+*10"),
        (["*10_*36_*36_*36"], "exon9hyb_exon9hyb", 4, "*36+*10/*36x2"), (["*1_*10_*36_*36"], "exon9hyb_exon9hyb", 4, "*1/*36+*36+*10"), (["*1_*10_*36_*36_*83"], "exon9hyb_exon9hyb_exon9hyb", 4, "*1/*36x2+*83+*10"), (["*4_*4"], "star68", 2, "*4/*68+*4"),
        (["*1_*4"], "star68_star68", 2, "*1/*68+*68+*4"), (["*1_*45"], "star68", 2, "*1/*68+*45"), (["*1_*2"], "star68", 2, "*1_*2_*68"), (["*1_*1_*4"], "dup_star68", 3, "*1x2/*68+*4"), (["*4_*4_*4"], "dup_star68", 3, "*4x2/*68+*4"),
    ],
)
def test_spelling(forms, tag, spacer, want):
    assert C.spell_call(forms, tag, spacer) == want


def test_repair(spark):
    cases = [
        (["g.42129809T>C"], "cn2", ["g.42129809T>C", "g.42129819G>T"]), (["g.42126611C>G", "x"], "star13", ["x"]), (["g.42126611C>G"], "star13intron1", ["g.42126611C>G"]), (["NA"], "cn2", []),
        (["g.42130692G>A"], "exon9hyb", ["exon9gc", "g.42126611C>G", "g.42130692G>A", "g.42130692G>A"]), (["g.42127565T>C", "g.42127565T>C"], "cn2", ["g.42127556T>C"] * 2 + ["g.42127565T>C"] * 2),
    ]
    rows = spark.createDataFrame([(k, a, t) for k, (a, t, _) in enumerate(cases)], "k int, names array<string>, tag string")
    got = {r["k"]: r["r"] for r in rows.select("k", C.repair_variants(F.col("names"), F.col("tag")).alias("r")).collect()}
    assert got == {k: sorted(w) for k, (_, _, w) in enumerate(cases)}


def test_filters(spark):
    rows = spark.createDataFrame([(0, None, False, False), (1, "*1/*2;*3/*4", True, True), (2, "*1", True, True), (3, "*1/*2", True, True), (4, "*1/*2", False, True), (5, "*1/*2", False, False)], "k int, g string, h boolean, f boolean")
    got = [r["x"] for r in rows.orderBy("k").select(C.call_filter(F.col("g"), F.col("h"), F.col("f")).alias("x")).collect()]
    assert got == [None, "More_than_one_possible_genotype", "Not_assigned_to_haplotypes", "LowQ_high_CN", "Fuzzy_match", "PASS"]
    off = one(spark, C.spacer_filter(F.lit("PASS"), F.lit("cn3"), F.lit(5), F.lit(3)).alias("a"), C.spacer_filter(F.lit("PASS"), F.lit("cn3"), F.lit(5), F.lit(2)).alias("b"), C.spacer_filter(F.lit("PASS"), F.lit("star13"), F.lit(5), F.lit(3)).alias("c"))
    assert tuple(off) == ("Spacer_CN_inconsistent", "PASS", "PASS")


def test_expected_copies(spark):
    rows = spark.createDataFrame([(42126611, "exon9hyb"), (42126612, "exon9hyb"), (42130500, "star68"), (1, "nothing")], "pos long, tag string")
    assert sorted((r["pos"], r["expected"]) for r in C.expected_copies(rows, "pos", "tag").collect()) == [(1, None), (42126611, 2), (42126612, 3), (42130500, 3)]


def test_phasing(spark):
    rows = spark.createDataFrame([("s", "f1", "a", True), ("s", "f1", "b", True), ("s", "f2", "a", True), ("s", "f2", "b", False), ("s", "f3", "a", True), ("s", "f4", "a", False), ("s", "f4", "b", False)], "s string, q string, site string, alt boolean")
    assert {r["pattern"]: r["n"] for r in R.phasing_modes(rows, ["s"], "q", "site", "alt").collect()} == {"a:1,b:1": 1, "a:1,b:0": 1, "a:0,b:0": 1}
    got = R.cis_trans(rows, ["s"], "q", "site", "alt", "a", "b").first()
    assert (got["cis"], got["trans"]) == (1, 1)
    won = R.phase_winner(spark.createDataFrame([("s", "x", 9), ("s", "y", 3), ("t", "x", 5), ("t", "y", 2)], "s string, d string, n int"), ["s"], "d", "n").collect()
    assert [tuple(r) for r in won] == [("s", "x")]


def test_paralog_mixture(spark):
    r = np.random.default_rng(7)
    ll, other, cn = r.uniform(-8, 0, (30, 3)), r.uniform(-8, 0, 30), 3
    rows = spark.createDataFrame(pd.DataFrame([("s", i, j, ll[i, j], other[i], cn) for i in range(30) for j in range(3)], columns=["s", "read", "item", "v", "o", "cn"]))
    got = {(x["a"], x["b"]): x["total"] for x in R.paralog_mixture(rows, ["s"], "read", "item", "v", "o", "cn").collect()}
    for a in range(3):
        for b in range(a, 3):
            splits = [cn] if a == b else range(1, cn)
            want = max(sum(math.log((math.exp(other[i]) + k * math.exp(ll[i, a]) + (cn - k) * math.exp(ll[i, b])) / (cn + 1)) for i in range(30)) for k in splits)
            assert got[a, b] == pytest.approx(want)


def test_local_mapping_deals_queries_before_their_seeds(spark, monkeypatch):
    """Many queries of one file are dealt into tasks, and no task adds up the hits of all; equal texts map alike."""
    r = random.Random(6)
    refs = spark.createDataFrame([(k, "".join(r.choices("ACGT", k=200))) for k in range(3)] + [(9, None)], "r long, s string")
    texts = [row["s"][at : at + 30] for row in refs.where("s is not null").collect() for at in (0, 50, 110, 170)]
    queries = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(240)] + [(900, None), (901, "AC")], "q long, t string").coalesce(1)
    mapped = lambda n: align.map_locally(queries, "q", "t", refs, "r", "s", 8, 2, task_chars=n)
    plan = mapped(1000)._jdf.queryExecution().executedPlan().toString()
    before_hits = plan[plan.index("partial_min") :].splitlines()
    dealt = next(k for k, line in enumerate(before_hits) if "Exchange hashpartitioning" in line)
    assert "REPARTITION_BY_NUM" in before_hits[dealt]
    by_task = mapped(1000).select(F.spark_partition_id().alias("p"), "q").distinct().groupBy("p").count().collect()
    assert len(by_task) > 10 and max(x["count"] for x in by_task) < 60
    rows = sorted(map(tuple, mapped(1000).collect()))
    assert {x[0] for x in rows if x[4] == 0} == set(range(240))
    by_text = [sorted(x[1:] for x in rows if x[0] == k) for k in range(240)]
    assert all(by_text[k] == by_text[k % len(texts)] for k in range(240))
    assert sorted(map(tuple, mapped(1 << 30).collect())) == rows
    monkeypatch.setattr(align, "FEW_CHARS", 0)
    assert sorted(map(tuple, mapped(1000).collect())) == rows
