"""Each operator against plain Python on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from paraloom.llm import embedding_dedup, html_text, language_id, line_dedup, mixing, packing, quality, registry, simhash, token_files, tokens, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(300)]
    out = [" ".join(r.choices(words, k=r.randint(1, 90))) for _ in range(n)]
    common = " ".join(r.choices(words, k=12))
    out = [f"{t}\n {common.upper() if k % 2 else common}\t\n{t[:50]}" if k % 4 == 0 else t for k, t in enumerate(out)]
    return [None, "", "   ", "\n\n", "One", out[0], out[0], *out, " ".join(r.choices(words, k=20_000))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 9 else None, t, ["en", "fr", None][k % 3], ["a", "b", "B", None][k % 4], len(t or "")) for k, t in enumerate(texts())]
    rows += [rows[12], rows[12]]
    return rows


def frame(spark, rows, **extra):
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def unions(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


# ---- line dedup ----


def brute_lines(rows, min_chars, min_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(d)
    keeper = {k: max((d for d in v if d is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("extra", [{}, {"key": 1, "id": 2, "pos": 3, "row": 4, "line_dedup": 5, "h1": 6}])
def test_line_dedup(spark, docs, extra):
    from pyspark.sql import functions as F

    out = line_dedup.dedup_lines(frame(spark, docs, **extra), min_chars=20, min_docs=3)
    got = out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("line_dedup.text").cast("binary"), 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_lines(docs, 20, 3)
    assert sum(r[2] for r in brute_lines(docs, 20, 3)) > 5
    assert line_dedup.dedup_lines(frame(spark, []), min_chars=20).count() == 0


# ---- SimHash ----


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate(LOW))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in texts(3, 20):
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint("Éa B", 3) == brute_fingerprint("Éa B")


def test_ring_finds_every_pair():
    r = random.Random(5)
    fps = [r.getrandbits(64) for _ in range(40)]
    fps += [f ^ 1 << r.randrange(64) ^ (1 << r.randrange(64) if k % 2 else 0) for k, f in enumerate(fps)] + [fps[0] ^ 0b111]
    fps = np.array(sorted(set(fps)), dtype=np.uint64)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= 2}
    found = set()
    for start in range(simhash.SEGMENTS):
        a, b = simhash.linked_pairs(fps, start, 2, simhash.SEGMENTS)
        found |= set(zip(a.tolist(), b.tolist(), strict=True))
    assert want and found == want


@pytest.mark.parametrize("group", [512, 3])
def test_simhash(spark, docs, group, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", group)
    r = random.Random(6)
    base = " ".join(r.choices(["ab", "cd", "efg", "hi"], k=400)).split(" ")
    near = [(1000 + k, " ".join(base[:k] + ["zz"] + base[k + 1 :]), "en", "a", 0) for k in range(0, 60, 2)]
    rows = docs + near
    got = simhash.dedup(frame(spark, rows, fp=1, a=2)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    root, least = unions(len(rows), pairs), {}
    for (d, *_), x in zip(rows, root, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    want = sorted(((d, f, least.get(x)) for (d, *_), f, x in zip(rows, fps, root, strict=True)), key=repr)
    assert sorted(((g["doc_id"], g["fp"] % (1 << 64), g["component_id"]) for g in got), key=repr) == want
    assert len(set(fps)) < len(fps) and len(pairs) > 20
    assert simhash.dedup(frame(spark, [])).count() == 0


def brute_near(texts):
    """Pairs of texts whose sets of five-word shingles are similar to four fifths; texts without words are alike."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").translate(LOW).split()) else {"none"} for t in texts]
    return [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def test_simhash_splits_a_large_group(spark):
    # fingerprints that share their first 26 bits, or all but the last few
    r = random.Random(2)
    fps = sorted({0xABCDEF << 40 | r.getrandbits(34) for _ in range(300)} | {0x123456789ABC << 16 | k for k in range(400)} | {0xABCDEF << 40 | 7 << k for k in range(30)})
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = unions(len(fps), pairs)
    for group in (4, 100_000):
        place = {x: k for k, x in enumerate(fps)}
        edges = [(place[e["a"] % (1 << 64)], place[e["b"] % (1 << 64)]) for e in simhash.linked_edges(nodes, group=group).collect()]
        assert set(map(tuple, map(sorted, edges))) <= set(map(tuple, map(sorted, pairs))) and unions(len(fps), edges) == want


@pytest.mark.parametrize("part", [3, 4096])
def test_simhash_stage_takes_five_words_and_four_fifths(spark, part, monkeypatch):
    monkeypatch.setattr(simhash.near_edges, "__defaults__", ("doc_id", "text", part, 0 if part == 3 else 10, 2000 if part == 3 else simhash.PART_BYTES))
    monkeypatch.setattr(simhash.star_links, "__defaults__", (2 if part == 3 else 1024,))
    r, rows = random.Random(8), []
    words = ["".join(r.choices("abcdefgh", k=6)) for _ in range(4000)]
    for k in range(40):
        base = r.choices(words, k=80)
        rows.append(" ".join(base))
        for m in range(k % 4):
            copy = list(base)
            for at in r.sample(range(80), 1 + m):
                copy[at] = "zz"
            rows.append(" ".join(copy))
    base = r.choices(words, k=200)
    rows += [" ".join([*base[:k], f"w{k}", *base[k + 1 :]]) for k in range(0, 60, 3)] + [None, "", "a b", "A  b", "a b c"]
    rows = [(k, t, None, None, 0) for k, t in enumerate(rows)]
    near = brute_near([t for _, t, *_ in rows])
    fps = [brute_fingerprint(t or "") for _, t, *_ in rows]
    close = [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    root = unions(len(rows), near + close)
    only_close = unions(len(rows), close)
    want = [k for k in range(len(rows)) if root[k] == k]
    assert sorted(x["doc_id"] for x in simhash.stage(spark, frame(spark, rows), "").collect()) == want
    assert len(want) < len([k for k in range(len(rows)) if only_close[k] == k])


def test_simhash_stage_keeps_one(spark, docs):
    rows = frame(spark, docs)
    groups = simhash.dedup(rows).where("doc_id is not null").select("component_id").distinct().count()
    out = simhash.stage(spark, rows, "")
    assert out.columns == rows.columns and out.where("doc_id is not null").count() == groups and out.where("doc_id is null").count() == 1


# ---- embeddings ----


@pytest.mark.parametrize("block", [1024, 7])
def test_embedding_dedup(spark, block):
    r = np.random.default_rng(3)
    base = r.normal(size=(40, 16))
    vectors = [v + r.normal(size=16) * s for v in base for s in (0.0, 0.05, 0.12, 0.3)]
    rows = [(k, v.tolist(), k % 3) for k, v in enumerate(vectors)] + [(500 + k, vectors[k].tolist(), k % 3) for k in range(20)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [None] + [1.0] * 15, 1), (604, vectors[0].tolist(), None), (None, vectors[0].tolist(), 0), (605, [], 1), (606, [1.0, 2.0], 1)]
    rows += [(607, (vectors[0] * 3).tolist(), 0), (608, [1e300] * 16, 2), (609, [2e300] * 16, 2), (610, [-0.0] + [1.0] * 15, 2), (611, [0.0] + [1.0] * 15, 2), (rows[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    out = [tuple(x) for x in embedding_dedup.dedup(df, block=block).collect()]
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in ok}
    unit = {k: v / np.linalg.norm(v) for k, v in unit.items()}
    pairs = [(a, b) for a in ok for b in ok if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and unit[a] @ unit[b] >= embedding_dedup.COSINE]
    links = Counter(x for p in pairs for x in p)
    root, least = unions(len(rows), pairs), {}
    for k, x in enumerate(root):
        if rows[k][0] is not None:
            least[x] = min(rows[k][0], least.get(x, rows[k][0]))
    want = [(rows[k][0], links[k], least.get(root[k]), rows[k][0] == least.get(root[k])) for k in range(len(rows))]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert len(pairs) > 50 and not got
    assert embedding_dedup.dedup(df.limit(0)).count() == 0


def test_quantisation_bound():
    r = np.random.default_rng(1)
    u = embedding_dedup.unit(r.normal(size=(200, 24)))
    q, s, e = embedding_dedup.quantise(u)
    exact = u @ u.T
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(exact - near) <= e[:, None] + (1 + e[:, None]) * e).all()


def test_embedding_pairs_between_the_bounds(spark):
    # vectors about the threshold apart, long ones, and columns with the operator's own names
    r = np.random.default_rng(7)
    rows = []
    for dim in (8, 2000):
        a = embedding_dedup.unit(r.normal(size=(30, dim)))
        b = r.normal(size=(30, dim))
        b = embedding_dedup.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
        for k, c in enumerate(np.r_[np.linspace(0.925, 0.935, 28), 0.5, 0.9999]):
            rows += [(len(rows) + j, v.tolist(), dim * 100 + k, "x", 1, 2.0) for j, v in enumerate((a[k], c * a[k] + np.sqrt(1 - c * c) * b[k]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, class string, links int, v double")
    got = {x["vec_id"]: x["n_links"] for x in embedding_dedup.dedup(df).collect()}
    exact = {k: float(np.dot(rows[k][1], rows[k + 1][1]) / (np.linalg.norm(rows[k][1]) * np.linalg.norm(rows[k + 1][1]))) for k in range(0, len(rows), 2)}
    assert all(abs(x - 0.93) > 1e-12 for x in exact.values())
    assert got == {k + j: int(x >= 0.93) for k, x in exact.items() for j in (0, 1)} and 20 < sum(got.values()) < 100
    codes = [embedding_dedup.quantise(np.array([rows[k][1]])) for k in range(0, 60)]
    left, right = (tuple(np.concatenate([c[n] for c in codes[j::2]]) for n in range(3)) for j in (0, 1))
    i, j, sure = embedding_dedup.tile_links(left, right, 0.93, False)
    assert (~sure & (i == j)).sum() > 5 and (sure & (i == j)).sum() > 0


# ---- URL filter ----


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://EXAMPLE.org", "http://example.org/", "http://a.example.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/9", "http://com/de/",
        "http://notexample.org/es/1", "http://xcom/fr/1", "ftp://h.net?q=://z/", "http://u@H.co.uk:80/fr/#://", "a://b://c/d", "http://È.com/de/ü\n/1",
    ]
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(urls)], "page_id long, url string, host int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["url_filter"] for r in url_filter.judge(pages, labels).collect()}
    for k, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = host.translate(LOW)
        fits = [(len(r), r, v) for r, v in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == (host, path, best[1], best[2]), u
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_reputation_blocks_bad_hosts(spark):
    pages = [(k, f"http://{h}.good.net/en/{k}") for k, h in enumerate(["bad"] * 60 + ["fine"] * 60 + ["few"] * 2)]
    pages += [(k + 500, f"http://h{k % 7}.other.net/en/{k + 500}") for k in range(70)]
    labels = [(k, 0 if h == "bad" else 1, None) for k, h in enumerate(["bad"] * 60 + ["fine"] * 60)] + [(k + 500, k % 9 and 1, 0) for k in range(70)] + [(None, 0, 0), (900, None, None)]
    out = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdicts = {(r["url_filter"]["host"], r["url_filter"]["verdict"]) for r in out.collect()}
    assert ("bad.good.net", "block") in verdicts and {v for h, v in verdicts if h != "bad.good.net"} == {"allow"}


def test_rules_of_one_length(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.org", "/ab1"), ("b.org", "/ab"), ("x.a.org", "/c")], "host string, path string")
    rule, verdict = url_filter.longest_rule(F.col("host"), F.col("path"), (("a.org/", "allow"), ("org/ab", "block")))
    assert [tuple(r) for r in df.select(rule, verdict).collect()] == [("org/ab", "block"), ("org/ab", "block"), ("a.org/", "allow")]


def test_links_at_the_threshold(spark):
    # cosines of exactly 0.6 in double precision link at 0.6, in every tile, and no pair leaves its tile
    rows = [(k, [3.0, 4.0, 0.0] if k % 2 else [5.0, 0.0, 0.0], 0) for k in range(6)] + [(10 + k, [3.0, 4.0, float(k + 1)], 0) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)
    links = [(a, b) for a in range(len(rows)) for b in range(len(rows)) if a != b and cos(rows[a][1], rows[b][1]) >= 0.6]
    root = unions(len(rows), links)
    for block in (2, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.dedup(df, threshold=0.6, block=block).collect()}
        assert got == {rows[k][0]: (sum(a == k for a, _ in links), rows[root[k]][0]) for k in range(len(rows))}


# ---- mixing ----


def brute_targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w, budget, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = (budget - sum(most * sizes[s] for s in capped)) / max(1, sum(w[s] for s in free))
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize(("shard", "group"), [(mixing.SHARD, mixing.GROUP), (700, 4096), (700, 3)])
def test_mixing(spark, docs, shard, group):
    rows = docs + [(2000 + k, "w " * (k * 7), "en", ["c", "d", None][k % 3], 0) for k in range(90)] + [(5000, None, None, "empty", 0)]
    df = frame(spark, rows, size=1, taken=2, shard=3)
    got = mixing.mix(df, shard_words=shard, group=group).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["doc_id"] is not None) == sorted((d, len(WORD.findall(t or ""))) for d, t, *_ in rows if d is not None)
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.05 * t, 3 * mixing.BLOCK_WORDS), (s, taken[s], t)
    assert sorted(map(tuple, mixing.mix(df.repartition(7), shard_words=shard, group=group).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, None, None, None)])).collect()] == [0]


def brute_seats(weights, seats, caps):
    want = Counter()
    for _ in range(seats):
        free = [k for k in range(len(weights)) if weights[k] > 0 and (caps is None or want[k] < caps[k])]
        if not free:
            break
        want[max(free, key=lambda k: (Fraction(float(weights[k])) / (2 * want[k] + 1), -k))] += 1
    return [want[k] for k in range(len(weights))]


def test_apportion_is_sainte_lague(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    weights = [r.randint(1, 1000) for _ in range(9)]
    rows = [(g, k, w, s, 1 + k) for g, s in enumerate((0, 5, 17, 101)) for k, w in enumerate(weights)]
    df = spark.createDataFrame(rows, "g int, p int, weight long, seats long, cap long").withColumn("__tie", F.col("p"))
    for cap in (None, "cap"):
        got = {(x["g"], x["p"]): x["quota"] for x in mixing.apportion(df, ["g"], "weight", "seats", cap).collect()}
        assert [got[g, k] for g in range(4) for k in range(9)] == [q for s in (0, 5, 17, 101) for q in brute_seats(weights, s, cap and range(1, 10))]


def test_highest_quotients():
    r = random.Random(5)
    cases = [([100, *[0.49] * 200], 198, None), ([100, 10, 10, 10], 100, [20, 40, 40, 40]), ([0, 0], 5, None), ([3, 3, 3], 7, [1, 1, 1]), ([1.0] * 50, 33, None), ([0, 5], 3, [9, 2])]
    for _ in range(60):
        weights = [r.paretovariate(0.7) for _ in range(r.randint(1, 60))]
        cases.append((weights, r.randint(0, 300), None if r.random() < 0.4 else [r.randint(0, 12) for _ in weights]))
        cases.append(([r.randint(1, 4) for _ in range(r.randint(2, 40))], r.randint(1, 200), None))  # ties
    for weights, seats, caps in cases:
        got = mixing.highest_quotients(np.array(weights, dtype=float), seats, None if caps is None else np.array(caps, dtype=np.int64), np.arange(len(weights)))
        assert got.tolist() == brute_seats(weights, seats, caps), (weights, seats, caps)
    # many seats: the totals are right and the divisor does the work
    got = mixing.highest_quotients(np.array([1.0, 2.0, 1e9]), 10**12, None, np.arange(3))
    assert got.sum() == 10**12 and got.tolist()[:2] == [1000, 2000]


#: Columns and types that the contracts name; more may follow.
CONTRACTS = {
    "op1_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op2_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op4_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op5_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op6_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op9_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op10_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op13_filter_audit": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_schemas_are_the_contracts(spark, tmp_path, name):
    made = {
        "documents": frame(spark, [(1, "one two three four five\nsix", "en", "a", 27), (2, "un deux trois", "fr", None, 13), (3, None, None, None, None)]),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"),
        "pages": spark.createDataFrame([(1, "http://a.b/c", "<p>x</p>"), (2, None, None)], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(k, [float(k), 1.0, 2.0, 3.0], k % 2) for k in range(4)], "vec_id long, embedding array<float>, label int"),
    }
    for table, df in made.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    found = registry.QUERIES[name](spark, str(tmp_path)).dtypes
    want = [tuple(x.rsplit(" ", 1)) for x in CONTRACTS[name].split(", ")]
    assert [x for x in found if x[0] in dict(want)] == want


def test_mixing_sizes_and_targets_by_sql(spark, docs, tmp_path):
    import duckdb

    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.query(spark, str(tmp_path)).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD.pattern}')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
levels AS (SELECT source, n, w, (1.5 * sum(n) OVER () - coalesce(sum(2 * n) OVER before, 0)) / sum(w) OVER (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW before AS (ORDER BY 2 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, n, least(2 * n, w * (SELECT min(level) FROM levels WHERE level * w < 2 * n)) AS target FROM levels)
SELECT doc_id, size, n, target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source""").fetchall()
    key = lambda x: (x[0] is None, x[0], x[1], x[2])
    for a, b in zip(sorted([tuple(r)[:4] for r in got], key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)


@pytest.mark.parametrize(("shard", "rows"), [(mixing.SHARD, mixing.BROADCAST_ROWS), (500, 0)])
def test_mixing_stage(spark, shard, rows):
    r = random.Random(3)
    kept = [(k if k % 50 else None, "".join(f"w{k}_{i}" + r.choice([" ", "\n", " \t "]) for i in range(k % 40)) or None, "en", ["a", "b", "b", None][k % 4], 0) for k in range(200)]
    df = frame(spark, kept, shard=7, h="x", edge="y")
    plan = mixing.mix(df, shard_words=shard).collect()
    taken = sorted((r["taken"], r["size"]) for r in plan if r["taken"])
    out = mixing.stage(spark, df, "", shard_words=shard, broadcast_rows=rows)
    assert out.columns == df.columns
    whole, cut_short = {t: [n, 0] for _, t, *_ in kept for n in [len((t or "").split())] if t}, 0
    for x in out.collect():
        assert x["n_chars"] == len(x["text"]) and (x["shard"], x["h"], x["edge"]) == (7, "x", "y")
        # whole, or the beginning of a text as it stands, cut behind a word
        own = next(t for t in whole if t.startswith(x["text"]) and len(t) - len(x["text"]) in (0, *range(1, 10**6)) and t.split()[0] == x["text"].split()[0])
        cut_short += own != x["text"]
        assert own == x["text"] or (x["text"] == x["text"].rstrip() and own[len(x["text"])].isspace())
        whole[own][1] += len(x["text"].split())
    assert sorted((n, size) for size, n in whole.values() if n) == taken
    assert cut_short <= len({(r["source"], r["shard"]) for r in plan})
    assert mixing.stage(spark, frame(spark, []), "").count() == 0


# ---- language ID ----


def sample_words(r, syllables, n):
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(n))


def test_language_id(spark):
    r, kinds = random.Random(4), {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ver", "ei"], "zz": ["ção", "lh", "nho", "os"]}
    rows = [(k, sample_words(r, kinds[x], r.randint(5, 200)).capitalize() + " ### 12", x, "s", 0) for k in range(300) for x in [list(kinds)[k % 3]]]
    rows += [(900, None, "xx", "s", 0), (901, "", "xx", "s", 0), (902, "12 ## \n", "yy", "s", 0), (903, "kato " * 30_000, None, "s", 0), (None, rows[0][1], "xx", "s", 0), rows[5], rows[5]]
    df = frame(spark, rows, language=1, key=2)
    samples = language_id.training_sample(df)
    assert [x for x, _ in samples] == sorted(kinds)
    out = language_id.predict(df, samples).collect()
    assert len(out) == len(rows)
    by_id = {x["doc_id"]: x["language"] for x in out}
    assert all(by_id[k]["lang"] == x and 0 < by_id[k]["score"] <= 1 for k, _, x, *_ in rows[:300])
    assert [(by_id[k]["lang"], by_id[k]["score"]) for k in (900, 901, 902)] == [("und", 0.0)] * 3 and by_id[903]["lang"] == "xx"
    assert {x["language"]["lang"] for x in language_id.predict(df, []).collect()} == {"und"}
    assert language_id.predict(frame(spark, []), samples).count() == 0
    assert {x["doc_id"] for x in language_id.stage(spark, df, "").collect()} == set(by_id) - {900, 901, 902}
    held = df.select("doc_id", language_id.held_out(df["doc_id"]).alias("h")).where("doc_id is not null").collect()
    assert all(x["h"] == (zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1) for x in held)


def greedy_phrases(text, sample):
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample and text[at : at + size] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("cells", [language_id.TABLE_CELLS, 0])
def test_prediction_is_that_of_one_parse(cells, monkeypatch):
    r, kinds = random.Random(4), {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ver", "ei"], "zz": ["ção", "lh", "nho", "ka"]}
    samples = [(x, sample_words(r, v, 150)) for x, v in kinds.items()] + [("aa", "k")]
    texts = [sample_words(r, sum(r.sample(list(kinds.values()), 2), []) + ["ß", "中"] * (k % 2), r.choice([1, 2, 9, 40, 300])) for k in range(40)] + ["a" * 900, "中" * 700, "kato" * 300, samples[0][1], None, "12"]
    want = []
    for t in texts:
        plain = language_id.letters(t).strip() if t else ""
        n = sorted((greedy_phrases(plain, sample), x) for x, sample in sorted(samples)) if plain else None
        want.append((n[0][1], 1 - n[0][0] / n[1][0]) if n else ("und", 0.0))
    for stretch, lanes in ((256, 8192), (7, 16), (1, 5), (3, 1)):
        monkeypatch.setattr(language_id, "STRETCH", stretch)
        monkeypatch.setattr(language_id, "LANES", lanes)
        got = language_id.Model(sorted(samples), cells).predict(texts)
        assert [x for x, _ in got] == [x for x, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


def test_many_languages_and_letters(spark):
    import tracemalloc

    r = random.Random(3)
    rows = [(k, sample_words(r, [chr(0x4E00 + 300 * (k % 70) + i) for i in range(90)], 60), f"l{k % 70:02d}", None, 0) for k in range(280)]
    # a language that has long texts only, and one whose label has no letter in its texts
    rows += [(1000 + k, "ñandu opa " * 1500, "long", None, 0) for k in range(3)] + [(2000, "1 2 3", "none", None, 0)]
    df = frame(spark, rows)
    samples = language_id.training_sample(df)
    assert len(samples) == 71 and "none" not in dict(samples) and len(dict(samples)["long"]) <= language_id.TRAIN_CHARS
    assert all(x["language"]["lang"] == x["lang"] for x in language_id.predict(df, samples).where("lang <> 'none'").collect())
    text = "".join(r.choices([chr(0x4E00 + i) for i in range(5000)], k=40_000))
    tracemalloc.start()
    model = language_id.Model([("a", text), ("b", "abc " * 100)], table_cells=language_id.TABLE_CELLS)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert size < 300e6 and [x for x, _ in model.predict([text[500:700], "abc abc"])] == ["a", "b"]


def test_language_stage_decides(spark):
    r, kinds = random.Random(4), {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ver", "ei"]}
    rows = [(k, sample_words(r, kinds[x], 60), x, "s", 0) for k in range(60) for x in [list(kinds)[k % 2]]]
    wrong = next(k for k in range(500, 600) if zlib.crc32(str(k).encode()) % 3 == 1)  # not learned from
    rows += [(wrong, rows[0][1], "yy", "s", 0), (101, rows[1][1], None, "s", 0), (102, rows[1][1], "other", "s", 0), (103, "1 2", "xx", "s", 0)]
    rows = [x for x in rows if x[0] != 102] + [(102, "kato schung", None, None, 0)]
    df = frame(spark, rows, language="mine", __text="t")
    out = language_id.stage(spark, df, "")
    got = {x["doc_id"]: x for x in out.collect()}
    # a wrong label goes, a missing one is filled, the columns of such names stay as they are
    assert out.columns == df.columns and set(got) == {x[0] for x in rows} - {wrong, 103}
    assert got[101]["lang"] == "yy" and got[102]["lang"] in kinds and all(x["language"] == "mine" and x["__text"] == "t" for x in got.values())


def test_cross_parsing_counts_greedy_phrases():
    sample = "abracadabra abrab"
    alphabet = {c: k for k, c in enumerate(sorted(set(sample) | {"x"}))}
    automaton = language_id.Automaton(sample, alphabet)
    for table in (False, True):
        if table:
            automaton.tabulate()
        for text in ("abrabra", "cadabx xbra", "x", "abracadabra abrab", "bbbb"):
            symbols = np.array([alphabet[c] for c in text])[:, None]
            assert automaton.phrases(symbols, np.array([len(text)]), np.array([-1])).tolist() == [greedy_phrases(text, sample)]


# ---- quality ----


def brute_counts(text):
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts():
    for t in [*texts(8, 30), "a b c a b c", "a a a a", "x\nx\n x\n\n\n", "é # é\u3000ß <>|", "a b c d a b", "q" * 5000]:
        assert quality.base_counts(t or "") == brute_counts(t or "")


def test_quality(spark, docs):
    r = random.Random(9)
    good = [(3000 + k, " ".join(r.choices(["the", "house", "is", "green", "and", "old", "tree", "sky", "by"], k=120)), "en", "a", 0) for k in range(80)]
    junk = [(4000 + k, " ".join(r.choices(["$$$", "%%%", "buy", "###", "zz", "win"], k=120)), "en", "a", 0) for k in range(40)]
    rows = docs + good + junk
    labels = spark.createDataFrame([(d, 1, 0) for d, *_ in good[:40]] + [(d, 0, 0) for d, *_ in junk[:9]] + [(None, 1, 0), (3000, None, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows, quality_rules=1, good=2)
    ratios = quality.log_ratios(df, labels)
    assert np.array_equal(ratios, quality.log_ratios(df, labels, broadcast_ids=0))
    got = {x["doc_id"]: x["quality_rules"] for x in quality.judge(df, ratios).collect()}
    raw, want = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for _, t, *_ in rows:
        np.add.at(raw, quality.buckets(t or ""), 1)
    for _, t, *_ in good[:40]:
        np.add.at(want, quality.buckets(t), 1)
    raw /= raw.sum()
    want = (want + quality.PRIOR * raw) / (want.sum() + quality.PRIOR)
    assert np.allclose(ratios, np.log(want / raw))
    assert not any(got[d]["kept"] for d, *_ in junk) and not got[0]["kept"] and got[0]["base_failed"] and got[0]["ratio"] == 0
    # every document against the score of its own n-grams, one by one
    for d, t, *_ in rows:
        if d is not None:
            grams = quality.buckets(t or "").tolist()
            score = sum(np.log(want[g] / raw[g]) for g in grams) / max(1, len(grams))
            words, *_, repeats = brute_counts(t or "")
            failed = words < 50 or 100 * repeats > 50 * words
            assert abs(got[d]["ratio"] - score) < 1e-9 and got[d]["base_failed"] == failed and got[d]["kept"] == (not failed and score >= -0.06)
    assert all(got[d]["ratio"] > 0 for d, *_ in good)
    # without trusted texts the base rules alone drop
    none = quality.log_ratios(df, labels.limit(0))
    assert np.abs(none).max() < 1e-12 and all(x["quality_rules"]["kept"] != x["quality_rules"]["base_failed"] for x in quality.judge(df, none).collect())
    assert quality.judge(frame(spark, []), ratios).count() == 0 and np.abs(quality.log_ratios(frame(spark, []), labels)).max() < 1e-12
    clash = quality.judge(frame(spark, rows[:3], found=1, c0="x", __text="y"), ratios)
    assert clash.columns == [*frame(spark, [], found=1, c0="x", __text="y").columns, "quality_rules"] and {(r["found"], r["c0"], r["__text"]) for r in clash.collect()} == {(1, "x", "y")}


# ---- HTML ----


def test_html_cases():
    article = "<article><h1>T &amp; U</h1><p>One\n two<br>three<p>Four <b>five</b></p><div class='ad-box'>x</div><aside>y</aside><ul><li>a<li>b</ul><pre> p  q </pre></article>"
    page = f"<html><head><title>no</title><script>var a='</p>';</script></head><body><nav>m</nav><div id=cookie-notice>c</div>{article}<section class='comments'><p>z</p></section><footer>f</footer></body>"
    assert html_text.extract([page]) == ["T & U\nOne two three\nFour five\na\nb\np q"]
    assert html_text.extract([None, "", "<", "plain  text", "<p>a &lt;b&gt; &eacute;&#x41;&nbsp;c", "<!-- x", "<p>a<scr", "<script>x"]) == ["", "", "<", "plain text", "a <b> éA c", "", "a", ""]
    assert html_text.extract(["<div>" * 3000 + "deep" + "</div>" * 3000]) == ["deep"]
    assert html_text.extract(["<b>" * 5000 + "x"]) == ["x"]


def test_html_wrapper_finds_the_slot():
    r = random.Random(2)
    bodies = ["\n".join(sample_words(r, ["ka", "to", "mi"], 30) for _ in range(4)) for _ in range(6)]
    page = lambda b: f"<body><div class=q1><p>Welcome to our site, dear reader of these pages</p></div><div class=q2>{''.join(f'<p>{x}</p>' for x in b.split(chr(10)))}<div class=q4><span>Same on all pages</span></div></div><div class=q3>Small print</div></body>"
    assert html_text.extract([page(b) for b in bodies]) == bodies


def test_html_pages(spark):
    rows = [(k, f"http://h{k % 3}.net/{k}", f"<body><nav>n</nav><article><p>text {k}</p></article></body>", 1) for k in range(80)] + [(80, None, None, 1), (None, "x", "<p>y", 1), (5, "http://h2.net/5", "<article>text 5</article>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text int")
    for hosts in (10, 0):
        got = sorted((repr(r["page_id"]), r["main_text"]) for r in html_text.extract_pages(df, group=8, broadcast_hosts=hosts).collect())
        assert got == sorted([(repr(k), f"text {k}") for k in range(80)] + [("80", ""), ("None", "y"), ("5", "text 5")])
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_html_copies_keep_their_text(spark):
    body = lambda t, more="": f"<html><head><script>{{}}</script></head><body><article><div><h1>{t}</h1><p>{t} text</p>{more}</div></article></body></html>"
    bare = "<html><body><div><p>a b c</p></div></body></html>"
    more = "<ul><li>u</li></ul><ol><li>o</li></ol><table><tr><td>t</td></tr></table><div>d</div><section>s</section>"
    alone, whole = html_text.extract([body("one")]), "three\nthree text\nu\no\nt\nd\ns"
    assert alone == ["one\none text"] and html_text.extract([body("one")] * 2) == alone * 2
    assert html_text.extract([bare] * 3) == ["a b c"] * 3
    nonces = [body("one").replace("{}", f"var n={k}") for k in range(3)]
    assert html_text.extract(nonces) == alone * 3
    assert html_text.extract([body("one"), body("two"), body("three", more), body("three", more)]) == ["one\none text", "two\ntwo text", whole, whole]
    rows = [(k, f"http://h.net/{k}", body(f"p{k}")) for k in range(9)] + [(100 + k, f"http://h.net/c{k}", body("three", more)) for k in range(30)] + [(200 + k, "http://i.net/", bare) for k in range(30)] + [(300 + k, "http://i.net/", None) for k in range(9)]
    want = sorted([(k, f"p{k}\np{k} text") for k in range(9)] + [(100 + k, whole) for k in range(30)] + [(200 + k, "a b c") for k in range(30)] + [(300 + k, "") for k in range(9)])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for copies in (50, 4):
        for hosts in (10, 0):
            got = html_text.extract_pages(df, group=8, broadcast_hosts=hosts, copies=copies)
            assert got.columns == [*df.columns, "main_text"] and sorted((r["page_id"], r["main_text"]) for r in got.collect()) == want


def test_html_matching_is_the_largest():
    r = random.Random(8)

    def tree(depth):
        node = html_text.Node("div", r.choice("ab"), False)
        node.parts = [tree(depth - 1) for _ in range(r.randint(0, 4))] if depth else []
        return node

    def brute(a, b):  # over runs of neighbours with one signature, as the wrapper has them
        if a[0].sig != b[0].sig:
            return 0
        if len(a) > 1 or len(b) > 1:
            return 1
        x, y = html_text.runs(a[0]), html_text.runs(b[0])

        def best(i, j):
            if i == len(x) or j == len(y):
                return 0
            both = brute(x[i], y[j])
            return max(best(i + 1, j), best(i, j + 1), both + best(i + 1, j + 1) if both else 0)

        return 1 + best(0, 0)

    for _ in range(150):
        a, b = tree(3), tree(3)
        m = html_text.Matcher()
        assert m.score(m.of_group([a]), m.of_group([b])) == brute([a], [b])


def test_html_long_lists_are_halved(monkeypatch):
    r = np.random.default_rng(1)
    for _ in range(30):
        weight = r.integers(0, 5, (4, 4)).astype(np.int32)
        ia, ib = r.integers(0, 4, 25), r.integers(0, 4, 31)
        total = lambda pairs, weight=weight, ia=ia, ib=ib: sum(weight[ia[i], ib[j]] for i, j in pairs)
        whole = html_text.best_pairs(weight, ia, ib)
        with monkeypatch.context() as m:
            m.setattr(html_text, "TABLE_CELLS", 40)
            halved = html_text.best_pairs(weight, ia, ib)
        assert total(whole) == total(halved) and all(a < c and b < d for (a, b), (c, d) in zip(halved, halved[1:], strict=False))


def test_html_names_are_whole_words():
    keep = [
        ('<article><header class="entry-header"><h1>Title</h1></header><p>text</p></article>', "Title\ntext"), ('<div id="main" class="no-sidebar"><p>all text</p></div>', "all text"),
        ('<div class="wrap has-sidebar"><article><p>one</p></article></div>', "one"), ('<article><section id="discussion"><p>one</p></section><div class="related-work">two</div></article>', "one\ntwo"),
        ("<article><p>Fill <label>the name</label> here <math>x</math> <canvas>y</canvas></p></article>", "Fill the name here x y"), ("<form><div><article><p>one</p></article></div><input></form>", "one"),
        ("<article><p>one</p></article><div class=ad>x</div><article class=b><p>two</p></article>", "one\ntwo"), ('<article><p>one</p><article class="comment"><p>no</p></article></article>', "one"),
        ("<article><table><tr><td>cell</td></tr></table></article>", "cell"), ('<article><div class="ad-box">no</div><div id=cookie-notice>no</div><p>one</p></article>', "one"),
    ]
    for page, want in keep:
        whole = f"<html><body><nav><a>m</a></nav>{page}<footer>f</footer></body></html>"
        assert html_text.extract([whole]) == [want] and html_text.extract([whole] * 2) == [want] * 2


def test_html_alignment_decides_without_names():
    r = random.Random(4)
    text = lambda n: sample_words(r, ["ka", "to", "mi", "re"], n)
    pages, want = [], []
    for _ in range(12):
        body = [text(r.randint(5, 60)) for _ in range(3)]
        teaser = text(4)
        pages.append(f"<body><div class=x1><div>Our paper</div><div class=x9>Read on, day by day</div></div><div class=x2><h2>{body[0]}</h2><div class=x5>{body[1]}</div><div class=x8>All rights are ours and stay so</div><p>{body[2]}</p></div><div class=x3>{teaser}</div></body>")
        want.append("\n".join(body))
    assert html_text.extract(pages) == want
    # what one page alone cannot tell
    assert html_text.extract(pages[:1]) != want[:1]


def test_html_article_wins_over_longer_neighbours():
    pages = [f'<body><article><p>body {k} text</p></article><div class="x"><div class="y"><p>Reader {k} says a long long text here</p></div></div></body>' for k in range(4)]
    assert html_text.extract(pages) == [f"body {k} text" for k in range(4)]
    # the article is found below neutral containers, and several end the search
    pages = [f'<body><div class="a"><div class="b"><main><p>body {k}</p></main></div></div><div class="x"><p>Reader {k} says a long long text here</p></div></body>' for k in range(4)]
    assert html_text.extract(pages) == [f"body {k}" for k in range(4)]
    pages = [f'<body><article class="a"><p>one {k}</p></article><article class="b"><p>two {k}, by far the longer one of the two</p></article></body>' for k in range(4)]
    assert html_text.extract(pages) == [f"one {k}\ntwo {k}, by far the longer one of the two" for k in range(4)]
    # nothing tells which part of main is the article: both stay
    pages = [f'<body><main><div class="post"><p>body {k}</p></div><div class="w7"><p>Reader said {k} a long long text here</p></div></main></body>' for k in range(4)]
    assert all(t.startswith(f"body {k}\n") for k, t in enumerate(html_text.extract(pages)))


@pytest.mark.parametrize("tag", "ul ol dl section div details p table blockquote pre figure".split())
def test_html_shared_parts_go_by_place(tag):
    inner = {"ul": "<li>shared</li>", "ol": "<li>shared</li>", "dl": "<dt>shared</dt>", "table": "<tr><td>shared</td></tr>"}.get(tag, "shared")
    part = f"<{tag}>{inner}</{tag}>"
    between = [f"<body><nav>menu</nav><article><h1>T{k}</h1><p>first {k}</p>{part}<p>last {k}</p></article><footer>f</footer></body>" for k in range(4)]
    assert html_text.extract(between) == [f"T{k}\nfirst {k}\nshared\nlast {k}" for k in range(4)] == [html_text.extract([x])[0] for x in between]
    edge = [f"<body><article><h1>T{k}</h1><p>first {k}</p><p>last {k}</p>{part}</article></body>" for k in range(4)]
    stays = tag in ("p", "table", "blockquote", "pre", "figure")
    assert html_text.extract(edge) == [f"T{k}\nfirst {k}\nlast {k}" + "\nshared" * stays for k in range(4)]


def brute_slot(slot):
    """The same choice from the leaves' side: the deepest wrapper node such that no step of the way to it was refused."""

    def holds(x, tags):
        return not x.named and bool(x.varying) and (x.tag in tags or any(holds(c, tags) for c in x.children))

    def step(x, inside):
        marked = [c for c in x.children if holds(c, html_text.ARTICLES)]
        if x.tag == "article" or len(marked) > 1:
            return None
        for some in ([marked] if marked else [x.children, [c for c in x.children if not c.named]]):
            total = sum(c.varying for c in some) + (x.varying - sum(c.varying for c in x.children))
            best = max(some, key=lambda c: c.varying, default=None)
            if best is None or not best.varying:
                return None
            if marked or (not best.named and best.tag in html_text.CONTAINERS and best.varying > html_text.SLOT_SHARE * total):
                beside = [c for c in x.children if c is not best and c.varying and not c.named]
                return None if any(c.tag in html_text.PROSE or (inside and holds(c, html_text.BODY)) for c in beside) else best
        return None

    inside = False
    while True:
        inside = inside or slot.tag == "main"
        below = step(slot, inside)
        if below is None:
            return slot
        slot = below


def test_html_slot_choice():
    r = random.Random(9)
    for _ in range(300):

        def tree(depth):
            node = html_text.Slot(html_text.Node(r.choice(["div", "div", "section", "p", "main", "article", "ul"]), "s", r.random() < 0.2))
            node.children = [tree(depth - 1) for _ in range(r.randint(0, 3))] if depth and node.tag != "p" else []
            node.varying = r.choice([0, 5, 40, 300]) * (not node.children) + sum(c.varying for c in node.children)
            html_text.mark(node)
            return node

        root = tree(4)
        root.named = False
        html_text.mark(root)
        assert html_text.content_slot(root) is brute_slot(root)


def test_html_alignment_alone_on_the_pages(monkeypatch):
    import pandas as pd

    pages = pd.read_parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = pages["url"].fillna("").str.extract(r"://([^/?#]*)")[0].fillna("").str.lower()
    groups = [list(x) for _, x in pages["html"].groupby(hosts)]
    want = [html_text.extract(x) for x in groups]
    real = html_text._named
    monkeypatch.setattr(html_text, "_named", lambda attrs, tag, inside: (real(attrs, tag, inside)[0], False))
    bare = [[re.sub(r"<(/?)(article|main)\b", r"<\1section", x or "") for x in some] for some in groups]
    same = sum(a == b for some, w in zip(bare, want, strict=True) for a, b in zip(html_text.extract(some), w, strict=True))
    assert same >= 0.98 * len(pages)


def test_html_depth_and_length():
    deep = "<div class=a><p>x</p>" * 4000 + "<p>end" + "</div>" * 4000
    out = html_text.extract([deep, deep.replace("end", "and")])
    assert [x.split("\n")[-1] for x in out] == ["end", "and"]
    rows = lambda n, w: "<table>" + "".join(f"<tr class=r{k % 2}><td>{w}{k}</td></tr>" for k in range(n)) + "</table>"
    out = html_text.extract([rows(700, "a"), rows(900, "b")])
    assert [len(x.split("\n")) for x in out] == [700, 900]


# ---- tokens, packing, token files ----

ODD_TEXTS = ["", " ", "a", " a", "a ", "a  b", "a\n\nb", "a \nb", "\na", "a\n", "don't <|endoftext|> x<|startoftext|>y", "é́ x y\tz", "a\x1cb c", "\0 a b", "x" * 300 + " y " + "z" * 60, "Ünï ẞ ß 12345 !!??", "Σας ΣΑΣ. x", "Word, word. WORD Word", "İstanbul I ı", "!", "a,b ,c . d.,"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("kept", [tokens.KEPT_UNITS, 5])
def test_encoder_equals_the_library(name, kept):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path(name)
    plain = Tokenizer.from_file(path)
    enc = tokens.UnitEncoder(path, kept)
    some = ODD_TEXTS + [t for t in texts(11, 40) if t] + [f"{a} {b}" for a in ODD_TEXTS for b in ODD_TEXTS[:9]]
    for _ in range(2):
        assert [x.tolist() for x in enc.encode(some)] == [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]
    assert list(enc.encode([])) == [] and [len(x) for x in enc.encode([None, "a", None])] == [0, 1, 0]
    letters = [chr(c) + "x, " + chr(c) + ".\n" + chr(c) for c in range(1, 0x260)]
    assert [x.tolist() for x in enc.encode(letters)] == [x.ids for x in plain.encode_batch(letters, add_special_tokens=False)]
    plain.encode_special_tokens = True
    assert [x.tolist() for x in tokens.UnitEncoder(path, kept, special_text=True).encode(some)] == [x.ids for x in plain.encode_batch(some, add_special_tokens=False)]


def test_encoder_cuts_no_chunk(monkeypatch):
    path = tokens.vocabulary_path("byte_bpe_50k.json")
    some = ODD_TEXTS + [t for t in texts(11, 40) if t]
    whole = [x.tolist() for x in tokens.UnitEncoder(path).encode(some)]
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 100)
    assert [x.tolist() for x in tokens.UnitEncoder(path).encode(some)] == whole


def brute_ids(name, rows):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path(name))
    return [plain.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_plan_is_best_fit_decreasing():
    r = random.Random(3)
    for capacity in (10, 64, 200):
        for _ in range(30):
            lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 120))]
            histogram = Counter(lengths)
            plan, bins = packing.plan_packing(histogram, capacity)
            free = []
            for x in sorted(lengths, reverse=True):
                fit = [k for k, f in enumerate(free) if f >= x]
                if fit:
                    free[min(fit, key=lambda k: free[k])] -= x
                else:
                    free.append(capacity - x)
            assert bins == len(free)
            used = defaultdict(list)
            ranks = Counter()
            for length, rank, n, first, offset in plan:
                assert rank == ranks[length]
                ranks[length] += n
                for k in range(n):
                    used[first + k].append((offset, length))
            assert ranks == histogram and sorted(capacity - sum(x for _, x in v) for v in used.values()) == sorted(free)
            for v in used.values():
                at = 0
                for offset, length in sorted(v):
                    assert offset == at
                    at += length


def test_packing(spark, docs):
    for rows in (docs, docs + [(7000 + k, "same words here", None, None, 0) for k in range(2500)]):
        got = [r.asDict() for r in packing.pack_documents(frame(spark, rows, length=1, piece=2), capacity=128).collect()]
        want = [(d, n, n * 128, len(p), crc(p)) for (d, *_), ids in zip(rows, brute_ids(packing.VOCABULARY, rows), strict=True) for n in range(-(-len(ids) // 128)) for p in [ids[n * 128 : n * 128 + 128]]]
        assert sorted(((g["doc_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got), key=repr) == sorted(want, key=repr)
        bins = defaultdict(list)
        for g in got:
            bins[g["sequence_id"]].append((g["offset"], g["length"]))
        for v in bins.values():
            at = 0
            for offset, length in sorted(v):
                assert offset == at
                at += length
            assert at <= 128
        assert len(bins) == packing.plan_packing(Counter(g["length"] for g in got), 128)[1]
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_repair_round_trip():
    r, end = np.random.default_rng(2), 50_257
    for symbols in (r.integers(0, 9, 5000), r.integers(0, 40_000, 5000), np.zeros(3000, int), np.array([], int), np.array([0]), r.zipf(1.3, 300_000) % 50_000):
        seq = symbols.astype(np.uint32)
        if len(seq):
            seq[r.integers(0, len(seq), len(seq) // 50 + 1)] = end
        short, rules, lengths = token_files.compress(seq, end)
        back = token_files.expand(short, rules, end)
        assert np.array_equal(back, np.where(seq == end, 0, seq))
        assert len(lengths) == len(rules) and all(len(token_files.expand(np.array([end + 1 + k], np.uint32), rules, end)) == n for k, n in list(enumerate(lengths))[:50])
        # no pair is left that would pay, overlaps within runs of one symbol aside
        left = Counter((a, b) for a, b in zip(short.tolist(), short.tolist()[1:]) if end not in (a, b) and a != b)
        assert not left or max(left.values()) < token_files.LEAST_COUNT
    assert len(token_files.compress(np.zeros(3000, np.uint32), end)[0]) < 100


def test_packed_numbers():
    r = np.random.default_rng(3)
    for most in (1, 1 << 10, 1 << 16, 1 << 17, 1 << 21):
        for n in (0, 1, 7, 8, 1001):
            values = r.integers(0, most, n).astype(np.uint32)
            packed = b"x" + token_files.pack_numbers(values)
            back, at = token_files.unpack_numbers(packed, 1, n)
            assert np.array_equal(back, values) and at == len(packed)


def test_payload_is_smaller_than_plain_ids():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 7))) for _ in range(3000)]
    enc = tokens.UnitEncoder(tokens.vocabulary_path(token_files.VOCABULARY))
    ids = list(enc.encode([" ".join(words[int(3000 * r.random() ** 3)] for _ in range(400)) for _ in range(200)]))
    assert len(token_files.write_block(list(range(200)), ids, enc.size)) < 1.6 * sum(len(x) + 1 for x in ids)


def test_block_random_access():
    ids = [np.array(x, dtype="<u4") for x in ([1, 2, 3] * 50, [], [0, 0, 0], [5] * 40)]
    block = token_files.Block(token_files.write_block([4, None, 6, -7], ids, 6))
    assert block.doc_ids == [4, None, 6, -7] and block.sizes().tolist() == [151, 1, 4, 41]
    for k in (3, 0, 2, 1):
        assert block.document(k).tolist() == [*ids[k].tolist(), 0]
    assert [x.tolist() for x in block.documents()] == [[*x.tolist(), 0] for x in ids]
    with pytest.raises(ValueError):
        token_files.Block(b"nothing")


def test_token_files(spark, docs, tmp_path):
    # rows of one id, of no id, and alike: in the order of ids, each with its own ids
    docs = docs + [(5, f"text {k % 4}", None, None, 0) for k in range(40)] + [(None, "no id", None, None, 0)] * 9
    token_files.write_token_files(frame(spark, docs, id=1, block=2), str(tmp_path / "f"), tokens.vocabulary_path(token_files.VOCABULARY), block_ids=500)
    got = sorted(map(tuple, token_files.read_token_files(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1])
    want = [(d, len(ids), crc(ids)) for (d, *_), ids in zip(docs, brute_ids(token_files.VOCABULARY, docs), strict=True)]
    assert Counter((d, n, c) for d, _, n, c in got) == Counter(want)
    assert [d for d, *_ in got] == sorted((d for d, *_ in got), key=lambda d: (d is not None, d or 0))
    assert [s for _, s, *_ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    token_files.write_token_files(frame(spark, []), str(tmp_path / "e"), tokens.vocabulary_path(token_files.VOCABULARY))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0
