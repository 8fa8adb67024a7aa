"""The corpus pipeline against plain Python, stage by stage, and its run from a folder of tables."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from paraloom.llm import language_id, mixing, packing, tokens
from tests.llm.test_operators import DOCS, WORD, brute_fingerprint, brute_near, brute_targets, frame, sample_words, unions


@pytest.fixture(scope="module")
def rows():
    r, kinds = random.Random(12), {"xx": ["ka", "to", "mi", "re"], "yy": ["sch", "ung", "ver", "ei"]}
    line = sample_words(r, kinds["xx"], 15)
    out = []
    for k in range(120):
        lang = ["xx", "yy"][k % 2]
        text = sample_words(r, kinds[lang], r.randint(30, 120))
        out.append((k, f"{text}\n{line}" if k % 8 == 0 else text, lang, ["a", "b", None][k % 3], len(text)))
    out += [(200 + k, out[k][1], out[k][2], "c", 0) for k in range(10)]
    words = out[3][1].split(" ")
    out += [(300, " ".join([*words[:-1], "zzz"]), "yy", "a", 0), (400, None, "xx", "a", 0), (401, "## 12 |", "xx", "a", 0), (402, "", None, None, 0)]
    return out


def test_stages(spark, rows):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "best-fit packing"]
    docs, seen = frame(spark, rows), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append(docs)
    assert all(d.columns == [f.split()[0] for f in DOCS.split(", ")] for d in seen[:-1])
    told, lines, unique, mixed, packed = ([tuple(r) for r in d.collect()] for d in seen)
    want = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(told, key=repr) == sorted(want, key=repr)
    # lines of 40 characters in five documents or more
    holders = defaultdict(set)
    for d, t, *_ in want:
        for x in t.split("\n"):
            if len(x) >= 40:
                holders[x.lower()].add(d)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    clean = {d: "\n".join(x for x in t.split("\n") if keeper.get(x.lower(), d) == d) for d, t, *_ in want}
    assert keeper and {r[0]: r[1] for r in lines} == clean and all(r[4] == len(r[1]) for r in lines)
    ids = sorted(clean)
    fps = [brute_fingerprint(clean[d]) for d in ids]
    near = brute_near([clean[d] for d in ids])
    assert any(bin(fps[a] ^ fps[b]).count("1") > 2 for a, b in near)
    root = unions(len(ids), near + [(a, b) for a in range(len(ids)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 2])
    assert sorted(r[0] for r in unique) == [ids[k] for k in range(len(ids)) if root[k] == k] and len(unique) < len(ids)
    sizes = Counter()
    for _, t, _, s, _ in unique:
        sizes[s] += len(WORD.findall(t))
    target, taken = brute_targets(sizes), Counter()
    source = {r[0]: r[3] for r in unique}
    for d, t, *_ in mixed:
        taken[source[d]] += len(WORD.findall(t))
        assert set(t.split()) <= set(clean[d].split())
    assert all(abs(taken[s] - t) <= max(0.05 * t, 3 * mixing.BLOCK_WORDS) for s, t in target.items())
    enc = tokens.UnitEncoder(tokens.vocabulary_path(packing.VOCABULARY))
    lengths = Counter(n for x in enc.encode([t for _, t, *_ in mixed]) for total in [len(x) + 1] for n in [2048] * (total // 2048) + [total % 2048] * (total % 2048 > 0))
    assert Counter(r[3] for r in packed) == lengths
    assert len({r[5] for r in packed}) == packing.plan_packing(lengths)[1]


def test_run_equals_the_stages(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, str(tmp_path))) == key(docs)


def test_empty_corpus(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_labels(spark, rows):
    assert language_id.stage(spark, frame(spark, [(d, t, None, s, n) for d, t, _, s, n in rows[:5]]), "").count() == 0
