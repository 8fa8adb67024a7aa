"""Options of a run, each on a toy sample whose call it changes."""

import pytest

from paraloom.plans import genotype as G
from paraloom.sources import tables as T
from tests.test_operators import READS
from tests.test_run import STATES, base

NAMES = {42_127_999: "g.42128000G>T", 42_129_999: "g.42130000G>T", 42_126_499: "g.42126500G>T"}


def sample(name, gene, other, variants=None, steps=None, spacer=2, strands=True):
    """Reads of a sample: 15 a copy, copies need not be whole. variants: copies of each change by place; steps: (gene, other) by site index."""
    rows, k = [], 0

    def add(pos, letter, copies, both=True):
        nonlocal k
        for n in range(round(15 * copies)):
            rows.append(base(name, k, pos, letter, n % 2 if both else 0))
            k += 1

    for i in range(117):
        one, two = steps(i) if steps else (gene, other)
        add(42_000_000 + i, "A", one)
        add(42_500_000 + i, "C", two)
    for place in NAMES:
        copies = (variants or {}).get(place, 0)
        add(place, "T", copies, strands)
        add(place, "G", gene - copies)
    for r in range(30):
        add(60_000_000 + 100 * r, "A", 2)
    add(61_000_000, "A", gene + other)
    add(62_000_000, "A", spacer)
    return rows


@pytest.fixture(scope="module")
def called(spark):
    a, b, c = NAMES
    rows = sample("near", 2, 2, {a: 1, b: 1}) + sample("one_strand", 2, 2, {c: 1}, strands=False) + sample("spacer", 2, 2, spacer=3)
    # no region has sites that agree on whole copies, but the share falls along the axis
    rows += sample("falls", 2, 1, steps=lambda i: (2.4, 0.6) if i < 60 else (1.5, 1.5))
    # whole copies for the most likely path, too few sites that are sure of them
    rows += sample("path", 3, 2, steps=lambda i: (2, 3) if i < 9 else (3, 2) if i % 4 == 0 else (2.62, 2.38))
    reads = spark.createDataFrame(rows, READS).cache()
    regions = [(k, "22", 60_000_000 + 100 * k, 60_000_100 + 100 * k, f"n{k}", "norm", 0.3 + k / 100) for k in range(30)]
    regions += [(30, "22", 61_000_000, 61_000_100, "gene_hapcn1", "d67", 0.5), (31, "22", 62_000_000, 62_000_100, "spacer_hapcn1", "spacer", 0.5)]
    schema = "idx int, chrom string, pos1 long, alleles1 array<string>, pos2 long, alleles2 array<string>, label string"
    targets = [(k, "22", place, ["T"], 42_600_000 + k, ["G"], name) for k, (place, name) in enumerate(NAMES.items())]
    res = T.Resources(
        spark.createDataFrame(regions, "ord int, chrom string, start long, end long, name string, region_type string, gc double"),
        spark.createDataFrame([(r, *s) for r in ("d67", "spacer") for s in STATES], "region string, param string, cn int, value double"),
        spark.createDataFrame([(i, "22", 42_000_000 + i, ["A"], 42_500_000 + i, ["C"], "x") for i in range(117)], schema), spark.createDataFrame(targets, schema), spark.createDataFrame([], schema),
        spark.createDataFrame([(0, "*1", []), (1, "*2", [NAMES[a], NAMES[b], NAMES[c]]), (2, "*3", [NAMES[c]])], "ord int, name string, parts array<string>"),
    )
    near = G.gene_reads(reads, res)
    counts = G.cut(G.I.region_read_counts(reads, res.regions, ["sample_id"]))
    samples = G.cut(counts.select("sample_id").distinct())
    return lambda **options: {r["sample_id"]: r for r in G.run(reads, res, G.Options(**options), counts, near, samples).collect()}


@pytest.fixture(scope="module")
def plain(called):
    return called()


def test_without_options(plain):
    got = {s: (r["total_cn"], r["spacer_cn"], r["tag"], r["genotype"], r["filter"]) for s, r in plain.items()}
    assert got["near"][2:] == ("cn2", None, None) and got["one_strand"][2:] == ("cn2", "*1/*3", "PASS") and got["spacer"] == (4, 3, "cn2", "*1/*1", "PASS")
    assert got["falls"][2:4] == (None, None) and got["path"][2:4] == (None, None)


def test_fuzzy_match(called):
    got = called(fuzzy_match=True)
    assert (got["near"]["genotype"], got["near"]["filter"]) == ("*1/*2", "Fuzzy_match") and got["near"]["call_info"].startswith("fuzzy_match(")


def test_strand_bias_all_and_spacer_check(called):
    got = called(strand_bias_all=True, spacer_cn_check=True)
    assert got["one_strand"]["genotype"] == "*1/*1"
    assert (got["spacer"]["genotype"], got["spacer"]["filter"]) == ("*1/*1", "Spacer_CN_inconsistent")


def test_changepoint_hybrid(called):
    got = called(changepoint_hybrid=True)
    assert got["falls"]["tag"] == "dup_star13" and got["near"]["tag"] == "cn2"


def test_hmm_cnv(called):
    got = called(hmm_cnv=True)
    assert got["path"]["tag"] == "exon9hyb" and got["near"]["tag"] == "cn2"
