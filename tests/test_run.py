"""Reads to calls on a toy gene: two sources, 117 sites, two variants."""

from paraloom.plans import genotype as G
from paraloom.sources import tables as T
from tests.test_operators import READS

STATES = [("shift", None, 1.0), ("mean", 2, 1.0), ("mean", 3, 1.5), ("sd", 2, 0.056)] + [("prior", k, p) for k, p in ((0, 0.001), (1, 0.001), (2, 0.2), (3, 0.2), (4, 0.3), (5, 0.2), (6, 0.05))]


def base(sample, k, pos, letter, strand):
    return (sample, f"{sample}-{k}", 16 * strand, "22", pos, pos + 1, 60, 300, [("M", 1)], letter, [30])


def toy_reads(sample, gene, other, variant):
    """30 reads a copy: `gene` and `other` copies of each source, `variant` copies of a change in the gene."""
    rows, k = [], 0

    def add(pos, letter, copies):
        nonlocal k
        for n in range(int(15 * copies)):
            rows.append(base(sample, k, pos, letter, n % 2))
            k += 1

    for i in range(117):
        add(42_000_000 + i, "A", gene)
        add(42_500_000 + i, "C", other)
    add(42_127_999, "T", variant)
    add(42_127_999, "G", gene - variant)
    for r in range(30):  # two copies a region
        add(60_000_000 + 100 * r, "A", 2)
    add(61_000_000, "A", gene + other)
    add(62_000_000, "A", 2)
    return rows


def test_reads_to_calls(spark):
    rows = toy_reads("het", 2, 2, 1) + toy_reads("hom", 2, 2, 2) + toy_reads("three", 3, 2, 0)
    reads = spark.createDataFrame(rows, READS)
    regions = [(k, "22", 60_000_000 + 100 * k, 60_000_100 + 100 * k, f"n{k}", "norm", 0.3 + k / 100) for k in range(30)]
    regions += [(30, "22", 61_000_000, 61_000_100, "gene_hapcn1", "d67", 0.5), (31, "22", 62_000_000, 62_000_100, "spacer_hapcn1", "spacer", 0.5)]
    sites = [(i, "22", 42_000_000 + i, ["A"], 42_500_000 + i, ["C"], "x") for i in range(117)]
    schema = "idx int, chrom string, pos1 long, alleles1 array<string>, pos2 long, alleles2 array<string>, label string"
    res = T.Resources(
        spark.createDataFrame(regions, "ord int, chrom string, start long, end long, name string, region_type string, gc double"),
        spark.createDataFrame([(r, *s) for r in ("d67", "spacer") for s in STATES], "region string, param string, cn int, value double"),
        spark.createDataFrame(sites, schema), spark.createDataFrame([(0, "22", 42_127_999, ["T"], 42_600_000, ["G"], "g.42128000G>T")], schema), spark.createDataFrame([], schema),
        spark.createDataFrame([(0, "*1", []), (1, "*2", ["g.42128000G>T"])], "ord int, name string, parts array<string>"),
        function=spark.createDataFrame([("*1", "1.0"), ("*2", "0.0")], "haplotype string, activity string"),
    )
    got = {r["sample_id"]: r for r in G.run(reads, res).collect()}
    assert {s: (r["total_cn"], r["spacer_cn"], r["tag"]) for s, r in got.items()} == {"het": (4, 2, "cn2"), "hom": (4, 2, "cn2"), "three": (5, 2, "cn3")}
    assert {s: (r["genotype"], r["filter"], r["phenotype"]) for s, r in got.items()} == {
        "het": ("*1/*2", "PASS", "Intermediate Metabolizer"), "hom": ("*2/*2", "PASS", "Poor Metabolizer"), "three": ("*1/*1x2", "PASS", "Indeterminate")
    }
    assert got["het"]["confidence_label"] in ("HIGH", "MEDIUM") and got["het"]["names"] == ["g.42128000G>T"]
