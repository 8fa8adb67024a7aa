"""Branches of the run that options switch on, and the evidence of single reads, on toy tables."""

import itertools
import json
import random
from collections import Counter

from pyspark.sql import functions as F

from paraloom import cli
from paraloom.operators import evidence as E
from paraloom.operators import match as M
from paraloom.operators import site_index as X
from paraloom.plans import diagnostics
from paraloom.plans import genotype as G
from paraloom.sources import sinks
from paraloom.sources import tables as T
from tests.test_operators import READS
from tests.test_run import STATES, base, toy_reads


def profile(spark, steps, total):
    rows = [("s", i, round(100 * v), 100 - round(100 * v)) for i in range(117) for v in [next(x for end, x in steps if i < end)]]
    return spark.createDataFrame(rows, "sample_id string, idx int, n1 long, n2 long"), spark.createDataFrame([("s", total, 2)], "sample_id string, total_cn int, spacer_cn int")


def test_changepoints_need_a_step(spark):
    tags = {}
    for name, steps, total in (("even", [(40, 0.60), (80, 0.50), (117, 0.38)], 2), ("falls", [(60, 0.65), (117, 0.35)], 2), ("rises", [(60, 0.30), (117, 0.66)], 4), ("far", [(60, 0.65), (117, 0.35)], 5)):
        tags[name] = G.changepoint_tags(*profile(spark, steps, total)).first()["step_tag"]
    assert tags == {"even": None, "falls": "star13", "rises": "star68_star68", "far": None}


def test_hidden_states_take_the_first_region_from_the_data(spark):
    # four copies in all, and two of the first source everywhere but before exon 9, where there is one: a duplication there is no balance
    plain, totals = profile(spark, [(117, 0.5)], 4)
    low, _ = profile(spark, [(3, 0.25), (117, 0.5)], 4)
    assert G.hidden_state_tags(plain, totals, 0.3).first()["state_tag"] == "cn2"
    assert G.hidden_state_tags(low, totals, 0.05).first()["state_tag"] is None
    # a region without sites ends it
    assert G.hidden_state_tags(plain.where("idx >= 3"), totals, 0.3).count() == 0


def test_strand_filter_uses_halves_of_the_alternative(spark):
    # sixteen reads on one strand against halves of sixteen are biased, whatever the reference reads are
    counts = spark.createDataFrame([("s", 0, 42127000, "g.x", 16, 30, 16, 0), ("s", 1, 42127001, "g.y", 16, 900, 8, 8)], "sample_id string, idx int, pos long, name string, n1 long, n2 long, n1_fwd long, n1_rev long")
    tags = spark.createDataFrame([("s", "cn2")], "sample_id string, tag string")
    plain = {r["name"]: r["cn"] for r in G.variant_copies(counts, tags, G.Options()).collect()}
    strict = {r["name"]: r["cn"] for r in G.variant_copies(counts, tags, G.Options(strand_bias_all=True)).collect()}
    assert plain["g.x"] == 1 and strict["g.x"] == 0 and plain["g.y"] == strict["g.y"]


def test_exon9_conversion_alone(spark):
    stars = spark.createDataFrame([(0, "*1", []), (1, "*36", ["exon9gc", "g.42126611C>G"])], "ord int, name string, parts array<string>")
    schema = "sample_id string, tag string, names array<string>, exon9 int, exon9_cn int, exon9_raw array<double>"
    rows = spark.createDataFrame([("a", "cn2", [], 2, 1, [1.1, 1.0]), ("b", "cn2", [], 2, 2, [2.0, 2.0]), ("c", "cn2", ["g.42126611C>G"], 2, 1, [1.4, 1.0])], schema)
    got = {r["sample_id"]: (r["names"], r["call_info"]) for r in G.match_stars(rows, G.dictionaries(stars), stars, G.Options()).collect()}
    assert got == {"a": (["exon9gc", "g.42126611C>G"], "unique_match"), "b": ([], "unique_match"), "c": (["g.42126611C>G"], "no_match")}


def brute_score(observed, candidate):
    both = sum((Counter(observed) & Counter(candidate)).values())
    extra, missing = len(candidate) - both, len(observed) - both
    return round(both - 0.5 * extra - 0.3 * missing, 6) if extra <= 2 and missing <= 2 else -1


def test_fuzzy_match_is_the_best_of_all(spark):
    r = random.Random(3)
    stars = [(k, f"*{k}", sorted(r.sample("abcdef", r.randint(0, 3)))) for k in range(9)]
    df = spark.createDataFrame(stars, "ord int, name string, parts array<string>")
    seen = [(f"s{k}", sorted(r.choices("abcdefg", k=r.randint(0, 8)))) for k in range(40)]
    rows = spark.createDataFrame(seen, "sample_id string, names array<string>")

    def want(tuples):
        keys = {"_".join(sorted(x for _, _, p in t for x in p)) for t in tuples} - {""}
        out = {}
        for s, names in seen:
            best = min(((-brute_score(names, k.split("_")), k) for k in keys), default=(0, ""))
            if best[0] <= -1:
                out[s] = (best[1], -best[0])
        return out

    pairs = M.pair_dictionary(df, [(1, 1, True)])
    assert {x["sample_id"]: (x["key"], x["score"]) for x in M.fuzzy_match(rows, pairs, ["sample_id"], "names").collect()} == want(itertools.combinations_with_replacement(stars, 2))
    triples = {x["sample_id"]: (x["key"], x["score"]) for x in G.fuzzy_triples(rows, df).collect()}
    assert triples == want(itertools.combinations_with_replacement(stars, 3))


STAR_ROWS = [(0, "*1", []), (1, "*2", ["g.101A>C", "g.111A>G"]), (2, "*3", ["g.101A>C"]), (3, "*4", ["g.111A>G"])]


def fragments(sample, letters):
    """Fragments that cover both variants, 10 apart, as (first base, second base) with their number."""
    rows = []
    for k, ((a, b), n) in enumerate(letters.items()):
        for m in range(n):
            seq = a + "A" * 9 + b + "AAAA"
            rows.append((sample, f"{k}-{m}", 0, "22", 100, 115, 60, 300, [("M", 15)], seq, [30] * 15))
    return rows


def test_phase_and_votes(spark):
    stars = spark.createDataFrame(STAR_ROWS, "ord int, name string, parts array<string>")
    reads = spark.createDataFrame(fragments("cis", {("C", "G"): 9, ("A", "A"): 9}) + fragments("trans", {("C", "A"): 9, ("A", "G"): 8}) + fragments("few", {("C", "G"): 2}), READS)
    candidates = spark.createDataFrame([(s, ["*1_*2", "*3_*4"]) for s in ("cis", "trans", "few")], "sample_id string, candidates array<string>")
    variants = spark.createDataFrame([("g.101A>C", 100, "C", "A"), ("g.111A>G", 110, "G", "A")], "name string, pos long, alt string, ref string")
    got = {r["sample_id"]: r["resolved"] for r in E.phased_calls(candidates, stars, reads, variants, "22").collect()}
    assert got == {"cis": "*1/*2", "trans": "*3/*4"}
    sites = E.vote_sites(variants.select("name"))
    pairs = E.vote_pairs(E.vote_scores(E.vote_observations(reads, sites, "22"), sites, stars))
    best = {r["sample_id"]: (r["a"], r["b"]) for r in pairs.where("rank = 1").collect()}
    assert best == {"cis": ("*1", "*2"), "trans": ("*3", "*4"), "few": ("*2", "*2")}
    calls = spark.createDataFrame([("cis", "*1/*2"), ("trans", "*1/*2"), ("few", "*2/*5")], "sample_id string, genotype string")
    flags = {r["sample_id"]: r["vote_flag"] for r in E.vote_flags(calls, pairs, stars).collect()}
    assert flags == {"cis": None, "trans": "Read_voting_disagrees_best_*3_*4", "few": None}


def test_deletions_vote_by_absence(spark):
    rows = [("s", "gone", 0, "22", 95, 110, 60, 300, [("M", 5), ("D", 3), ("M", 7)], "A" * 12, [20] * 12), ("s", "there", 0, "22", 95, 107, 60, 300, [("M", 12)], "A" * 12, [20] * 12), ("s", "low", 0, "22", 95, 107, 5, 300, [("M", 12)], "A" * 12, [20] * 12)]
    sites = E.vote_sites(spark.createDataFrame([("g.101delA",), ("g.99A>C",), ("g.5_6insA",)], "name string"))
    got = {(r["qname"], r["name"]): (r["base"], r["quality"]) for r in E.vote_observations(spark.createDataFrame(rows, READS), sites, "22").collect()}
    assert got == {("gone", "g.101delA"): (None, 30), ("gone", "g.99A>C"): ("A", 20), ("there", "g.101delA"): ("A", 20), ("there", "g.99A>C"): ("A", 20)}


def test_variants_along_reads(spark):
    schema = "idx int, chrom string, pos1 long, alleles1 array<string>, pos2 long, alleles2 array<string>, label string"
    sites = [(k, "22", 100 + k, ["A"], 5000 + k, ["C"], "x") for k in range(3)]
    row = lambda s, k, pos, seq: (s, f"{s}{k}", 0, "22", pos, pos + len(seq), 60, 300, [("M", len(seq))], seq, [30] * len(seq))
    # fewer copies of the first source at the last site than the total implies, and reads that go over
    rows = [row("one", k, 100, "AACTT") for k in range(20)] + [row("one", 100 + k, 100, "AAATT") for k in range(10)] + [row("one", 200 + k, 5000, "CCCTT") for k in range(30)] + [row("none", k, 100, "AAATT") for k in range(30)] + [row("none", 100 + k, 5000, "CCCTT") for k in range(30)]
    reads = spark.createDataFrame(rows, READS)
    totals = spark.createDataFrame([("one", 4), ("none", 4)], "sample_id string, total_cn int")
    tags = spark.createDataFrame([("one", "cn2"), ("none", "cn2")], "sample_id string, tag string")
    df = spark.createDataFrame(sites, schema)
    observed = X.observe(reads, X.site_rows(df, "haplotype 938").unionByName(X.site_rows(df, "haplotype 803")))
    copies, flags, raw = G.haplotype_calls(observed, {"938": df, "803": df}, totals, tags)
    assert [(r["sample_id"], r["name"], r["cn"]) for r in copies.collect()] == [("one", "g.42126938C>T", 1)]
    assert {r["sample_id"]: (r["cis_938"], r["trans_803"]) for r in flags.collect()} == {"one": (True, False), "none": (False, False)}
    assert {r["sample_id"]: (r["alt"], r["ref"]) for r in raw.collect()} == {"one": (50, 10), "none": (30, 30)}
    nothing = G.haplotype_calls(observed, {}, totals, tags)
    assert nothing[0].count() == nothing[2].count() == 0 and {r["cis_938"] for r in nothing[1].collect()} == {False}


def test_command_line(spark, tmp_path):
    rows = toy_reads("het", 2, 2, 1) + toy_reads("three", 3, 2, 0)
    spark.createDataFrame(rows, READS).write.parquet(str(tmp_path / "reads.parquet"))
    d = tmp_path / "definitions"
    d.mkdir()
    lines = [f"chr22\t{60_000_000 + 100 * k}\t{60_000_100 + 100 * k}\tn{k}\tnorm\t{0.3 + k / 100}" for k in range(30)] + ["chr22\t61000000\t61000100\tgene_hapcn1\td67\t0.5", "chr22\t62000000\t62000100\tspacer_hapcn1\tspacer\t0.5"]
    (d / "regions.bed").write_text("\n".join(lines))
    words = {p: " ".join(f"{k}:{v}" for q, k, v in STATES if q == p and k is not None) for p in ("mean", "sd", "prior")}
    (d / "gmm.txt").write_text("\n".join(f"{r}\tshift\t1.0\n" + "\n".join(f"{r}\t{p}\t{w}" for p, w in words.items()) for r in ("d67", "spacer")))
    (d / "sites.txt").write_text("\n".join(f"chr22\t{42_000_001 + i}\tA\t{42_500_001 + i}\tC\tx" for i in range(117)))
    (d / "targets.txt").write_text("chr22\t42128000\tT\t42600001\tG\tg.42128000G>T\n")
    (d / "homology.txt").write_text("#none\n")
    (d / "stars.txt").write_text("*1\tNA\tNormal\n*2\tg.42128000G>T\tNone\n")
    (d / "function.txt").write_text("Haplotype\tActivity\tFunction\tS\tE\n*1\t1.0\tnormal\tx\ty\n*2\t0.0\tnone\tx\ty\n")
    (d / "names.json").write_text(json.dumps({"regions": "regions.bed", "parameters": "gmm.txt", "sites": "sites.txt", "targets": "targets.txt", "homology": "homology.txt", "stars": "stars.txt", "function": "function.txt"}))
    flags = ["--haplotype-info", "--consistency-check", "--read-voting", "--phase-disambiguate", "--het-check", "--cn-classifier", "--clip-evidence", "--d7-depth", "--af-phasing", "--read-phasing", "--diplotype-caller", "--print"]
    cli.main(["-i", str(tmp_path / "reads.parquet"), "-o", str(tmp_path / "out"), "-d", str(d), *flags], spark)
    found = sinks.read_json("\n".join(r[0] for r in spark.read.text(str(tmp_path / "out" / "json")).collect()))
    assert {s: (x["Total_CN"], x["CNV_group"], x["Genotype"], x["Filter"], x["CNV_consensus"]) for s, x in found.items()} == {"het": (4, "cn2", "*1/*2", "PASS", "2,2,2,2,2"), "three": (5, "cn3", "*1/*1x2", "PASS", "2,3,3,3,3")}
    assert found["het"]["Variant_raw_count"] == {"g.42128000G>T": "15(8:7),15"} and found["het"]["d67_snp_call"].split(",") == ["2"] * 117
    text = spark.read.text(str(tmp_path / "out" / "tsv" / "sample=het"), wholetext=True).first()[0]
    assert "Haplotype\tActivity value" in text and "\n*2\t0.0\tnone\tx\ty\n" in text
    tables = {t: {r["sample_id"]: r for r in spark.read.parquet(str(tmp_path / "out" / t)).collect()} for t in diagnostics.TABLES if (tmp_path / "out" / t).exists()}
    assert tables["cn_classifier"]["het"]["label"] == "cn2" and tables["het_check"]["het"]["hemizygous"] is False and set(tables["d7_depth"]) == {"het", "three"}
    best = spark.read.parquet(str(tmp_path / "out" / "diplotype_caller")).where("rank = 1 and sample_id = 'het'").first()
    assert {best["a"], best["b"]} == {"*1", "*2"}
    assert cli.main(["-i", str(tmp_path / "no" / "such"), "-o", str(tmp_path / "empty"), "-d", str(d)], spark) is None
    assert spark.read.text(str(tmp_path / "empty" / "json")).first()[0] == "{}"


def test_counts_from_files(spark, tmp_path):
    (tmp_path / "a_count.txt").write_text("1 0 5 x norm 7\n1 0 5 x norm 9\nshort\n")
    (tmp_path / "b_count.txt").write_text("1 0 5 x norm 8\n")
    assert sorted(map(tuple, T.count_files(spark, str(tmp_path)).collect())) == [("a", "x", 7), ("b", "x", 8)]


def test_kmer_counts(spark):
    panel = spark.createDataFrame([("AAC", "first", 3), ("GTT", "first", 3), ("CCC", "second", 3), ("GGG", "second", 3)], "kmer string, source string, k int")
    reads = spark.createDataFrame([base("s", 0, 42_125_000, "A", 0)[:8] + ([("M", 6)], "AACCCG", [30] * 6), base("s", 1, 1, "A", 0)], READS)
    reads = reads.withColumn("end_pos", F.col("pos") + F.length("seq"))
    got = diagnostics.kmer_counts(reads, T.Resources(*[None] * 6, panel=panel)).collect()
    assert sorted((r["n1"], r["n2"]) for r in got) == [(0, 1), (1, 0)]
