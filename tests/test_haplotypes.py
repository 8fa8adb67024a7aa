"""Haplotype callers and confidence on toy rows."""

import pytest
from pyspark.sql import functions as F

from paraloom.operators import calls as C
from paraloom.operators import haplotypes as H
from tests.test_operators import READS, read


def test_motifs(spark):
    left, right = "AC", "GG"
    rows = [read(f"r{k}", 42128850, [("M", 40)], left + m + right, flag=f) for k, (m, f) in enumerate([(H.INSERTION_MOTIFS["long"], 0), (H.INSERTION_MOTIFS["short"], 0), (H.INSERTION_MOTIFS["short"], 0), (H.INSERTION_MOTIFS["none"], 0x400), (H.INSERTION_MOTIFS["none"], 0x100), ("ACGT", 0)])]
    got = H.motif_counts(spark.createDataFrame(rows, READS), "22")
    assert tuple(got.first())[1:] == (1, 2, 1)
    counts = spark.createDataFrame([("s1", H.INSERTION_NAMES["long"], 9, 9), ("s1", H.INSERTION_NAMES["short"], 9, 9), ("s1", "other", 9, 9)], "sample_id string, name string, n1 long, n2 long")
    assert {r["name"]: (r["n1"], r["n2"]) for r in H.insertion_counts(counts, got).collect()} == {H.INSERTION_NAMES["long"]: (1, 3), H.INSERTION_NAMES["short"]: (2, 2), "other": (9, 9)}


def patterns(spark, *rows):
    return spark.createDataFrame([(s, p) for s, p, n in rows for _ in range(n)], "sample_id string, pattern string")


def test_938(spark):
    last = spark.createDataFrame([("a", 10, 30), ("b", 10, 30), ("c", 20, 20)], "sample_id string, n1 long, n2 long")
    totals = spark.createDataFrame([(s, 4) for s in "abc"], "sample_id string, total_cn int")
    got = H.call_938(last, totals, patterns(spark, ("a", "1x2", 2), ("a", "x12", 2), ("b", "1x2", 1), ("c", "112", 5))).collect()
    assert {r["sample_id"]: (r["copies"], r["cis_938"]) for r in got} == {"a": (1, True), "b": (0, False), "c": (0, False)}


def test_526(spark):
    counts = spark.createDataFrame([(s, 20, 20, 20, 20) for s in "abc"], "sample_id string, a1 long, r1 long, a2 long, r2 long")
    tags = spark.createDataFrame([(s, "cn2") for s in "abc"], "sample_id string, tag string")
    got = H.call_526_556(counts, tags, patterns(spark, ("a", "211", 2), ("a", "221", 2), ("b", "221", 2), ("c", "2x1", 9))).collect()
    assert {r["sample_id"]: (r["n526"], r["n556"]) for r in got} == {"a": (1, 0), "b": (1, 1), "c": (0, 0)}


def test_803_and_insertion(spark):
    tags = spark.createDataFrame([("a", "cn2"), ("b", "cn3")], "sample_id string, tag string")
    got = H.trans_803(tags, patterns(spark, ("a", "12", 2), ("a", "21", 2), ("b", "12", 2), ("b", "21", 2))).collect()
    assert {r["sample_id"]: r["trans_803"] for r in got} == {"a": True, "b": False}
    far = spark.createDataFrame([("a", 0, 5), ("b", 3, 9), ("c", 2, 6)], "sample_id string, first long, second long")
    near = spark.createDataFrame([("a", 1, 20), ("c", 10, 3)], "sample_id string, aa long, a long")
    assert {r["sample_id"]: r["copies"] for r in H.call_inserted_a(far, near).collect()} == {"a": 1, "b": 0, "c": 2}


def test_confidence_parts(spark):
    x = spark.range(1).select(
        C.depth_score(F.lit(60.0), F.lit(0.05)).alias("d"), C.depth_score(F.lit(5.0), F.lit(0.2)).alias("d5"), C.rounding_score(F.lit(4.05), F.lit(2.02)).alias("good"), C.rounding_score(F.lit(4.45), F.lit(2.48)).alias("bad"),
        C.match_score(F.lit("unique_match"), F.lit("PASS")).alias("m"), C.match_score(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("n"), C.match_score(F.lit("unique_star"), F.lit("PASS")).alias("s"),
    ).first()
    assert x["d"] == pytest.approx(1) and x["d5"] == pytest.approx(0.2 * 0.65) and x["good"] > 0.9 and x["bad"] < 0.5 and x["m"] == 1 and x["n"] < 0.1 and x["s"] == 0.5


def test_variant_scores(spark):
    stars = spark.createDataFrame([("*1", []), ("*2", ["v1", "v2", "exon9gc"])], "name string, parts array<string>")
    calls = spark.createDataFrame([("a", "*1/*2x2;*1/*1"), ("b", "*1/*1"), ("c", None)], "s string, genotype string")
    counts = spark.createDataFrame([("a", "v1", 10, 10), ("a", "v2", 0, 20), ("a", "v3", 10, 10), ("a", "v4", 1, 2), ("b", "v3", 10, 10)], "s string, name string, alt long, ref long")
    got = {r["s"]: (r["completeness"], r["specificity"]) for r in C.variant_scores(calls, counts, stars, ["s"]).collect()}
    assert got == {"a": (0.5, pytest.approx(0.2)), "b": (1.0, 1.0), "c": (0.1, 1.0)}
    sites = spark.createDataFrame([("a", k * 1.0) for k in range(12)] + [("b", 0.4)], "s string, v double")
    assert {r["s"]: r["consistency"] for r in C.consistency_score(sites, ["s"], "v").collect()} == {"a": 1.0, "b": 0.5}
