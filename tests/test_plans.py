"""The genotype plan, loaders, sinks and streaming on toy tables that are no clinical data."""

import gzip
import io
import json
import struct

import pytest
from pyspark.sql import functions as F

from paraloom.operators import models as P
from paraloom.plans import genotype as G
from paraloom.sources import alignment, sinks
from paraloom.sources import tables as T
from paraloom.streaming import ingest


@pytest.fixture
def files(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return put


def test_loaders(spark, files):
    reg = T.regions(spark, files("r.bed", "chr22\t10\t20\tX_hapcn2\td67\t0.5\nbad line\nchr1\t1\t3\tn1\tnorm\t0.4\n")).orderBy("ord").collect()
    assert [(r["chrom"], r["start"], r["name"], r["region_type"]) for r in reg] == [("22", 10, "X_hapcn2", "d67"), ("1", 1, "n1", "norm")]
    par = T.model_parameters(spark, files("p.txt", "d67 shift 0.9\nd67\tmean\t2:1.0 3:1.5\nd67 mean 2:7\n")).collect()
    assert {(r["param"], r["cn"]): r["value"] for r in par} == {("shift", None): 0.9, ("mean", 2): 1.0, ("mean", 3): 1.5}
    site_file = files("s.txt", "#chr a b c d e\nchr22\t101\tg,t\t201\ta\tone\nchr22\t103\tac\t203\tgg\t-\nchr22\t105\tc\t205\tt\tone\n")
    rows = T.sites(spark, site_file).orderBy("idx").collect()
    assert [(r["idx"], r["pos1"], r["alleles1"], r["pos2"], r["alleles2"]) for r in rows] == [(0, 100, ["G", "T"], 200, ["A"]), (1, 102, ["AC"], 202, ["CC"]), (2, 104, ["C"], 204, ["T"])]
    assert [(r["idx"], r["pos1"]) for r in T.sites(spark, site_file, group="one").orderBy("idx").collect()] == [(0, 100), (1, 104)]
    assert [r["name"] for r in T.variant_names(spark, site_file, site_file).orderBy("ord").collect()] == ["one", "-", "one"] * 2
    stars = T.star_items(spark, files("t.txt", "*1\tNA\tNormal\n*2\tb\ta\tNormal\n")).orderBy("ord").collect()
    assert [(r["name"], r["parts"]) for r in stars] == [("*1", []), ("*2", ["a", "b"])]
    freq = files("f.txt", "allele\tA\tB\n*1\t0.5\t\n*2\t0.12345\t1\n")
    assert {(r["allele"], r["grp"]): r["p"] for r in T.wide_frequencies(spark, freq).select("allele", "grp", T.percent(F.col("freq")).alias("p")).collect()} == {("*1", "A"): "50.0%", ("*1", "B"): "", ("*2", "A"): "12.345%", ("*2", "B"): "100.0%"}
    counts = T.count_file(spark, files("c.txt", "1 0 5 a x 7\n1 0 5 b x 8\n1 0 5 a x 9\nshort line\n")).collect()
    assert {r["name"]: r["count"] for r in counts} == {"a": 7, "b": 8}
    fun = T.haplotype_function(spark, files("h.txt", "Haplotype\tActivity\tFunction\tS\tE\n*1\t≥1.0\tnormal\tx\ty\n")).first()
    assert (fun["haplotype"], fun["activity"]) == ("*1", "1.0")
    panel = T.diagnostic_panel(spark, files("k.json", json.dumps({"k": 3, "n_diagnostic": 1, "positions": [{"aln_pos": 1, "cyp2d6_kmer": "AAC", "cyp2d7_kmer": None, "kmer_unique": True}, {"aln_pos": 2, "cyp2d6_kmer": "TTT", "cyp2d7_kmer": "CCC", "kmer_unique": False}]})))
    assert sorted((r["kmer"], r["source"]) for r in panel.collect()) == [("AAC", "first"), ("GTT", "first")]
    contigs = spark.createDataFrame([(0, "1"), (7, "chr2")], "ord int, name string")
    assert not T.uses_chr(contigs).first()[0] and T.uses_chr(contigs.withColumn("ord", F.lit(1))).first()[0]


def test_sinks(spark, tmp_path):
    calls = spark.createDataFrame([("s1", "*1/*2;*1/*9", "More_than_one_possible_genotype", 0.756, "HIGH", "cn2", 2, True, ["*1_*2", "*1_*9"], "1.5;1.0", "N;I"), ("s2", None, None, None, None, None, None, None, None, None, None)], "sample_id string, genotype string, filter string, confidence double, confidence_label string, tag string, n_alternatives int, reflex boolean, candidates array<string>, activity string, phenotype string")
    sinks.write_json(calls, str(tmp_path / "j"))
    found = sinks.read_json("\n".join(r[0] for r in spark.read.text(str(tmp_path / "j")).collect()))
    assert set(found) == {"s1", "s2"} and all(list(x) == list(sinks.JSON_KEYS) for x in found.values())
    assert (found["s1"]["Confidence"], found["s1"]["Phasing_ambiguous"], found["s1"]["Clinical_equivalence"], found["s1"]["Raw_star_allele"]) == ("0.76", True, "different_effect", ["*1_*2", "*1_*9"])
    assert found["s2"]["Genotype"] is None and found["s2"]["Clinical_equivalence"] == "n/a"
    haplotypes = spark.createDataFrame([("s1", "*1", "1.0", "normal", "x", "y"), ("s1", "*2", "0.5", "less", "x", None), ("s2", "*3", "0", "no", "x", "y")], "sample_id string, haplotype string, activity string, function string, evidence_strength string, evidence_summary string")
    frequencies = spark.createDataFrame([("s1", "B", "*1", "50.0%"), ("s1", "A", "*1", "40.0%"), ("s1", "A", "*1/*2", "1.0%")], "sample_id string, grp string, name string, percent string")
    sinks.write_tsv(calls, str(tmp_path / "t"), haplotypes, frequencies)
    head = "\t".join(sinks.TSV_COLUMNS)
    assert [r[0] for r in spark.read.text(str(tmp_path / "t" / "sample=s1"), wholetext=True).collect()] == [
        f"{head}\ns1\t*1/*2;*1/*9\tMore_than_one_possible_genotype\t0.76 (HIGH)\t1.5;1.0\tN;I\ttrue\ttrue\n\nHaplotype\tActivity value\tFunction\tEvidence strength\tEvidence summary\n*1\t1.0\tnormal\tx\ty\n*2\t0.5\tless\tx\t\n"
        "\nBiogeographic group\t*1\t*1/*2\nA\t40.0%\t1.0%\nB\t50.0%\t\n"
    ]
    assert spark.read.text(str(tmp_path / "t" / "sample=s2"), wholetext=True).first()[0] == f"{head}\ns2\tNone\tNone\t0.00 (LOW)\t-\t-\tfalse\tfalse\n"
    assert "s1" in sinks.console_report(calls)
    sinks.write_json(calls.limit(0), str(tmp_path / "j0"))
    sinks.write_tsv(calls.limit(0), str(tmp_path / "t0"))
    assert spark.read.text(str(tmp_path / "j0")).collect()[0][0] == "{}" and spark.read.text(str(tmp_path / "t0")).collect()[0][0] == head
    assert sorted(map(tuple, T.all_samples(spark.createDataFrame([("s0",), ("s1",)], "sample_id string"), calls.select("sample_id", "filter")).collect())) == [("s0", None), ("s1", "More_than_one_possible_genotype")]


def test_read_length(spark):
    row = lambda s, k, pos, n: (s, f"{s}{k}", 0, "22", pos, pos + n, 60, 0, [("M", n)], "A" * n, [1] * n)
    reads = spark.createDataFrame([row("a", k, 100 + k, 10 + k) for k in range(3)] + [row("a", 9, 900, 50), row("b", 0, 900, 7)], T.READS)
    regions = spark.createDataFrame([(0, "22", 0, 50, "d67"), (1, "22", 90, 200, "spacer"), (2, "22", 800, 950, "norm")], "ord int, chrom string, start long, end long, region_type string")
    assert {r["sample_id"]: r["read_length"] for r in T.read_length(reads, regions).collect()} == {"a": 11.0, "b": 150.0}
    assert {r["sample_id"]: r["read_length"] for r in T.read_length(reads).collect()} == {"a": 11.5, "b": 7.0}


def bam(contigs, rows):
    """A BAM file's bytes: contigs, then (name, flag, contig, pos, mapq, tlen, cigar, seq)."""
    codes, ops = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(contigs)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 1000) for c in contigs)
    for name, flag, contig, pos, mapq, tlen, cigar, seq in rows:
        packed = bytes(codes.index(a) << 4 | codes.index(b) for a, b in zip(seq[::2], (seq + "=")[1::2], strict=False))
        body = struct.pack("<iiBBHHHiiii", contig, pos, len(name) + 1, mapq, 0, len(cigar), flag, len(seq), -1, -1, tlen) + name.encode() + b"\0"
        body += b"".join(struct.pack("<I", n << 4 | ops.index(op)) for op, n in cigar) + packed + bytes(range(len(seq)))
        out += struct.pack("<i", len(body)) + body
    return out


def test_bam(spark, tmp_path):
    rows = [("r1", 16, 0, 100, 60, 300, [("S", 2), ("M", 5), ("D", 3), ("M", 4)], "ACGTNACGTAC"), ("r2", 4, -1, -1, 0, 0, [], "AC"), ("r3", 0, 1, 7, 9, -5, [("M", 4)], "TTGA")]
    whole = bam(["chr22", "2"], rows)
    # two members, as a blocked file has them
    (tmp_path / "one.bam").write_bytes(gzip.compress(whole[:77]) + gzip.compress(whole[77:]))
    (tmp_path / "cut.bam").write_bytes(gzip.compress(whole[:-3]))
    got = alignment.read_bam(spark, str(tmp_path / "*.bam")).orderBy("sample_id", "qname").collect()
    assert [(r["sample_id"], r["qname"], r["flag"], r["chrom"], r["pos"], r["end_pos"], r["mapq"], r["tlen"], r["seq"]) for r in got] == [
        ("cut", "r1", 16, "22", 100, 112, 60, 300, "ACGTNACGTAC"), ("one", "r1", 16, "22", 100, 112, 60, 300, "ACGTNACGTAC"), ("one", "r3", 0, "2", 7, 11, 9, -5, "TTGA")
    ]
    assert [(c["op"], c["len"]) for c in got[0]["cigar"]] == [("S", 2), ("M", 5), ("D", 3), ("M", 4)] and got[0]["qual"] == list(range(11))
    assert got[0].asDict().keys() == {f.split(" ")[0] for f in T.READS.split(", ")}
    with pytest.raises(ValueError):
        list(alignment.records(io.BytesIO(b"nothing at all")))


STARS = [(0, "*1", []), (1, "*2", ["g.1A>C", "g.2A>C"]), (2, "*3", ["g.1A>C"]), (3, "*4", ["g.3C>T", "g.42130692G>A"]), (4, "*10", ["g.4A>C"]), (5, "*36", ["exon9gc", "g.42126611C>G", "g.4A>C"]), (6, "*4.013", ["exon9gc", "g.3C>T"])]


def test_matching(spark):
    stars = spark.createDataFrame(STARS, "ord int, name string, parts array<string>")
    tables = G.dictionaries(stars)
    seen = [
        ("a", "cn2", ["g.1A>C", "g.2A>C"]), ("b", "star5", ["g.1A>C"]), ("c", "cn3", ["g.1A>C", "g.1A>C"]), ("d", "exon9hyb", ["g.4A>C", "g.4A>C"]), ("e", "star68", ["g.3C>T", "g.42130692G>A", "g.42130692G>A"]), ("f", "cn2", ["g.9A>C"]),
        ("g", "cn3", ["g.4A>C", "g.1A>C"]), ("h", "exon9hyb_exon9hyb", ["g.4A>C"] * 4), ("i", "cn2", []), ("j", "cn2", ["g.1A>C", "g.2A>C", "g.9A>C"]),
    ]
    rows = spark.createDataFrame(seen, "sample_id string, tag string, names array<string>")
    totals = spark.createDataFrame([(s, 4, 2, False) for s, *_ in seen], "sample_id string, total_cn int, spacer_cn int, high_cn boolean")
    got = {}
    for fuzzy in (False, True):
        options = G.Options(fuzzy_match=fuzzy)
        matched = G.match_stars(rows, tables, stars, options)
        got[fuzzy] = {r["sample_id"]: (r["call_info"], r["genotype"], r["filter"]) for r in G.genotypes(matched, totals, options).collect()}
    plain = got[False]
    assert plain["a"] == ("unique_match", "*1/*2", "PASS")
    assert plain["b"] == ("unique_match", "*3/*5", "PASS")
    assert plain["c"] == ("unique_match", "*1/*3x2", "PASS")
    assert plain["d"] == ("unique_match", "*1/*36+*10", "PASS")
    assert plain["e"][1] == "*1/*68+*4"
    assert plain["f"] == ("no_match", None, None)
    # one more copy of either variant gives a match, so there is no single rescue
    assert plain["g"][0] == "no_match"
    assert plain["h"] == ("unique_match", "*36+*10/*36+*10", "PASS")
    assert plain["i"] == ("unique_match", "*1/*1", "PASS")
    assert plain["j"][0] == "no_match" and got[True]["j"] == ("fuzzy_match(score=1.7)", "*1/*2", "Fuzzy_match")


def test_depth_and_copies(spark):
    rows = []
    for s, gene in (("s1", 4), ("s2", 3)):
        rows += [(s, k, f"n{k}", "norm", 0, 1000, 0.3 + k / 100, 300) for k in range(40)]
        rows += [(s, 50, "gene_hapcn2", "d67", 0, 1000, 0.5, 300 * gene // 2), (s, 51, "other", "d67", 0, 500, 0.5, 0)]
    counts = spark.createDataFrame(rows, "sample_id string, ord int, name string, region_type string, start long, end long, gc double, count long")
    length = counts.select("sample_id").distinct().withColumn("read_length", F.lit(150.0))
    depth = G.normalised_depth(counts, length)
    # two haploid copies of length make depth half of the copies
    got = {r["sample_id"]: (round(r["depth"], 6), r["mad"], round(r["median_depth"], 6)) for r in depth.collect()}
    assert got == {"s1": (2.0, 0.0, 45.0), "s2": (1.5, 0.0, 45.0)}
    states = P.gmm_states(1.0, {2: 1.0, 3: 1.5}, {0: 0.001, 1: 0.001, 2: 0.3, 3: 0.3, 4: 0.3}, 0.056)
    total = G.region_copies(depth.withColumn("depth", F.col("depth") * 2), "d67", states, 1.0, "total_cn").collect()
    assert {r["sample_id"]: r["total_cn"] for r in total} == {"s1": 4, "s2": 3}


def test_structural_plan(spark):
    rows = [(s, i, *(n if i < 9 else m)) for s, n, m in (("normal", (30, 30), (30, 30)), ("hybrid", (24, 36), (36, 24))) for i in range(117)]
    counts = spark.createDataFrame(rows, "sample_id string, idx int, n1 long, n2 long")
    totals = spark.createDataFrame([("normal", 4, 2), ("hybrid", 5, 3)], "sample_id string, total_cn int, spacer_cn int")
    exon9 = spark.createDataFrame([("normal", None), ("hybrid", None)], "sample_id string, exon9_cn int")
    sites = G.site_copies(counts, totals)
    for options in (G.Options(), G.Options(hmm_cnv=True, changepoint_hybrid=True)):
        got = {r["sample_id"]: r["tag"] for r in G.structural_calls(sites, totals, exon9, options).collect()}
        assert got == {"normal": "cn2", "hybrid": "exon9hyb"}


def test_variant_plan(spark):
    rows = [("s", 0, 42127000, "g.x", 30, 30, 15, 15), ("s", 1, 42127001, "g.42128325A>G", 30, 30, 30, 0), ("s", 2, 42127002, "g.42127941G>A", 3, 60, 2, 1)]
    counts = spark.createDataFrame(rows, "sample_id string, idx int, pos long, name string, n1 long, n2 long, n1_fwd long, n1_rev long")
    tags = spark.createDataFrame([("s", "cn2")], "sample_id string, tag string")
    for options in (G.Options(), G.Options(strand_bias_all=True)):
        assert {r["name"]: r["cn"] for r in G.variant_copies(counts, tags, options).collect()} == {"g.x": 1, "g.42128325A>G": 0, "g.42127941G>A": 0}


def test_phenotypes(spark):
    calls = spark.createDataFrame([("a", "*1/*2"), ("b", "*1/*2;*1/*9"), ("c", None), ("d", "*2/*7")], "sample_id string, genotype string")
    toy = spark.createDataFrame([("*1", "1.0"), ("*2", "0.5"), ("*9", "0.0"), ("*7", "n/a")], "haplotype string, activity string")
    got = {r["sample_id"]: (r["activity"], r["phenotype"], r["n_alternatives"], r["reflex"]) for r in G.phenotypes(calls, toy).collect()}
    assert got == {"a": ("1.5", "Normal Metabolizer", 1, False), "b": ("1.5;1.0", "Normal Metabolizer;Intermediate Metabolizer", 2, True), "d": ("n/a", "Indeterminate", 1, False)}
    freq = spark.createDataFrame([("*1", "X", 0.5), ("*1/*2", "X", None)], "allele string, grp string, freq double")
    assert {(r["sample_id"], r["name"], r["percent"]) for r in G.frequencies(calls.where("sample_id = 'a'"), freq.where("allele = '*1'"), freq.where("allele <> '*1'")).collect()} == {("a", "*1", "50.0%"), ("a", "*1/*2", "")}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("s", k, k % 3) for k in range(30)], "sample_id string, idx int, v int")
    rows.where("idx < 10").write.parquet(str(tmp_path / "in"))
    count = lambda b: b.groupBy("sample_id", "v").count()
    args = (spark, str(tmp_path / "in"), "sample_id string, idx int, v int", count, str(tmp_path / "out"), str(tmp_path / "cp"))
    ingest.follow(*args).awaitTermination(120)
    rows.where("idx >= 10").write.mode("append").parquet(str(tmp_path / "in"))
    ingest.follow(*args).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("sample_id", "v").agg(F.sum("count").alias("count"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, count(rows).collect()))
