"""Side tables beside a call: what else the reads say, one table for each kind, none of which changes a result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.functions.scalar import fraction, reverse_complement, star_parts
from paraloom.operators import calls as C
from paraloom.operators import evidence as E
from paraloom.operators import intervals as I
from paraloom.operators import match as M
from paraloom.operators import reads as R
from paraloom.operators import site_index as X
from paraloom.operators.sides import small
from paraloom.plans import genotype
from paraloom.sources.tables import Resources, variant_bases

PARALOG, LN10 = "paralog", math.log(10)
#: Pairs of alleles that the search of a sample keeps.
BEST = 20
CLIP_REGION, KMER_REGIONS = (42123000, 42146000), ((42123000, 42132000), (42135000, 42146000))


def het_check(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, n_sites, n_het, hemizygous)."""
    observed = X.observe(reads, X.site_rows(res.sites, "sites"))
    sites = genotype.source_counts(observed, calls, res.sites, "sites", (1, 2), 0)
    return C.hemizygous(sites.withColumn("ratio", fraction(F.col("n1"), F.col("n2"), 10)), ["sample_id"], "ratio")


def clip_evidence(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, a flag per zone, n_clusters, most_reads) of soft clips at either end of reads."""
    use = reads.where((F.col("flag").bitwiseAND(I.NOT_PILEUP) == 0) & (F.col("chrom") == res.chrom) & (F.col("pos") < CLIP_REGION[1]) & (F.col("end_pos") > CLIP_REGION[0]))
    ends = F.array(F.struct(F.lit("L").alias("side"), F.get("cigar", F.lit(0)).alias("c"), F.col("pos").alias("at")), F.struct(F.lit("R").alias("side"), F.element_at("cigar", -1).alias("c"), F.col("end_pos").alias("at")))
    clips = use.where(F.size("cigar") > 0).select("sample_id", F.explode(ends).alias("e")).where("e.c.op = 'S'").select("sample_id", "e.side", F.col("e.c.len").alias("len"), F.col("e.at").alias("pos"))
    return E.clip_signals(R.clip_clusters(clips, ["sample_id"], "pos", "side", "len"), ["sample_id"])


def d7_depth(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, exon9_ratio, prime_ratio, exon9_elevated, three_prime_depleted)."""
    regions = reads.sparkSession.createDataFrame([(res.chrom, n, a, b) for n, (a, b) in E.SUBREGIONS.items()], "chrom string, name string, start long, end long")
    return E.subregion_signals(I.region_read_counts(reads, regions, ["sample_id"]), ["sample_id"])


def _target_counts(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    named = res.targets.select("idx", F.col("label").alias("name"))
    observed = X.observe(reads, X.site_rows(res.targets, "targets"))
    return genotype.source_counts(observed, calls, res.targets, "targets", (1,), 10).join(small(named), "idx")


def af_phasing(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, name, copies): copies of each heterozygous variant in samples of three copies or more."""
    rows = _target_counts(reads, res, calls).join(calls.select("sample_id", (F.col("total_cn") - 2).alias("cn")), "sample_id")
    return R.allele_copies(rows, "n1", "n2", "cn").where("copies is not null").select("sample_id", "name", "copies")


def read_phasing(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, pattern, n): which called variants stand together on fragments."""
    called = calls.select("sample_id", F.explode(F.array_distinct("names")).alias("name"))
    states = E.variant_states(reads, variant_bases(res.targets), res.chrom).join(called, ["sample_id", "name"], "left_semi")
    return R.phasing_modes(states, ["sample_id"], "qname", "name", "alt")


def phasing_scores(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, place, candidate, consistent and inconsistent modes and reads, score, best, phasing_flag): how well each alternative of a call explains its fragments."""
    modes = genotype.cut(read_phasing(reads, res, calls))
    return E.phasing_scores(modes, calls.select("sample_id", "genotype"), res.stars)


def cn_classifier(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, label, confidence)."""
    return E.classify_profiles(calls.where("total_cn is not null"), "sample_id")


def kmer_counts(reads: DataFrame, res: Resources) -> DataFrame:
    """(sample_id, idx, n1, n2): a panel's k-mers of either source in the reads of both regions, on both strands."""
    inside = [(F.col("pos") < b) & (F.col("end_pos") > a) for a, b in KMER_REGIONS]
    use = I.primary(reads).where((F.col("chrom") == res.chrom) & (inside[0] | inside[1]))
    k = res.panel.agg(F.max("k")).first()[0]  # one number
    place = F.least("kmer", reverse_complement(F.col("kmer")))
    panel = res.panel.select("kmer", "source", F.dense_rank().over(Window.orderBy(place)).alias("idx"))  # the panel, thousands of rows
    hits = M.kmer_hits(use, ["sample_id"], "seq", panel, k)
    of = lambda s: F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0))
    return hits.groupBy("sample_id", "idx").agg(of("first").alias("n1"), of("second").alias("n2"))


def kmer_validation(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame | None:
    """(sample_id, overall_ratio, estimated_cn, category, agrees, hybrid); nothing without a panel."""
    if res.panel is None:
        return None
    return E.kmer_validation(kmer_counts(reads, res), calls.where("tag is not null").select("sample_id", "tag", "total_cn"), ["sample_id"])


def diplotype_caller(reads: DataFrame, res: Resources, calls: DataFrame) -> DataFrame:
    """(sample_id, a, b, total, rank, posterior): pairs of alleles beside the paralog, by the likelihood of each fragment.

    The paralog is one more allele, whose variants are the second source's bases at the sites that tell the sources apart.
    """
    single = (F.length(F.get("alleles1", F.lit(0))) == 1) & (F.length(F.get("alleles2", F.lit(0))) == 1)
    apart = res.sites.where(single).select(F.concat(F.lit("s"), F.col("idx").cast("string")).alias("name"), F.explode(F.array("pos1", "pos2")).alias("pos"), F.get("alleles1", F.lit(0)).alias("ref"), F.get("alleles2", F.lit(0)).alias("alt"), F.lit(False).alias("is_deletion"))
    sites = E.vote_sites(res.targets.select(F.col("label").alias("name"))).unionByName(apart)
    paralog = apart.agg(F.collect_set("name").alias("parts")).select(F.lit(-1).alias("ord"), F.lit(PARALOG).alias("name"), "parts")
    stars = genotype.cut(res.stars.select(F.col("ord").cast("int").alias("ord"), "name", "parts").unionByName(paralog))
    observed = genotype.cut(E.vote_observations(reads, sites, res.chrom))
    scores = genotype.cut(E.vote_scores(observed, sites, stars))
    other = scores.where(F.col("allele") == PARALOG).select("sample_id", "qname", F.col("ll").alias("lo"))
    per = observed.groupBy("sample_id", "qname").agg(F.count("*").alias("n"))
    # fragments that neither an allele nor the paralog explains are left out
    well = R.well_mapped(scores.join(per, ["sample_id", "qname"]), ["sample_id"], "qname", "ll", "n")
    ll = scores.where(F.col("allele") != PARALOG).join(other, ["sample_id", "qname"]).join(well, ["sample_id", "qname"], "left_semi").join(calls.select("sample_id", F.col("total_cn").alias("copies")), "sample_id")
    natural = ll.select("sample_id", "qname", "allele", (F.col("ll") * LN10).alias("la"), (F.col("lo") * LN10).alias("lo"), "copies")
    return R.posteriors(R.paralog_mixture(natural, ["sample_id"], "qname", "allele", "la", "lo", "copies", BEST), ["sample_id"], "total", BEST)


def haplotype_details(called: DataFrame, function: DataFrame) -> DataFrame:
    """(sample_id, haplotype, activity, function, evidence_strength, evidence_summary) of the alleles of each genotype."""
    names = called.select("sample_id", F.explode(star_parts(F.col("genotype"))).alias("haplotype"))
    columns = ["activity", "function", "evidence_strength", "evidence_summary"]
    have = [(F.col(c) if c in function.columns else F.lit(None).cast("string")).alias(c) for c in columns]
    return names.join(function.select("haplotype", *have), "haplotype", "left").select("sample_id", "haplotype", *columns)


TABLES = {
    "het_check": het_check, "clip_evidence": clip_evidence, "d7_depth": d7_depth, "af_phasing": af_phasing, "read_phasing": read_phasing, "phasing_scores": phasing_scores, "cn_classifier": cn_classifier, "kmer_validation": kmer_validation,
    "diplotype_caller": diplotype_caller,
}
