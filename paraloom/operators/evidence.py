"""What single reads and whole calls say about a call: patterns along reads, consistency, phase, votes, clips, k-mers and profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.functions.scalar import allele_state, fraction, log10_base, main_allele, parse_variant, sort_pair, without_copies
from paraloom.operators import intervals as I
from paraloom.operators import segment as G
from paraloom.operators.calls import balance_deviation, conversion_map, mismatch_share
from paraloom.operators.match import nearest
from paraloom.operators.reads import phase_winner
from paraloom.operators.sides import small

# Zones in which clip clusters count, and parts of the second source whose depths are compared.
CLIP_ZONES = {"d6_body": (42126499, 42130881), "rep6_spacer": (42130881, 42132500), "spacer": (42132500, 42139500), "d7": (42139676, 42145745)}
SUBREGIONS = {"exon9": (42140600, 42142500), "in4_in8": (42139500, 42140600), "three_prime": (42139000, 42142455), "five_prime": (42142465, 42144575)}
# Profiles (total, spacer, exon 9, exon 9 to intron 4, intron 4 to intron 1, upstream) by tag, and how often each is learned.
CN_PROFILES = (
    ("cn2", 10, (4, 2, 2, 2, 2, 2)), ("cn3", 5, (5, 2, 3, 3, 3, 3)), ("cn4", 3, (6, 2, 4, 4, 4, 4)), ("star5", 3, (3, 2, 1, 1, 1, 1)), ("star5_star5", 1, (2, 2, 0, 0, 0, 0)),
    ("exon9hyb", 5, (5, 2, 2, 3, 3, 3)), ("exon9hyb_exon9hyb", 2, (6, 2, 2, 4, 4, 4)), ("exon9hyb_star5", 2, (4, 2, 1, 2, 2, 2)), ("star68", 3, (5, 3, 2, 2, 3, 3)), ("star68", 1, (5, 4, 2, 2, 3, 3)),
    ("star68", 1, (5, 4, 1, 2, 2, 3)), ("star68_star68", 1, (6, 2, 2, 2, 4, 4)), ("star13", 2, (4, 2, 2, 2, 2, 1)), ("dup_exon9hyb", 2, (6, 2, 3, 4, 4, 4)), ("dup_star68", 1, (6, 2, 3, 3, 4, 4)),
    ("star5_star68", 1, (4, 2, 1, 1, 2, 2)), ("star5_star68", 1, (4, 3, 1, 1, 2, 2)), ("star5_star68", 1, (4, 3, 1, 1, 1, 2)), ("star5_star13", 1, (3, 2, 1, 1, 1, 0)), ("dup_star13intron1", 1, (4, 1, 3, 3, 3, 2)), ("cn5", 1, (7, 2, 5, 5, 5, 5)),
)
PROFILE_NOISE, PROFILE_NEIGHBOURS = 0.3, 5
# Copies of the first source that a tag adds to or takes from total - 2 in terms of its k-mers.
KMER_SHIFT = {"star13": 0.5, "star13intron1": 0.5, "dup_star13": 0.5, "dup_star13intron1": 0.5, "star13_star13": 1.0, "star13intron1_star13intron1": 1.0}
VOTE_GAP, VOTE_PAIRS, VOTE_MAPQ = 5.0, 20, 10
DELETED = "*5"


# ---- patterns along reads ----


def read_patterns(reads: DataFrame, sites: DataFrame, both: bool, min_mapq: int) -> DataFrame:
    """(sample_id, qname, pattern): a character for each of the sites (idx 0 to n - 1): 1 or 2 for the source that the base tells, x for none."""
    at = I.two_coordinate(sites, "pos1", "pos2") if both else sites.withColumn("pos", F.col("pos1"))
    return patterns_along(I.site_bases(reads, at.select("idx", "chrom", "pos", "alleles1", "alleles2"), min_mapq), sites)


def patterns_along(found: DataFrame, sites: DataFrame) -> DataFrame:
    """read_patterns from what reads show at the sites."""
    own = I.haplotype_bases(found).groupBy("sample_id", "qname", "idx").agg(F.when(F.count_distinct("base") == 1, F.first("base")).alias("base"), F.first("alleles1").alias("a1"), F.first("alleles2").alias("a2"))
    char = F.when(F.array_contains("a2", F.col("base")), "2").when(F.array_contains("a1", F.col("base")), "1").otherwise("x")
    whole = own.groupBy("sample_id", "qname").agg(F.map_from_entries(F.collect_list(F.struct("idx", char.alias("c")))).alias("m"))
    size = F.broadcast(sites.agg(F.max("idx").alias("last")))  # one row
    chars = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("x")))
    return whole.crossJoin(size).select("sample_id", "qname", F.array_join(chars, "").alias("pattern"))


# ---- consistency of a call ----


def defining_variants(genotype: Column, stars: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, hap, allele, name): the variants that define the alleles of a genotype's two sides; tandem copies stand once each."""
    sides = calls.select(*keys, F.posexplode(F.split(genotype, "/")).alias("hap", "side"))
    alleles = sides.select(*keys, "hap", F.explode(F.split("side", r"\+")).alias("allele")).withColumn("allele", without_copies(F.trim("allele")))
    return alleles.join(stars.select(F.col("name").alias("allele"), F.explode("parts").alias("name")), "allele")


def consistency_flags(calls: DataFrame, sites: DataFrame, counts: DataFrame, stars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, crossing_flag, conversion_flag, mismatch_flag, balance_flag, flag) of calls (keys, genotype, tag, total_cn).

    sites (keys, idx, n1, n2); counts (keys, name, alt, ref). The first flag that there is counts; crossings are counted but never flag.
    """
    ratios = sites.select(*keys, "idx", fraction(F.col("n1"), F.col("n2"), 10).alias("ratio"))
    switch = conversion_map(ratios, keys, "idx", "ratio").select(*keys, "chimeric")
    defining = defining_variants(F.col("genotype"), stars, calls, keys)
    seen = defining.join(counts, [*keys, "name"]).withColumn("depth", F.col("alt") + F.col("ref")).withColumn("vaf", F.try_divide(F.col("alt").cast("double"), F.col("alt") + F.col("ref")))
    mismatch = mismatch_share(seen, keys, "alt", "ref").select(*keys, F.col("share").alias("rate"))
    # variants of exactly one of two sides
    one_side = seen.groupBy(*keys, "name").agg(F.count_distinct("hap").alias("sides"), *[F.first(c).alias(c) for c in ("depth", "vaf", "alt", "ref")])
    het = one_side.where((F.col("sides") == 1) & (F.col("depth") >= 10) & (F.col("vaf") > 0.05) & (F.col("vaf") < 0.95))
    balance = balance_deviation(het, keys, "alt", "ref")
    met = calls.join(switch, keys, "left").join(mismatch, keys, "left").join(balance, keys, "left")
    percent = lambda x: F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("pct"))
    plain = (F.col("tag") == "cn2") & (F.col("total_cn") == 4) & (F.size(F.split("genotype", "/")) == 2)
    flags = {
        "crossing_flag": F.lit(None).cast("string"), "conversion_flag": F.when((F.col("tag") == "cn2") & F.col("chimeric"), "Conversion_map_chimeric_in_cn2"),
        "mismatch_flag": F.when(F.col("rate") > 0.50, F.concat(F.lit("Allele_mismatch_rate_"), percent(F.col("rate")))),
        "balance_flag": F.when(plain & (F.col("deviation") > 0.30), F.concat(F.lit("Allele_balance_deviation_"), percent(F.col("deviation")))),
    }
    return met.select(*keys, *[c.alias(n) for n, c in flags.items()]).withColumn("flag", F.coalesce(*flags))


def flagged_filter(current: Column, flag: Column) -> Column:
    """A passing filter replaced by a flag."""
    return F.when(current.isin("PASS", "Fuzzy_match"), F.coalesce(flag, current)).otherwise(current)


# ---- phase of two candidates ----


def phase_pairs(candidates: DataFrame, stars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, cis_first): variant pairs of which one of two candidate diplotypes (array `candidates`) has both on one side and the other has them apart."""
    two = candidates.where((F.size("candidates") == 2) & F.forall("candidates", lambda c: F.size(F.split(c, "_")) == 2))
    sides = two.select(*keys, F.posexplode("candidates").alias("option", "c")).select(*keys, "option", F.posexplode(F.split("c", "_")).alias("side", "allele"))
    held = sides.join(stars.select(F.col("name").alias("allele"), F.explode("parts").alias("v")), "allele").select(*keys, "option", "side", "v").distinct()
    a, b = held.withColumnRenamed("v", "a").withColumnRenamed("side", "sa"), held.withColumnRenamed("v", "b").withColumnRenamed("side", "sb")
    cis = a.join(b, [*keys, "option"]).where("a < b").groupBy(*keys, "a", "b", "option").agg(F.max(F.col("sa") == F.col("sb")).alias("cis"))
    both = cis.groupBy(*keys, "a", "b").agg(F.max(F.when(F.col("option") == 0, F.col("cis"))).alias("c0"), F.max(F.when(F.col("option") == 1, F.col("cis"))).alias("c1"))
    return both.where("c0 is not null and c1 is not null and c0 <> c1").select(*keys, "a", "b", F.col("c0").alias("cis_first"))


def variant_states(reads: DataFrame, variants: DataFrame, chrom: str) -> DataFrame:
    """(sample_id, qname, name, alt): whether a fragment has a variant (name, pos, alt, ref) or the reference; neither has no row."""
    at = variants.select(F.col("name").alias("idx"), F.lit(chrom).alias("chrom"), "pos", F.upper("alt").alias("v_alt"), F.upper("ref").alias("v_ref"))
    bases = I.site_bases(reads, at)
    seen = F.col("seq").substr(F.col("qpos").cast("int") + 1, F.greatest(F.length("v_alt"), F.length("v_ref")))
    told = bases.where(F.length(seen) > 0).select("sample_id", "qname", F.col("idx").alias("name"), allele_state(seen, F.col("v_alt"), F.col("v_ref")).alias("alt"))
    return told.where("alt is not null").groupBy("sample_id", "qname", "name").agg(F.max("alt").alias("alt"))


def phase_scores(pairs: DataFrame, states: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """(sample_id, option, score): fragments that speak for each of two options; a pair counts with `least` fragments and a clear majority."""
    a, b = states.select("sample_id", "qname", F.col("name").alias("a"), F.col("alt").alias("sa")), states.select("sample_id", "qname", F.col("name").alias("b"), F.col("alt").alias("sb"))
    met = pairs.join(a, ["sample_id", "a"]).join(b, ["sample_id", "qname", "b"])
    counted = met.groupBy("sample_id", "a", "b", "cis_first").agg(F.count_if(F.col("sa") & F.col("sb")).alias("cis"), F.count_if(F.col("sa") != F.col("sb")).alias("trans"))
    total = F.col("cis") + F.col("trans")
    clear = counted.where((total >= least) & (F.greatest("cis", "trans") >= share * total) & (F.col("cis") != F.col("trans")))
    option = F.when((F.col("cis") > F.col("trans")) == F.col("cis_first"), 0).otherwise(1)
    return clear.groupBy("sample_id", option.alias("option")).agg(F.sum(F.abs(F.col("cis") - F.col("trans"))).alias("score"))


def phased_calls(candidates: DataFrame, stars: DataFrame, reads: DataFrame, variants: DataFrame, chrom: str) -> DataFrame:
    """(sample_id, resolved): of two candidate diplotypes the one that single fragments bear out, as main alleles."""
    pairs = phase_pairs(candidates, stars, ["sample_id"])
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()
    states = variant_states(reads.join(pairs.select("sample_id").distinct(), "sample_id", "left_semi"), variants.join(wanted, "name", "left_semi"), chrom)
    best = phase_winner(phase_scores(pairs, states), ["sample_id"], "option", "score")
    chosen = F.get("candidates", F.col("option"))
    return candidates.join(best, "sample_id").select("sample_id", sort_pair(F.array_join(F.transform(F.split(chosen, "_"), main_allele), "/")).alias("resolved"))


def phasing_scores(modes: DataFrame, calls: DataFrame, stars: DataFrame, least: int = 3, lead: float = 1.0) -> DataFrame:
    """(sample_id, place, candidate, consistent_modes, inconsistent_modes, consistent_reads, inconsistent_reads, score, best, phasing_flag): how well each of a call's alternatives explains its fragments.

    modes (sample_id, pattern, n) as phasing_modes gives them, calls (sample_id, genotype). A mode is consistent if one side of the candidate has all of its alternatives and none of
    its references; modes of references only tell nothing. The score is the log odds of consistent reads, at most 10 either way, and 0 without any. The best has the highest, the first
    of equals; the flag names it where it is not the first candidate, `lead` ahead of the second and has `least` reads. Samples without modes have no rows; a candidate that has not two sides scores 0.
    """
    each = calls.where("genotype is not null").join(modes.select("sample_id").distinct(), "sample_id", "left_semi")
    each = each.select("sample_id", F.posexplode(F.split("genotype", ";")).alias("place", "c")).select("sample_id", "place", F.trim("c").alias("candidate"))
    sides = each.select("sample_id", "place", F.posexplode(F.split("candidate", "/")).alias("side", "x"))
    alleles = sides.select("sample_id", "place", "side", F.explode(F.split("x", r"\+")).alias("allele")).withColumn("allele", without_copies(F.trim("allele")))
    held = alleles.join(stars.select(F.col("name").alias("allele"), F.explode("parts").alias("v")), "allele").groupBy("sample_id", "place").agg(
        *[F.collect_set(F.when(F.col("side") == k, F.col("v"))).alias(f"v{k}") for k in (0, 1)]
    )
    nothing = F.array().cast("array<string>")
    two = each.join(held, ["sample_id", "place"], "left").select("sample_id", "place", "candidate", (F.size(F.split("candidate", "/")) == 2).alias("two"), *[F.coalesce(f"v{k}", nothing).alias(f"v{k}") for k in (0, 1)])
    word = lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), (F.substring_index(x, ":", -1) == "1").alias("alt"))
    seen = modes.select("sample_id", "n", F.transform(F.split("pattern", ","), word).alias("seen")).where(F.exists("seen", lambda x: x["alt"]))
    fits = lambda v: F.forall("seen", lambda x: x["alt"] == F.array_contains(v, x["name"]))
    met = two.join(seen, "sample_id", "left").withColumn("ok", F.when(F.col("two") & F.col("seen").isNotNull(), fits("v0") | fits("v1")))
    count = lambda ok, what: F.coalesce(F.sum(F.when(F.col("ok") == ok, what)), F.lit(0)).cast("long")
    counted = met.groupBy("sample_id", "place", "candidate").agg(
        count(True, F.lit(1)).alias("consistent_modes"), count(False, F.lit(1)).alias("inconsistent_modes"), count(True, F.col("n")).alias("consistent_reads"), count(False, F.col("n")).alias("inconsistent_reads")
    )
    good, bad = F.col("consistent_reads"), F.col("inconsistent_reads")
    scored = counted.withColumn("score", F.when(good + bad == 0, 0.0).when(bad == 0, 10.0).when(good == 0, -10.0).otherwise(F.ln(good / bad)))
    order = Window.partitionBy("sample_id").orderBy(F.desc("score"), "place")
    ranked = scored.withColumns({"k": F.row_number().over(order), "next": F.lead("score").over(order)})
    prefers = (F.col("k") == 1) & F.col("next").isNotNull() & (F.col("score") > F.col("next") + lead) & (good >= least) & (F.col("place") > 0)
    flag = F.when(prefers, F.concat(F.lit("Phasing_prefers_"), F.replace("candidate", F.lit("/"), F.lit("_"))))
    return ranked.select(*scored.columns, (F.col("k") == 1).alias("best"), flag.alias("phasing_flag"))


# ---- votes of reads ----


def vote_sites(names: DataFrame) -> DataFrame:
    """(name, pos, ref, alt, is_deletion): the variants that a single base tells, 0-based; insertions have no row."""
    v = parse_variant(F.col("name"))
    return names.select("name", v.alias("v")).where("v is not null").select("name", (F.col("v.pos") - 1).alias("pos"), F.col("v.ref").alias("ref"), F.col("v.alt").alias("alt"), F.col("v.is_deletion").alias("is_deletion"))


def vote_observations(reads: DataFrame, sites: DataFrame, chrom: str, min_mapq: int = VOTE_MAPQ, width: int = 1 << 10) -> DataFrame:
    """(sample_id, qname, name, base, quality): a base of a read at each site; a deleted one is null at sites of deletions, and no row elsewhere."""
    at = sites.select(F.col("name").alias("idx"), F.lit(chrom).alias("chrom"), F.col("pos").alias("pos"), "is_deletion")
    found = I.site_bases(reads, at, min_mapq).where(F.col("qpos") < F.length("seq"))
    place = F.col("qpos").cast("int")
    present = found.select("sample_id", "qname", F.col("idx").alias("name"), F.col("seq").substr(place + 1, F.lit(1)).alias("base"), F.coalesce(F.get("qual", place), F.lit(30)).alias("quality"), "pos", "chrom")
    use = I.primary(reads, min_mapq).where(F.col("flag").bitwiseAND(I.NOT_PILEUP) == 0)
    over = I.overlapping(use.withColumn("__s", F.col("pos")), at.where("is_deletion").select("idx", "chrom", F.col("pos").alias("site_pos")), "__s", "end_pos", "site_pos", width, ("chrom",))
    gone = over.select("sample_id", "qname", F.col("idx").alias("name"), "pos", "chrom").join(present.select("sample_id", "qname", "name", "pos", "chrom"), ["sample_id", "qname", "name", "pos", "chrom"], "left_anti")
    gone = gone.select("sample_id", "qname", "name", F.lit(None).cast("string").alias("base"), F.lit(30).alias("quality"))
    return present.select("sample_id", "qname", "name", "base", "quality").unionByName(gone)


def vote_scores(observed: DataFrame, sites: DataFrame, stars: DataFrame) -> DataFrame:
    """(sample_id, qname, allele, ll): log10 likelihood of each fragment under each allele.

    A fragment has its likelihood without any variant, and each allele adds what its variants change.
    """
    told = sites.select("name", "ref", "alt", "is_deletion").distinct()
    met = observed.join(told, "name").withColumn("q", F.col("quality").cast("double"))
    as_ref = F.when(F.col("is_deletion"), log10_base(F.col("q"), F.col("base").isNotNull())).otherwise(log10_base(F.col("q"), F.upper("base") == F.col("ref")))
    as_alt = F.when(F.col("is_deletion"), log10_base(F.col("q"), F.col("base").isNull())).otherwise(log10_base(F.col("q"), F.upper("base") == F.col("alt")))
    each = met.select("sample_id", "qname", "name", as_ref.alias("r"), (as_alt - as_ref).alias("d"))
    base = each.groupBy("sample_id", "qname").agg(F.sum("r").alias("r"))
    change = each.join(stars.select(F.col("name").alias("allele"), F.explode("parts").alias("name")), "name").groupBy("sample_id", "qname", "allele").agg(F.sum("d").alias("d"))
    grid = base.crossJoin(small(stars.select(F.col("name").alias("allele"))))
    return grid.join(change, ["sample_id", "qname", "allele"], "left").select("sample_id", "qname", "allele", (F.col("r") + F.coalesce("d", F.lit(0.0))).alias("ll"))


def vote_pairs(scores: DataFrame, most: int = VOTE_PAIRS) -> DataFrame:
    """(sample_id, a, b, score, rank): the best pairs of alleles, each fragment being of either with even chance; equals by name.

    Fragments with equal likelihoods vote together; the pairs of a sample are summed over a matrix of its fragments.
    """

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        wide = x.pivot_table(index="qname", columns="allele", values="ll").sort_index(axis=1)
        names, table = list(wide.columns), wide.to_numpy()
        table, weight = np.unique(np.round(table, 12), axis=0, return_counts=True)
        rows = []
        for i in range(len(names)):
            pair = np.logaddexp(table[:, i : i + 1] * np.log(10), table[:, i:] * np.log(10)) / np.log(10) + np.log10(0.5)
            rows += [(names[i], names[i + j], s) for j, s in enumerate((weight[:, None] * pair).sum(axis=0))]
        best = sorted(rows, key=lambda r: (-round(r[2], 6), r[0], r[1]))[:most]
        return pd.DataFrame([(*key, a, b, float(s), k + 1) for k, (a, b, s) in enumerate(best)], columns=["sample_id", "a", "b", "score", "rank"])

    return scores.groupBy("sample_id").applyInPandas(run, "sample_id string, a string, b string, score double, rank int")


def vote_flags(calls: DataFrame, pairs: DataFrame, stars: DataFrame, gap: float = VOTE_GAP) -> DataFrame:
    """(sample_id, rank, score_gap, vote_flag) of calls (sample_id, genotype): whether the votes' best pairs can be read as the call.

    A vote stands for an allele of the same main form, for one that no variants define, and for one whose variants it has all. A deleted side
    gives no fragments, so the other's alleles may be voted for twice; a call of two deleted sides is not judged.
    """
    sides = F.transform(F.split("genotype", "/"), lambda h: F.transform(F.split(h, r"\+"), lambda s: without_copies(F.trim(s))))
    held = calls.where(F.size(F.split("genotype", "/")) == 2).withColumn("sides", sides)
    gone = lambda k: F.array_contains(F.get("sides", F.lit(k)), DELETED)
    alive = lambda k: F.filter(F.get("sides", F.lit(k)), lambda s: s != DELETED)
    expected = F.when(gone(0), F.concat(alive(1), alive(1))).when(gone(1), F.concat(alive(0), alive(0))).otherwise(F.flatten("sides"))
    held = held.where(~F.forall(F.flatten("sides"), lambda s: s == DELETED)).select("sample_id", F.posexplode(expected).alias("place", "e"))
    known = stars.select("name", "parts")
    votes = pairs.select("sample_id", "rank", "score", F.posexplode(F.array("a", "b")).alias("vote", "v"))
    met = votes.join(held, "sample_id").join(known.select(F.col("name").alias("e"), F.col("parts").alias("ep")), "e", "left").join(known.select(F.col("name").alias("v"), F.col("parts").alias("vp")), "v", "left")
    fits = (main_allele(F.col("v")) == main_allele(F.col("e"))) | F.col("ep").isNull() | (F.size(F.array_except("ep", "vp")) == 0)
    ok = met.where(fits).groupBy("sample_id", "rank").agg(F.first("score").alias("score"), *[F.collect_set(F.when(F.col("vote") == k, F.col("place"))).alias(f"p{k}") for k in (0, 1)])
    # two votes need two different places
    ok = ok.where((F.size("p0") > 0) & (F.size("p1") > 0) & (F.size(F.array_union("p0", "p1")) > 1))
    first = ok.groupBy("sample_id").agg(F.min(F.struct("rank", "score")).alias("f"))
    top = pairs.where("rank = 1").select("sample_id", F.col("score").alias("best"), "a", "b")
    judged = held.select("sample_id").distinct().join(top, "sample_id").join(first, "sample_id", "left").withColumn("score_gap", F.col("best") - F.col("f.score"))
    off = F.col("f").isNull() | (F.col("score_gap") >= gap)
    return judged.select("sample_id", F.col("f.rank").alias("rank"), "score_gap", F.when(off, F.concat_ws("_", F.lit("Read_voting_disagrees_best"), "a", "b")).alias("vote_flag"))


# ---- structural signals ----


def clip_signals(clusters: DataFrame, keys: list[str], zones: dict[str, tuple[int, int]] = CLIP_ZONES) -> DataFrame:
    """(keys, a flag per zone, n_clusters, most_reads) of clip clusters (keys, bin, n_left, n_right); zones include both ends."""
    total = F.col("n_left") + F.col("n_right")
    inside = lambda z: F.coalesce(F.max((F.col("bin") >= z[0]) & (F.col("bin") <= z[1]) & (total >= 3)), F.lit(False))
    return clusters.groupBy(*keys).agg(*[inside(z).alias(n) for n, z in zones.items()], F.count("*").alias("n_clusters"), F.max(total).alias("most_reads"))


def subregion_signals(counts: DataFrame, keys: list[str], regions: dict[str, tuple[int, int]] = SUBREGIONS) -> DataFrame:
    """(keys, exon9_ratio, prime_ratio, exon9_elevated, three_prime_depleted) of reads (keys, name, count) in parts of the second source.

    The read length of a sample cancels in the ratios; a part without reads gives a ratio of 1.
    """
    depth = lambda n: F.max(F.when(F.col("name") == n, F.col("count") / F.lit(float(regions[n][1] - regions[n][0]))))
    of = counts.groupBy(*keys).agg(*[F.coalesce(depth(n), F.lit(0.0)).alias(n) for n in regions])
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0)
    out = of.select(*keys, ratio("exon9", "in4_in8").alias("exon9_ratio"), ratio("three_prime", "five_prime").alias("prime_ratio"))
    return out.withColumn("exon9_elevated", (F.col("exon9_ratio") >= 1.25) & (F.col("exon9_ratio") < 1.75)).withColumn("three_prime_depleted", (F.col("prime_ratio") >= 0.40) & (F.col("prime_ratio") < 0.80))


def kmer_validation(counts: DataFrame, calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, overall_ratio, estimated_cn, category, agrees, hybrid) of k-mer counts (keys, idx, n1, n2) against calls (keys, tag, total_cn)."""
    summed = counts.groupBy(*keys).agg(F.sum("n1").alias("s1"), F.sum("n2").alias("s2"))
    ratios = counts.select(*keys, "idx", F.when((F.col("n1") >= 3) & (F.col("n2") >= 3) & (F.col("n1") + F.col("n2") >= 10), F.col("n1") / (F.col("n1") + F.col("n2"))).alias("ratio"))
    steps = G.stepped(G.changepoints(ratios, keys, "idx", "ratio", 4.0, 8), keys).select(*keys, F.col("stepped").alias("hybrid"))
    n68 = F.size(F.filter(F.split("tag", "_"), lambda x: x == "star68"))
    only68 = F.forall(F.split("tag", "_"), lambda x: x == "star68")
    shift = F.when(F.col("tag").isin(*KMER_SHIFT), F.try_element_at(F.create_map(*[F.lit(x) for p in KMER_SHIFT.items() for x in p]), F.col("tag"))).when(n68 == 0, 0.0).when(only68, -0.5 * n68).otherwise(-0.5)
    met = calls.join(summed, keys, "left").join(steps, keys, "left").withColumn("overall_ratio", fraction(F.coalesce("s1", F.lit(0)), F.coalesce("s2", F.lit(0)), 1, 0.5))
    met = met.withColumn("estimated_cn", F.col("total_cn") * F.col("overall_ratio"))
    near = F.round("estimated_cn")
    category = F.when(near == 0, "deletion_homozygous").when(near == 1, "deletion").when(near == 2, "normal").otherwise("duplication")
    return met.select(*keys, "overall_ratio", "estimated_cn", category.alias("category"), (F.abs(F.col("estimated_cn") - (F.col("total_cn") - 2 + shift)) < 0.7).alias("agrees"), F.coalesce("hybrid", F.lit(False)).alias("hybrid"))


def profile_examples(spark) -> DataFrame:
    """(ord, tag, features): the profiles that a copy-number profile is compared with, plain and moved up and down where they are not near zero."""
    base = [(t, f) for t, n, f in CN_PROFILES for _ in range(n)]
    moved = [(t, tuple(x + s * PROFILE_NOISE if x > 0.5 else x for x in f)) for t, f in base for s in (1, -1)]
    return spark.createDataFrame([(k, t, [float(x) for x in f]) for k, (t, f) in enumerate(base + moved)], "ord int, tag string, features array<double>")


def classify_profiles(rows: DataFrame, key: str) -> DataFrame:
    """(key, label, confidence): the tag that most of the five nearest profiles have, the first by name of equals.

    rows (key, total_cn, spacer_cn, exon9, exon9_intron4, intron4_intron1, intron1_up); a missing spacer is 2, other gaps 0.
    """
    parts = [F.col("total_cn"), F.coalesce("spacer_cn", F.lit(2)), *[F.coalesce(c, F.lit(0)) for c in ("exon9", "exon9_intron4", "intron4_intron1", "intron1_up")]]
    train = profile_examples(rows.sparkSession)
    names = sorted({t for t, _, _ in CN_PROFILES})
    number = F.create_map(*[F.lit(x) for k, t in enumerate(names) for x in (t, k)])
    asked = rows.select(key, F.array(*[p.cast("double") for p in parts]).alias("v"))
    found = nearest(asked, key, "v", train.select("ord", F.try_element_at(number, F.col("tag")).alias("label"), F.col("features").alias("t")), "t", "label", "ord", PROFILE_NEIGHBOURS)
    return found.select(key, F.get(F.array(*map(F.lit, names)), F.col("label")).alias("label"), "confidence")
