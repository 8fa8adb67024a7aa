"""From counts to calls for many samples at once: every step keyed by sample_id, every table one join."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.functions import scalar as S
from paraloom.operators import aggregates as A
from paraloom.operators import calls as C
from paraloom.operators import evidence as E
from paraloom.operators import haplotypes as H
from paraloom.operators import intervals as I
from paraloom.operators import match as M
from paraloom.operators import models as P
from paraloom.operators import segment as G
from paraloom.operators import site_index as X
from paraloom.operators.sides import SMALL_ROWS, small
from paraloom.plans.lineage import cut
from paraloom.sources import tables as T
from paraloom.sources.tables import Resources, percent

# What combinations a tag's variants may come from: times of each item, ordered or not, and items beside them.
HYBRID_ITEMS, HYBRID_PAIRS = ("*36", "*4.013", "*57", "*83", "*141"), (("*36", "*10"), ("*4.013", "*4"))
PATTERNS = {
    "pair": [(1, 1, True)], "triple_pair": [(1, 2, False)], "four": [(2, 2, True), (1, 3, False)], "five": [(2, 3, False), (1, 4, False)], "six": [(2, 4, False), (1, 5, False), (3, 3, True)],
}
TABLE_OF_TAG = {
    "star5": "single", "star13": "single", "star5_star68": "single", "star13_star68": "single", "cn2": "pair", "star13intron1": "pair", "dup_star13": "pair", "exon9hyb_star5": "pair", "star68": "pair",
    "star68_star68": "pair", "star68_star68_star68": "pair", "star68_star68_star68_star68": "pair", "cn3": "triple_pair", "dup_star13intron1": "triple_pair", "dup_star68": "triple_pair", "cn4": "four", "cn5": "five",
    "cn6": "six", "exon9hyb": "triple", "exon9hyb_star68": "triple", "dup_exon9hyb": "dup_hybrid", "exon9hyb_exon9hyb": "hybrid2", "exon9hyb_exon9hyb_exon9hyb": "hybrid3", "exon9hyb_exon9hyb_exon9hyb_exon9hyb": "hybrid4",
}
STAR68_VARIANT = "g.42130692G>A"
# The two sites of the conversion at exon 9.
EXON9_SITES = (7, 8)
# Windows that are looked at beside the tables: of the insertion, and of clips, sub-regions and k-mers.
WINDOWS = (H.INSERTION_WINDOW, (42_123_000, 42_146_000))
#: Stretches that stand nearer than this are read as one, and how many there are at most.
GAP, INTERVALS = 100_000, 32


@dataclass
class Options:
    """What changes a result; each is a branch of the plan."""

    strand_bias_all: bool = False
    fuzzy_match: bool = False
    changepoint_hybrid: bool = False
    hmm_cnv: bool = False
    spacer_cn_check: bool = False
    consistency_check: bool = False
    read_voting: bool = False
    phase_disambiguate: bool = False


def normalised_depth(counts: DataFrame, read_length: DataFrame, hap_cn: int = 2) -> DataFrame:
    """(sample_id, region_type, depth, mad, median_depth) from region counts (sample_id, ord, name, region_type, start, end, gc, count)."""
    norm = counts.where("region_type = 'norm'").withColumn("per_base", F.col("count") / (F.col("end") - F.col("start")))
    fit = G.gc_corrected(norm.select("sample_id", "ord", "gc", "per_base"), ["sample_id"], "gc", "per_base", "ord")
    middle = A.center(fit, ["sample_id"], "corrected").select("sample_id", F.col("median").alias("middle"))
    spread = A.mad(fit, ["sample_id"], "corrected").select("sample_id", F.col("mad").alias("spread"))
    base = A.center(norm, ["sample_id"], "per_base").select("sample_id", F.col("median").alias("raw_middle"))
    own = counts.where("region_type <> 'norm'").withColumn("len", F.col("end") - F.col("start"))
    depth = A.region_depth(own, ["sample_id"], "region_type", F.col("name"), "len", "count").join(middle, "sample_id").join(spread, "sample_id").join(base, "sample_id").join(read_length, "sample_id")
    return depth.select(
        "sample_id", "region_type", (hap_cn * F.try_divide(F.col("depth"), F.col("raw_middle"))).alias("depth"), S.round3(F.try_divide(F.col("spread"), F.col("middle"))).alias("mad"), (F.col("raw_middle") * F.col("read_length")).alias("median_depth")
    )


def region_copies(depth: DataFrame, region: str, states: list, shift: float, name: str) -> DataFrame:
    """(sample_id, name, name_raw): the copies of a region; above all states the nearest integer."""
    called = P.gmm_call(depth.where(F.col("region_type") == region).withColumnRenamed("depth", "value"), "value", states, shift)
    return called.select("sample_id", C.fallback_copies(F.col("cn"), F.col("depth")).alias(name), F.col("depth").alias(f"{name}_raw"))


def site_copies(counts: DataFrame, totals: DataFrame, min_reads: int = 0, cutoff: float = 0.6) -> DataFrame:
    """counts (sample_id, idx, n1, n2, ...) with cn, the copies of the first source at each site."""
    rows = counts.join(totals.select("sample_id", "total_cn"), "sample_id")
    called = P.poisson_call(rows, "total_cn", "n1", "n2", min_reads)
    return called.withColumn("cn", P.conversion_filter(F.col("cn_call"), cutoff))


def variant_copies(counts: DataFrame, tags: DataFrame, options: Options) -> DataFrame:
    """(sample_id, idx, name, cn): copies of each target variant (sample_id, idx, pos, name, n1, n2, n1_fwd, n1_rev), after the strand filters."""
    rows = C.expected_copies(counts.join(tags.select("sample_id", "tag"), "sample_id"), "pos", "tag")
    noisy, clean = F.col("name").isin(*C.NOISY_VARIANTS), F.col("name").isin(*C.CLEAN_VARIANTS)
    rows = P.strand_noise(rows, "n1_fwd", "n1_rev", "n1").withColumn("n1", F.when(noisy & F.col("noisy"), 0).otherwise(F.col("n1")))
    if options.strand_bias_all:
        # alternative reads by strand against two even halves of their number
        half = rows.withColumn("half", F.floor((F.col("n1_fwd") + F.col("n1_rev")) / 2))
        rows = P.strand_bias(half, "n1_fwd", "n1_rev", "half", "half", clean).withColumn("n1", F.when(~noisy & F.col("biased"), 0).otherwise(F.col("n1")))
    least = {"clean": clean, "noisy": noisy}
    out = None
    for kind, reads in (("clean", 2), ("noisy", 7), ("other", 4)):
        some = rows.where(least[kind] if kind in least else ~clean & ~noisy)
        called = P.poisson_call(some, "expected", "n1", "n2", reads)
        called = called.select("sample_id", "idx", "name", P.denovo_filter(F.col("cn_call"), 0.8, 0.65, F.col("expected")).alias("cn"))
        out = called if out is None else out.unionByName(called)
    return out


def homology_copies(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(sample_id, name, cn): copies of variants that both sources may have (sample_id, name, n1, n2), at most those beyond two."""
    called = P.poisson_call(counts.join(totals.select("sample_id", "total_cn"), "sample_id"), "total_cn", "n1", "n2", 4)
    return called.select("sample_id", "name", F.least(P.denovo_filter(F.col("cn_call"), 0.8, 0.65), F.col("total_cn") - 2).alias("cn"))


def changepoint_tags(sites: DataFrame, totals: DataFrame) -> DataFrame:
    """(sample_id, step_tag): the hybrid that a clear step in the share of the first source suggests."""
    ratio = sites.select("sample_id", "idx", F.when(F.col("n1") + F.col("n2") >= 5, F.col("n1") / (F.col("n1") + F.col("n2"))).alias("ratio"))
    ends = G.stepped(G.changepoints(ratio, ["sample_id"], "idx", "ratio", 3.0, 5), ["sample_id"])
    tag = C.changepoint_tag(F.col("total_cn"), *map(F.col, ("n_segments", "first_mean", "last_mean", "first_valid", "last_valid")))
    return ends.join(totals.select("sample_id", "total_cn"), "sample_id").select("sample_id", F.when(F.col("stepped"), tag).alias("step_tag"))


def hidden_state_tags(sites: DataFrame, totals: DataFrame, sd_cn2: float) -> DataFrame:
    """(sample_id, state_tag): the tag of the most likely copy numbers along the sites; every region must have votes."""
    shares = sites.select("sample_id", "idx", "n1", "n2").join(totals.select("sample_id", "total_cn"), "sample_id").withColumn("obs", F.coalesce(F.try_divide(F.col("total_cn") * F.col("n1"), F.col("n1") + F.col("n2")), F.lit(0.0)))
    profile = shares.where("total_cn is not null").withColumn("valid", F.col("n1") + F.col("n2") >= 10).withColumn("states", (F.col("total_cn") + 3).cast("int"))
    path = G.viterbi(profile, ["sample_id"], "idx", "obs", "valid", "states", sd_cn2 / 2**0.5).withColumn("region", C.region_of(F.col("idx")))
    regions = list(C.REGION_ENDS)
    wide = A.modal(path, ["sample_id", "region"], "state").groupBy("sample_id").pivot("region", regions).agg(F.first("state"))
    full = wide.join(totals.select("sample_id", "total_cn"), "sample_id").where(" and ".join(f"{r} is not null" for r in regions))
    return C.structural_tag(full, rep_col="rep").select("sample_id", F.col("tag").alias("state_tag"))


def structural_calls(sites: DataFrame, totals: DataFrame, exon9: DataFrame, options: Options, sd_cn2: float = 0.3) -> DataFrame:
    """(sample_id, total_cn, spacer_cn, tag, region columns): totals (sample_id, total_cn, spacer_cn), exon9 (sample_id, exon9_cn)."""
    regions = C.region_consensus(sites, ["sample_id"], "idx", "cn")
    loose = C.loose_support(sites.drop("total_cn").join(totals.select("sample_id", "total_cn"), "sample_id"), ["sample_id"], "idx", "cn", "total_cn")
    rows = totals.join(regions, "sample_id", "left").join(loose, "sample_id", "left").join(exon9.select("sample_id", "exon9_cn"), "sample_id", "left")
    tagged = C.structural_tag(C.fill_consensus(rows, "total_cn", "spacer_cn", "exon9_cn", "loose"))
    if options.changepoint_hybrid:
        tagged = tagged.join(changepoint_tags(sites, totals), "sample_id", "left").withColumn("tag", F.coalesce("tag", "step_tag")).drop("step_tag")
    if options.hmm_cnv:
        tagged = tagged.join(hidden_state_tags(sites, totals, sd_cn2), "sample_id", "left").withColumn("tag", F.coalesce("tag", "state_tag")).drop("state_tag")
    return tagged.withColumn("tag", C.known_tag(F.col("tag")))


def dictionaries(stars: DataFrame) -> DataFrame:
    """(cn_table, key, candidates) of all tables but that of triples, which each sample builds from what it shows."""
    hybrid = {r["name"]: list(r["parts"]) for r in stars.where(F.col("name").isin(*HYBRID_ITEMS, *[x for p in HYBRID_PAIRS for x in p])).collect()}  # nine names at most
    fixed = lambda *names: (list(names), [v for n in names for v in hybrid[n]])
    tables = {"single": M.single_dictionary(stars)} | {k: M.pair_dictionary(stars, p) for k, p in PATTERNS.items()}
    own = [h for h in HYBRID_ITEMS if h in hybrid]
    pairs = [fixed(*p) for p in HYBRID_PAIRS if all(x in hybrid for x in p)]
    if pairs:
        tables["dup_hybrid"] = M.pair_dictionary(stars, PATTERNS["pair"], pairs)
    if own:
        tables["hybrid2"] = M.pair_dictionary(stars, PATTERNS["pair"], [fixed(a, b) for k, a in enumerate(own) for b in own[k:]])
        tables["hybrid3"] = M.pair_dictionary(stars, PATTERNS["pair"], [fixed(a, b, c) for i, a in enumerate(own) for j, b in enumerate(own[i:], i) for c in own[j:]])
    if {"*10", "*36"} <= set(hybrid):
        names, parts = fixed("*10", "*10", "*36", "*36", "*36", "*36")
        tables["hybrid4"] = stars.sparkSession.createDataFrame([("_".join(sorted(parts)), ["_".join(sorted(names))])], "key string, candidates array<string>")
    out = None
    for name, rows in tables.items():
        rows = rows.select(F.lit(name).alias("cn_table"), "key", "candidates")
        out = rows if out is None else out.unionByName(rows)
    return out


def _table_of(tag):
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in TABLE_OF_TAG.items() for x in pair]), tag)


def match_stars(observed: DataFrame, tables: DataFrame, stars: DataFrame, options: Options) -> DataFrame:
    """(sample_id, tag, names, call_info, candidates, star_call) of samples (sample_id, tag, names[, exon9, exon9_cn, exon9_raw]).

    Beside the plain match these are tried: fewer copies of one variant where star68 may hold it, one more copy of a variant for
    more than two copies of the gene, and the best near match.
    """
    own = [F.col("exon9"), F.col("exon9_cn"), [F.get("exon9_raw", F.lit(k)) for k in (0, 1)]] if "exon9_cn" in observed.columns else []
    rows = observed.withColumn("names", C.repair_variants(F.col("names"), F.col("tag"), *own)).withColumn("cn_table", _table_of(F.col("tag")))
    n68 = F.size(F.filter(F.split("tag", "_"), lambda x: x == "star68"))
    have = F.size(F.filter("names", lambda x: x == STAR68_VARIANT))
    drops = F.sequence(F.lit(0), F.least(n68, have))
    fewer = lambda k: F.array_sort(F.concat(F.filter("names", lambda x: x != STAR68_VARIANT), F.array_repeat(F.lit(STAR68_VARIANT), have - k)))
    cn = F.try_to_number(F.regexp_extract("tag", r"^cn([3-6])$", 1), F.lit("9")).cast("int")
    more = F.filter(F.array_distinct("names"), lambda v: F.size(F.filter("names", lambda x: x == v)) == cn - 2)
    empty = F.array().cast("array<struct<kind:string,k:int,trial:array<string>>>")
    step = F.transform(drops, lambda k: F.struct(F.lit("drop").alias("kind"), k.alias("k"), fewer(k).alias("trial")))
    add = F.when(cn.isNotNull(), F.transform(more, lambda v, i: F.struct(F.lit("add").alias("kind"), i.alias("k"), F.array_sort(F.concat(F.col("names"), F.array(v))).alias("trial")))).otherwise(empty)
    trials = rows.withColumn("t", F.explode(F.concat(step, add))).select("sample_id", "tag", "names", "cn_table", "t.*").where("cn_table <> 'triple'")
    matched = M.exact_match(trials, tables, "trial", ("cn_table",))
    three = rows.where("cn_table = 'triple'").withColumn("t", F.explode(step)).select("sample_id", "tag", "names", "cn_table", "t.*")
    triples = M.triple_matches(three.select("sample_id", "kind", "k", F.col("trial").alias("names")), stars, ["sample_id", "kind", "k"])
    third = M.classify(three.withColumn("key", S.multiset_key(F.col("trial"))).join(triples, ["sample_id", "kind", "k", "key"], "left"))
    columns = ["sample_id", "tag", "names", "cn_table", "kind", "k", "call_info", "candidates", "star_call"]
    tried = matched.select(*columns).unionByName(third.select(*columns))
    ok = F.col("call_info") != "no_match"
    step_of = lambda c: F.sort_array(F.collect_list(F.when((F.col("kind") == "drop") & ok, F.struct("k", c))))
    grouped = tried.groupBy("sample_id", "tag", "names", "cn_table").agg(
        F.first(F.when((F.col("kind") == "drop") & (F.col("k") == 0), F.struct("call_info", "candidates", "star_call")), ignorenulls=True).alias("plain"),
        step_of("star_call").alias("dropped"), F.count_if(F.col("kind") == "drop").alias("n_drops"),
        F.collect_list(F.when((F.col("kind") == "add") & (F.col("call_info") == "unique_match"), F.struct("call_info", "candidates", "star_call"))).alias("added"),
    )
    haps = F.flatten(F.transform("dropped", lambda x: x["star_call"]))
    common = F.filter(haps, lambda c: ~F.exists(F.array(*map(F.lit, M.RARE_ALLELES)), lambda r: F.contains(c, r)))
    call = lambda info, cand, star: F.struct(F.lit(info).alias("call_info"), cand.alias("candidates"), star.alias("star_call"))
    none = call("no_match", F.array().cast("array<string>"), F.array().cast("array<string>"))
    star68 = (
        F.when(F.size(haps) == 0, none).when(F.size(F.array_distinct(haps)) == 1, call("unique_match", haps, F.slice(haps, 1, 1)))
        .when(F.size(F.array_distinct(common)) == 1, call("pick_common_allele", haps, F.slice(common, 1, 1))).otherwise(call("pick_common_allele", haps, F.slice(haps, -1, 1)))
    )
    chosen = F.when(F.col("n_drops") > 1, star68).when((F.col("plain.call_info") == "no_match") & (F.size("added") == 1), F.col("added")[0]).otherwise(F.col("plain"))
    out = grouped.withColumn("c", chosen).select("sample_id", "tag", "names", "cn_table", "c.*")
    if options.fuzzy_match:
        open_ = cut(out.where((F.col("call_info") == "no_match") & ((F.col("cn_table") == "single") | ~F.contains("tag", F.lit("star68")))))
        near = fuzzy_stars(open_, tables, stars)
        found = M.classify(near).select("sample_id", F.concat(F.lit("fuzzy_match(score="), F.format_number("score", 1), F.lit(")")).alias("f_info"), F.col("candidates").alias("f_cand"), M.main_forms(F.col("candidates")).alias("f_call"))
        out = out.join(found, "sample_id", "left").select(
            "sample_id", "tag", "names", F.coalesce("f_info", "call_info").alias("call_info"), F.coalesce("f_cand", "candidates").alias("candidates"), F.coalesce("f_call", "star_call").alias("star_call")
        )
    return out.select("sample_id", "tag", "names", "call_info", "candidates", "star_call")


def fuzzy_stars(open_: DataFrame, tables: DataFrame, stars: DataFrame) -> DataFrame:
    """(sample_id, key, score, candidates): the best near match of samples (sample_id, tag, names, cn_table), in whichever table their tag uses.

    The table of triples is not made; each sample combines the few alleles that it nearly shows.
    """
    parts = []
    for name in sorted(set(TABLE_OF_TAG.values()) - {"triple"}):
        own = tables.where(F.col("cn_table") == name)
        parts.append(M.fuzzy_match(open_.where(F.col("cn_table") == name), own, ["sample_id"], "names").join(own.select("key", "candidates"), "key"))
    parts.append(fuzzy_triples(open_.where(F.col("cn_table") == "triple"), stars))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return found.select("sample_id", "key", "score", "candidates")


def fuzzy_triples(open_: DataFrame, stars: DataFrame) -> DataFrame:
    """fuzzy_stars for triples of alleles: at most FUZZY_EXCESS observed names are no allele's, and at most as many are lacking.

    A triple's alleles lack FUZZY_EXCESS names in all, so each of them is observed but for so many of its parts; those few are combined.
    """
    rows = open_.select("sample_id", F.array_sort("names").alias("o"))
    less = lambda a, b: F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.greatest(F.lit(0), F.size(F.filter(a, lambda y: y == x)) - F.size(F.filter(b, lambda y: y == x))))
    few = rows.join(small(stars.select("ord", "name", "parts")), less(F.col("parts"), F.col("o")) <= M.FUZZY_EXCESS)
    of = lambda k: few.select(F.col("sample_id").alias(f"s{k}"), "o", F.col("ord").alias(f"o{k}"), F.col("name").alias(f"n{k}"), F.col("parts").alias(f"p{k}"))
    near = lambda p: less(p, F.col("o")) <= M.FUZZY_EXCESS
    ab = of("a").join(of("b").drop("o"), (F.col("sa") == F.col("sb")) & (F.col("oa") <= F.col("ob"))).where(near(F.concat("pa", "pb")))
    abc = ab.join(of("c").drop("o"), (F.col("sa") == F.col("sc")) & (F.col("ob") <= F.col("oc"))).withColumn("whole", F.array_sort(F.concat("pa", "pb", "pc"))).where("size(whole) > 0")
    extra, missing = less(F.col("whole"), F.col("o")), less(F.col("o"), F.col("whole"))
    score = F.round(F.size("o") - missing - M.FUZZY_EXTRA * extra - M.FUZZY_MISSING * missing, 6)
    fits = abc.where((extra <= M.FUZZY_EXCESS) & (missing <= M.FUZZY_EXCESS)).withColumn("score", score).where(F.col("score") >= M.FUZZY_LEAST)
    by_key = fits.groupBy(F.col("sa").alias("sample_id"), F.array_join("whole", "_").alias("key"), "score").agg(F.array_sort(F.collect_set(F.array_join(F.array_sort(F.array("na", "nb", "nc")), "_"))).alias("candidates"))
    best = by_key.groupBy("sample_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "key", "candidates")).alias("b"))
    return best.select("b.key", "sample_id", (-F.col("b.s")).alias("score"), "b.candidates")


def genotypes(matched: DataFrame, totals: DataFrame, options: Options, flags: DataFrame | None = None) -> DataFrame:
    """matched with genotype and filter; flags (sample_id, cis_938, trans_803) tell two ambiguous pairs apart, and a column `resolved` has what phase tells."""
    rows = matched.join(totals.select("sample_id", "total_cn", "spacer_cn", "high_cn"), "sample_id")
    rows = rows.join(flags, "sample_id", "left") if flags is not None else rows.withColumns({"cis_938": F.lit(False), "trans_803": F.lit(False)})
    direct = F.try_element_at(F.create_map(*[F.lit(x) for pair in C.DIRECT_GENOTYPES.items() for x in pair]), F.col("tag"))
    rows = C.spelled_calls(rows, "star_call", "tag", "spacer_cn")
    spelled = F.when(F.col("call_info") != "no_match", F.col("spelled"))
    if "resolved" in rows.columns:
        spelled = F.when((F.col("call_info") == "more_than_one_match") & (F.col("tag") == "cn2"), F.coalesce("resolved", spelled)).otherwise(spelled)
    solved = C.resolve_cn2(spelled, F.col("tag"), F.col("call_info"), F.coalesce("cis_938", F.lit(False)), F.coalesce("trans_803", F.lit(False)))
    rows = rows.withColumn("genotype", F.coalesce(direct, solved))
    fuzzy = F.startswith("call_info", F.lit("fuzzy_match"))
    rows = rows.withColumn("filter", C.call_filter(F.col("genotype"), F.coalesce("high_cn", F.lit(False)), F.coalesce(fuzzy, F.lit(False))))
    if options.spacer_cn_check:
        rows = rows.withColumn("filter", C.spacer_filter(F.col("filter"), F.col("tag"), F.col("total_cn"), F.col("spacer_cn")))
    return rows.withColumn("genotype", F.array_join(F.array_sort(F.transform(F.split("genotype", ";"), S.sort_pair)), ";")).drop("cis_938", "trans_803", "spelled", "resolved")


def phenotypes(calls: DataFrame, function: DataFrame) -> DataFrame:
    """(sample_id, activity, phenotype, n_alternatives, reflex) of each call's alternatives, from a haplotype function table."""
    each = calls.where("genotype is not null").select("sample_id", F.posexplode(F.split("genotype", ";")).alias("alt", "diplotype"))
    alleles = each.select("sample_id", "alt", "diplotype", F.explode(F.split("diplotype", "/")).alias("allele"))
    scored = C.activity_score(alleles, ["sample_id", "alt", "diplotype"], function).withColumn("phenotype", S.phenotype_band(F.col("score")))
    summary = C.ambiguity(scored, ["sample_id"], "phenotype")
    text = scored.groupBy("sample_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt", F.coalesce(F.col("score").cast("string"), F.lit("n/a")).alias("s")))), lambda x: x["s"]), ";").alias("activity"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alt", "phenotype"))), lambda x: x["phenotype"]), ";").alias("phenotype"),
    )
    return text.join(summary, "sample_id")


def frequencies(calls: DataFrame, haplotypes: DataFrame, diplotypes: DataFrame) -> DataFrame:
    """(sample_id, grp, name, percent) of a call's diplotypes and haplotypes in each group; names without a row have no rows."""
    each = calls.where("genotype is not null").select("sample_id", F.explode(F.split("genotype", ";")).alias("d"))
    names = each.select("sample_id", F.explode(F.concat(F.array("d"), F.split("d", "/"))).alias("name")).distinct()
    both = haplotypes.unionByName(diplotypes).withColumnRenamed("allele", "name")
    return names.join(both, "name").select("sample_id", "grp", "name", percent(F.col("freq")).alias("percent"))


def model_states(parameters: DataFrame, region: str) -> tuple[list, float]:
    """(states, shift) of a region from the parameter table, a handful of rows."""
    rows = [r for r in parameters.where(F.col("region") == region).collect()]
    of = lambda p: {r["cn"]: r["value"] for r in rows if r["param"] == p}
    shift = of("shift")[None]
    return P.gmm_states(shift, of("mean"), of("prior"), of("sd")[2]), shift


def model_sd(parameters: DataFrame, region: str) -> float:
    """The spread at two copies of a region, one row of the parameter table."""
    return parameters.where((F.col("region") == region) & (F.col("param") == "sd") & (F.col("cn") == 2)).first()["value"]


def gene_intervals(res: Resources) -> list[tuple[str, int, int]]:
    """The few stretches that a run looks at read by read: regions that are not for normalising, sites of all tables, and fixed windows."""
    rows = res.regions.where("region_type <> 'norm'").select("chrom", "start", "end")
    for table in site_tables(res).values():
        rows = rows.unionByName(table.select("chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end")))
    known = rows.distinct().limit(SMALL_ROWS + 1).collect()
    if len(known) > SMALL_ROWS:
        # too many to look at: one stretch a contig
        known = rows.groupBy("chrom").agg(F.min("start").alias("start"), F.max("end").alias("end")).collect()
    return X.merged([(r["chrom"], r["start"], r["end"]) for r in known] + [(res.chrom, *w) for w in WINDOWS], GAP, INTERVALS)


def site_tables(res: Resources) -> dict[str, DataFrame]:
    """The rows of the site index for each table of a run."""
    tables = {"sites": res.sites, "targets": res.targets, "homology": res.homology} | {f"haplotype {k}": t for k, t in (res.haplotypes or {}).items()}
    return {name: X.site_rows(table, name) for name, table in tables.items()}


def gene_reads(reads: DataFrame, res: Resources) -> DataFrame:
    """The reads of the gene's stretches, written once: the only full look at the reads that a run takes."""
    columns = [f.split(" ")[0] for f in T.READS.split(", ") if f.split(" ")[0] in reads.columns]
    return cut(X.overlapping_reads(reads, gene_intervals(res)).select(*columns))


def observations(near: DataFrame, res: Resources) -> DataFrame:
    """What the gene's reads show at the sites of all tables, written once."""
    return cut(X.observe(near, reduce(DataFrame.unionByName, site_tables(res).values())))


def source_counts(observed: DataFrame, samples: DataFrame, sites: DataFrame, source: str, sides: tuple[int, ...], min_mapq: int, min_span: int = 0) -> DataFrame:
    """(sample_id, idx, n1, n2, n1_fwd, n1_rev) of every site of every sample: distinct fragments at one coordinate or at both."""
    found = I.supporting_counts(I.allele_reads(X.at_sites(observed, source, sides, min_mapq, min_span), ["sample_id"]), ["sample_id"])
    grid = samples.select("sample_id").crossJoin(small(sites.select("idx")))
    return grid.join(found, ["sample_id", "idx"], "left").na.fill(0, ["n1", "n2", "n1_fwd", "n1_rev"])


def exon9_copies(sites: DataFrame, totals: DataFrame, pair: tuple[int, int] = EXON9_SITES) -> DataFrame:
    """(sample_id, exon9_cn): copies at the two conversion sites where they and their mean agree."""
    called = P.poisson_call(sites.where(F.col("idx").isin(*pair)).join(totals.select("sample_id", F.col("total_cn").alias("t")), "sample_id"), "t", "n1", "n2")
    each = called.select("sample_id", "idx", "n1", "n2", "t", P.conversion_filter(F.col("cn_call"), 0.88).alias("c"), (F.col("t") * F.try_divide(F.col("n1"), F.col("n1") + F.col("n2"))).alias("raw"))
    pick = lambda col, k: F.max(F.when(F.col("idx") == k, F.col(col)))
    wide = each.groupBy("sample_id").agg(F.first("t").alias("t"), F.round(F.avg("n1")).cast("long").alias("m1"), F.round(F.avg("n2")).cast("long").alias("m2"), *[pick(c, k).alias(f"{c}{j}") for c in ("c", "raw") for j, k in enumerate(pair)])
    mean = P.poisson_call(wide, "t", "m1", "m2").withColumn("by_mean", P.conversion_filter(F.col("cn_call"), 0.70))
    return mean.select("sample_id", C.exon9_call([F.col("c0"), F.col("c1")], [F.col("raw0"), F.col("raw1")], F.col("by_mean")).alias("exon9_cn"))


def haplotype_calls(observed: DataFrame, haplotypes: dict[str, DataFrame], totals: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The variants that patterns along reads tell: (sample_id, name, cn), the flags (sample_id, cis_938, trans_803) and raw counts (sample_id, name, alt, ref).

    haplotypes has a table of sites for each of 938, 526_556, 803 and ins_a; those that a release lacks are left out.
    """
    source_of = lambda k: f"haplotype {k}"
    counts_of = lambda k, sides, mapq, span=0: source_counts(observed, totals, haplotypes[k], source_of(k), sides, mapq, span)
    patterns_of = lambda k, sides, mapq: E.patterns_along(X.at_sites(observed, source_of(k), sides, mapq), haplotypes[k])
    nothing = tags.limit(0)
    copies = nothing.select("sample_id", F.lit("").alias("name"), F.lit(0).cast("long").alias("cn"))
    raw = nothing.select("sample_id", F.lit("").alias("name"), F.lit(0).cast("long").alias("alt"), F.lit(0).cast("long").alias("ref"))
    flags = totals.select("sample_id").withColumns({"cis_938": F.lit(False), "trans_803": F.lit(False)})
    last = lambda counts, sites: counts.join(F.broadcast(sites.agg(F.max("idx").alias("idx"))), "idx")  # noqa: E731  # one row
    named = lambda rows, name, cn: rows.select("sample_id", F.lit(name).alias("name"), F.col(cn).cast("long").alias("cn"))
    counted = lambda rows, name, alt, ref: rows.select("sample_id", F.lit(name).alias("name"), F.col(alt).cast("long").alias("alt"), F.col(ref).cast("long").alias("ref"))
    if "938" in haplotypes:
        sites = haplotypes["938"]
        end = cut(last(counts_of("938", (1, 2), 0), sites))
        found = cut(H.call_938(end, totals, patterns_of("938", (1, 2), 0)))
        copies = copies.unionByName(named(found, "g.42126938C>T", "copies"))
        raw = raw.unionByName(counted(end, "g.42126938C>T", "n2", "n1"))
        flags = flags.drop("cis_938").join(found.select("sample_id", "cis_938"), "sample_id", "left")
    if "526_556" in haplotypes:
        counts = counts_of("526_556", (1,), 10)
        of = lambda k, c: F.max(F.when(F.col("idx") == k, F.col(c)))
        wide = cut(counts.groupBy("sample_id").agg(of(0, "n2").alias("a1"), of(0, "n1").alias("r1"), of(1, "n2").alias("a2"), of(1, "n1").alias("r2")))
        found = cut(H.call_526_556(wide, tags, patterns_of("526_556", (1,), 10)))
        for name, cn, alt, ref in (("g.42127526C>T", "n526", "a1", "r1"), ("g.42127556T>C", "n556", "a2", "r2")):
            copies, raw = copies.unionByName(named(found, name, cn)), raw.unionByName(counted(wide, name, alt, ref))
    if "803" in haplotypes:
        found = H.trans_803(tags, patterns_of("803", (1,), 10))
        flags = flags.drop("trans_803").join(found, "sample_id", "left")
    if "ins_a" in haplotypes:
        sites, name = haplotypes["ins_a"], "g.42130655-42130656insA"
        far = last(counts_of("ins_a", (2,), 10, H.BETWEEN_SOURCES), sites).select("sample_id", F.col("n1").alias("first"), F.col("n2").alias("second"))
        near = last(counts_of("ins_a", (2,), 10), sites).select("sample_id", F.col("n1").alias("aa"))
        near = near.join(last(counts_of("ins_a", (1,), 10), sites).select("sample_id", F.col("n1").alias("a")), "sample_id")
        copies = copies.unionByName(named(H.call_inserted_a(far, near), name, "copies"))
        both = far.join(near, "sample_id")
        raw = raw.unionByName(both.select("sample_id", F.lit(name).alias("name"), (F.col("second") + F.col("aa")).alias("alt"), F.col("a").alias("ref")))
    return copies.where("cn > 0"), flags, raw


def run(reads: DataFrame, res: Resources, options: Options | None = None, counts: DataFrame | None = None, near: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """One row per sample of a reads table: depth, copies, tag, variants, genotype, filter and, with a function table, phenotype.

    The reads are scanned twice: once over a few narrow columns for the samples and the reads of each region (only for the samples where
    counts (sample_id, name, count) have been made before), and once for the reads of the gene's stretches, unless those are given (near, from gene_reads). With
    samples (sample_id) given, reads may be only those that can start in a region.
    A sample that a step cannot call keeps nulls from there on.
    """
    options = options or Options()
    if counts is None:
        regional = cut(I.region_read_counts(reads, res.regions, ["sample_id"]))
        samples, counts = regional.select("sample_id").distinct() if samples is None else samples, regional.where("name is not null")
    samples = cut(reads.select("sample_id").distinct() if samples is None else samples)
    near = gene_reads(reads, res) if near is None else near
    observed = observations(near, res)
    depth = cut(normalised_depth(cut(counts.join(small(res.regions), "name")), T.read_length(near, res.regions, samples)))
    gene, shift = model_states(res.parameters, "d67")
    spacer, spacer_shift = model_states(res.parameters, "spacer")
    own = region_copies(depth, "d67", gene, shift, "total_cn").withColumn("high_cn", F.col("total_cn") > 10)
    quality = depth.where("region_type = 'd67'").select("sample_id", "mad", "median_depth")
    totals = cut(samples.join(own, "sample_id", "left").join(region_copies(depth, "spacer", spacer, spacer_shift, "spacer_cn"), "sample_id", "left").join(quality, "sample_id", "left"))

    sites = cut(site_copies(source_counts(observed, samples, res.sites, "sites", (1, 2), 0), totals))
    exon9 = cut(exon9_copies(sites.drop("total_cn", "cn"), totals))
    tagged = cut(structural_calls(sites, totals.select("sample_id", "total_cn", "spacer_cn"), exon9, options, model_sd(res.parameters, "d67")))

    named = res.targets.select("idx", F.col("label").alias("name"), (F.col("pos1") + 1).alias("pos"))
    target = source_counts(observed, samples, res.targets, "targets", (1,), 10).join(small(named), "idx")
    target = cut(H.insertion_counts(target, H.motif_counts(near, res.chrom)))
    called = variant_copies(target, tagged, options).select("sample_id", "name", "cn")
    homology = source_counts(observed, samples, res.homology, "homology", (1, 2), 0).join(small(res.homology.select("idx", F.col("label").alias("name"))), "idx")
    called = called.unionByName(homology_copies(homology, totals))
    along, flags, more_raw = haplotype_calls(observed, res.haplotypes or {}, totals, tagged.select("sample_id", "tag"))
    names = cut(A.repeated(called.unionByName(along), ["sample_id"], "name", "cn"))
    raw9 = sites.where(F.col("idx").isin(*EXON9_SITES)).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.try_divide(F.col("total_cn") * F.col("n1"), F.col("n1") + F.col("n2")), F.lit(0.0)).alias("v")))).alias("r"))
    raw9 = raw9.select("sample_id", F.transform("r", lambda x: x["v"]).alias("exon9_raw"))
    own9 = exon9.join(raw9, "sample_id", "left")
    observed = tagged.where("tag is not null").select("sample_id", "tag", "exon9").join(names, "sample_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    observed = cut(observed.join(own9, "sample_id", "left"))

    matched = cut(match_stars(observed, cut(dictionaries(res.stars)), res.stars, options))
    if options.phase_disambiguate:
        open_ = matched.where((F.col("call_info") == "more_than_one_match") & (F.col("tag") == "cn2")).select("sample_id", "candidates")
        matched = matched.join(E.phased_calls(open_, res.stars, near, T.variant_bases(res.targets), res.chrom), "sample_id", "left")
    calls = cut(genotypes(matched, totals, options, flags))
    raw = target.select("sample_id", "name", F.col("n1").alias("alt"), F.col("n2").alias("ref"))
    if options.consistency_check:
        judged = calls.where("genotype is not null").select("sample_id", "genotype", "tag", "total_cn")
        found = E.consistency_flags(judged, sites, raw, res.stars, ["sample_id"]).select("sample_id", "flag")
        calls = calls.join(found, "sample_id", "left").withColumn("filter", E.flagged_filter(F.col("filter"), F.col("flag"))).drop("flag")
    if options.read_voting:
        chosen = calls.where(F.col("filter").isin("PASS", "Fuzzy_match")).select("sample_id", "genotype")
        voting = E.vote_sites(named.select("name"))
        scores = E.vote_scores(E.vote_observations(near.join(chosen.select("sample_id"), "sample_id", "left_semi"), voting, res.chrom), voting, res.stars)
        found = E.vote_flags(chosen, E.vote_pairs(scores), res.stars).select("sample_id", F.col("vote_flag").alias("flag"))
        calls = calls.join(found, "sample_id", "left").withColumn("filter", E.flagged_filter(F.col("filter"), F.col("flag"))).drop("flag")
    calls = cut(calls.drop("tag", "total_cn", "spacer_cn", "high_cn", "names"))
    raw = raw.join(more_raw.select("sample_id", "name"), ["sample_id", "name"], "left_anti").unionByName(more_raw)
    scores = C.variant_scores(calls.select("sample_id", "genotype"), raw, res.stars, ["sample_id"])
    profile = sites.select("sample_id", (F.col("total_cn") * F.try_divide(F.col("n1"), F.col("n1") + F.col("n2"))).alias("v"))
    even = C.consistency_score(profile, ["sample_id"], "v")
    out = totals.join(tagged.select("sample_id", "tag", "exon9", "exon9_intron4", "intron4_intron1", "intron1_up"), "sample_id", "left").join(observed.select("sample_id", "names"), "sample_id", "left")
    along_axis = sites.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "cn", F.coalesce(F.try_divide(F.col("total_cn") * F.col("n1"), F.col("n1") + F.col("n2")), F.lit(0.0)).alias("v")))).alias("a"))
    along_axis = along_axis.select("sample_id", F.transform("a", lambda x: x["cn"]).alias("site_calls"), F.transform("a", lambda x: x["v"]).alias("site_raw"))
    strands = target.select("sample_id", "name", F.format_string("%d(%d:%d),%d", "n1", "n1_fwd", "n1_rev", "n2").alias("c")).unionByName(more_raw.select("sample_id", "name", F.format_string("%d,%d", "alt", "ref").alias("c")))
    strands = strands.groupBy("sample_id", "name").agg(F.min("c").alias("c")).groupBy("sample_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "c")))).alias("raw_counts"))
    out = out.join(exon9, "sample_id", "left").join(along_axis, "sample_id", "left").join(strands, "sample_id", "left")
    out = out.join(calls, "sample_id", "left").join(scores, "sample_id", "left").join(even, "sample_id", "left")
    parts = {
        "depth": C.depth_score(F.coalesce("median_depth", F.lit(0.0)), F.coalesce("mad", F.lit(1.0))), "cn": C.rounding_score(F.coalesce("total_cn_raw", F.lit(0.5)), F.coalesce("spacer_cn_raw", F.lit(0.5))),
        "match": C.match_score(F.col("call_info"), F.col("filter")), "completeness": F.coalesce("completeness", F.lit(0.1)), "consistency": F.coalesce("consistency", F.lit(0.5)), "specificity": F.coalesce("specificity", F.lit(1.0)),
    }
    out = out.withColumn("confidence", F.round(C.confidence(parts), 2)).withColumn("confidence_label", S.confidence_label(F.col("confidence")))
    if res.function is not None:
        out = out.join(phenotypes(calls.select("sample_id", "genotype"), res.function), "sample_id", "left")
    return out
