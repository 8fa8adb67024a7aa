"""Decisions over copy-number evidence: structural tags, variant repair, genotype spelling, filters, confidence, phenotype."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.functions.scalar import geometric_mean, without_copies

# Tag, expected copies in all, up to exon 9, from there to intron 1, and upstream of intron 1.
TAG_COPIES = (
    ("star5_star5", 2, 0, 0, 0), ("star13_star13", 2, 2, 0, 0), ("star13intron1_star13intron1", 2, 2, 2, 0), ("star5", 3, 1, 1, 1),
    ("star13", 3, 2, 1, 1), ("star13intron1", 3, 2, 2, 1), ("star5_star5_star68", 3, 0, 0, 1), ("star5_star68", 4, 1, 1, 2),
    ("cn2", 4, 2, 2, 2), ("exon9hyb_star5", 4, 2, 2, 2), ("dup_star13", 4, 3, 2, 2), ("dup_star13intron1", 4, 3, 3, 2),
    ("star13_star68", 4, 2, 1, 2), ("cn3", 5, 3, 3, 3), ("exon9hyb", 5, 2, 3, 3), ("star68", 5, 2, 2, 3),
    ("cn4", 6, 4, 4, 4), ("exon9hyb_exon9hyb", 6, 2, 4, 4), ("star68_star68", 6, 2, 2, 4), ("dup_exon9hyb", 6, 3, 4, 4),
    ("dup_star68", 6, 3, 3, 4), ("exon9hyb_star68", 6, 2, 3, 4), ("cn5", 7, 5, 5, 5), ("exon9hyb_exon9hyb_exon9hyb", 7, 2, 5, 5),
    ("star68_star68_star68", 7, 2, 2, 5), ("cn6", 8, 6, 6, 6), ("exon9hyb_exon9hyb_exon9hyb_exon9hyb", 8, 2, 6, 6), ("star68_star68_star68_star68", 8, 2, 2, 6),
)
# The last position at or below exon 9, and the first upstream of intron 1.
EXON9_POS, INTRON1_POS = 42126611, 42130500
# The site axis is cut before these indices; least support of each region's consensus, and the loose one.
REGION_ENDS = {"rep": 3, "exon9": 9, "exon9_intron4": 40, "intron4_intron1": 74, "intron1_up": None}
REGION_SUPPORT, LOOSE_SUPPORT, REP_COPIES = {"exon9": 4, "exon9_intron4": 18, "intron4_intron1": 19, "intron1_up": 25}, 15, 2
# Events that add or take a copy.
GAINS, LOSSES = ("dup", "exon9hyb", "star68"), ("star13", "star13intron1", "star5")
# Total less spacer copies that a tag implies.
SPACER_DIFF = {
    "cn2": 2, "cn3": 3, "cn4": 4, "cn5": 5, "cn6": 6, "star5": 1, "star5_star5": 0, "exon9hyb": 2, "exon9hyb_exon9hyb": 2, "exon9hyb_exon9hyb_exon9hyb": 2, "exon9hyb_exon9hyb_exon9hyb_exon9hyb": 2,
    "exon9hyb_star5": 1, "dup_exon9hyb": 3, "dup_star68": 3, "exon9hyb_star68": 2, "star68_star68": 2, "star68_star68_star68": 2, "star68_star68_star68_star68": 2,
}
# Tags that name a genotype by themselves.
DIRECT_GENOTYPES = {"star5_star5": "*5/*5", "star13_star13": "*13/*13", "star13intron1_star13intron1": "*13/*13", "star5_star5_star68": "*5/*68"}
# Variant sites with little and with much noise.
CLEAN_VARIANTS = ("g.42129809T>C", "g.42129819G>T", "g.42128945C>T", "g.42126611C>G", "g.42130692G>A", "g.42127941G>A")
NOISY_VARIANTS = ("g.42127473C>T", "g.42129042T>C", "g.42129174C>A", "g.42129180A>T", "g.42127526C>T", "g.42128325A>G", "g.42126877G>A", "g.42127973T>C", "g.42127556T>C")
WEIGHTS = {"depth": 0.10, "cn": 0.20, "match": 0.25, "completeness": 0.20, "consistency": 0.10, "specificity": 0.15}


def tag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TAG_COPIES), "tag string, total int, exon9_down int, exon9_intron1 int, intron1_up int")


def expected_copies(sites: DataFrame, pos: str, tag: str) -> DataFrame:
    """sites with `expected`: the copies that their tag implies at their position; null for a tag that is not known."""
    table = tag_table(sites.sparkSession).withColumnRenamed("tag", "__tag")
    met = sites.join(F.broadcast(table), F.col(tag) == F.col("__tag"), "left")  # 28 rows
    zone = F.when(F.col(pos) <= EXON9_POS, F.col("exon9_down")).when(F.col(pos) >= INTRON1_POS, F.col("intron1_up")).otherwise(F.col("exon9_intron1"))
    return met.withColumn("expected", zone).drop("__tag", "total", "exon9_down", "exon9_intron1", "intron1_up")


def region_of(idx: Column) -> Column:
    out = None
    for name, end in REGION_ENDS.items():
        out = (F.when(idx < end, name) if out is None else out.when(idx < end, name)) if end is not None else out.otherwise(name)
    return out


def region_consensus(site_cn: DataFrame, keys: list[str], idx: str, cn: str) -> DataFrame:
    """(keys, a column per region): the modal copies of a region's sites where enough agree. Sites without a call do not count."""
    held = site_cn.where(F.col(cn).isNotNull()).withColumn("__region", region_of(F.col(idx)))
    counted = held.groupBy(*keys, "__region", cn).agg(F.count("*").alias("__n"))
    best = counted.groupBy(*keys, "__region").agg(F.max_by(cn, F.struct("__n", -F.col(cn))).alias("__v"), F.max("__n").alias("__s"))
    pick = lambda r: F.max(F.when((F.col("__region") == r) & (F.col("__s") >= REGION_SUPPORT[r]), F.col("__v"))).alias(r)
    return best.groupBy(*keys).agg(*map(pick, REGION_SUPPORT))


def loose_support(site_cn: DataFrame, keys: list[str], idx: str, cn: str, total: str) -> DataFrame:
    """(keys, loose): whether enough sites upstream of intron 1 have the copies that the total implies."""
    hit = (region_of(F.col(idx)) == "intron1_up") & (F.col(cn) == F.col(total) - 2) & (F.col(total) >= 2)
    return site_cn.groupBy(*keys).agg((F.count_if(hit) >= LOOSE_SUPPORT).alias("loose"))


def fill_consensus(rows: DataFrame, total: str, spacer: str, exon9: str, loose: str) -> DataFrame:
    """rows (one per sample, with the region columns) with gaps filled: from a neighbour, the total, the spacer and exon 9's own call."""
    mid, far = F.col("exon9_intron4"), F.col("intron4_intron1")
    filled = rows.withColumn("exon9_intron4", F.coalesce(mid, far)).withColumn("intron4_intron1", F.coalesce(far, mid))
    filled = filled.withColumn("intron1_up", F.coalesce("intron1_up", F.when(F.col(loose), F.col(total) - 2)))
    by_spacer, own, body = F.col(total) - F.col(spacer), F.col(exon9), F.col("exon9_intron4")
    between = ((by_spacer < own) & (own <= body)) | ((by_spacer > own) & (own >= body))
    return filled.withColumn("exon9", F.coalesce(F.when(F.col(spacer).isNotNull(), F.when(between, own).otherwise(by_spacer)).otherwise(F.col("exon9")), own))


def structural_tag(rows: DataFrame, total: str = "total_cn", rep_col: str | None = None) -> DataFrame:
    """rows (with the region columns) with `tag`: the events between regions if they balance, spelled as known; cn2 without events.

    The region before exon 9 has two copies unless a column tells; then events that do not balance leave no tag.
    """
    up, far, mid, low, rep = F.col("intron1_up"), F.col("intron4_intron1"), F.col("exon9_intron4"), F.col("exon9"), F.lit(REP_COPIES) if rep_col is None else F.col(rep_col)
    step = lambda a, b: F.coalesce(F.greatest(a - b, F.lit(0)), F.lit(0)).cast("int")
    n = {"star13intron1": step(far, up) + step(mid, far), "star68": step(up, far), "star13": step(low, mid), "exon9hyb": step(mid, low), "star5": step(rep, low), "dup": step(low, rep)}
    gained = sum((n[e] for e in GAINS), F.lit(0)) - sum((n[e] for e in LOSSES), F.lit(0))
    some = sum(n.values(), F.lit(0)) > 0
    # pairs that take each other back, unless they are all there is
    only = lambda a, b: (n[a] == 1) & (n[b] == 1) & (sum(n.values(), F.lit(0)) == 2)
    off5 = F.when(only("exon9hyb", "star5"), 0).otherwise(F.least(n["exon9hyb"], n["star5"]))
    off13 = F.when(only("dup", "star13"), 0).otherwise(F.least(n["dup"], n["star13"]))
    left = n | {"exon9hyb": n["exon9hyb"] - off5, "star5": n["star5"] - off5, "dup": n["dup"] - off13, "star13": n["star13"] - off13}
    names = F.concat(*[F.array_repeat(F.lit(e), left[e]) for e in sorted(left)])
    special = (n["dup"] == 2) & (n["exon9hyb"] == 1) & (n["star13intron1"] == 1) & (sum(n.values(), F.lit(0)) == 4)
    all_dups = (F.size(names) > 0) & F.forall(names, lambda x: x == "dup")
    spelled = F.when(all_dups, F.concat(F.lit("cn"), (F.size(names) + 2).cast("string"))).when(special, "cn4").otherwise(F.array_join(names, "_"))
    none = (mid == 2) & (far == 2) & (up == 2) & (F.lit(True) if rep_col is None else ~some)
    tag = F.when(up.isNull() | (F.col(total) < 2) | (up != F.col(total) - 2), None).when(some & (gained + 2 == up), spelled).when(none, "cn2")
    return rows.withColumn("tag", tag)


def known_tag(tag: Column) -> Column:
    return F.when(tag.isin(*[t[0] for t in TAG_COPIES]), tag)


def changepoint_tag(total: Column, n_segments: Column, first_mean: Column, last_mean: Column, first_valid: Column, last_valid: Column) -> Column:
    """The hybrid that a step between two ends of a profile suggests."""
    diff = first_mean - last_mean
    falls = F.when(total == 2, "star13").when(total == 3, "dup_star13")
    rises = F.when(total == 2, "star5_star68").when(total == 3, "star68").when(total == 4, "star68_star68")
    return F.when(n_segments.isin(2, 3) & (first_valid >= 10) & (last_valid >= 10), F.when(diff > 0.20, falls).when(diff < -0.20, rises))


def fallback_copies(cn: Column, depth: Column) -> Column:
    """The nearest integer where the model gives none and the depth is above all of its states."""
    return F.coalesce(cn, F.when(depth > 7.5, F.round(depth)).cast("int"))


def exon9_call(calls: list[Column], raw: list[Column], by_mean: Column) -> Column:
    """Copies at exon 9 where its sites and their mean agree; one copy needs low raw counts too."""
    seen = F.array_distinct(F.filter(F.array(*calls), lambda x: x.isNotNull()))
    one = F.when(F.size(seen) == 1, seen[0])
    low = (F.least(*raw) < 1.2) & (F.greatest(*raw) < 1.3)
    return F.when((one == by_mean) & ((one != 1) | low), one)


def repair_variants(names: Column, tag: Column, exon9: Column | None = None, exon9_cn: Column | None = None, raw: list[Column] | None = None) -> Column:
    """The called variants with what a structural tag implies added or taken, as a sorted multiset.

    With the consensus at exon 9, its own call and the raw copies at its sites, a conversion of exon 9 alone is added too.
    """
    count = lambda v: F.size(F.filter(names, lambda x: x == v))
    repeat = lambda v, n: F.array_repeat(F.lit(v), F.greatest(n, F.lit(0)).cast("int"))
    lead = lambda a, b: F.when(count(a) > count(b), count(a) - count(b)).otherwise(0)
    hybrids = F.size(F.filter(F.split(tag, "_"), lambda x: x == "exon9hyb"))
    hybrid = (hybrids > 0) & (tag != "exon9hyb_star5")
    fresh = hybrid & (count("exon9gc") == 0)
    more819 = lead("g.42129809T>C", "g.42129819G>T")
    n819 = count("g.42129819G>T") + more819
    topped = lambda v, n, unless=None: F.when(hybrid & (n > 0) & (n <= hybrids) & (F.lit(True) if unless is None else count(unless) == 0), 1).otherwise(0)
    drop = F.when(F.contains(tag, F.lit("star13")) & ~F.contains(tag, F.lit("intron1")) & (count("g.42126611C>G") > 0), 1).otherwise(0)
    at = F.array_position(names, "g.42126611C>G").cast("int")
    kept = F.when(drop == 1, F.filter(names, lambda x, i: i + 1 != at)).otherwise(names)
    top9754 = topped("g.42129754G>A", count("g.42129754G>A"), "g.42128945C>T")
    added = [
        repeat("g.42129819G>T", more819), repeat("g.42127556T>C", lead("g.42127565T>C", "g.42127556T>C")), repeat("exon9gc", F.when(fresh, hybrids).otherwise(0)), repeat("g.42126611C>G", F.when(fresh, hybrids).otherwise(0)),
        repeat("g.42130692G>A", topped("", count("g.42130692G>A"))), repeat("g.42129754G>A", top9754),
        repeat("g.42128945C>T", topped("", count("g.42128945C>T"), "g.42129754G>A")), repeat("g.42129809T>C", topped("", count("g.42129809T>C"), "g.42129754G>A")), repeat("g.42129819G>T", topped("", n819, "g.42129754G>A")),
    ]
    whole = F.concat(kept, *added)
    if exon9 is not None:
        less = (exon9 - exon9_cn).cast("int")
        lacks = ~F.array_contains(whole, F.lit("g.42126611C>G"))
        low = (F.least(*raw) < 1.15) & (F.greatest(*raw) < 1.2)
        own = (F.contains(tag, F.lit("exon9hyb")) | (tag == "cn2")) & (less > 0) & (exon9_cn <= 1) & (lacks | low)
        times = F.when(F.coalesce(own, F.lit(False)), less).otherwise(0)
        whole = F.concat(whole, F.array_repeat(F.lit("exon9gc"), times), F.array_repeat(F.lit("g.42126611C>G"), F.when(lacks, times).otherwise(0)))
    return F.array_sort(F.filter(whole, lambda x: x != "NA"))


def _repeats(stars: list[str]) -> list[str]:
    return [s if n == 1 else f"{s}x{n}" for s, n in Counter(stars).items()]


def _without(stars: list[str], *gone: str) -> list[str] | None:
    """The stars less one of each named, or null if one is missing."""
    rest = Counter(stars)
    rest.subtract(gone)
    return None if min(rest.values()) < 0 else sorted(rest.elements())


# Spellings of whole calls with several hybrids, and of star68 calls on *4 alone.
HYBRID_CALLS = {
    "*4_*4_*4.013_*4.013": "*4.013+*4/*4.013+*4", "*10_*36_*36_*36": "*36+*10/*36x2",
    "*10_*10_*36_*36_*36": "*36+*10/*36x2+*10", "*10_*10_*36_*36_*36_*36": "*36x2+*10/*36x2+*10",
}
STAR68_CALLS = {1: "*4/*68+*4", 2: "*68+*4/*68+*4", 3: "*68+*4/*68+*68+*4", 4: "*68+*68+*4/*68+*68+*4"}


def spell_call(forms: list[str], tag: str, spacer: int | None) -> str | None:
    """The genotype of a tag from its main-allele forms: haplotypes apart by `/`, tandem copies by `+` or xN, alternatives by `;`."""
    forms = sorted(forms)
    if len(forms) != 1:
        if len(forms) == 2 and tag == "cn2":
            return ";".join(f.replace("_", "/") for f in forms)
        return "*4/*36+*10" if forms == ["*10_*10_*4.013", "*10_*36_*4"] else ";".join(forms)
    whole, stars, events = forms[0], forms[0].split("_"), tag.split("_")
    wide = spacer is not None
    if tag == "star5_star68":
        return "*5/*68+*4" if whole == "*4" else f"*68/{whole}"
    if tag == "star13_star68":
        return "*13/*68+*4" if whole == "*4" else f"*13_{whole}_*68"
    if tag in ("star5", "star13"):
        return f"{whole}/*{tag[4:]}"
    if tag == "cn2":
        return "/".join(stars)
    if tag == "star13intron1":
        rest = _without(stars, "*2")
        return None if rest is None else f"*13/{rest[0]}"
    if tag == "dup_star13intron1":
        many = Counter(stars).most_common()
        return f"*13+{many[0][0]}/{many[-1][0]}" if len(many) == 1 or (len(many) == 2 and 2 in (many[0][1], many[1][1])) else None
    if tag == "dup_star13":
        return "_".join([*stars, "*13"]) if spacer == 1 else "/".join(stars)
    if tag[:2] == "cn" and len(tag) == 3:
        each = _repeats(stars)
        if len(each) == 1 and tag in ("cn3", "cn4", "cn5", "cn6"):
            less, more = len(tag) and int(tag[2]) // 2, int(tag[2]) - int(tag[2]) // 2
            return "/".join(f"{stars[0]}x{n}" if n > 1 else stars[0] for n in (less, more))
        return ("/" if len(each) == 2 else "_").join(each)
    if tag == "exon9hyb_star5":
        if whole == "*10_*10":
            return "*5/*36+*10" if wide and spacer > 2 else None
        return "*5/*4.013+*4" if whole == "*4_*4" and wide and spacer > 2 else "/".join(stars)
    if tag == "exon9hyb":
        for pair in (("*4", "*4.013"), ("*10", "*36")):
            rest = _without(stars, *pair)
            if rest is not None:
                return "*36/*36+*10;*10/*36x2" if rest[0] == "*36" and pair[1] == "*36" else f"{rest[0]}/{pair[1]}+{pair[0]}"
        if stars.count("*36") == 2:
            return f"*36x2/{next(s for s in stars if s != '*36')}"
    if tag == "dup_exon9hyb":
        hybrid = ("*10", "*36") if "*36" in stars else ("*4", "*4.013") if "*4.013" in stars else ()
        own = [s for s in stars if s not in hybrid] if hybrid else []
        if len(own) == 2:
            rest = "+".join(sorted((s for s in stars if s not in own), reverse=True))
            return f"{own[0]}x2/{rest}" if own[0] == own[1] else f"{own[0]}+{own[1]}/{rest}"
        if not own and whole in ("*10_*10_*10_*36", "*4_*4_*4_*4.013"):
            return f"{stars[0]}x2/{stars[-1]}+{stars[0]}"
    if set(events) == {"exon9hyb"} and len(events) > 1:
        if len(events) == 2 and whole == "*10_*10_*36_*36":
            return "*5/*36x2+*10x2" if wide and spacer > 4 else "*36+*10/*36+*10"
        if whole in HYBRID_CALLS:
            return HYBRID_CALLS[whole]
        rest = _without(stars, "*10", "*36", "*36", "*83") if len(events) == 3 and stars.count("*36") == 2 else None
        if rest is not None and len(rest) == 1:
            return f"{rest[0]}/*36x2+*83+*10"
        own = [s for s in stars if s not in ("*10", "*36", "*83")]
        if len(own) == 1:
            return f"{own[0]}/{'+'.join(sorted(_without(stars, own[0]), reverse=True))}"
    if "star68" in events:
        copies = events.count("star68")
        if set(events) == {"star68"}:
            for base in ("*4", "*45"):
                other = [s for s in stars if s != base]
                if base in stars and len(other) == 1:
                    return f"{other[0]}/{'*68+' * copies}{base}"
                if base == "*4" and stars == ["*4", "*4"]:
                    return STAR68_CALLS.get(copies)
        if tag == "dup_star68":
            own = [s for s in stars if s not in ("*4", "*68")]
            if len(own) == 2 and own[0] == own[1]:
                return f"{own[0]}x2/*68+*4"
            if whole == "*4_*4_*4":
                return "*4x2/*68+*4"
        if tag == "exon9hyb_star68" and whole == "*4_*4_*4.013":
            return "*4.013+*4/*68+*4"
        return "_".join(stars + ["*68"] * copies)
    return whole


def spelled_calls(rows: DataFrame, forms: str, tag: str, spacer: str, out: str = "spelled") -> DataFrame:
    """rows with the spelled genotype; each distinct combination of forms, tag and spacer is spelled once and joined back."""
    keys = [F.to_json(forms).alias("__f"), F.col(tag).alias("__t"), F.col(spacer).cast("int").alias("__s")]

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            found = [None if t is None or f is None else spell_call(list(f), t, None if pd.isna(s) else int(s)) for f, t, s in zip(x["forms"], x["__t"], x["__s"], strict=True)]
            yield x.drop(columns="forms").assign(__g=pd.Series(found, dtype=object, index=x.index))

    each = rows.select(*keys, F.col(forms).alias("forms")).dropDuplicates(["__f", "__t", "__s"])
    told = each.mapInPandas(spell, "__f string, __t string, __s int, __g string")
    held = rows.withColumns({"__f": F.to_json(forms), "__t": F.col(tag), "__s": F.col(spacer).cast("int")})
    same = [held[c].eqNullSafe(told[c]) for c in ("__f", "__t", "__s")]
    return held.join(told, same, "left").select(*[held[c] for c in rows.columns], F.col("__g").alias(out))


def resolve_cn2(genotype: Column, tag: Column, info: Column, cis_938: Column, trans_803: Column) -> Column:
    """Two pairs of diplotypes that share their variants, told apart by haplotype flags."""
    parts = F.array_sort(F.split(genotype, "[;/]+"))
    is_pair = lambda *x: parts == F.array(*map(F.lit, x))
    open_ = (info == "more_than_one_match") & (tag == "cn2")
    first = F.when(cis_938, "*1/*32").otherwise("*27/*41")
    second = F.when(trans_803, "*119/*2").otherwise("*1/*41")
    return F.when(open_ & is_pair("*1", "*27", "*32", "*41"), first).when(open_ & is_pair("*1", "*119", "*2", "*41"), second).otherwise(genotype)


def call_filter(genotype: Column, high_cn: Column, fuzzy: Column) -> Column:
    """The filter of a call, the first that holds; null without a call."""
    return (
        F.when(genotype.isNull(), None).when(F.contains(genotype, F.lit(";")), "More_than_one_possible_genotype").when(~F.contains(genotype, F.lit("/")), "Not_assigned_to_haplotypes")
        .when(high_cn, "LowQ_high_CN").when(fuzzy, "Fuzzy_match").otherwise("PASS")
    )


def spacer_filter(current: Column, tag: Column, total: Column, spacer: Column) -> Column:
    """A passing filter replaced where total less spacer is not what the tag implies."""
    table = F.create_map(*[F.lit(x) for pair in SPACER_DIFF.items() for x in pair])
    off = (total - spacer) != F.try_element_at(table, tag)
    return F.when(current.isin("PASS", "Fuzzy_match") & off, "Spacer_CN_inconsistent").otherwise(current)


def conversion_map(profile: DataFrame, keys: list[str], idx: str, ratio: str, size: int = 5, least: int = 3) -> DataFrame:
    """(keys, n_high, n_low, chimeric): full windows of sites whose mean ratio is over 0.35 or under 0.15."""
    w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(0, size - 1)
    mean = F.when((F.count("*").over(w) == size) & (F.count(ratio).over(w) >= least), F.avg(ratio).over(w))
    counted = profile.withColumn("__m", mean).groupBy(*keys).agg(F.count_if(F.col("__m") > 0.35).alias("n_high"), F.count_if(F.col("__m") < 0.15).alias("n_low"))
    return counted.withColumn("chimeric", (F.col("n_high") >= 3) & (F.col("n_low") >= 3))


def mismatch_share(defining: DataFrame, keys: list[str], alt: str, ref: str, least_depth: int = 5, low: float = 0.05) -> DataFrame:
    """(keys, n_sites, share): the share of a call's defining sites with hardly any alternative reads."""
    deep = F.col(alt) + F.col(ref) >= least_depth
    return defining.groupBy(*keys).agg(F.count_if(deep).alias("n_sites"), F.try_divide(F.count_if(deep & (F.col(alt) < low * (F.col(alt) + F.col(ref)))).cast("double"), F.count_if(deep)).alias("share"))


def balance_deviation(het: DataFrame, keys: list[str], alt: str, ref: str, least_sites: int = 2) -> DataFrame:
    """(keys, deviation): the mean distance of allele fractions from a half over heterozygous defining sites."""
    vaf = F.try_divide(F.col(alt).cast("double"), F.col(alt) + F.col(ref))
    return het.groupBy(*keys).agg(F.when(F.count(vaf) >= least_sites, F.avg(F.abs(vaf - 0.5))).alias("deviation"))


def hemizygous(sites: DataFrame, keys: list[str], ratio: str, least: int = 20, most_het: int = 2, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(keys, n_sites, n_het, hemizygous)."""
    counted = sites.where(F.col(ratio).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n_sites"), F.count_if((F.col(ratio) > low) & (F.col(ratio) < high)).alias("n_het"))
    return counted.withColumn("hemizygous", (F.col("n_sites") >= least) & (F.col("n_het") <= most_het))


def confidence(parts: dict[str, Column]) -> Column:
    return geometric_mean(list(parts.values()), [WEIGHTS[k] for k in parts])


def ramp(x: Column, good: float, bad: float, floor: float) -> Column:
    """1 up to `good`, falling evenly to `floor` at `bad` and beyond; good may be above bad, for values that should be large."""
    share = (x - good) / (bad - good)
    return 1 - (1 - floor) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def depth_score(depth: Column, mad: Column) -> Column:
    """Depth is full from 40 on, spread up to 0.10."""
    return ramp(depth, 40.0, 5.0, 0.2) * ramp(mad, 0.10, 0.30, 0.3)


def rounding_score(total: Column, spacer: Column) -> Column:
    """How near two copy-number depths are to integers."""
    return (ramp(F.abs(total - F.round(total)), 0.15, 0.40, 0.3) + ramp(F.abs(spacer - F.round(spacer)), 0.15, 0.40, 0.3)) / 2


def match_score(info: Column, current: Column) -> Column:
    """What kind of match a call is, and its filter."""
    base = F.when(info.isNull() | (info == "no_match"), 0.1).when(info == "unique_match", 1.0).when(info == "more_than_one_match", 0.7).when(F.startswith(info, F.lit("fuzzy_match")), 0.4).otherwise(0.5)
    kept = F.when(current == "PASS", 1.0).when(current == "More_than_one_possible_genotype", 0.7).when(current == "Fuzzy_match", 0.6).when(current == "LowQ_high_CN", 0.4).when(current == "Not_assigned_to_haplotypes", 0.2).otherwise(0.5)
    return base * kept


def consistency_score(site_depths: DataFrame, keys: list[str], value: str, least: int = 10) -> DataFrame:
    """(keys, consistency): how near the sites of a profile are to integers; 0.5 for few sites."""
    off = F.avg(F.abs(F.col(value) - F.round(value)))
    return site_depths.groupBy(*keys).agg(F.when(F.count(value) >= least, ramp(off, 0.10, 0.35, 0.3)).otherwise(0.5).alias("consistency"))


def variant_scores(calls: DataFrame, counts: DataFrame, stars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, completeness, specificity) of calls (keys, genotype) from counts (keys, name, alt, ref) and star items (name, parts).

    Completeness is the share of the first diplotype's defining variants that have alternative reads; specificity falls with
    the share of deep sites whose alternative is over 15 % without being expected.
    """
    parts = calls.select(*keys, "genotype", F.explode_outer(F.split(F.split("genotype", ";")[0], r"[/+]")).alias("__s")).withColumn("__s", without_copies(F.col("__s")))
    items = stars.select(F.col("name").alias("__s"), F.explode("parts").alias("name")).where("name <> 'exon9gc'")
    expected = parts.join(items, "__s").select(*keys, "name").distinct()
    seen = expected.join(counts, [*keys, "name"], "left").groupBy(*keys).agg((F.count_if(F.col("alt") > 0) / F.count("*")).alias("__c"))
    deep = counts.where(F.col("alt") + F.col("ref") >= 10).join(expected.withColumn("__e", F.lit(True)), [*keys, "name"], "left")
    odd = F.count_if((F.col("alt") / (F.col("alt") + F.col("ref")) > 0.15) & F.col("__e").isNull())
    more = deep.groupBy(*keys).agg(F.greatest(F.lit(0.2), 1 - 5 * odd / F.count("*")).alias("__p"))
    met = calls.select(*keys, "genotype").join(seen, keys, "left").join(more, keys, "left")
    none = F.col("__c").isNull()
    return met.select(*keys, F.when(F.col("genotype").isNull(), 0.1).when(none, 1.0).otherwise(F.col("__c")).alias("completeness"), F.when(F.col("genotype").isNull() | none, 1.0).otherwise(F.coalesce("__p", F.lit(1.0))).alias("specificity"))


def activity_score(alleles: DataFrame, keys: list[str], function: DataFrame) -> DataFrame:
    """(keys, score): the sum of a call's allele activities from a table (haplotype, activity); null if one is missing or `n/a`."""
    met = alleles.join(function.select(F.col("haplotype").alias("allele"), F.expr("try_cast(activity as double)").alias("__a")), "allele", "left")
    return met.groupBy(*keys).agg(F.when(F.count("*") == F.count("__a"), F.sum("__a")).alias("score"))


def ambiguity(alternatives: DataFrame, keys: list[str], phenotype: str) -> DataFrame:
    """(keys, n_alternatives, reflex): long reads help where the alternatives' phenotypes differ."""
    return alternatives.groupBy(*keys).agg(F.count("*").alias("n_alternatives"), (F.count_distinct(phenotype) > 1).alias("reflex"))
