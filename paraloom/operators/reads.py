"""Evidence of single fragments: phasing, majority votes, mixtures over candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.operators.pair_search import best_pairs


def phasing_modes(rows: DataFrame, keys: list[str], fragment: str, site: str, alt: str) -> DataFrame:
    """(keys, pattern, n): sorted site:alt patterns of fragments that see two or more sites, and how many have each."""
    seen = rows.where(F.col(alt).isNotNull()).groupBy(*keys, fragment, site).agg(F.max(alt).alias("__a"))
    words = F.concat_ws(":", F.col(site), F.col("__a").cast("int").cast("string"))
    whole = seen.groupBy(*keys, fragment).agg(F.count("*").alias("__n"), F.array_join(F.array_sort(F.collect_list(words)), ",").alias("pattern")).where(F.col("__n") >= 2)
    return whole.groupBy(*keys, "pattern").agg(F.count("*").alias("n"))


def majority(rows: DataFrame, keys: list[str], is_alt: Column, is_ref: Column) -> DataFrame:
    """(keys, alt, ref, is_alt): the side with more observations; ties have no row."""
    votes = rows.groupBy(*keys).agg(F.count_if(is_alt).alias("alt"), F.count_if(is_ref).alias("ref"))
    return votes.where("alt <> ref").withColumn("is_alt", F.col("alt") > F.col("ref"))


def cis_trans(rows: DataFrame, keys: list[str], fragment: str, site: str, alt: str, first: str, second: str) -> DataFrame:
    """(keys, cis, trans): fragments with both alternatives, and with one; both references say nothing."""
    of = lambda s: F.max(F.when(F.col(site) == s, F.col(alt)))
    pairs = rows.groupBy(*keys, fragment).agg(of(first).alias("__a"), of(second).alias("__b"))
    return pairs.groupBy(*keys).agg(F.count_if(F.col("__a") & F.col("__b")).alias("cis"), F.count_if(F.col("__a") != F.col("__b")).alias("trans"))


def phase_winner(pairs: DataFrame, keys: list[str], alternative: str, support: str, least: int = 3, times: int = 3) -> DataFrame:
    """(keys, alternative): the candidate that has `least` fragments or more and `times` those of every other."""
    w = Window.partitionBy(*keys).orderBy(F.desc(support), alternative)
    ranked = pairs.withColumn("__k", F.row_number().over(w)).withColumn("__next", F.coalesce(F.lead(support).over(w), F.lit(0)))
    return ranked.where((F.col("__k") == 1) & (F.col(support) >= least) & (F.col(support) >= times * F.col("__next"))).select(*keys, alternative)


def well_mapped(loglik: DataFrame, keys: list[str], read: str, value: str, n_sites: str, least: float = -1.5) -> DataFrame:
    """(keys, read) of reads that some haplotype explains: -1.5 a site or better."""
    return loglik.groupBy(*keys, read).agg(F.max(value).alias("__v"), F.first(n_sites).alias("__n")).where(F.col("__v") >= least * F.col("__n")).select(*keys, read)


def paralog_mixture(loglik: DataFrame, keys: list[str], read: str, item: str, value: str, other: str, copies: str, most: int | None = None) -> DataFrame:
    """(keys, a, b, total): pairs of haplotypes beside a paralog that each read may come from, or the best `most` of them.

    loglik has a row per read and haplotype with its log likelihood and that of the paralog (`other`). Of `copies` + 1 sources the
    paralog is one; the pair shares the rest by every split, and the best counts (a pair of one haplotype has it all).
    """
    return best_pairs(loglik, keys, read, item, value, other, copies, most)


def posteriors(scored: DataFrame, keys: list[str], total: str, most: int = 20) -> DataFrame:
    """The best `most` rows of each key with their normalised posterior."""
    best = Window.partitionBy(*keys).orderBy(F.desc(total), "a", "b")
    w = Window.partitionBy(*keys)
    top = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).withColumn("__w", F.exp(F.col(total) - F.max(total).over(w)))
    return top.withColumn("posterior", F.col("__w") / F.sum("__w").over(w)).drop("__w")


def allele_copies(sites: DataFrame, alt: str, ref: str, cn: str) -> DataFrame:
    """sites with `copies`: round(af * cn) of heterozygous sites of three copies or more."""
    af = F.try_divide(F.col(alt).cast("double"), F.col(alt) + F.col(ref))
    return sites.withColumn("copies", F.when((F.col(cn) >= 3) & (af >= 0.1) & (af <= 0.9), F.round(af * F.col(cn)).cast("int")))


def clip_clusters(clips: DataFrame, keys: list[str], pos: str, side: str, length: str, least_length: int = 20, width: int = 10, least: int = 3) -> DataFrame:
    from paraloom.operators.aggregates import two_sided_histogram

    return two_sided_histogram(clips.where(F.col(length) >= least_length), keys, pos, side, width, least)
