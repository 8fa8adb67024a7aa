"""Joins of positions with intervals, and what is counted over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paraloom.operators.sides import small

#: Reads that depth counts: no secondary or supplementary alignments; duplicates stay.
NOT_PRIMARY = 0x900
#: Reads that a pileup counts: no duplicates either.
NOT_PILEUP = 0xD00


def point_in_interval(points: DataFrame, intervals: DataFrame, pos: str, start: str, end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """points joined with the intervals [start, end) that hold them.

    Both sides are cut into buckets of `width`, so the join is on equal buckets and scales with the rows, whatever
    their number; an interval stands in each bucket that it meets.
    """
    held = intervals.where(F.col(end) > F.col(start)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    found = points.withColumn("__b", F.floor(F.col(pos) / width)).join(held, ["__b", *on])
    return found.where((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("__b")


def overlapping(rows: DataFrame, sites: DataFrame, start: str, end: str, pos: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """The same seen from the other side: rows that are intervals, joined with the sites that they cover."""
    return point_in_interval(sites, rows, pos, start, end, width, on)


def interval_counts(points: DataFrame, intervals: DataFrame, keys: list[str], pos: str, start: str, end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """(keys, n): points in each interval, 0 where there are none; keys name an interval."""
    counted = point_in_interval(points, intervals, pos, start, end, width, on).groupBy(*keys).agg(F.count("*").alias("n"))
    return intervals.select(*keys).join(counted, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def primary(reads: DataFrame, min_mapq: int = 0) -> DataFrame:
    return reads.where((F.col("flag").bitwiseAND(NOT_PRIMARY) == 0) & (F.col("mapq") >= min_mapq))


def region_read_counts(reads: DataFrame, regions: DataFrame, keys: list[str], width: int = 1 << 14) -> DataFrame:
    """(keys, name, count): primary reads that start in each region, for every sample that has reads.

    One pass over a few narrow columns: the regions go to every task, and a read outside all of them is kept as one of no region, so the same rows tell which samples there are.
    Where no region has a name, a sample has one row without.
    """
    cut = regions.where("end > start").select("chrom", "name", "start", "end").withColumn("__b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    cut = cut.select(F.col("chrom").alias("__c"), "__b", "name", F.col("start").alias("__s"), F.col("end").alias("__e"))
    some = reads.select(*keys, "chrom", "pos", ((F.col("flag").bitwiseAND(NOT_PRIMARY) == 0) & (F.col("mapq") >= 0)).alias("__ok"))
    inside = F.col("__ok") & (F.col("chrom") == F.col("__c")) & (F.floor(F.col("pos") / width) == F.col("__b")) & (F.col("pos") >= F.col("__s")) & (F.col("pos") < F.col("__e"))
    found = some.join(small(cut), inside, "left").groupBy(*keys, "name").agg(F.count("*").alias("count"))
    # a sample's regions, as many as there are names
    held = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "count")))).alias("__m"))
    names = small(regions.select("name").where("name is not null").distinct())
    return held.join(names, F.lit(True), "left").select(*keys, "name", F.coalesce(F.try_element_at("__m", F.col("name")), F.lit(0)).alias("count"))


def site_bases(reads: DataFrame, sites: DataFrame, min_mapq: int = 0, min_span: int = 0, width: int = 1 << 10, most_span: int | None = None) -> DataFrame:
    """(reads' columns, site columns, qpos): pileup reads over each site with the offset of the site in the read.

    sites (idx, chrom, pos, ...); a site inside a deletion or a skip has no offset and no row. Pairs that are min_span apart
    or more count, and with most_span only those that are nearer than that.
    """
    blocks = F.expr(
        """aggregate(cigar, named_struct('r', pos, 'q', 0L, 'b', array_repeat(named_struct('rs', 0L, 'qs', 0L, 'n', 0L), 0)),
             (a, c) -> named_struct(
               'r', a.r + if(c.op in ('M', '=', 'X', 'D', 'N'), c.len, 0), 'q', a.q + if(c.op in ('M', '=', 'X', 'I', 'S'), c.len, 0),
               'b', if(c.op in ('M', '=', 'X'), concat(a.b, array(named_struct('rs', a.r, 'qs', a.q, 'n', cast(c.len as bigint)))), a.b))).b"""
    )
    use = reads.where((F.col("flag").bitwiseAND(NOT_PILEUP) == 0) & (F.col("mapq") >= min_mapq) & (F.abs("tlen") >= min_span))
    use = use if most_span is None else use.where(F.abs("tlen") < most_span)
    aligned = use.withColumn("__block", F.explode(blocks)).withColumn("__rs", F.col("__block.rs")).withColumn("__re", F.col("__block.rs") + F.col("__block.n"))
    found = overlapping(aligned, sites.withColumnRenamed("pos", "site_pos"), "__rs", "__re", "site_pos", width, ("chrom",))
    return found.withColumn("qpos", F.col("__block.qs") + F.col("site_pos") - F.col("__rs")).drop("__block", "__rs", "__re")


def allele_reads(bases: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, allele, strand, qname): reads whose bases equal one of an allele's alternatives in full (alleles1, alleles2: arrays)."""
    sides = F.explode(F.array(F.struct(F.lit(1).alias("allele"), F.col("alleles1").alias("a")), F.struct(F.lit(2).alias("allele"), F.col("alleles2").alias("a"))))
    rows = bases.withColumn("__s", sides)
    hit = F.exists("__s.a", lambda a: (F.col("qpos") + F.length(a) <= F.length("seq")) & (F.col("seq").substr(F.col("qpos").cast("int") + 1, F.length(a)) == a))
    strand = F.when(F.col("flag").bitwiseAND(16) == 0, "fwd").otherwise("rev")
    return rows.where(hit).select(*keys, "idx", F.col("__s.allele").alias("allele"), strand.alias("strand"), "qname")


def haplotype_bases(bases: DataFrame) -> DataFrame:
    """bases with `base`: as many bases of the read as the shorter side's alleles have; a read that ends with them tells nothing."""
    size = F.least(F.length(F.array_join("alleles1", ",")), F.length(F.array_join("alleles2", ",")))
    return bases.where(F.col("qpos") + size < F.length("seq")).withColumn("base", F.col("seq").substr(F.col("qpos").cast("int") + 1, size))


def supporting_counts(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, n1, n2, n1_fwd, n1_rev): distinct fragments; one on both strands counts once in n1 and once in each strand."""
    of = lambda allele, strand=None: F.count_distinct(F.when((F.col("allele") == allele) & (F.lit(True) if strand is None else F.col("strand") == strand), F.col("qname")))
    return found.groupBy(*keys, "idx").agg(of(1).alias("n1"), of(2).alias("n2"), of(1, "fwd").alias("n1_fwd"), of(1, "rev").alias("n1_rev"))


def crossing_flags(rows: DataFrame, keys: list[str], is_one, is_two) -> DataFrame:
    """(keys, one, two, crossing): whether a key was seen with each of two properties, and with both."""
    seen = rows.groupBy(*keys).agg(F.max(F.when(is_one, 1).otherwise(0)).alias("one"), F.max(F.when(is_two, 1).otherwise(0)).alias("two"))
    return seen.withColumn("crossing", ((F.col("one") == 1) & (F.col("two") == 1)).cast("int"))


def two_coordinate(sites: DataFrame, first: str, second: str) -> DataFrame:
    """sites with one row for each of their two coordinates, as `pos`."""
    return sites.withColumn("pos", F.explode(F.array(first, second)))


def fragment_bases(rows: DataFrame, keys: list[str], site: str, base: str) -> DataFrame:
    """(keys, site, base): the base of a fragment at a site, null where its observations differ."""
    return rows.groupBy(*keys, site).agg(F.when(F.count_distinct(base) == 1, F.first(base, ignorenulls=True)).alias(base))


def haplotype_patterns(rows: DataFrame, keys: list[str], site: str, sites: list[int], is_one, is_two) -> DataFrame:
    """(keys, pattern): a character for each of the sites: 2 if seen as two, else 1 if seen as one, else x."""
    chars = [F.when(F.max(F.when((F.col(site) == s) & is_two, 1)) == 1, "2").when(F.max(F.when((F.col(site) == s) & is_one, 1)) == 1, "1").otherwise("x") for s in sites]
    return rows.groupBy(*keys).agg(F.concat(*chars).alias("pattern"))
