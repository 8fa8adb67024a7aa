"""Loaders for definition tables and count files, and the sinks. Every path is read by Spark, so it may be in any store.

Lines have an order that matters; `ord` keeps it. A definition table is one small file, read as one partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

READS = (
    "sample_id string, qname string, flag int, chrom string, pos long, end_pos long, mapq int, tlen long, "
    "cigar array<struct<op:string,len:int>>, seq string, qual array<int>"
)
DEFAULT_READ_LENGTH, READS_FOR_LENGTH = 150.0, 2001


def lines(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(ord, fields): the lines of a file, split on white space, comments aside."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    kept = raw.where((F.trim("line") != "") & ~F.startswith("line", F.lit(comment)))
    return kept.select("ord", F.split(F.trim("line"), r"\s+").alias("fields"), "line")


def _chrom(genome: str):
    return F.regexp_replace(F.col("fields")[0], "^chr", "") if genome == "38" else F.col("fields")[0]


def regions(spark: SparkSession, path: str, genome: str = "38") -> DataFrame:
    rows = lines(spark, path).where(F.size("fields") >= 6)
    f = F.col("fields")
    return rows.select("ord", _chrom(genome).alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), f[3].alias("name"), f[4].alias("region_type"), f[5].cast("double").alias("gc"))


def model_parameters(spark: SparkSession, path: str) -> DataFrame:
    """(region, param, cn, value): the first definition of a state counts; a value without a state has a null cn."""
    rows = lines(spark, path).select("ord", F.col("fields")[0].alias("region"), F.col("fields")[1].alias("param"), F.posexplode(F.slice("fields", 3, 1000)).alias("k", "tok"))
    number = F.substring_index("tok", ":", -1).cast("double")
    state = F.when(F.contains("tok", F.lit(":")), F.substring_index("tok", ":", 1).cast("int"))
    return rows.select("region", "param", state.alias("cn"), number.alias("value"), "ord", "k").groupBy("region", "param", "cn").agg(F.min_by("value", F.struct("ord", "k")).alias("value"))


def sites(spark: SparkSession, path: str, genome: str = "38", group: str | None = None) -> DataFrame:
    """(idx, chrom, pos1, alleles1, pos2, alleles2, label), 0-based; idx numbers the lines that are kept. A last field `-` turns the second side round."""
    from paraloom.functions.scalar import reverse_complement

    rows = lines(spark, path)
    f = F.col("fields")
    rows = rows.where(F.element_at(f, -1) == group) if group is not None else rows
    alleles = lambda x: F.split(F.upper(x), ",")
    second = F.when(F.element_at(f, -1) == "-", F.transform(alleles(f[4]), reverse_complement)).otherwise(alleles(f[4]))
    numbered = rows.withColumn("idx", F.row_number().over(Window.orderBy("ord")) - 1)
    return numbered.select("idx", _chrom(genome).alias("chrom"), (f[1].cast("long") - 1).alias("pos1"), alleles(f[2]).alias("alleles1"), (f[3].cast("long") - 1).alias("pos2"), second.alias("alleles2"), F.element_at(f, -1).alias("label"))


def variant_names(spark: SparkSession, *paths: str) -> DataFrame:
    """(ord, name): the last fields of the files' lines, one file after the other."""
    out = None
    for k, path in enumerate(paths):
        rows = lines(spark, path).select((F.lit(k * 1_000_000) + F.col("ord")).alias("o"), F.element_at("fields", -1).alias("name"))
        out = rows if out is None else out.unionByName(rows)
    return out.select((F.row_number().over(Window.orderBy("o")) - 1).alias("ord"), "name")


def star_items(spark: SparkSession, path: str) -> DataFrame:
    """(ord, name, parts): the variants of each star allele, sorted; the last field is no variant, and NA none."""
    rows = lines(spark, path)
    parts = F.array_sort(F.filter(F.slice("fields", 2, F.size("fields") - 2), lambda x: x != "NA"))
    return rows.select("ord", F.col("fields")[0].alias("name"), parts.alias("parts"))


def wide_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(allele, grp, freq) from a tab-separated table with a column per group; blanks are null."""
    wide = spark.read.csv(path, sep="\t", header=True)
    first, *groups = wide.columns
    long = wide.unpivot([first], groups, "grp", "freq")
    return long.select(F.col(first).alias("allele"), "grp", F.expr("try_cast(freq as double)").alias("freq"))


def percent(freq: Column) -> Column:
    """A share as per cent with three decimals at most and one at least; nothing for null."""
    x = F.round(freq * 100, 3)
    return F.when(freq.isNull(), "").otherwise(F.concat(F.regexp_replace(F.format_string("%.3f", x), r"(\.\d+?)0+$", "$1"), F.lit("%")))


def haplotype_function(spark: SparkSession, path: str) -> DataFrame:
    """(haplotype, activity, function, evidence_strength, evidence_summary)."""
    wide = spark.read.csv(path, sep="\t", header=True)
    names = ("haplotype", "activity", "function", "evidence_strength", "evidence_summary")
    return wide.select(*[F.replace(F.col(f"`{c}`"), F.lit("≥"), F.lit("")).alias(n) for c, n in zip(wide.columns, names, strict=False)])


def count_file(spark: SparkSession, path: str) -> DataFrame:
    """(name, count) from pre-computed counts; the first line of a name counts."""
    rows = lines(spark, path).where(F.size("fields") >= 5).select("ord", F.col("fields")[3].alias("name"), F.element_at("fields", -1).cast("long").alias("count"))
    return rows.groupBy("name").agg(F.min_by("count", "ord").alias("count"))


def count_files(spark: SparkSession, folder: str, ending: str = "_count.txt") -> DataFrame:
    """(sample_id, name, count) of a folder with a count file for each sample."""
    raw = spark.read.text(f"{folder}/*{ending}", wholetext=True).select(F.replace(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit(ending), F.lit("")).alias("sample_id"), F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line"))
    rows = raw.select("sample_id", "ord", F.split(F.trim("line"), r"\s+").alias("fields")).where(F.size("fields") >= 5)
    rows = rows.select("sample_id", "ord", F.col("fields")[3].alias("name"), F.element_at("fields", -1).cast("long").alias("count"))
    return rows.groupBy("sample_id", "name").agg(F.min_by("count", "ord").alias("count"))


def diagnostic_panel(spark: SparkSession, path: str) -> DataFrame:
    """(kmer, source, k) of a panel's unique k-mers on both strands."""
    from paraloom.functions.scalar import reverse_complement

    raw = spark.read.json(path, multiLine=True).select("k", F.explode("positions").alias("p")).where("p.kmer_unique")
    both = raw.select("k", F.explode(F.array(F.struct(F.lit("first").alias("source"), F.col("p.cyp2d6_kmer").alias("kmer")), F.struct(F.lit("second").alias("source"), F.col("p.cyp2d7_kmer").alias("kmer")))).alias("x"))
    return both.where("x.kmer is not null").select("k", "x.source", F.explode(F.array(F.col("x.kmer"), reverse_complement(F.col("x.kmer")))).alias("kmer")).distinct()


def reads(spark: SparkSession, path: str) -> DataFrame:
    """The canonical input: Parquet with the READS columns, best written sorted by chrom and pos so that row groups are skipped."""
    return spark.read.schema(READS).parquet(path)


def read_length(reads: DataFrame, regions: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(sample_id, read_length): the median over the first reads of each sample (of samples, else of those that have reads).

    With regions (ord, chrom, start, end, region_type), reads of the last that is not for normalising; without reads the default.
    """
    some = reads
    if regions is not None:
        last = regions.where("region_type <> 'norm'").orderBy(F.desc("ord")).limit(1).select(F.col("chrom").alias("__c"), F.col("start").alias("__s"), F.col("end").alias("__e"))
        some = reads.join(F.broadcast(last), (F.col("chrom") == F.col("__c")) & (F.col("pos") < F.col("__e")) & (F.col("end_pos") > F.col("__s")), "left_semi")  # one row
    first = some.withColumn("k", F.row_number().over(Window.partitionBy("sample_id").orderBy("chrom", "pos", "qname"))).where(F.col("k") <= READS_FOR_LENGTH)
    found = first.groupBy("sample_id").agg(F.median(F.length("seq")).alias("read_length"))
    samples = reads.select("sample_id").distinct() if samples is None else samples.select("sample_id")
    return samples.join(found, "sample_id", "left").withColumn("read_length", F.coalesce("read_length", F.lit(DEFAULT_READ_LENGTH)))


def uses_chr(contigs: DataFrame) -> DataFrame:
    """(uses_chr): whether one of the first five contig names (ord, name) has `chr`."""
    return contigs.where("ord < 5").agg(F.coalesce(F.max(F.contains("name", F.lit("chr"))), F.lit(False)).alias("uses_chr"))


def variant_bases(target: DataFrame) -> DataFrame:
    """(name, pos, alt, ref) for phasing: the first alternative of each side, 0-based."""
    return target.select(F.col("label").alias("name"), F.col("pos1").alias("pos"), F.col("alleles1")[0].alias("alt"), F.col("alleles2")[0].alias("ref"))


@dataclass
class Resources:
    """The definition tables of a run; those that a release lacks stay None."""

    regions: DataFrame
    parameters: DataFrame
    sites: DataFrame
    targets: DataFrame
    homology: DataFrame
    stars: DataFrame
    chrom: str = "22"
    function: DataFrame | None = None
    haplotype_frequency: DataFrame | None = None
    diplotype_frequency: DataFrame | None = None
    panel: DataFrame | None = None
    #: Sites along which reads are followed: 938, 526_556, 803 and ins_a.
    haplotypes: dict[str, DataFrame] | None = None


def all_samples(samples: DataFrame, calls: DataFrame, sample: str = "sample_id") -> DataFrame:
    """A row for every sample, of nulls where there is no call."""
    return samples.select(sample).distinct().join(calls, sample, "left")


def resources(spark: SparkSession, folder: str, names: dict[str, str], genome: str = "38") -> Resources:
    """The tables of a folder by their file names: regions, parameters, sites, targets, homology, stars and, where there are any, function, haplotype_frequency, diplotype_frequency, panel.

    haplotypes names a table of sites by group, and haplotype_groups the group of each of 938, 526_556, 803 and ins_a.
    """
    path = lambda k: f"{folder}/{names[k]}"
    labels = names.get("haplotype_groups", {})
    haplotypes = {k: sites(spark, path("haplotypes"), genome, label) for k, label in labels.items()} if "haplotypes" in names else None
    own = {k: sites(spark, path(k), genome) for k in ("sites", "targets", "homology")}
    more = {"function": haplotype_function, "haplotype_frequency": wide_frequencies, "diplotype_frequency": wide_frequencies, "panel": diagnostic_panel}
    return Resources(regions(spark, path("regions"), genome), model_parameters(spark, path("parameters")), **own, stars=star_items(spark, path("stars")), haplotypes=haplotypes, **{k: f(spark, path(k)) for k, f in more.items() if k in names})
