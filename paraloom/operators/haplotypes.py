"""Variants that counts alone do not tell: motif counts, patterns along reads, and pairs that span both sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.operators.calls import TAG_COPIES
from paraloom.operators.intervals import primary
from paraloom.operators.models import conversion_filter, poisson_call

# The window of the insertion's reads and the motifs of its long, short and absent form.
INSERTION_WINDOW = (42128848, 42128978)
INSERTION_MOTIFS = {"long": "TGGGGCGAAAGGGGCGAAAGGGGCGAAAGGGGCGT", "short": "TTGGGGCGAAAGGGGCGAAAGGGGCGTC", "none": "TTGGGGCGAAAGGGGCGTC"}
INSERTION_NAMES = {"long": "g.42128936-42128937insGGGGCGAAAGGGGCGAAA", "short": "g.42128936-42128937insGGGGCGAAA"}
# Fixed value: pairs that are apart as far as this have an end in each source.
BETWEEN_SOURCES = 13_000


def motif_counts(reads: DataFrame, chrom: str, window: tuple[int, int] = INSERTION_WINDOW, motifs: dict[str, str] = INSERTION_MOTIFS) -> DataFrame:
    """(sample_id, one column per motif): reads of a window by the first motif that they hold."""
    some = primary(reads).where((F.col("chrom") == chrom) & (F.col("pos") < window[1]) & (F.col("end_pos") > window[0]))
    first = None
    for name, motif in motifs.items():
        hit = F.contains("seq", F.lit(motif))
        first = F.when(hit, name) if first is None else first.when(hit, name)
    return some.withColumn("__m", first).groupBy("sample_id").agg(*[F.count_if(F.col("__m") == n).alias(n) for n in motifs])


def insertion_counts(counts: DataFrame, motifs: DataFrame) -> DataFrame:
    """counts (sample_id, name, n1, n2, ...) with those of the insertion's two forms taken from its motifs."""
    met = counts.join(motifs, "sample_id", "left")
    own = {"n1": {INSERTION_NAMES[k]: F.col(k) for k in ("long", "short")}, "n2": {INSERTION_NAMES["long"]: F.col("short") + F.col("none"), INSERTION_NAMES["short"]: F.col("long") + F.col("none")}}
    for column, by_name in own.items():
        new = F.col(column)
        for name, value in by_name.items():
            new = F.when(F.col("name") == name, F.coalesce(value, F.lit(0))).otherwise(new)
        met = met.withColumn(f"__{column}", new)
    return met.select(*[F.col(f"__{c}").alias(c) if c in own else F.col(c) for c in counts.columns])


def pattern_counts(patterns: DataFrame, positions: list[int], pattern: str = "pattern") -> DataFrame:
    """(sample_id, part, n): reads by their characters at the positions; reads that miss one (x) do not count."""
    part = F.concat(*[F.substring(pattern, p + 1, 1) for p in positions])
    whole = patterns.select("sample_id", part.alias("part")).where(~F.contains("part", F.lit("x")))
    return whole.groupBy("sample_id", "part").agg(F.count("*").alias("n"))


def _seen(counts: DataFrame, part: str, name: str, least: int = 2) -> DataFrame:
    return counts.groupBy("sample_id").agg((F.coalesce(F.max(F.when(F.col("part") == part, F.col("n"))), F.lit(0)) >= least).alias(name))


def _copies(rows: DataFrame, total: Column, n1: str, n2: str, cutoff: float, name: str) -> DataFrame:
    called = poisson_call(rows.withColumn("__t", total), "__t", n1, n2)
    return called.withColumn(name, conversion_filter(F.col("cn_call"), cutoff)).drop("__t", "cn_call")


def call_938(last_site: DataFrame, totals: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sample_id, copies, cis_938): copies of g.42126938C>T where the last site has fewer than the total implies and reads show the switch.

    last_site (sample_id, n1, n2); totals (sample_id, total_cn); patterns (sample_id, pattern) over three sites.
    """
    rows = _copies(last_site.join(totals.select("sample_id", "total_cn"), "sample_id"), F.col("total_cn"), "n1", "n2", 0.8, "__cn")
    rows = rows.join(_seen(pattern_counts(patterns, [0, 2]), "12", "__s"), "sample_id", "left").join(_seen(pattern_counts(patterns, [1, 2]), "12", "__g"), "sample_id", "left")
    ok = (F.col("total_cn") >= 2) & (F.col("__cn") < F.col("total_cn") - 2) & F.coalesce("__s", F.lit(False))
    return rows.select("sample_id", F.when(ok, F.col("total_cn") - 2 - F.col("__cn")).otherwise(0).alias("copies"), F.coalesce(ok & F.coalesce("__g", F.lit(False)), F.lit(False)).alias("cis_938"))


def call_526_556(counts: DataFrame, tags: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sample_id, n526, n556): counts (sample_id, a1, r1, a2, r2) of both variants, split by what reads show together."""
    table = tags.sparkSession.createDataFrame([(t[0], t[3]) for t in TAG_COPIES], "tag string, __d int")
    rows = counts.join(tags.select("sample_id", "tag"), "sample_id").join(F.broadcast(table), "tag")  # 28 rows
    rows = _copies(_copies(rows, F.col("__d"), "a1", "r1", 0.6, "__c1"), F.col("__d"), "a2", "r2", 0.6, "__c2")
    parts = pattern_counts(patterns, [0, 1, 2])
    rows = rows.join(_seen(parts, "211", "__first"), "sample_id", "left").join(_seen(parts, "221", "__both"), "sample_id", "left")
    one, two = F.coalesce("__c1", F.lit(0)), F.coalesce("__c2", F.lit(0))
    first, both = F.coalesce("__first", F.lit(False)), F.coalesce("__both", F.lit(False))
    pair = F.when(~first & both, F.least(one, two)).otherwise(0)
    return rows.select("sample_id", F.when(first, one).otherwise(pair).alias("n526"), pair.alias("n556"))


def trans_803(tags: DataFrame, patterns: DataFrame) -> DataFrame:
    """(sample_id, trans_803): reads show each of two variants without the other, in a sample of two copies."""
    parts = pattern_counts(patterns, [0, 1])
    rows = tags.join(_seen(parts, "12", "__a"), "sample_id", "left").join(_seen(parts, "21", "__b"), "sample_id", "left")
    return rows.select("sample_id", ((F.col("tag") == "cn2") & F.coalesce("__a", F.lit(False)) & F.coalesce("__b", F.lit(False))).alias("trans_803"))


def call_inserted_a(far: DataFrame, near: DataFrame) -> DataFrame:
    """(sample_id, copies): copies of the inserted A from pairs that span both sources.

    far (sample_id, first, second): reads of such pairs with each allele on the second source. near (sample_id, aa, a): all reads
    there with two A, and reads of the first source with one.
    """
    rows = far.join(near, "sample_id", "left")
    spanned = (F.col("second") >= 5) & (F.col("first") <= 2)
    enough = F.coalesce("a", F.lit(0)) >= F.col("second") + F.coalesce("aa", F.lit(0))
    return rows.select("sample_id", F.when(spanned, F.when(enough, 1).otherwise(2)).otherwise(0).alias("copies"))
