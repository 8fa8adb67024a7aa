"""Aggregations with explicit tie rules; all are two-phase hash aggregations over their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def center(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, mean, median): 0 for groups without values."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.coalesce(F.median(value), F.lit(0.0)).alias("median"))


def mad(df: DataFrame, keys: list[str], value: str, scale: float = MAD_SCALE) -> DataFrame:
    """(keys, median, mad): the scaled median of distances from the median."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(middle, keys).groupBy(*keys).agg(F.first("median").alias("median"), (F.median(F.abs(F.col(value) - F.col("median"))) * scale).alias("mad"))


def modal(df: DataFrame, keys: list[str], value: str, min_support: int = 1, weight: str | None = None) -> DataFrame:
    """(keys, value, support): the most frequent (or heaviest) non-null value, the lowest of equals; null below min_support."""
    amount = F.sum(weight) if weight else F.count("*")
    counted = df.groupBy(*keys, value).agg(F.when(F.col(value).isNotNull(), amount).alias("__n"))
    best = counted.groupBy(*keys).agg(F.max(F.col("__n")).alias("support"), F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(-F.col("__n"), F.col(value)))).alias("__v"))
    return best.select(*keys, F.when(F.col("support") >= min_support, F.col("__v")).alias(value), F.coalesce("support", F.lit(0)).alias("support"))


def region_depth(counts: DataFrame, keys: list[str], kind: str, name: str, length: str, count: str, suffix: str = "_hapcn") -> DataFrame:
    """(keys, kind, reads, depth): all regions of a kind give reads, the one whose name tells its haploid copies gives the length."""
    copies = F.regexp_extract(name, suffix + r"(\d+)", 1)
    span = F.max(F.when(copies != "", F.col(length) * copies.cast("int")))
    grouped = counts.groupBy(*keys, kind).agg(F.sum(count).alias("reads"), span.alias("span"))
    return grouped.select(*keys, kind, "reads", F.try_divide(F.col("reads"), F.col("span")).alias("depth"))


def two_sided_histogram(df: DataFrame, keys: list[str], pos: str, side: str, width: int, least: int) -> DataFrame:
    """(keys, bin, n_left, n_right) of bins where either side has `least` or more."""
    bins = df.groupBy(*keys, (F.floor(F.col(pos) / width) * width).cast("long").alias("bin")).agg(
        F.count_if(F.col(side) == "L").alias("n_left"), F.count_if(F.col(side) == "R").alias("n_right")
    )
    return bins.where((F.col("n_left") >= least) | (F.col("n_right") >= least))


def spread_from_integers(df: DataFrame, keys: list[str], value: str, least: int = 10, default: float = 0.5) -> DataFrame:
    """(keys, spread): mean distance of values from the nearest integer, or the default for few values."""
    return df.groupBy(*keys).agg(F.when(F.count(value) >= least, F.avg(F.abs(F.col(value) - F.round(value)))).otherwise(default).alias("spread"))


def repeated(df: DataFrame, keys: list[str], name: str, copies: str) -> DataFrame:
    """(keys, names): each name as often as its copies, sorted."""
    return df.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(F.array_repeat(F.col(name), F.coalesce(F.col(copies), F.lit(0)).cast("int"))))).alias("names"))


def normalized_depth(regions: DataFrame, keys: list[str], depth: str) -> DataFrame:
    """regions with `relative`: depth over the median of its key, null where that is zero."""
    middle = regions.groupBy(*keys).agg(F.median(depth).alias("__m"))
    return regions.join(middle, keys).withColumn("relative", F.try_divide(F.col(depth), F.col("__m"))).drop("__m")


def first_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def top_k(df: DataFrame, keys: list[str], k: int, *order) -> DataFrame:
    """The k best rows of each key with their rank; Spark limits each group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
