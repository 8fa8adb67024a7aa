"""Copy-number models, filters and tests as expressions: no Python on the executors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import DoubleType

from paraloom.functions.scalar import TAIL_Z, round3

GMM_STATES, GMM_POSTERIOR, ZERO_SD = 11, 0.95, 0.032
#: Depth of the allele that should be absent: a third of a tenth of the reads.
ABSENT_SHARE, ALL_SHARE, CALL = 0.1 / 3, 0.9, 0.9


def gmm_states(shift: float, means: dict[int, float], priors: dict[int, float], sd2: float) -> list[tuple[int, float, float, float]]:
    """(copies, mean, sd, prior) of each state, from a region's parameters."""
    step = means[3] - means[2]
    rest = (1 - sum(priors.values())) / (GMM_STATES - len(priors))
    mean = lambda k: [0.0, 0.5, means[2], means[3]][k] if k < 4 else 1 + step * (k - 2)
    return [(k, mean(k), ZERO_SD if k == 0 else sd2 * math.sqrt(k / 2), priors.get(k, rest)) for k in range(GMM_STATES)]


def gmm_call(df: DataFrame, value: str, states: list[tuple[int, float, float, float]], shift: float) -> DataFrame:
    """df with cn (null without a confident state), depth and posterior, by the Gaussian mixture over the states."""
    x = F.col(value) / 2 / shift
    logs = [math.log(p) - math.log(sd) - (x - m) * (x - m) / (2 * sd * sd) for _, m, sd, p in states]
    scored = df.withColumn("__l", F.array(*logs)).withColumn("__x", x)
    top = F.array_max("__l")
    best = F.array_position("__l", top).cast("int") - 1
    total = F.aggregate("__l", F.lit(0.0), lambda a, v: a + F.exp(v - top))
    z = F.element_at(F.array(*[(F.col("__x") - m) / sd for _, m, sd, _ in states]), best + 1)
    call = F.when((1 / total >= GMM_POSTERIOR) & (F.abs(z) <= TAIL_Z), best)
    return scored.withColumn("cn", call).withColumn("posterior", 1 / total).withColumn("depth", round3(F.col(value) / shift)).drop("__l", "__x")


def poisson_posterior(cn: Column, n1: Column, n2: Column) -> Column:
    """Posterior of 0..cn copies of allele 1 from its reads and the other's; the factorial cancels in the softmax.

    The smaller count is scored and the result turned round if that is the second's.
    """
    n, k = n1 + n2, F.least(n1, n2)
    rate = lambda i: F.when(i == 0, n * ABSENT_SHARE).when(i == cn, n * ALL_SHARE).otherwise(n * i / F.greatest(cn, F.lit(1)))
    logs = F.transform(F.sequence(F.lit(0), cn.cast("int")), lambda i: k * F.ln(rate(i)) - rate(i))
    weights = F.transform(logs, lambda v: F.exp(v - F.array_max(logs)))
    posterior = F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, v: a + v))
    return F.when(n2 < n1, F.reverse(posterior)).otherwise(posterior)


def poisson_call(df: DataFrame, cn: str, n1: str, n2: str, min_reads: int = 0) -> DataFrame:
    """df with struct cn_call (cn1, p1, cn2, p2); one confident state leaves cn2 null."""
    c, a, b = F.col(cn), F.col(n1), F.col(n2)
    fits = c.isNotNull() & (c > 0) & (a + b > 0) & ~((c == 1) & (a > min_reads))
    post = df.withColumn("__p", F.when(fits, poisson_posterior(c, a, b)))
    ranked = F.array_sort(F.transform("__p", lambda p, i: F.struct((-p).alias("m"), i.alias("i"))))
    one = lambda v: F.struct(v.cast("int").alias("cn1"), F.lit(1.0).alias("p1"), F.lit(None).cast("int").alias("cn2"), F.lit(None).cast("double").alias("p2"))
    post = post.withColumn("__r", ranked)
    first, second = F.element_at("__r", 1), F.try_element_at("__r", F.lit(2))
    two = F.struct(first["i"].cast("int").alias("cn1"), round3(-first["m"]).alias("p1"), second["i"].cast("int").alias("cn2"), round3(-second["m"]).alias("p2"))
    sure = F.struct(first["i"].cast("int").alias("cn1"), F.lit(1.0).alias("p1"), F.lit(None).cast("int").alias("cn2"), F.lit(None).cast("double").alias("p2"))
    call = (
        F.when(c.isNull(), None).when(c == 0, one(F.lit(0))).when((c == 1) & (a > min_reads), one(F.lit(1))).when(a + b == 0, None)
        .when((first["i"] != 0) & (a <= min_reads) & (b >= min_reads), one(F.lit(0))).when(-first["m"] >= CALL, sure).otherwise(two)
    )
    return post.withColumn("cn_call", call).drop("__p", "__r")


def conversion_filter(call: Column, cutoff: float) -> Column:
    """A call kept if it is single or its first option is above the cutoff."""
    return F.when(call["cn2"].isNull() | (call["p1"] > cutoff), call["cn1"])


def denovo_filter(call: Column, keep: float, choose: float, site_total: Column | None = None) -> Column:
    """A call whose first option is above `keep`; else, between two possible options, the first above `choose` or the lower."""
    both = (call["cn1"] > 0) & (call["cn2"] > 0)
    if site_total is not None:
        both = both | (call["cn1"] == site_total) | (call["cn2"] == site_total)
    return F.when(call["cn2"].isNull() | (call["p1"] > keep), call["cn1"]).when(both, F.when(call["p1"] > choose, call["cn1"]).otherwise(F.least(call["cn1"], call["cn2"])))


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """ln n! by Stirling's series with its correction, exact to 1e-12 from 16 on, and from a table below."""
    table = np.array([math.lgamma(k + 1) for k in range(16)])
    x = np.maximum(n, 16).astype(np.float64) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return np.where(n < 16, table[np.clip(n, 0, 15)], series)


def two_sided(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Fisher's two-sided p of 2 x 2 tables: what all tables of the same margins that are no likelier have together.

    Likelihoods rise to a mode and fall behind it, so those tables are two tails. Each tail's beginning is found by bisection and its sum by the ratio of
    neighbours, outwards until nothing is added; all rows go side by side, and a row's work and memory do not grow with its margins beyond the width of its tails.
    """
    a, b, c, d = (np.maximum(x, 0).astype(np.int64) for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    low, high = np.maximum(0, row + col - n), np.minimum(row, col)
    fixed = _log_factorials(row) + _log_factorials(n - row) + _log_factorials(col) + _log_factorials(n - col) - _log_factorials(n)

    def likely(k: np.ndarray) -> np.ndarray:
        return np.exp(fixed - _log_factorials(k) - _log_factorials(row - k) - _log_factorials(col - k) - _log_factorials(n - row - col + k))

    most = likely(a) + 1e-12
    mode = np.clip(((row + 1).astype(np.float64) * (col + 1) / (n + 2)).astype(np.int64), low, high)

    def tail(end: np.ndarray, step: int) -> np.ndarray:
        """The sum from the first table on that is no likelier than the observed, from the mode towards an end."""
        inside, beyond = mode.copy(), end + step  # likelier (or the mode), and not
        while (open_ := np.abs(beyond - inside) > 1).any():
            middle = np.where(open_, (inside + beyond) // 2, inside)
            less = likely(middle) <= most
            beyond, inside = np.where(open_ & less, middle, beyond), np.where(open_ & ~less, middle, inside)
        total, at = np.zeros(len(a)), beyond.copy()
        live = np.flatnonzero((at - end) * step <= 0)
        term = np.zeros(len(a))
        term[live] = likely(at)[live]
        while len(live):
            total[live] += term[live]
            k, r, q = at[live].astype(np.float64), row[live].astype(np.float64), col[live].astype(np.float64)
            rest = n[live] - r - q
            ratio = (r - k) * (q - k) / ((k + 1) * (rest + k + 1)) if step > 0 else k * (rest + k) / ((r - k + 1) * (q - k + 1))
            term[live] *= ratio
            at[live] += step
            live = live[(at[live] != end[live] + step) & (term[live] > 1e-18 * total[live])]
        return total

    out = tail(low, -1) + tail(high, 1)
    # a mode that is no likelier than the observed table leaves nothing out
    return np.where((n == 0) | (likely(mode) <= most), 1.0, np.minimum(1.0, out))


@F.pandas_udf(DoubleType())
def _fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    whole = a.notna() & b.notna() & c.notna() & d.notna()
    out = pd.Series(np.nan, index=a.index)
    if whole.any():
        out[whole] = two_sided(*(x[whole].to_numpy(np.int64) for x in (a, b, c, d)))
    return out.where(whole, None)


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """df with odds_ratio and p_value (two-sided) of the 2 x 2 table in four columns; a table of zeros has p 1, one with a null cell none."""
    A, B, C, D = (F.col(x).cast("long") for x in (a, b, c, d))
    return df.withColumns({"p_value": _fisher_p(A, B, C, D), "odds_ratio": F.try_divide((A.cast("double") * D), (B.cast("double") * C))})


def strand_noise(df: DataFrame, fwd: str, rev: str, total: str) -> DataFrame:
    """df with `noisy`: forward and reverse counts against two halves of the total, p < 0.05, or one strand with a read or none."""
    half = df.withColumn("__h", F.floor(F.col(total) / 2))
    tested = fisher_exact(half, fwd, rev, "__h", "__h")
    return tested.withColumn("noisy", (F.col("p_value") < 0.05) | (F.col(fwd) <= 1) | (F.col(rev) <= 1)).drop("__h", "p_value", "odds_ratio")


def strand_bias(df: DataFrame, alt_fwd: str, alt_rev: str, ref_fwd: str, ref_rev: str, clean: Column) -> DataFrame:
    """df with `biased`: three or more reads, one strand (nearly) empty and a small p; clean sites need a smaller one."""
    tested = fisher_exact(df, alt_fwd, alt_rev, ref_fwd, ref_rev)
    low = F.least(alt_fwd, alt_rev)
    rule = F.when(clean, (F.col("p_value") < 0.01) & (low == 0)).otherwise((F.col("p_value") < 0.02) & (low <= 1))
    return tested.withColumn("biased", (F.col(alt_fwd) + F.col(alt_rev) >= 3) & rule)


def quality_aware_posterior(reads: DataFrame, keys: list[str], is_one: str, quality: str, cn: str) -> DataFrame:
    """(keys, copies, posterior): copies 0..cn of allele 1 from each read's error, by a mixture likelihood."""
    e = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.pow(F.lit(10.0), -F.col(quality) / 10)))
    states = reads.withColumn("copies", F.explode(F.sequence(F.lit(0), F.col(cn).cast("int"))))
    share = F.col("copies") / F.greatest(F.col(cn), F.lit(1))
    likely = F.when(F.col(is_one), share * (1 - e) + (1 - share) * e).otherwise(share * e + (1 - share) * (1 - e))
    summed = states.groupBy(*keys, "copies").agg(F.sum(F.ln(likely)).alias("__l"))
    w = Window.partitionBy(*keys)
    scaled = summed.withColumn("__w", F.exp(F.col("__l") - F.max("__l").over(w)))
    return scaled.select(*keys, "copies", (F.col("__w") / F.sum("__w").over(w)).alias("posterior"))


def welch_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Welch's t of two samples; 0 for fewer than two values or no spread."""
    se = F.sqrt(v1 / F.greatest(n1, F.lit(1)) + v2 / F.greatest(n2, F.lit(1)))
    return F.when((n1 < 2) | (n2 < 2) | (se < 1e-10) | se.isNull(), 0.0).otherwise((m1 - m2) / se)
