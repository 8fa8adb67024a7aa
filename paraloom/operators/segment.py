"""Ordered profiles: windows, islands, changepoints, hidden states, local regression.

Sequential algorithms run in one pandas group per profile; a profile is a site axis of a sample, bounded by the panel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paraloom.operators.models import welch_t


def sliding_mean(df: DataFrame, keys: list[str], order: str, value: str, size: int = 5, least: int = 3) -> DataFrame:
    """df with `window_mean` over a row and the next size - 1 of its key; null unless the frame is full and has `least` values."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, size - 1)
    full = (F.count("*").over(w) == size) & (F.count(value).over(w) >= least)
    return df.withColumn("window_mean", F.when(full, F.avg(value).over(w)))


def islands(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, island, value, first, last, n): runs of equal values along the order."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__c", changed).withColumn("island", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def best_split(df: DataFrame, keys: list[str], order: str, value: str, min_bins: int) -> DataFrame:
    """(keys, split, t): the cut with the largest |t| between what is before it and the rest; both sides have min_bins."""
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    v = F.col(value)
    left = F.count(v).over(up), F.avg(v).over(up), F.var_samp(v).over(up)
    right = F.count(v).over(down), F.avg(v).over(down), F.var_samp(v).over(down)
    scored = df.select(*keys, order, left[0].alias("n1"), right[0].alias("n2"), F.round(F.abs(welch_t(left[0], left[1], left[2], right[0], right[1], right[2])), 6).alias("t"))
    ok = scored.where((F.col("n1") >= min_bins) & (F.col("n2") >= min_bins))
    return ok.groupBy(*keys).agg(F.max_by(order, F.struct("t", F.lit(0) - F.col("n1"))).alias("split"), F.max("t").alias("t"))


def segments_of(values: np.ndarray, valid: np.ndarray, threshold: float, min_bins: int) -> list[tuple[int, int]]:
    """Recursive binary segmentation: [start, end) of segments in order; the statistics of all cuts come from running sums."""
    middle = values[valid].mean() if valid.any() else 0.0
    held = np.where(valid, values - middle, 0.0)
    count, total, square = (np.concatenate([[0.0], np.cumsum(x)]) for x in (valid.astype(float), held, held * held))
    found, open_ = [], [(0, len(values))]
    while open_:
        a, b = open_.pop()
        k = np.arange(a + 1, b)
        n1, n2 = count[k] - count[a], count[b] - count[k]
        s1, s2 = total[k] - total[a], total[b] - total[k]
        ok = np.flatnonzero((n1 >= max(2, min_bins)) & (n2 >= max(2, min_bins)))
        k, n1, n2, s1, s2 = k[ok], n1[ok], n2[ok], s1[ok], s2[ok]
        v1 = np.maximum(square[k] - square[a] - s1 * s1 / n1, 0) / (n1 - 1)
        v2 = np.maximum(square[b] - square[k] - s2 * s2 / n2, 0) / (n2 - 1)
        se = np.sqrt(v1 / n1 + v2 / n2)
        t = np.where(se >= 1e-10, np.abs(s1 / n1 - s2 / n2) / np.maximum(se, 1e-10), 0.0)
        if len(t) and t.max() > 0 and t.max() >= threshold:
            at = int(k[np.argmax(t)])
            open_ += [(at, b), (a, at)]
        else:
            found.append((a, b))
    return found


def changepoints(df: DataFrame, keys: list[str], order: str, value: str, threshold: float = 4.0, min_bins: int = 5) -> DataFrame:
    """(keys, segment, first, last, n_valid, mean). A profile in one piece whose mean is off 0.5 is cut again, one lower in t."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order, kind="stable")
        v = x[value].to_numpy(float)
        valid = np.isfinite(v)
        found = segments_of(v, valid, threshold, min_bins)
        if len(found) == 1 and valid.any() and not 0.40 <= v[valid].mean() <= 0.60:
            found = segments_of(v, valid, max(2.0, threshold - 1), min_bins)
        rows = [(*key, k, x[order].iloc[a], x[order].iloc[b - 1], int(valid[a:b].sum()), float(v[a:b][valid[a:b]].mean()) if valid[a:b].any() else None) for k, (a, b) in enumerate(found)]
        return pd.DataFrame(rows, columns=[*keys, "segment", "first", "last", "n_valid", "mean"])

    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", segment int, first {types[order]}, last {types[order]}, n_valid int, mean double"
    return df.groupBy(*keys).applyInPandas(run, schema)


def stepped(cuts: DataFrame, keys: list[str], least_step: float = 0.15, least_valid: int = 5) -> DataFrame:
    """(keys, stepped, n_segments, first_mean, last_mean, first_valid, last_valid) of segments: whether two neighbours differ enough for a hybrid."""
    w, mean = Window.partitionBy(*keys).orderBy("segment"), F.coalesce("mean", F.lit(0.0))
    step = (F.abs(mean - F.lag(mean).over(w)) >= least_step) & (F.least("n_valid", F.lag("n_valid").over(w)) >= least_valid) & (F.lag("n_valid").over(w).isNotNull())
    ends = [F.min_by(mean, "segment").alias("first_mean"), F.max_by(mean, "segment").alias("last_mean"), F.min_by("n_valid", "segment").alias("first_valid"), F.max_by("n_valid", "segment").alias("last_valid")]
    return cuts.withColumn("__s", F.coalesce(step, F.lit(False))).groupBy(*keys).agg(F.max("__s").alias("stepped"), F.count("*").alias("n_segments"), *ends)


def best_path(obs: np.ndarray, valid: np.ndarray, states: int, sd: float, stay: float = 0.995, zero_sd: float = 0.15) -> np.ndarray:
    """Viterbi over copy numbers 0..states - 1 with Gaussian emissions; ties go to the lower earlier state."""
    if not len(obs):
        return np.zeros(0, int)
    cn = np.arange(states)
    spread = np.where(cn == 0, zero_sd, sd * np.sqrt(np.maximum(cn, 1)))
    emit = np.where(valid[:, None], -0.5 * np.log(2 * np.pi * spread**2) - (np.where(valid, obs, 0)[:, None] - cn) ** 2 / (2 * spread**2), 0.0)
    move = np.full((states, states), np.log((1 - stay) / max(states - 1, 1)))
    np.fill_diagonal(move, np.log(stay))
    score, back = emit[0] - np.log(states), np.zeros((len(obs), states), int)
    for t in range(1, len(obs)):
        reach = score[:, None] + move
        back[t] = reach.argmax(axis=0)
        score = reach.max(axis=0) + emit[t]
    path = np.empty(len(obs), int)
    path[-1] = score.argmax()
    for t in range(len(obs) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def viterbi(df: DataFrame, keys: list[str], order: str, obs: str, valid: str, states: str, sd: float = 0.3) -> DataFrame:
    """(keys, order, state): the most likely copy number at each site."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(order, kind="stable")
        path = best_path(x[obs].to_numpy(float), x[valid].to_numpy(bool) & np.isfinite(x[obs].to_numpy(float)), int(x[states].iloc[0]), sd)
        return x[[*keys, order]].assign(state=path.astype("int32"))

    types = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in [*keys, order]) + ", state int")


def smooth(x: np.ndarray, y: np.ndarray, share: float = 2 / 3, rounds: int = 3, cells: int = 4_000_000) -> np.ndarray:
    """LOWESS: local lines over the nearest share of points, tricube weights, bisquare rounds against outliers.

    The points are fitted in blocks of rows of their neighbours, as many as `cells` allow at once.
    """
    n = len(x)
    if n < 3:
        return y.astype(float)
    k, robust, fit = max(2, int(share * n + 1e-10)), np.ones(n), np.empty(n)
    order = np.argsort(x, kind="stable")
    xs, ys = x[order].astype(float), y[order].astype(float)
    # the window of a point moves on while the next point on the right is nearer than the first on the left
    left = np.zeros(n, dtype=np.int64)
    at = 0
    for i in range(n):
        while at + k < n and xs[at + k] - xs[i] < xs[i] - xs[at]:
            at += 1
        left[i] = at
    wide = max(1.0, (xs[-1] - xs[0]) ** 2)
    for turn in range(rounds + 1):
        for first in range(0, n, max(1, cells // k)):
            i = np.arange(first, min(n, first + max(1, cells // k)))
            near = left[i][:, None] + np.arange(k)[None, :]
            d = np.abs(xs[near] - xs[i][:, None])
            reach = np.maximum(xs[i] - xs[left[i]], xs[left[i] + k - 1] - xs[i])[:, None]
            ratio = np.divide(d, reach, out=np.zeros_like(d), where=reach > 0)
            weight = np.where(d <= 0.001 * reach, 1.0, np.where(d < 0.999 * reach, (1 - ratio**3) ** 3, 0.0))
            weight = np.where(reach > 0, weight, 1.0) * robust[near]
            total = weight.sum(axis=1)
            safe = np.where(total > 0, total, 1.0)
            mean = (weight * xs[near]).sum(axis=1) / safe
            off = xs[near] - mean[:, None]
            var = (weight * off * off).sum(axis=1) / safe
            slope = np.divide(xs[i] - mean, var, out=np.zeros(len(i)), where=var > 1e-12 * wide)
            line = (weight / safe[:, None] * (1 + slope[:, None] * off) * ys[near]).sum(axis=1)
            fit[i] = np.where(total > 0, line, ys[i])
        if turn == rounds:
            break
        rest = np.abs(ys - fit)
        scale = 6 * np.median(rest)
        if scale < 1e-12:
            break
        robust = np.where(rest < scale, (1 - (rest / scale) ** 2) ** 2, 0.0)
    out = np.empty(n)
    out[order] = fit
    return out


def gc_corrected(df: DataFrame, keys: list[str], gc: str, value: str, order: str, scale: float = 0.9) -> DataFrame:
    """df's key and order with `corrected`: value over the median, moved against its trend along gc; a zero median changes nothing."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values([gc, order], kind="stable")
        v = x[value].to_numpy(float)
        middle = np.median(v) if len(v) else 0.0
        if middle == 0:
            out = v
        else:
            y = v / middle
            out = y + scale * np.minimum(y, 2) * (np.median(y) - smooth(x[gc].to_numpy(float), y))
        return x[[*keys, order]].assign(corrected=out)

    types = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in [*keys, order]) + ", corrected double")
