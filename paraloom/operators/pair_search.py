"""The best pairs of items for a set of fragments, each of which comes from one of the pair (or from a third source).

A fragment is its log likelihood under every item; fragments with equal ones are one profile with a weight, counted by Spark before they meet, so a task holds the
profiles of one key as a matrix. Pairs are searched with a running cutoff: the pairs of the best single items are scored first, and their `most`-th best total
is what every other pair must reach. A pair is left without a logarithm taken if each profile's better item with the whole share does not reach it, and while its
splits are summed, profiles in order of what they can tell apart, as soon as the sum so far and the best that the remaining ones can give stay below. That never leaves a pair that belongs to the best `most`; without `most` every pair is scored.

Defined cases: profiles that lack one of two items say nothing about that pair, and a pair that no profile has both of is not given; equal totals go by the items' order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items whose pairs set the first cutoff, and blocks of profiles after which pairs are left.
SEEDS, BLOCKS = 8, 8
#: Pairs whose totals may differ by rounding only.
SLACK = 1e-7
#: Log likelihoods further apart than this in one profile are added as logarithms.
WIDE = 600.0


def _mixed(low: np.ndarray, high: np.ndarray, other: np.ndarray | None, wa: float, wb: float, wo: float) -> np.ndarray:
    """ln of the weighted sum of likelihoods, by logarithms."""
    with np.errstate(divide="ignore"):
        out = np.logaddexp(low + np.log(wa), high + np.log(wb))
        return out if other is None else np.logaddexp(out, other + np.log(wo))


class Profiles:
    """Profiles by items: values[p, i] is ln likelihood (NaN: none), weight[p] how often it stands, other[p] that of the third source."""

    def __init__(self, values: np.ndarray, weight: np.ndarray, other: np.ndarray | None, copies: int):
        # what tells most apart comes first
        spread = np.nan_to_num(np.nanmax(values, axis=1) - np.nanmin(values, axis=1)) * weight
        order = np.argsort(-spread, kind="stable")
        self.values, self.weight = values[order], weight[order].astype(np.float64)
        self.other = None if other is None else other[order]
        self.copies = copies
        self.known = ~np.isnan(self.values)
        top = np.nanmax(self.values, axis=1)
        top = top if self.other is None else np.maximum(top, self.other)
        low = np.nanmin(self.values, axis=1)
        self.wide = top - (low if self.other is None else np.minimum(low, self.other)) > WIDE
        self.top = top
        self.linear = np.exp(np.where(self.known, self.values, -np.inf) - top[:, None])
        self.other_linear = None if self.other is None else np.exp(self.other - top)
        # what an item can give at most, with all of the pair's share
        if self.other is None:
            self.alone = np.nan_to_num(self.values)
        else:
            whole = np.logaddexp(np.where(self.known, self.values, -np.inf) + np.log(max(copies, 1e-300)), self.other[:, None]) - np.log(copies + 1)
            self.alone = np.where(self.known, whole, 0.0)
        # the most that a profile can give any pair
        scale = 1.0 if self.other is None else 1 / (copies + 1)
        most = np.where(np.isnan(top), 0, np.nanmax(self.values, axis=1))
        if self.other is None:
            best = most
        else:
            best = np.logaddexp(most + np.log(max(copies, 1e-300)), self.other) + np.log(scale)
        # a profile that says nothing about a pair gives it 0
        gap = ~self.known.all(axis=1)
        self.best = self.weight * np.where(gap, np.maximum(best, 0), best)
        self.remaining = np.concatenate([np.cumsum(self.best[::-1])[::-1], [0.0]])
        ends = np.unique(np.linspace(0, len(self.values) ** 0.5, BLOCKS + 1) ** 2 // 1).astype(int)
        self.bounds = sorted({*ends.tolist(), len(self.values)} - {0})

    def splits(self, same: bool) -> list[tuple[float, float, float]]:
        """Weights of the first item, the second and the third source."""
        if self.other is None:
            return [(1.0, 0.0, 0.0)] if same else [(0.5, 0.5, 0.0)]
        n, each = self.copies, 1.0 / (self.copies + 1)
        return [(n * each, 0.0, each)] if same else [(k * each, (n - k) * each, each) for k in range(1, max(n - 1, 1) + 1)]

    def sums(self, a: int, b: np.ndarray, start: int, stop: int, split: tuple[float, float, float]) -> np.ndarray:
        """What profiles start..stop give item a with each of the items b."""
        wa, wb, wo = split
        both = self.known[start:stop, a : a + 1] & self.known[start:stop, b]
        mixed = wa * self.linear[start:stop, a : a + 1] + wb * self.linear[start:stop, b]
        if self.other is not None:
            mixed = mixed + wo * self.other_linear[start:stop, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.log(mixed) + self.top[start:stop, None]
        wide = np.flatnonzero(self.wide[start:stop])
        if len(wide):
            at = wide + start
            out[wide] = _mixed(self.values[at, a][:, None], self.values[np.ix_(at, b)], None if self.other is None else self.other[at][:, None], wa, wb, wo)
        return (np.where(both, out, 0.0) * self.weight[start:stop, None]).sum(axis=0)

    def bound(self, a: int, b: np.ndarray) -> np.ndarray:
        """At least what item a and each of the items b can have in all."""
        most = np.maximum(self.alone[:, a : a + 1], self.alone[:, b])
        most[~(self.known[:, a : a + 1] & self.known[:, b])] = 0.0
        return self.weight @ most

    def totals(self, a: int, b: np.ndarray, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        """(items, totals) of those of b that reach the cutoff with a, by the best split of each."""
        found = []
        for same in (True, False):
            some = b[(b == a) == same]
            if not same and np.isfinite(cutoff) and len(some):
                some = some[self.bound(a, some) >= cutoff - SLACK]
            splits = self.splits(same)
            part, start = np.zeros((len(splits), len(some))), 0
            for stop in self.bounds:
                for k, split in enumerate(splits):
                    part[k] += self.sums(a, some, start, stop, split)
                stays = part.max(axis=0) + self.remaining[stop] >= cutoff - SLACK
                some, part, start = some[stays], part[:, stays], stop
                if not len(some):
                    break
            found.append((some, part.max(axis=0) if len(some) else np.zeros(0)))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def pairs(self, most: int | None) -> list[tuple[int, int, float]]:
        """(a, b, total), a <= b, the best first."""
        n = self.values.shape[1]
        every = np.arange(n)
        together = self.known.T.astype(np.float32) @ self.known.astype(np.float32) > 0
        cutoff = -np.inf
        if most is not None and n > SEEDS:
            single = np.array([self.totals(a, np.array([a]), -np.inf)[1][0] for a in range(n)])
            seeds = np.sort(np.argsort(-single, kind="stable")[:SEEDS])
            first = np.concatenate([self.totals(a, seeds[(seeds >= a) & together[a, seeds]], -np.inf)[1] for a in seeds.tolist()])
            if len(first) >= most:
                cutoff = np.sort(first)[-most]
        out: list[tuple[int, int, float]] = []
        for a in range(n):
            b, total = self.totals(a, every[(every >= a) & together[a]], cutoff)
            out += [(a, int(j), float(t)) for j, t in zip(b, total, strict=True)]
            if most is not None and len(out) > 4 * most:
                out = sorted(out, key=lambda x: -x[2])
                cutoff = max(cutoff, out[most - 1][2])
                out = [x for x in out if x[2] >= cutoff - SLACK]
        out.sort(key=lambda x: (-x[2], x[0], x[1]))
        return out if most is None else out[:most]


def best_pairs(loglik: DataFrame, keys: list[str], read: str, item: str, value: str, other: str | None = None, copies: str | None = None, most: int | None = None) -> DataFrame:
    """(keys, a, b, total): pairs of items a <= b by the sum over fragments of the ln likelihood that a fragment is of either with even chance.

    loglik has a row for each fragment and item. With `other`, the ln likelihood of a third source, a fragment is one of `copies` + 1 of which one is the third source's, and the pair shares
    the rest by the split that fits best (a pair of one item has it all). most: only so many of the best pairs.
    """
    each = loglik.groupBy(*keys, read).agg(
        F.array_sort(F.collect_list(F.struct(F.col(item).alias("i"), F.col(value).cast("double").alias("v")))).alias("__p"),
        (F.first(other).cast("double") if other else F.lit(None).cast("double")).alias("__o"), (F.first(copies).cast("int") if copies else F.lit(0)).alias("__c"),
    )
    profiles = each.select(*keys, F.transform("__p", lambda x: x["i"]).alias("__i"), F.transform("__p", lambda x: x["v"]).alias("__v"), "__o", "__c")
    profiles = profiles.groupBy(*keys, "__i", "__v", "__o", "__c").agg(F.count("*").alias("__n"))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        names = sorted({i for some in x["__i"] for i in some})
        place = {i: k for k, i in enumerate(names)}
        values = np.full((len(x), len(names)), np.nan)
        for r, (some, v) in enumerate(zip(x["__i"], x["__v"], strict=True)):
            values[r, [place[i] for i in some]] = v
        third = None if other is None else x["__o"].to_numpy(np.float64)
        found = Profiles(values, x["__n"].to_numpy(), third, int(x["__c"].iloc[0])).pairs(most)
        key = {k: [x[k].iloc[0]] * len(found) for k in keys}
        return pd.DataFrame(key | {"a": [names[a] for a, _, _ in found], "b": [names[b] for _, b, _ in found], "total": [t for _, _, t in found]}, columns=[*keys, "a", "b", "total"])

    kind = loglik.schema[item].dataType.simpleString()
    schema = "".join(f"`{k}` {loglik.schema[k].dataType.simpleString()}, " for k in keys) + f"a {kind}, b {kind}, total double"
    return profiles.groupBy(*keys).applyInPandas(run, schema)
