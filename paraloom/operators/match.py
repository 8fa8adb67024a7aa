"""Joins by content: multisets of names against dictionaries, sets against sets, nearest vectors, k-mers and q-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.functions.scalar import main_allele, multiset_key
from paraloom.operators.grams import known_grams, occurrences
from paraloom.operators.pair_search import best_pairs
from paraloom.operators.sides import small

# Alleles that yield to any other candidate.
RARE_ALLELES = ("*34", "*39", "*4.009", "*139")
#: k-mers of a panel that go to the workers at most.
PANEL_KMERS = 500_000
FUZZY_EXTRA, FUZZY_MISSING, FUZZY_EXCESS, FUZZY_LEAST = 0.5, 0.3, 2, 1.0


def _times(parts: Column, n: int) -> Column:
    return F.flatten(F.array_repeat(parts, n))


def pair_dictionary(items: DataFrame, patterns: list[tuple[int, int, bool]], fixed: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """(key, candidates): the multisets of two items, as (times a, times b, ordered) patterns say, and the name lists that give each.

    items (ord, name, parts). fixed: (names, parts) that each multiset holds beside the two. The key is the sorted parts.
    """
    a, b = (items.select(F.col("ord").alias(f"o{k}"), F.col("name").alias(f"n{k}"), F.col("parts").alias(f"p{k}")) for k in "ab")
    rows = None
    for m, n, ordered in patterns:
        for names, parts in fixed or [([], [])]:
            pairs = a.join(b, F.col("oa") <= F.col("ob")) if ordered else a.crossJoin(b)  # the dictionary's own items: hundreds, whatever the samples
            more_names, more_parts = (F.array(*map(F.lit, x)).cast("array<string>") for x in (names, parts))
            whole = F.concat(_times(F.col("pa"), m), _times(F.col("pb"), n), more_parts)
            who = F.concat(F.array_repeat("na", m), F.array_repeat("nb", n), more_names)
            made = pairs.select(multiset_key(whole).alias("key"), F.array_join(F.array_sort(who), "_").alias("candidate"))
            rows = made if rows is None else rows.unionByName(made)
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))


def single_dictionary(items: DataFrame) -> DataFrame:
    """(key, candidates) of single items; of items with equal parts the first in order."""
    keyed = items.select(multiset_key(F.col("parts")).alias("key"), "name", "ord")
    return keyed.groupBy("key").agg(F.array(F.min_by("name", "ord")).alias("candidates"))


def triple_matches(observed: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, candidates): the triples of items whose parts are exactly a row's `names`.

    Only items all of whose parts are observed often enough can be in such a triple, so each row builds its own few; the
    dictionary of all triples is never made.
    """
    rows = observed.select(*keys, F.array_sort("names").alias("__obs"))
    some = F.filter("parts", lambda x: x != "NA")
    fits = F.forall(F.array_distinct(some), lambda x: F.size(F.filter(some, lambda y: y == x)) <= F.size(F.filter("__obs", lambda y: y == x)))
    few = rows.join(small(items.select("ord", "name", "parts")), fits)
    of = lambda k: few.select(*[F.col(c).alias(f"__{c}{k}") for c in keys], F.col("ord").alias(f"o{k}"), F.col("name").alias(f"n{k}"), F.col("parts").alias(f"p{k}"))
    same = lambda a, b: [F.col(f"__{c}{a}").eqNullSafe(F.col(f"__{c}{b}")) for c in keys]
    a, b, c = of("a"), of("b"), of("c")
    ab = a.join(b, [*same("a", "b"), F.col("oa") <= F.col("ob")])
    abc = ab.join(c, [*same("a", "c"), F.col("ob") <= F.col("oc")])
    found = abc.select(*[F.col(f"__{k}a").alias(k) for k in keys], multiset_key(F.concat("pa", "pb", "pc")).alias("key"), F.array_join(F.array_sort(F.array("na", "nb", "nc")), "_").alias("candidate"))
    wanted = rows.select(*keys, multiset_key(F.col("__obs")).alias("key"))
    return found.join(wanted, [*keys, "key"], "left_semi").groupBy(*keys, "key").agg(F.array_sort(F.collect_set("candidate")).alias("candidates"))


def main_forms(candidates: Column) -> Column:
    """The candidates with sub-alleles reduced to main alleles, sorted, once each."""
    return F.array_sort(F.array_distinct(F.transform(candidates, lambda c: F.array_join(F.array_sort(F.transform(F.split(c, "_"), main_allele)), "_"))))


def classify(df: DataFrame, rare: tuple[str, ...] = RARE_ALLELES) -> DataFrame:
    """df (with candidates) with call_info and star_call."""
    forms = main_forms(F.col("candidates"))
    common = F.filter("candidates", lambda c: ~F.exists(F.array(*map(F.lit, rare)), lambda r: F.contains(c, r)))
    left = main_forms(common)
    info = (
        F.when(F.coalesce(F.size("candidates"), F.lit(0)) <= 0, "no_match").when(F.size("candidates") == 1, "unique_match").when(F.size(forms) == 1, "unique_star")
        .when(F.size(left) == 1, "pick_common_allele").otherwise("more_than_one_match")
    )
    call = F.when(info == "no_match", F.array().cast("array<string>")).when(info.isin("unique_match", "unique_star"), forms).otherwise(left)
    return df.withColumn("call_info", info).withColumn("star_call", call)


def exact_match(observed: DataFrame, dictionary: DataFrame, names: str, on: tuple[str, ...] = ()) -> DataFrame:
    """observed with key, candidates, call_info and star_call, by equality of sorted multisets."""
    keyed = observed.withColumn("key", multiset_key(F.col(names)))
    return classify(keyed.join(dictionary, [*on, "key"], "left"))


def _numbered(names: Column) -> Column:
    """Sorted names, each with the number of its repeat, so that a multiset is a set."""
    held = F.array_sort(names)
    return F.transform(held, lambda x, i: F.concat_ws("#", x, (i + 2 - F.array_position(held, x)).cast("string")))


def _rarest(rows: DataFrame, key: str, words: str, frequency: DataFrame, n: int) -> DataFrame:
    """(key, word): the n rarest words of each row; words without a frequency come first."""
    each = rows.select(key, F.explode(words).alias("__w")).join(frequency, "__w", "left")
    order = Window.partitionBy(key).orderBy(F.coalesce("__f", F.lit(0)), "__w")
    return each.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= n).select(key, "__w")


def fuzzy_match(observed: DataFrame, dictionary: DataFrame, keys: list[str], names: str) -> DataFrame:
    """(keys, key, score): the best candidate of each row with a score of 1 or more; the smallest key of equals.

    Each distinct multiset is matched once. Two multisets that differ by FUZZY_EXCESS names on either side share one of
    their FUZZY_EXCESS + 1 rarest names, in any one order of names, so candidates come from an equal join on those alone.
    """
    rows = observed.select(*keys, F.array_sort(names).alias("__o")).withColumn("__m", F.to_json("__o"))
    some = rows.select("__m", "__o").dropDuplicates(["__m"]).withColumn("__on", _numbered(F.col("__o")))
    words = dictionary.select("key", F.split("key", "_").alias("__c")).where("key <> 'NA'").withColumn("__cn", _numbered(F.col("__c")))
    frequency = words.select(F.explode("__cn").alias("__w")).groupBy("__w").agg(F.count("*").alias("__f"))
    left = _rarest(some, "__m", "__on", frequency, FUZZY_EXCESS + 1)
    right = _rarest(words, "key", "__cn", frequency, FUZZY_EXCESS + 1)
    pairs = left.join(right, "__w").select("__m", "key").distinct().join(some, "__m").join(words, "key")
    both = F.size(F.array_intersect("__on", "__cn"))
    extra, missing = F.size("__cn") - both, F.size("__on") - both
    score = F.when((extra <= FUZZY_EXCESS) & (missing <= FUZZY_EXCESS), F.round(both - FUZZY_EXTRA * extra - FUZZY_MISSING * missing, 6))
    scored = pairs.select("__m", "key", score.alias("score")).where(F.col("score") >= FUZZY_LEAST)
    best = scored.groupBy("__m").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("b"))
    return rows.select(*keys, "__m").join(best, "__m").select(*keys, F.col("b.key").alias("key"), (-F.col("b.s")).alias("score"))


def lookup_pivot(rows: DataFrame, keys: list[str], name: str, value: str, names: list[str], default: str = "n/a") -> DataFrame:
    """One row per key with a column for each name, the default where there is no value."""
    wide = rows.groupBy(*keys).pivot(name, names).agg(F.first(value))
    return wide.select(*keys, *[F.coalesce(F.col(f"`{n}`").cast("string"), F.lit(default)).alias(n) for n in names])


def pair_mixture(loglik: DataFrame, keys: list[str], read: str, item: str, value: str, most: int | None = None) -> DataFrame:
    """(keys, a, b, total): for all a <= b the sum over reads of ln((e^la + e^lb) / 2), or for the best `most` of them."""
    return best_pairs(loglik, keys, read, item, value, most=most)


def windows(text: Column, k: int) -> Column:
    """All substrings of k characters, in order; the text is cut into characters once (as an element of its own, so that no window cuts it again)."""
    cut = F.array(F.split(text, ""))
    each = F.transform(cut, lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, F.lit(k)), "")))
    return F.when(F.char_length(text) >= k, F.get(each, F.lit(0))).otherwise(F.array().cast("array<string>"))


def kmer_hits(texts: DataFrame, keys: list[str], text: str, panel: DataFrame, k: int, without: str = "N", panel_kmers: int = PANEL_KMERS) -> DataFrame:
    """(keys, panel columns, n): occurrences of a panel's k-mers (column kmer) in each text; windows with `without` do not count."""
    panel = panel.where(~F.contains("kmer", F.lit(without))) if without else panel
    hits = _gram_counts(texts, keys, text, panel.select(F.col("kmer").alias("gram")), k, panel_kmers)
    return hits.join(panel, "kmer").groupBy(*keys, *panel.columns).agg(F.sum("n").cast("long").alias("n"))


def _gram_counts(texts: DataFrame, keys: list[str], text: str, grams: DataFrame, k: int, most: int) -> DataFrame:
    """(keys, kmer, n) of windows that are among the grams; with too many of those for the workers, of all windows."""
    known = known_grams(grams.where(F.char_length("gram") == k), most)
    if known is None:
        return texts.select(*keys, F.explode(windows(F.col(text), k)).alias("kmer")).groupBy(*keys, "kmer").agg(F.count("*").alias("n"))
    return occurrences(texts, keys, text, known, k).withColumnRenamed("gram", "kmer")


def shared_kmers(texts: DataFrame, keys: list[str], text: str, items: DataFrame, item_id: str, item_text: str, k: int, panel_kmers: int = PANEL_KMERS) -> DataFrame:
    """(keys, item_id, n): windows of each text that stand anywhere in an item, for all windows of the items' whole texts.

    A panel of few k-mers goes to the workers, which then give only windows that hit; of a larger one all windows are joined.
    """
    panel = items.where(F.char_length(item_text) >= k).select(item_id, F.explode(windows(F.col(item_text), k)).alias("kmer")).distinct()
    hits = _gram_counts(texts, keys, text, panel.select(F.col("kmer").alias("gram")), k, panel_kmers)
    return hits.join(panel, "kmer").groupBy(*keys, item_id).agg(F.sum("n").cast("long").alias("n"))


def qgram_seeds(queries: DataFrame, query_id: str | list[str], query: str, refs: DataFrame, ref_id: str, ref: str, q: int, max_k: int, most_hits: int | None = 500, panel_grams: int = PANEL_KMERS, few_places: bool = False) -> DataFrame:
    """(query_id, ref_id, diagonal): candidates of pigeonhole seeding, once per bucket of max_k + 1 diagonals.

    A match with max_k errors leaves one of max_k + 1 disjoint seeds whole. q-grams with over most_hits places are repeats
    and give no seeds; most_hits None seeds with all of them, so that no candidate is lost. query_id may be several columns. few_places says that
    the references' places go to every task; queries that are dealt by a column of query_id then stay where they are.
    """
    ids = [query_id] if isinstance(query_id, str) else query_id
    seeds = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_k)), lambda i: F.struct((i * q).alias("off"), F.substring(F.col(query), i * q + 1, F.lit(q)).alias("gram"))), lambda s: F.char_length(s["gram"]) == q)
    left = queries.select(*ids, F.explode(seeds).alias("s")).select(*ids, F.col("s.off").alias("off"), F.col("s.gram").alias("gram"))
    # only places of grams that are asked for go on
    known = known_grams(left, panel_grams)
    if known is None:
        grams = refs.select(ref_id, F.posexplode(windows(F.col(ref), q)).alias("at", "gram")).join(left.select("gram").distinct(), "gram", "left_semi")
    else:
        grams = occurrences(refs, [ref_id], ref, known, q, places=True).withColumn("at", F.col("at").cast("int"))
    if most_hits is not None:
        common = grams.groupBy("gram").agg(F.count("*").alias("__n")).where(F.col("__n") > most_hits).select("gram")
        grams = grams.join(common, "gram", "left_anti")
    hits = left.join(F.broadcast(grams) if few_places else grams, "gram").withColumn("d", F.col("at") - F.col("off"))
    return hits.groupBy(*ids, ref_id, F.floor(F.col("d") / (max_k + 1)).alias("bucket")).agg(F.min("d").alias("diagonal")).drop("bucket")


def nearest(queries: DataFrame, query_id: str, vector: str, train: DataFrame, train_vector: str, label: str, order: str, k: int = 5, block: int = 4096) -> DataFrame:
    """(query_id, label, confidence): the vote of the k nearest training rows; the lowest label of equals.

    Both sides may be of any size: they are dealt into blocks and every pair of blocks gives its k nearest a query.

    Rows without a vector are left out; the training side has those with a label.
    """
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_id).alias("__q"), F.col(vector).cast("array<float>").alias("__v"))
    t = train.where(F.col(train_vector).isNotNull() & F.col(label).isNotNull()).select(F.col(order).alias("__o"), F.col(label).alias("label"), F.col(train_vector).cast("array<float>").alias("__v"))
    n_q, n_t = (max(1, -(-df.count() // block)) for df in (q, t))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("__i", F.pmod(F.xxhash64("__q"), F.lit(n_q)).cast("int")).withColumn("__j", every(n_t))
    right = t.withColumn("__j", F.pmod(F.xxhash64("__o"), F.lit(n_t)).cast("int")).withColumn("__i", every(n_q))
    q_type, o_type, l_type = q.schema["__q"].dataType.simpleString(), t.schema["__o"].dataType.simpleString(), t.schema["label"].dataType.simpleString()

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = ([], [], [])
        if len(x) and len(y):
            y = y.sort_values("__o", kind="stable")  # places in y are in order of ties
            a, b = np.stack(x["__v"].to_numpy()).astype(np.float32), np.stack(y["__v"].to_numpy()).astype(np.float32)
            b64 = b.astype(np.float64)
            squares = (b64 * b64).sum(axis=1)
            for at in range(0, len(a), 256):
                part = a[at : at + 256].astype(np.float64)
                own = (part * part).sum(axis=1)
                d2 = own[:, None] + squares[None, :] - 2 * part @ b64.T
                kth = np.partition(d2, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1]
                # more than the error of the product and of rounding to six places
                most = (np.sqrt(np.maximum(kth, 0)) + 1e-5) ** 2 + 1e-12 * (own + squares.max())
                row, col = np.nonzero(d2 <= most[:, None])
                dist = np.concatenate([((part_a.astype(np.float64)) ** 2).sum(axis=1) for s in range(0, len(row), 1 << 16) for part_a in [a[at + row[s : s + (1 << 16)]] - b[col[s : s + (1 << 16)]]]])
                dist = np.floor(np.sqrt(dist) * 1e6 + 0.5) / 1e6
                by = np.lexsort((col, dist, row))
                row, col, dist = row[by], col[by], dist[by]
                first = np.arange(len(row)) - np.searchsorted(row, row) < k
                for out, values in zip(found, (row[first] + at, col[first], dist[first]), strict=True):
                    out.append(values)
        row, col, dist = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in found)
        return pd.DataFrame({"__q": x["__q"].to_numpy()[row], "label": y["label"].to_numpy()[col], "__o": y["__o"].to_numpy()[col], "dist": dist.astype(np.float64)})

    scored = left.groupBy("__i", "__j").cogroup(right.groupBy("__i", "__j")).applyInPandas(near, f"__q {q_type}, label {l_type}, __o {o_type}, dist double")
    kept = scored.withColumn("__k", F.row_number().over(Window.partitionBy("__q").orderBy("dist", "__o"))).where(F.col("__k") <= k)
    votes = kept.groupBy(F.col("__q").alias(query_id), "label").agg(F.count("*").alias("__n"))
    return votes.groupBy(query_id).agg(F.max_by("label", F.struct("__n", -F.col("label"))).alias("label"), (F.max("__n") / F.sum("__n")).alias("confidence"))


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, both, only_left, only_right): sizes of multiset intersection and differences."""
    a, b = left.groupBy(*keys, name).agg(F.count("*").alias("l")), right.groupBy(*keys, name).agg(F.count("*").alias("r"))
    met = a.join(b, [*keys, name], "full_outer").na.fill(0, ["l", "r"])
    return met.groupBy(*keys).agg(F.sum(F.least("l", "r")).alias("both"), F.sum(F.greatest(F.col("l") - F.col("r"), F.lit(0))).alias("only_left"), F.sum(F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("only_right"))
