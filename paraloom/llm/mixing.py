"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: the sources in order of code point weigh 5, 2, 1, repeating, and share `share` of all words; none gets more than
`most` times its size, and the excess goes to the others by weight (water filling in closed form over one row per source). Words come in
blocks of equal size. Blocks go to sources by the highest quotients target / (2k + 1): a divisor found by bisection gives all
but the last of them, and exact quotients give those. A source's blocks go to groups of its shards and from there to shards (documents by
hash, a bounded number of words each) by the same rule, at most `most` times the blocks of a shard. Inside a shard the seed orders the documents: the quota
over the shard's blocks takes whole passes first, then the first blocks in that order. So in each shard one document at most is taken in part, and that part is its beginning.

Defined cases: a null or empty text has size 0 and gives nothing; a null source is a source of its own, last; repeated rows are documents
of their own; equal quotients go by a hash of source and shard; a source of size 0 has target 0; no documents give no rows; other columns are not looked at.
The table of sources, one row each, is put in order in one task.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.llm.common import SPACES, WORD, cut, read_table, small

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK_WORDS = 16
#: Words and documents of a shard, about, and shards of a group.
SHARD, GROUP = 1 << 18, 4096
SEED = 17
#: Sources, and shards whose quotas the stage needs, that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """The words of a text, in order."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ", -1)
    return F.filter(parts, lambda x: x != "")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rank = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), rank + 1).cast("long")).withColumn("cap", F.col("source_size") * most)
    # sources reach their cap in this order as the level per weight rises
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    rows = rows.withColumn("cap_before", F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("w_from", F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    everything = F.sum("source_size").over(Window.partitionBy())
    level = (F.lit(share) * everything - F.col("cap_before")) / F.col("w_from")
    rows = rows.withColumn("level", level)
    # the first source that stays below its cap gives the level of all that follow
    open_level = F.min(F.when(F.col("level") * F.col("w") < F.col("cap"), F.struct("cap_before", "level"))).over(Window.partitionBy())["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(open_level * F.col("w"), F.col("cap").cast("double")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def highest_quotients(weights: np.ndarray, seats: int, caps: np.ndarray | None, order: np.ndarray) -> np.ndarray:
    """Seats by the highest quotients weight / (2k + 1), none beyond its cap; equal quotients go in the order given.

    A divisor just above the one that gives away all seats is found by bisection, since the seats given fall as it rises; what is
    left then goes by exact quotients, one seat at a time.
    """
    given = np.zeros(len(weights), dtype=np.int64)
    caps = np.full(len(weights), seats, dtype=np.int64) if caps is None else caps
    caps = np.where(weights > 0, np.minimum(caps, seats), 0)
    seats = min(seats, int(caps.sum()))
    if seats <= 0:
        return given
    at = lambda divisor: np.minimum(np.floor(weights / (2 * divisor) + 0.5), caps).astype(np.int64)
    # all seats are given where every part's quotient of its last seat is reached
    low, high = float((weights / (2.0 * np.maximum(caps, 1) + 1))[caps > 0].min()) * 0.5, float(weights.max()) * 2
    while high > low * (1 + 1e-12):
        middle = (low * high) ** 0.5
        if not low < middle < high:
            break
        low, high = (middle, high) if at(middle).sum() >= seats else (low, middle)
    given = at(high * (1 + 1e-9))
    heap = [(-Fraction(float(weights[k])) / int(2 * given[k] + 1), int(order[k]), k) for k in np.flatnonzero(given < caps).tolist()]
    heapq.heapify(heap)
    for _ in range(seats - int(given.sum())):
        _, _, k = heap[0]
        given[k] += 1
        if given[k] < caps[k]:
            heapq.heapreplace(heap, (-Fraction(float(weights[k])) / int(2 * given[k] + 1), int(order[k]), k))
        else:
            heapq.heappop(heap)
    return given


def apportion(parts: DataFrame, key: list[str], weight: str, seats: str, cap: str | None = None) -> DataFrame:
    """parts with `quota`: the seats of a key (the same in each of its rows) given to its parts by the highest quotients weight / (2k + 1), up to their caps.

    A key's parts meet in one task, so a key has few: the sources, the groups of a source, or the shards of a group. Ties go by the column __tie.
    """

    def run(x: pd.DataFrame) -> pd.DataFrame:
        order = np.empty(len(x), dtype=np.int64)
        order[np.argsort(x["__tie"].to_numpy(), kind="stable")] = np.arange(len(x))
        caps = x[cap].to_numpy(np.int64) if cap else None
        return x.assign(quota=highest_quotients(x[weight].to_numpy(np.float64), int(x[seats].iloc[0]), caps, order))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return parts.groupBy(*key).applyInPandas(run, f"{schema}, quota long")


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """(doc_id, source, size, h, more): h is what deals a document to its shard and orders it there."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *more, F.xxhash64(F.lit(seed), id_col, text).alias("h"))


def _shard(shards: Column) -> Column:
    return F.pmod(F.xxhash64("h"), shards)


def _quotas(sized: DataFrame, weights: tuple[int, ...], share: float, most: int, block: int, shard_words: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target, shards) of each source, and (source, shard, blocks, passes, picked) of each shard."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    wanted = targets(sources.select("source", "source_size"), weights, share, most).join(
        sources.select(F.col("source").alias("__s"), "n_docs"), F.col("source").eqNullSafe(F.col("__s"))
    )
    all_blocks = F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long")
    wanted = wanted.select("source", "source_size", "target", "n_docs", F.xxhash64("source").alias("__tie"), all_blocks.alias("all_blocks"))
    wanted = apportion(wanted, [], "target", "all_blocks").withColumnRenamed("quota", "source_blocks")
    wanted = cut(wanted.select("source", "source_size", "target", "source_blocks", F.ceil((F.col("source_size") + F.col("n_docs")) / shard_words).cast("long").alias("shards")))
    named = wanted.select(F.col("source").alias("__s"), "source_blocks", "shards")
    dealt = sized.join(small(named, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("__s"))).withColumn("shard", _shard(F.col("shards")))
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_blocks").alias("source_blocks"))
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / block).cast("long")).withColumn("__g", F.floor(F.col("shard") / group))
    groups = shards.groupBy("source", "__g").agg(F.sum("shard_size").alias("group_size"), F.sum("blocks").alias("group_blocks"), F.first("source_blocks").alias("source_blocks"))
    groups = groups.withColumn("__tie", F.xxhash64("source", "__g")).withColumn("__cap", F.col("group_blocks") * most)
    groups = apportion(groups, ["source"], "group_size", "source_blocks", "__cap")
    groups = groups.select(F.col("source").alias("__s"), F.col("__g").alias("__h"), F.col("quota").alias("group_quota"))
    shards = shards.join(groups, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__g") == F.col("__h"))).withColumn("__tie", F.xxhash64("source", "shard"))
    shards = shards.select("source", "shard", "__g", "shard_size", "blocks", "group_quota", "__tie", (F.col("blocks") * most).alias("__cap"))
    quotas = apportion(shards, ["source", "__g"], "shard_size", "group_quota", "__cap")
    passes = F.coalesce(F.floor(F.try_divide(F.col("quota"), F.col("blocks"))), F.lit(0)).cast("long")
    quotas = quotas.withColumn("passes", passes).select("source", "shard", "blocks", "passes", (F.col("quota") - F.col("passes") * F.col("blocks")).alias("picked"))
    return wanted, quotas


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block: int = BLOCK_WORDS,
    shard_words: int = SHARD,
    seed: int = SEED,
    group: int = GROUP,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, passes, first_word, shard, blocks, picked, h) for each document.

    A document is taken `passes` times whole and once more in the words that it has among the first `picked` blocks of its shard.
    """
    sized = cut(_dealt(docs, id_col, text_col, source_col, seed, F.size(words(F.col(text_col))).cast("long").alias("size")))
    wanted, quotas = _quotas(sized, weights, share, most, block, shard_words, group)
    named = wanted.select(F.col("source").alias("__s"), "source_size", "target", "shards")
    dealt = sized.join(small(named, BROADCAST_ROWS), F.col("source").eqNullSafe(F.col("__s"))).withColumn("shard", _shard(F.col("shards"))).drop("__s", "shards")
    order = Window.partitionBy("source", "shard").orderBy("h", "doc_id", "size")
    placed = dealt.withColumn("first_word", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    quotas = quotas.select(F.col("source").alias("__s"), F.col("shard").alias("__k"), "blocks", "passes", "picked")
    out = placed.join(quotas, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__k")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("picked") * block - F.col("first_word")))
    out = out.withColumn("taken", F.col("passes") * F.col("size") + part)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "first_word", "shard", "blocks", "picked", "h")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    parts = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ", -1)
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("chars"))

    def add(s: Column, x: Column) -> Column:
        more = F.struct((s["words"] + F.when(x != "", 1).otherwise(0)).alias("words"), (s["chars"] + F.char_length(x) + 1).alias("chars"))
        return F.when(s["words"] >= n, s).otherwise(more)

    return F.substring(text, F.lit(1), F.aggregate(parts, start, add)["chars"] - 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("doc_id").cast("long"), "size", "source_size", "target", F.col("taken").cast("long"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, block: int = BLOCK_WORDS, shard_words: int = SHARD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The mix: a document's row as often as it is taken whole, and a row with its beginning where it is taken in part.

    A document is judged by its shard's quota and by the first document that the quota does not take whole, so texts are not shuffled.
    Rows without a word go; rows that are alike in doc_id and text are taken alike; columns of any name pass through.
    """
    plan = cut(mix(docs, block=block, shard_words=shard_words).select("source", "shard", "h", "doc_id", "size", "first_word", "passes", "picked"))
    past = F.col("first_word") + F.col("size") > F.col("picked") * block
    edge = F.min(F.when(past, F.struct("h", "doc_id", (F.col("picked") * block - F.col("first_word")).alias("words"))))
    shards = cut(plan.groupBy("source", "shard").agg(F.first("passes").alias("passes"), edge.alias("edge")).select(F.col("source").alias("__s"), F.col("shard").alias("__k"), "passes", "edge"))
    sources = cut(plan.groupBy(F.col("source").alias("__t")).agg(F.ceil((F.sum("size") + F.count("*")) / shard_words).cast("long").alias("__n")))
    rows = _dealt(docs, "doc_id", "text", "source", SEED, F.struct(*docs.columns).alias("__d"))
    rows = rows.where(F.col("__d.text").rlike(WORD)).join(small(sources, broadcast_rows), F.col("source").eqNullSafe(F.col("__t")))
    rows = rows.join(small(shards, broadcast_rows), F.col("source").eqNullSafe(F.col("__s")) & (_shard(F.col("__n")) == F.col("__k")))
    at, edge_id = F.col("edge.h"), F.col("edge.doc_id")
    same = F.col("edge").isNotNull() & (F.col("h") == at) & F.col("doc_id").eqNullSafe(edge_id)
    before = F.col("edge").isNull() | (F.col("h") < at) | ((F.col("h") == at) & F.coalesce(F.col("doc_id") < edge_id, F.col("doc_id").isNull() & edge_id.isNotNull()))
    part = F.when(same & (F.col("edge.words") > 0), F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>"))
    copies = F.concat(F.array_repeat(F.lit(True), F.col("passes").cast("int") + before.cast("int")), part)
    rows = rows.withColumn("__whole", F.explode(copies))
    text = F.when(F.col("__whole"), F.col("__d.text")).otherwise(first_words(F.col("__d.text"), F.col("edge.words")))
    rows = rows.withColumn("__text", text)
    new = {"text": F.col("__text"), "n_chars": F.char_length("__text").cast("long")}
    return rows.select(*[(new[c] if c in new else F.col("__d")[c]).alias(c) for c in docs.columns])
