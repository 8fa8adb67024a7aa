"""Filter interaction audit: what each filter removes, alone and after others, in every order; copies found by partition refinement.

Every document gets a mask of the filters that it fails. Four of them look at the text alone. The fifth fails what is identical to the text of
a smaller id, and is found by refining a partition: texts are split by code points, then by hashes of successive blocks (each eight times as
long as the one before, the last being the rest), and what is alone in its class goes before the next block is looked at. All hashes of a text are
taken in one scan, so rounds move numbers only. What is left is compared as whole texts with the smallest id of its class; classes in which two texts
differ after all (hashes that collide) are told apart by their texts. Masks are then counted for each part; all orders follow from those counts,
32 at most for a part, so no document is looked at once for each order.

A filter's Shapley value here is what it removes, summed over all orders: a document that fails k filters is removed by each of them in 1 / k of the orders.

Defined cases: a null text is empty, so null and empty texts are identical; a row whose id is null is no copy and makes no other a copy; rows with
one id and one text are no copies of each other (no id is smaller); an id with several labels counts as good (toxic) if one of them says so; a null part
and an empty one are one part, the empty string; no documents give no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.llm.common import UPPER, cut, read_table, small
from paraloom.llm.mixing import words

LETTERS = "ABCDE"
BIT = {letter: 1 << k for k, letter in enumerate(LETTERS)}
#: Code points of the blocks that are hashed one after the other; the rest of a text is the last block.
BLOCKS = (64, 512, 4096, 32768)
#: Classes of copies that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def text_mask(text: Column, min_words: int = 100, distinct_percent: int = 80, upper_percent: int = 10, signs: str = "[#$%&*|]") -> Column:
    """The bits of the filters A to D that a text (not null) fails."""
    parts, size = words(text), F.char_length(text)
    upper = size - F.char_length(F.translate(text, UPPER, ""))
    fails = {
        "A": F.size(parts) < min_words,
        "B": 100 * F.size(F.array_distinct(parts)) < distinct_percent * F.size(parts),
        "C": 100 * upper.cast("long") > upper_percent * size.cast("long"),
        "D": text.rlike(signs),
    }
    return reduce(lambda a, b: a + b, [F.when(failed, BIT[letter]).otherwise(0) for letter, failed in fails.items()])


def _block_hashes(text: Column, blocks: tuple[int, ...]) -> list[Column]:
    starts = [1 + sum(blocks[:k]) for k in range(len(blocks) + 1)]
    return [F.xxhash64(F.substring(text, s, n)) for s, n in zip(starts, [*blocks, 1 << 30], strict=True)]


def _class_of(length: Column, hashes: list[Column]) -> list[Column]:
    """The class after each round: by length, then by each block's hash."""
    made = [length.cast("long")]
    for x in hashes:
        made.append(F.xxhash64(made[-1], x))
    return made


def _refined(rows: DataFrame, rounds: int) -> DataFrame:
    """(id, last class) of the rows (id, c0, c1, ...) that share every class with another row."""
    for k in range(rounds):
        shared = rows.groupBy(f"c{k}").agg(F.count("*").alias("n")).where("n > 1").select(f"c{k}")
        # a key of its own beside the class: else the join would reuse the aggregation's partitions, and a hot class could not be split
        own = F.xxhash64(f"c{k}").alias("__own")
        kept = rows.select("*", own).join(shared.select("*", own), [f"c{k}", "__own"], "left_semi")
        rows = cut(kept.select("id", *[f"c{j}" for j in range(k + (k + 1 < rounds), rounds)]))
    return rows


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: tuple[int, ...] = BLOCKS, broadcast_rows: int = BROADCAST_ROWS, hashed: DataFrame | None = None) -> DataFrame:
    """(id, d) of each row of docs whose text is identical to that of a smaller id; d is the row as a struct.

    hashed: (id, c0, c1, ...) of all rows where their classes are known already.
    """
    rounds = len(blocks) + 2
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = classes_of(docs, id_col, text_col, blocks) if hashed is None else hashed
    last = f"c{rounds - 1}"
    alive = _refined(hashed.where("id IS NOT NULL"), rounds)
    least = cut(alive.groupBy(last).agg(F.min("id").alias("least")))
    held = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.struct(*docs.columns).alias("d"))
    held = held.select("*", _class_of(F.char_length("t"), _block_hashes(F.col("t"), blocks))[-1].alias(last)).where("id IS NOT NULL")
    members = held.join(small(least, broadcast_rows), last)
    first = members.where("id = least").groupBy(last).agg(F.min("t").alias("first"))
    own = F.xxhash64(last).alias("__own")
    met = members.select("*", own).join(first.select("*", own), [last, "__own"])
    apart = cut(met.where("t <> first").select(last).distinct())
    if apart.isEmpty():
        return met.where("t = first AND id > least").select("id", "d")
    # hashes collided: in those classes the texts themselves are the classes
    alike = met.join(small(apart, broadcast_rows), last, "left_anti").where("t = first AND id > least").select("id", "d")
    mixed = members.drop("least").join(small(apart, broadcast_rows), last)
    smallest = mixed.groupBy(last, "t").agg(F.min("id").alias("least"))
    return alike.unionByName(mixed.join(smallest, [last, "t"]).where("id > least").select("id", "d"))


def classes_of(docs: DataFrame, id_col: str, text_col: str, blocks: tuple[int, ...], *more: Column) -> DataFrame:
    """(id, c0, c1, ..., more) of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *more)
    made = _class_of(F.char_length("t"), _block_hashes(F.col("t"), blocks))
    return rows.select("id", *[c.alias(f"c{k}") for k, c in enumerate(made)], *[F.col(c) for c in rows.columns[2:]])


def mask_counts(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", blocks: tuple[int, ...] = BLOCKS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part that fail exactly the filters of a mask, and how many of them are labelled so."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    hashed = cut(classes_of(docs, "id", "text", blocks, F.col("part"), text_mask(F.coalesce(F.col("text"), F.lit(""))).alias("mask")))
    again = copies(docs, "id", "text", blocks, broadcast_rows, hashed.drop("part", "mask"))
    # a copy leaves the count of its first four filters and enters that with the fifth
    again = again.select("id", F.col("d.part").alias("part"), text_mask(F.coalesce(F.col("d.text"), F.lit(""))).alias("mask"))
    moved = again.select("id", "part", F.inline(F.array(F.struct(F.col("mask"), F.lit(-1).alias("n")), F.struct((F.col("mask") + BIT["E"]).alias("mask"), F.lit(1).alias("n")))))
    counts = hashed.select("id", "part", "mask", F.lit(1).alias("n")).unionByName(moved).groupBy("id", "part", "mask").agg(F.sum("n").alias("n")).where("n <> 0")
    said = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)).cast("long"))
    known = labels.groupBy(F.col("doc_id").cast("long").alias("id")).agg(said("quality").alias("g"), said("toxic").alias("x"))
    met = counts.join(known, "id", "left")
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("g")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("x")), F.lit(0)).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from the counts of masks."""
    every = ["".join(p) for p in permutations(LETTERS)]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    rows = parts.select("part", "masks", F.explode(F.lit(every)).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    place = {letter: F.instr("filter_order", letter) for letter in LETTERS}
    total = lambda bits: reduce(lambda a, b: a + b, bits)
    rows = rows.select(
        "*", total(F.when(at < F.col("step"), BIT[x]).otherwise(0) for x, at in place.items()).alias("before"), total(F.when(at == F.col("step"), BIT[x]).otherwise(0) for x, at in place.items()).alias("own")
    )

    def over(field: str, where) -> Column:
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda s, x: s + x[field])

    before, own = F.col("before"), F.col("own")
    fails = lambda x: x["mask"].bitwiseAND(own) > 0
    here = lambda x: fails(x) & (x["mask"].bitwiseAND(before) == 0)
    shares = F.aggregate(F.filter("masks", fails), F.lit(0).cast("long"), lambda s, x: s + x["n"] * F.floor(F.lit(len(every)) / F.bit_count(x["mask"])))
    return rows.select(
        "part", "filter_order", "step",
        over("n", lambda x: x["mask"].bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        over("n", here).alias("removed"),
        over("n", lambda x: fails(x) & (x["mask"].bitwiseAND(before) > 0)).alias("redundant"),
        over("n", lambda x: x["mask"] == own).alias("unique_fails"),
        over("good", here).alias("good_lost"),
        over("toxic", here).alias("toxic_lost"),
        shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return orders(cut(mask_counts(docs, labels, **options)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_FAILS = """
  (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT"""
ORACLE_SQL = f"""
WITH said AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS g, max(coalesce(toxic = 1, false)::INT) AS x FROM labels GROUP BY 1),
held AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
masks AS (SELECT doc_id, part, {_FAILS} AS mask FROM held),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(g), 0) AS good, coalesce(sum(x), 0) AS toxic FROM masks LEFT JOIN said USING (doc_id) GROUP BY ALL),
l AS (SELECT substr('ABCDE', i, 1) AS c, (1 << (i - 1))::INT AS b FROM range(1, 6) r(i)),
perms AS (SELECT a.c || b.c || d.c || e.c || f.c AS filter_order FROM l a, l b, l d, l e, l f WHERE a.b + b.b + d.b + e.b + f.b = 31 AND (a.b | b.b | d.b | e.b | f.b) = 31),
steps AS (SELECT filter_order, s::INT AS step, sum(CASE WHEN instr(filter_order, c) < s THEN b ELSE 0 END)::INT AS before, sum(CASE WHEN instr(filter_order, c) = s THEN b ELSE 0 END)::INT AS own
  FROM perms, range(1, 6) r(s), l GROUP BY ALL),
found AS (SELECT part, filter_order, step, own,
  sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM found
"""
