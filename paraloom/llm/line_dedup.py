"""Line dedup: explode normalised lines, hash them, count the documents of each hash, drop lines over a threshold, reassemble by position.

Only DataFrame functions. Lines travel as hashes and positions, so each text is shuffled once, when the positions to drop
meet their document. The hashes are written to the shared checkpoint folder, so texts are split for them once. Counting is two-phase (a hot line shrinks before the shuffle); the join that finds the dropped
lines is a sort-merge join whose hot partitions adaptive execution splits. What stays of a document are the runs of lines between dropped positions, so the work
is in proportion to its lines, however many go.

Defined cases: a null or empty text is one empty line and keeps an empty text; lines of one text that are equal count one
document; rows with the same doc_id count as one document and each keeps its own lines; a null doc_id is one document of
its own, below all others; a text whose lines all go becomes the empty text; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.llm.common import LOWER, SPACES, UPPER, ascii_lower, cut, read_table

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    """What makes two lines the same: without white space at the ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, row, pos, h1, h2) of every line whose key has min_chars code points or more."""
    keys = F.filter(
        F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("key"))),
        lambda x: F.char_length(x["key"]) >= min_chars,
    )
    hashed = F.transform(keys, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(7), x["key"]).alias("h2")))
    return rows.where(F.char_length("text") >= min_chars).select("id", F.xxhash64("text").alias("row"), F.explode(hashed).alias("x")).select("id", "row", "x.*")


def _without(parts: Column, ends: Column) -> Column:
    """The lines between positions; ends has those that go in order, -1 before and the number of lines after them."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda k: F.slice(parts, F.get(ends, k - 1) + 2, F.get(ends, k) - F.get(ends, k - 1) - 1))
    return F.flatten(runs)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, out: str = "line_dedup") -> DataFrame:
    """docs with the struct column `out` (text, n_lines, n_dropped): the text without its repeated lines.

    A line stays in the largest id that holds it. A column of docs of that name is replaced.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = cut(_long_lines(rows, min_chars))
    common = (
        lines.groupBy("h1", "h2").agg(F.count_distinct(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # a key of its own for the join: else it would reuse the aggregation's partitions, and a hot line's could not be split
    pair = F.col("h1").bitwiseXOR(F.col("h2")).alias("h12")
    drops = (
        lines.select("*", pair).join(common.select("*", pair), ["h1", "h2", "h12"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("__id"), F.col("row").alias("__row")).agg(F.collect_set("pos").alias("__drop"))
    )
    held = docs.select(F.struct(*docs.columns).alias("__d"), F.col(id_col).alias("__i"), F.col(text_col).alias("__t"))
    met = held.join(drops, held["__i"].eqNullSafe(drops["__id"]) & (F.xxhash64(held["__t"]) == drops["__row"]), "left")
    parts, gone = _lines(F.col("__t")), F.coalesce(F.size("__drop"), F.lit(0))
    ends = F.concat(F.array(F.lit(-1)), F.array_sort("__drop"), F.array(F.size(parts)))
    met = met.withColumn("__ends", F.when(F.col("__drop").isNotNull(), ends))
    kept = F.when(F.col("__drop").isNull(), F.coalesce(F.col("__t"), F.lit(""))).otherwise(F.array_join(_without(parts, F.col("__ends")), "\n"))
    found = F.struct(kept.alias("text"), F.size(parts).cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"))
    return met.select(*[F.col("__d")[c].alias(c) for c in docs.columns if c != out], found.alias(out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    x = F.col("line_dedup")
    return dedup_lines(docs).select("doc_id", x["n_lines"].alias("n_lines"), x["n_dropped"].alias("n_dropped"), F.sha2(x["text"].cast("binary"), 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their repeated lines gone, and n_chars anew; a null text becomes empty, rows that repeat keep their own lines, and columns of any name pass through."""
    out, x = dedup_lines(docs, out="__line_dedup"), F.col("__line_dedup.text")
    new = {"text": x, "n_chars": F.char_length(x).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, rid, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (
    SELECT doc_id, rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
  )
),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
),
marked AS (
  SELECT l.rid, l.doc_id, l.pos, l.line, c.key IS NOT NULL AND l.doc_id IS DISTINCT FROM c.keeper AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
