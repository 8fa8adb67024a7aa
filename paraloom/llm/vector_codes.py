"""Vector code compression: product quantisation in integers, nearest entries screened by float32 matrix products with rounding-error intervals.

A pass over the table finds each part's nearest code book entry: |x|^2 does not matter, so entries are ranked by |c|^2 - 2 x.c, with x.c taken from
one float32 matrix product. For d components any order of summation errs by at most g |x| |c| with g = (d + 2) u / (1 - (d + 2) u), u = 2^-24
(two roundings of the factors included; Cauchy-Schwarz bounds the sum of absolute products). Every entry whose interval reaches below the least upper end
is computed again in int64, and equal distances go to the lower index. A task gives one sum and count for each entry that it met, so what is shuffled and what comes to the
driver is bounded by the code books, whatever the table: entries x components numbers a round.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped; so are vectors that cannot be cut into parts of the
code books' length (that of the smallest id whose vector's length the parts divide); integers are kept within a bound that lets squared distances fit in a long
(2^28 for parts of 16 components, components of 262,144), larger ones are set to it; equal ids are ordered by their integers; a null id comes after all others; fewer
rows than entries make smaller code books; no rows give no rows; a label's error beyond a long is null; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from paraloom.llm.common import cut, read_table, small

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors that are compared at once, and exact distances that are taken at once.
ROWS, EXACT = 2048, 1 << 16
BROADCAST_ROWS = 200_000


def bound(width: int) -> int:
    """The largest integer allowed, so that the squared distance of two parts stays below 2^62 over all parts."""
    return math.isqrt((1 << 62) // max(1, PARTS * width)) // 2


def integers(vectors: np.ndarray, scale: int, most: int) -> np.ndarray:
    return np.clip(np.floor(vectors.astype(np.float64) * scale), -most, most).astype(np.int64)


def screened(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) in order: every pair whose distance may be the row's least, by intervals around float32 products."""
    u = 2.0**-24
    g = (x.shape[1] + 2) * u / (1 - (x.shape[1] + 2) * u)
    wide, entries = x.astype(np.float64), book.astype(np.float64)
    square = (entries**2).sum(axis=1)
    products = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
    lengths = np.sqrt((wide**2).sum(axis=1))[:, None] * np.sqrt(square)
    score = square - 2 * products
    # the float32 product's error, and what double precision adds in squares, lengths and the score
    error = 2 * g * lengths * (1 + 1e-9) + 2.0**-48 * (square + 2 * np.abs(products)) + 1e-9
    return np.nonzero(score - error <= (score + error).min(axis=1, keepdims=True))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest entry, exact in int64, ties to the lower index."""
    # of equal entries only the first can win
    _, first = np.unique(book, axis=0, return_index=True)
    first.sort()
    row, entry = screened(x, book[first])
    entry = first[entry]
    distance = np.empty(len(row), dtype=np.int64)
    for k in range(0, len(row), EXACT):
        apart = x[row[k : k + EXACT]] - book[entry[k : k + EXACT]]
        distance[k : k + EXACT] = (apart * apart).sum(axis=1)
    starts = np.searchsorted(row, np.arange(len(x)))  # each row has one pair at least
    least = np.minimum.reduceat(distance, starts) if len(x) else distance
    best = np.flatnonzero(distance == least[row])
    return entry[best[np.searchsorted(row[best], np.arange(len(x)))]], least


def _vectors(batch: pa.RecordBatch, column: int, size: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def fits(vector: Column, width: int | None = None) -> Column:
    """Whether a vector has finite components only, and as many as the code books (or any number that is not 0)."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    size = F.size(vector) == width if width else (F.size(vector) > 0) & (F.size(vector) % PARTS == 0)
    return F.coalesce(size & ~odd, F.lit(False))


def _first_books(rows: DataFrame, scale: int, entries: int) -> tuple[np.ndarray, int]:
    """(books[part, entry, component], length of a vector); at most `entries` rows come to the driver."""
    order = [F.col("id").asc_nulls_last(), "v"]
    one = rows.where(fits(F.col("v"))).orderBy(*order).limit(1).collect()
    if not one:
        return np.zeros((PARTS, 0, 0), dtype=np.int64), 0
    size = len(one[0]["v"])
    rows = rows.where(fits(F.col("v"), size)).select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))
    held = rows.orderBy(*order).limit(entries).collect()
    made = integers(np.array([r["v"] for r in held], dtype=np.float64), 1, bound(size // PARTS))
    return made.reshape(len(held), PARTS, -1).transpose(1, 0, 2).copy(), size


def _sums(rows: DataFrame, books: np.ndarray, size: int, scale: int) -> list:
    """(part, entry, n, pos, total) over all parts: what each entry's parts add up to."""
    width = size // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            every = _vectors(batch, 0, size)
            for k in range(0, len(every), ROWS):
                x = integers(every[k : k + ROWS], scale, bound(width))
                for p in range(PARTS):
                    own = x[:, p * width : (p + 1) * width]
                    index, _ = nearest(own, books[p])
                    order = np.argsort(index, kind="stable")
                    met, starts, times = np.unique(index[order], return_index=True, return_counts=True)
                    n[p, met] += times
                    total[p, met] += np.add.reduceat(own[order], starts, axis=0)
        part, entry = np.nonzero(n)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.array(list(total[part, entry]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    found = rows.select("v").mapInArrow(count, "part int, entry int, n long, total array<long>")
    found = found.select("part", "entry", "n", F.posexplode("total").alias("pos", "x"))
    return found.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("x")).collect()


def train(rows: DataFrame, scale: int = SCALE, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """(books[part, entry, component], length of a vector) after some rounds over all rows (id, v)."""
    books, size = _first_books(rows, scale, entries)
    for _ in range(rounds if size else 0):
        now = books.copy()
        for r in _sums(rows.where(fits(F.col("v"), size)), books, size, scale):
            now[r["part"], r["entry"], r["pos"]] = int(r["x"]) // r["n"]
        books = now
    return books, size


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray, size: int, scale: int = SCALE) -> DataFrame:
    """(id, label, code, error) of every row (id, v, label) that fits the books."""
    width, label_type = size // PARTS, rows.schema["label"].dataType

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _vectors(batch, 2, size)
            codes, errors = np.zeros((len(every), PARTS), dtype=np.uint8), np.zeros(len(every), dtype=np.int64)
            for k in range(0, len(every), ROWS):
                x = integers(every[k : k + ROWS], scale, bound(width))
                for p in range(PARTS):
                    index, least = nearest(x[:, p * width : (p + 1) * width], books[p])
                    codes[k : k + ROWS, p] = index
                    errors[k : k + ROWS] += least
            spelled = [c.tobytes().hex() for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spelled, pa.string()), pa.array(errors)], names=["id", "label", "code", "error"])

    return rows.where(fits(F.col("v"), size)).select("id", "label", "v").mapInArrow(code, f"id long, label {label_type.simpleString()}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray, scale: int = SCALE, code_col: str = "code", out: str = "vector") -> DataFrame:
    """codes with the vector that each code stands for: its entries one after the other, in units of 1 / scale from the middle of each step."""

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.frombuffer(bytes.fromhex("".join(batch.column(names.index(code_col)).to_pylist())), dtype=np.uint8).reshape(-1, PARTS)
            found = np.concatenate([books[p][at[:, p]] for p in range(PARTS)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list((found + 0.5) / scale), pa.list_(pa.float64()))], names=[*names, out])

    names = codes.columns
    return codes.mapInArrow(vectors, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in codes.schema) + f", `{out}` array<double>")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row that fits."""
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    books, size = train(held)
    if not size:
        return held.where("false").select(F.col("id").alias("vec_id"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = cut(encode(held, books, size))
    errors = cut(coded.groupBy(F.col("label").alias("__l")).agg(F.expr("try_sum(error)").alias("label_error")))
    met = coded.join(small(errors, broadcast_rows), F.col("label").eqNullSafe(F.col("__l")))
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    distance = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT r, p, e[p * len(e) // {PARTS} + 1 : (p + 1) * len(e) // {PARTS}] AS x FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, i, x AS c FROM parts JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, e) - 1 AS i FROM kept) USING (r) WHERE i < {ENTRIES})"""]  # fmt: skip
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min((d, i)) AS best FROM (SELECT r, parts.p, x, i, {distance} AS d FROM parts JOIN b{k} USING (p)) GROUP BY r, p)")
        if k < ROUNDS:
            steps.append(f"""m{k} AS MATERIALIZED (SELECT p, i, list(m ORDER BY pos) AS c FROM
  (SELECT p, best[2] AS i, pos, floor(sum(v)::HUGEINT / count(*))::BIGINT AS m FROM (SELECT p, best, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{k}) GROUP BY ALL) GROUP BY p, i),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.i, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.i = m.i)""")
    return (
        "WITH " + ",\n".join(steps) + f""",
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM b{ROUNDS}),
coded AS (SELECT r, string_agg(lpad(lower(hex(best[2])), 2, '0'), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (r), books
"""
    )


ORACLE_SQL = _oracle()
