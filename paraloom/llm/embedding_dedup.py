"""Embedding near-dedup: int8 tile products with error bounds for each vector, full precision only where a pair may be over the threshold.

Equal vectors of a label are merged into one class first, and each class is quantised once: a unit vector u becomes s * q with q in
-127..127 and e = |u - s q|. The classes of a label are dealt into blocks by hash, and each pair of blocks
is one tile: a task sees the codes of two blocks and no more, whatever the label's size. Since |u.w - s_u s_w q_u.q_w| <= e_u + (1 + e_u) e_w, pairs
that are over or under the threshold by more than that are settled by integer products (exact in single precision for up to 1040 dimensions, in double beyond); only
those between are looked up in full and computed in double precision. A tile returns link counts for each class, a spanning forest of its settled links and
the pairs that are left, never all its pairs.

Defined cases: null, zero, null-holding and non-finite vectors, rows with a null label and rows with a null id link with nothing (n_links 0,
component_id their own id, kept; a null id gives a null component); vectors of different lengths do not link; a repeated row is a vector
of its own; no rows give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paraloom.llm.common import cut, read_table
from paraloom.llm.components import components
from paraloom.llm.simhash import forest

COSINE = 0.93
BLOCK = 1024
#: Pairs that are computed in full at once.
EXACT = 1 << 14
#: What rounding in double precision may add to the bounds.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e): int8 codes, their scale, and an upper bound of |u - s q|."""
    scale = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    error = np.sqrt(((units - scale[:, None] * codes) ** 2).sum(axis=1))
    return codes, scale, error * (1 + SLACK) + SLACK


def tile_links(left: tuple, right: tuple, threshold: float, same: bool, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, sure): pairs of two blocks of (codes, scales, errors) that are over the threshold, or may be; within one block i < j."""
    (qa, sa, ea), (qb, sb, eb) = left, right
    kind = np.float32 if qa.shape[1] <= 1040 else np.float64
    turned, found = qb.astype(kind).T, []
    for k in range(0, len(qa), rows):
        near = (qa[k : k + rows].astype(kind) @ turned).astype(np.float64) * (sa[k : k + rows, None] * sb)
        bound = ea[k : k + rows, None] + (1 + ea[k : k + rows, None]) * eb
        i, j = np.nonzero(near + bound >= threshold - SLACK)
        sure = near[i, j] - bound[i, j] >= threshold + SLACK
        i += k
        some = i < j if same else np.ones(len(i), dtype=bool)
        found.append((i[some], j[some], sure[some]))
    return tuple(np.concatenate([x[k] for x in found] or [np.zeros(0, int)]) for k in range(3))


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    with np.errstate(all="ignore"):
        exact = (left * right).sum(axis=1) / (np.sqrt((left**2).sum(axis=1)) * np.sqrt((right**2).sum(axis=1)))
    odd = ~np.isfinite(exact) | (exact == 0)
    if odd.any():
        exact[odd] = (unit(left[odd]) * unit(right[odd])).sum(axis=1)
    return exact


def _codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in frames:
        for _, same in x.groupby(x["v"].map(len)):
            q, s, e = quantise(unit(np.array(same["v"].tolist(), dtype=np.float64)))
            yield same.drop(columns="v").assign(q=[row.tobytes() for row in q], s=s, e=e)


def dedup(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    vec = F.col("v")
    held = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & vec.isNotNull() & ~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0)
    held = held.withColumn("fit", F.coalesce(fit, F.lit(False)))
    # a copy of a vector is no link to compute: one class holds all of them
    classes = held.where("fit").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()).withColumn("dim", F.size("v")))
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    label_type = classes.schema["label"].dataType.simpleString()
    codes = classes.select("class", "label", "dim", "copies", "v").mapInPandas(_codes, f"class long, label {label_type}, dim int, copies long, q binary, s double, e double")
    dealt = cut(codes).join(sizes, ["label", "dim"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "label", "dim", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"), "own", "class", "copies", "q", "s", "e"
    )

    def sides(x: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, bool]:
        """Places of the tile's two blocks, and whether they are one."""
        ti, tj = int(x["ti"].iloc[0]), int(x["tj"].iloc[0])
        first = np.flatnonzero(x["own"].to_numpy() == ti)
        return first, first if ti == tj else np.flatnonzero(x["own"].to_numpy() == tj), ti == tj

    def told(x: pd.DataFrame, i: np.ndarray, j: np.ndarray, open_: np.ndarray) -> pd.DataFrame:
        """What a tile tells: a spanning forest of its links (a, b), links of each class (a), and classes (a) of block b with pairs that are still open."""
        cls, copies = x["class"].to_numpy(np.int64), x["copies"].to_numpy(np.int64)
        links = np.zeros(len(x), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        edges = np.array(forest(len(x), i, j), dtype=np.int64).reshape(-1, 2)
        some = np.flatnonzero(links)
        columns = {
            "a": [cls[edges[:, 0]], cls[some], cls[open_]], "b": [cls[edges[:, 1]], np.full(len(some), -1), x["own"].to_numpy(np.int64)[open_]],
            "links": [np.zeros(len(edges), np.int64), links[some], np.full(len(open_), -1)],
        }
        key = {k: [x[k].iloc[0]] * (len(edges) + len(some) + len(open_)) for k in tile}
        return pd.DataFrame(key | {k: np.concatenate(v) for k, v in columns.items()})

    def link(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("class")
        left, right, same = sides(x)
        q, s, e = np.frombuffer(b"".join(x["q"]), np.int8).reshape(len(x), -1), x["s"].to_numpy(), x["e"].to_numpy()
        i, j, sure = tile_links((q[left], s[left], e[left]), (q[right], s[right], e[right]), threshold, same)
        i, j = left[i], right[j]
        return told(x, i[sure], j[sure], np.union1d(i[~sure], j[~sure]))

    def settle(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("class")
        left, right, same = sides(x)
        v = np.array(x["v"].tolist(), dtype=np.float64)
        q, s, e = quantise(unit(v))
        i, j, sure = tile_links((q[left], s[left], e[left]), (q[right], s[right], e[right]), threshold, same)
        i, j = left[i[~sure]], right[j[~sure]]  # the others are told
        over = [cosines(v[i[k : k + EXACT]], v[j[k : k + EXACT]]) >= threshold for k in range(0, len(i), EXACT)]
        over = np.concatenate([np.zeros(0, dtype=bool), *over])
        return told(x, i[over], j[over], np.zeros(0, dtype=np.int64))

    tile = ["label", "dim", "ti", "tj"]
    schema = f"label {label_type}, dim int, ti long, tj long, a long, b long, links long"
    found = cut(tiles.groupBy(*tile).applyInPandas(link, schema))
    # the full vectors of a tile's open classes meet once; pairs never leave their tile
    open_ = found.where("links = -1").select(*tile, F.col("a").alias("class"), F.col("b").alias("own")).join(classes.select("class", "copies", "v"), "class")
    settled = cut(open_.groupBy(*tile).applyInPandas(settle, schema))
    told_all = found.where("links >= 0").unionByName(settled)
    links = told_all.where("b < 0").select(F.col("a").alias("class"), "links").groupBy("class").agg(F.sum("links").alias("other_links"))
    edges = told_all.where("b >= 0").select("a", "b")
    groups = components(edges)
    named = classes.select("class", "first", "copies", "label", "v").join(groups, F.col("class") == F.col("node"), "left").withColumn("group", F.coalesce("component", "class"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"))
    named = named.join(least, "group").join(links, "class", "left")
    named = named.select("label", "v", F.lit(True).alias("fit"), "component_id", (F.coalesce("other_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = held.join(named, ["fit", "label", "v"], "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read_table(spark, sf_dir, "embeddings"))


_DOT = "list_sum(list_transform(list_zip({0}.e, {1}.e), lambda z: z[1] * z[2]))"
ORACLE_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE {_DOT.format("a", "b")} / (sqrt({_DOT.format("a", "a")}) * sqrt({_DOT.format("b", "b")})) >= {COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM ok UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.r = v.r) AS n_links, coalesce(c, v.vec_id) AS component_id, v.vec_id IS NOT DISTINCT FROM coalesce(c, v.vec_id) AS kept FROM v LEFT JOIN least ON v.vec_id = least.a
"""
