"""Queries against their SQL on planted tables."""

import duckdb
import numpy as np

from paraloom.llm import embedding_dedup, line_dedup, url_filter


def same(spark, folder, query, sql, tables):
    db = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got, want = query(spark, str(folder)), db.sql(sql)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
    return rows


def test_embeddings(spark, tmp_path):
    r = np.random.default_rng(5)
    base = r.normal(size=(15, 8))
    rows = [(k * 4 + j, (v + r.normal(size=8) * s).astype(np.float32).tolist(), k % 2) for k, v in enumerate(base) for j, s in enumerate((0.0, 0.0, 0.15, 0.4))]
    rows += [(100, None, 1), (101, [0.0] * 8, 1), (102, [float("nan")] * 8, 1), (None, base[0].tolist(), 0), (103, base[0].tolist(), None)]
    out = same(spark, tmp_path, embedding_dedup.query, embedding_dedup.ORACLE_SQL, {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")})
    assert sum(x[2] for x in out) > 20


def test_urls(spark, tmp_path):
    urls = [None, "x", "http://u@bad.co.uk:80/en/1"] + [f"http://bad.co.uk/en/{k}" for k in range(60)] + [f"http://h{k % 5}.net/fr/{k + 100}?q" for k in range(80)] + [f"https://a.example.org/es/{k}" for k in range(5)] + ["http://q.com/de/7.html", "http://1.2.3.4/77"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 60), k % 7 == 3) for k in range(180)], "doc_id long, quality int, toxic boolean").selectExpr("doc_id", "quality", "int(toxic) as toxic")
    out = same(spark, tmp_path, url_filter.query, url_filter.ORACLE_SQL, {"pages": pages, "labels": labels})
    assert {x[-1] for x in out if x[0] == "bad.co.uk"} == {"block"}


def test_lines(spark, tmp_path):
    line = "This line is long enough to count and stands in many"
    rows = [(k if k != 4 else None, f"{line.upper() if k % 2 else line} \nown {k}\n{line}", 0) for k in range(9)] + [(20, None, 0), (21, "", 0), (7, "other text", 0)]
    out = same(spark, tmp_path, line_dedup.query, line_dedup.ORACLE_SQL, {"documents": spark.createDataFrame(rows, "doc_id long, text string, n_chars int")})
    assert sum(x[2] for x in out) == 16
