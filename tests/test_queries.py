"""Every query of the library against its SQL, where the driver's smallest tables are at hand."""

import math
import os

import duckdb
import pytest

from paraloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark labels".split()


def plain(rows):
    fixed = lambda x: ("nan" if math.isnan(x) else round(x, 6) + 0.0) if isinstance(x, float) else x
    return sorted((tuple(map(fixed, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("the driver's tables are not here")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    got, want = catalog.QUERIES[name](spark, FOLDER), db.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = plain(tuple(r[c] for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == plain(tuple(r[k] for k in at) for r in want.fetchall())


def test_no_column_of_an_answer_is_constant(spark):
    """A column with one value in all rows proves nothing about what decides it."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("the driver's tables are not here")
    db, found = duckdb.connect(), []
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    slow = {"j12_kmer_join", "j13_qgram_seed"}  # no flags, and slow in SQL
    for name in sorted(set(catalog.ORACLES) - slow):
        answer = db.sql(catalog.ORACLES[name])
        rows = answer.fetchall()
        found += [(name, c) for k, c in enumerate(answer.columns) if len(rows) > 1 and len({str(r[k]) for r in rows}) == 1]
    assert found == []


def test_halves_round_to_even_as_in_sql(spark, tmp_path):
    """Balances of n + 0.5 decide a copy number at some keys; SQL's cast takes the even neighbour."""
    db = duckdb.connect()
    db.execute("CREATE VIEW supplier AS SELECT i AS s_suppkey, (i // 40 - 30) + 0.5 AS s_acctbal FROM range(2400) t(i)")
    db.execute("CREATE VIEW lineitem AS SELECT i % 2400 AS l_suppkey, 1.0 AS l_tax, 1.0 AS l_discount, 30.0 AS l_quantity, 'A' AS l_returnflag, 'F' AS l_linestatus FROM range(4800) t(i)")
    for name in ("supplier", "lineitem"):
        db.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    want = db.sql(catalog.ORACLES["d10_switch_938"])
    got = catalog.QUERIES["d10_switch_938"](spark, str(tmp_path)).collect()
    assert plain(tuple(r[c] for c in want.columns) for r in got) == plain(want.fetchall())
    assert len({r["copies"] for r in got}) > 2
