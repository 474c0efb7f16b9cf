"""Every query that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from tarn.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_rows(name, spark, db, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    cur = db.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
