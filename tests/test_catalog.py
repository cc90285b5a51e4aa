"""Every query against its SQL."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from plumbline.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, list | tuple) else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, con, name):
    df, rel = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
