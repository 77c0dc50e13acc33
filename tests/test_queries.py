"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from strandweave import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = c.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted((tuple(norm(x[names.index(k)]) for k in cols) for x in r.fetchall()), key=str) == got


def test_entry(spark):
    assert entry.entry(spark).count() == 100
    assert set(entry.oracle_sql()) <= set(entry.queries())
