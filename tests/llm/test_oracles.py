"""Every operator that has SQL against it on the smallest tables."""

import duckdb
import pytest

from strandweave.llm import catalog

TABLES = "documents conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    r = c.execute(catalog.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    assert sorted((tuple(x[names.index(k)] for k in cols) for x in r.fetchall()), key=str) == sorted((tuple(x[k] for k in cols) for x in df.collect()), key=str)
