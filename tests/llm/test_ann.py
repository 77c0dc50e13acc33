import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandweave.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, part int, class string"


def brute(rows, k=10):
    ok = {i: np.array(v, np.float64) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    length = max((len(v) for v in ok.values()), key=lambda n: sum(len(v) == n for v in ok.values()), default=0)
    ok = {i: v for i, v in ok.items() if len(v) == length}
    return {q: sorted((float(np.sqrt(((ok[q] - v) ** 2).sum())), i) for i, v in ok.items() if i != q)[:k] for q in ok if q % 100 == 0}


def shares(found, want):
    """The share of true neighbours found."""
    got: dict = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    assert set(got) == set(want)
    for q in want:
        assert sorted(got[q]) == list(range(1, 11))
        listed = [got[q][k] for k in range(1, 11)]
        assert listed == sorted(listed)
    return sum(len({i for _, i in got[q].values()} & {i for _, i in near}) for q, near in want.items()) / (10 * len(want))


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    assert shares(ann.search(df, F.col("vec_id") % 100 == 0), brute([tuple(r) for r in df.collect()])) >= 0.9


def test_recall_where_few_parts_are_searched(spark):
    """50,000 vectors without clusters are the hardest case for parts."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50_000, 24)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 24).cast(pa.list_(pa.float32()))}))
    index, _ = ann.build(df)
    assert index.parts == 512 and index.probes <= index.parts // 4
    y, want = x.astype(np.float64), {}
    for q in range(0, len(x), 100):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        want[q] = [(d[i], i) for i in np.argsort(d, kind="stable")[:10].tolist()]
    assert shares(ann.search(df, F.col("vec_id") % 100 == 0), want) >= 0.9


def test_queries_in_several_blocks(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect())
    monkeypatch.setattr(ann, "BLOCK", 30)
    monkeypatch.setattr(ann, "PENDING", 50)
    assert sorted(tuple(r) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()) == want


def test_copies_and_awkward_rows_are_exact(spark):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 1) for _ in range(4)], 0, 0, "x") for k in range(1, 60)]
    rows += [(100 + k, [1.0, 0.0, 0.0, 0.0], 0, 0, "x") for k in range(40)] + [(300, [1.0, -0.0, 0.0, 0.0], 0, 0, "x"), (200, [0.0] * 4, 0, 0, "x"), (400, None, 0, 0, "x"), (500, [1.0, None, 0.0, 0.0], 0, 0, "x"), (600, [math.nan, 0.0, 0.0, 1.0], 0, 0, "x"), (700, [math.inf, 0.0, 0.0, 1.0], 0, 0, "x"), (800, [1.0, 2.0], 0, 0, "x"), (None, [1.0] * 4, 0, 0, "x"), (5, rows[4][1], 0, 0, "x")]
    want = brute(rows)
    got: dict = {}
    for r in ann.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(got) == {100, 300} == set(want)
    for q in want:
        assert [i for _, _, i in sorted(got[q])] == [i for _, i in want[q]]
        assert np.allclose([s for _, s, _ in sorted(got[q])], [s for s, _ in want[q]], rtol=0, atol=0)


def test_few_and_none(spark):
    q = F.col("vec_id") % 100 == 0
    assert ann.search(spark.createDataFrame([], SCHEMA), q).collect() == []
    assert [tuple(r) for r in ann.search(spark.createDataFrame([(0, [1.0, 0.0], 0, 0, "x"), (1, [0.0, 0.0], 0, 0, "x"), (2, [1.0, 2.0], 0, 0, "x")], SCHEMA), q).collect()] == [(0, 1, 2, 2.0)]


def test_partitions_are_balanced():
    x = np.random.default_rng(1).normal(size=(1000, 8)).astype(np.float32)
    n = np.bincount(ann.partition(x, 8))
    assert len(n) == 8 and n.max() <= 138


def test_parts_grow_with_the_table():
    assert [ann.parts_for(n) for n in (1, 50, 500, 2000, 50_000, 10**6, 10**9)] == [1, 8, 32, 64, 512, 2048, 2048]
