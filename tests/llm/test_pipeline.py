import zlib
from collections import Counter

import numpy as np
import pytest

from strandweave.llm import decontaminate, toxicity

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = docs.collect()
        if name != names[-1]:
            assert docs.columns == columns
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = toxicity.train(first, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in first.collect() if chain.predict(toxicity.present(r.text))[-1] < toxicity.REJECT}
    items = [set(decontaminate.segments(decontaminate.reduce(r.text))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = [decontaminate.reduce(r.text) for r in kept["decontamination"]]
    assert not any(s in t for t in clean for x in items for s in x)
    ids = {n: Counter(r.doc_id for r in rows) for n, rows in kept.items()}
    assert max(ids["near_dedup"].values()) == 1
    assert set(ids["mixing"]) <= set(ids["decontamination"]) <= set(ids["near_dedup"]) <= set(ids["toxicity"])
    assert ids["token_output"] == ids["mixing"] and max(ids["mixing"].values()) <= 3

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in kept["mixing"]}
    at = 0
    for r in sorted(kept["token_output"], key=lambda r: r.start):
        own = [*t.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(np.array(own, "<u4").tobytes()))
        at += r.n_tokens


def test_run_equals_the_stages(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
    assert rows.count() > 50


def awkward(spark, folder, docs, items):
    kinds = "doc_id long, text string, lang string, source string, n_chars long, gone string, shard int, place int, `row` int, _slot int, `a.b` map<string,int>"
    spark.createDataFrame([(*d, "en", "s", len(d[1] or ""), "g", 1, 2, 3, 4, {"k": 1}) if len(d) == 2 else (d[0], d[1], None, d[2], 0, None, None, None, None, None, None) for d in docs], kinds).write.parquet(f"{folder}/documents.parquet")
    labels = [(k, 1, int(k % 3 == 0)) for k in range(40)] + [(None, 1, 1), (900, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_awkward_rows_pass_all_stages(spark, tmp_path):
    good = lambda k: f"a lovely day number {k} for a walk by the river with friends and cake {k * 7}"
    item = "what colour is the lovely sky above the quiet hills at noon in the early spring of the year"
    docs = [(k, f"you are an awful idiot and scum of kind {k}" if k % 3 == 0 else good(k)) for k in range(40)]
    clean = [(100, None), (101, ""), (102, " \t"), (None, good(500)), (None, None), (103, good(1) + " more"), (104, good(600)), (104, good(600)), (105, "w " * 100_000), (106, good(700), None), (107, None, None)]
    docs += [*clean, (200, f"It was asked: {item}! So."), (201, good(1)), (202, good(1).upper())]
    folder = awkward(spark, tmp_path / "t", docs, [(1, item), (2, None), (3, ""), (None, "?!"), (4, item)])
    frame, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        if name != "token_output":
            assert frame.columns == columns
        frame.write.parquet(f"{folder}/{name}")
        frame = spark.read.parquet(f"{folder}/{name}")
        kept[name] = sorted((r.doc_id for r in frame.collect()), key=str)
    toxic = set(range(0, 40, 3))
    first = [d[0] for d in docs if d[0] not in toxic]
    assert kept["toxicity"] == sorted(first, key=str)
    # 103 shares 18 of 22 shingles with 1, 104 is there twice, 201 and 202 are copies of 1.
    second = [i for i in first if i not in (103, 104, 201, 202)] + [104]
    assert kept["near_dedup"] == sorted(second, key=str)
    third = [i for i in second if i != 200]
    assert kept["decontamination"] == sorted(third, key=str)
    words = Counter(i for i in kept["mixing"])
    assert set(words) <= set(third) and max(n / third.count(i) for i, n in words.items()) <= 3
    assert kept["token_output"] == kept["mixing"]


def test_empty_tables_stay_empty(spark, tmp_path):
    folder = awkward(spark, tmp_path / "t", [], [])
    assert corpus_pipeline.run(spark, folder).collect() == []
