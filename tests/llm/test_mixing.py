import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandweave.llm import mixing
from strandweave.runtime import Workspace

SCHEMA = "doc_id long, text string, source string, size long, key string"


def waterfill(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(w[s] for s in open_)
        for s in open_:
            target[s] += left * w[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for _, t, s in docs:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = waterfill(sizes)
    source = {i: s for i, _, s in docs}
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _, _ in docs)
    taken, least = Counter(), {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        least[s] = max(least.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(least[s], 1)
    return taken, target


def run(spark, docs):
    return mixing.digest(mixing.mix(spark.createDataFrame([(*d, 1, "k") for d in docs], SCHEMA))).collect()


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    rows = mixing.digest(mixing.mix(df)).collect()
    check(rows, docs)
    again = mixing.digest(mixing.mix(df.repartition(5))).collect()
    assert sorted(rows) == sorted(again)


@pytest.mark.xfail(reason="measured 0.023: sources of ten long documents can't be filled closely with whole ones", strict=False)
def test_total_of_small_sources(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    taken, target = check(mixing.digest(mixing.mix(df)).collect(), [tuple(r) for r in df.select("doc_id", "text", "source").collect()])
    assert abs(sum(taken.values()) - sum(target.values())) < 0.02 * sum(target.values())


def test_awkward_rows(spark):
    docs = [(k, "w " * (k % 7), "b") for k in range(40)] + [(100 + k, "w " * 30, "a") for k in range(3)] + [(200, None, None), (201, "x y", None), (202, "", "empty"), (203, None, "empty"), (204, "t " * 3, "É"), (204, "t " * 3, "É"), (None, "q q", "b")]
    check(run(spark, docs), docs)
    assert run(spark, []) == []


def test_one_source_takes_all_once(spark):
    docs = [(k, "w " * (k + 1), "only") for k in range(10)]
    assert {r.doc_id: r.taken for r in run(spark, docs)} == {k: k + 1 for k in range(10)}


def test_rows_of_the_mixture_agree_with_what_is_taken(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = {r.doc_id: (r.size, r.taken) for r in mixing.digest(mixing.mix(df)).collect()}
    rows = Counter(r.doc_id for r in mixing.mixed_rows(df).select("doc_id").collect())
    assert all(rows[i] * size == taken for i, (size, taken) in said.items() if size)


def test_shards_are_partitions_in_a_permuted_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mixed_rows(df, 4).select("doc_id", F.spark_partition_id().alias("p")).collect()
    held = defaultdict(list)
    for r in mixed:
        held[r.p].append(r.doc_id)
    want = Counter((s, r.doc_id) for r in mixing.digest(mixing.mix(df, 4)).collect() for s in r.shards)
    assert Counter((p, i) for p, ids in held.items() for i in ids) == want and len(held) == 4
    assert all(ids != sorted(ids) for ids in held.values())
    again = [(r.p, r.doc_id) for r in mixing.mixed_rows(df.repartition(3), 4).select("doc_id", F.spark_partition_id().alias("p")).collect()]
    assert sorted(again) == sorted((r.p, r.doc_id) for r in mixed)


def test_mixture_whatever_the_columns(spark):
    names = ["doc_id", "text", "source", "row", "draws", "shard", "place", "own", "id", "KEY", "a.b", "m"]
    kinds = "doc_id long, text string, source string, row int, draws int, shard int, place int, own int, id int, KEY string, `a.b` int, m map<string,int>"
    rows = [(i, t, s, *range(6), "k", 7, {"z": 1, "y": i or 0}) for i, t, s in [(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "x y z", None), (3, "q", "s")]]
    df = spark.createDataFrame(rows, kinds)
    out = mixing.mixed_rows(df)
    assert out.columns == names
    said = Counter()
    for r in mixing.digest(mixing.mix(df)).collect():
        said[r.doc_id] += r.taken
    got = Counter()
    for r in out.collect():
        got[r.doc_id] += len(r.text.split()) if r.text else 0
    assert +got == +said
    assert mixing.mixed_rows(df.where("false")).collect() == []


def test_taken_words_against_brute_force(spark):
    """What is taken of each source, from the rules alone: whole passes, then whole blocks and documents that fit the rest."""
    rng = random.Random(3)
    docs = [(i, "w " * rng.randint(0, 30), s) for s, n in (("a", 500), ("b", 900), ("c", 80), (None, 300)) for i in range(10_000 * (len(s or "zz")) + n, 10_000 * (len(s or "zz")) + 2 * n)]
    docs = [(k, t, s) for k, (_, t, s) in enumerate(docs)]
    rows = run(spark, docs)
    source = {i: s for i, _, s in docs}
    taken, target = check(rows, docs)
    for s in ("a", "b", "c", None):
        own = [r for r in rows if source[r.doc_id] == s and r.size]
        passes = int(target[s] // own[0].source_size)
        times = Counter(r.taken // r.size for r in own)
        assert set(times) <= {passes, passes + 1}
        left = target[s] - passes * own[0].source_size
        assert sum(r.size for r in own if r.taken // r.size == passes + 1) == taken[s] - passes * own[0].source_size <= left
        out = [r.size for r in own if r.taken // r.size == passes]
        assert left - (taken[s] - passes * own[0].source_size) < max(out, default=1)


def test_tree_keeps_quotas_and_halves(spark):
    quotas = {"a": 1000, "b": 37, "c": 5, "d": 1, "e": 300}
    rows = mixing.splitting_tree(spark.createDataFrame(list(quotas.items()), "key string, quota long"), 8).collect()
    per_key, per_shard = defaultdict(list), Counter()
    for r in rows:
        per_key[r.key].append((r.lo, r.hi))
        per_shard[r.shard] += r.hi - r.lo
    for k, q in quotas.items():
        spans = sorted(per_key[k])
        assert spans[0][0] == 0 and spans[-1][1] == q and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_hypergeometric_draws(spark):
    u = (F.col("id") + 0.5) / 2000.0
    x = mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), u)
    got = spark.range(2000).select(x.alias("x")).groupBy("x").count().collect()
    from math import comb

    p = {k: comb(20, k) * comb(30, 10 - k) / comb(50, 10) for k in range(11)}
    assert all(abs(r["count"] / 2000 - p[r.x]) < 0.002 for r in got)
    edge = spark.range(1).select(*(mixing.hypergeometric(F.lit(a), F.lit(b), F.lit(c), F.lit(0.99999)) for a, b, c in ((0, 0, 0), (5, 5, 3), (5, 0, 3), (1, 1, 1)))).first()
    assert tuple(edge) == (0, 3, 0, 1)
