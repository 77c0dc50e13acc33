import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandweave.operators import dictionary, selection, stored
from strandweave.params import SampleParams
from strandweave.runtime import Workspace

P = SampleParams(k=5, w=10)


def texts(n, seed=1):
    rng = random.Random(seed)
    base = "".join(rng.choice("acgt") for _ in range(900))
    out = []
    for k in range(n):
        a = rng.randrange(600)
        t = base[a : a + 300]
        out.append(t if k % 2 else t[::-1].translate(str.maketrans("acgt", "tgca")))
    return [*out, "", "acg", "a" * 200, base[:150] + "a" * 80 + base[150:300]]


def seqs(spark, found, first=0):
    return spark.createDataFrame([(first + k, 1 + k % 3, t) for k, t in enumerate(found)], "seq_ord long, file int, seq string")


def test_an_index_comes_back_as_it_was(spark, tmp_path):
    ws, found = Workspace(spark, "stored"), texts(12)
    made = stored.build(ws, seqs(spark, found), P)
    stored.save_index(made, f"{tmp_path}/a", command="first")
    back = stored.load_index(spark, f"{tmp_path}/a", P)
    assert set(back.tables) == set(stored.TABLES)
    for name, table in made.tables.items():
        assert sorted(map(str, table.select(*back.tables[name].columns).collect())) == sorted(map(str, back.tables[name].collect()))
    assert {r.path_id: r.seq for r in stored.sequences_of(back).collect()} == dict(enumerate(found))
    assert stored.check_index(back).collect() == []
    with pytest.raises(ValueError):
        stored.load_index(spark, f"{tmp_path}/a", SampleParams())
    with pytest.raises(AttributeError):
        back.nothing


def test_a_dictionary_goes_on(spark, tmp_path):
    ws, old, new = Workspace(spark, "stored"), texts(6), texts(6, seed=2) + texts(4)
    stored.save_index(stored.build(ws, seqs(spark, old), P, ends=False, index=False), f"{tmp_path}/a", command="first")
    first = stored.load_index(spark, f"{tmp_path}/a")
    more = stored.build(ws, seqs(spark, new, 1000), P, known=first)
    stored.save_index(more, f"{tmp_path}/b", command="second")
    both = stored.load_index(spark, f"{tmp_path}/b")
    assert [p["command"] for p in both.provenance] == ["first", "second"] and {"path": f"{tmp_path}/a"} in both.references
    before, after = ({r.canon: r for r in x.nodes.collect()} for x in (first, both))
    whole = stored.build(ws, seqs(spark, old).union(seqs(spark, new, 1000)), P, ends=False, index=False)
    counts = {r.canon: r["count"] for r in whole.nodes.collect()}
    assert {c: r["count"] for c, r in after.items()} == counts
    assert all(after[c].node == r.node and after[c].loc == r.loc and after[c].max_count >= r.max_count for c, r in before.items())
    assert sorted(r.node for r in after.values()) == list(range(3, 3 + len(after))) and len(after) > len(before)
    assert {r.path_id: r.seq for r in stored.sequences_of(both).collect()} == {1000 + k: t for k, t in enumerate(new)}
    assert stored.check_index(both).collect() == []


def test_violations_are_found(spark):
    ws = Workspace(spark, "stored")
    good = stored.build(ws, seqs(spark, texts(6)), P)
    spoiled = {
        "visits": good.visits.where("NOT (path_id = 1 AND idx = 2)"),
        "nodes": good.nodes.where("node <> 5"),
        "edges": good.edges.withColumn("count", F.col("count") + F.when(F.col("adj") > 0, 1).otherwise(0)),
        "runs": good.runs.withColumn("run_no", F.col("run_no") + 1),
        "ends": good.ends.withColumn("prefix", F.concat(F.lit("a"), "prefix")),
    }
    for name, table in spoiled.items():
        assert not stored.check_index(stored.Index(P, good.tables | {name: table})).isEmpty(), name


def test_no_node_is_lost_to_large_numbers_of_sequences(spark):
    rng = random.Random(4)
    text = "".join(rng.choice("acgt") for _ in range(1200))
    for first in (0, (1 << 31) + 5, 1 << 40, 1 << 62):
        df = spark.createDataFrame([(first, 1, text, 0)], "seq_ord long, file int, seq string, start long")
        ws = Workspace(spark, "large")
        occurrences = ws.put(selection.syncmers(df, P), "occurrences")
        nodes = dictionary.build(ws, occurrences, df).collect()
        assert len(nodes) == occurrences.where("NOT poly").select("canon").distinct().count() > 60
        assert {r.first_seq for r in nodes} == {first} and [r.loc for r in sorted(nodes)] == sorted(r.first_pos for r in nodes)


def test_long_paths_come_in_stretches(spark):
    from strandweave.operators import pathing

    ws, found = Workspace(spark, "stretches"), texts(4)
    made = stored.build(ws, seqs(spark, found), P, index=False)
    rows = pathing.stretches(made.visits, made.nodes, made.ends, P, width=64).orderBy("path_id", "stretch").collect()
    assert max(len(r.seq) for r in rows) < 64 * 6 and len(rows) > len(found)
    for k, t in enumerate(found):
        own = [r for r in rows if r.path_id == k]
        assert "".join(r.seq for r in own) == t and [r.at for r in own] == [sum(len(x.seq) for x in own[:i]) for i in range(len(own))]


@pytest.mark.parametrize("only", [("nodes",), ("edges",), ("starts",), ("sequences",), ("nodes", "visits", "ends")])
def test_some_tables_come_without_the_others(spark, tmp_path, only):
    found = texts(5)
    whole = stored.build(Workspace(spark, "stored"), seqs(spark, found), P)
    ws = Workspace(spark, "stored")
    part = stored.build(ws, seqs(spark, found), P, only=only)
    stored.save_index(part, f"{tmp_path}/a")
    back = stored.load_index(spark, f"{tmp_path}/a", P)
    assert set(back.tables) == set(only)
    for name in only:
        assert sorted(map(str, whole.tables[name].collect())) == sorted(map(str, back.tables[name].select(*whole.tables[name].columns).collect()))
    assert not [x.name for x in Path(ws.path.removeprefix("file:")).iterdir() if x.name.endswith("-ranks")]


def test_bases_of_texts_are_found_as_by_the_column_function(spark):
    from strandweave.functions import dna

    found = ["ACGTNnacgt", "", None, "größe \u0000 cat\nTAG é𝒳n", "xyz"]
    df = spark.createDataFrame([(k, "s", t) for k, t in enumerate(found)], "seq_ord long, source string, text string")
    want = df.select("seq_ord", dna.clean(F.col("text")).alias("seq")).collect()
    got = selection.clean(df).collect()
    assert {r.seq_ord: r.seq for r in want} == {r.seq_ord: r.seq for r in got}
    assert {r.seq_ord: r.len for r in got} == {r.seq_ord: None if r.seq is None else len(r.seq) for r in want}
