import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import arrays, dna, files
from strandweave.operators import dictionary, mapping, pathindex, typing31
from strandweave.params import SampleParams
from strandweave.runtime import Workspace


def visits(spark, seed=1, n=30, nodes=6):
    rng, rows = random.Random(seed), []
    for p in range(n):
        pos = 0
        for i in range(rng.randint(1, 14)):
            rows.append((p, i, rng.choice([-1, 1]) * rng.randint(1, nodes), pos))
            pos += rng.randint(1, 2)
    return spark.createDataFrame(rows, "path_id long, idx long, node long, pos long")


def test_ranges_narrow_as_chains_grow(spark):
    ws = Workspace(spark, "narrow")
    ordered = ws.put(pathindex.visit_order(ws, visits(spark)), "ordered")
    runs = ws.put(pathindex.runs(pathindex.successors(ordered)), "runs")
    rows = sorted(ordered.collect(), key=lambda r: (r.path_id, r.strand, r.idx))
    rng, chains = random.Random(2), []
    for k in range(40):
        length = rng.randint(1, 4)
        at = rng.randrange(len(rows) - length)
        chains.append((k, [(r.node, r.gap) for r in rows[at : at + length]]))
    chains.append((99, [(1, 0), (1, 77)]))
    asked = spark.createDataFrame(chains, "id int, chain array<struct<node:long,gap:long>>")
    got = {r.id: (r.node, r.low, r.high, r["count"]) for r in pathindex.narrow_chain(ws, runs, asked).collect()}
    for k, chain in chains:
        # Visits at which the chain ends, by brute force.
        ends = [rows[i].place for i in range(len(chain) - 1, len(rows)) if all((rows[i - b].path_id, rows[i - b].strand) == (rows[i].path_id, rows[i].strand) and rows[i - b].node == n and (b == len(chain) - 1 or rows[i - b].gap == g) for b, (n, g) in enumerate(reversed(chain)))]
        assert got.get(k) == ((chain[-1][0], min(ends), max(ends) + 1, len(ends)) if ends else None)


def test_insert_moves_what_is_behind(spark):
    lists = spark.createDataFrame([(1, 0, 5, 1), (1, 1, 6, 1), (2, 0, 7, 1)], "node long, place long, next_node long, next_gap long")
    added = spark.createDataFrame([(1, 1, 9, 2), (1, 1, 8, 2), (1, 50, 4, 1), (3, 0, 1, 1)], "node long, place long, next_node long, next_gap long")
    got = sorted(tuple(r) for r in pathindex.insert(lists, added).collect())
    assert got == [(1, 0, 5, 1), (1, 1, 8, 2), (1, 2, 9, 2), (1, 3, 6, 1), (1, 4, 4, 1), (2, 0, 7, 1), (3, 0, 1, 1)]


def test_ordered_arrays(spark):
    df = spark.createDataFrame([([1, 3, 3, 7], v) for v in (0, 1, 2, 3, 7, 9)] + [([], 4)], "a array<int>, v int")
    a, v = F.col("a"), F.col("v")
    rows = df.select("a", "v", arrays.find(a, v).alias("at"), arrays.holds(a, v).alias("there"), arrays.insert(a, v).alias("more"), arrays.remove(a, v).alias("less"), arrays.compress(a).alias("once"), arrays.extend(a, F.lit(5), F.lit(0)).alias("wide")).collect()
    from bisect import bisect_left

    for r in rows:
        assert r.at == bisect_left(r.a, r.v) and r.there == (r.v in r.a)
        assert r.more == (r.a if r.v in r.a else sorted([*r.a, r.v]))
        less = list(r.a)
        if r.v in less:
            less.remove(r.v)
        assert r.less == less and r.once == sorted(set(r.a)) and r.wide == r.a + [0] * (5 - len(r.a))


def test_index_grows_and_shrinks(spark):
    ws = Workspace(spark, "index")
    index = dictionary.dense_index(ws, spark.createDataFrame([("b",), ("d",), ("a",), (None,)], "x string"), "x")
    more = dictionary.index_with(ws, index, spark.createDataFrame([("c",), ("a",), ("e",)], "value string"))
    assert {r.value: r["index"] for r in more.collect()} == {"a": 0, "b": 1, "d": 2, "c": 3, "e": 4}
    less = dictionary.index_without(ws, more, spark.createDataFrame([("b",), ("zz",)], "value string"))
    assert {r.value: r["index"] for r in less.collect()} == {"a": 0, "d": 1, "c": 2, "e": 3}


def test_letters_and_runs(spark):
    df = spark.createDataFrame([("acNNgtn",), ("",), ("nnnn",), ("acgt",)], "s string")
    bases, runs = dna.with_runs(F.col("s"))
    got = [(r.b, [tuple(x) for x in r.r]) for r in df.select(bases.alias("b"), runs.alias("r")).collect()]
    assert got == [("acaagta", [(2, 4), (6, 7)]), ("", []), ("aaaa", [(0, 4)]), ("acgt", [])]
    assert [r[0] for r in df.select(dna.only_bases(F.col("s"))).collect()] == [False, True, False, True]
    r = spark.createDataFrame([("acdB*yzJ",)], "s string").select(dna.amino_text(F.col("s")), dna.amino_numbers(F.col("s"))).first()
    assert tuple(r) == ("ACDXYX", [0, 1, 2, 20, 19, 20])
    for t in ("", "a", "acg", "acgta", "ttgca"):
        x = spark.createDataFrame([(t,)], "s string").select(dna.unpacked(dna.reverse_complement_packed(dna.packed(F.col("s")), F.length("s")), F.length("s"))).first()[0]
        assert x == t[::-1].translate(str.maketrans("acgt", "tgca"))


def test_names_and_reports(spark):
    assert files.tagged("a/b.c.fa.gz", "1khash") == "a/b.c.1khash" and files.tagged("x", "y") == "x.y"
    assert files.command_line(["p", "-a"]) == "p -a"
    assert spark.createDataFrame([("  a bc\td ",)], "s string").select(files.words(F.col("s"))).first()[0] == ["a", "bc", "d"]
    said = []
    with files.timed(said.append, "work"):
        pass
    assert said[0].startswith("work: elapsed 0.") and "MB" in said[0]
    p = SampleParams()
    assert SampleParams.read(p.write()) == p and "63 bases" in p.report()
    with pytest.raises(ValueError):
        p.require(SampleParams(k=5, w=10))


def test_map_output_has_a_row_for_each_query(spark):
    queries = spark.createDataFrame([(1, 10, "q1", None), (2, 20, "q2", "G")], "query long, len long, id string, code string")
    found = spark.createDataFrame([(1, 5, 9, 2), (1, 0, 4, 1)], "query long, start long, end long, count long")
    lacking = spark.createDataFrame([(2, 3, "acg")], "query long, pos long, dna string")
    placed = spark.createDataFrame([(1, 0, 4, 100, 1)], "query long, start long, end long, place long, strand int")
    rows = {r.query: r for r in mapping.output(queries, found, lacking, placed).collect()}
    assert [tuple(x) for x in rows[1].matches] == [(0, 4, 1), (5, 9, 2)] and rows[1].missing == [] and rows[1].places[0].place == 100 and rows[1].id == "q1"
    assert rows[2].matches == [] and [tuple(x) for x in rows[2].missing] == [(3, "acg")] and rows[2].code == "G"
    assert "id" not in mapping.output(queries, found, lacking, placed, ids=False).columns


def test_kmers_in_blocks_and_pieces(spark, monkeypatch):
    rng = random.Random(6)
    seqs = [(k, "".join(rng.choice("ac") + rng.choice("gt") for _ in range(200))) for k in range(5)]
    df = spark.createDataFrame(seqs, "seq_ord long, seq string")
    kmers = spark.createDataFrame([(f"k{i}", s[i : i + 9]) for i, (_, s) in enumerate(seqs)], "id string, kmer string").dropDuplicates(["kmer"])
    want = sorted(tuple(r) for r in typing31.matches(df, kmers, 9).collect())
    monkeypatch.setattr(typing31, "BLOCK", 2)
    monkeypatch.setattr(typing31, "PIECE", 50)
    assert sorted(tuple(r) for r in typing31.matches(df, kmers, 9).collect()) == want and want
    counted = typing31.counts(typing31.matches(df, kmers, 9), spark.createDataFrame([(k, 1 + k % 2) for k in range(5)], "seq_ord long, file int"))
    ids = sorted({w[2] for w in want})
    table = {r.file: r for r in typing31.table(counted, ids).collect()}
    assert sum(table[f][i] for f in table for i in ids) == len(want)


def brute_matches(chains, strands):
    """Maximal exact matches of chains [(node, gap)] with lists of (node, gap), counted; a match's first gap does not count."""
    out = {}
    for q, chain in chains.items():
        found = {}
        for path in strands:
            for d in range(-len(chain) + 1, len(path)):
                first = None
                for c in range(len(chain) + 1):
                    a = c + d
                    same = c < len(chain) and 0 <= a < len(path) and path[a][0] == chain[c][0]
                    joined = same and first is not None and path[a][1] == chain[c][1]
                    if first is not None and not joined:
                        found[(first, c - 1)] = found.get((first, c - 1), 0) + 1
                        first = None
                    if same and first is None:
                        first = c
        for (a, z), n in found.items():
            if not any((x, y) != (a, z) and x <= a and y >= z for x, y in found):
                out[(q, a, z)] = n
    return out


def test_matches_against_brute_force(spark):
    from strandweave.operators.pathing import both_strands

    visited = visits(spark, seed=5, n=25, nodes=5)
    rows = sorted(both_strands(visited).collect(), key=lambda r: (r.path_id, r.strand, r.idx))
    strands = {}
    for r in rows:
        strands.setdefault((r.path_id, r.strand), []).append((r.node, r.gap))
    rng, chains = random.Random(3), {}
    for q in range(25):
        pos, chain = 0, []
        for i in range(rng.randint(1, 9)):
            gap = rng.randint(1, 2) if i else 0
            pos += gap
            chain.append((rng.choice([-1, 1]) * rng.randint(1, 6), gap))
        chains[q] = chain
    df = spark.createDataFrame([(q, 0, c, node, gap) for q, chain in chains.items() for c, (node, gap) in enumerate(chain)], "query long, blk long, c long, node long, gap long")
    got = {(r.query, r.first, r.last): r["count"] for r in mapping.matches(df, visited).collect()}
    assert got == brute_matches(chains, strands.values())


def test_a_repeat_with_very_many_visits_costs_no_pairs(spark):
    """Node 1 stands 100,000 times between others; 1,000 queries hold it next to a node that only one path has."""
    paths = spark.range(100_000).select(F.col("id").alias("path_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("idx"), n.cast("long").alias("node"), F.lit(i).cast("long").alias("pos")) for i, n in enumerate((F.col("id") + 10, F.lit(1), F.col("id") + 200_010))])).alias("v")).select("path_id", "v.*")
    chains = spark.range(1000).select(F.col("id").alias("query"), F.lit(0).cast("long").alias("blk"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("c"), (F.col("id") + 10).alias("node"), F.lit(0).cast("long").alias("gap")), F.struct(F.lit(1).cast("long").alias("c"), F.lit(1).cast("long").alias("node"), F.lit(1).cast("long").alias("gap")))).alias("x")).select("query", "blk", "x.*")
    got = mapping.matches(chains, paths)
    assert got.count() == 1000 and got.where("first <> 0 OR last <> 1 OR count <> 1").isEmpty()


def stored_tables(spark):
    """Names of the tables that queries have written to the shared folder so far."""
    from pathlib import Path

    from strandweave import runtime

    return {str(p.relative_to(p.parents[1])) for p in Path(runtime.shared_dir(spark).removeprefix("file:"), "strandweave").glob("*/*")}


def test_missing_fragments_need_no_matches(spark, sf_dir):
    from strandweave import catalog

    before = stored_tables(spark)
    assert catalog.QUERIES["map_missing"](spark, sf_dir).count() > 0
    made = stored_tables(spark) - before
    assert made and not any(t.split("-")[-1] in ("visits", "matches", "nodes") for t in made), made


def test_queries_without_a_match_need_no_matches(spark, sf_dir):
    from strandweave import catalog
    from strandweave.operators import selection
    from strandweave.plans import testdata as T

    before = stored_tables(spark)
    got = {r.query for r in catalog.QUERIES["map_no_match"](spark, sf_dir).collect()}
    made = stored_tables(spark) - before
    assert made and not any(t.split("-")[-1] in ("visits", "matches", "nodes") for t in made), made
    fragments = [selection.syncmers(f(spark, sf_dir), T.SHORT).where("NOT poly") for f in (T.conversation_sequences, T.sequences)]
    known = {bytes(r.canon) for r in fragments[1].select("canon").distinct().collect()}
    some = {r.seq_ord for r in fragments[0].collect() if bytes(r.canon) in known}
    assert got == {r.seq_ord for r in T.conversation_sequences(spark, sf_dir).select("seq_ord").collect()} - some


def test_paths_told_apart_leave_the_rounds(spark):
    rng = random.Random(5)
    long = [(rng.choice([-1, 1]) * rng.randint(1, 4), rng.randint(1, 2)) for _ in range(70)]
    paths = [[(rng.choice([-1, 1]) * rng.randint(1, 4), rng.randint(1, 2)) for _ in range(rng.randint(1, 9))] for _ in range(20)] + [long, long, [(3, 1), *long]]
    rows = [(p, i, node, sum(g for _, g in path[: i + 1])) for p, path in enumerate(paths) for i, (node, _) in enumerate(path)]
    ws = Workspace(spark, "rounds")
    got = pathindex.visit_order(ws, spark.createDataFrame(rows, "path_id long, idx long, node long, pos long")).collect()
    of = {}
    for r in got:
        of.setdefault((r.path_id, r.strand), {})[r.idx] = (r.node, r.gap)
    history = lambda r: [of[r.path_id, r.strand][i] for i in range(r.idx, -1, -1)]
    for node in {r.node for r in got}:
        own = sorted((r for r in got if r.node == node), key=lambda r: (history(r), r.path_id, r.strand))
        assert [r.place for r in own] == list(range(len(own)))
    from pathlib import Path

    tables = sorted(p for p in Path(ws.path.removeprefix("file:")).iterdir() if p.name.endswith("-ranks"))
    assert {r.path_id for r in spark.read.parquet(str(tables[-1])).select("path_id").distinct().collect()} <= {20, 21, 22}
    assert sum(spark.read.parquet(str(t)).count() for t in tables) < 5 * len(got)


def test_steps_that_many_queries_and_paths_share(spark):
    """300 queries and 2,000 paths hold the same 21 fragments; half of the paths are walked backwards."""
    step = F.explode(F.sequence(F.lit(0), F.lit(20)).cast("array<long>"))
    paths = spark.range(2000).select(F.col("id").alias("path_id"), step.alias("idx")).withColumn("node", F.when(F.col("path_id") % 2 == 0, F.col("idx") + 3).otherwise(F.col("idx") - 23)).withColumn("pos", F.col("idx") * 5)
    chains = spark.range(300).select(F.col("id").alias("query"), F.lit(0).cast("long").alias("blk"), step.alias("c")).withColumn("node", F.col("c") + 3).withColumn("gap", F.when(F.col("c") == 0, 0).otherwise(5).cast("long"))
    got = mapping.matches(chains, paths).collect()
    assert sorted(tuple(r) for r in got) == [(q, 0, 0, 20, 2000) for q in range(300)]


def test_matches_of_messages_need_no_dictionary(spark, sf_dir):
    from strandweave import catalog

    before = stored_tables(spark)
    assert catalog.QUERIES["mem_conversations"](spark, sf_dir).count() > 0
    made = stored_tables(spark) - before
    assert made and not any(t.split("-")[-1] in ("visits", "nodes", "occurrences") for t in made), made


def test_long_matches_against_brute_force(spark):
    """Chains of up to 150 visits, of which every part and its reverse may stand in a path; gaps and nodes differ here and there."""
    from strandweave.operators.pathing import both_strands

    rng = random.Random(8)
    base = [(rng.choice([-1, 1]) * rng.randint(1, 3), rng.randint(1, 2)) for _ in range(150)]

    def part(flip):
        a = rng.randrange(150)
        own = base[a : a + rng.randint(1, 150)]
        if flip:
            own = [(-n, own[k + 1][1] if k + 1 < len(own) else 1) for k, (n, _) in enumerate(own)][::-1]
        return [(rng.randint(1, 3), g) if rng.random() < 0.02 else (n, g) for n, g in own]

    rows = [(p, i, node, sum(g for _, g in path[: i + 1])) for p, path in enumerate(part(k % 2) for k in range(30)) for i, (node, _) in enumerate(path)]
    visited = spark.createDataFrame(rows, "path_id long, idx long, node long, pos long")
    chains = {q: part(q % 3 == 0) for q in range(12)} | {12: [(1, 0), (-1, 1)], 13: [(99, 0)]}
    df = spark.createDataFrame([(q, 0, c, node, gap if c else 0) for q, chain in chains.items() for c, (node, gap) in enumerate(chain)], "query long, blk long, c long, node long, gap long")
    strands = {}
    for r in sorted(both_strands(visited).collect(), key=lambda r: (r.path_id, r.strand, r.idx)):
        strands.setdefault((r.path_id, r.strand), []).append((r.node, r.gap))
    got = {(r.query, r.first, r.last): r["count"] for r in mapping.matches(df, visited).collect()}
    assert got == brute_matches(chains, strands.values()) and max(z - a for _, a, z in got) > 20
