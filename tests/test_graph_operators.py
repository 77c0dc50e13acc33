"""Small and awkward sequences against plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandweave.operators import dictionary, graph, mapping, pathindex, pathing, selection, stats, typing31
from strandweave.params import SampleParams
from strandweave.runtime import Workspace, connected_components, maybe_in, membership, running_total

P = SampleParams(k=5, w=10)


def rc(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def hashed(s, p):
    num = lambda t: int("0" + t.translate(str.maketrans("acgt", "0123")), 4)
    h = lambda t: (num(t) * p.factor % 2**64) >> (64 - 2 * p.k)
    return [min(h(s[i : i + p.k]), h(rc(s[i : i + p.k]))) for i in range(len(s) - p.k + 1)]


def syncmers(s, p):
    h = hashed(s, p)
    return [i for i in range(len(s) - p.length) if min(h[i : i + p.w + 1]) in (h[i], h[i + p.w])]


def sequences():
    rng = random.Random(3)
    rand = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    base = rand(300)
    out = ["", "a", rand(4), rand(P.length - 1), rand(P.length), rand(P.length + 1), "a" * 60, "c" * 90, rand(40) + "a" * 50 + rand(40), rand(30) + "t" * 40 + "g" * 40 + rand(30), base, rc(base), base, base[:150] + rand(5) + base[150:], "acac" * 30]
    return out + [rand(n) for n in (64, 100, 257)]


@pytest.fixture(scope="module")
def made(spark):
    seqs = spark.createDataFrame([(i, s, len(s), 1 + i % 2) for i, s in enumerate(sequences())], "seq_ord long, seq string, len long, file int")
    ws = Workspace(spark, "test")
    files = ws.put(running_total(ws, seqs.select("seq_ord", "file", "len"), ["seq_ord"], F.col("len"), "start"), "files")
    occ = ws.put(selection.syncmers(seqs, P), "occ")
    nodes = ws.put(dictionary.build(ws, occ, files), "nodes")
    visits = ws.put(pathing.visits(dictionary.look_up(occ, nodes)), "visits")
    return ws, seqs, files, occ, nodes, visits


def test_selection_in_small_pieces(spark, made, monkeypatch):
    _, seqs, _, occ, _, _ = made
    want = sorted((i, p) for i, s in enumerate(sequences()) for p in syncmers(s, P))
    assert sorted((r.seq_ord, r.pos) for r in occ.collect()) == want
    assert sorted((r.seq_ord, r.pos) for r in selection.syncmers_relational(seqs, P).collect()) == want
    monkeypatch.setattr(selection, "PIECE", 37)
    found = []
    for s in sequences():
        c = selection.codes(s.encode())
        found.append([p for a, b in selection._pieces(len(c), P.length) for p in (selection.syncmer_places(c[a:b], P) + a)] if s else [])
    assert [(i, p) for i, ps in enumerate(found) for p in ps] == want


@pytest.mark.parametrize("p", [P, SampleParams(), SampleParams(k=31, w=2), SampleParams(k=16, w=1), SampleParams(k=1, w=2), SampleParams(k=15, w=40)], ids=lambda p: f"{p.k}-{p.w}")
def test_relational_syncmers_move_no_row_per_base(made, monkeypatch, p):
    _, seqs, _, _, _, _ = made
    monkeypatch.setattr(selection, "COLUMN_PIECE", 37)
    found = selection.syncmers_relational(seqs, p)
    assert sorted((r.seq_ord, r.pos) for r in found.collect()) == [(i, a) for i, s in enumerate(sequences()) for a in syncmers(s, p)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Window", "Sort", "Python", "Arrow") if x in plan]
    assert plan.count("rpad(") == 1  # hashes are worked out once: no test for null asks for them again


def test_minimizers_and_modimizers(made):
    _, seqs, _, _, _, _ = made
    minis, mods = set(), set()
    for i, s in enumerate(sequences()):
        h = hashed(s, P)
        for a in range(len(h) - P.w + 1):
            w = h[a : a + P.w]
            minis.add((i, a + w.index(min(w)), min(w)))
        mods |= {(i, a, x) for a, x in enumerate(h) if x % P.w == 0}
    assert {tuple(r) for r in selection.minimizers(seqs, P).collect()} == minis
    assert {tuple(r) for r in selection.modimizers(seqs, P).collect()} == mods


def test_round_trip_and_checks(made):
    ws, seqs, files, _, nodes, visits = made
    ends = pathing.ends(seqs, visits, P)
    assert {r.path_id: r.seq for r in pathing.rebuild(visits, nodes, ends, P).collect()} == dict(enumerate(sequences()))
    assert {r.ok for r in pathing.check_paths(seqs, visits, ends, P).collect()} == {True}
    both = pathing.both_strands(visits).where("strand = -1").select("path_id", "idx", "node")
    back = pathing.reversed_visits(visits, P).select("path_id", "idx", "node")
    assert pathing.differences(both, back).count() == 0


def test_dictionary(spark, made):
    ws, _, files, occ, nodes, _ = made
    rows = dictionary.with_text(nodes, P).orderBy("node").collect()
    counts, first = Counter(), {}
    for i, s in enumerate(sequences()):
        for p in syncmers(s, P):
            t = s[p : p + P.length]
            if len(set(t)) > 1:
                c = min(t, rc(t))
                counts[c] += 1
                first.setdefault(c, (i, p))
    assert [(r.canon, r["count"], (r.first_seq, r.first_pos)) for r in rows] == [(c, counts[c], first[c]) for c in sorted(first, key=first.get)]
    assert [r.node for r in rows] == list(range(3, len(rows) + 3))
    kept = dictionary.limit_counts(ws, nodes, 2).collect()
    assert sorted(r.node for r in kept) == list(range(3, len(kept) + 3)) and all(r["count"] >= 2 for r in kept)
    wanted = spark.createDataFrame([(3,), (-4,)], "node long")
    assert {r.node: r.text for r in dictionary.node_text(nodes, wanted, P).collect()} == {3: rows[0].canon, -4: rc(rows[1].canon)}
    with pytest.raises(Exception, match="no such node"):
        dictionary.node_text(nodes, spark.createDataFrame([(0,)], "node long"), P).collect()
    assert dictionary.extend(ws, nodes.select("node", "canon", "count"), occ, files).where("is_new").count() == 0


def test_graph_invariants(made):
    _, _, _, _, _, visits = made
    e = {(r.node, r.adj, r.off): r["count"] for r in graph.edges(visits).collect()}
    assert all(e[(-a, -n, o)] == c for (n, a, o), c in e.items() if a)
    starts = {r.node: r.starts for r in graph.start_counts(visits).collect()}
    paths = visits.select("path_id").distinct().count()
    assert sum(starts.values()) == 2 * paths
    arrivals, leaves = Counter(), Counter()
    for (n, a, _), c in e.items():
        arrivals[n] += c
        leaves[-n] += c
    assert arrivals == leaves
    classes = {r.node: r["class"] for r in graph.node_classes(graph.edges(visits)).collect()}
    assert set(classes.values()) <= {"simple", "simple_in", "simple_out", "complex"}


def test_path_index(made):
    ws, _, _, _, _, visits = made
    ordered = ws.put(pathindex.visit_order(ws, visits), "ordered")
    rows = ordered.collect()
    paths = {}
    for r in rows:
        paths.setdefault((r.path_id, r.strand), {})[r.idx] = (r.node, r.gap)
    key = lambda r: [paths[r.path_id, r.strand][i] for i in range(r.idx, -1, -1)] + [(r.path_id, r.strand)]
    by_node = {}
    for r in rows:
        by_node.setdefault(r.node, []).append(r)
    for rs in by_node.values():
        assert [r.place for r in sorted(rs, key=lambda r: (key(r)[:-1], r.path_id, r.strand))] == list(range(len(rs)))
    lists = ws.put(pathindex.successors(ordered), "lists")
    assert pathing.differences(pathindex.expand(pathindex.runs(lists)), lists).count() == 0
    at = {(r.path_id, r.strand, r.idx): (r.node, r.place) for r in rows}
    want = {at[k]: at[k[0], k[1], k[2] + 1] for k in at if (k[0], k[1], k[2] + 1) in at}
    assert {(r.node, r.place): (r.next_node, r.next_place) for r in pathindex.follow(lists).collect()} == want
    walked = {(r.start_node, r.start_place, r.step): r.node for r in pathindex.walk(ws, lists).collect()}
    assert walked == {(*at[p, s, 0], i): n for (p, s, i), (n, _) in at.items()}


def brute_mems(query, paths):
    found = Counter()
    for c in range(len(query)):
        for path in paths:
            for a in range(len(path)):
                same = lambda i, j, first: query[i][0] == path[j][0] and (first or query[i][1] == path[j][1])
                if not same(c, a, True):
                    continue
                if c and a and same(c - 1, a - 1, True) and query[c][1] == path[a][1]:
                    continue
                n = 1
                while c + n < len(query) and a + n < len(path) and same(c + n, a + n, False):
                    n += 1
                found[c, c + n - 1] += 1
    return {k: v for k, v in found.items() if not any(o != k and o[0] <= k[0] and o[1] >= k[1] for o in found)}


def test_matches(spark, made):
    ws, _, files, _, nodes, visits = made
    rng = random.Random(8)
    s = sequences()
    asked = [s[10][20:200], rc(s[10][20:200]), s[10][:80] + "t" + s[10][80:], "".join(rng.choice("acgt") for _ in range(120)), s[8], "a" * 70, s[10][:100] + "a" * 40 + s[10][100:200], ""]
    queries = spark.createDataFrame(list(enumerate(asked)), "seq_ord long, seq string")
    found = selection.syncmers(queries, P).join(nodes.select("canon", F.col("node").alias("_n")), "canon", "left").withColumn("node", F.coalesce(F.col("_n") * F.col("orient"), F.lit(0))).drop("_n")
    chains = ws.put(mapping.blocks(found), "chains")
    got = {}
    for r in mapping.matches(chains, visits).collect():
        got.setdefault((r.query, r.blk), {})[r.first, r.last] = r["count"]
    paths, blocks = {}, {}
    for r in pathing.both_strands(visits).collect():
        paths.setdefault((r.path_id, r.strand), {})[r.idx] = (r.node, r.gap)
    for r in chains.collect():
        blocks.setdefault((r.query, r.blk), {})[r.c] = (r.node, r.gap)
    paths = [[p[i] for i in range(len(p))] for p in paths.values()]
    assert got == {k: brute_mems([b[i] for i in range(len(b))], paths) for k, b in blocks.items()}
    placed = mapping.unique_places(mapping.matches(chains, visits), chains, nodes, P).collect()
    whole = "".join(s)
    for r in placed:
        text = asked[r.query][r.start : r.end]
        assert whole[r.place : r.place + len(text)] == (text if r.strand > 0 else rc(text))
    assert placed


def test_typing(spark, made):
    _, seqs, _, _, _, _ = made
    s = sequences()
    kmers = [("head", s[10][:31]), ("tail", s[10][-31:]), ("none", "ac" * 15 + "t")]
    got = typing31.matches(seqs, spark.createDataFrame(kmers, "id string, kmer string"))
    want = sorted((i, p, name, d) for i, t in enumerate(s) for name, k in kmers for d, x in ((1, k), (-1, rc(k))) for p in range(len(t) - 30) if t[p : p + 31] == x)
    assert sorted(tuple(r) for r in got.collect()) == want
    for r in typing31.contexts(got, seqs).collect():
        assert len(r.context) == 131 and r.context[50:81].lower() == dict(kmers)[r.id]
    for bad in ([("a", "acgt")], [("a", "n" * 31)], [("a", "a" * 31), ("b", "A" * 31)]):
        with pytest.raises(Exception, match="31 bases|given twice"):
            typing31.matches(seqs, spark.createDataFrame(bad, "id string, kmer string")).collect()


def test_histograms(spark):
    counts = [1, 2, 3, 4, 6, 7, 9, 10, 12, 13, 400]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(counts)], "node long, count long")
    edges = [(t + 1) ** 2 // 4 for t in range(1, 60)]
    want = Counter(min(e for e in edges if e >= c) for c in counts)
    assert {r.edge: r.nodes for r in stats.quadratic_histogram(df).collect()} == want


def test_filters(spark):
    rows = [("g" * 60, [30] * 60), ("g" * 61, [30] * 61), ("acgt", [19, 20, 20, 20]), ("acgt", [20] * 4), ("acgt", [0] * 4), ("", [])]
    df = spark.createDataFrame(rows, "seq string, qual array<int>").withColumn("n", F.monotonically_increasing_id())
    assert [r.code for r in mapping.filter_code(df, 60, 20.0).orderBy("n").collect()] == [None, "G", "Q", None, None, None]
    assert mapping.passing(df, 60, 20.0).count() == 4


def test_locate(spark):
    starts = spark.createDataFrame([(0, 1, 0, 5), (1, 1, 5, 0), (2, 2, 5, 200_000)], "path_id long, file int, start long, len long")
    places = spark.createDataFrame([(0,), (4,), (5,), (-7,), (200_004,), (200_005,)], "place long")
    got = {r.place: (r.file, r.path_id, r.offset) for r in pathindex.locate(places, starts).collect()}
    assert got == {0: (1, 0, 0), 4: (1, 0, 4), 5: (2, 2, 0), -7: (2, 2, -2), 200_004: (2, 2, 199_999), 200_005: (None, None, None)}


def test_components_and_membership(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)]
    low = {n: n for e in edges for n in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    ws = Workspace(spark, "components")
    got = connected_components(ws, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == low and len(got) == len(low)
    ids = spark.range(0, 5000, 7)
    maybe, sure = maybe_in(spark.range(5000).withColumn("_word", F.col("id") + 1), F.col("id"), membership(ids, "id"))
    assert maybe.columns == sure.columns == ["id", "_word"]
    found, rest = {r.id for r in maybe.collect()}, {r.id for r in sure.collect()}
    assert found >= set(range(0, 5000, 7)) and len(found) < 800 and found | rest == set(range(5000)) and not found & rest
