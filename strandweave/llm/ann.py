"""Operator 5: approximate nearest neighbours with learned partitions.

On a bounded sample: k-means gives a start, then a graph of each vector's nearest
neighbours is split into balanced parts: vectors move to the part that holds most
of their neighbours, as far as it has room.  A small linear classifier, which
starts from the parts' means, learns to tell the part from the vector.  It puts
every vector of the table into its two most probable parts and routes a query to
its most probable parts, whose vectors are all compared exactly, in double
precision.  How many parts are searched is measured: exact neighbours of some
vectors in the whole table say how many it takes to find ``RECALL`` of them.

There are about 2 * sqrt(n) parts, until the sample has reached its bound.  A few
vectors of the sample, at most one in 16 of the table, are compared with every
query: their distances bound the search from the start.

Queries go to the tasks in blocks of bounded size, each task scans its share of
the parts and returns what is nearest within it.  Equal vectors are one
candidate that stands for its smallest ids; so a vector that is copied a million
times is compared once.

Defined results: vectors that are null, all zero, hold a null or a non-finite
component or have another length than most take no part; rows that repeat an id
with the same vector count once; null ids take no part; with fewer candidates
than asked for all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import Workspace

#: Sample: vectors for a part, vectors at least and at most; neighbours in the graph; room of a part beyond its share.
PER_PART, LEAST, MOST, GRAPH, ROOM = 32, 2048, 1 << 16, 10, 1.1
#: Parts that hold a vector; vectors compared with all queries, at most; vectors that the recall is measured with, and the recall wanted.
COPIES, SEEDS, MEASURED, RECALL = 2, 2048, 256, 0.94
#: Entries (a query and a part that it searches) of a block of queries; found neighbours that a task holds before it keeps the nearest.
BLOCK, PENDING = 1 << 22, 1 << 18
KMEANS, MOVES, EPOCHS, SEED = 8, 8, 6, 5


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of x, for each row."""
    squares = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 256):
        d = squares[None, :] - 2 * (x[i : i + 256] @ x.T)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out[i : i + len(d)] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def _means(x: np.ndarray, part: np.ndarray, old: np.ndarray) -> np.ndarray:
    """Each part's mean; the old one where a part is empty."""
    order = np.argsort(part, kind="stable")
    there, first, n = np.unique(part[order], return_index=True, return_counts=True)
    out = old.copy()
    out[there] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return out


def _near_means(x: np.ndarray, means: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts, closeness) of the n nearest means of each row, the nearest first."""
    parts, close = [], []
    for i in range(0, len(x), 4096):
        s = 2 * (x[i : i + 4096] @ means.T) - (means * means).sum(1)
        own = np.argpartition(-s, n - 1, axis=1)[:, :n] if n < s.shape[1] else np.tile(np.arange(n), (len(s), 1))
        held = np.take_along_axis(s, own, 1)
        order = np.argsort(-held, axis=1, kind="stable")
        parts.append(np.take_along_axis(own, order, 1))
        close.append(np.take_along_axis(held, order, 1))
    return np.concatenate(parts), np.concatenate(close)


def partition(x: np.ndarray, parts: int) -> np.ndarray:
    """The part of each row of x, such that the neighbour graph is cut little and no part exceeds its room."""
    if parts == 1:
        return np.zeros(len(x), np.int64)
    means = x[np.random.default_rng(SEED).choice(len(x), parts, replace=False)].copy()
    for _ in range(KMEANS):
        means = _means(x, _near_means(x, means, 1)[0][:, 0], means)
    room = int(np.ceil(len(x) / parts * ROOM))
    near, close = _near_means(x, means, min(32, parts))
    part, size = np.empty(len(x), np.int64), np.zeros(parts, np.int64)
    for i in np.argsort(close[:, 1] - close[:, 0], kind="stable").tolist():  # the clearest first
        free = next((p for p in near[i].tolist() if size[p] < room), None)
        part[i] = int(size.argmin()) if free is None else free
        size[part[i]] += 1
    graph = nearest(x, min(GRAPH, len(x) - 1))
    a, b = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for _ in range(MOVES):
        key, count = np.unique(a * parts + part[b], return_counts=True)
        node, to = key // parts, key % parts
        here, stay = to == part[node], np.zeros(len(x), np.int64)
        stay[node[here]] = count[here]
        gain = count - stay[node]
        able = np.flatnonzero(~here & (gain > 0))
        moved = set()
        for k in able[np.argsort(-gain[able], kind="stable")].tolist():
            n, t = int(node[k]), int(to[k])
            if n not in moved and size[t] < room:
                moved.add(n)
                size[part[n]] -= 1
                size[t] += 1
                part[n] = t
        if len(moved) * 200 < len(x):
            break
    return part


class Router:
    """A linear classifier that gives each part a score."""

    def __init__(self, x: np.ndarray, y: np.ndarray, parts: int):
        rng = np.random.default_rng(SEED)
        self.centre, self.scale = x.mean(0), x.std() * x.shape[1] ** 0.5 + 1e-9
        z = ((x - self.centre) / self.scale).astype(np.float32)
        means = _means(z, y, np.zeros((parts, x.shape[1]), np.float32))
        sharp = np.float32(12)
        self.w, self.b = (sharp * means).T.copy(), -sharp / 2 * (means * means).sum(1)
        m, v, step = [0.0, 0.0], [0.0, 0.0], 0
        for epoch in range(EPOCHS):
            rate, order = np.float32(0.05 * (1 - epoch / EPOCHS)), rng.permutation(len(z))
            for i in range(0, len(z), 256):
                own = order[i : i + 256]
                s = z[own] @ self.w + self.b
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), y[own]] -= 1
                p /= len(own)
                step += 1
                for k, (g, at) in enumerate(((z[own].T @ p, self.w), (p.sum(0), self.b))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    at -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    def best(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n most probable parts of each row, the most probable first."""
        s = ((x - self.centre) / self.scale).astype(np.float32) @ self.w + self.b
        return np.argsort(-s, axis=1, kind="stable")[:, :n].astype(np.int32)


def parts_for(n: int) -> int:
    """A power of two near 2 * sqrt(n), as far as the sample's bound gives every part its vectors; each part has 8 at least."""
    parts = 1
    while parts * parts * 2 <= 4 * n and parts * 8 < n and parts * PER_PART < MOST:
        parts *= 2
    return parts


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, h1, h2) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return rows.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))


def _stack(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


class Queries:
    """A block of queries: their vectors, what bounds them, and for each part the queries that search it."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bound: np.ndarray, parts: np.ndarray, k: int):
        self.ids, self.q, self.bound, self.k = ids, q, bound, k
        self.squares = (q * q).sum(1)
        flat = parts.ravel()
        order = np.argsort(flat, kind="stable")
        there, first = np.unique(flat[order], return_index=True)
        rows = (order // parts.shape[1]).astype(np.int32)
        self.of_part = dict(zip(there.tolist(), np.split(rows, first[1:]), strict=True)) if len(flat) else {}


class Nearest:
    """The k nearest candidates of each query of a block so far."""

    def __init__(self, asked: Queries):
        self.asked, self.bound = asked, asked.bound.copy()
        self.kept, self.pending, self.n = [], [], 0

    def add(self, part: int, x: np.ndarray, ids: np.ndarray) -> None:
        """Compare vectors of a part with the queries that search it."""
        a, k = self.asked, self.asked.k
        rows = a.of_part.get(part)
        if rows is None:
            return
        squares = (x * x).sum(1)
        for at in range(0, len(rows), 1024):
            own = rows[at : at + 1024]
            d = a.squares[own, None] + squares[None, :] - 2 * (a.q[own] @ x.T)
            # This form rounds; what could be near enough is measured exactly.
            slack = 1e-12 * (a.squares[own] + squares.max())
            limit = self.bound[own] ** 2
            if len(x) > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero(d <= (limit * (1 + 1e-12) + slack)[:, None])
            if len(r):
                exact = np.sqrt(((x[c] - a.q[own[r]]) ** 2).sum(1))
                self.pending.append((own[r], ids[c], exact))
                self.n += len(r)
        if self.n > PENDING:
            self.reduce()

    def reduce(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, distance), k for each query at most."""
        found = [np.concatenate(z) for z in zip(*self.kept, *self.pending, strict=True)] if self.kept or self.pending else [np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0)]
        order = np.lexsort((found[1], found[2], found[0]))
        q, ids, d = (z[order] for z in found)
        once = np.ones(len(q), bool)
        once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
        q, ids, d = q[once], ids[once], d[once]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        rank = np.arange(len(q)) - np.repeat(first, np.diff(first, append=len(q)))
        last = rank == self.asked.k - 1
        self.bound[q[last]] = np.minimum(self.bound[q[last]], d[last])
        near = rank < self.asked.k
        out = q[near], ids[near], d[near]
        self.kept, self.pending, self.n = [out], [], 0
        return out


def _scan(shared):
    """Rows (class, v, part) in order of parts: (asked, class, score) of what is nearest within a task."""

    def run(it):
        found = Nearest(shared.value)
        for batch in it:
            if batch.num_rows:
                parts, x, ids = batch.column("part").to_numpy(), _stack(batch.column("v")), batch.column("class").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    found.add(int(parts[a]), x[a:b], ids[a:b])
        q, ids, d = found.reduce()
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.ids[q]), pa.array(ids), pa.array(d)], ["asked", "class", "score"])

    return W.tidy(run)


FOUND = "asked long, class long, score double"


@dataclass
class Index:
    """A table's classes of equal vectors, their parts, and what leads to them."""

    ws: Workspace
    classes: DataFrame
    placed: DataFrame
    router: Router
    seeds: np.ndarray
    seed_ids: np.ndarray
    n: int
    parts: int
    k: int
    probes: int = 0

    def ask(self, rows: DataFrame, probes: int):
        """Blocks of Queries from rows (class, v)."""
        shared = self.ws.spark.sparkContext.broadcast((self.router, self.seeds))
        n, k = probes, self.k

        def route(it):
            router, seeds = shared.value
            for batch in it:
                if batch.num_rows:
                    v = _stack(batch.column("v"))
                    bound = np.full(len(v), np.inf)
                    if len(seeds) >= k:
                        for i in range(0, len(v), 256):
                            d = ((v[i : i + 256] ** 2).sum(1)[:, None] + (seeds**2).sum(1) - 2 * v[i : i + 256] @ seeds.T).clip(0)
                            bound[i : i + len(d)] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
                        bound = bound * (1 + 1e-9) + 1e-9
                    parts = router.best(v, n)
                    yield batch.append_column("bound", pa.array(bound)).append_column("parts", W.lists(parts.ravel(), [parts.shape[1]] * len(parts), pa.int32()))

        routed = self.ws.put(rows.mapInArrow(route, "class long, v array<double>, bound double, parts array<int>"), "asked")
        blocks = -(-routed.count() * n // BLOCK)
        for b in range(blocks):
            t = routed.where(F.pmod(F.xxhash64("class"), F.lit(blocks)) == b).toArrow().combine_chunks()
            if t.num_rows:
                v, parts = (_stack(t.column(c).combine_chunks()) for c in ("v", "parts"))
                yield Queries(t.column("class").to_numpy(), v, t.column("bound").to_numpy(), parts, k)

    def nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """(asked, class, score) for rows (class, v): the k nearest classes found of each and others, each once."""
        found = [self.ws.put(self.placed.mapInArrow(_scan(self.ws.spark.sparkContext.broadcast(q)), FOUND), "found") for q in self.ask(rows, probes)]
        seeds, ids, k, placed = self.seeds, self.seed_ids, self.k, None
        if len(seeds):
            shared = self.ws.spark.sparkContext.broadcast((seeds, ids))

            def beside(it):
                seeds, ids = shared.value
                for batch in it:
                    for own in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                        n = own.num_rows
                        asked = Queries(own.column("class").to_numpy(), _stack(own.column("v")), np.full(n, np.inf), np.zeros((n, 1), np.int32), k)
                        near = Nearest(asked)
                        near.add(0, seeds, ids)
                        q, c, d = near.reduce()
                        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(c), pa.array(d)], ["asked", "class", "score"])

            placed = rows.mapInArrow(beside, FOUND)
        for f in found:
            placed = f if placed is None else placed.union(f)
        if placed is None:
            placed = self.ws.spark.createDataFrame([], FOUND)
        return placed.groupBy("asked", "class").agg(F.min("score").alias("score"))

    def measure(self, sample: DataFrame) -> int:
        """The least number of parts that finds RECALL of the exact neighbours of sample (class, v) in the whole table."""
        true = self.nearest(sample, self.parts).where("asked <> class")
        near = Over.partitionBy("asked").orderBy("score", "class")
        true = true.withColumn("n", F.row_number().over(near)).where(F.col("n") < self.k).select("asked", "class")
        homes = true.join(self.placed.select("class", "part"), "class").groupBy("asked", "class").agg(F.collect_list("part").alias("homes")).collect()
        if not homes:
            return self.parts
        asked = sample.toArrow().combine_chunks()
        order = self.router.best(_stack(asked.column("v").combine_chunks()), self.parts)
        place = np.argsort(order, axis=1)
        row = {c: i for i, c in enumerate(asked.column("class").to_pylist())}
        known = set(self.seed_ids.tolist())
        need = np.sort([0 if r["class"] in known else 1 + min(int(place[row[r.asked], h]) for h in r.homes) for r in homes])
        return max(1, int(need[int(np.ceil(RECALL * len(need))) - 1]))


def build(vectors: DataFrame, k: int = 10) -> tuple[Index | None, DataFrame]:
    """(index, rows): rows are (vec_id, v, h1, h2) of the vectors that take part; no index without any."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    rows = ws.put(usable(vectors).dropDuplicates(["vec_id", "h1", "h2"]), "vectors")
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return None, rows
    rows = rows.where(F.size("v") == length.d)
    first = Over.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    classes = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first(F.when(F.col("n") == 1, F.col("v")), ignorenulls=True).alias("v"))
    classes = ws.put(classes.withColumn("class", F.col("ids")[0]), "classes")
    n = classes.count()
    parts = parts_for(n)
    size = min(n, max(LEAST, PER_PART * parts))
    # A hash picks somewhat more than the sample, so that sorting and cutting it is work of the sample's size.
    pick = F.xxhash64(F.lit(SEED), "h1", "h2")
    share = F.shiftrightunsigned(pick, 11).cast("double") / F.lit(float(1 << 53))
    some = classes.where(share <= min(1.0, 1.2 * size / n + 100 / n)).orderBy(pick, "class").limit(size).select("class", "v")
    some = ws.put(some, "sample").orderBy(F.xxhash64("class"), "class").toArrow().combine_chunks()
    x, ids = _stack(some.column("v").combine_chunks()), some.column("class").to_numpy()
    single = x.astype(np.float32)
    router = Router(single, partition(single, parts), parts)
    seeds = min(SEEDS, n // 16)
    shared = spark.sparkContext.broadcast(router)

    def assign(it):
        for batch in it:
            if batch.num_rows:
                best = shared.value.best(_stack(batch.column("v")), COPIES)
                yield batch.append_column("parts", W.lists(best.ravel(), [best.shape[1]] * len(best), pa.int32()))

    held = classes.select("class", "v").mapInArrow(assign, "class long, v array<double>, parts array<int>").select("class", "v", F.explode("parts").alias("part"))
    placed = ws.put(held.repartitionByRange("part", "class").sortWithinPartitions("part", "class"), "placed")
    index = Index(ws, classes, placed, router, x[:seeds], ids[:seeds], n, parts, k + 1)
    index.probes = index.measure(spark.createDataFrame(some.slice(max(0, len(ids) - MEASURED)))) if parts > 1 else 1
    return index, rows


def search(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row (vec_id, embedding) with is_query its k nearest others found."""
    index, rows = build(vectors, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ws, classes = index.ws, index.classes
    queries = ws.put(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("query_id", "class"), "queries")
    asked = queries.select("class").distinct().join(classes.select("class", "v"), "class")
    found = index.nearest(asked, index.probes)
    best = Over.partitionBy("asked").orderBy("score", "id")
    found = found.join(classes.select("class", "ids"), "class").select("asked", "score", F.explode("ids").alias("id")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    ranked = queries.join(found, F.col("class") == F.col("asked")).where("id <> query_id").withColumn("rank", F.row_number().over(Over.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
