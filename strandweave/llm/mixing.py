"""Operator 4: mixing sources to target weights, with DataFrame operations only.

Sources share all words by weight; no source gives more than ``MOST`` times what
it has, and what is cut off is shared again by weight.  A source's documents
fall into blocks by hash.  Its target is so many whole passes over its blocks,
then whole blocks in a permuted order, then documents of one more block as far as
they fit: the quota of blocks.  A splitting tree deals the quotas of all sources
out among the output shards: at every node the left half gets a draw without
replacement from the node's blocks, source by source, which is a multivariate
hypergeometric split; a shard's counts become ranges of each source's permuted
blocks, so shards are disjoint and exact.  The mixture's rows lie in their
shard's partition, inside it in the order of a hash.  There are as many shards as
the words taken ask for.

All draws come from hashes of the seed, so reruns agree.  A source of n documents
has about sqrt(n) / 8 blocks, so neither a source's list of blocks nor a block's
list of documents grows with more than the square root, and a small source is one
block, all of whose documents may fill the rest.

Defined results: null text and text without words have size 0 and give no words;
null sources are one source that comes last; rows that are alike in all columns
are alike in what is taken, except that one more of them may fit; an empty table
gives no rows; columns may have any names and types, and a null doc_id is an id
like others.  What grows with the number of sources, and only that, meets in one
task: their sizes, targets and quotas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.runtime import Workspace, columns_of, fresh

WEIGHTS, MOST, SEED = (5.0, 2.0, 1.0), 3.0, 4
#: Words of a shard, about; pieces that a source's rows are dealt out in for joins; rounds of fitting documents of the last block.
SHARD_WORDS, SALTS, ROUNDS = 4_000_000, 16, 6


def words(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source):
    """Never null; sorts as sources do by code point, null last."""
    return F.coalesce(F.concat(F.lit("1"), source), F.lit("2"))


def targets(sizes: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """(key, source_size, n, target) of one row (key, source_size, n) for each source.

    The level at which weights are paid is found over the sources in the order in
    which they reach their limit: it rises as long as limits bind and falls after.
    The rows here are sources, not documents.
    """
    number = F.row_number().over(Over.orderBy("key")) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("limit", F.lit(most) * F.col("source_size"))
    order = Over.orderBy(F.col("limit") / F.col("w"), "key")
    before, after = order.rowsBetween(Over.unboundedPreceding, -1), order.rowsBetween(0, Over.unboundedFollowing)
    all_ = order.rowsBetween(Over.unboundedPreceding, Over.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("w").over(after))
    rows = rows.withColumn("paid", F.max(F.when(F.col("level") * F.col("w") <= F.col("limit"), F.col("level"))).over(all_))
    return rows.select("key", "source_size", "n", F.coalesce(F.least("limit", F.col("paid") * F.col("w")), "limit").alias("target"))


def hypergeometric(total, marked, drawn, u):
    """The number of marked among ``drawn`` of ``total`` items, by inversion of u.

    Outcomes over 12 deviations and 20 from the mean weigh less than a double
    can tell and are not summed.
    """
    t, k, n = (x.cast("double") for x in (total, marked, drawn))
    share = k / F.greatest(t, F.lit(1.0))
    mean = n * share
    reach = 12 * F.sqrt(F.greatest(mean * (1 - share) * (t - n) / F.greatest(t - 1, F.lit(1.0)), F.lit(0.0))) + 20
    low = F.greatest(F.greatest(F.lit(0.0), n - (t - k)), F.floor(mean - reach)).cast("long")
    high = F.least(F.least(k, n), F.ceil(mean + reach)).cast("long")

    def ratio(x):
        return (k - x) * (n - x) / ((x + 1) * F.greatest(t - k - n + x + 1, F.lit(1.0)))

    one = F.lit(1.0)
    whole = F.aggregate(F.sequence(low, high), F.struct(one.alias("w"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a.w * ratio(x)).alias("w"), (a.s + a.w).alias("s")), lambda a: a.s)
    start = F.struct(one.alias("w"), (u * whole).alias("left"), low.alias("pick"))
    return F.aggregate(F.sequence(low, high), start, lambda a, x: F.struct((a.w * ratio(x)).alias("w"), (a.left - a.w).alias("left"), F.when(a.left > 0, x).otherwise(a.pick).alias("pick")), lambda a: a.pick)


def uniform(*parts):
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _deal(level: int, seed: int):
    """A step of the fold over a node's sources: what the left half gets of one more source."""

    def step(a, x):
        # An array of one element holds the draw, as a value that is used twice would be drawn twice.
        drawn = F.array(hypergeometric(a.total, x.quota, a.n, uniform(F.lit(seed), F.lit(level), F.col("node"), x.key)))
        return F.transform(drawn, lambda got: F.struct(F.concat(a.out, F.array(F.struct(x.key.alias("key"), got.alias("quota")))).alias("out"), (a.total - x.quota).alias("total"), (a.n - got).alias("n")))[0]

    return step


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, key, lo, hi): of rows (key, quota), the range of each source's draws that a shard gets.

    A node is one row with a number for each source; its two halves are made
    without a shuffle.
    """
    if shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    node = quotas.where("quota > 0").agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("has")).select(F.lit(0).cast("long").alias("node"), "has")
    none = F.array().cast("array<struct<key:string,quota:bigint>>")
    for level in range(shards.bit_length() - 1):
        node = node.withColumn("total", F.aggregate("has", F.lit(0).cast("long"), lambda s, x: s + x.quota))
        start = F.struct(none.alias("out"), F.col("total"), F.floor((F.col("total") + F.pmod("node", F.lit(2))) / 2).cast("long").alias("n"))
        node = node.withColumn("left", F.aggregate("has", start, _deal(level, seed), lambda a: a.out))
        right = F.zip_with("has", "left", lambda h, g: F.struct(h.key.alias("key"), (h.quota - g.quota).alias("quota")))
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("has")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("has")))
        node = node.select(F.explode(halves).alias("x")).select("x.node", "x.has")
        if level == 6:
            node = node.repartition("node")
    leaves = node.select(F.col("node").cast("int").alias("shard"), F.explode("has").alias("x")).select("shard", "x.key", "x.quota")
    hi = F.sum("quota").over(Over.partitionBy("key").orderBy("shard"))
    return leaves.select("shard", "key", (hi - F.col("quota")).alias("lo"), hi.alias("hi"))


def row_hash(docs: DataFrame):
    """A hash of all columns; those that hold maps go in as JSON, which has no order of its own for them."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns_of(docs), docs.dtypes, strict=True)])


def mix(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """What the mix takes of each row of docs (doc_id, source, text, ...).

    Returns (doc_id, row, size, source_size, target, draws): row is a hash of all
    columns, draws an array of (shard, epoch) with one entry for each time that
    the whole document is taken.  Without a number of shards, a power of two,
    each gets about SHARD_WORDS words.
    """
    return _mix(Workspace(docs.sparkSession, "mixing"), docs, shards, seed)[0]


def _mix(ws: Workspace, docs: DataFrame, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    """What mix() returns, and the number of shards."""
    row = row_hash(docs)
    light = ws.put(docs.select(F.col("doc_id").cast("long"), source_key(F.col("source").cast("string")).alias("key"), words(F.col("text").cast("string")).alias("size"), row.alias("row")), "sizes")
    sizes = targets(light.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sizes = sizes.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumn("n_blocks", F.ceil(F.sqrt("n") / 8).cast("long"))
    sources = ws.put(sizes, "sources")
    if shards is None:
        words_taken = sources.agg(F.sum("target").alias("w")).first().w or 0.0
        shards = 1 << max(0, int(words_taken) // SHARD_WORDS).bit_length()

    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = light.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")
    dealt = ws.put(dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row"), "n_blocks")), "dealt")

    of_source = [F.min(c).alias(c) for c in ("passes", "rest", "n_blocks")]
    blocks = dealt.groupBy("key", "block").agg(F.sum("size").alias("words"), *of_source)
    order = Over.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), F.lit("rest"), "key", "block"), "block")
    blocks = blocks.withColumn("sum", F.sum("words").over(order)).withColumn("place", F.row_number().over(order) - 1)
    kind = F.when(F.col("sum") <= F.col("rest"), "whole").when(F.col("sum") - F.col("words") < F.col("rest"), "part").otherwise("none")
    blocks = ws.put(blocks.withColumn("last", kind), "blocks")

    # Documents of the block that the rest ends in: a permuted run of them, then in several rounds the largest that still fit.
    part = blocks.where("last = 'part'").select("key", "block", (F.col("rest") - F.col("sum") + F.col("words")).alias("room"))
    tried = dealt.select("key", "block", "doc_id", "row", "size").join(part, ["key", "block"])
    one, run = Over.partitionBy("key"), Over.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "row"), "doc_id", "row", "copy")
    tried = tried.withColumn("copy", F.row_number().over(Over.partitionBy("key", "doc_id", "row").orderBy("size"))).withColumn("fits", F.lit(False))
    largest = Over.partitionBy("key").orderBy(F.desc("size"), F.xxhash64(F.lit(seed), "row"), "doc_id", "row", "copy")
    run, largest = (x.rowsBetween(Over.unboundedPreceding, Over.currentRow) for x in (run, largest))
    for turn in range(ROUNDS):
        tried = tried.withColumn("can", ~F.col("fits") & (F.col("size") <= F.col("room")))
        tried = tried.withColumn("now", F.col("can") & (F.sum(F.when(F.col("can"), F.col("size")).otherwise(0)).over(largest if turn else run) <= F.col("room")))
        tried = tried.withColumn("room", F.col("room") - F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).over(one)).withColumn("fits", F.col("fits") | F.col("now"))
    fitted = ws.put(tried.where("fits").groupBy("key", "doc_id", "row").agg(F.count("*").alias("n_fit")), "fitted")

    # Every draw of a block has a rank in its source: the passes, each in an order of its own, then the rest.
    epochs = blocks.withColumn("epoch", F.explode(F.expr("sequence(0L, passes)"))).where("epoch < passes OR last <> 'none'")
    own = Over.partitionBy("key").orderBy("epoch", F.when(F.col("epoch") < F.col("passes"), F.xxhash64(F.lit(seed), F.lit("pass"), "epoch", "key", "block")).otherwise(F.col("place").cast("long")), "block")
    draws = ws.put(epochs.withColumn("rank", (F.row_number().over(own) - 1).cast("long")).select("key", "block", "epoch", "passes", "rank"), "draws")
    tree = splitting_tree(draws.groupBy("key").agg(F.count("*").alias("quota")), shards, seed)
    ranks = tree.where("lo < hi").select("shard", "key", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("rank"))
    given = draws.join(ranks, ["key", "rank"]).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("epoch", "shard"))).alias("block_draws"))
    given = blocks.select("key", "block", "last").join(given, ["key", "block"], "left")

    many = Over.partitionBy("key", "doc_id", "row").orderBy("size")
    out = dealt.join(given, ["key", "block"]).join(fitted, ["key", "doc_id", "row"], "left")
    out = out.withColumn("ends", (F.col("last") == "whole") | (F.coalesce("n_fit", F.lit(0)) >= F.row_number().over(many)))
    took = F.filter(F.coalesce("block_draws", F.array().cast("array<struct<epoch:bigint,shard:int>>")), lambda d: (d.epoch < F.col("passes")) | F.col("ends"))
    return out.select("doc_id", "row", "size", "source_size", "target", took.alias("draws")), shards


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda d: d.shard).alias("shards"))


def mixed_rows(docs: DataFrame, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """The mixture: each row of docs as often as it is taken, with its columns; a partition is a shard, in the shard's own order."""
    spark = docs.sparkSession
    ws, out = Workspace(spark, "mixing"), Workspace(spark, "mixture")
    taken, shards = _mix(ws, docs, shards, seed)
    taken = out.put(taken.where("size(draws) > 0").select("doc_id", "row", "draws"), "draws")
    ws.clear()
    own, i, r, w, d = fresh(docs.columns, "own", "id", "row", "draws", "draw")
    once = docs.select(*columns_of(docs), row_hash(docs).alias(own)).dropDuplicates(["doc_id", own])
    rows = once.join(taken.select(F.col("doc_id").alias(i), F.col("row").alias(r), F.col("draws").alias(w)), F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(r)))
    rows = rows.withColumn(d, F.explode(w)).repartitionById(shards, F.col(d)["shard"])
    return rows.sortWithinPartitions(F.xxhash64(F.lit(seed), F.col(d)["shard"], F.col(d)["epoch"], own), F.col(d)["epoch"]).select(*columns_of(docs))
