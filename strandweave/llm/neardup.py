"""Operator 1: near-duplicate documents by min-max hashing.

Each of 96 permutations of the 32-bit integers gives two signature values, the
smallest and the largest image of a document's shingles, so 192 values cost 96
evaluations a shingle.  Four values (both ends of two permutations) form a
band; documents with one of the 48 bands in common are candidates.  At a similarity of exactly 0.75 the chance that two documents
share no band is (1 - 0.75**4)**48 = 1.2e-8 if the sets are large, and 1.6e-8 for
the smallest sets that bands decide on.

Sets of up to ``SMALL`` shingles need no luck: of two such sets that reach 0.75
either has a shared shingle among its n // 4 + 1 rarest ones, so those are their
keys in place of bands; shingles of one document only are no keys.  Sets up to a
third larger have both kinds of keys, so that a pair across the border is found.

Equal shingle sets fall into one class first.  In every bucket the members are
then compared with one leader only, the member that shares most buckets with
others.  Components of the confirmed links follow.  Only members of different
components that still share a bucket may be compared with each other, and of
those only pairs that could reach the limit: two documents have at most as many
shingles in common as either has shingles that occur elsewhere among the open
documents.  That bound is exact; so is the one on sizes.  A pair is also passed
over if sketches of two bits each of 1,024 further signature values differ in more
than 270 places, where the limit gives 192 with a deviation of 12.5 (a chance of
1e-9; small sets have no such test), and it is made in the first of its buckets
only.  A bucket of thousands of copies so costs
thousands of comparisons, and no link between different components is lost.
Every link is confirmed on the full shingle sets.

Defined results: null or empty text has no shingles and links with nothing; a
text of fewer than five words is one shingle; rows that repeat a doc_id share
its component, each linked by its own text; a null doc_id gets a null component
and is kept; an empty table gives no rows.  ``keep_one`` returns the columns of
its input whatever their names; of rows that repeat a doc_id and its text it
keeps one, and all rows without a doc_id or without words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import Workspace, columns_of, connected_components, fresh, maybe_in, membership

#: Permutations that make bands, and those of the sketches of documents that are compared once more.
SHINGLE, BANDED, SKETCHED, PER_BAND = 5, 96, 512, 2
BANDS, LONGS = BANDED // PER_BAND, SKETCHED * 2 // 32
#: Of a sketch's 1,024 places, 192 differ on average at similarity 0.75; beyond so many a pair isn't compared.
PLACES = 270
#: Shingles of a set that is found by its rarest ones, and of one that may be its partner.
SMALL = 48
PARTNER = SMALL * 4 // 3
_rng = np.random.default_rng(20260101)
FLIP = _rng.integers(0, 1 << 32, BANDED + SKETCHED, dtype=np.uint32)
TIMES = _rng.integers(0, 1 << 31, BANDED + SKETCHED, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (string or null)."""
    h, ends = W.hash_texts(pc.ascii_lower(texts))
    out, at = [], 0
    for end in ends.tolist():
        own, at = h[at:end], end
        out.append(np.unique(W.hash_runs(own, min(SHINGLE, len(own)))) if len(own) else own)
    return out


def signatures(sets: list[np.ndarray], permutations=range(BANDED)) -> np.ndarray:
    """(documents, permutations, 2) of smallest and largest images; each set has an element at least."""
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), len(permutations), 2), np.uint32)
    for i, k in enumerate(permutations):
        y = (x ^ FLIP[k]) * TIMES[k]
        out[:, i, 0] = np.minimum.reduceat(y, at)
        out[:, i, 1] = np.maximum.reduceat(y, at)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; the band's number is part of the key."""
    v = sig.reshape(len(sig), BANDS, 2 * PER_BAND).astype(np.uint64)
    key = np.broadcast_to(SALT, v.shape[:2]).copy()
    for j in range(v.shape[2]):
        key = W.mix(key * np.uint64(W.STEP) + v[:, :, j])
    return key.view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, LONGS) longs with two bits of each value of the further permutations."""
    sig = signatures(sets, range(BANDED, BANDED + SKETCHED))
    v = ((sig.reshape(len(sets), LONGS, 32) * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64)
    return (v << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sign(it):
    for batch in W.batches(it, limit=2 << 20):
        sets = shingle_sets(batch.column("text"))
        large = [i for i, s in enumerate(sets) if len(s) > SMALL]
        b = [np.empty(0, np.int64)] * len(sets)
        if large:
            for i, keys in zip(large, bands(signatures([sets[i] for i in large])), strict=True):
                b[i] = keys
        few = [x.view(np.int64) if len(x) <= PARTNER else x[:0].view(np.int64) for x in sets]
        prints = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), W.lists(np.concatenate(b), [len(x) for x in b]), W.lists(np.concatenate(few), [len(x) for x in few])],
            ["doc_id", "n_shingles", "fp1", "fp2", "bands", "few"],
        )


def _sets(it):
    for batch in W.batches(it):
        sets = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), W.lists(np.concatenate(sets).view(np.int64), [len(s) for s in sets])], ["id", "items"])


def _sketched(it):
    """Rows (id, items) with sig, the sketch of the items."""
    for batch in it:
        for own in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
            items = own.column("items")
            ends = np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False))
            s = sketches(np.split(items.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends[:-1]))
            yield own.append_column("sig", W.lists(s.ravel(), [LONGS] * len(s)))


def rarest(ws: Workspace, reps: DataFrame) -> DataFrame:
    """(doc_id, key) of sets (doc_id, few): of each the n // 4 + 1 shingles that the fewest of them hold, without those that only one holds.

    Items that several sets hold are written by themselves, so that adaptive
    execution splits the rows of a very frequent one.
    """
    held = reps.where("size(few) > 0").select("doc_id", F.size("few").alias("n"), F.explode("few").alias("item"))
    often = ws.put(held.groupBy("item").agg(F.count("*").alias("n_docs")).where("n_docs > 1"), "items")
    shared = ws.put(held.join(often, "item").select("doc_id", "n", "n_docs", "item"), "shared")
    of_doc = shared.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("n_docs", "item"))).alias("has"))
    # The shingles of one document only come first and take their places.
    room = F.floor(F.col("n") / 4).cast("int") + 1 - (F.col("n") - F.size("has"))
    keys = of_doc.where(room > 0).select("doc_id", F.explode(F.slice("has", F.lit(1), room)).alias("x"))
    return keys.select("doc_id", F.xxhash64(F.lit("rare"), "x.item").alias("key"))


def sets_of(ws: Workspace, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, items) of the documents in ids (id); texts stay where they are read. A repeated doc_id has a row for each of its sets."""
    some, _ = maybe_in(docs.select("doc_id", "text"), F.col("doc_id"), membership(ids, "id"))
    return ws.put(some.mapInArrow(W.tidy(_sets), "id long, items array<long>").where("size(items) > 0").join(ids, "id", "left_semi").dropDuplicates(["id", "items"]), "sets")


def confirm(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) those with 100 * intersection >= 75 * union, on full sets (id, items).

    ``a`` may occur in very many pairs; both joins have nothing but the join
    above their exchanges, so that adaptive execution splits such a key.
    """
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return right.join(sets.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").where(100 * common >= 75 * (F.size("x") + F.size("y") - common)).select("a", "b")


def near_duplicates(docs: DataFrame, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, n_copies) for each row of docs (doc_id, text).

    class_id is the smallest doc_id with the same shingle set and n_copies the
    number of rows with it.
    """
    spark = docs.sparkSession
    ws = ws or Workspace(spark, "neardup")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = ws.put(docs.mapInArrow(W.tidy(_sign), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, few array<long>"), "signed")
    linked = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = linked.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    classes = ws.put(classes, "classes")
    reps = ws.put(linked.join(classes, ["fp1", "fp2"]).where("doc_id = class_id").select("doc_id", "n_shingles", "bands", "few"), "representatives")

    keys = reps.select("doc_id", F.explode("bands").alias("key")).union(rarest(ws, reps)).distinct()
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    buckets = ws.put(keys.join(shared, "key"), "buckets")
    weight = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    weighed = ws.put(buckets.join(weight, "doc_id").select("key", "doc_id", "weight"), "buckets")
    leader = weighed.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("id"))).alias("first")).select("key", (-F.col("first.id")).alias("a"))
    first = ws.put(weighed.join(leader, "key").where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    ids = first.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    links = ws.put(confirm(sets_of(ws, docs, ids), first), "links")
    parts = ws.put(connected_components(ws, links), "components")

    placed = buckets.join(parts, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("part"))
    placed = ws.put(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    open_ = ws.put(placed.join(mixed, "key", "left_semi"), "open")
    sets = sets_of(ws, docs, open_.select(F.col("doc_id").alias("id")).distinct())
    own = sets.select("id", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    able = sets.select("id", "items", F.size("items").alias("n")).join(own, "id", "left").select("id", "items", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"), "n").where("100 * common >= 75 * n")
    keys_of = open_.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("key").alias("keys"))
    able = able.mapInArrow(W.tidy(_sketched), "id long, items array<long>, common long, n int, sig array<long>").drop("items")
    able = ws.put(able.join(keys_of, "id"), "able")
    near_ = open_.join(able, F.col("doc_id") == F.col("id"))
    x, y = near_.alias("x"), near_.alias("y")
    ones = F.lit(0x5555555555555555)
    differ = sum((F.bit_count(z.bitwiseOR(F.shiftright(z, 1)).bitwiseAND(ones)) for z in (F.col("x.sig")[i].bitwiseXOR(F.col("y.sig")[i]) for i in range(LONGS))), F.lit(0))
    near = (
        (F.col("x.key") == F.col("y.key")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.part") != F.col("y.part"))
        & (100 * F.least("x.n", "y.n") >= 75 * F.greatest("x.n", "y.n")) & (7 * F.least("x.common", "y.common") >= 3 * (F.col("x.n") + F.col("y.n"))) & ((F.least("x.n", "y.n") <= SMALL) | (differ <= PLACES)) & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    )
    second = ws.put(x.join(y, near).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"), F.col("x.part").alias("p"), F.col("y.part").alias("q")), "pairs")
    more = ws.put(confirm(sets, second.select("a", "b")).join(second, ["a", "b"]).select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "links")
    # The second links join whole components.
    if not more.isEmpty():
        joined = connected_components(ws, more).select(F.col("node").alias("part"), F.col("component").alias("whole"))
        lone = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("component"))
        parts = parts.union(lone).join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("whole", "component").alias("component"))
        parts = ws.put(parts, "components")

    of_class = classes.join(parts, F.col("class_id") == F.col("node"), "left").select("fp1", "fp2", "class_id", "n_copies", F.coalesce("component", "class_id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "fp1", "fp2").join(of_class, ["fp1", "fp2"], "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    own = out.select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
    )
    return own.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id", "n_copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each component and one row of each repeated document.

    Texts move only for the documents that a membership filter can't clear.
    """
    ws, inner = (Workspace(docs.sparkSession, name) for name in ("keepone", "neardup"))
    found = ws.put(near_duplicates(docs, inner).select("doc_id", "kept", "n_copies"), "found")
    inner.clear()
    gone = ws.put(found.where("NOT kept").select("doc_id").distinct(), "gone")
    again = found.where("kept AND n_copies > 1").groupBy("doc_id").count().where("count > 1").select("doc_id")
    suspects = ws.put(gone.withColumn("gone", F.lit(True)).union(again.withColumn("gone", F.lit(False))), "suspects")
    maybe, sure = maybe_in(docs, F.col("doc_id").cast("long"), membership(suspects, "doc_id"))
    own, out = fresh(docs.columns, "own", "out")
    rest = maybe.join(suspects.select(F.col("doc_id").alias(own), F.col("gone").alias(out)), F.col("doc_id").cast("long") == F.col(own), "left")
    clear = rest.where(F.col(own).isNull()).select(*columns_of(docs))
    once = rest.where(~F.col(out)).select(*columns_of(docs)).dropDuplicates(["doc_id", "text"])
    return sure.unionByName(clear).unionByName(once)
