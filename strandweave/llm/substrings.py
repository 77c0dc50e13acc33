"""Operator 6: removal of repeated passages, with a count-min sketch before the exact grouping.

A window is 50 consecutive words of one document.  A window's words are removed
if the same 50 words also start in a document with a smaller doc_id.

Every window holds an anchor: the 25 consecutive words with the smallest hash
among the 26 such runs inside it.  Equal windows have equal anchors, so a window
can be repeated only if its anchor is, and windows side by side mostly share
one: there are a thirteenth as many anchors as words.  The first pass counts
anchors in a count-min sketch for each partition; merging adds them up.  The
second pass groups exactly those anchors that the sketch estimates to occur
twice or more, and then the windows of those that do occur in two documents.
The sketch never underestimates, so no repeated window is lost.  Its size follows
the text up to ``MOST_BITS``; beyond that it grows full, more anchors reach the
exact grouping, up to all of them, and the result is the same.

Window keys have 96 bits, from two independent hashes of the words.

Defined results: a null text has no words; windows of rows without a doc_id
count for nothing and such rows are returned whole; a window repeated inside one
document only stays; rows that repeat a doc_id are judged each by its own text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import Workspace, maybe_in, membership

WINDOW, ANCHOR = 50, 25
#: Rows of the sketch, cells of a row for an anchor, and cells of a row at least and at most (powers of two).
#: A cell counts up to two in two bits; the tasks get the one that says two: 2 * 2**28 cells are 64 MB.
ROWS, CELLS, LEAST_BITS, MOST_BITS = 2, 3, 19, 28
#: Cells of one stored segment of the merged sketch; bytes of text for an anchor, about.
SEGMENT_BITS, PER_ANCHOR = 19, 80


def least_of_each(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive items."""
    out, size = h, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        rest = width - size
        out = np.minimum(out[: len(out) - rest], out[rest:])
    return out


def anchors(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> np.ndarray:
    """The anchor's hash of each window of word hashes h."""
    if len(h) < window:
        return np.empty(0, np.uint64)
    return least_of_each(W.hash_runs(h, anchor), window - anchor + 1)


def cells(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of a sketch of 2**bits cells."""
    return [W.join(a, np.uint64(r)) >> np.uint64(64 - bits) for r in range(ROWS)]


def _note(seen: np.ndarray, again: np.ndarray, where: np.ndarray) -> None:
    """Count cells in two bitmaps: noted once at least, and twice at least."""
    spots, n = np.unique(where.astype(np.int64), return_counts=True)
    byte, bit = spots >> 3, np.left_shift(1, spots & 7).astype(np.uint8)
    more = ((seen[byte] & bit) != 0) | (n > 1)
    np.bitwise_or.at(again, byte[more], bit[more])
    np.bitwise_or.at(seen, byte, bit)


def _sketch(bits: int):
    """Of a whole partition: rows (row, segment, both bitmaps); empty segments are left out."""

    def run(it):
        maps = None
        for batch in W.batches(it):
            h, ends = W.hash_texts(batch.column("text"))
            found = [np.unique(anchors(own)) for own in np.split(h, ends[:-1]) if len(own) >= WINDOW]
            if not found:
                continue
            if maps is None:
                maps = [(np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)) for _ in range(ROWS)]
            for (seen, again), where in zip(maps, cells(np.concatenate(found), bits), strict=True):
                _note(seen, again, where)
        width = 1 << SEGMENT_BITS - 3
        for r, (seen, again) in enumerate(maps or []):
            for s in range(len(seen) // width):
                part = seen[s * width : (s + 1) * width]
                if part.any():
                    yield _segment((r, s), part, again[s * width : (s + 1) * width])

    return W.tidy(run)


def _segment(key, seen: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(level=1).compress
    return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([pack(seen.tobytes())], pa.binary()), pa.array([pack(again.tobytes())], pa.binary())], ["r", "segment", "seen", "again"])


def _bitmap(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), np.uint8)


def _merge(it):
    """Partial sketches in order of segments into one for each segment, one at a time."""
    key, seen, again = None, None, None
    for batch in it:
        for *now, x, y in zip(*(batch.column(c).to_pylist() for c in ("r", "segment", "seen", "again")), strict=True):
            x, y = _bitmap(x), _bitmap(y)
            if now == key:
                again |= y | (seen & x)
                seen |= x
                continue
            if key is not None:
                yield _segment(key, seen, again)
            key, seen, again = now, x.copy(), y.copy()
    if key is not None:
        yield _segment(key, seen, again)


def _repeats(sketch: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Whether the sketch estimates two or more of each key; sketch has a bitmap a row."""
    out = np.ones(len(a), bool)
    for row, where in zip(sketch, cells(a, (sketch.shape[1] << 3).bit_length() - 1), strict=True):
        where = where.astype(np.int64)
        out &= (row[where >> 3] >> (where & 7).astype(np.uint8) & 1) > 0
    return out


def _anchor_runs(shared):
    """Runs of windows with one anchor that may be repeated: (doc_id, at, n, anchor), at being the first window's number."""

    def run(it):
        sketch = shared.value
        for batch in W.batches(it):
            h, ends = W.hash_texts(batch.column("text"))
            out = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), np.split(h, ends[:-1]), strict=True):
                if doc_id is None or not len(a := anchors(own)):
                    continue
                first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                n = np.diff(first, append=len(a))
                maybe = _repeats(sketch, a[first])
                if maybe.any():
                    out.append((doc_id, first[maybe], n[maybe], a[first[maybe]]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([x[0] for x in out], [len(x[1]) for x in out]), pa.int64()), *(pa.array(np.concatenate([x[k] for x in out]).astype(np.int32)) for k in (1, 2)), pa.array(np.concatenate([x[3] for x in out]).view(np.int64))],
                    ["doc_id", "at", "n", "anchor"],
                )

    return run


def _windows(it):
    """Of documents with runs: (doc_id, print, at, key, check) for each window in a run."""
    for batch in W.batches(it):
        codes, ends, names = W.split(batch.column("text"))
        both = W.hash_names(names)
        for own, doc_id, mark, runs in zip(np.split(codes, ends[:-1]), *(batch.column(c).to_pylist() for c in ("doc_id", "print", "runs")), strict=True):
            total = len(own) - WINDOW + 1
            inside = np.zeros(max(total, 0) + 1, np.int64)
            starts = np.array([r["at"] for r in runs], np.int64)
            stops = starts + np.array([r["n"] for r in runs], np.int64)
            ok = stops <= total
            np.add.at(inside, starts[ok], 1)
            np.add.at(inside, stops[ok], -1)
            spots = np.flatnonzero(np.cumsum(inside)[:-1])
            if len(spots):
                key, check = (W.hash_runs(both[own, k], WINDOW)[spots] for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(spots), doc_id, np.int64)), pa.array(np.full(len(spots), mark, np.int64)), pa.array(spots.astype(np.int32)), pa.array(key.view(np.int64)), pa.array((check >> np.uint64(32)).astype(np.uint32).view(np.int32))],
                    ["doc_id", "print", "at", "key", "check"],
                )


def _whole(it):
    for batch in W.batches(it):
        kept = [(len(ws), hashlib.sha256(b" ".join(ws)).hexdigest()) for ws in ((t or b"").split() for t in W.raw(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in kept], pa.int64()), pa.array([0] * len(kept), pa.int64()), pa.array([s for _, s in kept])], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def covered(n: int, starts, window: int = WINDOW) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts."""
    edge = np.zeros(n + window + 1, np.int64)
    starts = np.asarray(starts, np.int64)
    starts = starts[starts + window <= n]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:n] > 0


def _cut(it):
    for batch in W.batches(it):
        rows = []
        for t, starts in zip(W.raw(batch), batch.column("starts").to_pylist(), strict=True):
            ws = (t or b"").split()
            gone = covered(len(ws), starts or [])
            rows.append((len(ws), int(gone.sum()), b" ".join([w for w, g in zip(ws, gone, strict=True) if not g])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows])],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


def sketch_bits(n_bytes: int) -> int:
    """Cells of a row, as a power of two, for so many bytes of text."""
    return min(max((CELLS * n_bytes // PER_ANCHOR).bit_length(), LEAST_BITS), MOST_BITS)


def merged_sketch(ws: Workspace, docs: DataFrame) -> np.ndarray:
    """The corpus's sketch: ROWS bitmaps of the cells that count two or more.

    Its size follows the bytes of text.  A task's partial sketch goes to the
    shared folder in compressed segments; a segment's parts are then added up one
    after the other.  What the driver gets and broadcasts is 64 MB at most.
    """
    bits = sketch_bits(docs.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0)
    kind = "r int, segment int, seen binary, again binary"
    partial = ws.put(docs.select("text").mapInArrow(_sketch(bits), kind), "sketches")
    merged = ws.put(partial.repartition("r", "segment").sortWithinPartitions("r", "segment").mapInArrow(_merge, kind), "sketch")
    ws.drop(partial)
    out = np.zeros((ROWS, 1 << bits - 3), np.uint8)
    width = 1 << SEGMENT_BITS - 3
    for row in merged.select("r", "segment", "again").toLocalIterator():
        out[row.r, row.segment * width : (row.segment + 1) * width] = _bitmap(bytes(row.again))
    return out


def repeated_starts(ws: Workspace, docs: DataFrame) -> DataFrame:
    """(doc_id, print, starts): of each document the first words' numbers of windows that start in an earlier document."""
    shared = docs.sparkSession.sparkContext.broadcast(merged_sketch(ws, docs))
    found = ws.put(docs.select("doc_id", "text").mapInArrow(W.tidy(_anchor_runs(shared)), "doc_id long, at int, n int, anchor long"), "anchors")
    twice = found.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("anchor")
    runs = ws.put(found.join(twice, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("runs")), "runs")
    ws.drop(found)
    some = maybe_in(docs, F.col("doc_id"), membership(runs, "doc_id"))[0].select("doc_id", "print", "text").join(runs, "doc_id")
    windows = ws.put(some.mapInArrow(W.tidy(_windows), "doc_id long, print long, at int, key long, check int"), "windows")
    first = windows.groupBy("key", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key", "check", "low")
    # Written first, so that the join has nothing but exchanges below it and adaptive execution splits a window of very many documents.
    first = ws.put(first, "first")
    later = windows.join(first, ["key", "check"]).where("doc_id > low")
    starts = ws.put(later.groupBy("doc_id", "print").agg(F.collect_set("at").alias("starts")), "starts")
    ws.drop(runs, windows, first)
    return starts


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs (doc_id, text).

    kept_sha256 is the digest of the words left, joined by one space.  Only
    documents that lose words are joined with what they lose; the others are
    digested where they are read.
    """
    ws = Workspace(docs.sparkSession, "substrings")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("print", F.xxhash64("text"))
    starts = repeated_starts(ws, docs)
    maybe, sure = maybe_in(docs, F.col("doc_id"), membership(starts, "doc_id"))
    kind = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    whole = sure.select("doc_id", "text").mapInArrow(W.tidy(_whole), kind)
    cut = maybe.select("doc_id", "print", "text").join(starts, ["doc_id", "print"], "left").select("doc_id", "text", "starts").mapInArrow(W.tidy(_cut), kind)
    return whole.union(cut)
