"""Longest chains that queries share with paths, and how often paths have them, without pairs.

A walk is a path or a query's chain in one row: its nodes and the gap before
each.  A chain of any length within a walk has a key of 128 bits, from prefix sums,
the same wherever the chain stands.  Paths are read where they lie: what a filter
of bounded size lets pass is counted key by key before anything is shuffled, so
there are as many rows as different chains that both sides have, however often
either has them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.runtime import Workspace

#: Bits of a filter (16 MB), bytes of the pieces it is put together from, visits worked on at once, keys held before they are counted.
BITS, CHUNK, VISITS, HELD = 27, 1 << 16, 1 << 18, 1 << 21
_BASES, _SALTS = (0x9E6C63D0876A9A47, 0xD1342543DE82EF95), (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_powers: list = [np.ones(1, np.uint64)] * 4


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _raised(n: int) -> list:
    """The first n powers of both bases and of their inverses modulo 2^64."""
    if len(_powers[0]) < n:
        for k, base in enumerate([*_BASES, *(pow(b, -1, 1 << 64) for b in _BASES)]):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


class Walks:
    """Walks one behind the other: nodes, the gap before each, and the walks' lengths."""

    def __init__(self, nodes: np.ndarray, gaps: np.ndarray, lengths: np.ndarray):
        n = len(nodes)
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
        self.gap, self.sums, self.back = [], [], []
        for k, salt in enumerate(_SALTS):
            node = _mixed(nodes.astype(np.int64).view(np.uint64) * np.uint64(salt) + np.uint64(1))
            gap = _mixed(gaps.astype(np.int64).view(np.uint64) * np.uint64(salt) + np.uint64(salt >> 1))
            power = _raised(n)
            self.gap.append(gap)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum((node + gap) * power[k][:n], dtype=np.uint64)]))
            self.back.append(power[k + 2][:n])

    def keys(self, at: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the keys of the chains of ``length`` visits from places; the gap before the first does not count."""
        size = np.atleast_1d(length).astype(np.uint64)
        return tuple(_mixed((s[at + length] - s[at]) * b[at] - g[at] + size * np.uint64(salt)) for s, b, g, salt in zip(self.sums, self.back, self.gap, _SALTS, strict=True))


def _bit(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = half >> np.uint64(64 - BITS)
    return (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def _among(bits: np.ndarray, keys: tuple) -> np.ndarray:
    """Whether a filter may hold keys."""
    (a, x), (b, y) = map(_bit, keys)
    return (bits[a] >> x & bits[b] >> y & 1).astype(bool)


def _bytes(shared) -> np.ndarray | None:
    return None if shared is None else np.frombuffer(shared.value, np.uint8)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], list(columns))


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, gaps, lengths) of rows' walks."""
    return part.column("nodes").flatten().to_numpy(), part.column("gaps").flatten().to_numpy(), np.diff(part.column("nodes").offsets.to_numpy())


def _pieces(it):
    """Some rows at a time: about VISITS visits, and one row at least."""
    for batch in it:
        sizes = np.diff(batch.column("nodes").offsets.to_numpy())
        group = (np.cumsum(sizes) - sizes) // VISITS
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)] if len(sizes) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def _levels(walks: Walks, bits: np.ndarray | None):
    """(length, places, keys): chains of 1, 2, 4, ... visits as far as the filter has them and both their halves."""
    size, at = 1, np.arange(len(walks.left))
    while len(at):
        keys = walks.keys(at, size)
        if bits is not None:
            ok = _among(bits, keys)
            at, keys = at[ok], tuple(k[ok] for k in keys)
        yield size, at, keys
        there = np.zeros(len(walks.left) + size, bool)
        there[at] = True
        at = at[there[at + size] & (walks.left[at] >= 2 * size)]
        size *= 2


def _counted(found):
    """Batches (h, g, n) of keys (h, g), each counted as far as they are held together."""

    def once(h, g, n):
        order = np.argsort(h)
        h, g, n = h[order], g[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
        return h[new], g[new], np.add.reduceat(n, new)

    def batch(h, g, n):
        return _batch(h=h.view(np.int64), g=g.view(np.int64), n=n)

    parts, held = [], 0
    for h, g in found:
        parts.append((h, g, np.ones(len(h), np.int64)))
        held += len(h)
        if held > HELD:
            parts = [once(*map(np.concatenate, zip(*parts, strict=True)))]
            held = len(parts[0][0])
            if held > HELD // 2:
                yield batch(*parts[0])
                parts, held = [], 0
    if held:
        yield batch(*once(*map(np.concatenate, zip(*parts, strict=True))))


def _filter(rows: DataFrame, keys) -> tuple:
    """(broadcast filter, lengths) of what ``keys`` yields, (length, keys), from an iterator of rows' batches."""

    def mark(it):
        bits, lengths = np.zeros(1 << BITS - 3, np.uint8), set()
        for length, pair in keys(it):
            lengths.update(np.unique(length).tolist())
            for half in pair:
                at, bit = _bit(half)
                np.bitwise_or.at(bits, at, np.left_shift(np.uint8(1), bit))
        some = [k for k in range(0, len(bits), CHUNK) if bits[k : k + CHUNK].any()]
        for k in some:
            yield _batch(k=[k], bits=[bits[k : k + CHUNK].tobytes()])
        for m in lengths:
            yield _batch(k=[-m - 1], bits=[bytes(1)])

    def merge(table):
        out = np.frombuffer(table.column("bits")[0].as_py(), np.uint8).copy()
        for x in table.column("bits")[1:]:
            out |= np.frombuffer(x.as_py(), np.uint8)
        return pa.table({"k": table.column("k")[:1], "bits": pa.array([out.tobytes()], pa.binary())})

    out, lengths = bytearray(1 << BITS - 3), []
    for r in rows.mapInArrow(mark, "k long, bits binary").groupBy("k").applyInArrow(merge, "k long, bits binary").toLocalIterator():
        if r.k < 0:
            lengths.append(-r.k - 1)
        else:
            out[r.k : r.k + CHUNK] = r.bits
    return rows.sparkSession.sparkContext.broadcast(bytes(out)), sorted(lengths)


def _doubled(part: pa.RecordBatch) -> tuple[Walks, np.ndarray, np.ndarray]:
    """(walks, row, start) of queries' chains on both strands: each row's chain, and behind all those the chains walked backwards."""
    nodes, gaps, sizes = _lists(part)
    # Walked backwards as a whole, the rows' order turns too; the gap before a visit is then the one that stood behind it.
    turned = np.concatenate([gaps[1:], np.zeros(min(1, len(gaps)), gaps.dtype)])[::-1]
    both = np.concatenate([sizes, sizes[::-1]])
    return Walks(np.concatenate([nodes, -nodes[::-1]]), np.concatenate([gaps, turned]), both), np.concatenate([np.arange(len(sizes)), np.arange(len(sizes))[::-1]]), np.cumsum(both) - both


def _best(part: pa.RecordBatch, row: np.ndarray, start: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(length, count) of the longest chain known from each place; 0 where none is."""
    hits = part.column("hits")
    of = np.repeat(np.arange(len(part)), np.diff(hits.offsets.to_numpy()))
    flat = hits.flatten()
    at, size, n = (flat.field(k).to_numpy() for k in range(3))
    k = len(part)
    place = np.where(at >= 0, start[of] + at, start[2 * k - 1 - of] - at - 1)
    order = np.lexsort((size, place))
    length, count = np.zeros(total, np.int64), np.zeros(total, np.int64)
    length[place[order]], count[place[order]] = size[order], n[order]
    return length, count


def _tests(step: int, bits: np.ndarray | None):
    """A function from pieces of queries to (part, place's row and number, length, keys) that are to be looked for; step 0: all powers of two."""

    def of(part):
        walks, row, start = _doubled(part)
        if not step:
            for size, at, keys in _levels(walks, bits):
                yield walks, row, start, at, np.full(len(at), size, np.int64), keys
            return
        length, _ = _best(part, row, start, len(walks.left))
        at = np.flatnonzero((length >= 2 * step) & (walks.left >= length + step))
        size = length[at] + step
        keys = walks.keys(at, size)
        if bits is not None:
            ok = _among(bits, keys)
            at, size, keys = at[ok], size[ok], tuple(k[ok] for k in keys)
        yield walks, row, start, at, size, keys

    return of


def _round(ws: Workspace, queries: DataFrame, paths: DataFrame, step: int, levels) -> tuple:
    """(hits (q, at, len, n), filter of what paths have): one look at all paths for the chains that queries ask for now."""
    def asked(it):
        for part in _pieces(it):
            for *_, size, keys in _tests(step, None)(part):
                yield size, keys

    wanted, lengths = _filter(queries, asked)

    def there(it):
        bits, known = _bytes(wanted), _bytes(levels)
        for part in _pieces(it):
            walks = Walks(*_lists(part))
            if not step:
                for _, _, keys in _levels(walks, bits):
                    yield keys
                continue
            for low, at, _ in _levels(walks, known):
                for m in lengths:
                    if low <= m < 2 * low:
                        some = at[walks.left[at] >= m]
                        keys = walks.keys(some, m)
                        ok = _among(bits, keys)
                        yield tuple(k[ok] for k in keys)

    found = ws.put(paths.mapInArrow(lambda it: _counted(there(it)), "h long, g long, n long").groupBy("h", "g").agg(F.sum("n").alias("n")), "found")

    def own(it):
        for batch in it:
            yield 1, [batch.column(c).to_numpy().view(np.uint64) for c in ("h", "g")]

    held, _ = _filter(found, own)
    wanted.destroy()

    def looked(it):
        bits = _bytes(held)
        for part in _pieces(it):
            ids = part.column("q").to_numpy()
            for walks, row, start, at, size, keys in _tests(step, bits)(part):
                k = np.searchsorted(start, at, "right") - 1
                c = at - start[k]
                yield _batch(q=ids[row[k]], at=np.where(k < len(part), c, -c - 1).astype(np.int32), len=size.astype(np.int32), h=keys[0].view(np.int64), g=keys[1].view(np.int64))

    hits = ws.put(queries.mapInArrow(looked, "q long, at int, len int, h long, g long").join(found, ["h", "g"]).select("q", "at", "len", "n"), "hits")
    ws.drop(found)
    return hits, held


def longest(ws: Workspace, queries: DataFrame, paths: DataFrame) -> DataFrame:
    """queries (q, nodes, gaps) with hits, an array of (at, len, n): the chains that paths (nodes, gaps) have too.

    at is a place of the chain, or -1 - place of the chain walked backwards; the
    longest chain from there has len visits and stands n times in the paths.  Chains
    of 1, 2, 4, ... visits are looked for together; then one look for each smaller
    power of two adds it to what is known, as far as that goes on.
    """
    def state(rows):
        return queries.join(rows.groupBy("q").agg(F.collect_list(F.struct("at", "len", "n")).alias("hits")), "q")

    all_hits, levels = _round(ws, queries, paths, 0, None)
    step = (all_hits.agg(F.max("len").alias("m")).first().m or 1) // 2
    while step:
        more, held = _round(ws, ws.put(state(all_hits), "state"), paths, step, levels)
        held.destroy()
        all_hits = all_hits.unionByName(more)
        step //= 2
    levels.destroy()
    return state(all_hits)


def maximal(found: DataFrame) -> DataFrame:
    """(query, blk, first, last, count) of ``longest``'s rows: its chains of both strands that are in no longer one."""

    def run(it):
        for part in _pieces(it):
            walks, row, start = _doubled(part)
            length, count = _best(part, row, start, len(walks.left))
            at = np.flatnonzero(length)
            k = np.searchsorted(start, at, "right") - 1
            c, size = at - start[k], length[at]
            of, total = row[k], np.diff(part.column("nodes").offsets.to_numpy())
            first = np.where(k < len(part), c, total[of] - c - size)
            last = first + size - 1
            order = np.lexsort((-last, first, of))
            of, first, last, n = of[order], first[order], last[order], count[at][order]
            if not len(of):
                continue
            new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])]))
            of, first, last, n = of[new], first[new], last[new], np.add.reduceat(n, new)
            # Ends of later rows lie beyond those of all rows before, so that one running maximum serves all.
            beyond = of * (int(total.max()) + 1) + last
            reach = np.concatenate([[-1], np.maximum.accumulate(beyond)[:-1]])
            ok = beyond > reach
            yield _batch(query=part.column("query").to_numpy()[of[ok]], blk=part.column("blk").to_numpy()[of[ok]], first=first[ok], last=last[ok], count=n[ok])

    return found.select("query", "blk", "nodes", "gaps", "hits").mapInArrow(run, "query long, blk long, first long, last long, count long")
