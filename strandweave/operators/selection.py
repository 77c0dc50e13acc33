"""Which k-mers of a sequence are kept: all, syncmers, minimizers or modimizers.

Every sequence is worked on where it lies, in numpy over Arrow batches; nothing
is shuffled and rows come out only for what is selected.  Long sequences are cut
into overlapping pieces, so a task holds a bounded number of hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.params import SampleParams

#: Bases worked on at once.
PIECE = 1 << 21
_code = np.zeros(256, np.uint8)
_code[list(b"acgt")] = np.arange(4)


#: What ``dna.clean`` does to bytes: N is a, and all but bases goes.
_BASES = bytes.maketrans(b"ACGTNn", b"acgtaa")
_OTHER = bytes(sorted(set(range(256)) - set(b"ACGTNacgtn")))


def clean(texts: DataFrame) -> DataFrame:
    """(seq_ord, source, seq, len) of texts (seq_ord, source, text): their bases, as ``dna.clean`` has them, in far less time."""

    def run(it):
        for batch in it:
            seqs = [None if t is None else t.translate(_BASES, _OTHER) for t in pc.cast(batch.column("text"), pa.binary()).to_pylist()]
            lengths = pa.array([None if s is None else len(s) for s in seqs], pa.int64())
            yield _table({"seq_ord": batch.column("seq_ord"), "source": batch.column("source"), "seq": pc.cast(pa.array(seqs, pa.binary()), pa.string()), "len": lengths})

    return texts.select(F.col("seq_ord").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(run, "seq_ord long, source string, seq string, len long")


def codes(seq: bytes) -> np.ndarray:
    return _code[np.frombuffer(seq, np.uint8)]


def numbers(c: np.ndarray, k: int) -> np.ndarray:
    """The k-mers at all places, two bits a base."""
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, size, out, have = c.astype(np.uint64), 1, None, 0
    while True:
        if k & size:
            part = run[have : have + n]
            out = part if out is None else (out << np.uint64(2 * size)) | part
            have += size
        if have == k:
            return out
        run = (run[:-size] << np.uint64(2 * size)) | run[size:]
        size *= 2


def hashes(c: np.ndarray, p: SampleParams) -> tuple[np.ndarray, np.ndarray]:
    """(hash, is_forward) of the k-mers at all places; the hash is the smaller of both strands'."""
    shift, factor = np.uint64(64 - 2 * p.k), np.uint64(p.factor)
    forward = numbers(c, p.k) * factor >> shift
    back = (numbers((3 - c)[::-1], p.k) * factor >> shift)[::-1]
    return np.minimum(forward, back), forward < back


def window_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive hashes."""
    if len(h) < width:
        return h[:0]
    size = 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def syncmer_places(c: np.ndarray, p: SampleParams) -> np.ndarray:
    """Places at which the smallest hash of w + 1 k-mers is at either end; the window at the very end isn't looked at."""
    h, _ = hashes(c, p)
    low = window_minimum(h, p.w + 1)
    n = max(0, min(len(low), len(c) - p.length))
    return np.flatnonzero((h[:n] == low[:n]) | (h[p.w : p.w + n] == low[:n]))


def minimizer_places(c: np.ndarray, p: SampleParams) -> np.ndarray:
    """The leftmost smallest hash of each window of w k-mers, each place once."""
    h, _ = hashes(c, p)
    keyed = (h << np.uint64(32)) | np.arange(len(h), dtype=np.uint64) if p.k <= 16 else None
    if keyed is not None:
        return np.unique(window_minimum(keyed, p.w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    low = window_minimum(h, p.w)
    return np.unique([i + int(np.flatnonzero(h[i : i + p.w] == low[i])[0]) for i in range(len(low))]).astype(np.int64)


def _pieces(n: int, overlap: int):
    """(start, stop) of pieces of a sequence of n bases that share ``overlap`` bases."""
    start = 0
    while True:
        stop = min(n, start + PIECE + overlap)
        yield start, stop
        if stop == n:
            return
        start += PIECE


def _rows(batch):
    ids = batch.column("seq_ord").to_pylist()
    for i, seq in zip(ids, pc.cast(batch.column("seq"), pa.binary()).to_pylist(), strict=True):
        if seq:
            yield i, codes(seq)


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _gather(found, kinds):
    """Batches of about a million rows from (seq_ord, arrays) tuples."""
    ids, parts, n = [], [], 0
    for i, *arrays in found:
        ids.append(np.full(len(arrays[0]), i, np.int64))
        parts.append(arrays)
        n += len(arrays[0])
        if n > 1 << 19:
            yield _table({"seq_ord": pa.array(np.concatenate(ids)), **{name: pa.array(np.concatenate(x), kind) for (name, kind), x in zip(kinds.items(), zip(*parts, strict=True), strict=True)}})
            ids, parts, n = [], [], 0
    if n:
        yield _table({"seq_ord": pa.array(np.concatenate(ids)), **{name: pa.array(np.concatenate(x), kind) for (name, kind), x in zip(kinds.items(), zip(*parts, strict=True), strict=True)}})


def kmers(seqs: DataFrame, p: SampleParams) -> DataFrame:
    """(seq_ord, pos, kmer, hash, is_forward) of every k-mer of seqs (seq_ord, seq)."""

    def found(it):
        for batch in it:
            for i, c in _rows(batch):
                for a, b in _pieces(len(c), p.k - 1):
                    h, f = hashes(c[a:b], p)
                    if len(h):
                        yield i, np.arange(a, a + len(h)), numbers(c[a:b], p.k), h, f

    def run(it):
        yield from _gather(found(it), {"pos": pa.int64(), "kmer": pa.int64(), "hash": pa.int64(), "is_forward": pa.bool_()})

    return seqs.select("seq_ord", "seq").mapInArrow(run, "seq_ord long, pos long, kmer long, hash long, is_forward boolean")


def _pack(c: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Packed fragments, a row of bytes for each place."""
    size = -(-length // 4)
    filled = np.concatenate([c, np.zeros(4 * size, np.uint8)])
    four = filled[:-3] << 6 | filled[1:-2] << 4 | filled[2:-1] << 2 | filled[3:]
    out = four[places[:, None] + 4 * np.arange(size)]
    if length % 4:
        out[:, -1] &= 0xFF << 2 * (4 - length % 4) & 0xFF
    return np.ascontiguousarray(out)


def fragments(c: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(canonical packed, orientation 1 or -1, homopolymer) of the fragments at places."""
    there, back = _pack(c, places, length), _pack((3 - c)[::-1], len(c) - places - length, length)
    differ = there != back
    at = differ.argmax(1)
    rows = np.arange(len(places))
    forward = there[rows, at] < back[rows, at]
    changes = np.concatenate([[0], np.cumsum(c[1:] != c[:-1])])
    poly = changes[places + length - 1] == changes[places]
    return np.where(forward[:, None], there, back), np.where(forward, 1, -1).astype(np.int32), poly


def _binary(rows: np.ndarray) -> pa.Array:
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * size).tobytes()), pa.py_buffer(rows.tobytes())])


def syncmers(seqs: DataFrame, p: SampleParams) -> DataFrame:
    """(seq_ord, pos, canon, orient, poly): the closed syncmers of seqs (seq_ord, seq); canon is packed."""

    def run(it):
        for batch in it:
            ids, places, rows, orient, poly, n = [], [], [], [], [], 0
            for i, c in _rows(batch):
                for a, b in _pieces(len(c), p.length):
                    own = c[a:b]
                    at = syncmer_places(own, p)
                    if not len(at):
                        continue
                    canon, o, x = fragments(own, at, p.length)
                    ids.append(np.full(len(at), i, np.int64))
                    places.append(at + a)
                    rows.append(canon)
                    orient.append(o)
                    poly.append(x)
                    n += len(at)
                    if n > 1 << 19:
                        yield _occurrences(ids, places, rows, orient, poly)
                        ids, places, rows, orient, poly, n = [], [], [], [], [], 0
            if n:
                yield _occurrences(ids, places, rows, orient, poly)

    return seqs.select("seq_ord", "seq").mapInArrow(run, "seq_ord long, pos long, canon binary, orient int, poly boolean")


def _occurrences(ids, places, rows, orient, poly) -> pa.RecordBatch:
    return _table({"seq_ord": pa.array(np.concatenate(ids)), "pos": pa.array(np.concatenate(places)), "canon": _binary(np.concatenate(rows)), "orient": pa.array(np.concatenate(orient)), "poly": pa.array(np.concatenate(poly))})


def minimizers(seqs: DataFrame, p: SampleParams) -> DataFrame:
    """(seq_ord, pos, hash) of the minimizers."""

    def found(it):
        for batch in it:
            for i, c in _rows(batch):
                last = -1
                for a, b in _pieces(len(c), p.w + p.k - 2):
                    at = minimizer_places(c[a:b], p) + a
                    at = at[at > last]
                    if len(at):
                        last = at[-1]
                        yield i, at, hashes(c[a:b], p)[0][at - a]

    def run(it):
        yield from _gather(found(it), {"pos": pa.int64(), "hash": pa.int64()})

    return seqs.select("seq_ord", "seq").mapInArrow(run, "seq_ord long, pos long, hash long")


def modimizers(seqs: DataFrame, p: SampleParams) -> DataFrame:
    """(seq_ord, pos, hash) of the k-mers whose hash is a multiple of w."""

    def found(it):
        for batch in it:
            for i, c in _rows(batch):
                for a, b in _pieces(len(c), p.k - 1):
                    h, _ = hashes(c[a:b], p)
                    at = np.flatnonzero(h % np.uint64(p.w) == 0)
                    if len(at):
                        yield i, at + a, h[at]

    def run(it):
        yield from _gather(found(it), {"pos": pa.int64(), "hash": pa.int64()})

    return seqs.select("seq_ord", "seq").mapInArrow(run, "seq_ord long, pos long, hash long")


#: Windows of a piece where hashes are an array in a row, and bases of a number there.
COLUMN_PIECE, WORD = 1 << 12, 31


def _once(value, use):
    """What ``use`` makes of a column that is worked out a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _never_null(numbers):
    """An array that isn't null, as the optimizer sees too: else it tests for null below, and works it out there once more."""
    return F.coalesce(numbers, F.array().cast("array<long>"))


def _strand_hashes(piece, p: SampleParams):
    """The hashes of the k-mers at all places of a piece (bases as binary), as an array.

    Words of 31 digits become numbers, and k-mers are cut out of them by shifts; the
    digits of the other strand are the complement of the reversed word's.
    """
    per = WORD - p.k + 1
    n = F.length(piece) - p.k + 1
    words = F.ceil(n / per).cast("int")
    digits = F.rpad(dna.encode(piece.cast("string")), (words - 1) * per + WORD, "0").cast("binary")
    texts = _once(digits, lambda d: F.transform(F.sequence(F.lit(0), words - 1), lambda i: F.substring(d, i * per + 1, F.lit(WORD)).cast("string")))

    def number(text):
        return F.conv(text, 4, 10).cast("long")

    def cut(word, shifts):
        return F.transform(F.array(*[F.lit(2 * i) for i in shifts]), lambda i: F.call_function("shiftright", word, i).bitwiseAND(F.lit(4**p.k - 1)))

    def both(word):
        return F.zip_with(cut(word["there"], reversed(range(per))), cut(word["back"], range(per)), lambda a, b: F.least(dna.kmer_hash(a, p.k, p.factor), dna.kmer_hash(b, p.k, p.factor)))

    numbers = F.transform(texts, lambda t: F.struct(number(t).alias("there"), (F.lit(4**WORD - 1) - number(F.reverse(t))).alias("back")))
    return F.slice(F.flatten(F.transform(numbers, both)), F.lit(1), n)


def syncmers_relational(seqs: DataFrame, p: SampleParams) -> DataFrame:
    """(seq_ord, pos) of the closed syncmers with DataFrame operations only; use it where Python isn't to be had.

    Sequences are cut into pieces that share a window's bases, and each piece is
    worked on where it lies: nothing is shuffled.  A window's ends are compared with
    the smallest hashes of the groups that lie in it, and only where one may be the
    smallest with all of its hashes.  The window at the very end isn't looked at, so
    the last base goes first.
    """

    def cut(bases):
        starts = F.sequence(F.lit(0), F.length(bases) - (p.length + 1), F.lit(COLUMN_PIECE))
        return F.transform(starts, lambda a: F.struct(a.alias("start"), F.substring(bases, a + 1, F.least(F.lit(COLUMN_PIECE + p.length - 1), F.length(bases) - 1 - a)).alias("piece")))

    pieces = seqs.where(F.length("seq") > p.length).select("seq_ord", F.explode(_once(F.col("seq").cast("binary"), cut)).alias("x"))
    rows = pieces.select("seq_ord", "x.start", _never_null(_strand_hashes(F.col("x.piece"), p)).alias("h"))
    size = math.isqrt(p.w + 1)
    lows = F.transform(F.sequence(F.lit(0), F.floor((F.size("h") - 1) / size).cast("int")), lambda g: F.array_min(F.slice("h", g * size + 1, F.lit(size))))
    rows = rows.select("seq_ord", "start", "h", _never_null(lows).alias("lows")).select("seq_ord", "start", "h", "lows", F.explode(F.sequence(F.lit(0), F.size("h") - (p.w + 1))).alias("at"))
    first, behind = F.ceil(F.col("at") / size).cast("int"), F.floor((F.col("at") + (p.w + 1)) / size).cast("int")
    end = F.least(F.get("h", F.col("at")), F.get("h", F.col("at") + p.w))
    kept = rows.where((end <= F.array_min(F.slice("lows", first + 1, behind - first))) & (end == F.array_min(F.slice("h", F.col("at") + 1, F.lit(p.w + 1)))))
    return kept.select("seq_ord", (F.col("start") + F.col("at")).cast("long").alias("pos"))


#: Bases of the longest fragment that is a number by itself.
NUMBERED = 27


def numbered(p: SampleParams):
    """The fragment's number, from 1, signed by its orientation, of occurrences (canon, orient): a node that needs no dictionary."""
    if p.length > NUMBERED:
        raise ValueError(f"fragments of over {NUMBERED} bases have no number")
    return (F.conv(F.hex("canon"), 16, 10).cast("long") + 1) * F.col("orient")


def walks(seqs: DataFrame, p: SampleParams) -> DataFrame:
    """(nodes, gaps): the paths of seqs (seq_ord, seq), each in one row, by the numbers of fragments; homopolymers are left out."""
    if p.length > NUMBERED:
        raise ValueError(f"fragments of over {NUMBERED} bases have no number")

    def run(it):
        for batch in it:
            nodes, gaps, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [0]
            for _, c in _rows(batch):
                places, signed = [np.empty(0, np.int64)], []
                for a, b in _pieces(len(c), p.length):
                    own = c[a:b]
                    at = syncmer_places(own, p)
                    if not len(at):
                        continue
                    canon, orient, poly = fragments(own, at, p.length)
                    number = np.zeros(len(at), np.int64)
                    for column in canon.T:
                        number = number << 8 | column
                    places.append(at[~poly] + a)
                    signed.append(((number + 1) * orient)[~poly])
                places = np.concatenate(places)
                if len(places):
                    nodes += signed
                    gaps.append(np.diff(places, prepend=places[0]).astype(np.int32))
                    sizes.append(len(places))
            offsets = pa.array(np.cumsum(sizes), pa.int32())
            yield _table({"nodes": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(nodes))), "gaps": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(gaps)))})

    return seqs.select("seq_ord", "seq").mapInArrow(run, "nodes array<long>, gaps array<int>")
