"""Words of whole texts and hashes of words and word sequences, vectorised over many documents.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` gives.  Every distinct word of a batch is hashed once, with a
seeded 128-bit xxhash of its bytes, whose two halves serve as independent hashes.
Hashes of word sequences are put together pairwise, each time with a full mixing,
so that no arrangement of words cancels out.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SEED = 0x9E3779B97F4A7C15
STEP, FLIP = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, ends, names): each word's place in names, text after text; where each text's words end; distinct words."""
    found = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    ends = found.offsets.to_numpy().astype(np.int64)
    ends = ends[1:] - ends[0]
    flat = found.flatten().dictionary_encode()
    codes, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    # White space at either end of a text gives an empty string.
    if (empty := pc.index(names, pa.scalar("", names.type)).as_py()) >= 0:
        keep = codes != empty
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return codes, ends, names


def hash_names(names: pa.Array) -> np.ndarray:
    """(names, 2) uint64: two independent hashes of each."""
    digest = xxhash.xxh3_128_digest
    found = b"".join([digest(w, SEED) for w in names.cast(pa.binary()).to_pylist()])
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def hash_texts(texts: pa.Array, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, where each text's end)."""
    codes, ends, names = split(texts)
    return np.ascontiguousarray(hash_names(names)[:, which])[codes], ends


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs; the order counts."""
    return mix(a * np.uint64(STEP) + (b ^ np.uint64(FLIP)))


def hash_runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive items of h; len(h)-k+1 of them."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n, run, size, out, have = len(h) - k + 1, h, 1, None, 0
    while True:
        if k & size:
            part = run[have : have + n]
            out = part.copy() if out is None else join(out, part)
            have += size
        if have == k:
            return out
        run = join(run[:-size], run[size:])
        size *= 2


def release() -> None:
    """Give memory that a task no longer uses back, so that a worker that lives on doesn't keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """A function for mapInArrow that leaves a small worker behind."""

    def tidied(it):
        try:
            yield from run(it)
        finally:
            release()

    return tidied


def filtered(docs, run):
    """docs through a function for mapInArrow that leaves out rows; it may read doc_id and text, other columns may have any names."""
    names = docs.columns
    plain = docs.toDF(*[n if n in ("doc_id", "text") else f"_{i}" for i, n in enumerate(names)])
    return plain.mapInArrow(tidy(run), plain.schema).toDF(*names)


def batches(it, column: str = "text", limit: int = 4 << 20):
    """Record batches cut so that each holds about ``limit`` bytes of text or a single row."""
    for batch in it:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw(batch, column: str = "text") -> list:
    """The column's values as bytes or None."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def lists(values: np.ndarray, sizes, kind=None) -> pa.ListArray:
    """An Arrow list column from all values and each row's number of them."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
