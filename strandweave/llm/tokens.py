"""Operator 3: token ids in files, each a wavelet matrix with its documents' bounds.

Documents are put in ascending doc_id order over shards; every shard is one
file.  A file holds the ids as bit planes, most significant bit first: plane l
has bit l of every id, in the order in which the zeros of the plane above come
first and then its ones.  The file answers the id at a place, the number of an id
before a place and the place of an id's n-th occurrence; for that it unpacks a
block of a plane or two and never the whole.

File layout (little-endian): magic ``SWWM0002``; planes u32, bits of a block u32,
documents u64, ids u64, blocks of a plane u64; the zeros of each plane u64; the
ones before each block of each plane u64; the place of every frame in the file
u64 and the end of the last.  Then zstandard frames: the bounds of the documents
(documents + 1 times u64), their ids (i64), a byte each for null ids, and each
block of each plane (bit i of byte j is position 8 j + i).

A text's ids are those the tokenizers library gives for the whole text.  Where
the vocabulary's file asks for the steps in ``STEPS``, nothing reaches over white
space or from letters into punctuation; then every distinct word goes to the
library once in a while and is remembered, and words of Latin letters go there in
lower case and without the steps that change nothing in them.  With other steps
whole texts are encoded.

Defined results: null text is empty and has the end id only; null doc_ids come
first; rows with the same doc_id follow by text; an empty table makes no file;
files that are not in the table of shards are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import Workspace, running_total

#: Bits of a block of a plane: what one look-up unpacks; ids, in whole blocks, that are dealt to a plane's zeros and ones at once.
MAGIC, HEAD, BLOCK, DEALT = b"SWWM0002", "<IIQQQ", 1 << 15, 1 << 18
END = 2
#: Bytes of text in a shard, on average; of text encoded at once.
SHARD, PIECE = 24 << 20, 2 << 20
#: Words that a worker remembers within a task, and from one to the next; words that go to the library at once.
KNOWN, KEPT, TOGETHER = 240_000, 50_000, 8192
#: The normalizer and pre-tokenizer under which words may be encoded one by one.
STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Latin letters but for those without a case or form of their own, then visible ASCII but for ' and <.
#: An apostrophe behind letters may begin a contraction, a < a special token: such words stay whole.
PLAIN = "^(?P<head>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!-&(-/:;=-@\\[-`{-~]*)$"


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, vocabulary: str, end: int = END, known: int = KNOWN, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        made = json.loads(vocabulary)
        self.by_word = all(made[k] == v for k, v in STEPS.items()) and all(x["special"] and not x["single_word"] and not x["lstrip"] and not x["rstrip"] and x["content"][:1] == "<" and not set(x["content"]) & set(" \t\n\v\f\r") for x in made["added_tokens"])
        self._coder = Tokenizer.from_str(vocabulary)
        # For lower-case letters all steps but the one from bytes to characters change nothing.
        self._steps = (self._coder.normalizer, self._coder.pre_tokenizer), (None, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        self._end, self._most, self._kept = end, known, kept
        self._number: dict[str, int] = {}
        self._starts, self._ids = np.zeros(1, np.int64), np.empty(0, np.uint32)

    def forget(self) -> None:
        """Remember only the words learned first, which are mostly the frequent ones."""
        self._number = dict(islice(self._number.items(), self._kept))
        self._starts = self._starts[: len(self._number) + 1].copy()
        self._ids = self._ids[: self._starts[-1]].copy()

    def _encode(self, strings: list[str], letters: bool) -> list[list[int]]:
        self._coder.normalizer, self._coder.pre_tokenizer = self._steps[letters]
        return [e.ids for i in range(0, len(strings), TOGETHER) for e in self._coder.encode_batch_fast(strings[i : i + TOGETHER], add_special_tokens=False)]

    def _learn(self, strings: list[str], letters: list[bool]) -> None:
        fresh = [[s for s, x in zip(strings, letters, strict=True) if x is kind] for kind in (False, True)]
        ids = [x for kind in (False, True) for x in self._encode(fresh[kind], kind)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._number.update(zip(chain(*fresh), range(len(self._number), len(self._number) + len(strings)), strict=True))
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))])

    def _numbers(self, strings: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Each string's number among the known; letters says which go without the steps."""
        names = strings.to_pylist()
        out = np.fromiter(map(self._number.get, names, [-1] * len(names)), np.int64, len(names))
        if len(fresh := np.flatnonzero(out < 0)):
            own = [names[i] for i in fresh]
            self._learn(own, letters[fresh].tolist())
            out[fresh] = np.fromiter(map(self._number.__getitem__, own), np.int64, len(own))
        return out

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id behind each, number of ids of each); null is empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            ids = [np.array([*x, self._end], np.uint32) for x in self._encode(texts.to_pylist(), False)]
            return np.concatenate(ids) if ids else np.empty(0, np.uint32), np.array([len(x) for x in ids], np.int64)
        codes, ends, names = W.split(texts)
        if len(self._number) > self._most:
            self.forget()
        cut = pc.extract_regex(names, PLAIN)
        plain = cut.is_valid()
        head = pc.if_else(plain, pc.utf8_lower(pc.struct_field(cut, "head")), names).dictionary_encode()
        tail = pc.if_else(plain, pc.struct_field(cut, "tail"), "").dictionary_encode()
        letters = np.zeros(len(head.dictionary), bool)
        letters[head.indices.to_numpy()] = plain.to_numpy(zero_copy_only=False)
        first = self._numbers(head.dictionary, letters)[head.indices.to_numpy()]
        second = self._numbers(tail.dictionary, np.zeros(len(tail.dictionary), bool))[tail.indices.to_numpy()]
        starts, size = self._starts, np.diff(self._starts)
        # Each distinct word's ids in one row, then the end id's.
        own = np.empty(2 * len(names) + 1, np.int64)
        own[:-1:2], own[1::2] = size[first], size[second]
        own[-1] = 1
        stop = np.cumsum(own)
        of_word = np.empty(stop[-1], np.uint32)
        of_word[-1] = self._end
        at = np.empty(2 * len(names), np.int64)
        at[::2], at[1::2] = starts[first], starts[second]
        of_word[:-1] = self._ids[_spread(at, own[:-1])]
        start = np.concatenate([[0], stop[1::2]])
        each = np.diff(np.append(start, stop[-1]))
        codes = np.insert(codes, ends, len(names))
        n = each[codes]
        ids = of_word[_spread(start[codes], n)]
        last = np.cumsum(n)[ends + np.arange(len(ends))]
        return ids, np.diff(last, prepend=0)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the same of the next."""
    stop = np.cumsum(sizes)
    return np.repeat(starts - (stop - sizes), sizes) + np.arange(stop[-1] if len(stop) else 0)


class WaveletMatrix:
    """Access, rank and select over ids, by blocks of packed planes.

    ``block(level, k)`` gives the bytes of a plane's k-th block and ``ones[level][k]``
    the ones before it.
    """

    def __init__(self, n: int, zeros: np.ndarray, ones: np.ndarray, block, bits: int = BLOCK):
        self.n, self.zeros, self.ones, self.block, self.bits = n, [int(z) for z in zeros], ones, block, bits

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        """Needs two arrays of the ids' size and the packed planes, whatever the number of ids; ids is let go after the first plane."""
        n, planes = len(ids), max(1, int(ids.max()).bit_length()) if len(ids) else 1
        kind = np.uint16 if planes <= 16 else np.uint32
        blocks, zeros, ones, kept = -(-n // BLOCK), [], [], []
        now, spare = ids, None
        del ids
        for level in range(planes):
            packed, bit = np.empty(-(-n // 8), np.uint8), kind(1 << (planes - 1 - level))
            for i in range(0, n, DEALT):
                own = np.packbits((now[i : i + DEALT].astype(kind, copy=False) & bit) != 0, bitorder="little")
                packed[i >> 3 : (i >> 3) + len(own)] = own
            cuts = np.arange(blocks) * (BLOCK >> 3)
            each = np.add.reduceat(np.bitwise_count(packed), cuts, dtype=np.int64) if blocks else np.empty(0, np.int64)
            ones.append(np.concatenate([[0], np.cumsum(each)])[:blocks])
            zeros.append(n - int(each.sum()))
            kept.append(packed)
            if level + 1 == planes:
                break
            following, low, high = np.empty(n, kind) if spare is None else spare, 0, zeros[-1]
            for i in range(0, n, DEALT):
                own = now[i : i + DEALT].astype(kind, copy=False)
                b = np.unpackbits(packed[i >> 3 : (i + DEALT) >> 3], count=len(own), bitorder="little").view(bool)
                many = int(np.count_nonzero(b))
                following[low : low + len(own) - many], following[high : high + many] = own[~b], own[b]
                low, high = low + len(own) - many, high + many
            # The caller's array is never written to.
            now, spare = following, now if level else None
            del own
        return cls(n, np.array(zeros), np.array(ones).reshape(planes, blocks), lambda level, k: kept[level][k * (BLOCK >> 3) : (k + 1) * (BLOCK >> 3)])

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        k, inside = divmod(i, self.bits)
        block = self.block(level, k)
        out = int(self.ones[level][k]) + int(np.bitwise_count(block[: inside >> 3]).sum(dtype=np.int64))
        return out + (int(block[inside >> 3] & ((1 << (inside & 7)) - 1)).bit_count() if inside & 7 else 0)

    def _bit(self, level: int, i: int) -> int:
        k, inside = divmod(i, self.bits)
        return int(self.block(level, k)[inside >> 3] >> (inside & 7) & 1)

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) such bit of a plane."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * self.bits - self.ones[level]
        b = int(np.searchsorted(before, k, "right")) - 1
        inside = np.unpackbits(self.block(level, b), bitorder="little") == bit
        return b * self.bits + int(np.flatnonzero(inside)[k - int(before[b])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            i = zeros + ones if bit else i - ones
            out = out << 1 | bit
        return out

    def _range(self, value: int, i: int) -> tuple[int, int]:
        low, high = 0, i
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (zeros + a, zeros + b) if value >> (len(self.zeros) - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, value: int, i: int) -> int:
        """How often value occurs among the first i ids."""
        if value >> len(self.zeros):
            return 0
        low, high = self._range(value, min(i, self.n))
        return high - low

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of the k-th (from 0) occurrence of value; -1 if there are fewer."""
        if not 0 <= k < self.count(value):
            return -1
        i = self._range(value, 0)[0] + k
        for level in reversed(range(len(self.zeros))):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def narrow(self) -> np.ndarray:
        """All ids in 16 bits each if they fit, from the last plane up, block by block; needs two arrays of that size."""
        planes = len(self.zeros)
        kind = np.uint16 if planes <= 16 else np.uint32
        out, above = np.zeros(self.n, kind), np.empty(self.n, kind)
        for level in reversed(range(planes)):
            low, high, bit = 0, self.zeros[level], kind(1 << (planes - 1 - level))
            for k in range(self.ones.shape[1]):
                own = above[k * self.bits : (k + 1) * self.bits]
                b = np.unpackbits(self.block(level, k), count=len(own), bitorder="little").view(bool)
                many = int(np.count_nonzero(b))
                own[~b], own[b] = out[low : low + len(own) - many], out[high : high + many] | bit
                low, high = low + len(own) - many, high + many
            out, above = above, out
        return out

    def ids(self) -> np.ndarray:
        """All ids."""
        return self.narrow().astype("<u4")


def frames_of(matrix: WaveletMatrix, bounds: np.ndarray, doc_ids: list) -> list[bytes]:
    """The head and the frames of a file, which follow each other in it."""
    pack = zstandard.ZstdCompressor(level=1).compress
    planes, blocks = matrix.ones.shape
    frames = [pack(np.asarray(bounds, "<u8").tobytes()), pack(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()), pack(bytes(d is None for d in doc_ids))]
    frames += [pack(matrix.block(level, k).tobytes()) for level in range(planes) for k in range(blocks)]
    head = MAGIC + struct.pack(HEAD, planes, matrix.bits, len(doc_ids), matrix.n, blocks) + np.array(matrix.zeros, "<u8").tobytes() + matrix.ones.astype("<u8").tobytes()
    places = len(head) + 8 * (len(frames) + 1) + np.concatenate([[0], np.cumsum([len(f) for f in frames])])
    return [head, places.astype("<u8").tobytes(), *frames]


def to_file(matrix: WaveletMatrix, bounds: np.ndarray, doc_ids: list) -> bytes:
    return b"".join(frames_of(matrix, bounds, doc_ids))


class TokenFile(WaveletMatrix):
    """A stored matrix, its documents' bounds and ids; read(start, stop) gives bytes of the file.

    Only the head is read at once.  ``kept`` unpacked blocks are remembered.
    """

    def __init__(self, read, kept: int = 64):
        size = len(MAGIC) + struct.calcsize(HEAD)
        head = bytes(read(0, size))
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        planes, bits, self.docs, n, blocks = struct.unpack_from(HEAD, head, len(MAGIC))
        rest = np.frombuffer(read(size, size + 8 * (planes + planes * blocks + 4 + planes * blocks)), "<u8").astype(np.int64)
        zeros, ones, self._places = np.split(rest, [planes, planes + planes * blocks])
        self._read = read
        block = lru_cache(kept)(lambda level, k: np.frombuffer(self._frame(3 + level * blocks + k), np.uint8))
        super().__init__(n, zeros, ones.reshape(planes, blocks), block, bits)

    def _frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(bytes(self._read(int(self._places[k]), int(self._places[k + 1]))))

    def bounds(self) -> np.ndarray:
        return np.frombuffer(self._frame(0), "<u8").astype(np.int64)

    def doc_ids(self) -> list:
        ids, nulls = np.frombuffer(self._frame(1), "<i8"), self._frame(2) if self.docs else b""
        return [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        view = memoryview(data)
        return cls(lambda start, stop: view[start:stop])

    @classmethod
    def open(cls, uri: str) -> TokenFile:
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        f = fs.open_input_file(path)
        return cls(lambda start, stop: f.read_at(stop - start, start))


def put_file(uri: str, *data: bytes) -> None:
    """Write under a hidden name, then move: a repeated task leaves the same whole file."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    folder = path.rpartition("/")[0]
    fs.create_dir(folder, recursive=True)
    own = f"{folder}/_{uuid.uuid4().hex}.part"
    with fs.open_output_stream(own) as f:
        for part in data:
            f.write(part)
    try:
        fs.move(own, path)
    except OSError:  # some file systems don't move onto a file, here one that an earlier attempt of this task has left
        if fs.get_file_info(path).type == pyarrow.fs.FileType.NotFound:
            raise
        fs.delete_file(path)
        fs.move(own, path)


_encoders: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str, end: int) -> Encoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    key = (zlib.crc32(vocabulary.encode()), len(vocabulary), end)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary, end)
    return _encoders[key]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """All parts in one array; the list is emptied on the way."""
    out, at = np.empty(sum(map(len, parts)), np.result_type(*parts)), 0
    parts.reverse()
    while parts:
        own = parts.pop()
        out[at : at + len(own)] = own
        at += len(own)
    return out


def _write(folder: str, vocabulary, end: int):
    """A sorted partition into one file: (shard, path, n_docs, n_ids)."""

    def run(it):
        from pyspark import TaskContext

        encode = _encoder(vocabulary.value, end)
        doc_ids, sizes, parts = [], [], []
        for batch in W.batches(it, limit=PIECE):
            ids, n = encode(batch.column("text"))
            doc_ids += batch.column("doc_id").to_pylist()
            sizes.append(n)
            parts.append(ids.astype(np.uint16) if not len(ids) or ids.max() < 1 << 16 else ids)
        if not doc_ids:
            return
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:06d}.swwm"
        encode.forget()
        W.release()
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        matrix = WaveletMatrix.build(_joined(parts))
        put_file(path, *frames_of(matrix, bounds, doc_ids))
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(doc_ids)], pa.int64()), pa.array([matrix.n], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    return W.tidy(run)


def write(docs: DataFrame, folder: str, vocabulary: str, end: int = END, shard_bytes: int = SHARD) -> DataFrame:
    """Write docs (doc_id, text) as token files below folder, in ascending doc_id order; (shard, path, n_docs, n_ids).

    vocabulary is a file of the tokenizers library on the driver.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first().b or 0
    shards = int(total // shard_bytes) + 1
    ordered = rows.repartitionByRange(shards, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    return ordered.mapInArrow(_write(folder, shared, end), "shard int, path string, n_docs long, n_ids long")


def _read(it):
    for batch in it:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
            stored = TokenFile.of(data.as_buffer())
            ids, bounds = stored.narrow(), stored.bounds()
            crc = [zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(stored.doc_ids(), pa.int64()), pa.array(np.full(stored.docs, shard, np.int32)), pa.array(bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                ["doc_id", "shard", "inside", "n_tokens", "ids_crc32"],
            )


def read(spark, folder: str, shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, shard) of every document, from the files of write()'s result."""
    starts = running_total(Workspace(spark, "shards"), shards, ["shard"], F.col("n_ids"), "base").select(F.col("shard").alias("s"), "base")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.swwm").load(folder)
    files = found.select(F.regexp_extract("path", r"shard-(\d+)\.swwm$", 1).cast("int").alias("shard"), "content")
    rows = files.mapInArrow(W.tidy(_read), "doc_id long, shard int, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts, F.col("shard") == F.col("s")).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", "shard")


def tokenize(docs: DataFrame, vocabulary: str, folder: str | None = None, end: int = END) -> DataFrame:
    """Write docs as token files and return what the files say of each document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "tokens")
    folder = folder or f"{ws.path}/files"
    shards = ws.put(write(docs, folder, vocabulary, end), "shards")
    if shards.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")
    return read(spark, folder, shards)
