"""Packed binary sequence files: two bits a base, one bit a quality.

A file is a header of 64 bytes (the letter b, the quality threshold or 0, six
bytes of padding, then as u64 the numbers of sequences, bytes of ids, of
descriptions and bases, and the longest of each) and for each sequence three i32
(lengths of id, description and sequence), id and description each with a zero
byte, the bases with the first in the lowest bits, the qualities at or over the
threshold as bits likewise, and zeros up to a multiple of four.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD, HIGH = "<BB6x7Q", 40
_LETTERS = np.frombuffer(b"acgt", np.uint8)
_NUMBERS = np.zeros(256, np.uint8)
_NUMBERS[[ord(c) for c in "cCgGtT"]] = [1, 1, 2, 2, 3, 3]


def pack(seq: bytes) -> bytes:
    """Two bits a base, the first base lowest; other letters are a."""
    n = np.zeros(-(-len(seq) // 4) * 4, np.uint8)
    n[: len(seq)] = _NUMBERS[np.frombuffer(seq, np.uint8)]
    n = n.reshape(-1, 4)
    return (n[:, 0] | n[:, 1] << 2 | n[:, 2] << 4 | n[:, 3] << 6).tobytes()


def unpack(data: bytes, length: int) -> bytes:
    b = np.frombuffer(data, np.uint8)
    return _LETTERS[np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).ravel()[:length]].tobytes()


def reverse_complement(data: bytes, length: int) -> bytes:
    """Of packed bases, packed."""
    b = np.frombuffer(data, np.uint8)
    n = np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], axis=1).ravel()[:length]
    return pack(_LETTERS[3 - n[::-1]].tobytes())


def to_bytes(rows: list[tuple], threshold: int = 0) -> bytes:
    """A file of (id, desc, seq, qual) rows."""
    out, sizes = [], []
    for id_, desc, seq, qual in rows:
        i, d, s = (id_ or "").encode(), (desc or "").encode(), (seq or "").encode()
        body = i + b"\0" + d + b"\0" + pack(s)
        if threshold:
            held = np.zeros(len(s), bool)
            held[: len(qual or ())] = np.asarray(qual or [], np.int64)[: len(s)] >= threshold
            body += np.packbits(held, bitorder="little").tobytes()
        out.append(struct.pack("<3i", len(i), len(d), len(s)) + body + b"\0" * (-len(body) % 4))
        sizes.append((len(i), len(d), len(s)))
    total, most = ([f(x[k] for x in sizes) if sizes else 0 for k in range(3)] for f in (sum, max))
    return struct.pack(HEAD, ord("b"), threshold, len(rows), *total, *most) + b"".join(out)


def from_bytes(data: bytes):
    """The (id, desc, seq, qual) rows of a file; qual is 0 or HIGH, null without a threshold."""
    letter, threshold, n = struct.unpack_from(HEAD, data)[:3]
    if letter != ord("b"):
        raise ValueError("not a packed sequence file")
    at = struct.calcsize(HEAD)
    for _ in range(n):
        i, d, s = struct.unpack_from("<3i", data, at)
        at += 12
        start = at
        id_, at = data[at : at + i].decode(), at + i + 1
        desc, at = data[at : at + d].decode(), at + d + 1
        seq, at = unpack(data[at : at + -(-s // 4)], s).decode(), at + -(-s // 4)
        qual = None
        if threshold:
            bits = np.unpackbits(np.frombuffer(data[at : at + -(-s // 8)], np.uint8), bitorder="little")[:s]
            qual, at = (bits.astype(int) * HIGH).tolist(), at + -(-s // 8)
        at = start + -(-(at - start) // 4) * 4
        yield id_, desc, seq, qual


def read_packed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(file, seq_in_file, id, desc, len, seq, qual) of packed files, one task for each; a path may be a folder that write_packed made."""
    paths = [paths] if isinstance(paths, str) else paths
    kind = "file int, part string, n int, id string, desc string, len long, seq string, qual array<int>"

    def run(it):
        for batch in it:
            for path, number, data in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "content")), strict=True):
                rows = [(number, path, k, i, d, len(s), s, q) for k, (i, d, s, q) in enumerate(from_bytes(data))]
                for a in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_pylist([dict(zip(("file", "part", "n", "id", "desc", "len", "seq", "qual"), r, strict=True)) for r in rows[a : a + 1000]], pa.schema([("file", pa.int32()), ("part", pa.string()), ("n", pa.int32()), ("id", pa.string()), ("desc", pa.string()), ("len", pa.int64()), ("seq", pa.string()), ("qual", pa.list_(pa.int32()))]))

    out = None
    for number, path in enumerate(paths, 1):
        files = spark.read.format("binaryFile").load(path).select("path", F.lit(number).cast("int").alias("file"), "content")
        out = files if out is None else out.unionByName(files)
    rows = out.mapInArrow(run, kind)
    # A folder's parts follow by name; only their sizes are added up.
    from pyspark.sql import Window as Over

    sizes = rows.groupBy("file", "part").agg(F.count("*").alias("c"))
    before = sizes.select(F.col("file").alias("_f"), F.col("part").alias("_p"), F.coalesce(F.sum("c").over(Over.partitionBy("file").orderBy("part").rowsBetween(Over.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    joined = rows.join(before, (F.col("file") == F.col("_f")) & (F.col("part") == F.col("_p")))
    return joined.select("file", (F.col("n") + F.col("_before") + 1).cast("int").alias("seq_in_file"), "id", "desc", "len", "seq", "qual")


def write_packed(seqs: DataFrame, path: str, threshold: int = 0) -> None:
    """seqs (id, seq; desc and qual if there) as a folder of packed files, one for each partition."""
    rows = seqs.select(F.col("id").cast("string"), (F.col("desc") if "desc" in seqs.columns else F.lit("")).alias("desc"), "seq", (F.col("qual").cast("array<int>") if "qual" in seqs.columns else F.lit(None).cast("array<int>")).alias("qual"))
    there = seqs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    folder = there.getFileSystem(seqs.sparkSession._jsc.hadoopConfiguration()).makeQualified(there).toUri().toString()

    def run(it):
        from pyspark import TaskContext

        held = [tuple(r.values()) for batch in it for r in batch.to_pylist()]
        if held:
            fs, at = pyarrow.fs.FileSystem.from_uri(folder)
            fs.create_dir(at, recursive=True)
            own, name = f"{at}/_{uuid.uuid4().hex}", f"{at}/part-{TaskContext.get().partitionId():06d}"
            with fs.open_output_stream(own) as f:
                f.write(to_bytes(held, threshold))
            fs.move(own, name)
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    rows.mapInArrow(run, "n long").agg(F.sum("n")).collect()
