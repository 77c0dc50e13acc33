"""Operator 10: the language of a text by compression.

For each language a raw-content zstandard dictionary is put together from a
bounded sample of labelled texts, each whole.  A text is encoded in pieces, every piece with every
dictionary; the language with the smallest total is the prediction.  Pieces keep
a long text from becoming its own dictionary.  The score says by how much the
best language beats the second; below ``MARGIN`` the prediction is marked as
not reliable.

Defined results: null text or text without a letter is ``und`` with score 0 and
not reliable; equal sizes go to the language with more labelled texts; without a
learned language everything is ``und``; rows with a null lang are not learned
from; an empty table gives no rows; rows that repeat a doc_id are each judged by
their own text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import small_batches

#: What is learned from: so many labelled texts of a language at most, and so many bytes of dictionary.
TEXTS, DICT_BYTES = 400, 1 << 18
#: A text with more than this part of the dictionary's bytes is not learned from, so that none takes the place of all others.
SHARE = 8
#: Bytes encoded at once, and zstandard's level.
PIECE, LEVEL = 1024, 6
#: Share of the second best size that the best must save to be reliable.
MARGIN = 0.02
_letter = re.compile(r"[^\W\d_]")
_other = re.compile(r"[\W\d_]+")


def held_out(doc_id):
    """Documents that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, texts: int = TEXTS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """A dictionary for each language, the most frequent first, from rows (doc_id, text, lang) that may be learned from.

    A draw by hash, with a share of each language that gives somewhat over
    ``texts`` of its rows, is made where the rows lie.  Whole texts of it, in the
    order of the hash, fill the dictionary; one that no longer fits is passed over.
    """
    spark = docs.sparkSession
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    able = F.octet_length("text") <= dict_bytes // SHARE
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(able).alias("able")).orderBy(F.desc("n"), "lang").collect()
    if not counts:
        return {}
    # One row for each language, which the driver holds already.
    shares = spark.createDataFrame([(r.lang, min(1.0, (1.3 * texts + 30) / max(r.able, 1))) for r in counts], "_lang string, _share double")
    hashed = F.xxhash64(F.lit(10), "doc_id", "text")
    drawn = rows.where(able).select("lang", "text", hashed.alias("_at")).join(F.broadcast(shares), F.col("lang") == F.col("_lang"))
    drawn = drawn.where(F.shiftrightunsigned("_at", 11).cast("double") / F.lit(float(1 << 53)) < F.col("_share")).select("lang", "_at", "text")
    found: dict[str, list] = {r.lang: [] for r in counts}
    size, taken = dict.fromkeys(found, 0), dict.fromkeys(found, 0)
    for r in drawn.orderBy("lang", "_at", "text").toLocalIterator():
        own = normal(r.text).encode()
        if taken[r.lang] < texts and size[r.lang] + len(own) + 1 <= dict_bytes:
            found[r.lang].append(own)
            size[r.lang] += len(own) + 1
            taken[r.lang] += 1
    return {k: b"\n".join(v) for k, v in found.items()}


def normal(text: str) -> str:
    """What is encoded: words in lower case, without digits and signs."""
    return _other.sub(" ", text.lower()).strip()


def sizes(text: str, coders: list) -> np.ndarray:
    data = normal(text).encode()
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    return np.array([sum(len(c.compress(p)) for p in pieces) for c in coders], np.float64)


def _predict(dictionaries: dict[str, bytes]):
    names = list(dictionaries)

    def run(it):
        coders = []
        for n in names:
            d = zstandard.ZstdCompressionDict(dictionaries[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            coders.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False))
        for batch in W.batches(it):
            said, score = [], []
            for t in batch.column("text").to_pylist():
                if not names or t is None or not _letter.search(t):
                    said.append("und")
                    score.append(0.0)
                    continue
                s = sizes(t, coders)
                best = int(np.argmin(s))
                said.append(names[best])
                score.append(1.0 if len(s) == 1 else float(1 - s[best] / np.delete(s, best).min()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array([x >= MARGIN for x in score], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "reliable"],
            )

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, reliable) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(W.tidy(_predict(dictionaries)), "doc_id long, held_out boolean, lang_pred string, score double, reliable boolean")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and predict all."""
    return predict(docs, learn(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")))
