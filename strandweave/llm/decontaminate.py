"""Operator 2: documents that hold test items, found by pigeonhole edit matching.

Texts and items are reduced to lower-case letters and digits with single spaces.
An item of n characters may differ from a passage by k = n // 20 edits.  Split
into k + 1 pieces, one piece must then occur exactly; an Aho-Corasick automaton
finds all pieces of all items in one pass over a text.  Around every hit the
item's distance to the best-fitting passage is computed with Myers' bit-parallel
algorithm.  Long items are split into segments first, each matched as an item of
its own; further segments overlap so that any run of half an item's words holds a
whole one.  So half an item of 2 * ``LEAST_WORDS`` words or more is found too;
shorter items must be there as a whole.

Items are taken to the tasks in blocks of bounded size; a larger test set means
more blocks, each one more pass over the documents.

Words are what stands between spaces; in scripts without spaces two characters
count as one.  An item of fewer than ``LEAST_WORDS`` words and ``SHORT``
characters must occur exactly, from word bound to word bound.

Defined results: null or empty texts hold nothing, and items without a letter or
digit are in no text; null item_ids are reported as null; items with the same
text are all reported.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import small_batches

#: One edit for so many characters; words of a segment at least; words, or else characters, of an item that may differ at all; characters of items in a block.
PER_EDIT, SEGMENT, LEAST_WORDS, SHORT, BLOCK = 20, 24, 8, 40, 1 << 20
#: Thai to Tibetan, Myanmar, Khmer, Chinese and Japanese letters, which stand without spaces.
_JOINED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u312f\u31a0-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_word, _joined = re.compile(f"[{_JOINED}]{{1,2}}|[^ {_JOINED}]+"), re.compile(f"[{_JOINED}]")
_other = re.compile(r"[\W_]+")


def reduce(text: str) -> str:
    return _other.sub(" ", text.lower()).strip()


def segments(text: str) -> list[str]:
    """The parts of a reduced item: equal runs of SEGMENT words or more, or the item; then overlapping ones, of which each half holds one."""
    w = [m.span() for m in _word.finditer(text)]
    if not w:
        return []
    n = max(1, len(w) // SEGMENT)
    runs, half = [(len(w) * i // n, len(w) * (i + 1) // n) for i in range(n)], len(w) // 2
    if half >= LEAST_WORDS:
        step = min(len(w) // 8, half - LEAST_WORDS + 1, SEGMENT // 2)
        size = min(half - step + 1, SEGMENT)
        runs += [(a, a + size) for a in range(0, len(w) - size + 1, step)]
    return [text[w[a][0] : w[b - 1][1]] for a, b in runs]


def short(segment: str) -> bool:
    """Whether a segment, then a whole item, is too short to differ."""
    return len(segment) < SHORT and len(_word.findall(segment)) < LEAST_WORDS


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a word bound is at both ends of a passage of a reduced text."""
    return all(not 0 < at < len(text) or " " in (pair := text[at - 1 : at + 1]) or _joined.search(pair) is not None for at in (start, end))


def pieces(segment: str) -> list[tuple[int, str]]:
    """(offset, piece): one more than the edits allowed, of nearly equal length."""
    n = len(segment) // PER_EDIT + 1
    cuts = [len(segment) * i // n for i in range(n + 1)]
    return [(a, segment[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Myers:
    """Best edit distance of a pattern to any substring of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i

    def best(self, text: str, limit: int) -> tuple[int, int]:
        """(distance, end) of the best fit; stops at distance 0."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        pv, mv, score, low, end, peq = full, 0, self.m, self.m, 0, self.peq
        for j, c in enumerate(text):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv) & full, pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            if score < low:
                low, end = score, j + 1
                if not low:
                    break
        return low, end


class Matcher:
    """All items of a block against one text after the other."""

    def __init__(self, items: list[tuple]):
        import ahocorasick

        by_text: dict[str, list] = defaultdict(list)
        for item_id, text in items:
            for k, s in enumerate(segments(reduce(text or ""))):
                by_text[s].append((item_id, k))
        self.segments = list(by_text)
        self.owners = [by_text[s] for s in self.segments]
        self.myers = [Myers(s) for s in self.segments]
        self.short = [short(s) for s in self.segments]
        where: dict[str, list] = defaultdict(list)
        for i, s in enumerate(self.segments):
            for offset, piece in [(0, s)] if self.short[i] else pieces(s):
                where[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, spots in where.items():
            self.automaton.add_word(piece, (len(piece), spots))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def __call__(self, text: str | None) -> list[tuple]:
        """(item_id, segment, distance) of what the text holds, each item's segment once with its best distance."""
        if not text or self.empty:
            return []
        t = reduce(text)
        starts: dict[int, list] = defaultdict(list)
        exact: set[int] = set()
        for end, (size, spots) in self.automaton.iter(t):
            for i, offset in spots:
                if not self.short[i]:
                    starts[i].append(end + 1 - size - offset)
                elif i not in exact and bounded(t, end + 1 - size, end + 1):
                    exact.add(i)
        out = [(item_id, k, 0) for i in sorted(exact) for item_id, k in self.owners[i]]
        for i, found in starts.items():
            n = len(self.segments[i])
            budget, low = n // PER_EDIT, n
            seen = None
            for s in sorted(found):
                if seen is not None and s <= seen:
                    continue
                # The passage lies within so many edits of where the hit puts it; hits close behind share the look.
                seen = s + budget
                low = min(low, self.myers[i].best(t[max(0, s - budget) : s + n + 2 * budget], budget)[0])
                if not low:
                    break
            if low <= budget:
                out += [(item_id, k, low) for item_id, k in self.owners[i]]
        return out


def blocks(items: DataFrame, limit: int = BLOCK):
    """Items (item_id, text) in lists of bounded size; the driver holds one list at a time."""
    now, size = [], 0
    for r in items.select("item_id", "text").where("text IS NOT NULL").toLocalIterator():
        now.append((r.item_id, r.text))
        size += len(r.text)
        if size >= limit:
            yield now
            now, size = [], 0
    if now:
        yield now


_matchers: dict[str, Matcher] = {}


def _matcher(shared) -> Matcher:
    if shared.id not in _matchers:
        _matchers.clear()
        _matchers[shared.id] = Matcher(shared.items.value)
    return _matchers[shared.id]


class _Shared:
    def __init__(self, spark, items: list):
        self.items = spark.sparkContext.broadcast(items)
        #: A worker outlives this object, so its memory address may come again with other items.
        self.id = uuid.uuid4().hex


def _find(shared):
    def run(it):
        match = _matcher(shared)
        for batch in W.batches(it):
            hits = [(i, *h) for i, t in enumerate(batch.column("text").to_pylist()) for h in match(t)]
            if hits:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([h[0] for h in hits])), *(pa.array([h[k] for h in hits], kind) for k, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32())))], ["doc_id", "item_id", "segment", "distance"])

    return run


def _clean(shared):
    def run(it):
        match = _matcher(shared)
        for batch in W.batches(it):
            yield batch.filter(pa.array([not match(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    return run


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, segment, distance) of every item's segment that a document holds."""
    spark, kind = docs.sparkSession, "doc_id long, item_id long, segment int, distance int"
    small_batches(spark)
    rows, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None
    for block in blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        found = rows.mapInArrow(W.tidy(_find(_Shared(spark, block))), kind)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], kind)


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no segment of any item; null and empty texts stay; nothing is shuffled."""
    small_batches(docs.sparkSession)
    for block in blocks(items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))):
        docs = W.filtered(docs, _clean(_Shared(docs.sparkSession, block)))
    return docs
