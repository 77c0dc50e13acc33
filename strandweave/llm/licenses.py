"""Operator 7: licences of files, from their headers and from licence files above them.

Every line of a file that holds a cue word is a header; of longer lines also the
runs of words around each cue, so that a notice inside a paragraph or a text
without line breaks is found.  Headers and whole text are compared with templates by the cosine of sparse TF-IDF vectors, the whole
text also with the full licences in ``licences/``.  Terms are words and pairs of
neighbouring words; a term's weight comes from the number of documents of the
whole table that hold it if a template has it, and is the largest one if not.  A file whose whole text is like a template is a
licence file and speaks for its directory; a file without a licence of its own
inherits that of the nearest directory above it that has one, found by joining
each directory's ancestors with the directories that have licences.

Defined results: null and empty text hold no licence but may inherit; a null
path has no directory and inherits nothing; of equal scores the licence that
sorts first wins; of several licence files in a directory the one with the best
score, then the licence that sorts first.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.llm import words as W
from strandweave.runtime import Workspace

#: Least cosine of a header and of a licence file; salts of a directory's files.
HEADER, FILE, SALTS = 0.6, 0.9, 16
#: Lengths of the runs of words around a cue; each is tried at four places. Longer lines than the longest are not compared as a whole.
RUNS = (8, 16, 32)

#: Licence names with notices and openings by which they are known.
TEMPLATES = {
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal Public Domain Dedication"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Confidential and proprietary."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: A line without any of these is no header.
CUES = ["licen", "copyright", "rights reserved", "spdx", "public domain", "permission", "redistribution", "cc0", "creative commons"]

#: The AGPL is the GPL but for a section and its title; characters of a text in which the title is.
AFFERO, TITLE_CHARS = re.compile(r"affero\s+general\s+public\s+license", re.IGNORECASE), 200

_cue = re.compile("|".join(CUES), re.IGNORECASE)
_term = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def terms(text: str) -> Counter:
    w = _term.findall(text.lower())
    return Counter(w) + Counter(f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True))


def headers(line: str) -> list[str]:
    """What is compared of a line that holds a cue: the line, if it is not long, and the runs of words around each cue."""
    spans = [m.span() for m in _term.finditer(line.lower())]
    if len(spans) <= RUNS[0] or len(line) != len(line.lower()):
        return [line]
    ends, runs = [b for _, b in spans], set()
    for hit in _cue.finditer(line):
        at = bisect_right(ends, hit.start())
        for width in RUNS:
            for k in range(4):
                first = max(0, at - k * width // 4)
                runs.add((first, min(len(spans), first + width) - 1))
    out = [line] if len(spans) <= 2 * RUNS[-1] else []
    return out + [line[spans[a][0] : spans[b][1]] for a, b in sorted(runs) if a <= b]


VOCABULARY = sorted({t for texts in TEMPLATES.values() for x in texts for t in terms(x)})


def _count(it):
    """(term number, documents that hold it) of a partition."""
    number, found = {t: i for i, t in enumerate(VOCABULARY)}, Counter()
    single = {t for t in VOCABULARY if " " not in t}
    rows = 0
    for batch in W.batches(it):
        for t in batch.column("text").to_pylist():
            rows += 1
            w = _term.findall(t.lower()) if t else []
            own = single.intersection(w)
            found.update(own)
            # A pair of the templates can only be where one of its words is followed by another of theirs.
            if len(own) > 1:
                found.update({p for a, b in zip(w[:-1], w[1:], strict=True) if a in own and b in own and (p := f"{a} {b}") in number})
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([number[t] for t in found] + [-1], pa.int32()), pa.array([*found.values(), rows], pa.int64())], ["term", "n"])


def weights(docs: DataFrame) -> dict[str, float]:
    """Inverse document frequencies of the templates' terms over all documents."""
    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(W.tidy(_count), "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    n = {r.term: r.n for r in counted.collect()}
    rows = n.get(-1, 0)
    return {t: math.log((1 + rows) / (1 + n.get(i, 0))) + 1 for i, t in enumerate(VOCABULARY)}


def full_texts() -> dict[str, str]:
    """The whole licences by name; read on the driver only."""
    return {p.name.removesuffix(".txt"): p.read_text("utf-8") for p in (resources.files("strandweave.llm") / "licences").iterdir() if p.name.endswith(".txt")}


class Scorer:
    def __init__(self, idf: dict[str, float], full: dict[str, str]):
        self.idf = idf
        self.full = sorted(full)
        self.holding: dict[str, list] = defaultdict(list)
        for i, name in enumerate(self.full):
            for t, x in self.vector(full[name], damped=True).items():
                self.holding[t].append((i, x))
        self.templates = [(name, self.vector(x)) for name, texts in sorted(TEMPLATES.items()) for x in texts]

    def vector(self, text: str | Counter, damped: bool = False) -> dict[str, float]:
        """Unit vector; terms of no template count in its length as terms of no document.

        Damped, a term counts by the logarithm of its occurrences: of long texts
        the common words would decide otherwise.
        """
        rare = max(self.idf.values(), default=1.0)
        counts = terms(text) if isinstance(text, str) else text
        v = {t: (1 + math.log(n) if damped else n) * self.idf.get(t, rare) for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def best(self, text: str | Counter) -> tuple[float, str | None]:
        v, score, name = self.vector(text), 0.0, None
        for n, t in self.templates:
            s = sum(x * v[k] for k, x in t.items() if k in v)
            if s > score + 1e-12:
                score, name = s, n
        return score, name

    def whole(self, text: str) -> tuple[float, str | None]:
        """The best of the templates and the full licences for a whole text."""
        counts, sums = terms(text), [0.0] * len(self.full)
        for t, x in self.vector(counts, damped=True).items():
            for i, y in self.holding.get(t, ()):
                sums[i] += x * y
        score, name = self.best(counts)
        for s, n in zip(sums, self.full, strict=True):
            if s > score + 1e-12:
                score, name = s, n
        if name == "GPL-3.0" and AFFERO.search(text[:TITLE_CHARS]):
            name = "AGPL-3.0"
        return score, name

    def __call__(self, text: str | None) -> tuple:
        """(licence, score, file_licence, file_score): the best of headers and whole text, and what a licence file says, null for other files."""
        if not text or not _cue.search(text):
            return None, 0.0, None, 0.0
        score, name = 0.0, None
        for line in text.split("\n"):
            if _cue.search(line):
                for header in headers(line):
                    s, n = self.best(header)
                    if s >= HEADER and s > score + 1e-12:
                        score, name = s, n
        s, n = self.whole(text)
        if s < FILE:
            return name, score, None, 0.0
        return (n, s, n, s) if s >= score - 1e-12 else (name, score, n, s)


def _scan(shared):
    def run(it):
        score = Scorer(*shared.value)
        for batch in W.batches(it):
            found = [score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.string(), pa.float64())))],
                ["id", "path", "license", "score", "file_license", "file_score"],
            )

    return run


def directory(path):
    """The path without its last part; the top is the empty string."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan(files: DataFrame) -> DataFrame:
    """(id, path, license, score, origin, from_directory) for each row of files (id, path, text).

    origin is 'own', 'inherited' or 'none'.
    """
    ws = Workspace(files.sparkSession, "licenses")
    shared = files.sparkSession.sparkContext.broadcast((weights(files), full_texts()))
    rows = files.select(F.col("id").cast("long"), F.col("path").cast("string"), F.col("text").cast("string"))
    found = rows.mapInArrow(W.tidy(_scan(shared)), "id long, path string, license string, score double, file_license string, file_score double").withColumn("dir", F.when(F.col("path").isNotNull(), directory(F.col("path"))))
    found = ws.put(found, "found")
    best = Over.partitionBy("has").orderBy(F.desc("score"), "lic")
    owners = found.where("file_license IS NOT NULL AND dir IS NOT NULL").groupBy(F.col("dir").alias("has"), F.col("file_license").alias("lic")).agg(F.max("file_score").alias("score"))
    owners = owners.withColumn("n", F.row_number().over(best)).where("n = 1").select("has", "lic")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    # One entry for each directory that has or inherits: the licence of the longest ancestor, itself included.
    nearest = found.select("dir").where("dir IS NOT NULL").distinct().withColumn("up", F.explode(F.array_distinct(above))).join(owners, F.col("up") == F.col("has"))
    nearest = nearest.groupBy("dir").agg(F.max_by(F.struct("up", "lic"), F.length("up")).alias("got")).select(F.col("dir").alias("d"), F.col("got.up").alias("from_directory"), F.col("got.lic").alias("inherited"))
    salted = nearest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = found.withColumn("own_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, (F.col("dir") == F.col("d")) & (F.col("own_salt") == F.col("salt")), "left")
    own = F.col("license").isNotNull()
    return out.select(
        "id", "path", F.coalesce("license", "inherited").alias("license"), "score",
        F.when(own, "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none").alias("origin"), F.when(~own, F.col("from_directory")).alias("from_directory"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/doc_id."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("source", "lang", "doc_id")]
    return docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", *part).alias("path"), "text")
