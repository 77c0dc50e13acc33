import hashlib
import random
import re

import numpy as np

from strandweave.llm import substrings


def brute(docs):
    first, split = {}, []
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        split.append(w)
        for a in range(len(w) - 49):
            key = tuple(w[a : a + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = set()
        for a in range(len(w) - 49):
            if i is not None and first[tuple(w[a : a + 50])] < i:
                gone.update(range(a, a + 50))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, print long, starts long")
    return sorted((tuple(r) for r in substrings.dedup_substrings(df).collect()), key=str)


def test_matches_brute_force_on_awkward_rows(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice(["a", "b", "É", "the", "x"]) + str(rng.randint(0, 30)) for _ in range(n))
    p50, p80, p49 = words(50), words(80), words(49)
    docs = [(5, p50), (3, "pre " + p50 + " post"), (9, p80 + " " + words(30) + " " + p80), (4, words(20) + "\n" + p80), (8, p49), (2, p49), (6, None), (7, ""), (None, p80), (1, "y " * 300), (11, "y " * 120), (12, p50.upper()), (13, p80), (13, p50 + " " + p50)]
    docs += [(20 + k, words(200)) for k in range(5)] + [(30, "q " * 30_000)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs) == brute(docs)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "merged_sketch", lambda ws, docs: np.full((substrings.ROWS, 1 << 16), 255, np.uint8))
    t = " ".join(f"w{i}" for i in range(70))
    docs = [(1, t), (2, "x " + t), (3, " ".join(f"v{i}" for i in range(90)))]
    assert run(spark, docs) == brute(docs)


def test_sketch_counts_are_never_too_low():
    a, bits = np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64), 19
    parts = [[(np.zeros(1 << bits - 3, np.uint8), np.zeros(1 << bits - 3, np.uint8)) for _ in range(substrings.ROWS)] for _ in range(2)]
    for p, keys in zip(parts, (a, a[:1000]), strict=True):
        for (seen, again), where in zip(p, substrings.cells(keys, bits), strict=True):
            substrings._note(seen, again, where)
    rows = [substrings._segment((r, 0), *p[r]) for r in range(substrings.ROWS) for p in parts]
    merged = [substrings._bitmap(b.column("again")[0].as_py()) for b in substrings._merge(rows)]
    said = substrings._repeats(np.stack(merged), a)
    assert said[:1000].all() and said[1000:].mean() < 0.05


def test_sketch_grows_with_the_text():
    assert [substrings.sketch_bits(n) for n in (0, 10**6, 10**9, 10**10, 10**14)] == [19, 19, 26, 28, 28]


def test_words_in_mirrored_patterns_are_told_apart(spark):
    mirror = str.maketrans("ab", "ba")
    t = "a"
    for _ in range(10):
        t += t.translate(mirror)
    left, right = " ".join(f"l{i}" for i in range(25)), " ".join(f"r{i}" for i in range(25))
    letters = " ".join(t[:64])
    docs = [(1, f"{left} {t} {right}"), (2, f"{left} {t.translate(mirror)} {right}"), (3, letters), (4, letters.translate(mirror)), (5, f"{left} {t} {right}")]
    assert run(spark, docs) == brute(docs)


def test_least_of_each():
    h = np.random.default_rng(0).integers(0, 1000, 90)
    assert substrings.least_of_each(h, 26).tolist() == [h[i : i + 26].min() for i in range(65)]
