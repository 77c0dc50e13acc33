import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from strandweave.llm import neardup, words

SCHEMA = "doc_id long, text string, lang string, sig string, kept string"


def brute(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    low = [i for i, _ in docs]
    changed = True
    near = [(a, b) for a, b in combinations(range(len(docs)), 2) if sets[a] and sets[b] and docs[a][0] is not None and docs[b][0] is not None and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return sorted(((i, len(s), c, i == c or i is None) for (i, _), s, c in zip(docs, sets, low, strict=True)), key=str)


def run(spark, docs):
    df = spark.createDataFrame([(i, t, "en", "x", "y") for i, t in docs], SCHEMA)
    return sorted((tuple(r)[:4] for r in neardup.near_duplicates(df).collect()), key=str)


def test_matches_brute_force_on_awkward_rows(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefghij") * rng.randint(1, 5) + str(rng.randint(0, 99)) for _ in range(120)]
    docs = [(1000, " ".join(base)), (None, " ".join(base)), (7, None), (8, ""), (9, " \t\n"), (10, "One two"), (11, "ONE\ttwo"), (12, "É x"), (13, "é x")]
    for k in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "z" + str(rng.randint(0, 999))
        docs.append((k + 100, "\n".join(w)))
    docs += [(150, "a b c d e"), (150, "a b c d e"), (151, "A  b c d e"), (152, "x " * 4000)]
    assert run(spark, docs) == brute(docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_matches_brute_force_on_documents(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs) == brute(docs)


def test_both_ends_estimate_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    s = neardup.signatures([np.sort(x[:3500]), np.sort(x[500:])])
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.13
    assert (s[:, :, 0] <= s[:, :, 1]).all()


def test_words_are_those_of_split_and_hashes_do_not_depend_on_their_place():
    texts = ["  alpha b " + "gamma" * 300_000 + "\x0b\talpha\nb", None, "", " \n", "x\x1cy\x85z b", "É"]
    codes, ends, names = words.split(pa.array(texts).slice(0))
    found = [[names[c].as_py() for c in own] for own in np.split(codes, ends[:-1])]
    assert found == [[w.decode() for w in (t or "").encode().split()] for t in texts]
    h, _ = words.hash_texts(pa.array(texts[:1]))
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 3
    runs = words.hash_runs(h, 2)
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 3


def test_words_in_mirrored_patterns_are_told_apart(spark):
    mirror = str.maketrans("ab", "ba")
    t = "a"
    for _ in range(10):
        t += t.translate(mirror)
    letters = " ".join(t[:64])
    docs = [(1, t), (2, t.translate(mirror)), (3, letters), (4, "q " + letters.translate(mirror)), (5, " ".join(t[:4])), (6, " ".join(t[:4]).translate(mirror))]
    assert run(spark, docs) == brute(docs)


def test_small_sets_are_linked_exactly(spark):
    """Pairs at the limit with sets of all sizes up to the border and across it, beside a line that all share."""
    rng, docs, line = random.Random(7), [], "this very line stands in each of them"
    for n in range(1, 70):
        for k in range(3):
            w = [f"{n}x{k}x{i}x{rng.randint(0, 9)}" for i in range(n + 4)]
            docs += [(10 * len(docs), " ".join(w)), (10 * len(docs) + 1, " ".join([*w, *(f"e{n}x{i}" for i in range(n // 3))])), (10 * len(docs) + 2, " ".join([*w, *(f"f{n}x{i}" for i in range(n // 3 + 1))])), (10 * len(docs) + 3, f"{line} " + " ".join(w[: n // 2 + 1]))]
    assert run(spark, docs) == brute(docs)


def test_rows_that_repeat_a_doc_id_are_linked_by_each_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (11, c), (12, c + " more"), (5, a)]
    got = {r[0]: r[2] for r in run(spark, docs)}
    assert got == {5: 5, 7: 5, 9: 5, 11: 11, 12: 11}


def test_keep_one_keeps_one_row_and_all_columns(spark):
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(1, t, "en", "s", "k"), (2, t, "en", "s", "k"), (3, t + " more", "en", "s", "k"), (4, "else " + t[:40], "en", "s", "k"), (4, "else " + t[:40], "en", "s", "k"), (None, t, "en", "s", "k")]
    out = neardup.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "lang", "sig", "kept"]
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 4, None]


def test_keep_one_whatever_the_columns_names(spark):
    t = " ".join(f"w{i}" for i in range(60))
    names = ["doc_id", "text", "gone", "own", "_id", "_slot", "_word", "_MASK", "out", "a.b", "n_copies"]
    rows = [(i, x, *range(9)) for i, x in ((1, t), (2, t + " more"), (3, None), (4, ""), (4, ""), (5, "five"), (5, "five"), (None, None), (None, None))]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names[2:]))
    out = neardup.keep_one(df)
    assert out.columns == names
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 4, 4, 5, None, None]
    assert neardup.keep_one(df.where("false")).collect() == []
