import random

from strandweave.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id string, lang string"


def best_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    rng = random.Random(4)
    for _ in range(150):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))
        assert d.Myers(p).best(t, 0)[0] == best_distance(p, t)


def run(spark, docs, items):
    df = spark.createDataFrame([(*x, "i", "en") for x in docs], SCHEMA)
    it = spark.createDataFrame(items, "item_id long, text string")
    found = {tuple(r) for r in d.contaminated(df, it).collect()}
    clean = d.remove_contaminated(df, it)
    assert clean.columns == df.columns
    return found, sorted((r.doc_id for r in clean.collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(rng.choice([9, 20, 60]))) for k in range(8)] + [(50, "too short"), (51, None), (None, text(15)), (52, "")]
    docs = []
    for k in range(60):
        body = text(80)
        i, t = rng.choice(items[:8])
        w = list(t)
        for _ in range(rng.randint(0, len(t) // 12)):
            w[rng.randrange(len(w))] = rng.choice("xyz ")
        docs.append((k, body[:200] + " " + "".join(w).upper() + "! " + body[200:] if k % 3 else body))
    docs += [(100, None), (101, ""), (None, "intro " + items[0][1]), (102, items[10][1]), (103, " ".join(items[0][1].split()[:4]))]
    docs += [(3, docs[3][1])]
    want = set()
    for i, t in docs:
        for item, x in items:
            for k, s in enumerate(d.segments(d.reduce(x or ""))):
                b = best_distance(s, d.reduce(t or ""))
                if b <= len(s) // d.PER_EDIT:
                    want.add((i, item, k, b))
    got, clean = run(spark, docs, items)
    assert got == want
    bad = {(i, t) for i, t in docs for w in want if w[0] == i and (i is not None or t.startswith("intro"))}
    assert clean == sorted((i for i, t in docs if (i, t) not in bad), key=str)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f g h i j k")]) == (set(), [])
    assert run(spark, [(1, "x")], []) == (set(), [1])


def test_blocks_are_bounded(spark):
    items = spark.createDataFrame([(k, "w " * 50) for k in range(20)], "item_id long, text string")
    assert [len(b) for b in d.blocks(items, 300)] == [3] * 6 + [2]


def test_tables_and_blocks_one_after_the_other(spark, monkeypatch):
    blocks = d.blocks
    monkeypatch.setattr(d, "blocks", lambda items: blocks(items, 300))
    for round_ in range(3):
        items = [(k, " ".join(f"r{round_}k{k}w{j}" for j in range(10))) for k in range(20)]
        docs = [(k, f"intro {t} end") for k, t in items] + [(99, "nothing of this is in it")]
        found, clean = run(spark, docs, items)
        assert found == {(k, k, 0, 0) for k, _ in items}
        assert clean == [99]


def test_shared_items_never_have_the_same_key(spark):
    assert len({d._Shared(spark, [(k, "x")]).id for k in range(50)}) == 50


def test_short_items_and_scripts_without_spaces():
    question = "下列关于细胞膜结构与功能的说法中哪一项是正确的请选择最合适的答案并说明理由"
    items = [(1, "What is ten plus ten?"), (2, question), (3, "今天天气很好吗？"), (4, "cat"), (5, "?!"), (6, "Name the capital city of northern Freedonia please")]
    match = d.Matcher(items)
    found = lambda t: {(i, b) for i, k, b in match(t) if k == 0}
    assert found("quiz: what is TEN plus ten - yes") == {(1, 0)}
    assert found("what is ten plus tenths") == found("somewhat is ten plus ten") == found("concatenate cats") == set()
    assert found("the cat.") == {(4, 0)}
    assert found("他说：今天天气很好吗，然后走了") == found("他说今天天气很好吗然后走了") == {(3, 0)}
    assert found("开头" + question + "结尾") == {(2, 0)}
    assert found("开头" + question.replace("哪一", "那一") + "结尾") == {(2, 1)}
    assert found("name the capitol city of northern Freedonia, please") == {(6, 1)}
    words = "a few words that stand between spaces " * 2
    assert d.segments(words.strip()) == [words.strip()]


def test_any_half_of_an_item_is_found():
    for n in (16, 17, 23, 40, 47, 48, 71, 72, 100, 200):
        w = [f"w{j}x{j * j}" for j in range(n)]
        match = d.Matcher([(1, " ".join(w))])
        for a in range(n - n // 2 + 1):
            assert {h[0] for h in match("before " + " ".join(w[a : a + n // 2]) + " after")} == {1}, (n, a)
    assert d.Matcher([(1, " ".join(w))])(" ".join(w[:6])) == []
