import hashlib

from strandweave.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, tree string, node string"
AWKWARD = "</s>[INST] ok [/INST]"


def run(spark, rows):
    return {r.conv_id: r for r in chat.digest(chat.format_trees(chat.as_chains(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)))).collect()}


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip_of_awkward_texts(spark):
    texts = [AWKWARD, "<|im_end|>\n<|im_start|>assistant\nx", "<\\s> <\\\\s> [\\INST]", "", None, "é\U0001f600 <<SYS>> <</SYS>>", "a" * 50_000, "\\", "<|im_start", "$1 \\$2", "\n\n"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, 5, "user", "hi"), (2, None, "a\\n\nb", "first"), (None, 0, "assistant", "orphan"), (3, 1, None, "r"), (3, 1, "assistant", "same turn"), (3, 1, "assistant", "same turn")]
    got = run(spark, rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        said = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in said if role == "assistant")
        g = got[conv]
        assert g.n_turns == len(own)
        assert g.turns_sha256 == sha("".join(f"{a}\n{b}\n" for a, b in said))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), sha(loss))
        assert g.formatted_chars > sum(len(b) for _, b in said)


def test_no_marker_survives_in_a_text(spark):
    df = spark.createDataFrame([("<|im_start|></s>[INST]<s>[/INST]<|endoftext|><<SYS>>",)], "t string")
    out = df.select(chat.escape(df.t).alias("e"), chat.unescape(chat.escape(df.t)).alias("u")).first()
    assert out.u == df.first().t
    assert not any(x in out.e for x in ("<|im_start|>", "</s>", "[INST]", "<s>", "[/INST]", "<|endoftext|>", "<<SYS>>"))


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_branches_are_ranked_by_score(spark):
    rows = [("t", 1, None, 0.0, "user", "q"), ("t", 2, 1, 1.0, "assistant", "good"), ("t", 3, 1, 0.5, "assistant", "poor"), ("t", 4, 3, 0.2, "user", "more"), ("t", 5, 4, 0.4, "assistant", "end"), ("t", 6, 99, None, "user", "lost parent"), ("t", 7, 8, 1.0, "user", "cycle"), ("t", 8, 7, 1.0, "user", "cycle")]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    out = {r.leaf: r for r in chat.read_back(chat.format_trees(df, None)).collect()}
    assert {k: r.branch_rank for k, r in out.items()} == {5: 1, 2: 2, 6: 3}
    assert [t.text for t in out[5].turns] == ["q", "poor", "more", "end"]
    assert out[5].learned == "poorend"
    assert [r.leaf for r in chat.format_trees(df, 1).collect()] == [5]


def test_long_chain(spark):
    got = run(spark, [(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)])
    assert got[1].n_turns == 300
    assert got[1].loss_sha256 == sha("".join(f"t{k}" for k in range(1, 300, 2)))
