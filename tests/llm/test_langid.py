import zlib

from strandweave.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score string"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.identify(docs).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_awkward_rows(spark):
    rows = [(k, "the cat sat on the mat and the dog too " * 3, "en", "s", "x") for k in range(12)] + [(k, "der hund und die katze sitzen auf dem dach " * 3, "de", "s", "x") for k in range(12, 24)]
    rows += [(30, None, "en", None, None), (31, "", "en", "s", "x"), (32, "123 !?", "de", "s", "x"), (33, "the dog and the cat", None, "s", "x"), (None, "die katze und der hund", "de", "s", "x"), (34, "der hund " * 50_000, None, "s", "x"), (33, "the dog and the cat", None, "s", "x")]
    out = langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert [by[k].lang_pred for k in (30, 31, 32, 33, None, 34)] == ["und", "und", "und", "en", "de", "de"]
    assert by[30].score == 0 and not by[30].reliable and by[None].held_out is False


def test_nothing_learned_and_empty_table(spark):
    rows = [(1, "some text", None, "s", "x")]
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()] == ["und"]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_and_frequent_languages_take_no_others_place(spark):
    """A long labelled text is not learned from and ends nothing; whole texts are learned, not their beginnings."""
    junk = "xq zv kj " * 300
    rows = [(k, "zzz qqq xxx " * 100_000, "en", "s", "x") for k in range(4)] + [(k, junk + "the cat sat on the mat and the dog too " * 20, "en", "s", "x") for k in range(10, 40)]
    rows += [(k, junk + "der hund und die katze sitzen auf dem dach " * 20, "de", "s", "x") for k in range(50, 400)]
    rows += [(1000, "the dog and the cat sat on the mat", None, "s", "x"), (1001, "die katze und der hund sitzen auf dem dach", None, "s", "x")]
    learned = langid.learn(spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang"), texts=40)
    assert list(learned) == ["de", "en"] and all(len(v) <= langid.DICT_BYTES for v in learned.values())
    assert learned["de"].count(b"auf dem dach") >= 20 * 25 and b"qqq" not in learned["en"] and learned["en"].count(b"mat and") >= 20 * 20
    by = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (by[1000], by[1001]) == ("en", "de")
