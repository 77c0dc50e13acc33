import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, shard int, start string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(open(PATH, encoding="utf-8").read())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from(["the", "The,", "don't", "it's", "<|endoftext|>", "a<|endoftext|>b", "ΣΑΣ", "İx", "é", "̈a", "x\x1cy!\x1c?", "été.", "STRASSE!!", "ª", "1a2", "a-b", " ", "​", "μµ", "ﬁ", "l'été", "***", "end.***"])), max_size=12))
def test_encoder_equals_the_library(library, encoder, parts):
    for sep in (" ", "", "\n", " "):
        t = sep.join(parts)
        ids, n = encoder(pa.array([None, t, "", t]).slice(1))
        own = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert n.tolist() == [len(own), 1, len(own)] and ids.tolist() == [*own, 2, *own]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_000) | st.integers(0, 3) | st.just(1 << 20), max_size=1500))
def test_wavelet_matrix(ids):
    a = np.array(ids, np.uint32)
    bounds, docs = np.array([0, len(a)], np.uint64), [None]
    m = tokens.TokenFile.of(tokens.to_file(tokens.WaveletMatrix.build(a), bounds, docs))
    assert m.ids().tolist() == ids and m.bounds().tolist() == bounds.tolist() and m.doc_ids() == docs
    for i in {0, len(a) // 3, len(a) - 1} if len(a) else ():
        assert m.access(i) == ids[i]
        for v in {ids[i], 2, 77}:
            assert m.rank(v, i) == ids[:i].count(v) and m.count(v) == ids.count(v)
        where = [j for j, x in enumerate(ids) if x == ids[i]]
        assert [m.select(ids[i], k) for k in {0, len(where) - 1}] == [where[k] for k in {0, len(where) - 1}]
        assert m.select(ids[i], len(where)) == -1


def test_files_hold_every_document(spark, library, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(100_000, None), (-5, ""), (100_001, "z " * 40_000), (None, "no id"), (100_001, "again")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], SCHEMA).repartition(3)
    got = sorted(tokens.tokenize(df, PATH).collect(), key=lambda r: r.start)
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    at = 0
    assert len(got) == len(order)
    for r, (i, t) in zip(got, order, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_several_shards_and_empty_table(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text number {k}", 1, "x") for k in range(50)], SCHEMA)
    shards = tokens.write(df, f"file://{tmp_path}/t", PATH, shard_bytes=100).cache()
    assert shards.count() > 3
    got = tokens.read(spark, f"file://{tmp_path}/t", shards).orderBy("doc_id").collect()
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert tokens.tokenize(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_a_look_up_unpacks_few_blocks(tmp_path):
    ids = np.random.default_rng(4).integers(0, 49_408, 1 << 19).astype(np.uint32)
    tokens.put_file(f"file://{tmp_path}/x.swwm", tokens.to_file(tokens.WaveletMatrix.build(ids), np.array([0, len(ids)]), [7]))
    m, got = tokens.TokenFile.open(f"file://{tmp_path}/x.swwm"), []
    read = m._read
    m._read = lambda start, stop: got.append(stop - start) or read(start, stop)
    for i in (0, 300_000, len(ids) - 1):
        assert m.access(i) == ids[i]
    assert sum(got) < 3 * 16 * 2 * (tokens.BLOCK >> 3) < (tmp_path / "x.swwm").stat().st_size / 2
    v = int(ids[300_000])
    where = np.flatnonzero(ids == v)
    assert m.count(v) == len(where) and [m.select(v, k) for k in range(len(where))] == where.tolist() and m.rank(v, 300_000) == (where < 300_000).sum()


def test_files_left_behind_do_no_harm(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text number {k}", 1, "x") for k in range(50)], SCHEMA)
    folder = f"{tmp_path}/t"
    shards = tokens.write(df, f"file://{folder}", PATH, shard_bytes=300).persist()
    want = sorted(tuple(r) for r in tokens.read(spark, f"file://{folder}", shards).collect())
    data = open(f"{folder}/shard-000000.swwm", "rb").read()
    for name in ("_0f.part", "shard-000000.swwm.0f.tmp", "shard-000077.swwm"):  # a killed task's, another format's, a longer run's
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data if name.endswith("swwm") else b"half")
    tokens.put_file(f"file://{folder}/shard-000000.swwm", data)  # a task that runs again
    assert sorted(tuple(r) for r in tokens.read(spark, f"file://{folder}", shards).collect()) == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_other_vocabularies_encode_whole_texts(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    encoder, library = tokens.Encoder(open(path, encoding="utf-8").read(), end=50_256), Tokenizer.from_file(path)
    texts = ["Two  words", " lead", "", "Tab\tand\nline ", "it's ÉTÉ"]
    ids, n = encoder(pa.array([*texts, None]))
    assert not encoder.by_word
    assert ids.tolist() == [i for t in [*texts, ""] for i in [*library.encode(t, add_special_tokens=False).ids, 50_256]] and n.sum() == len(ids)


def test_forgetting_changes_nothing():
    texts = pa.array([f"word{i} Word{i}! été{i % 7}, {i}" for i in range(300)])
    vocabulary = open(PATH, encoding="utf-8").read()
    a, b = tokens.Encoder(vocabulary), tokens.Encoder(vocabulary, known=10, kept=4)
    for k in range(0, 300, 50):
        assert a(texts.slice(k, 50))[0].tolist() == b(texts.slice(k, 50))[0].tolist()


def test_a_shard_is_written_and_read_in_little_memory():
    import tracemalloc

    ids = np.random.default_rng(1).integers(0, 49_000, 2_000_000 + 13).astype(np.uint16)
    before = ids.copy()
    bounds = np.append(np.arange(0, len(ids), 1000), len(ids))

    def peak(run):
        """Bytes for each id beyond what there was."""
        tracemalloc.start()
        out = run()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, most / len(ids)

    matrix, build = peak(lambda: tokens.WaveletMatrix.build(ids))
    data = tokens.to_file(matrix, bounds, list(range(len(bounds) - 1)))
    found = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["shard", "content"])
    rows, read = peak(lambda: [b.to_pydict() for b in tokens._read([found])])
    raw = before.astype("<u4").tobytes()
    assert np.array_equal(ids, before) and np.array_equal(tokens.TokenFile.of(data).ids(), before)
    assert rows[0]["ids_crc32"] == [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    # Two arrays of 2 bytes an id, in building also the planes' 2, and pieces.
    assert build < 8 and read < 6, (build, read)
