import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandweave.sources import packed as B
from strandweave.sources import sequences as S
from strandweave.sources import typed_lines as L


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first desc\nACGTNacgt\nRRAC\n>two\n\n>three x\nT-T\n")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">four\nggg\n")
    rows = S.read_fasta(spark, [str(tmp_path / "b.fa.gz"), str(tmp_path / "a.fa")]).orderBy("file", "seq_in_file").collect()
    assert [(r.file, r.seq_in_file, r.id, r.desc, r.len, r.seq) for r in rows] == [(1, 1, "four", "", 3, "ggg"), (2, 1, "one", "first desc", 11, "acgtaacgtac"), (2, 2, "two", "", 0, ""), (2, 3, "three", "x", 2, "tt")]
    S.write_fasta(S.read_fasta(spark, str(tmp_path / "a.fa")).coalesce(1), str(tmp_path / "out"))
    again = S.read_fasta(spark, str(tmp_path / "out"))
    assert sorted((r.id, r.seq) for r in again.collect()) == [("one", "acgtaacgtac"), ("three", "tt"), ("two", "")]


def test_fastq_and_list(spark, tmp_path):
    (tmp_path / "r.fq").write_text("@r1 d\nACxGN\n+\nIIJ!#\n@r2\n\n+\n\n")
    rows = S.read_fastq(spark, str(tmp_path / "r.fq")).orderBy("seq_in_file").collect()
    assert [(r.id, r.desc, r.seq, r.qual) for r in rows] == [("r1", "d", "acga", [40, 40, 0, 2]), ("r2", "", "", [])]
    (tmp_path / "bad.fq").write_text("@r1\nACG\n+\nII\n")
    with pytest.raises(Exception, match="FASTQ"):
        S.read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    (tmp_path / "a.fa").write_text(">x\nacgt\n")
    (tmp_path / "list.txt").write_text(f"{tmp_path}/r.fq\n{tmp_path}/a.fa\n")
    assert sorted((r.file, r.id) for r in S.read_any(spark, str(tmp_path / "list.txt")).collect()) == [(1, "r1"), (1, "r2"), (2, "x")]


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\nr1\t0\t*\t0\t0\t*\t*\t0\t0\tAACG\tIIIJ\nr2\t16\t*\t0\t0\t*\t*\t0\t0\tAACG\tIIIJ\n")
    rows = {r.id: (r.seq, r.qual) for r in S.read_sam(spark, str(tmp_path / "a.sam")).collect()}
    assert rows == {"r1": ("aacg", [40, 40, 40, 41]), "r2": ("aacg", [40, 40, 40, 41])}
    turned = {r.id: (r.seq, r.qual) for r in S.read_sam(spark, str(tmp_path / "a.sam"), as_sequenced=True).collect()}
    assert turned == {"r1": ("aacg", [40, 40, 40, 41]), "r2": ("cgtt", [41, 40, 40, 40])}
    assert S.sniff(spark, str(tmp_path / "a.sam")) == "sam"


def test_typed_lines(spark, tmp_path):
    seqs = spark.createDataFrame([(0, "s one", "acgt"), (1, "t", ""), (2, "u", "gg")], "seq_ord long, id string, seq string")
    L.write_sequences(seqs, str(tmp_path / "x"))
    path = str(tmp_path / "x")
    assert S.sniff(spark, path) == "typed"
    assert L.read_schema(spark, path) == [("O", "S", ["DNA"]), ("D", "I", ["STRING"])]
    assert sorted((r.seq_in_file, r.id, r.seq) for r in L.read_sequences(spark, path).collect()) == [(1, "s", "acgt"), (2, "t", ""), (3, "u", "gg")]
    lines = L.read_lines(spark, path)
    assert [r.rest for r in L.objects(lines, [(1, 2)]).orderBy("line_no").collect()] == ["4 acgt", "5 s one"]
    assert {r.object: r.n for r in L.lines_until_next(lines, "I").collect()} == {1: 1, 2: 1, 3: 1}
    with pytest.raises(ValueError):
        L.check_schema([("O", "S", ["DNA"])], [("O", "S", ["STRING"])])
    (tmp_path / "z").write_text("1 3 map 1 0\n~ O P 3 3 INT 4 CHAR 8 INT_LIST\n~ D T 1 11 STRING_LIST\nP 7 c 3 1 2 3\nT 2 1 a 2 bc\n")
    r = L.table(spark, str(tmp_path / "z"), "P", "P").first()
    assert (r.f0, r.f1, r.f2) == (7, "c", [1, 2, 3])
    assert L.table(spark, str(tmp_path / "z"), "T", "P").first().f0 == ["a", "bc"]
    rows = L.table(spark, str(tmp_path / "z"), "P", "P").withColumn("line_type", F.lit("P"))
    assert L.format_lines(rows, ["INT", "CHAR", "INT_LIST"]).first().value == "P 7 c 3 1 2 3"


def test_kmer_list(spark, tmp_path):
    (tmp_path / "k.txt").write_text("a ACGT\n\nb\tacgg\n")
    assert [tuple(r) for r in S.read_kmer_list(spark, str(tmp_path / "k.txt")).collect()] == [("a", "ACGT"), ("b", "acgg")]


def test_files_are_told_apart_by_their_whole_paths(spark, tmp_path):
    for d, text in (("a", ">one\nacgt\n>two\ncc\n"), ("b", ">three\ngg\n"), ("a b", ">four\ntt\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.fa").write_text(text)
        (tmp_path / d / "r.fq").write_text("".join(f"@{x[1:].split()[0]}\nAC\n+\nII\n" for x in text.split("\n") if x[:1] == ">") + "\n" * (d == "a"))
    names = [str(tmp_path / d / "x.fa") for d in ("b", "a", "a b")]
    rows = S.read_fasta(spark, names).orderBy("file", "seq_in_file").collect()
    assert [(r.file, r.seq_in_file, r.id) for r in rows] == [(1, 1, "three"), (2, 1, "one"), (2, 2, "two"), (3, 1, "four")]
    rows = S.read_fastq(spark, [n.replace("x.fa", "r.fq") for n in names]).orderBy("file", "seq_in_file").collect()
    assert [(r.file, r.seq_in_file, r.id) for r in rows] == [(1, 1, "three"), (2, 1, "one"), (2, 2, "two"), (3, 1, "four")]
    (tmp_path / "list").write_text("\n".join([*names, names[0].replace("x.fa", "r.fq")]) + "\n")
    assert sorted((r.file, r.id) for r in S.read_any(spark, str(tmp_path / "list")).collect()) == [(1, "three"), (2, "one"), (2, "two"), (3, "four"), (4, "three")]


def test_records_are_numbered_over_many_blocks(spark, tmp_path):
    rng = random.Random(3)
    texts = ["".join(rng.choice("acgt") for _ in range(rng.randint(0, 400))) for _ in range(500)]
    (tmp_path / "x.fa").write_text("".join(f">r{k}\n{t}\n" for k, t in enumerate(texts)))
    (tmp_path / "x.fq").write_text("".join(f"@r{k}\n{t}\n+\n{'I' * len(t)}\n" for k, t in enumerate(texts)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        for read, name in ((S.read_fasta, "x.fa"), (S.read_fastq, "x.fq")):
            rows = read(spark, str(tmp_path / name))
            assert name == "x.fq" or rows.rdd.getNumPartitions() > 4
            assert {r.seq_in_file: (r.id, r.seq) for r in rows.collect()} == {k + 1: (f"r{k}", t) for k, t in enumerate(texts)}
        seqs = spark.createDataFrame([(k, f"r{k} d", t, [k % 40] * len(t)) for k, t in enumerate(texts)], "seq_ord long, id string, seq string, qual array<int>").repartition(5)
        L.write_sequences(seqs, str(tmp_path / "y.1seq"), programs=[("prog", "1", "run it", "today")], references=[("x.fa", 500)])
        rows = S.read_any(spark, str(tmp_path / "y.1seq"))
        assert {r.seq_in_file: (r.id, r.seq) for r in rows.collect()} == {k + 1: (f"r{k}", t) for k, t in enumerate(texts)}
        assert {r.seq_in_file: r.qual for r in L.read_sequences(spark, str(tmp_path / "y.1seq")).collect()} == {k + 1: [k % 40] * len(t) for k, t in enumerate(texts)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert L.provenance(spark, str(tmp_path / "y.1seq")) == ([("prog", "1", "run it", "today")], [("x.fa", 500)])
    assert L.text_view(spark, str(tmp_path / "y.1seq"), "header").count() == 6 and L.text_view(spark, str(tmp_path / "y.1seq"), "body").orderBy("n").first().value == f"S {len(texts[0])} {texts[0]}"
    L.to_parquet(spark, str(tmp_path / "y.1seq"), str(tmp_path / "y.parquet"))
    assert spark.read.parquet(str(tmp_path / "y.parquet" / "S")).count() == 500


def test_runs_of_other_letters(spark, tmp_path):
    (tmp_path / "n.1seq").write_text("1 3 seq 1 0\n~ O S 1 3 DNA\n~ D I 1 6 STRING\n~ D N 3 3 INT 4 CHAR 3 INT\nS 8 acgtacgt\nI 3 one\nN 2 n 3\nN 6 t 2\nS 3 ggg\nI 3 two\n")
    assert [(r.id, r.seq) for r in L.read_sequences(spark, str(tmp_path / "n.1seq")).orderBy("seq_in_file").collect()] == [("one", "acaaactt"), ("two", "ggg")]


def test_packed_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"s{k}", "d" * (k % 3), "".join(rng.choice("acgt") for _ in range(k)), [rng.randrange(41) for _ in range(k)]) for k in range(23)]
    seqs = spark.createDataFrame(rows, "id string, desc string, seq string, qual array<int>").repartition(3)
    B.write_packed(seqs, str(tmp_path / "p.2bs"), threshold=20)
    got = {r.id: (r.desc, r.seq, r.qual) for r in B.read_packed(spark, str(tmp_path / "p.2bs")).collect()}
    assert got == {i: (d, s, [40 * (x >= 20) for x in q]) for i, d, s, q in rows}
    assert sorted(r.seq_in_file for r in S.read_any(spark, str(tmp_path / "p.2bs")).collect()) == list(range(1, 24))
    assert S.sniff(spark, str(tmp_path / "p.2bs" / "part-000000")) == "packed"
    for n in range(13):
        t = bytes(rng.choice(b"acgt") for _ in range(n))
        assert B.unpack(B.reverse_complement(B.pack(t), n), n) == t[::-1].translate(bytes.maketrans(b"acgt", b"tgca"))
    S.write_any(seqs, str(tmp_path / "q.fq.gz"))
    assert {r.id: r.qual for r in S.read_fastq(spark, str(tmp_path / "q.fq.gz")).collect()} == {i: q for i, d, s, q in rows}
