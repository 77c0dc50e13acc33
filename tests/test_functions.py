import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.params import SampleParams


def rc(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def test_column_functions(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("acgt") for _ in range(n)) for n in [0, 1, 2, 3, 4, 5, 8, 31, 63] for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    for r in df.select(s, dna.reverse_complement(s).alias("rc"), dna.canonical(s).alias("c"), dna.packed(s).alias("p"), dna.unpacked(dna.packed(s), F.length(s)).alias("u")).collect():
        assert r.rc == rc(r.s) and r.c == min(r.s, rc(r.s)) and r.u == r.s and len(r.p) == -(-len(r.s) // 4)
    assert df.select(dna.canonical(s) == dna.canonical(dna.reverse_complement(s))).distinct().collect()[0][0]


@pytest.mark.parametrize("k", [5, 8, 15, 16, 20, 31])
def test_hash_has_no_overflow(spark, k):
    rng = random.Random(k)
    p = SampleParams(k=k, w=10 if k % 2 else 11)
    values = [rng.randrange(4**k) for _ in range(200)] + [0, 4**k - 1]
    got = spark.createDataFrame([(v,) for v in values], "m long").select(dna.kmer_hash(F.col("m"), k, p.factor).alias("h"), dna.kmer_text(F.col("m"), k).alias("t"), dna.kmer_number(dna.kmer_text(F.col("m"), k)).alias("n")).collect()
    assert [r.h for r in got] == [(v * p.factor % 2**64) >> (64 - 2 * k) for v in values]
    assert [r.n for r in got] == values


def test_small_ones(spark):
    row = spark.createDataFrame([("ANcgtRYkm-x", "acgt", "acca", [30, 2], [])], "t string, a string, b string, q array<int>, e array<int>")
    got = row.select(
        dna.clean(F.col("t")).alias("clean"), dna.reverse_complement_ambiguous(F.lit("acgtRn")).alias("amb"), dna.first_mismatch(F.col("a"), F.col("b")).alias("mm"), dna.first_mismatch(F.col("a"), F.col("a")).alias("same"),
        dna.quality_bits(F.col("q"), 20).alias("bits"), dna.mean_quality(F.col("q")).alias("mean"), dna.mean_quality(F.col("e")).alias("none"), dna.is_homopolymer(F.lit("ttt")).alias("poly"), dna.is_homopolymer(F.lit("tta")).alias("not_poly"),
    ).first()
    assert (got.clean, got.amb, got.mm, got.same, got.bits, got.mean, got.none, got.poly, got.not_poly) == ("aacgt", "nYacgt", 3, 0, [True, False], 16.0, None, True, False)
    assert dna.index_ranges("1,4-7") == [(1, 2), (4, 7)]
    for bad in ("", "a", "5-3", "1-"):
        with pytest.raises(ValueError):
            dna.index_ranges(bad)


def test_parameters():
    assert SampleParams().length == 63
    for bad in ({"k": 0}, {"k": 32, "w": 1}, {"w": 0}, {"k": 8, "w": 54}, {"factor": 0}):
        with pytest.raises(ValueError):
            SampleParams(**bad)
    with pytest.raises(ValueError):
        SampleParams().require(SampleParams(w=57))
