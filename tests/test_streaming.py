from strandweave.operators import selection
from strandweave.params import SampleParams
from strandweave.plans import testdata
from strandweave.streaming import ingest

P = SampleParams(k=5, w=10)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    seqs = testdata.sequences(spark, sf_dir).select("seq_ord", "seq")
    seqs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.sequences(spark, str(tmp_path / "in"), 1)
    q = ingest.fragment_counts(stream, P).writeStream.outputMode("complete").format("memory").queryName("fragment_counts").start()
    q.processAllAvailable()
    q.stop()
    want = {bytes(r.canon): r["count"] for r in selection.syncmers(seqs, P).where("NOT poly").groupBy("canon").count().collect()}
    assert {bytes(r.canon): r["count"] for r in spark.table("fragment_counts").collect()} == want
    for _ in range(2):
        q = ingest.grow_dictionary(ingest.sequences(spark, str(tmp_path / "in"), 1), P, str(tmp_path / "dict"), str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    rows = [bytes(r.canon) for r in spark.read.parquet(str(tmp_path / "dict")).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == set(want)
