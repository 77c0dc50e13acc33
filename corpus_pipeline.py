"""The corpus pipeline: documents to token files in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and returns a DataFrame that is written as Parquet and read again.  All but the
last return the columns of their input, whatever their names and types.  An empty
table stays empty in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandweave.llm import decontaminate, mixing, neardup, tokens, toxicity
from strandweave.runtime import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    Null and empty texts stay unless most labelled ones are toxic; rows that repeat
    a doc_id are judged each by its own text; without labels nothing goes.
    """
    return toxicity.remove_toxic(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Null texts, texts without words and rows without a doc_id all stay; of rows
    that repeat a doc_id and its text one stays.
    """
    return neardup.keep_one(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or half of a long one, go.

    Null and empty texts stay; items that are null or hold no letter or digit are
    in no text; without items nothing goes.
    """
    return decontaminate.remove_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, shard by shard in the shard's own order.

    Documents without words come along with others and add none; null sources are one
    source; rows alike in all columns are taken alike, but one more of them may fit.
    """
    return mixing.mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token files say of each document, in ascending order of doc_id, null first, then of text.

    A null text has the end id only; a document that the mix repeats has a row each time.
    """
    import public_tokenizers

    return tokens.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", keep_one),
    ("decontamination", remove_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The stages have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what each returns is written and read again."""
    ws, docs = Workspace(spark, "pipeline"), _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return docs
