"""The ten queries by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandweave.llm import ann, chat, decontaminate, langid, licenses, mixing, neardup, substrings, tokens, toxicity
from strandweave.llm.oracles import ORACLES  # noqa: F401


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark, sf_dir):
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark, sf_dir):
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_files(spark, sf_dir):
    import public_tokenizers

    return tokens.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_source_mixing(spark, sf_dir):
    return mixing.digest(mixing.mix(_table(spark, sf_dir, "documents")))


def op5_learned_partition_ann(spark, sf_dir):
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_substring_dedup(spark, sf_dir):
    return substrings.dedup_substrings(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(licenses.as_files(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op8_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return toxicity.judge(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_chat_formatting(spark, sf_dir):
    text = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(chat.format_trees(chat.as_chains(rows)))


def op10_language_id(spark, sf_dir):
    return langid.identify(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_token_files": op3_token_files,
    "op4_source_mixing": op4_source_mixing,
    "op5_learned_partition_ann": op5_learned_partition_ann,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_language_id": op10_language_id,
}
