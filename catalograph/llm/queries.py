"""The dealt operators and the pipeline as registered queries, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from catalograph.llm import (
    chat_format, decontam, language_id, packing, periodic_runs, prefix_trie, quality_model, quality_rules, secrets, sharding, simhash, token_counts, token_files,
)
from catalograph.llm.tables import documents, text_or_empty, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op1_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `key`: the 8-shard tree, and the same tree grown by one shard."""
    text = text_or_empty()
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                                           F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    tree = sharding.balanced()
    placed = sharding.assign(sharding.assign(rows, tree, into="shard"), tree.grown(), into="grown_shard")
    return sharding.number(written(placed, "shards")).withColumn("law", F.lit("key"))


@_register
def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good: quality 1 and not toxic. A document's site is its source, its path the source and the language."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return quality_model.posteriors(docs, quality_model.fit(docs, labels), docs["source"], F.concat_ws("/", docs["source"], docs["lang"]))


@_register
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


@_register
def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


@_register
def op6_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_files(token_files.write_files(documents(spark, sf_dir), token_files.new_folder(spark)))


@_register
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), limit=512)


@_register
def op2_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_register
def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


@_register
def op9_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(documents(spark, sf_dir), ["doc_id"])


@_register
def op10_subword_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out())
    return language_id.predict(docs, language_id.fit(docs.filter(~F.col("held_out"))), ("doc_id", "held_out"))


@_register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.marked(prefix_trie.ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie.report(prefix_trie.Trie(*prefix_trie.branched(written(turns, "turns"))))


@_register
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings, read back from the laid-out tree."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-1, i, r, "</s>[INST] ok [/INST]") for i, r in enumerate(["user", "assistant"])], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.layout(said.unionByName(odd)))


@_register
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.collapse(periodic_runs.planted(documents(spark, sf_dir))))


ORACLES["op2_benchmark_containment"] = decontam.ORACLE
ORACLES["op8_secret_ledger"] = secrets.ORACLE
ORACLES["op9_host_quality_rules"] = quality_rules.ORACLE
ORACLES["op11_prefix_trie"] = prefix_trie.ORACLE

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
