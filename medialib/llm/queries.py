"""The registered queries of this package: each applies one operator to its whole table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialib.llm import (
    decontaminate, language, line_dedup, near_dup, packing, passages, periodic_runs, quality_rank, repetition, reply_trees,
    spelling, training_order, url_aliases)
from medialib.llm.steps import Steps


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rank.score(docs, quality_rank.train(docs, _table(spark, sf_dir, "labels")))


def op2_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_aliases.judge(_table(spark, sf_dir, "pages"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the shards written for all documents: what a reader finds at each slot."""
    path = f"{Steps(spark, 'shards').root}/shards"
    training_order.materialise(_table(spark, sf_dir, "documents"), path, key=20_260_101)
    place = F.col("slot") % training_order.PER_SHARD * training_order.stride()
    return training_order.read_from(spark, path).select(
        "slot", "shard", place.alias("offset"), "doc_id", "piece", "length", "ids_crc32")


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.classify(docs, language.train(docs))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, window=3, lone=1, removed_col="n_removed")
    return out.select("doc_id", "n_removed", "text")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


def op11_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each a tree of one path, and one whose texts hold the marks of the template."""
    hostile = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    formatted = reply_trees.format_trees(reply_trees.chain(turns, "conv_id", "turn"))
    return reply_trees.digest(reply_trees.read_back(formatted))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"), misspell=199)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(_table(spark, sf_dir, "documents"), order=periodic_runs.planted)


QUERIES = {f.__name__: f for f in (
    op1_quality_rank, op2_url_aliases, op3_training_order, op4_repetition, op5_packing, op6_passages, op7_language,
    op8_near_dup, op9_line_dedup, op10_decontaminate, op11_reply_trees,
    op12_spelling, op13_periodic_runs)}
