"""A training corpus from raw documents, in five stages over Parquet.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Null and empty texts, ties and repeated rows are treated as the operators' docstrings say.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialib.llm import decontaminate, line_dedup, near_dup, packing, quality_rank
from medialib.llm.steps import Steps

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates of the corpus: five words a shingle, four fifths of them in common.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier accepts; it is trained on the labelled ones among ``docs`` outside the held-out fold."""
    model = quality_rank.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rank.score(docs, model, carry=COLUMNS).where("predicted = 1").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of a line; documents left without a word have been repeats throughout and go."""
    out = line_dedup.dedup_lines(docs.select(COLUMNS), window=3, lone=1, removed_col="n_removed")
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return out.where(~emptied).withColumn(
        "n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: its smallest id, of that id's texts in the group the one of least hash."""
    found = near_dup.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT, hash_col="hash", group_col="group")
    kept = found.where("kept and doc_id is not null").groupBy("doc_id", "group").agg(F.min("hash").alias("hash"))
    # Merged at every size, as most documents are kept; repeated rows then already lie together.
    own = docs.select(*COLUMNS, F.xxhash64("text").alias("hash"))
    rows = own.join(kept.select("doc_id", "hash").hint("merge"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
    return rows.select(COLUMNS).unionByName(docs.select(COLUMNS).where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hash_col="hash")
    hit = found.where("n_hit > 0").select("doc_id", "hash").distinct()
    own = docs.select(*COLUMNS, F.xxhash64("text").alias("hash"))
    return own.join(hit, ["doc_id", "hash"], "left_anti").select(COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's pieces and their places in sequences of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark),
          ("sequences", sequences)]
#: The learnt classifier, MinHash candidates and the tokenizer are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    steps = Steps(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = steps.settle(stage(spark, docs, sf_dir), name)
    return docs
