"""Intermediate tables of one operator run, in the shared folder of the session."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from medialib.session import scratch_dir, shuffles_freed


class Steps:
    """Written tables that cut lineage: they outlive a lost executor and give the next plan measured sizes."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` under ``label`` and read it back; an earlier table of that label is replaced."""
        path = f"{self.root}/{label}"
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *labels: str) -> None:
        """Free the space of tables no later plan reads, by writing an empty table over each."""
        for label in labels:
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{label}")
