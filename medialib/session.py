"""Session settings the operators rely on, and the shared scratch folder."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_RUNS: list[list[str]] = []


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on (UTC) and those that guard against skew."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where none is set it lies in the warehouse; on a cluster that must not be a folder of one machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if warehouse.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: executors on other machines cannot read " + warehouse)
    return warehouse + "/_scratch"


@contextmanager
def scratch_run(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables settled inside are emptied when the block ends.

    Results that read them must have been written or collected by then.
    """
    _RUNS.append([])
    try:
        yield
    finally:
        for path in _RUNS.pop():
            _empty(spark, path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files once it is done; else they stay until the driver collects garbage."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def _empty(spark: SparkSession, path: str) -> None:
    """Free the space of a table by writing an empty one over it."""
    spark.range(0).coalesce(1).write.mode("overwrite").parquet(path)


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage of iterative work, survives executor loss, and gives the
    next plan real sizes so that broadcast decisions rest on measured data.
    """
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    if _RUNS:
        _RUNS[-1].append(path)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The table an iterative operator rewrites: two folders take turns, so old rounds don't pile up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.turn = spark, 0
        self.base = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if _RUNS:
            _RUNS[-1] += [f"{self.base}-0", f"{self.base}-1"]

    def settle(self, df: DataFrame) -> DataFrame:
        """Write the next round, which may read the last one but none before it."""
        path = f"{self.base}-{self.turn}"
        self.turn = 1 - self.turn
        with shuffles_freed(self.spark):
            df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
