"""Tables that streams write to: plain Parquet, one folder of changed rows per batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BASE = -1


class Upserts:
    """Rows by key under ``root/batch=<n>``; of the rows of a key the last batch's counts.

    A batch writes what it changed and nothing else. A batch run again after a failure overwrites its own folder.
    ``tombstone``: a column that is true where the row stands for a deleted key.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: str, tombstone: str | None = None):
        self.spark, self.root, self.keys, self.schema, self.tombstone = spark, root.rstrip("/"), keys, schema, tombstone
        self.fields = StructType.fromDDL(schema).fields

    def start(self, rows: DataFrame | None = None) -> "Upserts":
        """Lay down the rows the table starts from (none by default), unless it exists; the end state of another table
        of the kind makes a new one without its history."""
        first = rows if rows is not None else self.spark.createDataFrame([], self.schema)
        self._typed(first).write.mode("ignore").parquet(f"{self.root}/batch={BASE}")
        return self

    def _typed(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields])

    def write(self, changed: DataFrame, batch: int) -> None:
        self._typed(changed).write.mode("overwrite").parquet(f"{self.root}/batch={batch}")

    def read(self, below: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Current rows, before batch ``below``; ``only``: those whose key columns occur in that table."""
        rows = self.spark.read.schema(f"{self.schema}, batch BIGINT").parquet(self.root)
        if below is not None:
            rows = rows.where(F.col("batch") < below)
        if only is not None:
            keys = [k for k in self.keys if k in only.columns]
            rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
        names = [f.name for f in self.fields]
        rest = [c for c in names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
        if self.tombstone:
            newest = newest.where(~F.coalesce(F.col(f"_row.{self.tombstone}"), F.lit(False)))
        return newest.select(*[F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in names])

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: what an update-mode query emits goes to the table."""
        return lambda batch, n: self.write(batch, n)
