"""Named, runnable queries: each reads the tables of one folder and returns a DataFrame."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialib.plans.binding import Binding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Binding], DataFrame]):
    """Register ``fn`` under its own name."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Binding(spark, sf_dir))
    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def r6(col) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def as_long(*cols) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in cols]
