"""Top-k and ordering helpers that never gather an unbounded group in one task."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Above this k, ranking goes through salted sub-groups first. At or below it
# Spark's own group-limit operator already trims every map task to k rows.
DIRECT_LIMIT = 600


def top_k(df: DataFrame, keys, order, k: int, rank_col: str = "rank",
          salt: str = "id", salts: int = 64) -> DataFrame:
    """First ``k`` rows of each key in ``order`` (a total order), with their rank.

    A key holding a large share of the table is first cut to k rows inside
    each of ``salts`` sub-groups, so the final sort of a key sees at most
    ``k * salts`` rows whatever the size of the group.
    """
    keys = list(keys)
    if k > DIRECT_LIMIT:
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", F.pmod(F.xxhash64(F.col(salt)), F.lit(salts)))
              .withColumn("_rank", F.row_number().over(part))
              .where(F.col("_rank") <= k).drop("_salt", "_rank"))
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(whole))
            .where(F.col(rank_col) <= k))


def sliced_position(df: DataFrame, keys, value: str, width: int,
                    out: str = "position") -> DataFrame:
    """Zero-based position of a unique integer ``value`` within its key.

    Rows are ranked inside slices of ``width`` consecutive values (so at most
    ``width`` rows each) and shifted by the running count of earlier slices;
    no task ever sorts a whole key.
    """
    keys = list(keys)
    sliced = df.withColumn("_slice", F.floor(F.col(value) / F.lit(width)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
              .drop("_n"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(value)
    return (sliced.withColumn("_in", F.row_number().over(inside) - 1)
            .join(starts, [*keys, "_slice"])
            .withColumn(out, F.col("_start") + F.col("_in"))
            .drop("_slice", "_in", "_start"))


def shuffle_key(seed, *cols) -> Column:
    """Deterministic stand-in for a random draw: 60 bits of an md5 of seed and ids."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str)
                                                else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def upper_median(df: DataFrame, keys, value: str, step: float, out: str) -> DataFrame:
    """Element ``n div 2`` of each key's sorted values.

    Values are counted per ``step`` first; only the step that holds the wanted
    element is ranked row by row, so large keys are narrowed before any sort.
    """
    keys = list(keys)
    stepped = df.select(*keys, value).withColumn("_step", F.floor(F.col(value) / F.lit(step)))
    running = Window.partitionBy(*keys).orderBy("_step")
    whole = Window.partitionBy(*keys)
    found = (stepped.groupBy(*keys, "_step").agg(F.count("*").alias("_n"))
             .withColumn("_upto", F.sum("_n").over(running))
             .withColumn("_want", F.floor(F.sum("_n").over(whole) / 2))
             .where((F.col("_want") >= F.col("_upto") - F.col("_n")) & (F.col("_want") < F.col("_upto")))
             .withColumn("_at", F.col("_want") - F.col("_upto") + F.col("_n") + 1)
             .select(*keys, "_step", "_at"))
    inside = Window.partitionBy(*keys, "_step").orderBy(value)
    return (stepped.join(found, [*keys, "_step"])
            .withColumn("_rn", F.row_number().over(inside))
            .where(F.col("_rn") == F.col("_at"))
            .select(*keys, F.col(value).alias(out)))
