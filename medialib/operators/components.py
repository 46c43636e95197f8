"""Connected components of an edge table, by alternating star contractions.

Each pass is one grouped minimum and one equi-join, so a hub with a large share
of all edges is combined map-side and its join partition can be split by AQE.
Published as "Connected Components in MapReduce and Beyond" (Kiveris et al., 2014).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.session import Rounds


def _sum(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, src: str, dst: str, keys=("library_id",)) -> DataFrame:
    """``(keys, node, component)`` for every node on an edge; the component is its smallest node.

    Every pass but the last moves some node nearer to its smallest, so it ends on any input.
    """
    keys = list(keys)
    rounds = Rounds(edges.sparkSession, "edges")
    now = rounds.settle(edges.where(F.col(src) != F.col(dst)).select(
        *keys, F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct())
    mark = _sum(now)
    while True:
        # Neighbours larger than u move to u's smallest neighbour (or u itself).
        both = now.unionByName(now.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        wide = (both.join(low, [*keys, "u"]).where(F.col("v") > F.col("u"))
                .select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).distinct())
        # Smaller neighbours of u gather on the smallest of them.
        low = wide.groupBy(*keys, "u").agg(F.min("v").alias("_m"))
        linked = wide.join(low, [*keys, "u"])
        tight = linked.where(F.col("v") != F.col("_m")).select(
            *keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        now = rounds.settle(low.select(*keys, "u", F.col("_m").alias("v")).unionByName(tight).distinct())
        after = _sum(now)
        if after == mark:
            break
        mark = after
    leaves = now.select(*keys, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
