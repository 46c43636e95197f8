"""Connected components by contraction: every node hooks to its smallest neighbour, trees are flattened by pointer
jumping, and what edges remain between roots is contracted again.

Parents are smaller than their children, so a root is the least of its tree and the last root the least of its
component. A round leaves only local minima; a tree of depth d is flat after log2(d) jumps. Hubs are grouped minima,
combined map-side; every step is a written table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialib.llm.steps import Steps


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node on an edge of ``edges(a, b)`` between two nodes; named by its smallest node.

    Loops and edges with a null end tie nothing; repeated edges and both directions count once. No edges: no rows.
    """
    steps = Steps(edges.sparkSession, "components")
    now = steps.settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges-0")
    placed, k = None, 0
    while placed is None or not now.isEmpty():
        both = now.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(
            now.select(F.col("b").alias("node"), F.col("a").alias("near")))
        up = steps.settle(both.groupBy("node").agg(F.least("node", F.min("near")).alias("parent")), "parents-0")
        jump, moved = 0, True
        while moved:
            jump += 1
            above = up.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            far = steps.settle(up.select("node", "parent").join(above, "parent").select(
                "node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), f"parents-{jump % 2}")
            moved, up = not far.where("moved").isEmpty(), far.drop("moved")
        root = up.withColumnRenamed("parent", "root")
        k += 1
        if placed is None:
            placed = steps.settle(root.select("node", F.col("root").alias("component")), f"placed-{k % 2}")
        else:
            placed = steps.settle(placed.join(root.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("root", "component").alias("component")), f"placed-{k % 2}")
        ends = now.join(root.toDF("a", "ra"), "a").join(root.toDF("b", "rb"), "b").where("ra <> rb")
        now = steps.settle(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges-{k % 2}")
    return placed
