"""Links between pages: groups of alternates and bounded discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factflow.sources.folders import checkpointed


def groups(edges: DataFrame) -> DataFrame:
    """(node, group) over undirected edges (a, b): components of more than one node, numbered by their smallest node.

    Smallest labels spread along edges and then jump to their label's own label, until
    nothing changes; minima are combined before the shuffle.
    """
    e = edges.where("a <> b").select("a", "b")
    both = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")))
    while True:
        near = both.join(labels.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("l").alias("m"))
        low = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jump = low.join(labels.select(F.col("a").alias("m"), F.col("l").alias("j")), "m", "left").select("a", F.least("m", "j").alias("n"), (F.least("m", "j") != F.col("l")).alias("moved"))
        new = checkpointed(jump)
        labels = new.select("a", F.col("n").alias("l"))
        if new.where("moved").isEmpty():
            break
    return labels.join(_numbered(labels.select("l").distinct(), "l"), "l").select(F.col("a").alias("node"), "group")


def _numbered(values: DataFrame, column: str) -> DataFrame:
    """Distinct values with ``group``, their place from 1 in ascending order: counted range by range, no sort in one task."""
    dealt = checkpointed(values.repartitionByRange(column).select(column, F.spark_partition_id().alias("part")))
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return dealt.withColumn("k", place).join(before, "part").select(column, (F.col("k") + F.col("before")).cast("long").alias("group"))


def discover(links: DataFrame, start: DataFrame, cap: int | None = 500) -> DataFrame:
    """(node, depth) reached from ``start`` over (src, dst), breadth first, each node once; with a ``cap``, that many by (depth, node)."""
    seen = checkpointed(start.select("node", F.lit(0).alias("depth")))
    frontier, depth, count = seen, 0, seen.count()
    while cap is None or count < cap:
        depth += 1
        step = links.join(frontier.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = checkpointed(step.select("node", F.lit(depth).alias("depth")))
        more = frontier.count()
        if not more:
            break
        seen, count = checkpointed(seen.unionByName(frontier)), count + more
    return seen if cap is None else seen.orderBy("depth", "node").limit(cap)
