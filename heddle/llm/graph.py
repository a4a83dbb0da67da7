"""Connected components of an edge table by alternating star contractions, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import durable

#: Tasks of a round: at least these, and one for so many edges.
LEAST_TASKS, EDGES_A_TASK = 12, 20_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Every neighbour of a node that is larger than the node is hung on the smallest of them all."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """A node and its smaller neighbours are hung on the smallest neighbour; ``u > v`` holds for all edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").coalesce(tasks).distinct().coalesce(tasks)


def components(pairs: DataFrame, left: str, right: str, most_rounds: int = 60) -> DataFrame:
    """Rows ``node, component``: each node of an edge with the smallest node that it reaches.

    Edges are directed to the smaller end and repeatedly re-hung, which keeps every hub's work spread over
    map-side minima and joins that can be split. Each round is written to the checkpoint folder. It ends
    when every node hangs on a node that hangs on nothing: no edge's lower end is another's upper end.
    A round's tasks follow the number of edges, not the session's partitions: a small graph in many of these is all start-up.
    Null ends and loops are left out; an empty table gives an empty one.
    """
    edges = durable(
        pairs.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    tasks = max(LEAST_TASKS, edges.count() // EDGES_A_TASK)
    edges = edges.coalesce(tasks)
    for _ in range(most_rounds):
        # Each node as an upper end (how often) and as a lower end: settled if none is both, or twice an upper end.
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("low")))
        if not ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("low").alias("low")).coalesce(tasks).filter("up > 1 or up = 1 and low = 1").head(1):
            break
        edges = durable(_small_star(_large_star(edges, tasks), tasks))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
