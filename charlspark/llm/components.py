"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charlspark.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (long) -> id, component (smallest id of the component) for every id that has an edge.

    In each round every node moves to the neighbour (or itself) that is first in an order, and the edges are contracted to
    these. The order is that of the ids in the first two rounds and every other one, which folds stars at once, and one drawn anew
    in the others, which makes a share of the nodes vanish whatever the ids are: a chain of n takes about log n rounds. All steps are grouped minima and joins whose one side has one row for each node; the names come
    from a minimum at the end."""
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        drawn = len(moves) > 1 and len(moves) % 2 == 0
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(len(moves))) if drawn else F.lit(0)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        up = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least("m", rank("a"))["to"].alias("m")))
        moves.append(up)
        moved = edges.join(up.withColumnRenamed("id", "a"), "a").select("b", F.col("m").alias("x"))
        moved = moved.join(up.select(F.col("id").alias("b"), F.col("m").alias("y")), "b").filter("x <> y")
        edges = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if not moves:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    label = moves[0].select("id", F.col("m").alias("component"))
    for up in moves[1:]:
        label = label.join(up.select(F.col("id").alias("component"), "m"), "component", "left").select("id", F.coalesce("m", "component").alias("component"))
    label = cut(label)
    names = cut(label.groupBy("component").agg(F.min("id").alias("name")))
    return label.join(names, "component").select("id", F.col("name").alias("component"))
