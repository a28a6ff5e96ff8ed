"""Connected components of an edge table by repeated contraction, with DataFrame operations only.

Each round every node takes its least neighbour as parent, parents are followed twice, and edges
move to the parents; self-loops and repeated edges go. Parents are always less than their
children, so there are no cycles, and the edges shrink by a factor each round. Nothing is
collected; each round's tables are written to the shared folder and deleted after the next. Edges are
distinct and joined on their ends as plain tables, so AQE splits what a node with many edges has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) -> (node, root): the least node of each node's component, for nodes with an edge.

    Edges with a null end and self-loops link nothing. Nodes without edges are not returned.
    """
    edges = materialize(edges.where("u <> v").select("u", "v"), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = materialize(both.groupBy("u").agg(F.min("v").alias("p")).select(F.col("u").alias("node"), F.least("u", "p").alias("parent")), "parents")
        upper = first.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        parents = materialize(first.join(upper, "parent").select("node", F.col("grand").alias("parent")), "grandparents")
        at_u = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        at_v = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = edges.join(at_u, "u").join(at_v, "v").where("pu <> pv")
        done, edges = [first, edges], materialize(moved.select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
        if roots is None:
            roots = parents.select("node", F.col("parent").alias("root"))
        else:
            step = parents.select(F.col("node").alias("root"), F.col("parent").alias("next"))
            done, roots = [*done, parents, roots], materialize(roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        for table in done:
            drop_table(table)
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
