"""Bounded breadth-first traversal: one join a level, visited nodes dropped by an anti join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import kept


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, node, distance, edge_type) of all nodes within ``depth`` steps of each root.

    edges: src, dst, edge_type; roots: root. The type is that of the edge that discovers the
    node first when parents are visited in order. The edges and every level are kept in the
    shared folder: otherwise each level would compute all that is before it again.
    """
    edges = kept(edges.select("src", "dst", "edge_type"))
    return _reach(edges, roots, depth)


def _reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    level = kept(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("edge_type"),
                              F.array(F.col("root")).alias("_way")))
    levels = [level]
    for d in range(1, depth + 1):
        visited = reduce(DataFrame.unionByName, [x.select("root", "node") for x in levels])
        step = (
            level.select("root", F.col("node").alias("src"), "_way")
            .join(edges, "src")
            .select("root", F.col("dst").alias("node"), "edge_type", "_way")
            .join(visited, ["root", "node"], "left_anti")
            # The first way in: the parents' order decides, which their own ways carry.
            .groupBy("root", "node")
            .agg(F.min(F.struct("_way", "edge_type")).alias("_f"))
            .select(
                "root", "node", F.lit(d).alias("distance"), F.col("_f.edge_type").alias("edge_type"),
                F.concat("_f._way", F.array("node")).alias("_way"),
            )
        )
        level = kept(step)
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).drop("_way")


def reach_graph(edges: DataFrame, roots: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, distance) within ``depth`` of any root, and the edges out of every node
    nearer than ``depth``, back edges included."""
    edges = kept(edges)
    found = _reach(edges.select("src", "dst", "edge_type"), roots, depth)
    nodes = kept(found.groupBy("node").agg(F.min("distance").alias("distance")))
    expanded = nodes.where(F.col("distance") < depth).select(F.col("node").alias("src"))
    inner = edges.join(expanded, "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return nodes, inner
