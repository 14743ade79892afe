"""The dependency graph around anchors: imports, calls or both; collapsed and truncated."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.operators import expand, graphs, ranking, traverse
from codequarry.operators.scratch import kept
from codequarry.sources import workspaces
from codequarry.sources.config import UsageError

from .request import Request, Resolved, resolve
from .symbols import call_edges, calls_of

NODE = ("id", "kind", "lang", "name", "path", "start_line", "end_line", "ws_root", "anchor", "external", "confidence", "seq")
EDGE = ("from_id", "to_id", "type", "site_path", "site_start", "site_end", "confidence", "seq")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    meta: dict


def _file_id(lang: Column, path: Column) -> Column:
    return F.concat_ws(":", lang, path)


def _numbered(df: DataFrame, columns: tuple[str, ...], order: list[str]) -> DataFrame:
    return ranking.global_rank(df, [F.col(c) for c in order], "seq").select(*columns)


def import_graph(resolved: Resolved, depth: int, include_tests: str) -> tuple[DataFrame, DataFrame]:
    files = resolved.index.files.select("path", "lang", "ws_root")
    anchors = kept(files.where(F.col("path").isin(resolved.anchor_paths)))
    reached, inner = traverse.reach_graph(resolved.index.imports, anchors.select(F.col("path").alias("root")), depth)
    tests = expand.tests(resolved.index.files, anchors, include_tests).select("path", "anchor_path")
    near = reached.select(F.col("node").alias("path"), "distance").unionByName(tests.select("path", F.lit(1).alias("distance")))
    near = near.groupBy("path").agg(F.min("distance").alias("distance")).join(files, "path")
    none = F.lit(None).cast("int")
    nodes = near.select(
        _file_id(F.col("lang"), F.col("path")).alias("id"), F.lit("file").alias("kind"), "lang", paths.basename(F.col("path")).alias("name"),
        "path", none.alias("start_line"), none.alias("end_line"), "ws_root", F.col("path").isin(resolved.anchor_paths).alias("anchor"),
        F.lit(False).alias("external"), F.lit(1.0).alias("confidence"), "distance",
    )
    lang = files.select("path", "lang")
    a, b = lang.select(F.col("path").alias("src"), F.col("lang").alias("_a")), lang.select(F.col("path").alias("dst"), F.col("lang").alias("_b"))
    linked = inner.select("src", "dst", F.col("edge_type").alias("type")).unionByName(
        tests.select(F.col("path").alias("src"), F.col("anchor_path").alias("dst"), F.lit("tests").alias("type"))
    )
    edges = linked.join(a, "src").join(b, "dst").select(
        _file_id(F.col("_a"), F.col("src")).alias("from_id"), _file_id(F.col("_b"), F.col("dst")).alias("to_id"), "type",
        F.lit(None).cast("string").alias("site_path"), none.alias("site_start"), none.alias("site_end"),
        F.when(F.col("type") == "imports-dynamic", 0.9).otherwise(1.0).alias("confidence"),
    )
    return _numbered(nodes, NODE, ["distance", "id"]), _numbered(edges, EDGE, ["from_id", "to_id", "type"])


def call_graph(resolved: Resolved) -> tuple[DataFrame, DataFrame]:
    """Calls in anchor files; depth has no meaning here."""
    files = resolved.index.files.select("path", "lang", "ws_root")
    calls = calls_of(call_edges(resolved.index), resolved.anchor_paths)
    home = _file_id(F.col("lang"), F.col("path"))
    caller = F.when(F.col("caller").isNull(), home).otherwise(F.concat_ws("#", home, "caller"))
    known = F.col("callee_path").isNotNull()
    callee = F.when(known, F.concat_ws("#", _file_id(F.col("lang"), F.col("callee_path")), "callee")).otherwise(
        F.concat_ws("", "lang", F.lit(":[unresolved]#"), "callee")
    )
    calls = kept(calls.select("*", caller.alias("from_id"), callee.alias("to_id")))

    def kind(symbol: Column) -> Column:
        return (
            F.when(symbol.isNull(), "file").when(symbol.rlike(r"\.(constructor|__init__)$"), "constructor")
            .when(symbol.contains("."), "method").otherwise("function")
        )

    def nodes(node_id: str, symbol: str, path: Column, external: Column, start: Column, end: Column, rank: int) -> DataFrame:
        return calls.select(
            F.col(node_id).alias("id"), kind(F.col(symbol)).alias("kind"), "lang", F.coalesce(symbol, paths.basename(path)).alias("name"),
            path.alias("path"), start.alias("start_line"), end.alias("end_line"), external.alias("external"),
            F.when(external, F.lit(0.5)).otherwise(F.lit(1.0)).alias("confidence"), F.lit(rank).alias("_rank"), F.col("seq").alias("_at"),
        )

    none = F.lit(None).cast("int")
    both = nodes("from_id", "caller", F.col("path"), F.lit(False), none, none, 0).unionByName(
        nodes("to_id", "callee", F.coalesce("callee_path", F.lit("")), ~known, none, none, 1)
    )
    own = files.select("path", "ws_root")
    both = both.join(own, "path", "left").withColumn("ws_root", F.coalesce("ws_root", F.lit("")))
    both = both.withColumn("anchor", F.col("path").isin(resolved.anchor_paths) & (F.col("_rank") == 0))
    kinds = F.when(F.col("is_dynamic"), "calls-dynamic").when(F.col("confidence") < 0.5, "calls-unknown").otherwise("calls")
    edges = calls.select(
        "from_id", "to_id", kinds.alias("type"), F.col("path").alias("site_path"), F.col("start_line").alias("site_start"),
        F.col("end_line").alias("site_end"), "confidence", F.col("seq").alias("_at"),
    )
    return _numbered(both, NODE, ["path", "_at", "_rank", "id"]), _numbered(edges, EDGE, ["site_path", "_at", "to_id"])


def build(resolved: Resolved, graph_type: str, depth: int, include_tests: str) -> tuple[DataFrame, DataFrame]:
    if graph_type == "imports":
        nodes, edges = import_graph(resolved, depth, include_tests)
    elif graph_type == "calls":
        nodes, edges = call_graph(resolved)
    elif graph_type == "combined":
        (n1, e1), (n2, e2) = import_graph(resolved, depth, include_tests), call_graph(resolved)
        late = {"seq": F.col("seq") + (1 << 40)}
        nodes, edges = n1.unionByName(n2.withColumns(late)), e1.unionByName(e2.withColumns(late))
    else:
        raise UsageError(f"graph-type is imports, calls or combined, not {graph_type}")
    return kept(graphs.merge_nodes(nodes).select(*NODE)), kept(graphs.merge_edges(edges).select(*EDGE))


def graph(spark: SparkSession, request: Request, cwd: str) -> Graph:
    return graph_of(request, resolve(spark, request, cwd, projects=True))


def graph_of(request: Request, resolved: Resolved) -> Graph:
    """The graph of a request whose anchors and files are known."""
    depth = resolved.config.depth if request.depth is None else request.depth
    nodes, edges = build(resolved, request.graph_type, depth, request.include_tests or resolved.config.include_tests)
    if not request.include_external and request.collapse == "none":
        inner = nodes.where("NOT external").select("id")
        nodes = nodes.where("NOT external")
        edges = edges.join(inner, edges["to_id"] == inner["id"], "left_semi")
    nodes, edges = graphs.collapse(nodes, edges, request.collapse)
    nodes, edges, cut = graphs.truncate(nodes, edges, request.max_nodes, request.max_edges)
    order = lambda *cs: [F.collate(c, "UNICODE") for c in cs]
    owners = [w for p in resolved.anchor_paths if (w := workspaces.owner(resolved.every, os.path.join(resolved.root, p)))]
    meta = {
        "repoRoot": os.path.relpath(resolved.root, resolved.cwd), "scope": {
            "mode": resolved.mode, "workspaces": sorted({w.root: w.ws_id for w in [*resolved.scope, *owners]}.values()),
        },
        "graphType": request.graph_type, "depth": depth, "maxNodes": request.max_nodes, "maxEdges": request.max_edges,
        "collapse": request.collapse, "truncated": cut["truncated"],
    }
    meta |= {n: cut[k] for n, k in (("truncatedNodes", "truncated_nodes"), ("truncatedEdges", "truncated_edges")) if cut[k]}
    return Graph(nodes.orderBy(*order("id")), edges.orderBy(*order("from_id", "to_id", "type")), meta)
