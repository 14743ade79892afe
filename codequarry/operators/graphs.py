"""Operators on property graphs held as two tables: merging, collapsing, truncating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_group
from .scratch import kept

EXTERNAL = "__external__"


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """By id: first given wins, anchor if any, highest confidence."""
    rest = [c for c in nodes.columns if c not in ("id", "anchor", "confidence", "seq")]
    return nodes.groupBy("id").agg(
        F.bool_or("anchor").alias("anchor"), F.max("confidence").alias("confidence"), F.min("seq").alias("seq"),
        F.min_by(F.struct(*rest), "seq").alias("_rest"),
    ).select("id", "_rest.*", "anchor", "confidence", "seq")


def merge_edges(edges: DataFrame) -> DataFrame:
    """By ends and type: the first given wins, its call site with it."""
    return first_per_group(edges, ["from_id", "to_id", "type"], [F.col("seq").asc()])


def merge_edge_types(edges: DataFrame, lang: Column) -> DataFrame:
    """One type per (src, dst): for TypeScript dynamic beats static, for Python the reverse.
    'imports' sorts before 'imports-dynamic'."""
    return (
        edges.groupBy("ws_root", "src", "dst", lang.alias("lang"))
        .agg(F.min("edge_type").alias("_least"), F.max("edge_type").alias("_most"))
        .select("ws_root", "src", "dst", F.when(F.col("lang") == "py", F.col("_least")).otherwise(F.col("_most")).alias("edge_type"))
    )


def _moved(edges: DataFrame, places: DataFrame) -> DataFrame:
    """Edges with ends replaced by (id, new_id), where there is one."""
    a = places.select(F.col("id").alias("from_id"), F.col("new_id").alias("_a"))
    b = places.select(F.col("id").alias("to_id"), F.col("new_id").alias("_b"))
    out = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    return out.withColumn("from_id", F.coalesce("_a", "from_id")).withColumn("to_id", F.coalesce("_b", "to_id")).drop("_a", "_b")


def collapse_external(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All external nodes as one; edges between them go; the one node only if it has edges."""
    nodes, edges = kept(nodes), kept(edges)
    places = nodes.where("external").select("id", F.lit(EXTERNAL).alias("new_id"))
    moved = merge_edges(_moved(edges, places).where(F.col("from_id") != F.col("to_id")))
    touched = moved.where((F.col("from_id") == EXTERNAL) | (F.col("to_id") == EXTERNAL)).limit(1)
    made = {
        "id": F.lit(EXTERNAL), "kind": F.lit("external"), "name": F.lit("external"), "path": F.lit(""), "external": F.lit(True),
        "anchor": F.lit(False), "confidence": F.lit(1.0), "start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int"),
    }
    sink = nodes.where("external").orderBy("seq").limit(1).withColumns(made)
    sink = sink.join(touched.select(F.lit(EXTERNAL).alias("id")), "id", "left_semi").select(*nodes.columns)
    return nodes.where("NOT external").unionByName(sink), moved


def _collapse(nodes: DataFrame, edges: DataFrame, new_id: Column, change: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    placed = nodes.withColumn("_new", new_id)
    places = placed.where(F.col("_new") != F.col("id")).select("id", F.col("_new").alias("new_id"))
    changed = placed.withColumns({c: F.when(F.col("_new") != F.col("id"), v).otherwise(F.col(c)) for c, v in change.items()})
    merged = merge_nodes(changed.drop("id").withColumnRenamed("_new", "id").select(*nodes.columns))
    moved = _moved(edges, places).where(F.col("from_id") != F.col("to_id"))
    return merged.select(*nodes.columns), merge_edges(moved)


def collapse_to_file(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols become their files; edges within a file go."""
    file_id = F.when(F.col("external"), F.col("id")).otherwise(F.substring_index("id", "#", 1))
    none = F.lit(None).cast("int")
    return _collapse(
        nodes, edges, file_id,
        {"kind": F.lit("file"), "name": F.substring_index("path", "/", -1), "start_line": none, "end_line": none},
    )


def collapse_to_class(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Methods become their classes; other nodes stay."""
    symbol = F.regexp_extract("id", r"#([^#]*)$", 1)
    owner = F.substring_index(symbol, ".", 1)
    new_id = F.when(symbol.contains("."), F.concat(F.substring_index("id", "#", 1), F.lit("#"), owner)).otherwise(F.col("id"))
    return _collapse(nodes, edges, new_id, {"kind": F.lit("class"), "name": owner})


def collapse(nodes: DataFrame, edges: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    by = {"external": collapse_external, "file": collapse_to_file, "class": collapse_to_class}
    if mode == "none":
        return nodes, edges
    if mode not in by:
        raise ValueError(f"unknown collapse mode: {mode}")
    return by[mode](nodes, edges)


def truncate(nodes: DataFrame, edges: DataFrame, max_nodes: int, max_edges: int) -> tuple[DataFrame, DataFrame, dict]:
    """The first nodes - anchors always, then internal before external, by confidence and id -
    and, of the edges between them, the first by confidence, type and ends. Both are
    distributed top-k; the counts say what was cut."""
    nodes, edges = kept(nodes), kept(edges)
    counted = nodes.agg(F.count_if("anchor").alias("anchors"), F.count(F.lit(1)).alias("n")).first()
    anchors, n = counted["anchors"], counted["n"]
    room = max(0, max_nodes - anchors)
    others = nodes.where("NOT anchor").orderBy(F.col("external").asc(), F.col("confidence").desc(), F.col("id").asc()).limit(room)
    held = nodes.where("anchor").unionByName(others) if n > max_nodes else nodes
    ids = held.select(F.col("id").alias("_id"))
    inner = kept(edges.join(ids, edges["from_id"] == ids["_id"], "left_semi").join(ids, edges["to_id"] == ids["_id"], "left_semi"))
    m = inner.count()
    cut = inner.orderBy(F.col("confidence").desc(), "type", "from_id", "to_id").limit(max_edges) if m > max_edges else inner
    left_out = {"truncated_nodes": max(0, n - max(max_nodes, anchors)), "truncated_edges": max(0, m - max_edges)}
    return held, cut, {"truncated": any(left_out.values())} | left_out
