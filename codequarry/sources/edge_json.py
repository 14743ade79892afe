"""Import edges as JSON text: one object a file, targets with their edge types. The older form,
a list of targets, is read too; its edges are all plain imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read_edges(df: DataFrame, text: Column) -> DataFrame:
    """(src, dst, edge_type) of rows that each hold a whole graph as JSON. Text that isn't such
    an object has no edges."""
    by_source = df.select(F.explode(F.from_json(text, "map<string,string>")).alias("src", "_targets"))
    # Either list or object: each parses as its own kind only.
    old = F.transform(F.from_json("_targets", "array<string>"), lambda d: F.struct(d.alias("dst"), F.lit("imports").alias("edge_type")))
    new = F.transform(F.map_entries(F.from_json("_targets", "map<string,string>")), lambda e: F.struct(e["key"].alias("dst"), e["value"].alias("edge_type")))
    pairs = F.when(F.col("_targets").startswith("["), old).otherwise(new)
    return by_source.select("src", F.explode(pairs).alias("e")).select("src", "e.dst", "e.edge_type").where("dst IS NOT NULL")


def write_edges(edges: DataFrame) -> DataFrame:
    """(src, targets): per file its targets and their types as JSON, in order of the targets."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("dst", "edge_type"))))
    return edges.groupBy("src").agg(F.to_json(pairs).alias("targets"))
