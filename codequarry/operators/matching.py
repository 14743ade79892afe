"""Joins beyond equality: deepest containing root, longest dotted prefix, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_per_group


def deepest_owner(paths: DataFrame, path: str, roots: DataFrame, root: str) -> DataFrame:
    """Each path with the longest root that holds it (none: dropped).

    No path-by-root comparison: a path is exploded into its own ancestors, as many as it has
    slashes, and these meet the roots by equality.
    """
    parts = F.split(F.col(path), "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("a"), n.alias("n"))
    )
    exploded = paths.select(path, F.explode(ancestors).alias("_x")).select(path, F.col("_x.a").alias(root), F.col("_x.n").alias("_n"))
    return exploded.join(roots.select(root).distinct(), root).groupBy(path).agg(F.max_by(root, "_n").alias(root))


def longest_prefix(names: DataFrame, name: str, known: DataFrame, key: str, value: str) -> DataFrame:
    """Each dotted name with the value of its longest known prefix: a.b.c, a.b, a."""
    parts = F.split(F.col(name), r"\.")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), ".").alias("p"), n.alias("n"))
    )
    exploded = names.select(name, F.explode(prefixes).alias("_x")).select(name, F.col("_x.p").alias(key), F.col("_x.n").alias("_n"))
    return exploded.join(known.select(key, value), key).groupBy(name).agg(
        F.max_by(value, "_n").alias(value), F.max_by(key, "_n").alias(key)
    )


def changes(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, status) of two snapshots: added, removed, changed or unchanged."""
    b = before.select(F.col(key), F.struct(*compared).alias("_b"))
    a = after.select(F.col(key), F.struct(*compared).alias("_a"))
    status = (
        F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed")
        .when(F.col("_a").eqNullSafe(F.col("_b")), "unchanged").otherwise("changed")
    )
    return b.join(a, key, "full_outer").select(key, status.alias("status"))


def is_current(before: DataFrame, after: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """One row: whether nothing was added, removed or changed."""
    return changes(before, after, key, compared).agg(
        (F.count_if(F.col("status") != "unchanged") == 0).alias("valid"), F.count_if(F.col("status") != "unchanged").alias("stale")
    )


def unmatched(asked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for and has no match."""
    return asked.join(found.select(*keys), keys, "left_anti")


def matched(asked: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """What was asked for and has a match, each row once."""
    return asked.join(found.select(*keys), keys, "left_semi")


def ambiguous(found: DataFrame, key: str, place: str, shown: int = 20) -> DataFrame:
    """(key, matches, at): keys with several different places, how many, and the first ``shown``
    of them in order. Only those are gathered; a key may have any number."""
    places = found.select(key, place).distinct()
    several = places.groupBy(key).agg(F.count(F.lit(1)).alias("matches")).where("matches > 1")
    first = top_per_group(places, [key], [F.col(place)], shown, "_rank").groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(place).alias("p")))), lambda x: x["p"]).alias("at")
    )
    return several.join(first, key)


def inverted_index(places: DataFrame, place: str, names: Column) -> DataFrame:
    """(name, files, first): in how many places each name stands, and in which first. One row
    per place with an array of its names; a name is counted once a place, before it moves."""
    said = places.select(place, F.explode(F.array_distinct(names)).alias("name"))
    return said.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.min(place).alias("first"))


def merge_kinds(found: DataFrame, root: str = "root", kind: str = "kind", name: str = "name") -> DataFrame:
    """One row per root: its kind, ``mixed`` where several were found there, and the name that the Node detector gave."""
    return found.groupBy(root).agg(
        F.when(F.min(kind) != F.max(kind), "mixed").otherwise(F.min(kind)).alias(kind),
        F.min_by(name, F.when(F.col(kind) == "node", 0).otherwise(1)).alias(name),
    )
