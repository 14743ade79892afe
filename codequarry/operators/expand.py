"""Expansion of anchors: imports within reach, barrels, related tests, configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths

from .candidates import SCORES, distance_score
from .traverse import reach

#: Files that speak for their directory, and framework configuration.
BARRELS = ("index.ts", "index.tsx", "index.js", "index.jsx")
CONFIGS = (
    "next.config.js", "next.config.mjs", "next.config.ts", "next-env.d.ts", "vite.config.ts", "vite.config.js",
    "svelte.config.js", "remix.config.js",
)


def test_stem(path: Column) -> Column:
    """The name of what a file tests (x.test.*, x.spec.*, test_x.*); null for other files."""
    name = paths.basename(path)
    found = F.regexp_extract(name, r"^(.*)\.(?:test|spec)\.[^/]*$", 1)
    python = F.regexp_extract(name, r"^test_(.*)\.[^.]*$", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(python, F.lit("")))


def wants_tests(path: Column, include: str) -> Column:
    """false: no, true: yes, auto: for files below src or lib."""
    return {"true": F.lit(True), "false": F.lit(False)}.get(include, paths.under_source(F.concat(F.lit("/"), path)))


def by_imports(edges: DataFrame, anchors: DataFrame, depth: int) -> DataFrame:
    """(path, score, reason) of files within ``depth`` imports of each anchor (column path)."""
    found = reach(edges, anchors.select(F.col("path").alias("root")), depth).where("distance > 0")
    reason = F.concat(F.when(F.col("edge_type") == "imports-dynamic", "dynamic-").otherwise(""), F.lit("import-distance "), F.col("distance").cast("string"))
    return found.select(F.col("node").alias("path"), distance_score(F.col("distance")).alias("score"), reason.alias("reason"), F.col("root").alias("anchor_path"))


def barrels(files: DataFrame, anchors: DataFrame) -> DataFrame:
    """The first barrel beside each anchor."""
    rank = F.array_position(F.array(*(F.lit(b) for b in BARRELS)), paths.basename(F.col("path")))
    beside = files.where(paths.basename(F.col("path")).isin(*BARRELS)).select("path", paths.dirname(F.col("path")).alias("_dir"), rank.alias("_rank"))
    first = beside.groupBy("_dir").agg(F.min_by("path", "_rank").alias("path"))
    return anchors.select(F.col("path").alias("anchor_path"), paths.dirname(F.col("path")).alias("_dir")).join(first, "_dir").select(
        "path", F.lit(SCORES["barrel"]).alias("score"), F.lit("barrel file").alias("reason"), "anchor_path"
    )


def tests(files: DataFrame, anchors: DataFrame, include: str) -> DataFrame:
    """Test files named after an anchor in its workspace."""
    named = files.select("ws_root", "path", test_stem(F.col("path")).alias("_stem")).where("_stem IS NOT NULL")
    wanted = anchors.where(wants_tests(F.col("path"), include)).select("ws_root", F.col("path").alias("anchor_path"), paths.stem(F.col("path")).alias("_stem"))
    return wanted.join(named, ["ws_root", "_stem"]).select(
        "path", F.lit(SCORES["test"]).alias("score"), F.lit("related test").alias("reason"), "anchor_path"
    )


def configs(files: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Framework configuration at the roots of the workspaces (column root)."""
    named = files.where(paths.basename(F.col("path")).isin(*CONFIGS)).withColumn("root", paths.dirname(F.col("path")))
    return named.join(workspaces.select("root").distinct(), "root", "left_semi").select(
        "path", F.lit(SCORES["config"]).alias("score"), F.lit("config booster").alias("reason"), F.lit(None).cast("string").alias("anchor_path")
    )
