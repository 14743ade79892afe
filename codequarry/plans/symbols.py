"""Symbols: queries to definitions, and definitions to references."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.extract.index import Index
from codequarry.functions import paths
from codequarry.operators import matching, ranking

REFERENCES = 10
CONTEXT_LINES = 3
LOCATIONS = "query string, path string, start_line int, end_line int, role string, lang string, name string"


def definitions(spark: SparkSession, index: Index, queries: list[str], roots: list[str] | None = None) -> DataFrame:
    """Locations that symbol queries name, in the workspaces at ``roots`` if these are given. Forms: name; Class.member; module.name and
    module:name (Python); path:name. A member comes with the head of its class as context."""
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    within = F.lit(True) if roots is None else reduce(or_, (paths.inside(F.col("path"), F.lit(r)) for r in roots), F.lit(False))
    d = index.definitions.where(within).select("ws_root", "path", "lang", "name", "kind", "start_line", "end_line", "owner", "owner_start", "owner_end")
    d = d.join(index.modules.select("ws_root", "path", "module"), ["ws_root", "path"], "left")
    member = F.concat_ws(".", "owner", "name")
    own = F.when(F.col("owner").isNull(), F.col("name")).otherwise(member)
    # Every spelling by which a definition can be asked for, so that queries meet it by equality.
    spellings = F.array_distinct(F.filter(F.array(
        F.when(F.col("owner").isNull(), F.col("name")), F.when(F.col("owner").isNotNull(), member),
        F.when(F.col("module").isNotNull(), F.concat_ws(".", "module", own)), F.when(F.col("module").isNotNull(), F.concat_ws(":", "module", own)),
        F.concat_ws(":", "path", own),
    ), lambda x: x.isNotNull()))
    found = F.broadcast(asked).join(d.withColumn("query", F.explode(spellings)), "query")
    places = found.select("query", "path", "start_line", "end_line", F.lit("definition").alias("role"), "lang", "name")
    context = found.where("owner IS NOT NULL AND lang = 'py'").select(
        "query", "path", F.col("owner_start").alias("start_line"),
        F.least(F.col("owner_end"), F.col("owner_start") + CONTEXT_LINES - 1).alias("end_line"),
        F.lit("context").alias("role"), "lang", F.col("owner").alias("name"),
    )
    return places.unionByName(context).distinct()


def unresolved(spark: SparkSession, queries: list[str], found: DataFrame) -> list[str]:
    asked = spark.createDataFrame([(q,) for q in queries], "query string")
    return sorted(r["query"] for r in matching.unmatched(asked, found, ["query"]).collect())


def ambiguous(found: DataFrame) -> dict[str, list[str]]:
    """Queries with more than one definition, and where the first of those are."""
    places = found.where("role = 'definition'").select("query", F.concat_ws(":", "path", "start_line").alias("place"))
    return {r["query"]: list(r["at"]) for r in matching.ambiguous(places, "query", "place").collect()}


def references(index: Index, found: DataFrame, anchor_paths: list[str]) -> DataFrame:
    """Ten references per definition: files that use the name, the definition's own file first,
    then anchor files; two lines around each use."""
    wanted = found.where("role = 'definition'").select("query", F.col("path").alias("_home"), F.col("start_line").alias("_at"), "lang", "name")
    uses = index.identifiers.join(F.broadcast(wanted), ["lang", "name"])
    score = F.when(F.col("path") == F.col("_home"), 60).otherwise(0) + F.when(F.col("path").isin(anchor_paths), 30).otherwise(0)
    uses = uses.select("query", "_home", "_at", "path", "line", "lang", "name", score.alias("_score")).distinct()
    order = [F.col("_score").desc(), F.collate("path", "UNICODE"), F.col("line")]
    best = ranking.top_per_group(uses, ["query", "_home", "_at"], order, REFERENCES, "_rank")
    ends = index.files.select("path", F.size(F.split("content", r"\r?\n", -1)).alias("_lines"))
    return best.join(ends, "path").select(
        "query", "path", F.greatest(F.lit(1), F.col("line") - 2).alias("start_line"),
        F.least(F.col("_lines"), F.col("line") + 2).alias("end_line"), F.lit("reference").alias("role"), "lang", "name",
    )


def calls_of(calls: DataFrame, files: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Calls in the files, and by the calling symbols, that are named; None names all."""
    for column, names in (("path", files), ("caller", symbols)):
        if names is not None:
            calls = calls.where(F.col(column).isin(names))
    return calls


def call_edges(index: Index) -> DataFrame:
    """Calls with callee resolved where names allow: (path, lang, caller, callee_path, callee,
    shape, confidence, is_dynamic, start_line, end_line). A name is looked up in its own file
    first, then in the files it imports, then (Python) anywhere in module order."""
    calls = index.records.where("rec = 'call'").select(
        "ws_root", "path", "lang", "seq", F.col("owner").alias("caller"), "name", F.col("kind").alias("shape"), "receiver",
        F.col("status").alias("_class"), "start_line", "end_line",
    )
    target = (
        F.when(F.col("shape") == "identifier", F.col("name"))
        .when(F.col("receiver").isin("self", "cls", "this"), F.col("_class"))
        .when(F.col("shape").isin("attribute", "property"), F.col("receiver"))
    )
    calls = calls.withColumn("_target", target)
    tops = index.definitions.where("owner IS NULL").select("lang", F.col("path").alias("_path"), F.col("name").alias("_target"), F.col("kind").alias("_kind"))
    tops = tops.distinct()
    reach = index.imports.select(F.col("src").alias("path"), F.col("dst").alias("_path")).distinct().withColumn("_imported", F.lit(1))
    named = calls.where("_target IS NOT NULL").select("path", "lang", "_target").distinct()
    options = named.join(tops, ["lang", "_target"]).join(reach, ["path", "_path"], "left")
    rank = F.when(F.col("path") == F.col("_path"), 0).when(F.col("_imported") == 1, 1).when(F.col("lang") == "py", 2)
    best = options.withColumn("_rank", rank).where("_rank IS NOT NULL").groupBy("path", "lang", "_target").agg(
        F.min_by(F.struct("_path", "_kind"), F.struct("_rank", "_path")).alias("_to")
    )
    joined = calls.join(best, ["path", "lang", "_target"], "left")
    is_class = F.col("_to._kind") == "class"
    resolved = F.col("_to").isNotNull() & ((F.col("shape") == "identifier") | is_class)
    symbol = F.when(F.col("shape") == "identifier", F.col("name")).otherwise(F.concat_ws(".", "_target", "name"))
    chain = F.when(F.col("receiver").isNotNull(), F.concat_ws(".", "receiver", "name")).otherwise(F.col("name"))
    py = F.col("lang") == "py"
    confidence = (
        F.when(F.col("shape") == "identifier", F.when(resolved, F.when(py, 0.9).otherwise(1.0)).otherwise(F.when(py, 0.7).otherwise(0.8)))
        .when(F.col("shape") == "attribute", F.when(resolved, 0.8).otherwise(0.5))
        .when(F.col("shape") == "property", F.when(resolved, 1.0).otherwise(0.6))
        .when(F.col("shape") == "chain", 0.4).when(F.col("shape").isin("on-call", "element"), 0.3)
        .when(F.col("shape") == "on-expression", 0.2).otherwise(0.1)
    )
    dynamic = ~((F.col("shape") == "identifier") | resolved)
    return joined.select(
        "ws_root", "path", "lang", "seq", "caller", F.when(resolved, F.col("_to._path")).alias("callee_path"),
        F.when(resolved, symbol).otherwise(chain).alias("callee"), "shape", confidence.alias("confidence"), dynamic.alias("is_dynamic"),
        "start_line", "end_line",
    )
