"""The bundle: anchors, what is near them, ranked, under a budget."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.operators import budget, candidates, expand, ranking
from codequarry.operators.scratch import kept
from codequarry.sources import folder, ignore, workspaces

from .request import Request, Resolved, content_of, estimated, resolve

COMMON = ("path", "start_line", "end_line", "score", "reason", "anchor", "ord")


@dataclass
class Bundle:
    items: DataFrame  # pick, kind, lang, ws_root, path, start_line, end_line, reasons, content
    omitted: DataFrame  # id, path, kind, start_line, end_line, reason, score, estimated_chars
    meta: dict


def _expanded(resolved: Resolved, depth: int, include_tests: str, spark: SparkSession) -> DataFrame:
    files = resolved.index.files
    anchors = files.where(F.col("path").isin(resolved.anchor_paths)).select("ws_root", "path")
    roots = spark.createDataFrame([(os.path.relpath(w.root, resolved.root).removeprefix("."),) for w in resolved.scope], "root string")
    parts = [
        expand.by_imports(resolved.index.imports, anchors, depth).withColumn("ord", F.lit(10)),
        expand.barrels(files, anchors).withColumn("ord", F.lit(11)),
        expand.tests(files, anchors, include_tests).withColumn("ord", F.lit(12)),
        expand.configs(files, roots).withColumn("ord", F.lit(13)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    none = F.lit(None).cast("int")
    return out.select("path", none.alias("start_line"), none.alias("end_line"), "score", "reason", F.lit(False).alias("anchor"), "ord")


def candidates_of(spark: SparkSession, resolved: Resolved, depth: int, include_tests: str, budget_chars: int) -> DataFrame:
    """Merged candidates with penalties and header snippets."""
    raw = resolved.anchors.select(*COMMON).unionByName(_expanded(resolved, depth, include_tests, spark))
    files = resolved.index.files.select("path", "lang", "ws_root", "size")
    order = [F.col("ord"), F.col("path"), F.col("start_line"), F.col("reason"), F.col("score").desc()]
    made = ranking.global_rank(raw.join(files, "path", "left"), order, "seq").select(
        candidates.candidate_id(F.col("path"), F.col("start_line"), F.col("end_line")).alias("id"),
        F.when(F.col("start_line").isNull(), "file").otherwise("snippet").alias("kind"),
        F.coalesce("lang", paths.language(F.col("path"))).alias("lang"), F.coalesce("ws_root", F.lit("")).alias("ws_root"), "path",
        "start_line", "end_line", "score", F.array("reason").alias("reasons"),
        estimated(F.col("size"), F.col("start_line"), F.col("end_line")).alias("estimated_chars"), "anchor",
        "seq",
    )
    merged = kept(candidates.merge_candidates(candidates.with_penalty(made)))
    headers = candidates.header_snippets(merged, budget_chars).withColumn("seq", F.col("seq") + 1_000_000)
    return candidates.merge_candidates(merged.unionByName(headers))


def pack(spark: SparkSession, request: Request, cwd: str) -> Bundle:
    return bundle(spark, request, resolve(spark, request, cwd))


def bundle(spark: SparkSession, request: Request, resolved: Resolved) -> Bundle:
    """The bundle of a request whose anchors and files are known."""
    config = resolved.config
    chars = config.budget_chars if request.budget_chars is None else request.budget_chars
    depth = config.depth if request.depth is None else request.depth
    include = request.include_tests or config.include_tests
    found = candidates_of(spark, resolved, depth, include, chars)
    contents = resolved.index.files.select("path", "content")
    full = candidates.ranked_columns(found.join(contents, "path", "left"))
    full = full.withColumn("content", content_of(F.col("content"), F.col("start_line"), F.col("end_line")))
    full = kept(full.withColumn("chars", text.utf16_length(F.col("content"))).withColumn("tokens", text.token_estimate(F.col("chars"))))
    costs, caps = ["chars"], [chars]
    if request.budget_tokens is not None:
        costs, caps = ["chars", "tokens"], [chars, request.budget_tokens]
    readable = full.where("content IS NOT NULL")
    chosen = kept(budget.select_within_budget(readable, candidates.rank_order(), costs, caps, "id"))
    used = chosen.agg(F.coalesce(F.sum("chars"), F.lit(0)).alias("c"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()
    unread = F.when(F.col("content").isNull(), F.lit("; failed to read file")).otherwise("")
    left = full.join(chosen.select("id"), "id", "left_anti").withColumn("reason", F.concat(F.array_join("reasons", "; "), unread))
    items = chosen.select("pick", "kind", "lang", "ws_root", "path", "start_line", "end_line", "reasons", "content")
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in candidates.rank_order()]
    omitted = left.orderBy(*order).select("id", "path", "kind", "start_line", "end_line", "reason", "score", "estimated_chars")
    if not request.reason:
        items = items.withColumn("reasons", F.array().cast("array<string>"))
        omitted = omitted.limit(0)
    if request.folders:
        items, omitted = _with_folders(spark, request, resolved, items, omitted)
    if request.redact or (request.redact is None and config.redact):
        items = items.withColumn("content", text.redacted(F.col("content"), config.redact_patterns))
    owners = [w for p in resolved.anchor_paths if (w := workspaces.owner(resolved.every, os.path.join(resolved.root, p)))]
    shown = sorted({w.root: w.ws_id for w in [*resolved.scope, *owners]}.values())
    meta = {
        "repoRoot": resolved.root, "scope": {"mode": resolved.mode, "workspaces": shown},
        "budget": {"chars": chars, "usedChars": used["c"]}
        | ({"tokens": request.budget_tokens, "usedTokens": used["t"]} if request.budget_tokens is not None else {}),
    }
    if request.reason and resolved.note:
        meta["note"] = resolved.note
    return Bundle(items.orderBy("pick"), omitted, meta)


def _with_folders(spark: SparkSession, request: Request, resolved: Resolved, items: DataFrame, omitted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folder entries after the selection, by path, outside the budget."""
    rules = ignore.load_rules(resolved.root)
    for n, name in enumerate(request.folders, 1):
        top = os.path.join(resolved.cwd, name)
        found = kept(folder.read_folder(spark, top, resolved.root, rules, int(request.folder_max_mb * (1 << 20)), request.folder_hidden, request.folder_links))
        rel = F.substr("path", F.lit(len(resolved.root.rstrip("/")) + 2)) if top.startswith(resolved.root) else F.col("path")
        kind = F.col("kind")
        reason = F.when(kind == "binary", "folder inclusion (binary metadata only)").when(kind == "directory", "folder inclusion (empty directory)").otherwise("folder inclusion")
        shown = (
            F.when(kind == "binary", F.concat_ws("", F.lit("[Binary file: "), "mime_type", F.lit(", "), "size", F.lit(" bytes]")))
            .when(kind == "directory", "[Empty directory]").otherwise(F.col("content"))
        )
        none = F.lit(None).cast("int")
        ranked = ranking.global_rank(found.where("kind <> 'too-large'"), [F.col("path")], "_place")
        taken = ranked.select(
            (F.col("_place") + (n << 24)).cast("int").alias("pick"), F.lit("file").alias("kind"),
            F.when((kind == "text") & F.lower("path").endswith(".py"), "py").otherwise("ts").alias("lang"), F.lit("").alias("ws_root"),
            rel.alias("path"), none.alias("start_line"), none.alias("end_line"),
            (F.array(reason) if request.reason else F.array().cast("array<string>")).alias("reasons"), shown.alias("content"),
        )
        too_large = found.where("kind = 'too-large'").select(
            F.concat(F.lit("folder:"), rel).alias("id"), rel.alias("path"), F.lit("file").alias("kind"), none.alias("start_line"), none.alias("end_line"),
            F.concat_ws("", F.lit("file exceeds max size ("), "size", F.lit(f" bytes > {int(request.folder_max_mb * (1 << 20))} bytes)")).alias("reason"),
            F.lit(0).alias("score"), F.col("size").alias("estimated_chars"),
        )
        items, omitted = items.unionByName(taken), omitted.unionByName(too_large)
    return items, omitted
