"""What a request names, resolved: scope, configuration, index and anchors."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.extract.index import Index, build_index
from codequarry.functions import parsing, paths, text
from codequarry.operators.candidates import CHARS_PER_LINE, SCORES
from codequarry.operators.scratch import kept
from codequarry.shipping import ship
from codequarry.sources import diff, ignore, repo, workspaces
from codequarry.sources.config import AmbiguousSymbol, AnchorNotFound, Config, UsageError, load_config
from codequarry.sources.tsconfig import load_project
from codequarry.streaming.index_store import store_key

from . import symbols


@dataclass
class Request:
    """Anchors and options; None leaves an option to the configuration."""

    entries: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)
    symbol_strict: bool = False
    from_diff: str | None = None
    from_log: str | None = None
    workspace: str | None = None
    all_workspaces: bool = False
    fallback_all: bool = False
    depth: int | None = None
    include_tests: str | None = None
    budget_chars: int | None = None
    budget_tokens: int | None = None
    redact: bool | None = None
    reason: bool = False
    folders: list[str] = field(default_factory=list)
    folder_max_mb: float = 5
    folder_hidden: bool = False
    folder_links: bool = False
    graph_type: str = "imports"
    include_external: bool = False
    max_nodes: int = 500
    max_edges: int = 2000
    collapse: str = "external"
    index: str | None = None  # a folder for parsed files, brought up to date by what changed


@dataclass
class Resolved:
    root: str
    cwd: str
    config: Config
    mode: str
    scope: list[workspaces.Workspace]
    note: str | None
    every: list[workspaces.Workspace]
    index: Index
    anchors: DataFrame  # candidates with path, start_line, end_line, score, reason, anchor, is_file
    anchor_paths: list[str]


ANCHORS = "path string, start_line int, end_line int, score int, reason string, anchor boolean, is_file boolean, ord int"


def _relative(path: str, cwd: str, root: str) -> str:
    return os.path.relpath(os.path.join(cwd, path), root)


def _within_projects(index: Index, roots: list[str], top: str) -> Index:
    """The index without import edges out of TypeScript files that belong to no project: where a
    workspace has a project file, only the sources it takes and what these import have edges."""
    projects = {os.path.relpath(r, top).removeprefix("."): p for r in roots if (p := load_project(r))}
    if not projects:
        return index
    inside = F.lit(True)
    for root, project in projects.items():
        rel = F.col("path") if not root else F.substr("path", F.lit(len(root) + 2))
        named = rel.isin(*project.files) if project.files else F.lit(False)
        taken = rel.rlike(rf"({'|'.join(e.replace('.', chr(92) + '.') for e in project.extensions)})$")
        taken = taken & (rel.rlike(project.include) if project.include else F.lit(False))
        taken = taken & ~rel.rlike(project.exclude) if project.exclude else taken
        inside = F.when((F.col("ws_root") == root) & (F.col("lang") == "ts"), named | taken).otherwise(inside)
    held = kept(index.files.select("path", inside.alias("held")))
    if held.where("NOT held").isEmpty():
        return index
    edges = index.imports.select("src", "dst")
    program = level = kept(held.where("held").select(F.col("path").alias("src")))
    while not level.isEmpty():
        level = kept(level.join(edges, "src").select(F.col("dst").alias("src")).distinct().join(program, "src", "left_anti"))
        program = kept(program.unionByName(level))
    return replace(index, known_imports=kept(index.imports.join(program, "src", "left_semi").select(*index.imports.columns)))


def resolve(spark: SparkSession, request: Request, cwd: str, projects: bool = False) -> Resolved:
    """``projects``: whether TypeScript project files say which sources have imports."""
    ship(spark)
    root = workspaces.repo_root(cwd)
    every = workspaces.detect(root)
    mode, scope, note = workspaces.scope(every, cwd, request.workspace, request.all_workspaces)
    config = load_config(root, scope[0].root if len(scope) == 1 else None)
    if request.include_tests not in (None, "auto", "true", "false"):
        raise UsageError(f"include-tests is auto, true or false, not {request.include_tests}")
    anchors: list[tuple] = []
    for e in request.entries:
        anchors.append((_relative(e, cwd, root), None, None, SCORES["entry"], "entry file", True, True, 0))
    hunks = logs = None
    if request.from_diff:
        hunks = [r.asDict() for r in diff.hunks(spark, diff.diff_text(root, request.from_diff)).orderBy("line_no").collect()]
        for path in dict.fromkeys(h["path"] for h in hunks):
            anchors.append((path, None, None, SCORES["diff file"], "diff file", True, True, 3))
        anchors += [(h["path"], h["start_line"], h["end_line"], SCORES["diff hunk"], "diff hunk", True, False, 2) for h in hunks]
    if request.from_log:
        said = Path(cwd, request.from_log).read_text("utf-8", "replace")
        logs = parsing.parse_log(diff.text_lines(spark, said)).orderBy("line_no").collect()
        anchors += [(_relative(r["path"], root, root), r["start_line"], r["end_line"], SCORES["diagnostic"], "diagnostic", True, False, 4) for r in logs]

    # Workspaces of the anchors join those in scope.
    owners = {w.root: w for a in anchors if (w := workspaces.owner(every, os.path.join(root, a[0])))}
    wider = list({w.root: w for w in [*scope, *owners.values()]}.values())

    def index_of(chosen: list[workspaces.Workspace]) -> Index:
        rules = [*ignore.ALWAYS, *config.ignore]
        for r in dict.fromkeys([root, *(w.root for w in chosen)]):
            for name in ignore.IGNORE_FILES:
                if Path(r, name).is_file():
                    rules += Path(r, name).read_text("utf-8", "replace").splitlines()
        tops = sorted(w.root for w in chosen)
        # Workspaces inside others are read with these; a file belongs to the deepest.
        outer = [t for t in tops if not any(t != o and t.startswith(o.rstrip("/") + "/") for o in tops)]
        files = None
        for top in outer:
            part = repo.read_repo(spark, top, root, rules)
            files = part if files is None else files.unionByName(part)
        rel = [os.path.relpath(t, root) for t in tops]
        home = F.lit("")
        for r in sorted(rel, key=len):
            if r != ".":
                home = F.when(paths.inside(F.col("path"), F.lit(r)), r).otherwise(home)
        placed = files.withColumn("ws_root", home)
        placed = placed.withColumn("rel_path", F.when(F.col("ws_root") == "", F.col("path")).otherwise(F.expr("substr(path, length(ws_root) + 2)")))
        store = None
        if request.index:
            told = json.dumps([sorted(rel), rules, config.import_roots])
            store = os.path.join(request.index, hashlib.sha1(f"{store_key(root, config)}|{told}".encode()).hexdigest())
        index = build_index(placed.dropDuplicates(["path"]), config.import_roots, store)
        return _within_projects(index, [w.root for w in chosen], root) if projects else index

    index = index_of(wider)
    if request.symbols:
        # Symbols are looked for in the scope alone; what is found there expands beyond it.
        roots = [os.path.relpath(w.root, root).removeprefix(".") for w in scope]
        found = kept(symbols.definitions(spark, index, request.symbols, roots))
        missing = symbols.unresolved(spark, request.symbols, found)
        if missing and request.fallback_all:
            index = index_of(every)
            found = kept(symbols.definitions(spark, index, request.symbols))
            missing = symbols.unresolved(spark, request.symbols, found)
        if missing:
            raise AnchorNotFound(f"not found: {', '.join(missing)} (try --all-workspaces or --fallback-all)")
        if request.symbol_strict and (several := symbols.ambiguous(found)):
            raise AmbiguousSymbol("; ".join(f"{q}: {', '.join(at)}" for q, at in sorted(several.items())) + " (path:name tells them apart)")
        places = found.unionByName(symbols.references(index, found, [a[0] for a in anchors])).collect()
        for r in sorted(places, key=lambda r: (request.symbols.index(r["query"]), r["role"] != "definition", r["role"], r["path"], r["start_line"])):
            reason = f"references {r['query']}" if r["role"] == "reference" else f"defines-symbol {r['query']}"
            anchors.append((r["path"], r["start_line"], r["end_line"], SCORES[r["role"]], reason, r["role"] != "reference", False, 1))
    if not anchors and not request.folders:
        raise UsageError("an anchor is needed: an entry, a symbol, a diff, a log or a folder")
    made = spark.createDataFrame(anchors, ANCHORS)
    anchor_paths = list(dict.fromkeys(a[0] for a in anchors))
    return Resolved(root, cwd, config, mode, scope, note, every, index, made, anchor_paths)


def estimated(size: Column, start: Column, end: Column) -> Column:
    snippet = F.greatest(F.lit(1), end - start + 1) * CHARS_PER_LINE
    return F.when(start.isNull(), F.coalesce(size, F.lit(0))).otherwise(snippet).cast("long")


def content_of(content: Column, start: Column, end: Column) -> Column:
    return F.when(start.isNull(), content).otherwise(text.snippet(content, start, end))
