"""Command line: pack, graph, workspaces, version."""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

from codequarry import __version__
from codequarry.plans import render
from codequarry.plans.graph import graph
from codequarry.plans.pack import pack
from codequarry.plans.request import Request
from codequarry.sources import workspaces
from codequarry.sources.config import AnchorNotFound, UsageError


@dataclass(frozen=True)
class Flag:
    """kind: value, many, switch, int or number; name: the request's field ('' for the command's own)."""

    kind: str
    name: str
    help: str


_ANCHORS = {
    "entry": Flag("many", "entries", "anchor file"), "symbol": Flag("many", "symbols", "anchor symbol"),
    "from-diff": Flag("value", "from_diff", "anchors from git diff REV"), "from-log": Flag("value", "from_log", "anchors from a log file"),
    "workspace": Flag("value", "workspace", "workspace by name or path"), "all-workspaces": Flag("switch", "all_workspaces", "every workspace"),
    "depth": Flag("int", "depth", "import distance"), "include-tests": Flag("value", "include_tests", "auto, true or false"),
    "format": Flag("value", "", "output format"), "out": Flag("value", "", "write to a file"),
    "index": Flag("value", "index", "keep parsed files in this folder and parse only what changed"),
    "no-timestamp": Flag("switch", "", "leave the time out"), "debug": Flag("switch", "", "more messages"),
}
FLAGS: dict[str, dict[str, Flag]] = {
    "pack": _ANCHORS | {
        "symbol-strict": Flag("switch", "symbol_strict", "fail on ambiguous symbols"), "fallback-all": Flag("switch", "fallback_all", "look for symbols everywhere if need be"),
        "budget-chars": Flag("int", "budget_chars", "character budget"), "budget-tokens": Flag("int", "budget_tokens", "token budget"),
        "reason": Flag("switch", "reason", "show reasons and what was left out"), "redact": Flag("switch", "redact", "mask secrets"),
        "folder": Flag("many", "folders", "include a folder"), "folder-max-size": Flag("number", "folder_max_mb", "largest file in MB"),
        "folder-include-hidden": Flag("switch", "folder_hidden", "hidden files too"), "folder-follow-symlinks": Flag("switch", "folder_links", "follow links"),
        "debug-cache": Flag("switch", "", "accepted; indexes are Parquet tables"),
    },
    "graph": _ANCHORS | {
        "graph-type": Flag("value", "graph_type", "imports, calls or combined"), "include-external": Flag("switch", "include_external", "external nodes"),
        "max-nodes": Flag("number", "max_nodes", "most nodes"), "max-edges": Flag("number", "max_edges", "most edges"),
        "collapse": Flag("value", "collapse", "none, external, file or class"), "scope": Flag("value", "", "accepted, without effect"),
        "python-engine": Flag("value", "", "accepted, without effect"),
    },
    "workspaces": {"format": Flag("value", "", "json or text")},
    "version": {},
}


def parse(command: str, argv: list[str]) -> tuple[dict, dict]:
    """(request fields, the command's own options). ``--k v`` and ``--k=v``; a value doesn't
    begin with two dashes; there are no positional arguments."""
    fields: dict = {}
    own: dict = {}
    args = list(argv)
    while args:
        word = args.pop(0)
        if not word.startswith("--"):
            raise UsageError(f"unexpected argument: {word}")
        key, given, value = word[2:].partition("=")
        flag = FLAGS[command].get(key)
        if flag is None:
            raise UsageError(f"unknown flag: --{key}")
        if flag.kind == "switch":
            (fields if flag.name else own)[flag.name or key] = True
            continue
        if not given:
            if not args or args[0].startswith("--"):
                raise UsageError(f"--{key} needs a value")
            value = args.pop(0)
        if flag.kind in ("int", "number"):
            try:
                value = int(value) if flag.kind == "int" else float(value)
            except ValueError:
                raise UsageError(f"--{key} needs a number, not {value}") from None
            if flag.kind == "int" and value < 0:
                raise UsageError(f"--{key} can't be negative")
            if flag.name.startswith("max_"):
                value = int(value)
        if flag.kind == "many":
            fields.setdefault(flag.name, []).append(value)
        else:
            (fields if flag.name else own)[flag.name or key] = value
    if fields.get("workspace") and fields.get("all_workspaces"):
        raise UsageError("--workspace and --all-workspaces exclude each other")
    return fields, own


def usage() -> str:
    lines = ["codequarry COMMAND [flags]", ""]
    for command, flags in FLAGS.items():
        lines.append(command)
        lines += [f"  --{k:<24}{f.help}" for k, f in flags.items()]
    return "\n".join(lines)


def _session() -> SparkSession:
    spark = (
        SparkSession.builder.appName("codequarry").master(os.environ.get("SPARK_MASTER", "local[*]"))
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(argv: list[str], cwd: str, spark: SparkSession | None = None) -> tuple[str, dict]:
    """The command's output and its own options."""
    command = argv[0] if argv else "--help"
    if command in ("--help", "help", "-h") or "--help" in argv[1:]:
        return usage(), {}
    if command not in FLAGS:
        raise UsageError(f"unknown command: {command}")
    fields, own = parse(command, argv[1:])
    if command == "version":
        return __version__, own
    if command == "workspaces":
        found = workspaces.detect(workspaces.repo_root(cwd))
        if own.get("format", "json") == "text":
            return "\n".join(f"{w.ws_id}\t{w.name}\t{w.kind}" for w in found), own
        return json.dumps([{"id": w.ws_id, "name": w.name, "root": w.ws_id, "kind": w.kind} for w in found], indent=2), own
    formats = {"pack": ("json", "md"), "graph": ("json", "dot")}[command]
    form = own.get("format", "json")
    if form not in formats:
        raise UsageError(f"--format is {' or '.join(formats)}, not {form}")
    request = Request(**fields)
    anchors = request.entries or request.symbols or request.from_diff or request.from_log
    if not anchors and not (command == "pack" and request.folders):
        raise UsageError("an anchor is needed: --entry, --symbol, --from-diff or --from-log")
    spark = spark or _session()
    made = (pack if command == "pack" else graph)(spark, request, cwd)
    stamp = {} if own.get("no-timestamp") else {"generatedAt": dt.datetime.now(dt.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")}
    made.meta |= {"command": f"codequarry {' '.join(argv)}"} | stamp
    if command == "pack":
        return (render.bundle_json(made) if form == "json" else render.bundle_markdown(made, request.reason)), own
    return (render.graph_json(made) if form == "json" else render.graph_dot(made)), own


def main(argv: list[str] | None = None) -> int:
    cwd = os.getcwd()
    try:
        output, own = run(sys.argv[1:] if argv is None else argv, cwd)
    except AnchorNotFound as e:
        print(e, file=sys.stderr)
        return 2
    except UsageError as e:
        print(e, file=sys.stderr)
        return 3
    except Exception as e:  # noqa: BLE001
        print(f"failed: {e}", file=sys.stderr)
        return 1
    if own.get("out"):
        Path(cwd, own["out"]).write_text(output, "utf-8")
    else:
        print(output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
