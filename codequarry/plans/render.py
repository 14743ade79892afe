"""Bundles and graphs as JSON, Markdown and DOT. What is rendered is bounded by its budget or
limits, so it is collected."""

from __future__ import annotations

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from codequarry.functions.paths import FENCES

from .graph import Graph
from .pack import Bundle


def _dumps(value: dict) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


def _range(r: Row) -> dict:
    return {"range": {"startLine": r["start_line"], "endLine": r["end_line"]}} if r["start_line"] is not None else {}


def bundle_json(bundle: Bundle) -> str:
    items = [
        {"kind": r["kind"], "lang": r["lang"], "workspaceRoot": r["ws_root"] or ".", "filePath": r["path"]} | _range(r)
        | {"reasons": list(r["reasons"]), "content": r["content"]}
        for r in bundle.items.collect()
    ]
    omitted = [
        {"filePath": r["path"], "kind": r["kind"]} | _range(r)
        | {"reason": r["reason"], "score": r["score"], "estimatedChars": r["estimated_chars"]}
        for r in bundle.omitted.collect()
    ]
    return _dumps({"meta": bundle.meta, "items": items, "omitted": omitted})


def bundle_markdown(bundle: Bundle, reasons: bool) -> str:
    meta, items = bundle.meta, bundle.items.collect()
    spent = meta["budget"]
    out = ["# codequarry bundle", "", f"- command: {meta.get('command', '')}"]
    out.append(f"- scope: {meta['scope']['mode']} ({', '.join(meta['scope']['workspaces'])})")
    out.append(f"- budget: {spent['usedChars']}/{spent['chars']} chars")
    if "tokens" in spent:
        out.append(f"- tokens: {spent['usedTokens']}/{spent['tokens']}")
    out += [f"- {k}: {meta[k]}" for k in ("note", "generatedAt") if meta.get(k)]

    def lines(r: Row) -> str:
        return f":{r['start_line']}-{r['end_line']}" if r["kind"] == "snippet" else ""

    out += ["", "## Index"]
    for r in items:
        why = f" (reasons: {', '.join(r['reasons'])})" if reasons and r["reasons"] else ""
        out.append(f"- {r['kind']} {r['path']}{lines(r)}{why}")
    out += ([] if items else ["- (empty)"]) + ["", "## Content"]
    for r in items:
        shown = f"lines {r['start_line']}-{r['end_line']}" if r["kind"] == "snippet" else "full file"
        extension = r["path"].rsplit(".", 1)[-1].lower()
        out += [f"### {r['kind']} {r['path']} ({shown})", f"workspace: {r['ws_root'] or '.'}"]
        if reasons and r["reasons"]:
            out.append(f"reasons: {', '.join(r['reasons'])}")
        out += ["", f"```{extension if extension in FENCES else 'text'}", r["content"], "```", ""]
    left = bundle.omitted.collect() if reasons else []
    if left:
        out.append("## Omitted (budget)")
        out += [f"- {r['kind']} {r['path']}{lines(r)} (score {r['score']}, est {r['estimated_chars']} chars) - {r['reason']}" for r in left]
        out.append("")
    return "\n".join(out)


def graph_json(graph: Graph) -> str:
    nodes = [
        {"id": r["id"], "kind": r["kind"], "lang": r["lang"], "name": r["name"], "filePath": r["path"]} | _range(r)
        | {"workspaceRoot": r["ws_root"] or ".", "anchor": r["anchor"], "external": r["external"], "confidence": r["confidence"]}
        for r in graph.nodes.collect()
    ]
    edges = []
    for r in graph.edges.collect():
        site = {"callsite": {"filePath": r["site_path"], "range": {"startLine": r["site_start"], "endLine": r["site_end"]}}} if r["site_path"] else {}
        edges.append({"from": r["from_id"], "to": r["to_id"], "type": r["type"]} | site | {"confidence": r["confidence"]})
    return _dumps({"meta": graph.meta, "nodes": nodes, "edges": edges})


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"')


def _node_line(r: Row) -> str:
    name = _escaped(r["name"]).replace("\n", "\\n")
    styles = [f'label="{name}"']
    if r["anchor"]:
        styles += ['style="filled"', 'fillcolor="lightblue"']
    elif r["external"]:
        styles += ['style="dashed"', 'color="gray"']
    shape = {"class": "ellipse", "function": "diamond", "method": "diamond"}.get(r["kind"])
    return f'"{_escaped(r["id"])}" [{", ".join(styles + ([f"shape={chr(34)}{shape}{chr(34)}"] if shape else []))}];'


#: How edges are drawn, by type.
_EDGE_STYLES = {
    "imports-dynamic": ['style="dashed"'], "calls-dynamic": ['style="dashed"'], "calls-unknown": ['style="dashed"'],
    "tests": ['color="green"', 'label="tests"'], "calls": ['color="blue"'],
}


def _edge_line(r: Row) -> str:
    styles = list(_EDGE_STYLES.get(r["type"], []))
    if r["confidence"] < 0.8 and 'style="dashed"' not in styles:
        styles.append('style="dotted"')
    drawn = f" [{', '.join(styles)}]" if styles else ""
    return f'"{_escaped(r["from_id"])}" -> "{_escaped(r["to_id"])}"{drawn};'


def graph_dot(graph: Graph) -> str:
    nodes = graph.nodes.collect()
    by_root: dict[str, list[Row]] = {}
    for r in nodes:
        by_root.setdefault(r["ws_root"] or ".", []).append(r)
    out = ["digraph G {", "  rankdir=LR;", "  node [shape=box];", ""]
    if len(by_root) > 1:
        for k, (root, own) in enumerate(by_root.items()):
            out += [f"  subgraph cluster_{k} {{", f'    label="{_escaped(root)}";', *(f"    {_node_line(r)}" for r in own), "  }", ""]
    else:
        out += [f"  {_node_line(r)}" for r in nodes]
    return "\n".join([*out, "", *(f"  {_edge_line(r)}" for r in graph.edges.orderBy(F.collate("from_id", "UNICODE"), F.collate("to_id", "UNICODE"), "type").collect()), "}"])
