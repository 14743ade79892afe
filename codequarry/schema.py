"""Schemas of the relations that a source repository is modelled as."""

from __future__ import annotations

RANGE = "struct<start_line:int,end_line:int>"

WORKSPACES = "ws_id string, name string, root string, kind string"
FILES = "ws_root string, path string, rel_path string, lang string, size bigint, mtime_ms double, content string"
MODULES = "ws_root string, module string, path string, seq int"
DEFINITIONS = (
    "ws_root string, path string, lang string, seq int, name string, kind string, start_line int, end_line int, "
    "class_name string, class_start int, class_end int"
)
SPECIFIERS = "ws_root string, path string, lang string, seq int, specifier string, names array<string>, level int, is_dynamic boolean"
CALLS = (
    "ws_root string, path string, lang string, seq int, caller string, callee string, receiver string, shape string, "
    "start_line int, end_line int"
)
IDENTIFIERS = "ws_root string, path string, lang string, name string, line int"
IMPORT_EDGES = "ws_root string, src string, dst string, edge_type string"
CANDIDATES = (
    "id string, kind string, lang string, ws_id string, ws_root string, path string, start_line int, end_line int, "
    "score int, reasons array<string>, estimated_chars bigint, anchor boolean, seq bigint"
)
NODES = (
    "id string, kind string, lang string, name string, path string, start_line int, end_line int, ws_root string, "
    "anchor boolean, external boolean, confidence double, seq bigint"
)
EDGES = (
    "from_id string, to_id string, type string, site_path string, site_start int, site_end int, confidence double, seq bigint"
)
