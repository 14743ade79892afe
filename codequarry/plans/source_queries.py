"""Parsers, import resolution, symbols, graphs and bundles on sources made from the driver's
tables, with SQL for the relations that must come out.

Every supplier is a Python module and every part a TypeScript one; a module imports the next
two, calls what they define and what it defines itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.extract.index import Index, build_index
from codequarry.functions import paths
from codequarry.operators import matching
from codequarry.sources.config import Config
from codequarry.sources.edge_json import read_edges, write_edges
from codequarry.sources.ignore import IgnoreMatcher

from . import graph, pack, render, symbols
from .request import ANCHORS, Request, Resolved
from .table_queries import _t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


#: Texts of the modules. {k}: the module's number, {a} and {b}: the next two; {n}, {na}, {nb}: their folders.
_PYTHON = """import os
from pkg{na}.mod{a} import helper{a}, Box{a} as Other
from . import mod{k}
importlib.import_module("pkg{nb}.mod{b}.deep")
__import__("pkg{na}.mod{a}")


class Box{k}(Other):
    def total(self, x):
        return self.size() + helper{a}(x)

    @property
    def size(self):
        return len(x.items())


def helper{k}(v):
    return Box{k}.total(v)
"""
_TYPESCRIPT = """import { make{a}, Box{a} } from "../c{na}/part{a}.js";
export * from '../c{nb}/part{b}'
// import none from "./none";
export class Box{k} {
  next: Box{a};
  open(b: Box{a}, n: number) {
    b.open(n);
    return this.next.open(n);
  }
}
export function make{k}(x: number) {
  const it = new Box{k}();
  it.open(x);
  console.log(`v ${make{a}(x)}`);
  return import("../c{na}/part{a}");
}
export type Size{k} = number;
export const twice{k} = (x: number) => make{k}(x) * 2;
"""


#: Files made, and then parsed, by a task.
FILES = 10_000


def _files(spark: SparkSession, sf_dir: str, name: str, number: str, folder: str, path: str, template: str, lang: str) -> DataFrame:
    own = _t(spark, sf_dir, name).select(F.col(number).alias("k"), F.col(folder).alias("n"))
    after = lambda step, k, n: own.select((F.col("k") - step).alias("k"), F.col("k").alias(k), F.col("n").alias(n))
    rows = own.join(after(1, "a", "na"), "k", "left").join(after(2, "b", "nb"), "k", "left")
    # Numbers are few bytes, so the join leaves few tasks, or one; texts and their parsing need many.
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, -(-own.count() // FILES)), "k")

    def filled(text: str) -> Column:
        out = F.lit(text)
        for key, value in (("k", "k"), ("n", "n")):
            out = F.replace(out, F.lit(f"{{{key}}}"), F.col(value).cast("string"))
        # The last modules import what isn't there.
        for key, other in (("a", F.col("k") + 1), ("b", F.col("k") + 2), ("na", F.lit(999)), ("nb", F.lit(999))):
            out = F.replace(out, F.lit(f"{{{key}}}"), F.coalesce(F.col(key), other).cast("string"))
        return out

    made = rows.select(F.lit("").alias("ws_root"), filled(path).alias("path"), F.lit(lang).alias("lang"), filled(template).alias("content"))
    return made.select(
        "ws_root", "path", F.col("path").alias("rel_path"), "lang", F.octet_length("content").cast("long").alias("size"), F.lit(0.0).alias("mtime_ms"), "content"
    )


def _python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "src/pkg{n}/mod{k}.py", _PYTHON, "py")


def _typescript(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "part", "p_partkey", "p_size", "web/c{n}/part{k}.ts", _TYPESCRIPT, "ts")


_PY = """
s AS (SELECT s_suppkey AS k, 'src/pkg' || s_nationkey || '/mod' || s_suppkey || '.py' AS path FROM supplier),
m AS (SELECT s.k, s.path, a.path AS pa, b.path AS pb FROM s LEFT JOIN s a ON a.k = s.k + 1 LEFT JOIN s b ON b.k = s.k + 2)"""
_TS = """
s AS (SELECT p_partkey AS k, 'web/c' || p_size || '/part' || p_partkey || '.ts' AS path FROM part),
m AS (SELECT s.k, s.path, a.path AS pa, b.path AS pb FROM s LEFT JOIN s a ON a.k = s.k + 1 LEFT JOIN s b ON b.k = s.k + 2)"""


@query(f"""WITH {_PY}
SELECT path, 'Box' || k AS name, 'class' AS kind, 8 AS start_line, 14 AS end_line, NULL AS owner FROM m
UNION ALL SELECT path, 'total', 'method', 9, 10, 'Box' || k FROM m
UNION ALL SELECT path, 'size', 'method', 12, 14, 'Box' || k FROM m
UNION ALL SELECT path, 'helper' || k, 'function', 17, 18, NULL FROM m""")
def python_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decorators belong to a definition's range."""
    return build_index(_python(spark, sf_dir), kinds=("definition",)).definitions.select("path", "name", "kind", "start_line", "end_line", "owner")


@query(f"""WITH {_PY}
SELECT path AS src, pa AS dst, 'imports' AS edge_type FROM m WHERE pa IS NOT NULL
UNION ALL SELECT path, pb, 'imports-dynamic' FROM m WHERE pb IS NOT NULL""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a module back off to it, a static import beats a dynamic one, own modules are no edges."""
    return build_index(_python(spark, sf_dir), kinds=("import",)).imports.select("src", "dst", "edge_type")


@query(f"""WITH {_TS}
SELECT path AS src, pa AS dst, 'imports-dynamic' AS edge_type FROM m WHERE pa IS NOT NULL
UNION ALL SELECT path, pb, 'imports' FROM m WHERE pb IS NOT NULL""")
def typescript_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dynamic import beats a static one; comments import nothing; .js may mean .ts."""
    return build_index(_typescript(spark, sf_dir), kinds=("import",)).imports.select("src", "dst", "edge_type")


@query(f"""WITH {_TS}
SELECT path, 'Box' || k AS name, 'class' AS kind, 4 AS start_line, 10 AS end_line FROM m
UNION ALL SELECT path, 'make' || k, 'function', 11, 16 FROM m
UNION ALL SELECT path, 'it', 'variable', 12, 12 FROM m
UNION ALL SELECT path, 'Size' || k, 'type', 17, 17 FROM m
UNION ALL SELECT path, 'twice' || k, 'variable', 18, 18 FROM m""")
def typescript_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_index(_typescript(spark, sf_dir), kinds=("definition",)).definitions.select("path", "name", "kind", "start_line", "end_line")


_CALLS = ("path", "caller", "callee_path", "callee", "shape", "confidence", "is_dynamic", "start_line")
#: Records that calls are resolved with.
_CALL_KINDS = ("definition", "import", "call")
_PY_CALLS = """
calls AS (
  SELECT path, NULL AS caller, NULL AS callee_path, 'importlib.import_module' AS callee, 'attribute' AS shape, 0.5 AS confidence, true AS is_dynamic, 4 AS start_line FROM m
  UNION ALL SELECT path, NULL, NULL, '__import__', 'identifier', 0.7, false, 5 FROM m
  UNION ALL SELECT path, 'Box' || k || '.total', path, 'Box' || k || '.size', 'attribute', 0.8, false, 10 FROM m
  UNION ALL SELECT path, 'Box' || k || '.total', pa, 'helper' || (k + 1), 'identifier', CASE WHEN pa IS NULL THEN 0.7 ELSE 0.9 END, false, 10 FROM m
  UNION ALL SELECT path, 'Box' || k || '.size', NULL, 'len', 'identifier', 0.7, false, 14 FROM m
  UNION ALL SELECT path, 'Box' || k || '.size', NULL, 'x.items', 'attribute', 0.5, true, 14 FROM m
  UNION ALL SELECT path, 'helper' || k, path, 'Box' || k || '.total', 'attribute', 0.8, false, 18 FROM m)"""


@query(f"""WITH {_PY}, {_PY_CALLS} SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM calls""")
def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callees by name: in the own file first, then in imported ones; self is the enclosing class."""
    return symbols.call_edges(build_index(_python(spark, sf_dir), kinds=_CALL_KINDS)).select(*_CALLS)


@query(f"""WITH {_TS}
SELECT path, caller, callee_path, callee, shape, CAST(confidence AS DOUBLE) AS confidence, is_dynamic, start_line FROM (
  SELECT path, 'Box' || k || '.open' AS caller, pa AS callee_path, 'Box' || (k + 1) || '.open' AS callee, 'property' AS shape,
    CASE WHEN pa IS NULL THEN 0.6 ELSE 1.0 END AS confidence, pa IS NULL AS is_dynamic, unnest([7, 8]) AS start_line FROM m
  UNION ALL SELECT path, 'make' || k, path, 'Box' || k, 'identifier', 1.0, false, 12 FROM m
  UNION ALL SELECT path, 'make' || k, path, 'Box' || k || '.open', 'property', 1.0, false, 13 FROM m
  UNION ALL SELECT path, 'make' || k, NULL, 'console.log', 'property', 0.6, true, 14 FROM m
  UNION ALL SELECT path, 'make' || k, pa, 'make' || (k + 1), 'identifier', CASE WHEN pa IS NULL THEN 0.8 ELSE 1.0 END, false, 14 FROM m
  UNION ALL SELECT path, 'twice' || k, path, 'make' || k, 'identifier', 1.0, false, 18 FROM m)""")
def typescript_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of what is annotated or a new instance; calls inside templates."""
    return symbols.call_edges(build_index(_typescript(spark, sf_dir), kinds=_CALL_KINDS)).select(*_CALLS)


@query(f"""WITH {_PY},
names AS (
  SELECT path, unnest(['Other', '__import__', 'importlib', 'import_module', 'items', 'len', 'property', 'self', 'size', 'total', 'v', 'x',
    'mod' || k, 'Box' || k, 'helper' || k, 'Box' || (k + 1), 'helper' || (k + 1)]) AS name FROM m)
SELECT name, count(*) AS files, min(path) AS first FROM names GROUP BY 1""")
def python_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names to the files that use them."""
    found = build_index(_python(spark, sf_dir), kinds=("identifier",)).identifiers.select("path", F.array("name").alias("names")).distinct()
    return matching.inverted_index(found, "path", F.col("names"))


#: What is asked for: a function, a method, a module's member, and a name that isn't there.
_ASKED = ["helper3", "Box5.total", "nowhere", "total"]


@query(f"""WITH {_PY}
SELECT 'helper3' AS query, path, 17 AS start_line, 18 AS end_line, 'definition' AS role, 'helper3' AS name FROM m WHERE k = 3
UNION ALL SELECT 'Box5.total', path, 9, 10, 'definition', 'total' FROM m WHERE k = 5
UNION ALL SELECT 'Box5.total', path, 8, 10, 'context', 'Box5' FROM m WHERE k = 5""")
def symbol_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members are asked for with their class, which comes along as context."""
    found = symbols.definitions(spark, build_index(_python(spark, sf_dir)), _ASKED)
    return found.select("query", "path", "start_line", "end_line", "role", "name")


@query("SELECT unnest(['nowhere', 'total']) AS query")
def symbol_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = symbols.definitions(spark, build_index(_python(spark, sf_dir)), _ASKED)
    return spark.createDataFrame([(q,) for q in symbols.unresolved(spark, _ASKED, found)], "query string")


@query(f"""WITH {_PY},
uses AS (
  SELECT path, 17 AS line, 60 AS score FROM m WHERE k = 3
  UNION ALL SELECT path, unnest([2, 10]), 0 FROM m WHERE k = 2)
SELECT 'helper3' AS query, path, greatest(1, line - 2) AS start_line, least(19, line + 2) AS end_line FROM uses""")
def symbol_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of a function with two lines around, its own file's first, ten at most."""
    index = build_index(_python(spark, sf_dir))
    found = symbols.references(index, symbols.definitions(spark, index, ["helper3"]), [])
    return found.select("query", "path", "start_line", "end_line")


def _resolved(spark: SparkSession, index: Index, chars: int = 28_000) -> Resolved:
    """A request that starts from the module of the smallest number."""
    first = index.files.orderBy(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long")).select("path").first()
    anchors = [first["path"]] if first else []
    made = spark.createDataFrame([(p, None, None, 800, "entry file", True, True, 0) for p in anchors], ANCHORS)
    return Resolved("/", "/", Config(budget_chars=chars), "all", [], None, [], index, made, anchors)


_REACHED = f"""{_PY},
e AS (SELECT path AS src, pa AS dst, 'imports' AS t FROM m WHERE pa IS NOT NULL UNION ALL SELECT path, pb, 'imports-dynamic' FROM m WHERE pb IS NOT NULL),
d0 AS (SELECT path FROM m WHERE k = (SELECT min(k) FROM m)),
d1 AS (SELECT dst AS path, t FROM e JOIN d0 ON src = path),
d2 AS (SELECT dst AS path, arg_min(e.t, src) AS t FROM e JOIN d1 ON src = d1.path WHERE dst NOT IN (SELECT path FROM d1) AND dst NOT IN (SELECT path FROM d0) GROUP BY 1),
n AS (SELECT path, 0 AS d, NULL AS t FROM d0 UNION ALL SELECT path, 1, t FROM d1 UNION ALL SELECT path, 2, t FROM d2)"""


@query(f"""WITH {_REACHED} SELECT 'py:' || path AS id, 'file' AS kind, d = 0 AS anchor, CAST(1.0 AS DOUBLE) AS confidence FROM n""")
def import_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes as the graph's JSON has them."""
    made = graph.graph_of(Request(graph_type="imports", depth=2), _resolved(spark, build_index(_python(spark, sf_dir))))
    nodes = json.loads(render.graph_json(made))["nodes"]
    return spark.createDataFrame([(x["id"], x["kind"], x["anchor"], float(x["confidence"])) for x in nodes], "id string, kind string, anchor boolean, confidence double")


@query(f"""WITH {_REACHED}
SELECT '"py:' || src || '" -> "py:' || dst || '"' || CASE WHEN e.t = 'imports' THEN '' ELSE ' [style="dashed"]' END || ';' AS line
FROM e JOIN n ON n.path = e.src AND n.d < 2 WHERE dst IN (SELECT path FROM n)""")
def import_graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as the graph's DOT text draws them; those out of the farthest nodes are left out."""
    made = graph.graph_of(Request(graph_type="imports", depth=2), _resolved(spark, build_index(_python(spark, sf_dir))))
    return spark.createDataFrame([(x.strip(),) for x in render.graph_dot(made).split("\n") if "->" in x], "line string")


@query(f"""WITH {_PY}, {_PY_CALLS},
c AS (SELECT * FROM calls WHERE path IN (SELECT path FROM m WHERE k = (SELECT min(k) FROM m)))
SELECT DISTINCT 'py:' || path || coalesce('#' || caller, '') AS from_id,
  CASE WHEN callee_path IS NULL THEN '__external__' ELSE 'py:' || callee_path || '#' || callee END AS to_id,
  CASE WHEN is_dynamic THEN 'calls-dynamic' WHEN confidence < 0.5 THEN 'calls-unknown' ELSE 'calls' END AS type FROM c""")
def call_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls out of the anchor; callees that aren't known are one external node."""
    made = graph.graph_of(Request(graph_type="calls", collapse="external"), _resolved(spark, build_index(_python(spark, sf_dir))))
    return made.edges.select("from_id", "to_id", "type")


@query(f"""WITH {_REACHED}, {_PY_CALLS},
c AS (SELECT * FROM calls WHERE path IN (SELECT path FROM d0) AND callee_path IS NOT NULL),
ids AS (
  SELECT 'py:' || path AS id FROM n UNION SELECT 'py:' || path || '#' || caller FROM calls WHERE path IN (SELECT path FROM d0) AND caller IS NOT NULL
  UNION SELECT 'py:' || callee_path || '#' || callee FROM c)
SELECT id, CASE WHEN id NOT LIKE '%#%' THEN 'file' WHEN split_part(id, '#', 2) LIKE '%.%' THEN 'method' ELSE 'function' END AS kind FROM ids""")
def combined_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports and calls in one graph, without external nodes."""
    made = graph.graph_of(Request(graph_type="combined", depth=2, collapse="none"), _resolved(spark, build_index(_python(spark, sf_dir))))
    return made.nodes.select("id", "kind")


_BUNDLE = f"""RECURSIVE {_REACHED},
sized AS (
  SELECT n.path, d, t, length('import os
from pkg.mod import helper, Box as Other
from . import mod
importlib.import_module("pkg.mod.deep")
__import__("pkg.mod")


class Box(Other):
    def total(self, x):
        return self.size() + helper(x)

    @property
    def size(self):
        return len(x.items())


def helper(v):
    return Box.total(v)
') + 4 * length(CAST(s.s_suppkey AS VARCHAR)) + 5 * length(CAST(a.s_suppkey AS VARCHAR)) + 2 * length(CAST(a.s_nationkey AS VARCHAR))
    + length(CAST(b.s_suppkey AS VARCHAR)) + length(CAST(b.s_nationkey AS VARCHAR)) AS chars
  FROM n JOIN m USING (path) JOIN supplier s ON s.s_suppkey = m.k JOIN supplier a ON a.s_suppkey = m.k + 1 JOIN supplier b ON b.s_suppkey = m.k + 2),
scored AS (
  SELECT path, chars, CASE d WHEN 0 THEN 800 WHEN 1 THEN 250 ELSE 150 END AS score,
    CASE WHEN d = 0 THEN 'entry file' ELSE CASE WHEN t = 'imports' THEN '' ELSE 'dynamic-' END || 'import-distance ' || d END AS reason FROM sized),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS rn FROM scored),
f AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, false AS taken, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS reason, 0 AS score
  UNION ALL SELECT r.rn, f.used + CASE WHEN f.used + r.chars <= 1200 THEN r.chars ELSE 0 END, f.used + r.chars <= 1200, r.path, r.reason, r.score
  FROM f JOIN r ON r.rn = f.rn + 1)"""


def _bundle(spark: SparkSession, sf_dir: str) -> pack.Bundle:
    made = pack.bundle(spark, Request(reason=True, depth=2), _resolved(spark, build_index(_python(spark, sf_dir)), 1200))
    made.meta |= {"command": "query"}
    return made


@query(f"""WITH {_BUNDLE} SELECT path, reason, 'kept' AS place, CAST(row_number() OVER (ORDER BY rn) AS INTEGER) AS rank FROM f WHERE rn > 0 AND taken
UNION ALL SELECT path, reason, 'omitted', CAST(row_number() OVER (ORDER BY rn) AS INTEGER) FROM f WHERE rn > 0 AND NOT taken""")
def bundle_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bundle's JSON keeps and leaves out, in its order, under 1,200 characters."""
    said = json.loads(render.bundle_json(_bundle(spark, sf_dir)))
    rows = [(x["filePath"], ", ".join(x["reasons"]), "kept", k) for k, x in enumerate(said["items"], 1)]
    rows += [(x["filePath"], x["reason"], "omitted", k) for k, x in enumerate(said["omitted"], 1)]
    return spark.createDataFrame(rows, "path string, reason string, place string, rank int")


@query(f"""WITH {_BUNDLE}
SELECT '- file ' || path || ' (reasons: ' || reason || ')' AS line FROM f WHERE rn > 0 AND taken
UNION ALL SELECT '- budget: ' || (SELECT max(used) FROM f) || '/1200 chars'""")
def bundle_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown's index and budget lines."""
    said = render.bundle_markdown(_bundle(spark, sf_dir), True).split("## Content")[0].split("\n")
    return spark.createDataFrame([(x,) for x in said if x.startswith(("- file", "- budget"))], "line string")


@query(f"""WITH {_PY}
SELECT path AS src, pa AS dst, 'imports' AS edge_type FROM m WHERE pa IS NOT NULL
UNION ALL SELECT path, pb, CASE WHEN k % 2 = 0 THEN 'imports' ELSE 'imports-dynamic' END FROM m WHERE pb IS NOT NULL""")
def edges_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges written as JSON and read back, those of even modules in the older form, which has no types."""
    edges = python_imports(spark, sf_dir)
    number = F.regexp_extract("src", r"mod(\d+)", 1).cast("long")
    targets = edges.groupBy("src").agg(F.to_json(F.collect_list("dst")).alias("targets"))
    both = write_edges(edges.where(number % 2 == 1)).unionByName(targets.where(number % 2 == 0))
    return read_edges(both, F.concat(F.lit('{"'), F.col("src"), F.lit('":'), F.col("targets"), F.lit("}")))


@query("""
WITH p AS (SELECT page_id, string_split(split_part(url, '://', 2), '/') AS ps FROM pages)
SELECT page_id, array_to_string(CASE WHEN list_position(ps, 'src') > 0 THEN list_slice(ps, list_position(ps, 'src'), len(ps)) ELSE list_slice(ps, greatest(1, len(ps) - 1), len(ps)) END, '/') AS path
FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN list_concat(list_append(ps, 'src'), ['a', 'b.ts']) ELSE ps END AS ps FROM p)""")
def source_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.substring_index("url", "://", -1)
    path = F.when(F.col("page_id") % 2 == 0, F.concat(path, F.lit("/src/a/b.ts"))).otherwise(path)
    return _t(spark, sf_dir, "pages").select("page_id", paths.source_path(path).alias("path"))


_RULES = ["node_modules/", "*.log", "build/", "!keep.log", "/web/c1*/", "pkg2/mod[0-4].py"]


@query("""
WITH p AS (
  SELECT 'web/c' || p_size || '/part' || p_partkey || '.ts' AS path FROM part
  UNION ALL SELECT 'src/pkg' || s_nationkey || '/mod' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.log' ELSE '.py' END FROM supplier
  UNION ALL SELECT 'pkg2/mod' || s_suppkey || '.py' FROM supplier
  UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a/keep.log' ELSE 'build/keep.log' END || CASE WHEN n_nationkey = 0 THEN '' ELSE CAST(n_nationkey AS VARCHAR) END FROM nation)
SELECT path, regexp_matches(path, '^web/c1[0-9]*/') OR regexp_matches(path, '[.]log$') AND NOT regexp_matches(path, '(^|/)keep[.]log$')
  OR regexp_matches(path, '^build/') OR regexp_matches(path, '^pkg2/mod[0-4][.]py$') AS ignored FROM p""")
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gitignore rules: the last that matches decides, but nothing comes back out of an ignored folder."""
    supplier, part = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "part")
    kind = F.when(F.col("s_suppkey") % 3 == 0, ".log").otherwise(".py")
    n = F.col("n_nationkey")
    listed = (
        part.select(F.concat_ws("", F.lit("web/c"), "p_size", F.lit("/part"), "p_partkey", F.lit(".ts")).alias("path"))
        .union(supplier.select(F.concat_ws("", F.lit("src/pkg"), "s_nationkey", F.lit("/mod"), "s_suppkey", kind)))
        .union(supplier.select(F.concat_ws("", F.lit("pkg2/mod"), "s_suppkey", F.lit(".py"))))
        .union(_t(spark, sf_dir, "nation").select(
            F.concat_ws("", F.when(n % 2 == 0, "a/keep.log").otherwise("build/keep.log"), F.when(n == 0, "").otherwise(n.cast("string")))))
    )
    rules = list(_RULES)

    @F.pandas_udf("boolean")
    def ignored(batch):
        import pandas as pd

        matcher = IgnoreMatcher(rules)
        return pd.Series([matcher.ignores(p) for p in batch])

    return listed.select("path", ignored("path").alias("ignored"))
