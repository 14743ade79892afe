"""Every relational operator of the engine on the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions import parsing, paths, text
from codequarry.operators import benchstats, budget, candidates, graphs, matching, ranking, traverse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates: score by label and language, less the size penalty."""
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    labels = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    score = 800 * F.coalesce("q", F.lit(0)) + F.when(F.col("lang") == "en", 120).otherwise(0)
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", "n_chars", (score - ranking.size_penalty(F.col("n_chars"))).cast("int").alias("score")
    )


_SCORED = """
scored AS (
  SELECT doc_id, n_chars, CAST(800 * coalesce(q, 0) + CASE WHEN lang = 'en' THEN 120 ELSE 0 END
    - least(200, floor(n_chars / 1000) * 10) AS INTEGER) AS score
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) USING (doc_id))"""


@query(f"""
WITH RECURSIVE {_SCORED},
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM scored),
f AS (
  SELECT 0 AS rn, CAST(0 AS BIGINT) AS used, false AS taken, CAST(0 AS BIGINT) AS picks, CAST(NULL AS BIGINT) AS doc_id
  UNION ALL
  SELECT r.rn, f.used + CASE WHEN f.used + r.n_chars <= 28000 THEN r.n_chars ELSE 0 END, f.used + r.n_chars <= 28000,
    f.picks + CASE WHEN f.used + r.n_chars <= 28000 THEN 1 ELSE 0 END, r.doc_id
  FROM f JOIN r ON r.rn = f.rn + 1)
SELECT f.doc_id, s.score, s.n_chars, CAST(f.picks AS INTEGER) AS pick, (SELECT max(used) FROM f) AS used_n_chars
FROM f JOIN scored s USING (doc_id) WHERE f.taken""")
def pack_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: best documents first, greedily under 28,000 characters."""
    return budget.select_within_budget(
        _scored(spark, sf_dir), [("score", True), ("doc_id", False)], ["n_chars"], [28_000], "doc_id"
    ).select("doc_id", "score", "n_chars", "pick", "used_n_chars")


@query("""
WITH RECURSIVE r AS (
  SELECT conv_id, turn, length(text) AS chars, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS uc, CAST(0 AS BIGINT) AS ut, CAST(NULL AS BIGINT) AS turn, false AS taken FROM r
  UNION ALL
  SELECT r.conv_id, r.rn, f.uc + CASE WHEN f.uc + chars <= 700 AND f.ut + tokens <= 150 THEN chars ELSE 0 END,
    f.ut + CASE WHEN f.uc + chars <= 700 AND f.ut + tokens <= 150 THEN tokens ELSE 0 END, r.turn,
    f.uc + chars <= 700 AND f.ut + tokens <= 150
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.rn = f.rn + 1)
SELECT conv_id, turn, max(uc) OVER (PARTITION BY conv_id) AS used_chars, max(ut) OVER (PARTITION BY conv_id) AS used_tokens
FROM f QUALIFY taken""")
def budget_two_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and tokens at once, one request per conversation."""
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.utf16_length(F.col("text")).alias("chars"))
    rows = rows.withColumn("tokens", text.token_estimate(F.col("chars"))).withColumn("_turn", F.col("turn"))
    return budget.select_per_group(rows, ["conv_id"], "_turn", ["chars", "tokens"], [700, 150], "turn")


@query("""
WITH c AS (
  SELECT source || ':' || lang AS id, doc_id AS seq, CAST(700 - (n_chars % 500) AS INTEGER) AS score, doc_id % 97 = 0 AS anchor,
    'lang ' || lang || ' ' || (doc_id % 3) AS reason, n_chars FROM documents),
r AS (SELECT id, reason, min(seq) AS s FROM c GROUP BY 1, 2),
j AS (SELECT id, string_agg(reason, ',' ORDER BY s) AS reasons FROM r GROUP BY 1)
SELECT id, max(score) AS score, bool_or(anchor) AS anchor, any_value(j.reasons) AS reasons, arg_min(n_chars, seq) AS n_chars, min(seq) AS seq
FROM c JOIN j USING (id) GROUP BY id""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    made = d.select(
        F.concat_ws(":", "source", "lang").alias("id"), F.col("doc_id").alias("seq"),
        (700 - F.col("n_chars") % 500).cast("int").alias("score"), (F.col("doc_id") % 97 == 0).alias("anchor"),
        F.array(F.concat_ws(" ", F.lit("lang"), "lang", (F.col("doc_id") % 3).cast("string"))).alias("reasons"), "n_chars",
    )
    merged = candidates.merge_candidates(made)
    return merged.select("id", "score", "anchor", F.array_join("reasons", ",").alias("reasons"), "n_chars", "seq")


@query(f"WITH {_SCORED} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored")
def size_penalty_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    return ranking.global_rank(_scored(spark, sf_dir), order).select("doc_id", "score", "rank")


def _part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part of an order to the next one: a graph with cycles and many parallels."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = lines.alias("a").join(lines.alias("b"), "l_orderkey").where(F.col("a.l_partkey") < F.col("b.l_partkey"))
    kind = F.when(F.col("l_orderkey") % 8 == 0, "imports").otherwise("imports-dynamic")
    return (
        pairs.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"), kind.alias("edge_type"))
        .groupBy("src", "dst").agg(F.min("edge_type").alias("edge_type"))
    )


_PART_EDGES = """
l AS (SELECT l_orderkey, l_partkey FROM lineitem),
e AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst,
    min(CASE WHEN a.l_orderkey % 8 = 0 THEN 'imports' ELSE 'imports-dynamic' END) AS edge_type
  FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"""


#: Where traversals begin: the smallest parts of one brand.
_ANCHORS = "p_brand = 'Brand#4' AND p_size <= 3"


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").where(_ANCHORS).select(F.col("p_partkey").alias("root"))


@query(f"""
WITH RECURSIVE {_PART_EDGES},
b AS (SELECT p_partkey AS root, p_partkey AS node, 0 AS d FROM part WHERE {_ANCHORS}
  UNION SELECT b.root, e.dst, b.d + 1 FROM b JOIN e ON e.src = b.node WHERE b.d < 3),
n AS (SELECT root, node, min(d) AS d FROM b GROUP BY 1, 2),
-- The way in of a node is the least one: parents in the order of their own ways, then the edge's type.
w0 AS (SELECT root, node, [node] AS way, NULL AS edge_type FROM n WHERE d = 0),
w1 AS (SELECT n.root, n.node, min({{'w': w.way, 't': e.edge_type}}) AS f FROM n JOIN w0 w ON w.root = n.root JOIN e ON e.src = w.node AND e.dst = n.node WHERE n.d = 1 GROUP BY 1, 2),
v1 AS (SELECT root, node, list_append(f.w, node) AS way, f.t AS edge_type FROM w1),
w2 AS (SELECT n.root, n.node, min({{'w': w.way, 't': e.edge_type}}) AS f FROM n JOIN v1 w ON w.root = n.root JOIN e ON e.src = w.node AND e.dst = n.node WHERE n.d = 2 GROUP BY 1, 2),
v2 AS (SELECT root, node, list_append(f.w, node) AS way, f.t AS edge_type FROM w2),
w3 AS (SELECT n.root, n.node, min({{'w': w.way, 't': e.edge_type}}) AS f FROM n JOIN v2 w ON w.root = n.root JOIN e ON e.src = w.node AND e.dst = n.node WHERE n.d = 3 GROUP BY 1, 2),
v AS (SELECT root, node, edge_type FROM w0 UNION ALL SELECT root, node, edge_type FROM v1 UNION ALL SELECT root, node, edge_type FROM v2
  UNION ALL SELECT root, node, f.t FROM w3)
SELECT root, node, CAST(n.d AS INTEGER) AS distance, edge_type FROM n JOIN v USING (root, node)""")
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every anchor: what lies within three steps, and the type of the edge that finds it."""
    return traverse.reach(_part_edges(spark, sf_dir), _anchors(spark, sf_dir), 3).select("root", "node", "distance", "edge_type")


@query(f"""
WITH RECURSIVE {_PART_EDGES},
b AS (SELECT p_partkey AS node, 0 AS d FROM part WHERE {_ANCHORS}
  UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.node WHERE b.d < 2),
n AS (SELECT node, min(d) AS d FROM b GROUP BY 1)
SELECT src, dst, edge_type FROM e JOIN n ON n.node = e.src AND n.d < 2 WHERE dst IN (SELECT node FROM n)""")
def bfs_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach_graph(_part_edges(spark, sf_dir), _anchors(spark, sf_dir), 2)[1].select("src", "dst", "edge_type")


@query(f"""
WITH RECURSIVE {_PART_EDGES},
b AS (SELECT p_partkey AS node, 0 AS d FROM part WHERE {_ANCHORS}
  UNION SELECT e.dst, b.d + 1 FROM b JOIN e ON e.src = b.node WHERE b.d < 2)
SELECT node, CAST(min(d) AS INTEGER) AS distance FROM b GROUP BY 1""")
def bfs_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.reach_graph(_part_edges(spark, sf_dir), _anchors(spark, sf_dir), 2)[0].select("node", "distance")


def _part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part")
    path = F.concat(F.lit("py:"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(".py"))
    symbol = F.concat_ws("", path, F.lit("#"), F.replace(F.substring_index("p_type", " ", 1), F.lit("."), F.lit("")), F.lit(".m"), "p_partkey")
    nodes = part.select(
        symbol.alias("id"), F.lit("method").alias("kind"), F.lit("py").alias("lang"), "p_name", path.alias("path"), "p_partkey",
        (F.col("p_partkey") % 50 == 0).alias("anchor"), (F.col("p_size") > 45).alias("external"),
        F.when(F.col("p_size") % 2 == 0, 1.0).otherwise(0.9).alias("confidence"), F.col("p_partkey").alias("seq"),
    )
    nodes = nodes.select(
        "id", "kind", "lang", F.col("p_name").alias("name"), "path", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"),
        F.lit("/").alias("ws_root"), "anchor", "external", "confidence", "seq",
    )
    ids = part.select(F.col("p_partkey").alias("k"), symbol.alias("id"))
    e = _part_edges(spark, sf_dir)
    edges = e.join(ids.select(F.col("k").alias("src"), F.col("id").alias("from_id")), "src").join(
        ids.select(F.col("k").alias("dst"), F.col("id").alias("to_id")), "dst"
    ).select("from_id", "to_id", F.col("edge_type").alias("type"), F.when(F.col("edge_type") == "imports", 1.0).otherwise(0.9).alias("confidence"),
             (F.col("src") * 1_000_000 + F.col("dst")).alias("seq"))
    return nodes, edges


_PART_GRAPH = f"""{_PART_EDGES},
nodes AS (
  SELECT 'py:' || replace(p_brand, '#', '-') || '.py' AS path,
    'py:' || replace(p_brand, '#', '-') || '.py#' || replace(split_part(p_type, ' ', 1), '.', '') || '.m' || p_partkey AS id,
    'py:' || replace(p_brand, '#', '-') || '.py#' || replace(split_part(p_type, ' ', 1), '.', '') AS class_id,
    p_partkey AS seq, p_partkey % 50 = 0 AS anchor, p_size > 45 AS external, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.9 END AS confidence
  FROM part),
edges AS (
  SELECT a.id AS from_id, b.id AS to_id, edge_type AS type, CASE WHEN edge_type = 'imports' THEN 1.0 ELSE 0.9 END AS confidence,
    a.external AS xa, b.external AS xb, a.path AS pa, b.path AS pb, a.class_id AS ca, b.class_id AS cb
  FROM e JOIN nodes a ON a.seq = e.src JOIN nodes b ON b.seq = e.dst)"""


@query(f"""
WITH {_PART_GRAPH}
SELECT DISTINCT CASE WHEN xa THEN '__external__' ELSE from_id END AS from_id, CASE WHEN xb THEN '__external__' ELSE to_id END AS to_id, type
FROM edges WHERE NOT (xa AND xb)""")
def collapse_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.collapse(nodes, edges, "external")[1].select("from_id", "to_id", "type")


@query(f"""
WITH {_PART_GRAPH}
SELECT id, 'method' AS kind, anchor, CAST(confidence AS DOUBLE) AS confidence, false AS external FROM nodes WHERE NOT external
UNION ALL SELECT '__external__', 'external', false, 1.0, true WHERE EXISTS (SELECT 1 FROM edges WHERE xa <> xb)""")
def collapse_external_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node stands for all external ones, if an edge leads there."""
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.collapse(nodes, edges, "external")[0].select("id", "kind", "anchor", "confidence", "external")


@query(f"""
WITH {_PART_GRAPH},
f AS (SELECT CASE WHEN xa THEN from_id ELSE pa END AS from_id, CASE WHEN xb THEN to_id ELSE pb END AS to_id, type FROM edges)
SELECT DISTINCT from_id, to_id, type FROM f WHERE from_id <> to_id""")
def collapse_file_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.collapse(nodes, edges, "file")[1].select("from_id", "to_id", "type")


@query(f"""
WITH {_PART_GRAPH}
SELECT class_id AS id, 'class' AS kind, bool_or(anchor) AS anchor, CAST(max(confidence) AS DOUBLE) AS confidence,
  arg_min(external, seq) AS external, min(seq) AS seq FROM nodes GROUP BY 1""")
def collapse_class_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.collapse(nodes, edges, "class")[0].select("id", "kind", "anchor", "confidence", "external", "seq")


@query(f"""
WITH {_PART_GRAPH},
f AS (SELECT CASE WHEN external THEN id ELSE path END AS id, anchor, confidence, external FROM nodes)
SELECT id, bool_or(anchor) AS anchor, CAST(max(confidence) AS DOUBLE) AS confidence, bool_or(external) AS external FROM f GROUP BY 1""")
def collapse_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.collapse(nodes, edges, "file")[0].select("id", "anchor", "confidence", "external")


@query(f"""
WITH {_PART_GRAPH} SELECT DISTINCT ca AS from_id, cb AS to_id, type FROM edges WHERE ca <> cb""")
def collapse_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.collapse(nodes, edges, "class")[1].select("from_id", "to_id", "type")


@query(f"""
WITH {_PART_GRAPH},
ranked AS (SELECT id, anchor, row_number() OVER (ORDER BY external, confidence DESC, id) AS rn FROM nodes WHERE NOT anchor),
kept AS (SELECT id FROM nodes WHERE anchor UNION ALL SELECT id FROM ranked WHERE rn <= 300 - (SELECT count(*) FROM nodes WHERE anchor)),
inner_edges AS (SELECT * FROM edges WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept))
SELECT from_id, to_id, type FROM inner_edges ORDER BY confidence DESC, type, from_id, to_id LIMIT 200""")
def truncate_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits are the feature: the first nodes and edges by priority."""
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.truncate(nodes, edges, 300, 200)[1].select("from_id", "to_id", "type")


@query(f"""
WITH {_PART_GRAPH},
ranked AS (SELECT id, row_number() OVER (ORDER BY external, confidence DESC, id) AS rn FROM nodes WHERE NOT anchor)
SELECT id FROM nodes WHERE anchor UNION ALL SELECT id FROM ranked WHERE rn <= 300 - (SELECT count(*) FROM nodes WHERE anchor)""")
def truncate_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    return graphs.truncate(nodes, edges, 300, 200)[0].select("id")


@query(f"""
WITH {_PART_GRAPH},
ranked AS (SELECT id, row_number() OVER (ORDER BY external, confidence DESC, id) AS rn FROM nodes WHERE NOT anchor),
kept AS (SELECT id FROM nodes WHERE anchor UNION ALL SELECT id FROM ranked WHERE rn <= 300 - (SELECT count(*) FROM nodes WHERE anchor)),
c AS (SELECT (SELECT count(*) FROM nodes) - (SELECT count(*) FROM kept) AS n,
  greatest(0, (SELECT count(*) FROM edges WHERE from_id IN (SELECT id FROM kept) AND to_id IN (SELECT id FROM kept)) - 200) AS m)
SELECT n > 0 OR m > 0 AS truncated, CAST(n AS BIGINT) AS truncated_nodes, CAST(m AS BIGINT) AS truncated_edges FROM c""")
def truncate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _part_graph(spark, sf_dir)
    cut = graphs.truncate(nodes, edges, 300, 200)[2]
    return spark.createDataFrame([cut], "truncated boolean, truncated_nodes long, truncated_edges long")


@query("""
SELECT l_partkey AS from_id, l_suppkey AS to_id, l_returnflag AS type, arg_min(l_orderkey * 10 + l_linenumber, k) AS site
FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
GROUP BY 1, 2, 3""")
def edge_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("l_returnflag").alias("type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("seq"),
    )
    return graphs.merge_edges(lines).select("from_id", "to_id", "type", "site")


@query("""
SELECT user_id AS src, event_type AS dst, CASE WHEN user_id % 2 = 0 THEN min(t) ELSE max(t) END AS edge_type
FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'imports-dynamic' ELSE 'imports' END AS t FROM events) GROUP BY 1, 2""")
def edge_type_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _t(spark, sf_dir, "events").select(
        F.lit("/").alias("ws_root"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"),
        F.when(F.col("event_id") % 5 == 0, "imports-dynamic").otherwise("imports").alias("edge_type"),
        F.when(F.col("user_id") % 2 == 0, "py").otherwise("ts").alias("l"),
    )
    return graphs.merge_edge_types(edges, F.col("l")).select("src", "dst", "edge_type")


@query("""
WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages),
r AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS root FROM p
      UNION SELECT DISTINCT split_part(path, '/', 1) FROM p)
SELECT path, arg_max(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def prefix_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    roots = p.select(F.regexp_replace("path", "/[^/]*$", "").alias("root")).union(p.select(F.substring_index("path", "/", 1)))
    return matching.deepest_owner(p, "path", roots, "root")


@query("""
WITH m AS (SELECT DISTINCT r_name || '.' || n_name AS module, n_nationkey AS v FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT r_name, 100 + r_regionkey FROM region),
q AS (SELECT r_name || '.' || n_name || '.C' || c_custkey AS name FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name || '.UNKNOWN.X' FROM region)
SELECT name, arg_max(module, length(module)) AS module, CAST(arg_max(v, length(module)) AS INTEGER) AS value
FROM q JOIN m ON name = module OR starts_with(name, module || '.') GROUP BY 1""")
def longest_prefix_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    full = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    known = full.select(F.concat_ws(".", "r_name", "n_name").alias("module"), F.col("n_nationkey").alias("value")).union(
        region.select("r_name", F.col("r_regionkey") + 100)
    )
    customer = _t(spark, sf_dir, "customer")
    names = customer.join(full, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws("", "r_name", F.lit("."), "n_name", F.lit(".C"), "c_custkey").alias("name")
    )
    names = names.union(region.select(F.concat("r_name", F.lit(".UNKNOWN.X"))))
    return matching.longest_prefix(names, "name", known, "module", "value").select("name", "module", F.col("value").cast("int").alias("value"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def unresolved_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return matching.unmatched(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def resolved_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _t(spark, sf_dir, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return matching.matched(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@query("""
WITH r AS (SELECT c_nationkey AS query, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
SELECT query, CAST(count(*) AS BIGINT) AS matches, string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) FILTER (rn <= 20) AS found
FROM r GROUP BY 1 HAVING count(*) > 1""")
def ambiguous_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places a name has, and the first twenty: what a message shows, however many there are."""
    asked = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), "c_custkey")
    found = F.array_join(F.transform("at", lambda x: x.cast("string")), ",")
    return matching.ambiguous(asked, "query", "c_custkey").select("query", "matches", found.alias("found"))


@query("""
SELECT part, site, score, rank FROM (
  SELECT l_partkey AS part, site, score, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, site, q, p) AS INTEGER) AS rank
  FROM (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS site, l_quantity AS q, l_extendedprice AS p,
    CAST(CASE WHEN l_returnflag = 'R' THEN 60 ELSE 0 END + CASE WHEN l_linestatus = 'O' THEN 30 ELSE 0 END AS INTEGER) AS score FROM lineitem))
WHERE rank <= 10""")
def reference_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten references per definition: 60 points in its file, 30 in an anchor file."""
    score = F.when(F.col("l_returnflag") == "R", 60).otherwise(0) + F.when(F.col("l_linestatus") == "O", 30).otherwise(0)
    refs = _t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("site"),
        score.cast("int").alias("score"), "l_quantity", "l_extendedprice",
    )
    order = [F.col("score").desc(), F.col("site"), F.col("l_quantity"), F.col("l_extendedprice")]
    return ranking.top_per_group(refs, ["part"], order, 10).select("part", "site", "score", "rank")


_SNAPSHOTS = """
b AS (SELECT o_orderkey, o_totalprice AS size, o_orderstatus AS mtime FROM orders WHERE o_orderkey % 7 <> 0),
a AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size, o_orderstatus AS mtime FROM orders WHERE o_orderkey % 11 <> 0),
c AS (
  SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed'
    WHEN a.size IS NOT DISTINCT FROM b.size AND a.mtime IS NOT DISTINCT FROM b.mtime THEN 'unchanged' ELSE 'changed' END AS status
  FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("size"), F.col("o_orderstatus").alias("mtime"))
    after = o.where("o_orderkey % 11 <> 0").withColumn("size", F.col("size") + F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(0))
    return o.where("o_orderkey % 7 <> 0"), after


@query(f"WITH {_SNAPSHOTS} SELECT o_orderkey, status FROM c")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed between two listings; each is a part of the table by the query's meaning."""
    return matching.changes(*_snapshots(spark, sf_dir), "o_orderkey", ["size", "mtime"])


@query(f"WITH {_SNAPSHOTS} SELECT count(*) FILTER (status <> 'unchanged') = 0 AS valid, CAST(count(*) FILTER (status <> 'unchanged') AS BIGINT) AS stale FROM c")
def cache_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.is_current(*_snapshots(spark, sf_dir), "o_orderkey", ["size", "mtime"])


@query("""
SELECT name, count(*) AS files, min(doc_id) AS first_file FROM (
  SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM documents) GROUP BY 1""")
def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier to files; each file's identifiers are made distinct before they move."""
    names = F.regexp_extract_all("text", F.lit("([A-Za-z_][A-Za-z0-9_]*)"))
    return matching.inverted_index(_t(spark, sf_dir, "documents"), "doc_id", names).withColumnRenamed("first", "first_file")


_LOG_LINE = """CASE event_id % 8
  WHEN 0 THEN '  at Object.<anonymous> (src/u' || user_id || '/h.test.ts:' || (event_id % 90 + 1) || ':10)'
  WHEN 1 THEN 'FAIL src/c' || user_id || '/Button.test.tsx'
  WHEN 2 THEN 'src/m' || user_id || '.py:' || (event_id % 90 + 1) || ': error: bad'
  WHEN 3 THEN 'src/p' || user_id || '.py:' || (event_id % 90 + 1) || ':12 - error: bad'
  WHEN 4 THEN 'File "tests/test_' || user_id || '.py", line ' || (event_id % 90 + 1)
  WHEN 5 THEN 'src/a' || user_id || '.ts:' || (event_id % 90 + 1) || ':5 - error TS2345'
  WHEN 6 THEN 'see src/g' || user_id || '.py:' || (event_id % 90 + 1)
  ELSE 'nothing here ' || event_type END"""


def _sql_cascade(which: int) -> str:
    cases = "\n".join(
        f"WHEN regexp_matches(line, '{p}') THEN regexp_extract(line, '{p}', {g[which]})" for p, *g in parsing.LOG_PATTERNS
    )
    return f"CASE {cases} END"


@query(f"""
WITH l AS (SELECT event_id AS line_no, {_LOG_LINE} AS line FROM events),
p AS (SELECT line_no, {_sql_cascade(0)} AS path, {_sql_cascade(1)} AS n FROM l),
q AS (SELECT path, CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END AS line, line_no FROM p WHERE path IS NOT NULL)
SELECT path, line, greatest(1, line - 3) AS start_line, line + 3 AS end_line, min(line_no) AS line_no FROM q GROUP BY path, line""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(_LOG_LINE).alias("line"))
    return parsing.parse_log(lines)


_DIFF_LINE = """CASE WHEN turn % 3 = 0 THEN CASE WHEN conv_id % 10 = 9 THEN '+++ /dev/null' WHEN conv_id % 10 = 8 THEN '+++ src/g' || conv_id || '.py' ELSE '+++ b/src/f' || conv_id || '_' || turn || '.ts' END
  WHEN turn % 3 = 1 THEN '@@ -1,2 +' || (length(text) % 50 + 1) || ',' || (turn + conv_id % 2) || ' @@' ELSE '@@ -3 +' || (turn + 1) || ' @@ x' END"""


@query(f"""
WITH l AS (SELECT conv_id, turn AS line_no, {_DIFF_LINE} AS line FROM conversations),
c AS (SELECT *, last_value(CASE WHEN line = '+++ /dev/null' THEN '' WHEN starts_with(line, '+++ b/') THEN substr(line, 7) WHEN starts_with(line, '+++ ') THEN substr(line, 5) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS path FROM l),
h AS (SELECT conv_id, path, line_no, CAST(regexp_extract(line, '\\+([0-9]+)', 1) AS INTEGER) AS s, regexp_extract(line, '\\+[0-9]+,([0-9]+)', 1) AS n
  FROM c WHERE line LIKE '@@%' AND path <> '')
SELECT conv_id, path, s AS start_line, greatest(s, s + CASE WHEN n = '' THEN 1 ELSE CAST(n AS INTEGER) END - 1) AS end_line, line_no FROM h""")
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("line_no"), F.expr(_DIFF_LINE).alias("line"))
    return parsing.parse_diff(lines, ["conv_id"])


@query("""
SELECT doc_id, CASE WHEN len(ls) < 2 THEN '' ELSE array_to_string(list_slice(ls, 2, 4), chr(10)) END AS snippet
FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS ls FROM documents)""")
def snippet_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), F.lit(2), F.lit(4)).alias("snippet"))


@query("""SELECT page_id, count(*) AS links, min(u) AS first_link FROM (
  SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u FROM pages) GROUP BY 1""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    pages = _t(spark, sf_dir, "pages").select("page_id", found.alias("u"))
    return pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.min("u").alias("first_link"))


@query(r"""
SELECT doc_id, replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '[REDACTED]', 'g'), '[0-9]{3,}', '[REDACTED]', 'g'), '(the', '[REDACTED]') AS text
FROM documents""")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two expressions and one that isn't valid, taken literally."""
    patterns = [r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", r"[0-9]{3,}", "(the"]
    return _t(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text"), patterns).alias("text"))


_BINARY = ", ".join(f"'{x}'" for x in paths.BINARY_EXTENSIONS)
_MIME = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in paths.MIME_TYPES.items())


@query(f"""
WITH p AS (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '/a.PNG' WHEN 1 THEN '/b.py' WHEN 2 THEN '/c.tar.gz' WHEN 3 THEN '/d.tsx' WHEN 4 THEN '/e' ELSE '/f.docx' END AS path FROM pages),
x AS (SELECT page_id, lower(regexp_extract(path, '([^./]*)$', 1)) AS ext, path FROM p)
SELECT page_id, ext IN ({_BINARY}) AS is_binary, CASE ext {_MIME} ELSE 'application/octet-stream' END AS mime,
  CASE WHEN ext IN ('tsx', 'ts', 'jsx', 'js', 'py') THEN ext ELSE 'text' END AS fence, CASE WHEN ext = 'py' THEN 'py' ELSE 'ts' END AS lang FROM x""")
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.array(*(F.lit(t) for t in ("/a.PNG", "/b.py", "/c.tar.gz", "/d.tsx", "/e", "/f.docx")))
    path = F.concat("url", F.get(tails, (F.col("page_id") % 6).cast("int")))
    return _t(spark, sf_dir, "pages").select(
        "page_id", paths.is_binary(path).alias("is_binary"), paths.mime_type(path).alias("mime"), paths.fence(path).alias("fence"),
        paths.language(path).alias("lang"),
    )


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = text.utf16_length(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", length.alias("chars"), text.token_estimate(length).alias("tokens"))


@query("""
SELECT root, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind, arg_min(name, CASE kind WHEN 'node' THEN 0 ELSE 1 END) AS name
FROM (SELECT s_nationkey AS root, 'node' AS kind, min(s_name) AS name FROM supplier GROUP BY 1
  UNION ALL SELECT CASE WHEN c_acctbal < 0 THEN 100 + c_nationkey WHEN c_acctbal > 9000 THEN c_nationkey ELSE 200 + c_nationkey END, 'python', min(c_name)
    FROM customer GROUP BY 1) GROUP BY root""")
def workspace_kind_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that two detectors find: suppliers stand for one of them, customers for the other."""
    node = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("root")).agg(F.min("s_name").alias("name")).withColumn("kind", F.lit("node"))
    n, balance = F.col("c_nationkey"), F.col("c_acctbal")
    root = F.when(balance < 0, n + 100).when(balance > 9000, n).otherwise(n + 200).cast("int")
    python = _t(spark, sf_dir, "customer").groupBy(root.alias("root")).agg(F.min("c_name").alias("name")).withColumn("kind", F.lit("python"))
    return matching.merge_kinds(node.unionByName(python)).select("root", "kind", "name")


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.short_hash(F.col("text")).alias("sha1"), text.content_hash(F.col("text")).alias("sha256"))


@query("""
SELECT event_type AS category, count(*) AS n, round(avg(value), 6) AS avg_value, round(median(value), 6) AS median_value, round(min(value), 6) AS min_value,
  round(max(value), 6) AS max_value, round(stddev_pop(value), 6) AS stddev_value FROM events GROUP BY 1""")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _t(spark, sf_dir, "events").select(F.col("event_type").alias("category"), "value")
    return benchstats.timing_stats(runs, ["category"], "value")


@query("""
SELECT p_type AS category, count(*) AS results, round(sum(p_retailprice), 6) AS total, arg_max(p_partkey, p_retailprice * 100000000 + p_partkey) AS slowest
FROM part GROUP BY 1""")
def bench_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by category, each with its slowest; parts stand for results."""
    return benchstats.by_category(_t(spark, sf_dir, "part").withColumnRenamed("p_type", "category"), "category", "p_partkey", "p_retailprice")


@query("""
WITH r AS (SELECT l_returnflag AS category, l_linestatus AS name, sum(l_quantity) AS now FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
b AS (SELECT l_returnflag AS category, l_linestatus AS name, sum(l_quantity) AS base FROM lineitem WHERE l_orderkey % 2 = 1 GROUP BY 1, 2)
SELECT category, name, round((now - base) / base * 100, 6) AS delta_pct, (now - base) / base * 100 > 1 AS regression FROM r JOIN b USING (category, name)""")
def bench_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against a baseline by name and category; even and odd orders stand for the two."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("name"), "l_quantity", "l_orderkey")
    total = lambda odd: lines.where(F.col("l_orderkey") % 2 == odd).groupBy("category", "name").agg(F.sum("l_quantity").alias("v"))
    return benchstats.regressions(total(0), total(1), ["category", "name"], "v", 1)


@query("""
WITH d AS (SELECT 'src/' || source || '/' || CASE WHEN doc_id % 4 = 0 THEN '__init__' ELSE 'm' || doc_id END || '.py' AS rel FROM documents)
SELECT DISTINCT rel, replace(regexp_replace(regexp_replace(substr(rel, 5), '\\.py$', ''), '(^|/)__init__$', ''), '/', '.') AS module FROM d""")
def python_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 4 == 0, "__init__").otherwise(F.concat(F.lit("m"), F.col("doc_id").cast("string")))
    rel = _t(spark, sf_dir, "documents").select(F.concat_ws("", F.lit("src/"), "source", F.lit("/"), name, F.lit(".py")).alias("rel")).distinct()
    return rel.select("rel", paths.python_module(F.col("rel"), ["src", "."]).alias("module"))


@query("""
WITH n AS (SELECT conv_id, turn, 'u' || conv_id || '_' || turn AS stem, CASE turn % 3 WHEN 1 THEN 'x/u' || conv_id || '_' || (turn - 1) || '.test.ts'
  WHEN 2 THEN 't/test_u' || conv_id || '_' || (turn - 2) || '.py' END AS test FROM conversations)
SELECT a.stem AS anchor, b.test FROM n a JOIN n b ON b.test IS NOT NULL
  AND a.stem = CASE WHEN b.turn % 3 = 1 THEN 'u' || b.conv_id || '_' || (b.turn - 1) ELSE 'u' || b.conv_id || '_' || (b.turn - 2) END""")
def related_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors with the tests named after them: the pattern becomes an equality on stems."""
    from codequarry.operators.expand import test_stem

    n = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("", F.lit("u"), "conv_id", F.lit("_"), "turn").alias("stem"))
    test = F.when(F.col("turn") % 3 == 1, F.concat_ws("", F.lit("x/u"), "conv_id", F.lit("_"), F.col("turn") - 1, F.lit(".test.ts"))).when(
        F.col("turn") % 3 == 2, F.concat_ws("", F.lit("t/test_u"), "conv_id", F.lit("_"), F.col("turn") - 2, F.lit(".py"))
    )
    tests = n.select(test.alias("test")).where("test IS NOT NULL").withColumn("stem", test_stem(F.col("test")))
    return n.select("stem").join(tests, "stem").select(F.col("stem").alias("anchor"), "test")
