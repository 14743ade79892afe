import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.functions import parsing, paths, text
from codequarry.functions import tables as table_functions
from codequarry.operators import budget, candidates, graphs, matching, ranking, traverse
from codequarry.schema import CANDIDATES
from codequarry.sources import edge_json
from codequarry.sources.ignore import IgnoreMatcher


def greedy(lengths, cap):
    used, kept = 0, []
    for i, n in enumerate(lengths):
        if used + n <= cap:
            used += n
            kept.append(i)
    return kept


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([30, 80, 50, 30, 10])], "i long, n long")
    got = budget.select_within_budget(df, [("i", False)], ["n"], [100], "i").orderBy("pick").collect()
    assert [r["n"] for r in got] == [30, 50, 10] and got[0]["used_n"] == 90


def test_budget_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(budget, "ROUND", 3)
    lengths = [7, 90, 3, 41, 60, 2, 2, 1, 50, 1, 0, 5, 9, 1]
    df = spark.createDataFrame(list(enumerate(lengths)), "i long, n long")
    got = budget.select_within_budget(df, [("i", False)], ["n"], [60], "i").orderBy("pick").collect()
    assert [r["i"] for r in got] == greedy(lengths, 60)


def test_budget_nothing_fits(spark):
    df = spark.createDataFrame([(1, 10), (2, 10)], "i long, n long")
    assert budget.select_within_budget(df, [("i", False)], ["n"], [5], "i").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=30), st.integers(0, 100))
def test_budget_per_group(spark, lengths, cap):
    df = spark.createDataFrame([(1, i, n) for i, n in enumerate(lengths)], "g int, i long, n long").withColumn("o", F.col("i"))
    got = budget.select_per_group(df, ["g"], "o", ["n"], [cap], "i").collect()
    assert sorted(r["i"] for r in got) == greedy(lengths, cap)


def test_global_rank(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 101).alias("a"), "id")
    got = ranking.global_rank(df, [F.col("a").desc(), F.col("id")]).collect()
    want = sorted(((r["a"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 501))
    assert ranking.global_rank(df.limit(0), [F.col("id")]).count() == 0


def test_candidates_merge_and_header(spark):
    base = dict(kind="file", lang="ts", ws_id="w", ws_root="", path="a.ts", start_line=None, end_line=None, estimated_chars=30_000)
    data = [
        base | dict(id="a.ts:file", score=250, reasons=["import-distance 1"], anchor=False, seq=2),
        base | dict(id="a.ts:file", score=800, reasons=["entry file"], anchor=True, seq=1),
    ]
    merged = candidates.merge_candidates(spark.createDataFrame(data, CANDIDATES))
    (r,) = merged.collect()
    assert (r["score"], r["anchor"], r["reasons"]) == (800, True, ["entry file", "import-distance 1"])
    (h,) = candidates.header_snippets(merged, 28_000).collect()
    assert (h["id"], h["score"], h["kind"], h["anchor"]) == ("a.ts:1-80", 800 - 200 - 60, "snippet", False)


def test_reach(spark):
    edges = spark.createDataFrame([("a", "b", "imports"), ("b", "c", "imports-dynamic"), ("c", "a", "imports"), ("c", "d", "imports")],
                                  "src string, dst string, edge_type string")
    roots = spark.createDataFrame([("a",)], "root string")
    got = {r["node"]: (r["distance"], r["edge_type"]) for r in traverse.reach(edges, roots, 2).collect()}
    assert got == {"a": (0, None), "b": (1, "imports"), "c": (2, "imports-dynamic")}
    nodes, inner = traverse.reach_graph(edges, roots, 3)
    assert {(r["src"], r["dst"]) for r in inner.collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")}


NODES = "id string, kind string, lang string, name string, path string, start_line int, end_line int, ws_root string, anchor boolean, external boolean, confidence double, seq long"
EDGES = "from_id string, to_id string, type string, site_path string, site_start int, site_end int, confidence double, seq long"


def tables(spark, nodes, edges):
    n = [(i, k, "ts", i, i.split("#")[0], 1, 2, "", a, x, 1.0, s) for s, (i, k, a, x) in enumerate(nodes)]
    e = [(a, b, "imports", None, None, None, 1.0, s) for s, (a, b) in enumerate(edges)]
    return spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES)


def test_collapse_external(spark):
    n, e = tables(spark, [("i", "file", True, False), ("x1", "file", False, True), ("x2", "file", False, True)], [("i", "x1"), ("i", "x2"), ("x1", "x2")])
    n, e = graphs.collapse(n, e, "external")
    assert sorted(r["id"] for r in n.collect()) == ["__external__", "i"]
    assert [(r["from_id"], r["to_id"]) for r in e.collect()] == [("i", "__external__")]
    n, e = tables(spark, [("a", "file", True, False), ("b", "file", False, False)], [("a", "b")])
    assert sorted(r["id"] for r in graphs.collapse(n, e, "external")[0].collect()) == ["a", "b"]


def test_collapse_file_and_class(spark):
    made = [("f#K.m", "method", True, False), ("f#K.n", "method", False, False), ("f#g", "function", False, False), ("h#z", "function", False, False)]
    n, e = tables(spark, made, [("f#K.m", "f#K.n"), ("f#K.n", "h#z"), ("f#g", "h#z")])
    fn, fe = graphs.collapse(n, e, "file")
    assert {(r["id"], r["anchor"]) for r in fn.collect()} == {("f", True), ("h", False)}
    assert [(r["from_id"], r["to_id"]) for r in fe.collect()] == [("f", "h")]
    cn, ce = graphs.collapse(n, e, "class")
    assert {(r["id"], r["kind"]) for r in cn.collect()} == {("f#K", "class"), ("f#g", "function"), ("h#z", "function")}
    assert {(r["from_id"], r["to_id"]) for r in ce.collect()} == {("f#K", "h#z"), ("f#g", "h#z")}
    with pytest.raises(ValueError):
        graphs.collapse(n, e, "other")


def test_truncate(spark):
    names = [("a1", True), ("a2", True), ("o1", False), ("o2", False), ("o3", False)]
    n, e = tables(spark, [(i, "file", a, False) for i, a in names], [("a1", "a2"), ("a1", "o1"), ("a1", "o3")])
    kept, edges, cut = graphs.truncate(n, e, 3, 10)
    assert {r["id"] for r in kept.collect()} == {"a1", "a2", "o1"} and cut["truncated_nodes"] == 2
    assert {(r["from_id"], r["to_id"]) for r in edges.collect()} == {("a1", "a2"), ("a1", "o1")}
    _, edges, cut = graphs.truncate(n, e, 10, 2)
    assert edges.count() == 2 and cut == {"truncated": True, "truncated_nodes": 0, "truncated_edges": 1}
    assert not graphs.truncate(n, e, 10, 10)[2]["truncated"]


def test_edge_merge_keeps_the_first(spark):
    e = spark.createDataFrame([("a", "b", "calls", "p2", 9, 9, 0.5, 2), ("a", "b", "calls", "p1", 1, 1, 0.9, 1)], EDGES)
    (r,) = graphs.merge_edges(e).collect()
    assert (r["site_path"], r["site_start"]) == ("p1", 1)


LOG = [
    ("src/app.ts:10:5 - error TS2345: nope", "src/app.ts", 7, 13), ('File "tests/test_app.py", line 42', "tests/test_app.py", 39, 45),
    ("  at Object.<anonymous> (src/utils/helper.test.ts:25:10)", "src/utils/helper.test.ts", 22, 28),
    ("FAIL src/components/Button.test.tsx", "src/components/Button.test.tsx", 1, 4), (" ❯ src/lib/utils.test.ts:15:3", "src/lib/utils.test.ts", 12, 18),
    ("src/models/user.py:45: error: x", "src/models/user.py", 42, 48), ("src/api/handler.py:30:12 - error: x", "src/api/handler.py", 27, 33),
    ("nothing to see", None, None, None), ("src/models/user.py:45:7", "src/models/user.py", 42, 48),
]


def test_log_lines(spark):
    lines = spark.createDataFrame([(i, x[0]) for i, x in enumerate(LOG)], "line_no long, line string")
    got = {(r["path"], r["start_line"], r["end_line"]) for r in parsing.parse_log(lines).collect()}
    assert got == {x[1:] for x in LOG if x[1]}


def test_diff(spark):
    text_ = "--- a/x\n+++ b/src/app.ts\n@@ -1,2 +1,3 @@\n+x\n@@ -9 +20 @@ f\n+++ /dev/null\n@@ -1,3 +0,0 @@\n+++ b/z.py\n@@ -1 +5,0 @@"
    lines = spark.createDataFrame(list(enumerate(text_.split("\n"))), "line_no long, line string")
    got = [(r["path"], r["start_line"], r["end_line"]) for r in parsing.parse_diff(lines).orderBy("line_no").collect()]
    assert got == [("src/app.ts", 1, 3), ("src/app.ts", 20, 20), ("z.py", 5, 5)]


def test_text_functions(spark):
    df = spark.createDataFrame([("a😀\r\nb\nc",)], "t string")
    r = df.select(
        text.utf16_length(F.col("t")).alias("n"), text.snippet(F.col("t"), F.lit(2), F.lit(9)).alias("s"), text.snippet(F.col("t"), F.lit(7), F.lit(9)).alias("e"),
        text.snippet(F.col("t"), F.lit(0), F.lit(1)).alias("f"), text.redacted(F.col("t"), ["b|c", "(a"]).alias("r"), text.token_estimate(F.lit(5)).alias("k"),
    ).first()
    assert (r["n"], r["s"], r["e"], r["f"], r["r"], r["k"]) == (8, "b\nc", "", "a😀", "a😀\r\n[REDACTED]\n[REDACTED]", 2)


def test_paths(spark):
    df = spark.createDataFrame([("src/a/__init__.py",), ("src/b.py",), ("x/c.py",), ("src/__init__.py",)], "p string")
    got = [r[0] for r in df.select(paths.python_module(F.col("p"), ["src", "."])).collect()]
    assert got == ["a", "b", "x.c", "src"]


def test_owner_and_prefix(spark):
    p = spark.createDataFrame([("a/b/c.ts",), ("a/x.ts",), ("z.ts",), ("ab/q.ts",)], "path string")
    roots = spark.createDataFrame([("a",), ("a/b",)], "root string")
    assert {r["path"]: r["root"] for r in matching.deepest_owner(p, "path", roots, "root").collect()} == {"a/b/c.ts": "a/b", "a/x.ts": "a"}
    names = spark.createDataFrame([("a.b.c",), ("a.z",), ("q",)], "name string")
    known = spark.createDataFrame([("a", 1), ("a.b", 2)], "k string, v int")
    assert {r["name"]: r["v"] for r in matching.longest_prefix(names, "name", known, "k", "v").collect()} == {"a.b.c": 2, "a.z": 1}


@pytest.mark.parametrize(
    ("rules", "path", "ignored"),
    [
        (["dist/"], "a/dist/x.js", True), (["/dist"], "a/dist", False), (["*.snap"], "a/b.snap", True), (["**/build/**"], "p/build/q.ts", True),
        (["*.log", "!keep.log"], "keep.log", False), (["a/*.ts"], "a/b/c.ts", False), (["a/**/c.ts"], "a/b/c.ts", True), (["# x", ""], "x", False),
        (["node_modules/"], "node_modules/a.js", True), (["x/", "!x/y"], "x/y", True), (["[ab].py"], "a.py", True), (["*"], "../up", False),
    ],
)
def test_ignore(rules, path, ignored):
    assert IgnoreMatcher(rules).ignores(path) is ignored


def test_budget_and_rows_of_no_cost(spark):
    """Rows that cost nothing are all kept, wherever they rank, and never gathered."""
    rows = [(k, 100 - k, 0 if k % 3 == 0 else 10) for k in range(30)] + [(99, 1, None), (98, 500, 1000)]
    df = spark.createDataFrame(rows, "id int, score int, cost int")
    got = budget.select_within_budget(df, [("score", True), ("id", False)], ["cost"], [45], "id").orderBy("pick").collect()
    free = [k for k in range(30) if k % 3 == 0]
    assert sorted(r["id"] for r in got) == sorted([*free, 1, 2, 4, 5]) and {r["used_cost"] for r in got} == {40}
    assert [r["pick"] for r in got] == list(range(1, len(got) + 1)) and [r["id"] for r in got] == sorted(r["id"] for r in got)


def test_reasons_of_very_common_ids(spark):
    rows = [("a", k, 5, False, ["x", f"r{k % 3}"]) for k in range(300)] + [("a", -1, 1, True, []), ("b", 7, 2, False, [])]
    df = spark.createDataFrame(rows, "id string, seq int, score int, anchor boolean, reasons array<string>").withColumn("rest", F.col("seq"))
    got = {r["id"]: r for r in candidates.merge_candidates(df).collect()}
    assert list(got["a"]["reasons"]) == ["x", "r0", "r1", "r2"] and list(got["b"]["reasons"]) == []
    assert (got["a"]["score"], got["a"]["anchor"], got["a"]["seq"], got["a"]["rest"]) == (5, True, -1, -1)


def test_ambiguous_names(spark):
    found = spark.createDataFrame([("n", f"p{k:03}") for k in range(50)] * 2 + [("one", "p")], "query string, place string")
    (r,) = matching.ambiguous(found, "query", "place", shown=3).collect()
    assert (r["query"], r["matches"], list(r["at"])) == ("n", 50, ["p000", "p001", "p002"])


def test_diff_without_prefix(spark):
    lines = ["+++ b/src/a.ts", "@@ -1 +4 @@", "+++ src/b.py", "@@ -1,2 +7,3 @@ def x", "+++ /dev/null", "@@ -1,2 +0,0 @@", "+++ src/c d.ts\r", "@@ -3,0 +9,0 @@"]
    got = parsing.parse_diff(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).orderBy("line_no").collect()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [("src/a.ts", 4, 4), ("src/b.py", 7, 9), ("src/c d.ts", 9, 9)]


def test_table_functions(spark):
    table_functions.register(spark)
    log = "src/app.ts:10:5 - error\nnothing\nsrc/app.ts:10:9 - error\nsrc/m.py:1: error: x"
    got = spark.createDataFrame([(log,)], "t string").createOrReplaceTempView("said")
    got = spark.sql("SELECT p.* FROM said, LATERAL parse_log(t) p ORDER BY line_no").collect()
    assert [tuple(r) for r in got] == [("src/app.ts", 10, 7, 13, 1), ("src/m.py", 1, 1, 4, 4)]
    got = spark.sql("SELECT * FROM parse_diff('+++ b/x.py\n@@ -1 +2,3 @@\n+++ /dev/null\n@@ -1 +1 @@')").collect()
    assert [tuple(r) for r in got] == [("x.py", 2, 4, 2)]
    assert spark.sql("SELECT * FROM parse_log('')").collect() == []


def test_patterns_are_tested_by_the_engine_that_runs_them(spark):
    """Valid in Python alone: literal. Valid in Java alone: an expression."""
    df = spark.createDataFrame([("a(?P<x>b) ab xx",)], "t string")
    assert df.select(text.redacted(F.col("t"), ["(?P<x>b)"]).alias("t")).first()["t"] == "a[REDACTED] ab xx"
    assert df.select(text.redacted(F.col("t"), [r"\p{Lower}{2} "]).alias("t")).first()["t"] == "a(?P<x>b) [REDACTED]xx"


def test_edges_as_json(spark):
    df = spark.createDataFrame([('{"a":["b","c"],"d":{"e":"imports-dynamic","a":"imports"},"f":[]}',), ("no json",), (None,)], "t string")
    got = {tuple(r) for r in edge_json.read_edges(df, F.col("t")).collect()}
    assert got == {("a", "b", "imports"), ("a", "c", "imports"), ("d", "e", "imports-dynamic"), ("d", "a", "imports")}
