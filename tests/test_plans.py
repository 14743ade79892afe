import json

import pytest

from codequarry import cli
from codequarry.extract import python_ast, ts_tokens
from codequarry.plans.request import Request
from codequarry.sources.config import AmbiguousSymbol, AnchorNotFound, UsageError, load_config

FILES = {
    ".git/HEAD": "", "package.json": '{"name":"monorepo","workspaces":["packages/*","services/*"]}', "packages/web/package.json": '{"name":"web-app"}',
    "packages/web/src/index.ts": 'import { helper } from "./util.js";\nexport function hello(name: string) {\n  return helper(name);\n}\n',
    "packages/web/src/util.ts": 'export const helper = (x: string) => {\n  return x.trim();\n};\nexport class Box { get(a: number) { return helper(a); } }\nconst l = import("./lazy");\n',
    "packages/web/src/lazy.ts": "export const lazy = 1;\n", "packages/web/src/util.test.ts": 'import { helper } from "./util";\nhelper("x");\n',
    "packages/web/dist/out.ts": "export const helper = 2;\n", "services/billing/pyproject.toml": "[project]\n",
    "services/billing/src/__init__.py": "from .invoice import Invoice\n",
    "services/billing/src/invoice.py": "class Invoice:\n    def total(self):\n        return self.tax()\n\n    def tax(self):\n        return compute(1)\n\n\ndef compute(x):\n    return x\n",
    "services/billing/src/loader.py": 'import importlib\nm = importlib.import_module("src.invoice")\nfrom invoice import compute\ncompute(2)\n',
    "docs/readme.md": "hello SECRET_KEY=1", "docs/logo.png": "x", "docs/.hidden": "h",
}


@pytest.fixture(scope="module")
def mono(tmp_path_factory):
    root = tmp_path_factory.mktemp("mono")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    (root / "docs/empty").mkdir()
    return str(root)


def pack(spark, mono, *argv):
    return json.loads(cli.run(["pack", "--no-timestamp", "--all-workspaces", *argv], mono, spark)[0])


def graph(spark, mono, *argv):
    return json.loads(cli.run(["graph", "--no-timestamp", "--all-workspaces", *argv], mono, spark)[0])


def test_workspaces(mono):
    found = json.loads(cli.run(["workspaces"], mono)[0])
    assert [(w["id"], w["name"], w["kind"]) for w in found] == [(".", "monorepo", "node"), ("packages/web", "web-app", "node"), ("services/billing", "billing", "python")]
    assert cli.run(["workspaces", "--format", "text"], mono)[0].startswith(".\tmonorepo\tnode")


def test_entry_depth_and_budget(spark, mono):
    entry = ["--entry", "packages/web/src/index.ts", "--reason"]
    shallow = pack(spark, mono, *entry, "--depth", "0")
    assert [i["filePath"] for i in shallow["items"]] == ["packages/web/src/index.ts"]
    assert shallow["items"][0]["reasons"] == ["entry file", "barrel file"]
    deep = pack(spark, mono, *entry, "--depth", "2", "--include-tests", "true")
    got = {i["filePath"]: i["reasons"] for i in deep["items"]}
    assert got["packages/web/src/util.ts"] == ["import-distance 1"] and got["packages/web/src/lazy.ts"] == ["dynamic-import-distance 2"]
    assert "packages/web/dist/out.ts" not in got
    small = pack(spark, mono, *entry, "--budget-chars", "110")
    assert small["meta"]["budget"]["usedChars"] <= 110 and small["omitted"]
    missing = pack(spark, mono, "--entry", "nowhere.ts", "--reason")
    assert missing["items"] == [] and missing["omitted"][0]["reason"] == "entry file; failed to read file"


def test_symbols(spark, mono):
    got = pack(spark, mono, "--symbol", "Invoice.total", "--reason")
    first = got["items"][0]
    assert (first["filePath"], first["range"]) == ("services/billing/src/invoice.py", {"startLine": 2, "endLine": 3})
    assert any(r == "references Invoice.total" for i in got["items"] for r in i["reasons"])
    with pytest.raises(AnchorNotFound):
        pack(spark, mono, "--symbol", "Nowhere")
    with pytest.raises(AnchorNotFound):
        cli.run(["pack", "--symbol", "helper", "--workspace", "billing"], mono, spark)
    assert json.loads(cli.run(["pack", "--symbol", "helper", "--workspace", "billing", "--fallback-all", "--no-timestamp"], mono, spark)[0])["items"]


def test_strict(spark, tmp_path):
    (tmp_path / ".git").mkdir()
    for name in ("a.py", "b.py"):
        (tmp_path / name).write_text("def same():\n    pass\n")
    with pytest.raises(AmbiguousSymbol):
        cli.run(["pack", "--symbol", "same", "--symbol-strict"], str(tmp_path), spark)
    assert cli.run(["pack", "--symbol", "a.py:same", "--symbol-strict"], str(tmp_path), spark)


def test_log_and_folder(spark, mono, tmp_path):
    log = tmp_path / "log"
    log.write_text('File "services/billing/src/invoice.py", line 6\n')
    got = pack(spark, mono, "--from-log", str(log), "--reason")
    assert (got["items"][0]["reasons"], got["items"][0]["range"]) == (["diagnostic"], {"startLine": 3, "endLine": 9})
    got = pack(spark, mono, "--folder", "docs", "--reason", "--redact")
    assert [(i["filePath"], i["content"]) for i in got["items"]] == [
        ("docs/empty", "[Empty directory]"), ("docs/logo.png", "[Binary file: image/png, 1 bytes]"), ("docs/readme.md", "hello [REDACTED]1"),
    ]
    assert len(pack(spark, mono, "--folder", "docs", "--folder-include-hidden")["items"]) == 4
    got = pack(spark, mono, "--folder", "docs", "--folder-max-size", "0")
    assert all("exceeds max size" in o["reason"] for o in got["omitted"]) and got["omitted"]


def test_import_graph(spark, mono):
    g = graph(spark, mono, "--entry", "services/billing/src/loader.py")
    edges = {(e["from"][3:], e["to"][3:], e["type"]) for e in g["edges"]}
    src = "services/billing/src/"
    # A name in a module that isn't one backs off to the longest prefix that is.
    assert (src + "loader.py", src + "__init__.py", "imports-dynamic") in edges and (src + "loader.py", src + "invoice.py", "imports") in edges
    # The package's own file is module src, its neighbour is module invoice: src.invoice is unknown.
    assert (src + "__init__.py", src + "invoice.py", "imports") not in edges
    assert [n["filePath"] for n in g["nodes"] if n["anchor"]] == [src + "loader.py"]
    g = graph(spark, mono, "--entry", "packages/web/src/util.ts", "--include-tests", "true")
    assert ("ts:packages/web/src/util.test.ts", "ts:packages/web/src/util.ts", "tests") in {(e["from"], e["to"], e["type"]) for e in g["edges"]}


def test_call_graph(spark, mono):
    g = graph(spark, mono, "--entry", "services/billing/src/invoice.py", "--graph-type", "calls", "--collapse", "none", "--include-external")
    src = "py:services/billing/src/invoice.py#"
    got = {(e["from"], e["to"], e["type"], e["confidence"]) for e in g["edges"]}
    assert got == {(src + "Invoice.total", src + "Invoice.tax", "calls", 0.8), (src + "Invoice.tax", src + "compute", "calls", 0.9)}
    g = graph(spark, mono, "--entry", "packages/web/src/util.ts", "--graph-type", "combined", "--collapse", "class")
    assert ("ts:packages/web/src/util.ts#Box", "ts:packages/web/src/util.ts#helper") in {(e["from"], e["to"]) for e in g["edges"]}
    dot = cli.run(["graph", "--entry", "packages/web/src/index.ts", "--format", "dot", "--no-timestamp"], mono, spark)[0]
    assert dot.startswith("digraph G {\n  rankdir=LR;") and 'fillcolor="lightblue"' in dot


def test_markdown_is_deterministic(spark, mono):
    argv = ["pack", "--entry", "packages/web/src/index.ts", "--format", "md", "--reason", "--no-timestamp"]
    one, two = (cli.run(argv, mono, spark)[0] for _ in range(2))
    assert one == two and "## Index\n- file packages/web/src/index.ts (reasons: entry file, barrel file)" in one


@pytest.mark.parametrize("argv", [["pack"], ["pack", "--entry"], ["pack", "--nope", "1"], ["pack", "x"], ["pack", "--entry", "a", "--depth", "-1"],
                                  ["pack", "--entry", "a", "--workspace", "w", "--all-workspaces"], ["pack", "--entry", "a", "--format", "dot"], ["what"],
                                  ["graph", "--entry", "a", "--max-nodes", "many"]])
def test_usage(argv, tmp_path, monkeypatch):
    with pytest.raises(UsageError):
        cli.run(argv, str(tmp_path))
    monkeypatch.chdir(tmp_path)
    assert cli.main(argv) == 3


def test_version_and_help(capsys):
    assert cli.main(["version"]) == 0 and cli.main(["--help"]) == 0
    assert "--symbol-strict" in capsys.readouterr().out


def test_config(tmp_path):
    (tmp_path / ".codequarryrc.json").write_text('{"budgetChars": 5, "ignore": ["x"], "redact": {"enabled": true}}')
    (tmp_path / "w").mkdir()
    (tmp_path / "w/.codequarryrc.json").write_text('{"depth": 7}')
    c = load_config(str(tmp_path), str(tmp_path / "w"))
    assert (c.budget_chars, c.ignore, c.redact, c.depth) == (5, ["x"], True, 7) and c.redact_patterns
    (tmp_path / "w/.codequarryrc.json").write_text("{")
    with pytest.raises(UsageError):
        load_config(str(tmp_path), str(tmp_path / "w"))


def test_diff_anchor(spark, tmp_path):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("x = 1\n" * 5)
    git("add", ".")
    git("commit", "-qm", "one")
    (tmp_path / "a.py").write_text("x = 1\n" * 4 + "x = 2\n")
    got = json.loads(cli.run(["pack", "--from-diff", "HEAD", "--reason", "--no-timestamp"], str(tmp_path), spark)[0])
    assert {(i["kind"], i["reasons"][0]) for i in got["items"]} == {("snippet", "diff hunk"), ("file", "diff file")}
    with pytest.raises(UsageError):
        cli.run(["pack", "--from-diff", "--output=x"], str(tmp_path), spark)


def test_index_store(spark, mono, tmp_path):
    from codequarry.sources.repo import read_repo
    from codequarry.streaming import index_store

    files = read_repo(spark, mono, mono, ["node_modules/"])
    store = str(tmp_path / "store")
    assert {r["status"] for r in index_store.status(files, store).collect()} == {"added"}
    first = index_store.refresh(files, store)
    n = first.count()
    assert index_store.refresh(files, store).count() == n
    assert "packages/web/src/util.ts" in {r["path"] for r in first.select("path").distinct().collect()}
    fewer = files.where("path <> 'packages/web/src/util.ts'")
    assert {r["status"] for r in index_store.status(fewer, store).collect()} == {"unchanged", "removed"}
    assert index_store.refresh(fewer, store).where("path = 'packages/web/src/util.ts'").count() == 0


def test_stream_of_log_lines(spark, tmp_path):
    from codequarry.streaming.log_anchors import stream_anchors

    rows = [("2024-01-01 00:00:00", "src/a.ts:5:1 - error"), ("2024-01-01 00:00:01", "src/a.ts:5:9 - error"), ("2024-01-01 00:00:02", "x")]
    spark.createDataFrame(rows, "ts string, line string").selectExpr("cast(ts as timestamp) ts", "line").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, line string").parquet(str(tmp_path / "in"))
    q = stream_anchors(stream).writeStream.format("memory").queryName("anchors").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = spark.table("anchors").collect()
    finally:
        q.stop()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [("src/a.ts", 2, 8)]


def test_ts_tokens():
    found = ts_tokens.parse('import a from "./x";\nexport * from \'./y\'\nconst r = /a"\\/[/]b/g, s = `t ${f(`n`)} import("z")`;\n// import "./no"\nfunction g() { return import("./d") }\nnew K().m(1)\nx?.y.z(2)\n')
    assert [(f.name, f.is_dynamic) for f in found if f.rec == "import"] == [("./x", False), ("./y", False), ("./d", True)]
    assert [(f.receiver, f.name, f.owner) for f in found if f.rec == "call"] == [(None, "f", None), (None, "K", None), ("[expr]", "m", None), ("x.y", "z", None)]


def test_python_ast():
    found = python_ast.parse("@d\nclass K:\n    def m(self):\n        def inner(): pass\n        return a.b.c()\nif x:\n    def g(): pass\n")
    assert [(f.name, f.kind, f.start_line, f.owner) for f in found if f.rec == "definition"] == [("K", "class", 1, None), ("m", "method", 3, "K"), ("g", "function", 7, None)]
    (call,) = (f for f in found if f.rec == "call")
    assert (call.name, call.kind, call.receiver, call.owner) == ("c", "chain", "a.b", "K.m")
    broken = python_ast.parse("def f(:\nimport x.y\n")
    assert broken[-1].status == "errors" and any(f.rec == "import" and f.name == "x.y" for f in broken)


def test_request_defaults():
    assert Request().max_nodes == 500 and Request().max_edges == 2000


def test_commands_with_an_index_parse_what_changed(spark, mono, tmp_path, monkeypatch):
    """A second run over the same files parses nothing; after a change only the changed file is parsed."""
    from codequarry.streaming import index_store

    argv, parsed = ["--entry", "packages/web/src/index.ts", "--reason", "--index", str(tmp_path / "index")], []
    parse = index_store.parse_files
    monkeypatch.setattr(index_store, "parse_files", lambda files: parsed.append(sorted(r["path"] for r in files.select("path").collect())) or parse(files))
    first = pack(spark, mono, *argv)
    assert first["items"] == pack(spark, mono, "--entry", "packages/web/src/index.ts", "--reason")["items"]
    assert len(parsed) == 1 and len(parsed[0]) > 5
    again, drawn = pack(spark, mono, *argv), graph(spark, mono, "--entry", "packages/web/src/index.ts", *argv[3:])
    assert again["items"] == first["items"] and drawn["nodes"] and len(parsed) == 1
    changed = f"{mono}/packages/web/src/lazy.ts"
    before = open(changed).read()
    try:
        open(changed, "w").write("export const lazy = 1;\nexport const more = 2;\n")
        assert pack(spark, mono, *argv)["items"] != first["items"]
    finally:
        open(changed, "w").write(before)
    assert parsed[1:] == [["packages/web/src/lazy.ts"]]


def test_files_of_the_same_size_and_time_are_not_hashed(spark, tmp_path):
    from codequarry.streaming import index_store

    columns = "ws_root string, path string, rel_path string, lang string, size bigint, mtime_ms double, content string"
    files = lambda rows: spark.createDataFrame([("", p, p, "py", len(c), t, c) for p, t, c in rows], columns)
    store = str(tmp_path / "store")
    index_store.refresh(files([("a.py", 1.0, "x = 1"), ("b.py", 1.0, "y = 1"), ("c.py", 1.0, "z")]), store)
    now = files([("a.py", 1.0, "x = 2"), ("b.py", 2.0, "y = 1"), ("c.py", 2.0, "w"), ("d.py", 1.0, "d")])
    assert {r["path"]: r["status"] for r in index_store.status(now, store).collect()} == {"a.py": "unchanged", "b.py": "unchanged", "c.py": "changed", "d.py": "added"}
    edges = spark.createDataFrame([("a.py", "b.py", "imports"), ("a.py", 'q"c.py', "imports-dynamic"), ("d.py", "a.py", "imports")], "src string, dst string, edge_type string")
    index_store.save_edges(edges, store)
    assert {tuple(r) for r in index_store.load_edges(spark, store).collect()} == {tuple(r) for r in edges.collect()}


def test_project_files(spark, tmp_path):
    """Sources outside a project have no edges, unless the project imports them."""
    from codequarry.sources.tsconfig import load_project

    files = {
        ".git/HEAD": "", "package.json": "{}", "base.json": '{"compilerOptions": {"outDir": "out"}, "include": ["nothing"]}',
        "tsconfig.json": '// a project\n{"extends": "./base", "include": ["src/**/*", "tool.ts",], /* not */ "exclude": ["src/old"]}',
        "src/a.ts": 'import "../lib/c";\n', "src/old/b.ts": 'import "../a";\n', "lib/c.ts": 'import "./d";\n', "lib/d.ts": "", "tool.ts": 'import "./src/a";\n', "stray.ts": 'import "./src/a";\n',
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    project = load_project(str(tmp_path))
    held = {p for p in files if p.endswith(".ts") and project.holds(p)}
    assert held == {"src/a.ts", "tool.ts"} and not project.holds("src/x.js") and load_project(str(tmp_path / "src")) is None

    def reached(entry):
        return sorted(n["filePath"] for n in graph(spark, str(tmp_path), "--entry", entry, "--depth", "3")["nodes"])

    assert reached("tool.ts") == ["lib/c.ts", "lib/d.ts", "src/a.ts", "tool.ts"]
    assert reached("stray.ts") == ["stray.ts"] and reached("src/old/b.ts") == ["src/old/b.ts"]
    assert reached("lib/c.ts") == ["lib/c.ts", "lib/d.ts"]
    (tmp_path / "tsconfig.json").write_text("{ nonsense")
    with pytest.raises(UsageError):
        load_project(str(tmp_path))


def test_stat_only_scan_and_other_languages(spark, mono, tmp_path):
    from codequarry.extract import adapters
    from codequarry.extract.index import build_index
    from codequarry.extract.records import Found
    from codequarry.sources.repo import read_repo

    stats = read_repo(spark, mono, mono, ["node_modules/"], stat_only=True).collect()
    assert len(stats) > 5 and all(r["content"] is None and r["size"] > 0 and r["mtime_ms"] > 0 for r in stats)
    (tmp_path / "x.toy").write_text("one two")
    adapters.register(adapters.Adapter("toy", (".toy",), lambda text: [Found("definition", w, "word", 1, 1) for w in text.split()]))
    try:
        index = build_index(read_repo(spark, str(tmp_path), str(tmp_path)))
        assert sorted(r["name"] for r in index.definitions.collect()) == ["one", "two"]
    finally:
        adapters.unregister("toy")


def test_types_of_receivers_and_code_in_templates():
    source = (
        'import { a,\n b } from "./x"\nexport { c }\nimport d from "./y"\n'
        "class Svc { private store: Store; cache = new Cache();\n constructor(private readonly log: Logger) {}\n"
        " run(q?: Query) { this.store.get(1); this.log.info(1); q.exec(); return this.cache.put(`a ${fmt(1)} b ${`n ${inner()}`}`) }\n}\n"
        "function go(s: Svc, n: number) { const t: Tree<X> = make(); const u = new Util(); s.run(); u.do(); t.walk(); n.toFixed(); x.y.z() }\n"
        "const o = (b: Box) => b.open();\n"
    )
    found = ts_tokens.parse(source)
    assert [f.name for f in found if f.rec == "import"] == ["./x", "./y"]
    calls = {(f.receiver, f.name) for f in found if f.rec == "call" and f.kind == "property"}
    assert calls == {("Store", "get"), ("Logger", "info"), ("Query", "exec"), ("Cache", "put"), ("Svc", "run"), ("Util", "do"), ("t", "walk"), ("n", "toFixed"), ("x.y", "z"), ("Box", "open")}
    assert {"fmt", "inner", "make"} <= {f.name for f in found if f.rec == "call" and f.kind == "identifier"}
    assert ts_tokens.parse("import {" + "a, " * 5000 + 'z } from "./far"\n')[0].name == "./far"


def test_calls_by_file_and_symbol(spark):
    from codequarry.plans.symbols import calls_of

    calls = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f")], "path string, caller string")
    assert calls_of(calls).count() == 3 and calls_of(calls, ["a"]).count() == 2 and calls_of(calls, ["a"], ["g"]).count() == 1


def test_elements_are_no_code_but_what_they_hold_is():
    source = (
        'const View = (p: Props) => {\n  if (p.a < b(1) && c > d) { return null; }\n  return (\n'
        '    <Layout title="it\'s (not) a call" items={list(p)} {...rest(p)}>\n      Don\'t (call) this; import "x"\n'
        "      <ul className='k'>{p.rows.map((r) => <Row key={id(r)} on={() => hit(`a ${fmt(r)}`)} />)}</ul>\n"
        "      <>{cond ? <b>yes (no)</b> : other()}</>\n    </Layout>\n  );\n};\n"
        "const f = <T,>(x: T) => keep(x);\nconst g = <T>(x: T) => kept(x);\n"
    )
    found = ts_tokens.parse(source)
    assert [f.name for f in found if f.rec == "call"] == ["b", "list", "rest", "map", "id", "hit", "fmt", "other", "keep", "kept"]
    assert {f.owner for f in found if f.rec == "call" and f.start_line < 10} == {"View"}
    assert not [f for f in found if f.rec == "import"] and {"Layout", "Row"} <= {f.name for f in found if f.rec == "identifier"}
    assert [(f.name, f.end_line) for f in found if f.rec == "definition"] == [("View", 10), ("f", 11), ("g", 12)]


def test_a_scan_is_split_below_its_top_folders(tmp_path):
    from codequarry.sources import repo

    for k in range(9):
        for j in range(5):
            (tmp_path / f"only/a{k}/b{j}").mkdir(parents=True)
            (tmp_path / f"only/a{k}/b{j}/x.py").write_text("x = 1")
    (tmp_path / "only/top.py").write_text("y = 1")
    (tmp_path / "only/skip/deep").mkdir(parents=True)
    (tmp_path / "only/skip/deep/z.py").write_text("z = 1")
    reader = repo.RepoReader({"path": str(tmp_path), "ignore": "skip/", "languages": '{".py": "py"}'})
    parts = reader.partitions()
    paths = [row[1] for p in parts for row in reader.read(p)]
    assert len(parts) > 40 and len(paths) == len(set(paths)) == 46 and not any("skip" in p for p in paths)


def test_symbols_are_looked_for_in_the_scope(spark, mono):
    """A workspace that an anchor brings in expands, but its symbols aren't searched."""
    argv = ["pack", "--no-timestamp", "--workspace", "billing", "--entry", "packages/web/src/index.ts"]
    with pytest.raises(AnchorNotFound):
        cli.run([*argv, "--symbol", "hello"], mono, spark)
    assert json.loads(cli.run([*argv, "--symbol", "hello", "--fallback-all"], mono, spark)[0])["items"]


def test_folder_source(spark, tmp_path):
    """Every entry once, whatever the partitions; links are followed when asked, but not in circles."""
    from codequarry.sources import folder

    for k in range(8):
        (tmp_path / f"f/a{k}/b/c").mkdir(parents=True)
        (tmp_path / f"f/a{k}/b/t{k}.md").write_text("t" * k)
    (tmp_path / "f/a0/.h").write_text("hidden")
    (tmp_path / "f/a1/big.txt").write_text("x" * 100)
    (tmp_path / "f/a2/z.bin").write_bytes(b"a\0b")
    (tmp_path / "f/a3/up").symlink_to(tmp_path / "f/a3")
    (tmp_path / "other").mkdir()
    (tmp_path / "other/o.md").write_text("o")
    (tmp_path / "f/a4/out").symlink_to(tmp_path / "other")
    def read(**more):
        rows = folder.read_folder(spark, str(tmp_path / "f"), str(tmp_path), ["a7/"], 50, **more).collect()
        assert len(rows) == len({r["path"] for r in rows})
        return {r["path"].removeprefix(str(tmp_path) + "/"): (r["kind"], r["size"]) for r in rows}

    want = {f"f/a{k}/b/t{k}.md": ("text", k) for k in range(7)} | {f"f/a{k}/b/c": ("directory", 0) for k in range(7)}
    want |= {"f/a1/big.txt": ("too-large", 100), "f/a2/z.bin": ("binary", 3)}
    assert read() == want
    assert read(hidden=True) == want | {"f/a0/.h": ("text", 6)}
    assert read(links=True)["f/a4/out/o.md"] == ("text", 1)
    assert folder.read_folder(spark, str(tmp_path / "none"), str(tmp_path), []).count() == 0


def test_made_files_are_parsed_by_many_tasks(spark, sf_dir):
    """Joining the numbers leaves one task; texts are made and parsed by as many as there are cores."""
    from codequarry.extract.index import build_index
    from codequarry.plans import source_queries

    for made in (source_queries._typescript(spark, sf_dir), source_queries._python(spark, sf_dir)):
        index = build_index(made, kinds=("definition", "import", "call"))
        assert index.records.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        held = [n for n in index.files.rdd.glom().map(len).collect() if n]
        assert len(held) > 1 and max(held) < sum(held)


@pytest.mark.parametrize("kinds", [("definition",), ("import",), ("call",), ("identifier",), ("definition", "import", "call")])
def test_only_the_records_that_a_plan_reads_are_kept(spark, mono, monkeypatch, kinds):
    """With the same fields as among all records, and by few records at a time; modules and imports aren't made unasked."""
    from codequarry.extract import index
    from codequarry.sources.repo import read_repo

    files = read_repo(spark, mono, mono)
    every = index.build_index(files).records
    monkeypatch.setattr(index, "BATCH", 3)
    found = index.build_index(files, kinds=kinds)
    assert {r["rec"] for r in found.records.collect()} == set(kinds)
    assert sorted(map(str, found.records.collect())) == sorted(map(str, every.where(every["rec"].isin(*kinds)).collect()))
    assert not {"modules", "imports"} & set(vars(found))
