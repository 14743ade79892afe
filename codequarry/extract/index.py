"""From files to relations: one parsing stage, then joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions import paths
from codequarry.operators import matching
from codequarry.operators.graphs import merge_edge_types
from codequarry.operators.ranking import first_per_group
from codequarry.operators.scratch import kept

from . import adapters
from .records import RECORD

_COLUMNS = [c.split(" ")[0] for c in RECORD.split(", ")]
_TYPES = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split(" ")[1]] for c in RECORD.split(", ")]
#: Records that a task holds before it passes them on.
BATCH = 20_000


def parse_files(files: DataFrame, kinds: frozenset[str] | None = None) -> DataFrame:
    """Records of all files (ws_root, path, lang, content), each file parsed once; files of
    languages that no adapter knows have none. ``kinds`` names the records that are wanted, all
    if it is None."""
    parse_of = adapters.parsers(kinds)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _COLUMNS)
            out.clear()
            return made

        for batch in batches:
            for ws_root, path, lang, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for seq, f in enumerate(parse_of[lang](content or "") if lang in parse_of else ()):
                    if kinds is None or f.rec in kinds:
                        out.append(
                            (ws_root, path, lang, seq, f.rec, f.name, f.kind, f.start_line, f.end_line, f.owner, f.owner_start,
                             f.owner_end, f.receiver, f.level, f.is_dynamic, f.status)
                        )
                if len(out) >= BATCH:
                    yield flush()
        if out:
            yield flush()

    return files.select("ws_root", "path", "lang", "content").mapInArrow(parse, RECORD)


@dataclass(frozen=True)
class Index:
    """The relations of a repository; modules and imports are made when they are first asked for."""

    files: DataFrame
    records: DataFrame
    import_roots: tuple[str, ...] = ("src", ".")
    known_imports: DataFrame | None = None

    @cached_property
    def modules(self) -> DataFrame:
        return kept(python_modules(self.files, list(self.import_roots)))

    @cached_property
    def imports(self) -> DataFrame:
        if self.known_imports is not None:
            return self.known_imports
        edges = python_imports(self.records, self.modules).unionByName(ts_imports(self.records, self.files))
        return kept(merge_edge_types(edges, F.col("lang")))

    @property
    def definitions(self) -> DataFrame:
        return self.records.where("rec = 'definition'")

    @property
    def identifiers(self) -> DataFrame:
        return self.records.where("rec = 'identifier'").select("path", "lang", "ws_root", "name", F.col("start_line").alias("line"))


def python_modules(files: DataFrame, import_roots: list[str]) -> DataFrame:
    """(ws_root, module, path); the first file in path order gives a module its file."""
    named = files.where("lang = 'py'").select("ws_root", "path", paths.python_module(F.col("rel_path"), import_roots).alias("module"))
    named = named.where("module IS NOT NULL")
    return named.join(first_per_group(named, ["ws_root", "module"], [F.col("path").asc()]).select("ws_root", "module", F.col("path").alias("_first")),
                      ["ws_root", "module"]).select("ws_root", "module", "path", (F.col("path") == F.col("_first")).alias("first"))


def _absolute(module: Column, level: Column, own: Column, package: Column) -> Column:
    """A relative import's module: the importing module less ``level`` parts (one less for a
    package's own file), then what follows the dots."""
    parts = F.split(own, r"\.")
    up = F.greatest(F.size(parts) - level + F.when(package, 1).otherwise(0), F.lit(0))
    base = F.array_join(F.slice(parts, 1, up), ".")
    joined = F.when(base == "", module).when(module == "", base).otherwise(F.concat_ws(".", base, module))
    return F.when(level > 0, joined).otherwise(module)


def python_imports(records: DataFrame, modules: DataFrame) -> DataFrame:
    """Import edges of Python files: to the submodule that a name is, else to the module, else
    to the longest prefix that is one."""
    own = modules.select("ws_root", "path", F.col("module").alias("_own"))
    said = records.where("rec = 'import' AND lang = 'py'").join(own, ["ws_root", "path"], "left")
    package = F.col("path").endswith("__init__.py")
    target = _absolute(F.col("name"), F.col("level"), F.coalesce("_own", F.lit("")), package)
    full = F.when(F.col("receiver").isNotNull() & (F.col("receiver") != "*"), F.concat_ws(".", F.nullif(target, F.lit("")), "receiver")).otherwise(target)
    said = said.select("ws_root", "path", "is_dynamic", full.alias("module")).where("module <> ''")
    # Names carry their workspace, so that one join serves all.
    tag = lambda c: F.concat_ws("\0", "ws_root", c)
    names = said.select(tag("module").alias("_name")).distinct()
    known = modules.where("first").select(tag("module").alias("_key"), F.col("path").alias("dst"))
    found = matching.longest_prefix(names, "_name", known, "_key", "dst").select("_name", "dst")
    edges = said.withColumn("_name", tag("module")).join(found, "_name")
    kind = F.when(F.col("is_dynamic"), "imports-dynamic").otherwise("imports")
    return edges.where("path <> dst").select("ws_root", F.col("path").alias("src"), "dst", kind.alias("edge_type"), F.lit("py").alias("lang"))


#: What a specifier without extension may stand for, in order; .js may mean .ts.
_TAILS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx")


def _normal(path: Column) -> Column:
    """A path without . and .. parts."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(
        F.concat(out, F.array(p))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def ts_imports(records: DataFrame, files: DataFrame) -> DataFrame:
    """Import edges of relative specifiers: each becomes a few candidate paths in order of
    preference, and the first that exists wins. Targets outside the importing file's workspace
    are no edges."""
    said = records.where("rec = 'import' AND lang = 'ts' AND name RLIKE '^[./]'").select(
        "ws_root", F.col("path").alias("src"), "name", "is_dynamic"
    )
    target = _normal(F.concat_ws("/", paths.dirname(F.col("src")), "name"))
    said = said.distinct().withColumn("_target", target)
    bare = F.regexp_replace("_target", r"\.(js|jsx|mjs)$", "")
    options = F.concat(
        F.array(F.col("_target")),
        F.when(F.col("_target").rlike(r"\.jsx?$"), F.array(F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))).otherwise(F.array()),
        F.array(*(F.concat("_target", F.lit(t)) for t in _TAILS)),
    )
    tried = said.select("ws_root", "src", "name", "is_dynamic", F.posexplode(options).alias("_rank", "dst"))
    there = tried.join(files.select("dst" if "dst" in files.columns else F.col("path").alias("dst")).distinct(), "dst")
    best = there.groupBy("ws_root", "src", "name", "is_dynamic").agg(F.min_by("dst", "_rank").alias("dst"))
    kind = F.when(F.col("is_dynamic"), "imports-dynamic").otherwise("imports")
    edges = best.select("ws_root", "src", "dst", kind.alias("edge_type"), F.lit("ts").alias("lang"))
    return edges.where((F.col("src") != F.col("dst")) & paths.inside(F.col("dst"), F.col("ws_root")))


def build_index(
    files: DataFrame, import_roots: list[str] | None = None, store: str | None = None, kinds: tuple[str, ...] | None = None
) -> Index:
    """Parse the files and resolve their imports; everything is kept, as plans read it often.
    With a store only what changed since its last use is parsed. ``kinds`` names the records
    that a plan reads, if not all (a store holds all)."""
    files = kept(files)
    roots = tuple(import_roots or ["src", "."])
    if not store:
        return Index(files, kept(parse_files(files, None if kinds is None else frozenset(kinds))), roots)
    from codequarry.streaming import index_store

    records = index_store.refresh(files, store)
    if (known := index_store.stored_edges(files.sparkSession, store)) is not None:
        homes = files.select("ws_root", F.col("path").alias("src"))
        return Index(files, records, roots, kept(known.join(homes, "src").select("ws_root", "src", "dst", "edge_type")))
    index = Index(files, records, roots)
    index_store.save_edges(index.imports, store)
    return index
