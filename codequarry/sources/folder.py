"""Whole folders as entries, by a Spark data source: texts, binaries, empty directories, and
what was too large. Subtrees are its partitions, so files are read by many tasks; the folder
must be one that all of them see."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.functions.paths import BINARY_EXTENSIONS, MIME_TYPES

from .ignore import IgnoreMatcher
from .repo import PARTS

#: kind: text, binary, directory (an empty one) or too-large (which isn't read).
ENTRIES = "path string, kind string, size bigint, content string, mime_type string, is_empty boolean"


def is_binary(path: str) -> bool:
    name = os.path.basename(path).lower()
    if name.rsplit(".", 1)[-1] in BINARY_EXTENSIONS:
        return True
    with open(path, "rb") as f:
        return b"\0" in f.read(4096)


class Part(InputPartition):
    def __init__(self, below: str, deep: bool) -> None:
        self.below, self.deep = below, deep


class FolderReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.root = options["path"], options["root"]
        self.rules = options.get("ignore", "").split("\n")
        self.max_bytes = int(options.get("max_bytes", 5 << 20))
        self.hidden, self.links = options.get("hidden") == "true", options.get("links") == "true"

    def entries(self, below: str, matcher: IgnoreMatcher) -> tuple[list[os.DirEntry], bool]:
        """What counts in a folder, by name, and whether the folder is empty."""
        inside = sorted(os.scandir(below), key=lambda e: e.name)
        counted = []
        for e in inside:
            rel = os.path.relpath(e.path, self.root)
            if (e.name.startswith(".") and not self.hidden) or (e.is_symlink() and not self.links):
                continue
            if not matcher.ignores(rel + "/" if e.is_dir() else rel):
                counted.append(e)
        return counted, not inside

    def partitions(self) -> list[InputPartition]:
        """Subtrees, split level by level until there are enough of them; a split one leaves its own files as a part."""
        if not os.path.isdir(self.folder):
            return [Part("", False)]
        matcher = IgnoreMatcher(self.rules)
        inside = lambda d: [e.path for e in self.entries(d, matcher)[0] if e.is_dir()]
        parts, level = [Part(self.folder, False)], inside(self.folder)
        while level and len(parts) + len(level) < PARTS:
            below = {d: inside(d) for d in level}
            if not any(below.values()):
                break
            parts += [Part(d, False) for d in level]
            level = [x for d in level for x in below[d]]
        return [*parts, *(Part(d, True) for d in level)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.below:
            return
        matcher = IgnoreMatcher(self.rules)
        waiting, seen = [partition.below], {os.path.realpath(partition.below)}
        while waiting:
            here = waiting.pop()
            counted, empty = self.entries(here, matcher)
            for e in counted:
                if e.is_dir():
                    # Links may lead back up.
                    if partition.deep and (real := os.path.realpath(e.path)) not in seen:
                        seen.add(real)
                        waiting.append(e.path)
                    continue
                size = e.stat().st_size
                if size > self.max_bytes:
                    yield e.path, "too-large", size, None, None, False
                elif is_binary(e.path):
                    yield e.path, "binary", size, None, MIME_TYPES.get(e.name.lower().rsplit(".", 1)[-1], "application/octet-stream"), False
                else:
                    yield e.path, "text", size, Path(e.path).read_text("utf-8", "replace"), None, size == 0
            if empty:
                yield here, "directory", 0, None, None, True


class FolderDataSource(DataSource):
    """``spark.read.format("codequarry_folder").load(folder)``; options: root (to which ignore
    rules are relative), ignore (rules, one a line), max_bytes, hidden, links."""

    @classmethod
    def name(cls) -> str:
        return "codequarry_folder"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(self.options)


def read_folder(
    spark: SparkSession, folder: str, root: str, rules: list[str], max_bytes: int = 5 << 20, hidden: bool = False, links: bool = False
) -> DataFrame:
    """The entries below a folder; a folder that isn't there has none."""
    spark.dataSource.register(FolderDataSource)
    options = {"root": root, "ignore": "\n".join(rules), "max_bytes": max_bytes, "hidden": str(hidden).lower(), "links": str(links).lower()}
    return spark.read.format("codequarry_folder").options(**options).load(folder)
