"""Source files of a repository as a Spark data source.

Spark's own file readers skip names that begin with an underscore or a dot, which would lose
every ``__init__.py``; hence a data source of its own. Its partitions are subtrees, so big
repositories are read by many tasks; the folder must be one that all of them see.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codequarry.extract import adapters
from codequarry.schema import FILES

from .ignore import IgnoreMatcher


#: Subtrees that a scan aims at.
PARTS = 64


def folders(root: str, below: str) -> list[str]:
    """The folders in a folder, by relative path; hidden ones and links aren't followed."""
    try:
        found = sorted(e.name for e in os.scandir(os.path.join(root, below)) if e.is_dir() and not e.is_symlink() and not e.name.startswith("."))
    except OSError:
        return []
    return [f"{below}/{name}" if below else name for name in found]


class Subtree(InputPartition):
    def __init__(self, root: str, below: str, deep: bool) -> None:
        self.root, self.below, self.deep = root, below, deep


def walk(root: str, below: str, deep: bool, matcher: IgnoreMatcher, repo: str, hidden: bool = False) -> Iterator[str]:
    """Relative paths of the files below a directory, sorted; symbolic links are not followed."""
    here = os.path.join(root, below) if below else root
    prefix = os.path.relpath(root, repo)
    prefix = "" if prefix == "." else prefix + "/"
    try:
        entries = sorted(os.scandir(here), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        rel = f"{below}/{e.name}" if below else e.name
        if e.is_symlink() or (e.name.startswith(".") and not hidden):
            continue
        if e.is_dir():
            if deep and not matcher.ignores(prefix + rel + "/"):
                yield from walk(root, rel, True, matcher, repo, hidden)
        elif not matcher.ignores(prefix + rel):
            yield rel


class RepoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.repo = options.get("repo", self.root)
        self.rules = options.get("ignore", "").split("\n")
        self.languages = json.loads(options["languages"])
        self.stat_only = options.get("stat_only", "false") == "true"

    def prefix(self) -> str:
        """What leads from the repository's root to this one."""
        found = os.path.relpath(self.root, self.repo)
        return "" if found == "." else found + "/"

    def partitions(self) -> list[InputPartition]:
        """Subtrees, split level by level until there are enough of them; a split one leaves its own files as a part."""
        matcher, prefix = IgnoreMatcher(self.rules), self.prefix()
        inside = lambda d: [x for x in folders(self.root, d) if not matcher.ignores(f"{prefix}{x}/")]
        parts, level = [Subtree(self.root, "", False)], inside("")
        while level and len(parts) + len(level) < PARTS:
            below = {d: inside(d) for d in level}
            if not any(below.values()):
                break
            parts += [Subtree(self.root, d, False) for d in level]
            level = [x for d in level for x in below[d]]
        return [*parts, *(Subtree(self.root, d, True) for d in level)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        matcher = IgnoreMatcher(self.rules)
        if partition.below and matcher.ignores(f"{self.prefix()}{partition.below}/"):
            return
        for rel in walk(partition.root, partition.below, partition.deep, matcher, self.repo):
            lang = self.languages.get(os.path.splitext(rel)[1])
            if not lang:
                continue
            path = os.path.join(self.root, rel)
            try:
                stat = os.stat(path)
                content = None if self.stat_only else Path(path).read_text("utf-8", "replace")
            except OSError:
                continue
            at = os.path.relpath(path, self.repo)
            yield (os.path.relpath(self.root, self.repo).removeprefix("."), at, rel, lang, stat.st_size, stat.st_mtime * 1000, content)


class RepoDataSource(DataSource):
    """``spark.read.format("codequarry_repo").load(root)``; options: repo (the repository's
    root, to which paths are relative), ignore (rules, one a line), languages (by extension,
    as JSON), stat_only (sizes and times alone, files aren't opened). Files that can't be read
    are left out."""

    @classmethod
    def name(cls) -> str:
        return "codequarry_repo"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> RepoReader:  # noqa: ANN001
        return RepoReader(self.options)


def read_repo(spark: SparkSession, root: str, repo: str | None = None, ignore: list[str] | None = None, stat_only: bool = False) -> DataFrame:
    spark.dataSource.register(RepoDataSource)
    options = {
        "repo": repo or root, "ignore": "\n".join(ignore or []), "languages": json.dumps(adapters.languages()), "stat_only": str(stat_only).lower(),
    }
    return spark.read.format("codequarry_repo").options(**options).load(root)
