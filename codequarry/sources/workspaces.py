"""Workspaces of a repository, by Node and Python markers, and scopes over them."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from codequarry.schema import WORKSPACES

from .config import UsageError

#: What makes a directory a Python project, and where projects are looked for.
PYTHON_MARKERS = ("pyproject.toml", "requirements.txt")
PYTHON_PLACES = ("apps/*", "packages/*", "services/*")


@dataclass(frozen=True)
class Workspace:
    ws_id: str
    name: str
    root: str
    kind: str


def repo_root(cwd: str) -> str:
    """The nearest directory upwards with a .git entry, else ``cwd``."""
    here = Path(cwd).resolve()
    return str(next((p for p in [here, *here.parents] if (p / ".git").exists()), here))


def _package(root: Path) -> dict:
    try:
        found = json.loads((root / "package.json").read_text("utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def _node_globs(root: Path) -> list[str]:
    listed = _package(root).get("workspaces") or []
    globs = listed.get("packages", []) if isinstance(listed, dict) else list(listed)
    pnpm = root / "pnpm-workspace.yaml"
    if pnpm.is_file():
        import yaml

        globs += (yaml.safe_load(pnpm.read_text("utf-8")) or {}).get("packages") or []
    return globs


def _directories(root: Path, globs: list[str]) -> list[Path]:
    wanted = [g for g in globs if not g.startswith("!")]
    dropped = {p for g in globs if g.startswith("!") for p in root.glob(g[1:].rstrip("/"))}
    found = {p for g in wanted for p in root.glob(g.rstrip("/")) if p.is_dir() and "node_modules" not in p.parts}
    return sorted(found - dropped)


def detect(root: str) -> list[Workspace]:
    """All workspaces, sorted by id; one that both detectors find is mixed and keeps its Node name."""
    top = Path(root)
    found: dict[Path, tuple[str, str]] = {}
    for p in [top, *_directories(top, _node_globs(top))]:
        if (p / "package.json").is_file():
            found[p] = (str(_package(p).get("name") or p.name), "node")
    for p in [top, *_directories(top, list(PYTHON_PLACES))]:
        if any((p / m).is_file() for m in PYTHON_MARKERS):
            name, kind = found.get(p, (p.name, "python"))
            found[p] = (name, "mixed" if kind == "node" else "python")
    if not found:
        found[top] = (top.name, "mixed")
    made = [Workspace(p.relative_to(top).as_posix(), n, str(p), k) for p, (n, k) in found.items()]
    return sorted(made, key=lambda w: w.ws_id)


def owner(workspaces: list[Workspace], path: str) -> Workspace | None:
    """The deepest workspace that holds the path."""
    holding = [w for w in workspaces if path == w.root or path.startswith(w.root.rstrip("/") + "/")]
    return max(holding, key=lambda w: len(w.root), default=None)


def scope(workspaces: list[Workspace], cwd: str, name: str | None = None, every: bool = False) -> tuple[str, list[Workspace], str | None]:
    """(mode, workspaces, note): all, the named one, or the one that holds ``cwd``."""
    if every and name:
        raise UsageError("--workspace and --all-workspaces exclude each other")
    if every:
        return "all", workspaces, None
    if name:
        named = [w for w in workspaces if name in (w.name, w.ws_id)]
        found = named[0] if named else owner(workspaces, str(Path(cwd, name).resolve()))
        if not found:
            raise UsageError(f"no workspace is called {name}")
        return "explicit", [found], None
    here = owner(workspaces, str(Path(cwd).resolve()))
    if here:
        return "auto", [here], None
    return "auto", workspaces[:1], "no workspace holds the current directory; the first one is used"


def frame(spark: SparkSession, workspaces: list[Workspace]) -> DataFrame:
    return spark.createDataFrame([(w.ws_id, w.name, w.root, w.kind) for w in workspaces], WORKSPACES)
