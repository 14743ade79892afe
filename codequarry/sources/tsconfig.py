"""TypeScript project files: which sources belong to a project."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from .config import UsageError
from .ignore import glob_pattern

#: Project files in the order tried, what is left out where nothing is said, and extensions of sources.
NAMES = ("tsconfig.json", "tsconfig.base.json")
LEFT_OUT = ("node_modules", "bower_components", "jspm_packages")
TYPED, UNTYPED = (".ts", ".tsx"), (".js", ".jsx")

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.DOTALL)


def _parsed(file: Path) -> dict:
    """JSON with comments and commas before closing brackets."""
    text = _TOKEN.sub(lambda m: m[0] if m[0].startswith('"') else " ", file.read_text("utf-8-sig"))
    text = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)
    try:
        found = json.loads(text)
    except ValueError as e:
        raise UsageError(f"{file}: {e}") from e
    return found if isinstance(found, dict) else {}


def _extended(file: Path, seen: tuple[Path, ...] = ()) -> dict:
    """A project file over those it extends; file lists are replaced, not merged. Packages can't be extended."""
    own = _parsed(file)
    above = own.get("extends") or []
    out: dict = {}
    for name in [above] if isinstance(above, str) else above:
        base = (file.parent / name) if name.startswith(".") else None
        base = base if base is None or base.suffix == ".json" else base.with_name(base.name + ".json")
        if base and base.is_file() and base not in seen:
            out |= _extended(base, (*seen, file))
    options = (out.get("compilerOptions") or {}) | (own.get("compilerOptions") or {})
    return out | own | {"compilerOptions": options}


def _regex(globs: list[str]) -> str | None:
    """One expression for paths that any of the globs takes; one without wild cards takes what is below it too."""
    made = []
    for g in globs:
        g = g.removeprefix("./").strip("/")
        if g in ("", "."):
            g = "**/*"
        made.append(glob_pattern(g) + ("" if "*" in g.rsplit("/", 1)[-1] or "?" in g.rsplit("/", 1)[-1] else "(?:/.*)?"))
    return "^(?:" + "|".join(made) + ")$" if made else None


@dataclass(frozen=True)
class Project:
    """Expressions over paths relative to the project's root; ``files`` are named one by one."""

    include: str | None
    exclude: str | None
    files: tuple[str, ...]
    extensions: tuple[str, ...]

    def holds(self, path: str) -> bool:
        if path in self.files:
            return True
        return bool(
            path.endswith(self.extensions) and self.include and re.match(self.include, path)
            and not (self.exclude and re.match(self.exclude, path))
        )


def load_project(root: str) -> Project | None:
    """The project at a workspace's root, if a project file is there."""
    file = next((Path(root, n) for n in NAMES if Path(root, n).is_file()), None)
    if file is None:
        return None
    given = _extended(file)
    options = given["compilerOptions"]
    files = tuple(f.removeprefix("./") for f in given.get("files") or [])
    include = given.get("include")
    if include is None:
        include = [] if files else ["**/*"]
    out = [str(options[k]) for k in ("outDir", "declarationDir") if options.get(k)]
    exclude = given.get("exclude")
    exclude = [*LEFT_OUT, *(o.removeprefix("./") for o in out)] if exclude is None else list(exclude)
    extensions = TYPED + (UNTYPED if options.get("allowJs") or options.get("checkJs") else ())
    return Project(_regex(include), _regex(exclude), files, extensions)
