"""Configuration: defaults, the repository's file, the workspace's file, then flags."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from pathlib import Path

from codequarry.functions.text import REDACTIONS

CONFIG_FILE = ".codequarryrc.json"


class UsageError(Exception):
    """Wrong flags or configuration; exit status 3."""


class AnchorNotFound(Exception):
    """A symbol that isn't defined; exit status 2."""


class AmbiguousSymbol(AnchorNotFound):
    """A symbol with several definitions under strict resolution; exit status 2."""


@dataclass(frozen=True)
class Config:
    budget_chars: int = 28_000
    depth: int = 2
    include_tests: str = "auto"
    ignore: list[str] = field(default_factory=lambda: ["**/dist/**", "**/.next/**", "**/build/**", "**/*.snap"])
    ws_mode: str = "auto"
    import_roots: list[str] = field(default_factory=lambda: ["src", "."])
    redact: bool = False
    redact_patterns: list[str] = field(default_factory=lambda: list(REDACTIONS))

    def updated(self, given: dict) -> Config:
        """With what is given; lists are replaced, not extended."""
        ws, redact = given.get("workspaces") or {}, given.get("redact") or {}
        found = {
            "budget_chars": given.get("budgetChars"), "depth": given.get("depth"), "include_tests": given.get("includeTests"),
            "ignore": given.get("ignore"), "ws_mode": ws.get("mode"), "import_roots": ws.get("pythonImportRoots"),
            "redact": redact.get("enabled"), "redact_patterns": redact.get("patterns"),
        }
        return replace(self, **{k: v for k, v in found.items() if v is not None})


def load_config(repo_root: str, ws_root: str | None = None) -> Config:
    config = Config()
    for root in dict.fromkeys([repo_root, ws_root or repo_root]):
        file = Path(root, CONFIG_FILE)
        if file.is_file():
            try:
                given = json.loads(file.read_text("utf-8"))
            except ValueError as e:
                raise UsageError(f"{file}: {e}") from e
            if not isinstance(given, dict):
                raise UsageError(f"{file}: an object is expected")
            config = config.updated(given)
    return config
