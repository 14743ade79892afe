"""Gitignore rules compiled to regular expressions; the last rule that matches decides."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

#: Never part of the sources, and the tool's own ignore file.
ALWAYS = ["node_modules/"]
IGNORE_FILES = (".gitignore", ".codequarryignore")


def glob_pattern(pattern: str) -> str:
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out += "(?:.*/)?"
            i += 3
            continue
        if pattern.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += re.escape(c)
        i += 1
    return out


@dataclass(frozen=True)
class Rule:
    pattern: str
    negated: bool
    directories: bool

    @staticmethod
    def parse(line: str) -> Rule | None:
        text = line.rstrip("\r\n")
        if not text.endswith("\\ "):
            text = text.rstrip(" ")
        if not text or text.startswith("#"):
            return None
        negated = text.startswith("!")
        text = text[1:] if negated else text.removeprefix("\\") if text[:2] in ("\\!", "\\#") else text
        directories = text.endswith("/")
        body = text.rstrip("/")
        anchored = "/" in body
        body = body.lstrip("/")
        if not body:
            return None
        return Rule(("" if anchored else "(?:.*/)?") + glob_pattern(body), negated, directories)


class IgnoreMatcher:
    """``ignores(path)`` for paths relative to the root; a directory ends with a slash. What
    lies in an ignored directory is ignored, whatever later rules say."""

    def __init__(self, lines: list[str]) -> None:
        self.rules = [(re.compile(r.pattern + r"\Z"), r) for line in lines if (r := Rule.parse(line))]

    def _decide(self, path: str, directory: bool) -> bool:
        out = False
        for compiled, rule in self.rules:
            if (directory or not rule.directories) and compiled.match(path):
                out = not rule.negated
        return out

    def ignores(self, path: str) -> bool:
        directory = path.endswith("/")
        path = path.strip("/")
        if not path or path.startswith("../"):
            return False
        parts = path.split("/")
        above = ("/".join(parts[:k]) for k in range(1, len(parts)))
        return any(self._decide(p, True) for p in above) or self._decide(path, directory)


def load_rules(repo_root: str, ws_root: str | None = None, extra: list[str] | None = None) -> list[str]:
    """Rules of the configuration, then of the repository's and the workspace's ignore files."""
    lines = [*ALWAYS, *(extra or [])]
    for root in dict.fromkeys([repo_root, ws_root or repo_root]):
        for name in IGNORE_FILES:
            file = Path(root, name)
            if file.is_file():
                lines += file.read_text("utf-8", "replace").splitlines()
    return lines
