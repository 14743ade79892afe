"""Languages as plug-ins: the extensions of their files and the parser of one file's text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from . import python_ast, ts_tokens
from .records import Found


@dataclass(frozen=True)
class Adapter:
    lang: str
    extensions: tuple[str, ...]
    parse: Callable[..., list[Found]]
    #: Whether ``parse`` can be told the kinds of records that are wanted, and spare work for others.
    by_kind: bool = False


_REGISTERED: dict[str, Adapter] = {}


def register(adapter: Adapter) -> None:
    """Add a language, or take the place of one. Its files are scanned and parsed from then on."""
    _REGISTERED[adapter.lang] = adapter


def unregister(lang: str) -> None:
    _REGISTERED.pop(lang, None)


def parsers(kinds: frozenset[str] | None = None) -> dict[str, Callable[[str], list[Found]]]:
    return {a.lang: partial(a.parse, kinds=kinds) if a.by_kind else a.parse for a in _REGISTERED.values()}


def languages() -> dict[str, str]:
    """Language by file extension."""
    return {e: a.lang for a in _REGISTERED.values() for e in a.extensions}


register(Adapter("ts", (".ts", ".tsx", ".js", ".jsx"), ts_tokens.parse, by_kind=True))
register(Adapter("py", (".py",), python_ast.parse))
