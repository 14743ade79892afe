"""The record that every parser emits, one row for each thing found in a file."""

from __future__ import annotations

from typing import NamedTuple

RECORD = (
    "ws_root string, path string, lang string, seq int, rec string, name string, kind string, start_line int, end_line int, "
    "owner string, owner_start int, owner_end int, receiver string, level int, is_dynamic boolean, status string"
)


class Found(NamedTuple):
    """rec: definition, import, call, identifier or status. For imports ``name`` is the module
    and ``receiver`` the imported name; for calls ``name`` is the callee, ``receiver`` what it
    is called on, ``kind`` the shape of the call and ``owner`` the calling symbol."""

    rec: str
    name: str
    kind: str = ""
    start_line: int = 0
    end_line: int = 0
    owner: str | None = None
    owner_start: int | None = None
    owner_end: int | None = None
    receiver: str | None = None
    level: int = 0
    is_dynamic: bool = False
    status: str | None = None
