"""Python files by the standard library's parser; files that don't parse fall back on tokens."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings

from .records import Found

#: Functions that import by name.
IMPORTERS = ("importlib.import_module", "import_module", "__import__")


def dotted(node: ast.expr) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value)}.{node.attr}"
    return "[expr]"


class _Visitor(ast.NodeVisitor):
    def __init__(self) -> None:
        self.found: list[Found] = []
        self.classes: list[ast.ClassDef] = []
        self.functions: list[ast.AST] = []

    @staticmethod
    def _start(node: ast.AST) -> int:
        return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])

    def _define(self, node: ast.AST, kind: str) -> None:
        # Definitions inside functions aren't visible from elsewhere.
        if self.functions:
            return
        owner = self.classes[-1] if self.classes else None
        place = (owner.name, self._start(owner), owner.end_lineno) if owner else (None, None, None)
        if kind == "function" and owner:
            kind = "method"
        self.found.append(Found("definition", node.name, kind, self._start(node), node.end_lineno or node.lineno, *place))

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:  # noqa: N802
        self._define(node, "function")
        self.found.append(Found("identifier", node.name, start_line=node.lineno))
        for d in node.decorator_list:
            self.visit(d)
        self.functions.append(node)
        for child in [node.args, *([node.returns] if node.returns else []), *node.body]:
            self.visit(child)
        self.functions.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node: ast.ClassDef) -> None:  # noqa: N802
        self._define(node, "class")
        self.found.append(Found("identifier", node.name, start_line=node.lineno))
        for child in [*node.decorator_list, *node.bases, *node.keywords]:
            self.visit(child)
        self.classes.append(node)
        for child in node.body:
            self.visit(child)
        self.classes.pop()

    def visit_Import(self, node: ast.Import) -> None:  # noqa: N802
        for alias in node.names:
            self.found.append(Found("import", alias.name, start_line=node.lineno))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:  # noqa: N802
        for alias in node.names:
            self.found.append(Found("import", node.module or "", start_line=node.lineno, receiver=alias.name, level=node.level))
            self.found.append(Found("identifier", alias.name, start_line=node.lineno))

    def visit_Name(self, node: ast.Name) -> None:  # noqa: N802
        self.found.append(Found("identifier", node.id, start_line=node.lineno))

    def visit_Attribute(self, node: ast.Attribute) -> None:  # noqa: N802
        self.found.append(Found("identifier", node.attr, start_line=node.end_lineno or node.lineno))
        self.visit(node.value)

    def _caller(self) -> str | None:
        if not self.functions:
            return None
        name = self.functions[-1].name
        return f"{self.classes[-1].name}.{name}" if self.classes else name

    def visit_Call(self, node: ast.Call) -> None:  # noqa: N802
        f = node.func
        if dotted(f) in IMPORTERS and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            self.found.append(Found("import", node.args[0].value, start_line=node.lineno, is_dynamic=True))
        shape, name, receiver = None, "", None
        if isinstance(f, ast.Name):
            shape, name = "identifier", f.id
        elif isinstance(f, ast.Attribute):
            v = f.value
            if isinstance(v, ast.Name):
                shape, name, receiver = "attribute", f.attr, v.id
            elif isinstance(v, ast.Call):
                shape, name, receiver = "on-call", f.attr, "[call]"
            elif isinstance(v, ast.Attribute):
                shape, name, receiver = "chain", f.attr, dotted(v)
            else:
                shape, name, receiver = "on-expression", f.attr, "[expr]"
        elif isinstance(f, ast.Subscript):
            shape, name = "subscript", "[subscript]"
        if shape:
            owner = self._caller()
            self.found.append(
                Found("call", name, shape, node.lineno, node.end_lineno or node.lineno, owner, receiver=receiver,
                      status=self.classes[-1].name if self.classes else None)
            )
        self.generic_visit(node)


_IMPORT = re.compile(r"^\s*import\s+([\w.]+)|^\s*from\s+(\.*)([\w.]*)\s+import\s+(\w+)")
_DEFINITION = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)")


def _by_tokens(text: str) -> list[Found]:
    """What can be told from a file with errors: line by line, and names up to the error."""
    found: list[Found] = []
    for n, line in enumerate(text.split("\n"), 1):
        if m := _IMPORT.match(line):
            found.append(Found("import", m[1] or m[3] or "", start_line=n, receiver=m[4], level=len(m[2] or "")))
        elif (m := _DEFINITION.match(line)) and not m[1]:
            found.append(Found("definition", m[3], "class" if m[2] == "class" else "function", n, n))
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type == tokenize.NAME:
                found.append(Found("identifier", t.string, start_line=t.start[0]))
    except (tokenize.TokenError, SyntaxError):
        pass
    return found


def parse(text: str) -> list[Found]:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
        visitor = _Visitor()
        visitor.visit(tree)
        found, status = visitor.found, "parsed"
    except (SyntaxError, ValueError, RecursionError):
        found, status = _by_tokens(text), "errors"
    return [*dict.fromkeys(found), Found("status", status, status=status)]
