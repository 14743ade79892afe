"""TypeScript and JavaScript files by a tokenizer: imports, definitions, calls, names.

There is no compiler here: names are found by their tokens and braces. Of types only what is
written is known: the annotation of a variable, parameter or class field, or the class that it
is a new instance of. A method called on such a name is a call of that type's method; other
callees are named as they are written.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from .records import Found


class Token(NamedTuple):
    kind: str  # name, string, template, number, regex, op
    text: str
    line: int


_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
#: What its first character tells: spaces, names, numbers, operators that begin nothing else.
_PLAIN = re.compile(rf"[ \t\r\f\v]+|({_NAME.pattern})|(\d[\w.]*)|(=>|\?\.|\.\.\.|[{{}}()\[\];,>+\-*%&|^!~?:=.@#])")
_PLAIN_KINDS = (None, "name", "number", "op")
#: Words after which a slash begins a regular expression, and words that are no callees.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do instanceof yield await".split())
_NOT_CALLED = frozenset("if for while switch catch function return typeof await super import constructor with in of void delete async".split())


def _template_end(text: str, at: int) -> int:
    """After the closing backtick of a template that begins at ``at``; braces nest."""
    i, depth = at + 1, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if depth == 0 and c == "`":
            return i + 1
        if text.startswith("${", i):
            depth += 1
            i += 2
            continue
        if depth and c == "`":
            i = _template_end(text, i)
            continue
        if depth and c == "{":
            depth += 1
        elif depth and c == "}":
            depth -= 1
        i += 1
    return i


_TAG = re.compile(r"[A-Za-z_$][\w$.:-]*")
#: What stands before an element, where a comparison can't.
_BEFORE_ELEMENT = frozenset(("(", "=", "=>", "?", ":", ",", "{", "[", "&", "|", ";", "}"))


def _element_may_start(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    return last.text in _BEFORE_REGEX if last.kind == "name" else last.kind == "op" and last.text in _BEFORE_ELEMENT


def _brace_end(text: str, at: int) -> int:
    """After the brace that closes the one at ``at``, or -1; strings and templates are skipped."""
    depth, i = 0, at
    while i < len(text):
        c = text[i]
        if c == "`":
            i = _template_end(text, i)
            continue
        if c in "\"'":
            end = i + 1
            while end < len(text) and text[end] not in (c, "\n"):
                end += 2 if text[end] == "\\" else 1
            # A lone apostrophe in an element's text closes nowhere on its line.
            i = end + 1 if end < len(text) and text[end] == c else i + 1
            continue
        depth += (c == "{") - (c == "}")
        i += 1
        if not depth:
            return i
    return -1


def _element(text: str, at: int) -> tuple[int, list[tuple[int, int]]] | None:
    """The end of the JSX element at ``at``, and where its code is: names of components and
    what stands in braces. None if there is no whole element, as with type parameters."""
    code: list[tuple[int, int]] = []
    opened: list[str] = []
    i = at
    while i < len(text):
        if text.startswith("</", i):
            m = _TAG.match(text, i + 2)
            name = m[0] if m else ""
            i = text.find(">", i)
            if i < 0 or not opened or opened.pop() != name:
                return None
            i += 1
        elif text[i] == "<":
            m = _TAG.match(text, i + 1)
            name, i = (m[0], m.end()) if m else ("", i + 1)
            if m and (name[0].isupper() or "." in name):
                code.append((m.start(), m.end()))
            # Attributes, up to the tag's end.
            while i < len(text) and text[i] != ">" and not text.startswith("/>", i):
                if text[i] == "{":
                    end = _brace_end(text, i)
                    if end < 0:
                        return None
                    code.append((i + 1, end - 1))
                    i = end
                elif text[i] in "\"'":
                    i = text.find(text[i], i + 1) + 1
                    if not i:
                        return None
                elif text[i].isspace() or text[i] == "=" or _TAG.match(text, i):
                    m = _TAG.match(text, i)
                    i = m.end() if m else i + 1
                else:
                    return None
            if i >= len(text):
                return None
            if text[i] == ">":
                opened.append(name)
                i += 1
            else:
                i += 2
        elif text[i] == "{":
            end = _brace_end(text, i)
            if end < 0:
                return None
            code.append((i + 1, end - 1))
            i = end
        else:
            i += 1
        if not opened:
            return i, code
    return None


def _inserted(text: str, at: int, end: int) -> list[tuple[int, int]]:
    """Where the expressions of a template begin and end; nested templates are part of theirs."""
    out, i = [], at + 1
    while i < end - 1:
        if text[i] == "\\":
            i += 2
        elif text.startswith("${", i):
            start, depth, i = i + 2, 1, i + 2
            while i < end - 1 and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            out.append((start, i - 1 if not depth else i))
        else:
            i += 1
    return out


def tokens(text: str, line: int = 1) -> list[Token]:
    out: list[Token] = []
    i, n = 0, len(text)
    while i < n:
        if (m := _PLAIN.match(text, i)) and not (i == 0 and text.startswith("#!")):
            if m.lastindex:
                out.append(Token(_PLAIN_KINDS[m.lastindex], m[0], line))
            i = m.end()
            continue
        c = text[i]
        if c == "\n":
            line += 1
            i += 1
        elif text.startswith("//", i) or m:
            end = text.find("\n", i)
            i = n if end < 0 else end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            line += text.count("\n", i, end)
            i = end
        elif c in "\"'":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            out.append(Token("string", text[i + 1 : j], line))
            i = min(n, j + 1)
        elif c == "`":
            end = _template_end(text, i)
            out.append(Token("template", text[i + 1 : end - 1], line))
            # What is inserted is code, in brackets of its own.
            for a, b in _inserted(text, i, end):
                at = line + text.count("\n", i, a)
                out += [Token("op", "[", at), *tokens(text[a:b], at), Token("op", "]", line + text.count("\n", i, b))]
            line += text.count("\n", i, end)
            i = end
        elif c == "<" and (text[i + 1 : i + 2].isalpha() or text[i + 1 : i + 2] == ">") and _element_may_start(out) and (found := _element(text, i)):
            # Text between tags is no code; names of components and what stands in braces are.
            for a, b in found[1]:
                at = line + text.count("\n", i, a)
                out += [Token("op", "[", at), *tokens(text[a:b], at), Token("op", "]", line + text.count("\n", i, b))]
            out.append(Token("template", "", line))
            line += text.count("\n", i, found[0])
            i = found[0]
        elif c == "/" and _regex_may_start(out):
            j, in_class = i + 1, False
            while j < n and text[j] != "\n" and (in_class or text[j] != "/"):
                if text[j] == "\\":
                    j += 1
                elif text[j] == "[":
                    in_class = True
                elif text[j] == "]":
                    in_class = False
                j += 1
            if j < n and text[j] == "/":
                m = _NAME.match(text, j + 1)
                out.append(Token("regex", text[i : j + 1], line))
                i = m.end() if m else j + 1
            else:
                out.append(Token("op", c, line))
                i += 1
        else:
            if c in "</":
                out.append(Token("op", c, line))
            i += 1
    return out


def _regex_may_start(before: list[Token]) -> bool:
    if not before:
        return True
    last = before[-1]
    if last.kind == "name":
        return last.text in _BEFORE_REGEX
    return last.kind == "op" and last.text not in (")", "]", "}")


def _closings(toks: list[Token]) -> dict[int, int]:
    """Place of each opening bracket's partner."""
    open_at: list[int] = []
    out: dict[int, int] = {}
    pairs = {")": "(", "]": "[", "}": "{"}
    for i, t in enumerate(toks):
        if t.kind != "op":
            continue
        if t.text in "([{":
            open_at.append(i)
        elif t.text in pairs:
            while open_at and toks[open_at[-1]].text != pairs[t.text]:
                open_at.pop()
            if open_at:
                out[open_at.pop()] = i
    return out


class _File:
    def __init__(self, text: str) -> None:
        self.toks = tokens(text)
        self.ops = [t.text if t.kind == "op" else None for t in self.toks]
        self.close = _closings(self.toks)
        self.found: list[Found] = []

    def at(self, i: int) -> Token:
        return self.toks[i] if 0 <= i < len(self.toks) else Token("op", "", self.toks[-1].line if self.toks else 1)

    def is_op(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.ops) and self.ops[i] == text

    def body_end(self, i: int) -> int:
        """Place of the end of what starts at i: the partner of its first brace at this level,
        or the statement's end."""
        j = i
        while j < len(self.toks):
            t = self.toks[j]
            if t.kind == "op":
                if t.text == "{":
                    return self.close.get(j, len(self.toks) - 1)
                if t.text in "([":
                    j = self.close.get(j, j)
                elif t.text == ";":
                    return j
            j += 1
        return len(self.toks) - 1

    def statement_end(self, i: int) -> int:
        """End of a variable or type statement: its semicolon, or the last token of the line
        on which it is complete."""
        j = i
        while j < len(self.toks):
            t = self.toks[j]
            if t.kind == "op" and t.text in ("(", "[", "{"):
                j = self.close.get(j, j)
            elif t.kind == "op" and t.text == ";":
                return j
            elif t.kind == "op" and t.text in (")", "]", "}"):
                return j - 1
            follower = self.at(j + 1)
            here = self.at(j)
            if j + 1 < len(self.toks) and follower.line > here.line and here.text not in ("=", "=>", ",", "|", "&", "?", ":", "+", "-", "*", "/", ".") \
                    and not (follower.kind == "op" and follower.text in (".", "?.", "|", "&", "?", ":", "=", "=>", "+", "-", "*", "/", "{", "(", "[")):
                return j
            j += 1
        return len(self.toks) - 1

    def imports(self) -> None:
        depth = 0
        for i, t in enumerate(self.toks):
            if t.kind == "op":
                depth += (t.text in "([{" and len(t.text) == 1) - (t.text in ")]}" and len(t.text) == 1)
                continue
            if t.kind != "name" or (i and self.is_op(i - 1, ".")):
                continue
            if t.text == "import" and self.is_op(i + 1, "("):
                if self.at(i + 2).kind == "string" and self.at(i + 3).text in (")", ","):
                    self.found.append(Found("import", self.at(i + 2).text, start_line=t.line, is_dynamic=True))
            elif t.text == "import" and depth == 0 and self.at(i + 1).kind == "string":
                self.found.append(Found("import", self.at(i + 1).text, start_line=t.line))
            elif t.text in ("import", "export") and depth == 0:
                j = i + 1
                # The next statement of the kind ends this one, where no semicolon does.
                while j < len(self.toks) and not self.is_op(j, ";"):
                    if self.at(j).kind == "name" and self.at(j).text in ("import", "export"):
                        break
                    if self.is_op(j, "{"):
                        j = self.close.get(j, j)
                    elif self.at(j).kind == "name" and self.at(j).text == "from" and self.at(j + 1).kind == "string":
                        self.found.append(Found("import", self.at(j + 1).text, start_line=t.line))
                        break
                    elif self.is_op(j, "=") or self.is_op(j, "(") or self.at(j).text in ("function", "class", "const", "let", "var", "interface", "enum"):
                        break
                    j += 1

    def definitions(self) -> list[tuple[int, int, str, str | None]]:
        """Emits definitions; returns (first token, last token, symbol, class) of what calls can
        stand in."""
        scopes: list[tuple[int, int, str, str | None]] = []
        for i, t in enumerate(self.toks):
            if t.kind != "name" or (i and self.is_op(i - 1, ".")):
                continue
            first = i
            while self.at(first - 1).kind == "name" and self.at(first - 1).text in ("export", "default", "async", "abstract", "declare", "public"):
                first -= 1
            start = self.at(first).line
            if t.text in ("function", "class", "interface"):
                at = i + 2 if self.is_op(i + 1, "*") else i + 1
                if self.at(at).kind != "name":
                    continue
                name, end = self.at(at).text, self.body_end(at)
                self.found.append(Found("definition", name, t.text, start, self.at(end).line))
                if t.text == "function":
                    scopes.append((i, end, name, None))
                elif t.text == "class":
                    scopes += self._methods(at, end, name)
            elif t.text == "type" and self.at(i + 1).kind == "name" and (self.is_op(i + 2, "=") or self.is_op(i + 2, "<")):
                self.found.append(Found("definition", self.at(i + 1).text, "type", start, self.at(self.statement_end(i + 2)).line))
            elif t.text in ("const", "let", "var") and self.at(i + 1).kind == "name":
                end = self.statement_end(i + 1)
                name = self.at(i + 1).text
                self.found.append(Found("definition", name, "variable", start, self.at(end).line))
                j = i + 2
                while j < end and not self.is_op(j, "="):
                    j = self.close.get(j, j) + 1
                if self.is_op(j, "=") and self._is_function(j + 1, end):
                    scopes.append((i, end, name, None))
        return scopes

    def _is_function(self, j: int, end: int) -> bool:
        """Whether the value at j is a function or an arrow function."""
        if self.at(j).text == "async":
            j += 1
        if self.at(j).text == "function":
            return True
        if self.at(j).kind == "name":
            return self.is_op(j + 1, "=>")
        if not self.is_op(j, "("):
            return False
        # Past the parameters, and a return type if there is one.
        j = self.close.get(j, end) + 1
        while self.is_op(j, ":") or (self.at(j).kind in ("name", "string") and j < end) or self.at(j).text in ("<", ">", "[", "]", "|", "."):
            j += 1
        return self.is_op(j, "=>")

    def _methods(self, at: int, end: int, name: str) -> list[tuple[int, int, str, str | None]]:
        j, out = at, []
        while j < end and not self.is_op(j, "{"):
            j += 1
        j += 1
        while j < end:
            t = self.at(j)
            if t.kind == "name" and (self.is_op(j + 1, "(") or (self.is_op(j + 1, "<"))) and t.text not in _NOT_CALLED - {"constructor"}:
                k = j + 1
                while k < end and not self.is_op(k, "("):
                    k += 1
                k = self.close.get(k, k) + 1
                while k < end and not self.is_op(k, "{") and not self.is_op(k, ";"):
                    k += 1
                if self.is_op(k, "{"):
                    stop = self.close.get(k, end)
                    out.append((j, stop, f"{name}.{t.text}", name))
                    j = stop + 1
                    continue
                j = k + 1
                continue
            if self.is_op(j, "{") or self.is_op(j, "(") or self.is_op(j, "["):
                j = self.close.get(j, j)
            j += 1
        return out

    def _type_at(self, j: int) -> str | None:
        """The type that is written from j on, if it is one name."""
        t = self.at(j)
        ends = self.at(j + 1).kind != "op" or self.at(j + 1).text in (",", ")", "=", ";", "{", "}") or self.at(j + 1).line > t.line
        return t.text if t.kind == "name" and t.text[:1].isupper() and ends else None

    def _instance_at(self, j: int) -> str | None:
        """The class of which a new instance begins at j."""
        t = self.at(j + 1)
        return t.text if self.at(j).kind == "name" and self.at(j).text == "new" and t.kind == "name" and not self.is_op(j + 2, ".") else None

    def types(self, scopes: list[tuple[int, int, str, str | None]]) -> tuple[list[tuple[int, int, str, str]], dict[tuple[str, str], str]]:
        """Types of variables and parameters as (first token, last token, name, type) of where
        they hold, and types of class fields by (class, field)."""
        names: list[tuple[int, int, str, str]] = []
        fields: dict[tuple[str, str], str] = {}
        whole = (-1, len(self.toks), "", None)

        def home(i: int) -> tuple:
            return max((s for s in scopes if s[0] < i < s[1]), key=lambda s: s[0], default=whole)

        for i, t in enumerate(self.toks):
            if t.kind == "name" and t.text in ("const", "let", "var") and self.at(i + 1).kind == "name":
                kind = self._type_at(i + 3) if self.is_op(i + 2, ":") else self._instance_at(i + 3) if self.is_op(i + 2, "=") else None
                if kind:
                    names.append((*home(i)[:2], self.at(i + 1).text, kind))
            elif t.kind == "name" and t.text == "class" and self.at(i + 1).kind == "name":
                self._fields(i + 1, fields)
        for first, last, symbol, owner in scopes:
            j = first
            while j < last and not self.is_op(j, "(") and not self.is_op(j, "{"):
                j += 1
            if not self.is_op(j, "("):
                continue
            for k in range(j + 1, self.close.get(j, j)):
                at = k + 2 if self.is_op(k + 1, "?") else k + 1
                if self.at(k).kind == "name" and self.is_op(at, ":") and (kind := self._type_at(at + 1)):
                    names.append((first, last, self.at(k).text, kind))
                    # A parameter with a modifier is a field too.
                    if owner and symbol.endswith(".constructor") and self.at(k - 1).text in ("private", "public", "protected", "readonly"):
                        fields[owner, self.at(k).text] = kind
        return names, fields

    def _fields(self, at: int, fields: dict[tuple[str, str], str]) -> None:
        name, end, j = self.at(at).text, self.body_end(at), at
        while j < end and not self.is_op(j, "{"):
            j += 1
        j += 1
        while j < end:
            if self.at(j).kind == "name":
                k = j + 2 if self.is_op(j + 1, "?") or self.is_op(j + 1, "!") else j + 1
                kind = self._type_at(k + 1) if self.is_op(k, ":") else self._instance_at(k + 1) if self.is_op(k, "=") else None
                if kind:
                    fields[name, self.at(j).text] = kind
            j = self.close.get(j, j) + 1

    def calls(self, scopes: list[tuple[int, int, str, str | None]]) -> None:
        starts = {s[0] for s in scopes}
        names, fields = self.types(scopes)

        def type_of(name: str, i: int) -> str | None:
            holding = [x for x in names if x[2] == name and x[0] < i < x[1]]
            return max(holding, key=lambda x: x[0])[3] if holding else None

        for i, op in enumerate(self.ops):
            if op != "(":
                continue
            j = i - 1
            if self.is_op(j, ">"):
                depth = 0
                while j >= 0:
                    depth += self.is_op(j, ">") - self.is_op(j, "<")
                    if depth == 0:
                        break
                    if not (self.at(j).kind in ("name", "string") or self.at(j).text in "<>,.[]|&"):
                        j = -1
                        break
                    j -= 1
                j -= 1
            end = self.close.get(i, i)
            within = [s for s in scopes if s[0] < i < s[1]]
            owner = max(within, key=lambda s: s[0], default=(0, 0, None, None))
            made = dict(start_line=self.at(j).line, end_line=self.at(end).line, owner=owner[2], status=owner[3])
            if self.is_op(j, "]"):
                self.found.append(Found("call", "[dynamic]", "element", **made))
                continue
            callee = self.at(j)
            if callee.kind != "name" or callee.text in _NOT_CALLED or j in starts or self.at(j - 1).text in ("function", "class", "interface"):
                continue
            chain = []
            while self.at(j).kind == "name" and (self.is_op(j - 1, ".") or self.is_op(j - 1, "?.")):
                chain.append(self.at(j).text)
                j -= 2
            if chain:
                root = self.at(j).text if self.at(j).kind == "name" else "[expr]"
                made["start_line"] = self.at(j).line
                receiver = ".".join([root, *chain[:0:-1]])
                if len(chain) == 1 and root not in ("this", "[expr]"):
                    receiver = type_of(root, i) or receiver
                elif len(chain) == 2 and root == "this" and owner[3]:
                    receiver = fields.get((owner[3], chain[1])) or receiver
                self.found.append(Found("call", callee.text, "property", receiver=receiver, **made))
            else:
                self.found.append(Found("call", callee.text, "identifier", **made))


def parse(text: str, kinds: frozenset[str] | None = None) -> list[Found]:
    """What the text holds, in order; with ``kinds`` what isn't wanted and follows may be left out."""
    file = _File(text)
    if not file.toks:
        return [Found("status", "parsed", status="parsed")]
    file.imports()
    if kinds is None or kinds & {"definition", "call", "identifier", "status"}:
        scopes = file.definitions()
        if kinds is None or kinds & {"call", "identifier", "status"}:
            file.calls(scopes)
    found = dict.fromkeys(file.found)
    if kinds is None or kinds & {"identifier", "status"}:
        found.update(dict.fromkeys(Found("identifier", t.text, start_line=t.line) for t in file.toks if t.kind == "name"))
    return [*found, Found("status", "parsed", status="parsed")]
