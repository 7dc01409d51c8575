"""Method declarations in one Java source text.

Comments and literals are blanked out in a copy of equal length. One pass over the
brackets of that copy keeps a stack of open scopes; whatever lies between two
delimiters of a class body is matched as a method header. Linear, no recursion.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

# Modifier keywords and the kinds of primitive return types.
_MODIFIERS = (
    "public protected private abstract static final strictfp default synchronized "
    "native transient volatile sealed non-sealed"
).split()
_PRIMITIVES = {
    "boolean": "boolean_type",
    "float": "floating_point_type",
    "double": "floating_point_type",
    "byte": "integral_type",
    "short": "integral_type",
    "int": "integral_type",
    "long": "integral_type",
    "char": "integral_type",
    "void": "void_type",
}
# Keywords that may start a statement but never a type.
_NO_TYPE = frozenset(
    "assert break case catch class continue do else enum extends finally for goto if "
    "implements import instanceof interface new package return super switch this throw "
    "throws try while".split()
)

_HIDDEN = re.compile(
    r'//[^\n]*|/\*.*?(?:\*/|\Z)|"""(?:\\.|[^\\])*?(?:"""|\Z)'
    r'|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?',
    re.S,
)
_BRACKET = re.compile(r"[{}();]|(?<![\w$])new(?![\w$])")
_CREATED = re.compile(r"\s*(?:@[\w$.]+\s*)*[\w$]+(?:\s*\.\s*[\w$]+)*\s*")
_KEYWORD = re.compile(r"\s*((?:%s)(?![\w$-]))" % "|".join(_MODIFIERS))
_ANNOTATION = re.compile(r"\s*(@(?!\s*interface\b)\s*[\w$]+(?:\s*\.\s*[\w$]+)*)(\s*\()?")
_TYPE_DECL = re.compile(
    r"(?<![\w$.])(@\s*)?(class|interface|enum|record(?=\s+[\w$]+\s*[<(]))\s+[\w$]+"
)
_WORD = re.compile(r"\s*([\w$]+)")
_SPACE = re.compile(r"\s*")
_DIMS = re.compile(r"\s*\[\s*\]")
_AFTER_PARAMS = re.compile(r"\s*(?:\[\s*\]\s*)*(?:throws\b[^={}]*)?")


def _blank(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Text with comments and literals blanked, and where the comments are."""
    pieces, comments, last = [], [], 0
    for m in _HIDDEN.finditer(text):
        start, end = m.span()
        pieces.append(text[last:start])
        pieces.append(" " * (end - start))
        last = end
        if text[start] == "/":
            comments.append((start, end))
    pieces.append(text[last:])
    # a byte order mark is white space
    return "".join(pieces).replace("\ufeff", " "), comments


class _Source:
    def __init__(self, text: str):
        self.text = text
        self.code, self.comments = _blank(text)
        self.closing: dict[int, int] = {}  # open parenthesis -> its close

    def space(self, at: int) -> int:
        return _SPACE.match(self.code, at).end()

    def angles(self, at: int) -> int:
        """Position after the type arguments that open at ``at``; -1 if unbalanced."""
        depth = 0
        for i in range(at, len(self.code)):
            c = self.code[i]
            if c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if depth == 0:
                    return i + 1
            elif c in "{};":
                return -1
        return -1

    def modifiers(self, at: int) -> tuple[list[tuple[int, int]], int]:
        """Spans of the annotations and keywords from ``at`` on, and where they end."""
        spans = []
        while True:
            m = _KEYWORD.match(self.code, at)
            if m:
                spans.append(m.span(1))
                at = m.end()
                continue
            m = _ANNOTATION.match(self.code, at)
            if not m:
                return spans, at
            end = m.end(1)
            if m.group(2):
                close = self.closing.get(m.end() - 1)
                if close is None:
                    return spans, at
                end = close + 1
            spans.append((m.start(1), end))
            at = end

    def modifier_texts(self, spans: list[tuple[int, int]]) -> list[str]:
        """Modifier texts in order; a comment between two of them counts as one."""
        if len(spans) > 1 and self.comments:
            between = []
            i = bisect_left(self.comments, (spans[0][1], 0))
            while i < len(self.comments) and self.comments[i][1] <= spans[-1][0]:
                start, end = self.comments[i]
                if not any(s <= start < e for s, e in spans):
                    between.append((start, end))
                i += 1
            spans = sorted(spans + between)
        return [self.text[s:e] for s, e in spans]

    def type_at(self, at: int):
        """``(kind, start, end)`` of the type at ``at``; kind is None for arrays."""
        m = _WORD.match(self.code, at)
        if not m or m.group(1) in _NO_TYPE:
            return None
        start, end = m.span(1)
        kind = _PRIMITIVES.get(m.group(1), "type_identifier")
        while True:
            p = self.space(end)
            c = self.code[p : p + 1]
            if c == "<":
                end, kind = self.angles(p), "generic_type"
                if end < 0:
                    return None
            elif c == ".":
                _, q = self.modifiers(p + 1)
                m = _WORD.match(self.code, q)
                if not m:
                    return None
                end, kind = m.end(1), "scoped_type_identifier"
            elif c in "[@":
                _, q = self.modifiers(p)
                m = _DIMS.match(self.code, q)
                if not m:
                    return (kind, start, end)
                end, kind = m.end(), None
            else:
                return (kind, start, end)

    def declares_type(self, start: int, stop: int) -> str | None:
        """Scope a ``{`` at ``stop`` opens if a type declaration leads up to it."""
        m = _TYPE_DECL.search(self.code, start, stop)
        if not m:
            return None
        return "note" if m.group(1) else "enum" if m.group(2) == "enum" else "type"

    def method(self, start: int, stop: int) -> dict | None:
        """Fields of the method whose header is exactly ``start..stop``."""
        spans, at = self.modifiers(start)
        p = self.space(at)
        if self.code[p : p + 1] == "<":
            at = self.angles(p)
            if at < 0:
                return None
            _, at = self.modifiers(at)
        found = self.type_at(at)
        if not found:
            return None
        kind, type_start, type_end = found
        name = _WORD.match(self.code, type_end)
        if not name or name.group(1)[0].isdigit():
            return None
        opening = self.space(name.end())
        close = self.closing.get(opening)
        if close is None or close >= stop:
            return None
        if not _AFTER_PARAMS.fullmatch(self.code, close + 1, stop):
            return None
        fields = {
            "identifier": name.group(1),
            "formal_parameters": self.text[opening : close + 1],
            "modifiers": self.modifier_texts(spans),
            "block": None,
        }
        if kind:
            fields[kind] = self.text[type_start:type_end]
        return fields


class _Scope:
    __slots__ = ("kind", "open", "start", "method")

    def __init__(self, kind: str, open_at: int, method: dict | None = None):
        self.kind = kind  # type, enum (its constants), note (@interface), code, paren
        self.open = open_at
        self.start = open_at + 1  # where the current member or statement begins
        self.method = method


# closed parentheses of ended members that are held at most, about
_CLOSED = 10_000


def scan_methods(text: str) -> list[dict]:
    """Method declarations in order of their start, outer before nested."""
    return list(each_method(text))


def each_method(text: str) -> Iterator[dict]:
    """The same one after the other: those of a member come once it ends and are not kept."""
    source = _Source(text)
    code, closing = source.code, source.closing
    stack = [_Scope("type", -1)]
    created: set[int] = set()  # parentheses that follow "new Type"
    last_pair = (-1, -1)  # latest closed parenthesis: where it opened, where it closed
    methods: list[dict] = []
    inside = 0  # open scopes that a member encloses: bodies and parentheses
    token = ""
    for m in _BRACKET.finditer(code):
        if token in (";", "}") and not inside:  # a member has ended, no header reaches back
            yield from methods
            methods.clear()
            if len(closing) > _CLOSED:
                closing.clear()
                created = {p for p in created if p >= m.start()}
        at, token = m.start(), m.group()
        top = stack[-1]
        if token == "(":
            inside += 1
            stack.append(_Scope("paren", at))
        elif token == ")":
            if top.kind == "paren":
                inside -= 1
                stack.pop()
                closing[top.open] = at
                last_pair = (top.open, at)
        elif token == ";":
            if top.kind == "paren":
                continue
            if top.kind == "type":
                found = source.method(top.start, at)
                if found:
                    methods.append(found)
            elif top.kind == "enum":
                top.kind = "type"
            top.start = at + 1
        elif token == "{":
            opened, close = last_pair
            if opened in created and source.space(close + 1) == at:
                stack.append(_Scope("type", at))
                continue
            if top.kind == "enum":
                stack.append(_Scope("type", at))
                continue
            kind = None if top.kind == "paren" else source.declares_type(top.start, at)
            found = None
            if kind is None and top.kind == "type":
                found = source.method(top.start, at)
                if found:
                    methods.append(found)
            inside += kind is None
            stack.append(_Scope(kind or "code", at, found))
        elif token == "}":
            while len(stack) > 1:
                scope = stack.pop()
                inside -= scope.kind in ("paren", "code")
                if scope.kind != "paren":
                    if scope.method is not None:
                        scope.method["block"] = text[scope.open : at + 1]
                    break
            if stack[-1].kind != "paren":
                stack[-1].start = at + 1
        else:  # new
            created_at = _created_parenthesis(source, m.end())
            if created_at is not None:
                created.add(created_at)
    for scope in stack:  # bodies the text leaves open
        if scope.method is not None:
            scope.method["block"] = text[scope.open :].rstrip()
    yield from methods


def _created_parenthesis(source: _Source, at: int) -> int | None:
    """The argument parenthesis of the object creation whose ``new`` ends at ``at``."""
    m = _CREATED.match(source.code, at)
    while m:
        p = m.end()
        if source.code[p : p + 1] == "<":
            p = source.angles(p)
            if p < 0:
                return None
            p = source.space(p)
        if source.code[p : p + 1] == ".":
            m = _CREATED.match(source.code, p + 1)
            continue
        return p if source.code[p : p + 1] == "(" else None
    return None
