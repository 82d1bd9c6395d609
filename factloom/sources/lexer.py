"""Tokens and declarations of TypeScript text: a lexer with bracket matching and a scanner for declarations.

There is no compiler here: type-derived facts are best effort. Only text is read; nothing is resolved. Of syntax errors those are
seen that tokens show: brackets, strings, templates, comments and JSX elements without an end, operators without an operand,
operands side by side, declarations without a name, conditions without parentheses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)|(?P<tick>`)|(?P<op>=>|\.\.\.|\?\.|\?\?=?|&&=?|\|\|=?|[=!]==?|[<>]=|\+\+|--|\*\*|[-+*/%&|^]=|.)""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = frozenset("( , = : [ ! & | ? { } ; => return typeof case in of && || ?? + - * %".split())
_SINGLE = frozenset("()[]{},;:")  # signs that begin no longer one
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class SyntaxFault(ValueError):
    def __init__(self, message: str, line: int, col: int):
        super().__init__(message)
        self.line, self.col = line, col


@dataclass(slots=True)
class Token:
    kind: str  # name, string, template, number, regex, op, jsx
    text: str
    line: int
    col: int
    start: int
    end: int


@dataclass
class Source:
    text: str
    tokens: list[Token] = field(default_factory=list)
    pair: dict[int, int] = field(default_factory=dict)
    comments: list[tuple[int, str]] = field(default_factory=list)

    def slice(self, a: int, b: int) -> str:
        """The text of tokens a to b, exclusive."""
        return self.text[self.tokens[a].start : self.tokens[b - 1].end] if a < b else ""


def _template_end(text: str, at: int) -> int:
    """Where the template literal that begins at ``at`` ends, holes included."""
    i, n = at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif text.startswith("${", i):
            depth, i = 1, i + 2
            while i < n and depth:
                if text[i] == "`":
                    i = _template_end(text, i)
                    continue
                if text[i] in "\"'":
                    m = re.compile(r"""(["'])(?:\\.|(?!\1).)*\1""", re.S).match(text, i)
                    i = m.end() if m else i + 1
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
        else:
            i += 1
    return n


_JSX_TEXT = re.compile(r"[^<{]+")
_JSX_TAG = re.compile(r"<[A-Za-z_$][\w.$:-]*|<(?=\s*>)")
_JSX_END = re.compile(r"</\s*[\w.$:-]*\s*>")
_JSX_ATTRIBUTE = re.compile(r"""\s+|[\w.$:-]+|=|"[^"]*"|'[^']*'|/\*.*?\*/|//[^\n]*""", re.S)
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b|>\s*\([^()]*\)\s*(?:=>|:))")
_CALLED_REGEX = re.compile(_REGEX.pattern + r"\.(?:test|exec)\(")


def lex(text: str, jsx: bool = False) -> Source:
    """Raises ``SyntaxFault`` where tokens show an error. With ``jsx``, markup is read as tokens of kind jsx, its holes as code."""
    source, at, line, begin = Source(text), 0, 1, 0
    stack: list[int] = []
    modes: list[str | int] = []  # open markup: "tag" in a tag, "text" between tags; a hole is the number of brackets around it

    def fault(message: str) -> SyntaxFault:
        return SyntaxFault(message, line, at - begin)

    tokens, match, size = source.tokens, _TOKEN.match, len(text)
    while at < size:
        mode = modes[-1] if modes else None
        kind, hole, m = "", False, None
        if mode is None or mode.__class__ is int:  # code; most of it is words and space, which open and close nothing, and signs of one letter
            c = text[at]
            if c == " " and at + 1 < size:
                at += 1
                c = text[at]
            if c in _SINGLE:
                if c in OPEN:
                    stack.append(len(tokens))
                tokens.append(Token("op", c, line, at - begin, at, at + 1))
                if c in CLOSE:
                    if not stack or OPEN[tokens[stack[-1]].text] != c:
                        raise fault(f"unexpected {c!r}")
                    i, j = len(tokens) - 1, stack.pop()
                    source.pair[i], source.pair[j] = j, i
                    if mode is not None and mode == len(stack):
                        modes.pop()
                at += 1
                continue
            m = match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "name" or kind == "number":
                tokens.append(Token(kind, text[at:end], line, at - begin, at, end))
                at = end
                continue
            if kind == "space":
                if n := text.count("\n", at, end):
                    line, begin = line + n, text.rindex("\n", at, end) + 1
                at = end
                continue
        if mode == "text" and text[at] != "{":
            if m := _JSX_TEXT.match(text, at):
                kind, end = "jsx", m.end()
            elif m := _JSX_END.match(text, at):
                kind, end = "jsx", m.end()
                modes.pop()
            elif m := _JSX_TAG.match(text, at):
                kind, end = "jsx", m.end()
                modes.append("tag")
            else:
                raise fault("an element's text holds a stray '<'")
        elif mode == "tag" and text[at] != "{":
            if text.startswith("/>", at):
                kind, end = "jsx", at + 2
                modes.pop()
            elif text[at] == ">":
                kind, end = "jsx", at + 1
                modes[-1] = "text"
            elif m := _JSX_ATTRIBUTE.match(text, at):
                kind, end = "space" if m[0].isspace() else "jsx", m.end()
            else:
                raise fault(f"unexpected {text[at]!r} in a tag")
        else:
            hole = mode in ("tag", "text")
            if m is None:
                m = match(text, at)
                kind, end = m.lastgroup, m.end()
            sign = text[at:end]
            if sign == "/" or sign == "<":
                last = tokens[-1] if tokens else None
                starts = last is None or last.text in _BEFORE_REGEX or last.text in {"default", "yield"}
            if sign == "/" and ((starts and (r := _REGEX.match(text, at))) or (last is not None and last.text == ")" and _CALLED_REGEX.match(text, at) and (r := _REGEX.match(text, at)))):
                kind, end = "regex", r.end()
            if jsx and sign == "<" and starts and (r := _JSX_TAG.match(text, at)) and not _GENERIC.match(text, at):
                kind, end = "jsx", r.end()
                modes.append("tag")
            if kind == "tick":
                kind, end = "template", _template_end(text, at)
                if end - at < 2 or text[end - 1] != "`":
                    raise fault("a template has no end")
            if kind == "op" and sign in {'"', "'", "\\"}:
                raise fault("a string has no end" if sign != "\\" else "unexpected '\\\\'")
            if kind == "comment" and sign.startswith("/*") and (len(sign) < 4 or not sign.endswith("*/")):
                raise fault("a comment has no end")
        raw = text[at:end]
        if kind == "comment":
            source.comments.append((line, raw))
        elif kind != "space":
            tokens.append(Token(kind, raw, line, at - begin, at, end))
            i = len(tokens) - 1
            if kind == "op" and raw in OPEN:
                if hole:
                    modes.append(len(stack))
                stack.append(i)
            elif kind == "op" and raw in CLOSE:
                if not stack or OPEN[tokens[stack[-1]].text] != raw:
                    raise fault(f"unexpected {raw!r}")
                j = stack.pop()
                source.pair[i], source.pair[j] = j, i
                if modes and modes[-1] == len(stack) and not isinstance(modes[-1], str):
                    modes.pop()
        if kind != "op" and (n := raw.count("\n")):
            line, begin = line + n, at + raw.rindex("\n") + 1
        at = end
    if stack:
        t = source.tokens[stack[-1]]
        raise SyntaxFault(f"{t.text!r} is not closed", t.line, t.col)
    if modes:
        raise fault("an element is not closed")
    _check(source)
    return source


_NEEDS_RIGHT = frozenset("= => + - * / % ** & | ^ && || ?? == === != !== <= >= += -= *= /= %= &= |= ^= &&= ||= ??= ... ?.".split())
_ENDS = frozenset(") ] } ; ,".split())
_AFTER_VALUE = frozenset("as in of instanceof satisfies extends implements is with assert from keyof".split())
_BEFORE_VALUE = frozenset(
    "import from case return typeof in of extends as satisfies keyof module default throw await yield new else do is delete void instanceof readonly static get set async public private protected override abstract infer asserts declare require type".split()
)


def _check(s: Source) -> None:
    t = s.tokens
    for i, a in enumerate(t):
        b, before = t[i + 1] if i + 1 < len(t) else None, t[i - 1] if i else None
        word = a.kind == "name" and not (before and before.text in {".", "?."})
        ends = b is None or b.kind == "op" and b.text in _ENDS
        if a.kind == "op" and a.text in _NEEDS_RIGHT and ends:
            raise SyntaxFault(f"nothing follows {a.text!r}", a.line, a.col)
        if b is not None and b.line == a.line:
            side = b.kind in {"number", "string"} or b.kind == "name" and b.text not in _AFTER_VALUE
            if a.kind in {"number", "string"} and side or word and a.text not in _BEFORE_VALUE and b.kind in {"number", "string"}:
                raise SyntaxFault(f"{b.text!r} follows {a.text!r} without an operator", b.line, b.col)
        if not word:
            continue
        if a.text in {"const", "let", "var"} and (b is None or b.text in {"=", ";"}) and not (before and before.text in {"as", "<", ",", "{"}):
            raise SyntaxFault(f"{a.text} declares nothing", a.line, a.col)
        if a.text in {"const", "let", "var"} and i + 2 < len(t) and b.kind == "name" and b.text != "enum" and t[i + 2].kind == "name" and t[i + 2].line == b.line and t[i + 2].text not in {"of", "in"}:
            raise SyntaxFault(f"{t[i + 2].text!r} follows {b.text!r} without an operator", b.line, b.col)
        if a.text in {"if", "while", "switch"} and b is not None and b.kind in {"name", "number", "string"}:
            raise SyntaxFault(f"{a.text} has no condition in parentheses", a.line, a.col)
        if a.text in {"function", "class"} and before is not None and before.text == "export" and b is not None and b.text in {"(", "{"}:
            raise SyntaxFault(f"an exported {a.text} has no name", a.line, a.col)
        if a.text in {"import", "export"} and b is not None and b.text == ";":
            raise SyntaxFault(f"{a.text} names nothing", a.line, a.col)


def unquote(t: Token) -> str:
    return re.sub(r"\\(.)", r"\1", t.text[1:-1])


@dataclass
class Function:
    """A function-like declaration; ``body`` is a token range without its braces, ``block`` says whether it has braces."""

    name: str
    line: int
    line_end: int
    exported: bool
    is_async: bool
    params: tuple[int, int]
    returns: str
    body: tuple[int, int]
    block: bool
    container: str = ""
    col: int = 0


@dataclass
class Item:
    name: str
    kind: str
    line: int
    line_end: int
    exported: bool
    container: str
    col: int
    head: int  # token of the name
    body: tuple[int, int] | None


KINDS = {"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace", "module": "namespace"}


def split_commas(s: Source, a: int, b: int) -> list[tuple[int, int]]:
    """Token ranges between the commas of a range, brackets and type arguments passed over."""
    out, start, i, angle = [], a, a, 0
    while i < b:
        t = s.tokens[i].text
        if s.tokens[i].kind == "op" and t in OPEN:
            i = s.pair[i]
        elif t == "<":
            angle += 1
        elif t == ">" and angle:
            angle -= 1
        elif t == "," and not angle:
            out.append((start, i))
            start = i + 1
        i += 1
    if start < b:
        out.append((start, b))
    return out


def statement_end(s: Source, i: int, stop: int) -> int:
    """Past the end of the statement at token i: its semicolon, or a line whose next token can't go on with it."""
    while i < stop:
        t = s.tokens[i]
        if t.kind == "op" and t.text in OPEN:
            i = s.pair[i]
        elif t.text == ";":
            return i + 1
        i += 1
        if i < stop and s.tokens[i].line > s.tokens[i - 1].line and s.tokens[i].kind == "name" and s.tokens[i - 1].text not in {"=", "=>", ",", ":", "|", "&", "+", "?", "(", ".", "extends", "of", "in", "return", "&&", "||", "??"} and s.tokens[i].text not in {"instanceof", "in", "of", "as", "satisfies"}:
            return i
    return stop


def _skip_types(s: Source, i: int, stop: int) -> int:
    """Past a type argument list that begins at i, if one does."""
    if i < stop and s.tokens[i].text == "<":
        depth = 0
        while i < stop:
            t = s.tokens[i].text
            depth += (t == "<") - (t == ">")
            if t in OPEN and s.tokens[i].kind == "op":
                i = s.pair[i]
            i += 1
            if not depth:
                break
    return i


def function_at(s: Source, name: str, i: int, stop: int, first: int, exported: bool, is_async: bool, container: str = "") -> Function | None:
    """The function whose parameter list (or type arguments before it) begins at token i."""
    i = _skip_types(s, i, stop)
    if i >= stop or s.tokens[i].text != "(":
        return None
    close = s.pair[i]
    params, j, returns = (i + 1, close), close + 1, ""
    if j < stop and s.tokens[j].text == ":":
        k = j + 1
        while k < stop and s.tokens[k].text not in {"=>", ";"} and not (s.tokens[k].text == "{" and k > j + 1 and s.tokens[k - 1].text not in {"|", "&", ":", "<", ","}):
            k = s.pair[k] + 1 if s.tokens[k].kind == "op" and s.tokens[k].text in OPEN else k + 1
        returns, j = s.slice(j + 1, k), k
    if j < stop and s.tokens[j].text == "=>":
        j += 1
        if j < stop and s.tokens[j].text != "{":
            end = statement_end(s, j, stop)
            return Function(name, s.tokens[first].line, s.tokens[end - 1].line, exported, is_async, params, returns, (j, end), False, container, s.tokens[first].col)
    if j < stop and s.tokens[j].text == "{":
        return Function(name, s.tokens[first].line, s.tokens[s.pair[j]].line, exported, is_async, params, returns, (j + 1, s.pair[j]), True, container, s.tokens[first].col)
    return Function(name, s.tokens[first].line, s.tokens[j - 1].line, exported, is_async, params, returns, (j, j), False, container, s.tokens[first].col)


def initial_function(s: Source, name: str, i: int, stop: int, first: int, exported: bool) -> Function | None:
    """The function that an initialiser at token i is, if it is one: arrow or function expression."""
    is_async = i < stop and s.tokens[i].text == "async"
    i += is_async
    if i < stop and s.tokens[i].text == "function":
        i += 1
        while i < stop and s.tokens[i].text not in {"(", "<"}:
            i += 1
        return function_at(s, name, i, stop, first, exported, is_async)
    j = _skip_types(s, i, stop)
    if j < stop and s.tokens[j].text == "(":
        f = function_at(s, name, j, stop, first, exported, is_async)
        arrow = any(s.tokens[k].text == "=>" for k in (s.pair[j] + 1, f.body[0] - 1, f.body[0] - 2) if 0 <= k < stop) if f else False
        return f if arrow else None
    if i + 1 < stop and s.tokens[i].kind == "name" and s.tokens[i + 1].text == "=>":
        block = i + 2 < stop and s.tokens[i + 2].text == "{"
        body = (i + 3, s.pair[i + 2]) if block else (i + 2, statement_end(s, i + 2, stop))
        last = s.tokens[min(body[1], stop - 1)].line
        return Function(name, s.tokens[first].line, last, exported, is_async, (i, i + 1), "", body, block, "", s.tokens[first].col)
    return None


def declarations(s: Source, a: int = 0, b: int | None = None) -> tuple[list[Item], list[Function]]:
    """Declarations of a token range at its own depth, members of classes and interfaces with them."""
    b = len(s.tokens) if b is None else b
    items: list[Item] = []
    functions: list[Function] = []
    i = a
    while i < b:
        first, exported, is_async = i, False, False
        while i < b and s.tokens[i].text in {"export", "default", "declare", "abstract", "async"} and not (i + 1 < b and s.tokens[i + 1].text in {"=", "(", ".", ":"}):
            exported |= s.tokens[i].text == "export"
            is_async |= s.tokens[i].text == "async"
            i += 1
        if i >= b:
            break
        t = s.tokens[i].text
        named = i + 1 < b and s.tokens[i + 1].kind == "name"
        if t == "function":
            i += 1 + (i + 1 < b and s.tokens[i + 1].text == "*")
            name, head = (s.tokens[i].text, i) if i < b and s.tokens[i].kind == "name" else ("default", i)
            f = function_at(s, name, i + (name != "default"), b, first, exported, is_async)
            if f:
                functions.append(f)
                items.append(Item(name, "function", f.line, f.line_end, exported, "", s.tokens[first].col, head, f.body))
                i = max(f.body[1] + f.block, i + 1)
                continue
        elif t in KINDS and (named or t == "class"):
            name = s.tokens[i + 1].text if named and s.tokens[i + 1].text not in {"extends", "implements"} else "default"
            j = i + 1
            while j < b and s.tokens[j].text != "{":
                j = s.pair[j] + 1 if s.tokens[j].kind == "op" and s.tokens[j].text in OPEN else j + 1
            if j < b:
                end = s.pair[j]
                items.append(Item(name, KINDS[t], s.tokens[first].line, s.tokens[end].line, exported, "", s.tokens[first].col, i + 1, (j + 1, end)))
                if t in {"class", "interface"}:
                    _members(s, j + 1, end, name, exported, items, functions)
                i = end + 1
                continue
        elif t == "type" and named:
            end = statement_end(s, i, b)
            items.append(Item(s.tokens[i + 1].text, "type", s.tokens[first].line, s.tokens[end - 1].line, exported, "", s.tokens[first].col, i + 1, (i + 2, end)))
            i = end
            continue
        elif t in {"const", "let", "var"} and i + 1 < b and s.tokens[i + 1].text != "enum":
            end = statement_end(s, i, b)
            for x, y in split_commas(s, i + 1, end):
                eq = next((k for k in range(x, y) if s.tokens[k].text == "=" and not any(o < k < s.pair[o] for o in range(x, k) if o in s.pair and s.pair[o] > o)), None)
                for head in ([x] if s.tokens[x].kind == "name" else [k for k in range(x + 1, s.pair.get(x, x)) if s.tokens[k].kind == "name" and s.tokens[k + 1].text in {",", "}", "]", "="}]):
                    items.append(Item(s.tokens[head].text, "variable", s.tokens[first].line, s.tokens[y - 1].line, exported, "", s.tokens[first].col, head, (x, y)))
                if eq is not None and s.tokens[x].kind == "name" and (f := initial_function(s, s.tokens[x].text, eq + 1, y, first, exported)):
                    functions.append(f)
            i = end
            continue
        elif t == "const" and i + 2 < b:
            j = i + 3
            end = s.pair[j] if j in s.pair else j
            items.append(Item(s.tokens[i + 2].text, "enum", s.tokens[first].line, s.tokens[min(end, b - 1)].line, exported, "", s.tokens[first].col, i + 2, (j + 1, end)))
            i = end + 1
            continue
        i = max(statement_end(s, i, b), i + 1)
    return items, functions


def _members(s: Source, a: int, b: int, owner: str, exported: bool, items: list[Item], functions: list[Function]) -> None:
    i = a
    while i < b:
        first, is_async, private = i, False, False
        while i + 1 < b and s.tokens[i].text in {"public", "private", "protected", "static", "readonly", "async", "override", "abstract", "get", "set", "*", "declare"} and s.tokens[i + 1].text not in {"(", ":", "=", "?", ";"}:
            is_async |= s.tokens[i].text == "async"
            private |= s.tokens[i].text == "private"
            i += 1
        if s.tokens[i].kind in {"name", "string"} or s.tokens[i].text == "#":
            private |= s.tokens[i].text == "#"
            i += s.tokens[i].text == "#"
            head = i
            j = i + 1 + (i + 1 < b and s.tokens[i + 1].text in {"?", "!"})
            f = function_at(s, s.tokens[head].text, j, b, first, exported and not private, is_async, owner) if j < b and s.tokens[j].text in {"(", "<"} else None
            end = (f.body[1] + 1 if f.block else max(f.body[1], j + 1)) if f else statement_end(s, i, b)
            items.append(Item(s.tokens[head].text, "method" if f else "property", s.tokens[first].line, s.tokens[min(end, b) - 1].line, exported and not private, owner, s.tokens[first].col, head, (j, end)))
            if f:
                functions.append(f)
            i = max(end, i + 1)
        else:
            i = s.pair[i] + 1 if s.tokens[i].kind == "op" and s.tokens[i].text in OPEN else i + 1


@dataclass
class Call:
    callee: str
    line: int
    col: int
    is_new: bool
    args: tuple[int, int]
    at: int


def calls(s: Source, a: int, b: int, skip: list[tuple[int, int]] = ()) -> list[Call]:
    """Calls and constructions in a token range, the ranges to skip aside."""
    out = []
    for i in range(a, b):
        if s.tokens[i].text != "(" or i == a or any(x <= i < y for x, y in skip):
            continue
        j = i - 1
        if s.tokens[j].text == ">":  # type arguments
            depth = 0
            while j > a:
                depth += (s.tokens[j].text == ">") - (s.tokens[j].text == "<")
                j -= 1
                if not depth:
                    break
        parts: list[str] = []
        while j >= a and s.tokens[j].kind == "name":
            parts.append(s.tokens[j].text)
            if j - 1 >= a and s.tokens[j - 1].text in {".", "?."}:
                j -= 2
                if s.tokens[j].kind == "op" and s.tokens[j].text == ")":
                    parts.append("()")
                    break
            else:
                break
        if not parts or parts[0] in {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "of", "in", "constructor", "super", "async", "import"} or (j > a and s.tokens[j - 1].text == "function"):
            continue
        is_new = j > a and s.tokens[j - 1].text == "new"
        out.append(Call(".".join(reversed(parts)), s.tokens[max(j, a)].line, s.tokens[max(j, a)].col, is_new, (i + 1, s.pair[i]), i))
    return out
