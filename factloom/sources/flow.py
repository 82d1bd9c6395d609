"""Control flow of function bodies: a walk over statements, not over lines, that counts for both models at once.

The larger model nests by what branches and loops (an ``else if`` lies in its ``if``), enters nested functions and counts a
fixed set of statements; the smaller one nests by blocks, counts every statement and stays out of nested functions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from factloom.sources import lexer as L

LITERAL_NAMES = {"true", "false"}
UNCOUNTED = {"function", "class", "interface", "type", "enum", "namespace", "module", "import", "export", "declare", "abstract", "break", "continue", "debugger"}


@dataclass
class Metrics:
    statements: int = 0
    branches: int = 0
    loops: int = 0
    max_nesting: int = 0
    max_literal_chain: int = 0
    manual_transform_loops: int = 0
    max_block_statements: int = 0
    block_nesting: int = 1
    all_statements: int = 0
    clauses: int = 0  # branches of the smaller model
    own_loops: int = 0
    awaits: int = 0
    tries: int = 0


def _bare(s: L.Source, a: int, b: int) -> tuple[int, int]:
    """The range without parentheses around all of it."""
    while a < b and s.tokens[a].text == "(" and s.tokens[a].kind == "op" and s.pair[a] == b - 1:
        a, b = a + 1, b - 1
    return a, b


def _is_literal(s: L.Source, a: int, b: int) -> bool:
    t = s.tokens[a]
    return b - a == 1 and (t.kind in {"string", "number"} or t.kind == "template" and "${" not in t.text or t.text in LITERAL_NAMES)


def comparison_subject(s: L.Source, a: int, b: int) -> str | None:
    """What a condition compares with a literal, on either side of one == or ===; None for any other condition."""
    a, b = _bare(s, a, b)
    i, at = a, None
    while i < b:
        t = s.tokens[i]
        if t.kind == "op" and t.text in L.OPEN:
            i = s.pair[i]
        elif t.text in {"&&", "||", "??", "?", ",", "=", "!=", "!=="} or t.text in {"==", "==="} and at is not None:
            return None
        elif t.text in {"==", "==="}:
            at = i
        i += 1
    if at is None or at == a or at + 1 == b:
        return None
    left, right = _bare(s, a, at), _bare(s, at + 1, b)
    if _is_literal(s, *left) == _is_literal(s, *right):
        return None
    return s.slice(*(right if _is_literal(s, *left) else left))


@dataclass
class _Walk:
    s: L.Source
    body: tuple[int, int]  # of the function at hand
    m: Metrics = field(default_factory=Metrics)

    def text(self, i: int, stop: int) -> str:
        return self.s.tokens[i].text if i < stop else ""

    def block(self, a: int, b: int, depth: int, blocks: int | None) -> None:
        """The statements between two braces, ``blocks`` of which lie around them."""
        n, i = 0, a
        while i < b:
            i = max(self.statement(i, b, depth, blocks), i + 1)
            n += 1
        self.m.max_block_statements = max(self.m.max_block_statements, n)

    def statement(self, i: int, stop: int, depth: int, blocks: int | None) -> int:
        """Walks the statement at token i; past its end."""
        m, s, t = self.m, self.s, self.s.tokens[i]
        if blocks is not None:
            m.all_statements += 1
            m.block_nesting = max(m.block_nesting, blocks + 1)
        word = t.text if t.kind == "name" and self.text(i + 1, stop) not in {":", "=", "."} else ""
        if t.kind == "op" and t.text == ";":
            return i + 1
        if t.kind == "op" and t.text == "{":
            self.block(i + 1, s.pair[i], depth, None if blocks is None else blocks + 1)
            return s.pair[i] + 1
        if t.kind == "name" and self.text(i + 1, stop) == ":" and word == "":
            return self.statement(i + 2, stop, depth, blocks) if i + 2 < stop else stop  # a label
        if word in {"if", "for", "while", "switch", "try", "do"}:
            m.statements += 1
            return getattr(self, f"_{word}")(i, stop, depth + 1, blocks)
        end = self._end(i, stop)
        if word in UNCOUNTED or word == "async" and self.text(i + 1, stop) == "function":
            self.nested(i, end, depth)
        else:
            m.statements += 1
            self.expression(i, end, depth, blocks)
        return end

    def _end(self, i: int, stop: int) -> int:
        """Past a statement without a body of its own; declarations of functions and classes end with their braces."""
        t = self.s.tokens
        if t[i].text in {"function", "class", "interface", "enum", "namespace", "export", "async", "abstract", "declare"}:
            k = i
            while k < stop and t[k].text not in {"{", ";", "="}:
                k = self.s.pair[k] + 1 if t[k].kind == "op" and t[k].text in L.OPEN else k + 1
            if k < stop and t[k].text == "{":
                return self.s.pair[k] + 1
        return L.statement_end(self.s, i, stop)

    def _head(self, i: int, stop: int) -> tuple[int, int] | None:
        k = i + 1 + (self.text(i + 1, stop) == "await")
        return (k + 1, self.s.pair[k]) if self.text(k, stop) == "(" else None

    def _deeper(self, depth: int) -> None:
        self.m.max_nesting = max(self.m.max_nesting, depth)

    def _if(self, i: int, stop: int, depth: int, blocks: int | None, chain: tuple[str | None, int] = (None, 0)) -> int:
        head = self._head(i, stop)
        if head is None:
            return self._end(i, stop)
        self.m.branches += 1
        self.m.clauses += blocks is not None
        self._deeper(depth)
        subject = comparison_subject(self.s, *head)
        n = chain[1] + 1 if subject is not None and subject == chain[0] else int(subject is not None)
        self.m.max_literal_chain = max(self.m.max_literal_chain, n)
        self.expression(*head, depth, blocks)
        k = self.statement(head[1] + 1, stop, depth, blocks) if head[1] + 1 < stop else stop
        if self.text(k, stop) == "else" and k + 1 < stop:
            if self.text(k + 1, stop) == "if":
                self.m.statements += 1
                if blocks is not None:
                    self.m.all_statements += 1
                return self._if(k + 1, stop, depth + 1, blocks, (subject, n))
            return self.statement(k + 1, stop, depth, blocks)
        return k

    def _for(self, i: int, stop: int, depth: int, blocks: int | None) -> int:
        self.m.loops += 1
        self.m.own_loops += blocks is not None
        self._deeper(depth)
        head = self._head(i, stop)
        if head is None:
            return self._end(i, stop)
        self.expression(*head, depth, blocks)
        start = head[1] + 1
        end = self.statement(start, stop, depth, blocks) if start < stop else stop
        if self.text(i, stop) == "for" and self._transforms(head, start, end):
            self.m.manual_transform_loops += 1
        return end

    _while = _for

    def _do(self, i: int, stop: int, depth: int, blocks: int | None) -> int:
        self.m.loops += 1
        self.m.own_loops += blocks is not None
        self._deeper(depth)
        k = self.statement(i + 1, stop, depth, blocks) if i + 1 < stop else stop
        if self.text(k, stop) == "while":
            head = self._head(k, stop)
            if head:
                self.expression(*head, depth, blocks)
                k = head[1] + 1
        return k + (self.text(k, stop) == ";")

    def _switch(self, i: int, stop: int, depth: int, blocks: int | None) -> int:
        head = self._head(i, stop)
        if head is None or self.text(head[1] + 1, stop) != "{":
            return self._end(i, stop)
        self.m.branches += 1
        self._deeper(depth)
        self.expression(*head, depth, blocks)
        k, end, at = head[1] + 2, self.s.pair[head[1] + 1], depth
        inner = None if blocks is None else blocks + 1
        while k < end:
            t = self.s.tokens[k]
            if t.kind == "name" and t.text in {"case", "default"}:
                self.m.clauses += blocks is not None
                colon = self._colon(k + 1, end)
                if t.text == "case":
                    self.m.branches += 1
                    self._deeper(depth + 1)
                    self.expression(k + 1, colon, depth + 1, inner)
                at = depth + (t.text == "case")
                k = colon + 1
            else:
                k = max(self.statement(k, end, at, inner), k + 1)
        return end + 1

    def _colon(self, i: int, stop: int) -> int:
        asked = 0
        while i < stop:
            t = self.s.tokens[i]
            if t.kind == "op" and t.text in L.OPEN:
                i = self.s.pair[i]
            elif t.text == "?":
                asked += 1
            elif t.text == ":":
                if not asked:
                    return i
                asked -= 1
            i += 1
        return stop

    def _try(self, i: int, stop: int, depth: int, blocks: int | None) -> int:
        self.m.tries += blocks is not None
        self._deeper(depth)
        k, inner = i + 1, None if blocks is None else blocks + 1
        while self.text(k, stop) in {"{", "catch", "finally"}:
            at = depth
            if self.text(k, stop) == "catch":
                self.m.branches += 1
                at = depth + 1
                self._deeper(at)
                k += 1
                k = self.s.pair[k] + 1 if self.text(k, stop) == "(" else k
            elif self.text(k, stop) == "finally":
                k += 1
            if self.text(k, stop) != "{":
                break
            self.block(k + 1, self.s.pair[k], at, inner)
            k = self.s.pair[k] + 1
        return k

    def expression(self, a: int, b: int, depth: int, blocks: int | None) -> None:
        """Conditionals, awaits and nested functions of a token range; a conditional's parts lie one deeper."""
        i, at = a, depth
        s = self.s
        while i < b:
            t = s.tokens[i]
            if t.text == "await" and t.kind == "name":
                self.m.awaits += blocks is not None
            elif t.kind == "op" and t.text == "?" and self.text(i + 1, b) not in {":", ")", ",", "]", "}", ""}:
                at += 1
                self.m.branches += 1
                self.m.clauses += blocks is not None
                self._deeper(at)
            elif t.kind == "op" and t.text in {",", ";"}:
                at = depth
            elif t.kind == "op" and t.text in L.OPEN:
                if t.text == "{" and i > 0 and (s.tokens[i - 1].text in {"=>", ")"} or self._typed_body(i, a)):
                    outer, self.body = self.body, (i + 1, s.pair[i])
                    self.block(i + 1, s.pair[i], at, None)
                    self.body = outer
                else:
                    self.expression(i + 1, s.pair[i], at, blocks)
                i = s.pair[i]
            i += 1

    nested = lambda self, a, b, depth: self.expression(a, b, depth, None)

    def _typed_body(self, i: int, a: int) -> bool:
        """Whether a brace opens the body of a function with a result type: ``): T {``."""
        k = i - 1
        while k > a and s_ok(self.s.tokens[k]):
            k -= 1
        return k > a and self.s.tokens[k].text == ":" and self.s.tokens[k - 1].text == ")"

    def _transforms(self, head: tuple[int, int], start: int, end: int) -> bool:
        """Whether a loop pushes what its variables hold into a list that its function returns."""
        t = self.s.tokens
        stop = next((k for k in range(*head) if t[k].text in {"of", "in", ";", "="}), head[1])
        names = {t[k].text for k in range(head[0], stop) if t[k].kind == "name" and t[k].text not in {"const", "let", "var", "await"} and self.text(k + 1, head[1]) != ":"}
        for c in L.calls(self.s, start, end):
            target, _, method = c.callee.rpartition(".")
            if method == "push" and re.fullmatch(r"[\w$]+", target) and any(t[k].kind == "name" and t[k].text in names and t[k - 1].text != "." for k in range(*c.args)) and self._returned(target):
                return True
        return False

    def _returned(self, name: str) -> bool:
        t, (a, b) = self.s.tokens, self.body
        i = a
        while i < b:
            if t[i].kind == "op" and t[i].text == "{" and i > a and (t[i - 1].text == "=>" or t[i - 1].text == ")" and self._is_function(i, a)):
                i = self.s.pair[i]
            elif t[i].text == "return" and t[i].kind == "name":
                x, y = _bare(self.s, i + 1, self._end(i, b))
                y -= y > x and t[y - 1].text == ";"
                x, y = _bare(self.s, x, y)
                if y - x == 1 and t[x].text == name:
                    return True
            i += 1
        return False

    def _is_function(self, i: int, a: int) -> bool:
        k = self.s.pair[i - 1] - 1
        return k >= a and not (self.s.tokens[k].text in {"if", "for", "while", "switch", "catch", "await", "with"})


def s_ok(t: L.Token) -> bool:
    """Whether a token may stand in a simple result type."""
    return t.kind in {"name", "string"} or t.text in {"<", ">", "|", "&", ".", "[", "]", ","}


def metrics(s: L.Source, body: tuple[int, int], is_block: bool) -> Metrics:
    """Of the body of one function; an arrow's expression counts as one statement of its block and none by itself."""
    w = _Walk(s, body)
    if is_block:
        w.block(*body, 0, 1)
    elif body[0] < body[1]:
        w.expression(*body, 0, 0)
        w.m.max_block_statements = max(w.m.max_block_statements, 1)
    return w.m


def line_span(s: L.Source, body: tuple[int, int], is_block: bool) -> int:
    """Lines from where the body begins to where it ends, braces included."""
    a, b = (body[0] - 1, body[1]) if is_block else (body[0], body[1] - 1)
    last = s.tokens[b]
    return last.line + last.text.count("\n") - s.tokens[a].line + 1
