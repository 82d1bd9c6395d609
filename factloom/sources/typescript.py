"""Fact families of TypeScript modules, and the Spark scans that yield them.

Each collector is apart from the others: one that fails yields nothing for its own family, and a diagnostic of the phase
"extract". A text that can't be read into tokens yields an invalid module with a diagnostic of code 0, never an exception.
``facts`` reads one family; ``all_facts`` reads every family in one pass over the texts, as one tagged table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from factloom.schemas import SCHEMAS
from factloom.sources import flow
from factloom.sources import lexer as L

# fixed values
PROMISE_COMBINATORS = ("Promise.all", "Promise.allSettled", "Promise.any", "Promise.race")
EFFECT_COLLECTIONS = ("Effect.all", "Effect.allSuccesses", "Effect.allWith", "Effect.forEach", "Effect.mergeAll", "Effect.replicateEffect", "Effect.validateAll")
RUN_METHODS = ("runCallback", "runFork", "runPromise", "runPromiseExit", "runSync")
EXTERNAL_IO = ("fetch", "Effect.async", "Effect.promise", "Effect.tryPromise")
OBSERVES = r"^Effect\.(annotateCurrentSpan|annotateLogs|annotateLogsScoped|log|logDebug|logError|logFatal|logInfo|logTrace|logWarning|withSpan)$|^Metric\."
RESILIENT = r"^Effect\.(retry|retryOrElse|timeout|timeoutFail|timeoutFailCause|timeoutOption|timeoutTo)$"
DECODES = r"^Schema\.((decode|validate)\w*|parseJson|is|asserts)$"
IMPURE_CALLS = ("Date.now", "Math.random")
BRANCHES = {"if", "case", "catch", "?", "&&", "||", "??"}


def _names(s: L.Source, a: int, b: int) -> list[tuple[str, str, bool]]:
    """(name, alias, type-only) of the elements of an import or export clause."""
    out = []
    for x, y in L.split_commas(s, a, b):
        words = [s.tokens[i].text for i in range(x, y)]
        type_only = len(words) > 1 and words[0] == "type" and words[1] != "as"
        words = words[type_only:]
        if words:
            out.append((words[0], words[-1], type_only))
    return out


def imports(path: str, s: L.Source, d: tuple) -> list[dict]:
    out, t = [], s.tokens

    def add(i: int, spec: int, kind: str, type_only: bool) -> None:
        out.append({"path": path, "seq": len(out), "module_specifier": L.unquote(t[spec]), "kind": kind, "is_type_only": type_only, "line": t[i].line, "col": t[i].col})

    for i in range(len(t) - 1):
        if t[i].kind != "name" or t[i].text not in {"import", "export"} or (i and t[i - 1].text == "."):
            continue
        if t[i].text == "import" and t[i + 1].text == "(":
            close = s.pair[i + 1]
            if close == i + 3 and t[i + 2].kind == "string":
                in_type = i > 0 and (t[i - 1].text in {":", "<", "|", "&", "typeof"} or i > 2 and t[i - 1].text == "=" and t[i - 3].text == "type")
                add(i, i + 2, "import" if in_type else "dynamic-import", in_type)
            continue
        if t[i].text == "import" and t[i + 1].kind == "string":
            add(i, i + 1, "import", False)
            continue
        end = next((k for k in range(i + 1, min(i + 4000, len(t))) if t[k].text in {";", "from", "="} or (k > i + 1 and t[k].line > t[k - 1].line and t[k].text in {"import", "export", "const", "function", "class"})), None)
        if end is None:
            continue
        if t[end].text == "from" and end + 1 < len(t) and t[end + 1].kind == "string":
            brace = next((k for k in range(i + 1, end) if t[k].text == "{"), None)
            named = _names(s, brace + 1, s.pair[brace]) if brace is not None and s.pair[brace] < end + 1 else []
            only_named = brace == i + 1
            type_only = t[i + 1].text == "type" and t[i + 2].text not in {"from", ","} or bool(named) and only_named and all(x[2] for x in named)
            add(i, end + 1, t[i].text, type_only)
        elif t[i].text == "import" and t[end].text == "=" and end + 3 < len(t) and t[end + 1].text == "require" and t[end + 3].kind == "string":
            add(i, end + 3, "import", t[i + 1].text == "type")
    return out


def exports(path: str, s: L.Source, d: tuple) -> list[dict]:
    """A row for each name that a statement of the module exports, in order; a declaration without a name is called default."""
    t = s.tokens
    found: list[tuple[int, int, str, str, bool]] = []  # line, column, name, kind, type-only

    def add(at: L.Token, name: str, kind: str, type_only: bool = False) -> None:
        found.append((at.line, at.col, name, kind, type_only))

    depth_end = -1
    for i in range(len(t) - 1):
        if i <= depth_end:
            continue
        if t[i].kind == "op" and t[i].text == "{" and not (i and t[i - 1].text in {"export", "type"}):
            depth_end = s.pair[i]
            continue
        if t[i].text != "export" or t[i].kind != "name":
            continue
        type_only = t[i + 1].text == "type" and t[i + 2].text in {"{", "*"}
        j = i + 1 + type_only
        if t[j].text == "*":
            named = t[j + 1].text == "as"
            add(t[i], t[j + 2].text if named else "*", "namespace-reexport" if named else "star", type_only)
        elif t[j].text == "{":
            again = s.pair[j] + 1 < len(t) and t[s.pair[j] + 1].text == "from"
            for _, alias, only in _names(s, j + 1, s.pair[j]):
                add(t[i], alias, "reexport" if again else "export-list", type_only or only)
        elif t[j].text == "=":
            add(t[i], s.slice(j + 1, L.statement_end(s, j + 1, len(t))).rstrip("; \n"), "export-assignment")
        elif t[j].text == "as" and t[j + 1].text == "namespace" and j + 2 < len(t):
            add(t[i], t[j + 2].text, "global-namespace")
        elif t[j].text == "default" and t[j + 1].text not in {"function", "class", "async", "abstract", "interface"}:
            add(t[i], "default", "default")
    for item in d[0]:
        if item.exported and not item.container:
            found.append((item.line, item.col, item.name, item.kind, item.kind in {"interface", "type"}))
    names = ("line", "col", "name", "kind", "is_type_only")
    return [{"path": path, "seq": i, **dict(zip(names, r, strict=True))} for i, r in enumerate(sorted(found, key=lambda r: r[:2]))]


def items(path: str, s: L.Source, d: tuple) -> list[dict]:
    return [{"path": path, "name": x.name, "kind": x.kind, "is_exported": x.exported, "is_private": x.name.startswith(("_", "#")) or not x.exported and bool(x.container), "line": x.line, "line_end": x.line_end, "container": x.container or None} for x in d[0]]


def call_rows(path: str, s: L.Source, d: tuple) -> list[dict]:
    out, seen = [], []
    for f in d[1]:
        seen += [f.body, (f.params[0] - 1, f.params[1])]
        out += [{"path": path, "owner": f.name, "callee": c.callee, "is_new": c.is_new, "line": c.line, "col": c.col} for c in L.calls(s, *f.body)]
    out += [{"path": path, "owner": None, "callee": c.callee, "is_new": c.is_new, "line": c.line, "col": c.col} for c in L.calls(s, 0, len(s.tokens), seen)]
    return out


def _typed(s: L.Source, a: int, b: int) -> tuple[str, str | None]:
    """(name, type text) of a parameter or field."""
    i = a
    while i < b and s.tokens[i].text in {"public", "private", "protected", "readonly", "..."}:
        i += 1
    name = s.slice(i, s.pair[i] + 1) if i in s.pair else s.tokens[i].text if i < b else ""
    colon = (s.pair[i] if i in s.pair else i) + 1
    colon += colon < b and s.tokens[colon].text in {"?", "!"}
    if colon < b and s.tokens[colon].text == ":":
        end = next((k for k in range(colon + 1, b) if s.tokens[k].text == "=" and not any(o < k < s.pair[o] for o in range(colon, k) if o in s.pair)), b)
        while end > colon + 1 and s.tokens[end - 1].text in {";", ","}:
            end -= 1
        return name, s.slice(colon + 1, end)
    return name, None


def primitive(text: str | None) -> str | None:
    parts = sorted({p.strip() for p in (text or "").split("|") if p.strip()})
    return " | ".join(parts) if parts and all(p in {"string", "number", "boolean", "bigint", "symbol"} for p in parts) else None


def flag(text: str | None) -> str | None:
    parts = {p.strip() for p in (text or "").split("|")} - {"", "undefined", "null"}
    return "boolean" if parts and parts <= {"boolean", "true", "false"} else None


def params(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for f in d[1]:
        for x, y in L.split_commas(s, *f.params) if f.exported else []:
            name, kind = _typed(s, x, y)
            out.append({"path": path, "seq": len(out), "function_name": f.name, "function_line": f.line, "param_name": name, "type_text": kind, "primitive_type": primitive(kind), "flag_type": flag(kind), "line": s.tokens[x].line, "col": s.tokens[x].col})
    return out


def tuple_surfaces(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for f in d[1]:
        typed = [(n, k) for n, k in (_typed(s, x, y) for x, y in L.split_commas(s, *f.params))] + [("return", f.returns)] if f.exported else []
        for name, kind in typed:
            bare = re.sub(r"^readonly\s+", "", (kind or "").strip())
            m = re.fullmatch(r"\[(.*)\]|Promise<\s*\[(.*)\]\s*>", bare, re.S)
            parts = [p.strip() for p in (m[1] or m[2] or "").split(",")] if m else []
            if len(parts) > 1 and all(primitive(p) for p in parts):
                out.append({"path": path, "seq": len(out), "function_name": f.name, "surface_name": name, "type_text": kind, "element_types": parts, "line": f.line, "col": f.col})
    return out


def _fields(s: L.Source, a: int, b: int) -> Iterator[tuple[str, str | None, L.Token]]:
    i = a
    while i < b:
        end, angle = i, 0
        while end < b and not (s.tokens[end].text == ";" or s.tokens[end].text == "," and not angle) and not (end > i and not angle and s.tokens[end].line > s.tokens[end - 1].line and s.tokens[end].kind == "name" and s.tokens[end - 1].text not in {":", "|", "&", "readonly"}):
            angle += (s.tokens[end].text == "<") - (s.tokens[end].text == ">" and angle > 0)
            end = s.pair[end] + 1 if end in s.pair and s.pair[end] > end else end + 1
        if end > i and s.tokens[i].kind == "name":
            name, kind = _typed(s, i, end)
            if kind is not None:
                yield name, kind, s.tokens[i]
        i = end + 1 if end < b and s.tokens[end].text in {";", ","} else max(end, i + 1)


def data_fields(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for x in d[0]:
        body = x.body
        if x.kind == "type" and body:
            brace = next((k for k in range(body[0], min(body[0] + 3, body[1])) if s.tokens[k].text == "{"), None)
            alone = brace is not None and all(s.tokens[k].text == ";" for k in range(s.pair[brace] + 1, body[1]))
            body = (brace + 1, s.pair[brace]) if alone else None
        if x.exported and not x.container and body and x.kind in {"interface", "type", "class"}:
            for name, kind, t in _fields(s, *body):
                out.append({"path": path, "seq": len(out), "type_kind": x.kind, "type_name": x.name, "type_line": x.line, "field_name": name, "type_text": kind, "primitive_type": primitive(kind), "line": t.line, "col": t.col})
    return out


def type_aliases(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for x in d[0]:
        if x.kind == "type" and x.exported and x.body:
            eq = next((k for k in range(*x.body) if s.tokens[k].text == "="), None)
            text = s.slice(eq + 1, x.body[1]).rstrip("; \n") if eq is not None else ""
            out.append({"path": path, "seq": len(out), "alias_name": x.name, "type_text": text, "primitive_type": primitive(text), "line": x.line, "col": x.col})
    return out


def variant_fields(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for x in d[0]:
        if x.kind != "type" or not x.exported or not x.body:
            continue
        i, n = x.body[0], 0
        while i < x.body[1]:
            if s.tokens[i].text == "{":
                fields = list(_fields(s, i + 1, s.pair[i]))
                mark = next(((a, b) for a, b, _ in fields if re.fullmatch(r"""["'][^"']*["']""", b or "")), None)
                n += 1
                for name, kind, t in fields:
                    if mark and name != mark[0]:
                        out.append({"path": path, "seq": len(out), "union_name": x.name, "variant_name": mark[1][1:-1], "discriminant_name": mark[0], "field_name": name, "primitive_type": primitive(kind), "line": t.line, "col": t.col})
                i = s.pair[i]
            i += 1
    return out


FLOW_FIELDS = ("statements", "branches", "loops", "max_nesting", "max_literal_chain", "manual_transform_loops", "max_block_statements")


def control_flows(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for f in d[1]:
        if f.exported and (f.block or f.body[0] < f.body[1]):
            m = flow.metrics(s, f.body, f.block)
            out.append({"path": path, "seq": len(out), "function_name": f.name, "line_span": flow.line_span(s, f.body, f.block), "line": f.line, "col": f.col, **{x: getattr(m, x) for x in FLOW_FIELDS}})
    return out


def responsibilities(path: str, s: L.Source, d: tuple) -> list[dict]:
    rows = [{"path": path, "kind": x.kind, "name": x.name, "line_span": x.line_end - x.line + 1, "line": x.line, "col": x.col} for x in d[0] if not x.container]
    inside = [x.body for x in d[0] if x.body] + [f.body for f in d[1]]
    return rows + [{"path": path, "kind": "call", "name": c.callee, "line_span": 1, "line": c.line, "col": c.col} for c in L.calls(s, 0, len(s.tokens), inside)]


def effect_parts(text: str) -> tuple[str, str, str] | None:
    """Success, error and requirements of an Effect type; never where they are left out."""
    m = re.match(r"\s*(?:Effect\.)?Effect<(.*)>\s*$", text or "", re.S)
    if not m:
        return None
    parts, depth, at = [], 0, 0
    for i, c in enumerate(m[1]):
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and not depth:
            parts.append(m[1][at:i].strip())
            at = i + 1
    parts.append(m[1][at:].strip())
    return tuple((parts + ["never", "never"])[:3]) if len(parts) < 3 else tuple(parts[:3])


def error_kind(text: str) -> str:
    parts = [p.strip() for p in text.split("|")]
    if all(p == "never" for p in parts):
        return "none"
    return "weak" if any(p in {"any", "unknown", "Error", "string", "object", "{}"} for p in parts) else "domain"


def async_surfaces(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for f in d[1]:
        effect = effect_parts(f.returns)
        promise = bool(re.match(r"\s*Promise<", f.returns or ""))
        if f.exported and not f.container and (f.is_async or promise or effect):
            out.append({"path": path, "seq": len(out), "name": f.name, "is_async": f.is_async, "returns_promise": promise, "returns_effect": effect is not None, "error_text": effect and effect[1], "error_kind": effect and error_kind(effect[1]), "requirements": effect and effect[2], "line": f.line, "col": f.col})
    return out


def service_methods(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for x in d[0]:
        if not x.exported or x.container or x.kind not in {"class", "interface", "type"} or not x.body:
            continue
        found = [(f.name, f.returns, f.line) for f in d[1] if f.container == x.name] + [(n, re.sub(r"^\(.*?\)\s*=>\s*", "", k or "", flags=re.S), t.line) for n, k, t in _fields(s, *x.body)]
        for name, returns, line in found:
            if effect := effect_parts(returns):
                out.append({"path": path, "seq": len(out), "container_kind": x.kind, "container_name": x.name, "method_name": name, "requirements": effect[2], "error_kind": error_kind(effect[1]), "line": line, "col": 0})
    return out


def fixtures(path: str, s: L.Source, d: tuple) -> list[dict]:
    out = []
    for c in L.calls(s, 0, len(s.tokens)):
        args = L.split_commas(s, *c.args)
        if c.callee.rpartition(".")[2] == "writeFileSync" and len(args) >= 2 and s.tokens[args[1][0]].kind in {"string", "template"}:
            names = [L.unquote(s.tokens[i]) for i in range(*args[0]) if s.tokens[i].kind == "string"]
            t = s.tokens[args[1][0]]
            out.append({"path": path, "seq": len(out), "fixture_path": "/".join(names), "line": t.line, "line_end": t.line + t.text.count("\n")})
    return out


def _loops_awaiting(s: L.Source, a: int, b: int) -> Iterator[L.Token]:
    for i in range(a, b):
        if s.tokens[i].text in {"for", "while"} and s.tokens[i].kind == "name":
            head = next((k for k in range(i + 1, min(i + 3, b)) if s.tokens[k].text == "("), None)
            body = s.pair[head] + 1 if head is not None else i
            if body < b and s.tokens[body].text == "{" and any(s.tokens[k].text == "await" for k in range(body, s.pair[body])):
                yield s.tokens[i]


def signals(path: str, s: L.Source, d: tuple) -> list[dict]:
    """Effect and React signals: family, owner, callee and kinds."""
    out: list[dict] = []

    def add(family: str, owner: str, callee: str, kinds: list[str], line: int, col: int = 0) -> None:
        out.append({"path": path, "seq": len(out), "family": family, "owner_name": owner, "callee": callee, "kinds": sorted(set(kinds)), "line": line, "col": col})

    for f in d[1]:
        cs = L.calls(s, *f.body)
        names = [c.callee for c in cs]
        for c in cs:
            args = s.slice(*c.args)
            head, _, method = c.callee.rpartition(".")
            if method in RUN_METHODS and (head in {"Effect", "Runtime"} or re.search("runtime$", head, re.I)):
                inside = any(re.fullmatch(r"use(Query|Mutation|InfiniteQuery|SuspenseQuery)", o.callee) and o.args[0] <= c.at < o.args[1] for o in cs)
                add("runtime-call", f.name, c.callee, ["query-hook"] if inside else [], c.line, c.col)
            if c.callee == "Effect.promise":
                kinds = [k for k, p in (("async-callback", r"^\s*async\b"), ("throws", r"\bthrow\b"), ("rejects", r"\bPromise\.reject\(")) if re.search(p, args)]
                if kinds:
                    add("promise-interop", f.name, c.callee, kinds, c.line, c.col)
            if c.callee == "Effect.acquireRelease" and "Effect.scoped" not in names:
                add("resource-scope", f.name, c.callee, [], c.line, c.col)
            if c.callee in PROMISE_COMBINATORS:
                add("concurrency", f.name, c.callee, ["promise-combinator"], c.line, c.col)
            if c.callee in EFFECT_COLLECTIONS and not re.search(r"\bconcurrency\s*:", args):
                add("concurrency", f.name, c.callee, ["unbounded-collection"], c.line, c.col)
            if (c.callee == "JSON.parse" or method == "json") and not any(re.search(DECODES, n) for n in names):
                add("schema-boundary", f.name, c.callee, ["unvalidated-json"], c.line, c.col)
            if c.callee in EXTERNAL_IO:
                lacking = [k for k, p in (("observability", OBSERVES), ("resilience", RESILIENT)) if not any(re.search(p, n) for n in names)]
                if lacking:
                    add("production-boundary", f.name, c.callee, lacking, c.line, c.col)
        for t in _loops_awaiting(s, *f.body):
            add("concurrency", f.name, t.text, ["await-in-loop"], t.line, t.col)
        if f.exported and re.match(r"[A-Z]|use[A-Z0-9]", f.name):
            inner = [g.body for g in d[1] if g is not f and f.body[0] <= g.body[0] and g.body[1] <= f.body[1]] + _nested(s, *f.body)
            for c in L.calls(s, *f.body, inner):
                if c.callee in IMPURE_CALLS or c.is_new and c.callee == "Date":
                    add("render-purity", f.name, c.callee, ["impure-call"], c.line, c.col)
                if re.match(r"use([A-Z0-9]|$)", c.callee.rpartition(".")[2]):
                    kinds = hook_violations(s, f.body, c.at, c.callee)
                    if kinds:
                        add("hook-call", f.name, c.callee, kinds, c.line, c.col)
            for i in range(*f.body):
                if s.tokens[i].text in {"window", "document", "localStorage"} and not any(x <= i < y for x, y in inner) and re.match(r"[\w.\s]*=[^=>]", s.slice(i, min(i + 8, f.body[1]))):
                    add("render-purity", f.name, s.tokens[i].text, ["global-assignment"], s.tokens[i].line, s.tokens[i].col)
            nested, _ = L.declarations(s, *f.body)
            for x in nested:
                if re.match(r"[A-Z][a-z]|use[A-Z0-9]", x.name) and x.kind in {"function", "variable"}:
                    add("static-definition", f.name, x.name, ["component" if x.name[0].isupper() else "hook"], x.line, x.col)
    return out


def _nested(s: L.Source, a: int, b: int) -> list[tuple[int, int]]:
    """Bodies of arrow functions and function expressions in a range."""
    out = []
    for i in range(a, b - 1):
        if s.tokens[i].text == "=>":
            j = i + 1
            out.append((j, s.pair[j]) if s.tokens[j].text == "{" else (j, j + 1))
    return out


def hook_violations(s: L.Source, body: tuple[int, int], at: int, callee: str) -> list[str]:
    """conditional, loop, try, nested, after-return, by what stands around the call; use itself may be conditional, in loops and after returns."""
    kinds: set[str] = set()
    for i in range(body[0], at):
        if s.tokens[i].kind == "name" and s.tokens[i].text in {"if", "for", "while", "switch", "try", "else", "do"}:
            head = next((k for k in range(i + 1, min(i + 3, at)) if s.tokens[k].text == "("), None) if s.tokens[i].text not in {"try", "else", "do"} else None
            block = s.pair[head] + 1 if head is not None and head in s.pair else i + 1
            holds = block < len(s.tokens) and s.tokens[block].text == "{" and block < at < s.pair[block]
            if holds:
                kinds.add({"for": "loop", "while": "loop", "do": "loop", "try": "try"}.get(s.tokens[i].text, "conditional"))
            elif s.tokens[i].text in {"if", "switch"} and block < at and (end := s.pair.get(block, block + 1)) <= at and any(s.tokens[k].text == "return" for k in range(block, min(end, at))):
                kinds.add("after-return")
        if s.tokens[i].text in {"&&", "||", "?"} and s.tokens[i].line == s.tokens[at].line:
            kinds.add("conditional")
        if s.tokens[i].text == "=>" and s.tokens[i + 1].text == "{" and i + 1 < at < s.pair[i + 1]:
            kinds.add("nested")
    return sorted(kinds - ({"conditional", "loop", "after-return"} if callee == "use" else set()))


def return_shape(s: L.Source, f: L.Function) -> dict | None:
    """Fields and spreads of the first object literal that a function returns."""
    for i in range(f.body[0], f.body[1] - 1):
        if s.tokens[i].text == "return" and s.tokens[i + 1].text in {"{", "("}:
            j = i + 1 + (s.tokens[i + 1].text == "(")
            if s.tokens[j].text == "{":
                fields, spreads = [], []
                for x, y in L.split_commas(s, j + 1, s.pair[j]):
                    if s.tokens[x].text == "...":
                        if s.tokens[x + 1].text == "{":
                            names = [s.tokens[p].text for p, _ in L.split_commas(s, x + 2, s.pair[x + 1])]
                            fields += names
                            spreads += names
                        else:
                            spreads.append(s.slice(x + 1, y))
                    else:
                        fields.append(s.tokens[x].text)
                return {"function_name": f.name, "fields": fields, "spreads": spreads}
    return None


def return_shapes(path: str, s: L.Source, d: tuple) -> list[dict]:
    found = [(f, x) for f in d[1] if (x := return_shape(s, f)) is not None]
    return [{"path": path, "seq": i, "line": f.line, **x} for i, (f, x) in enumerate(found)]


def function_shapes(path: str, s: L.Source, d: tuple) -> list[dict]:
    """Every function of the module itself with the metrics of its body: nesting by blocks, awaits, tries, boolean parameters."""
    out = []
    for f in d[1]:
        if f.container:
            continue
        m = flow.metrics(s, f.body, f.block)
        parts = L.split_commas(s, *f.params)
        typed = [_typed(s, x, y)[1] for x, y in parts]
        text = " ".join(t or "" for t in typed) + " " + (f.returns or "")
        out.append({
            "path": path, "seq": len(out), "name": f.name, "exported": f.exported, "is_async": f.is_async, "line": f.line, "line_span": f.line_end - f.line + 1,
            "n_params": sum(s.tokens[x].kind == "name" for x, _ in parts), "n_boolean_params": sum(t in ("boolean", "Boolean") for t in typed), "statements": m.all_statements, "max_nesting": m.block_nesting, "branches": m.clauses,
            "loops": m.own_loops, "awaits": m.awaits, "tries": m.tries, "uses_any": bool(re.search(r"\bany\b", text)), "returns": f.returns or None,
        })
    return out


def _effect_statements(s: L.Source, c: L.Call) -> int:
    """Statements of the callback that an effect hook gets."""
    brace = next((k for k in range(*c.args) if s.tokens[k].text == "{" and s.tokens[k - 1].text in {"=>", ")"}), None)
    return flow.metrics(s, (brace + 1, s.pair[brace]), True).all_statements if brace is not None else 0


def react_shapes(path: str, s: L.Source, d: tuple) -> list[dict]:
    """Components: boolean props, properties of the value that a context gets, statements in the longest effect."""
    out = []
    for f in d[1]:
        if f.container or not re.match(r"[A-Z]", f.name):
            continue
        props = s.slice(*f.params)
        value = re.search(r"Provider\s+value=\{\{(.*?)\}\}", s.slice(*f.body), re.S)
        effects = [_effect_statements(s, c) for c in L.calls(s, *f.body) if c.callee.rpartition(".")[2] in {"useEffect", "useLayoutEffect"}]
        out.append({"path": path, "seq": len(out), "name": f.name, "line": f.line, "n_boolean_props": len(re.findall(r"\?*:\s*boolean\b", props)), "n_context_props": len([x for x in value[1].split(",") if x.strip()]) if value else 0, "effect_statements": max(effects, default=0)})
    return out


COLLECTORS: dict[str, Callable[[str, L.Source, tuple], list[dict]]] = {
    "imports": imports, "exports": exports, "items": items, "calls": call_rows, "params": params, "tuple_surfaces": tuple_surfaces, "data_fields": data_fields, "type_aliases": type_aliases,
    "variant_fields": variant_fields, "control_flows": control_flows, "responsibilities": responsibilities, "async_surfaces": async_surfaces, "service_methods": service_methods, "fixtures": fixtures, "signals": signals,
    "function_shapes": function_shapes, "react_shapes": react_shapes, "return_shapes": return_shapes,
}


ALL = ("modules", "diagnostics", *COLLECTORS)
# fixed values: what stands in every text that yields a row of a family, or of a family of signals; names are never split
SIGNS = {"fixtures": ("writeFileSync",), "runtime-call": RUN_METHODS, "promise-interop": ("promise",), "resource-scope": ("acquireRelease",)}
PARTS = 2  # tasks for each shuffle partition of the session


def read_all(path: str, content: str | None, wanted: tuple[str, ...] = ALL) -> dict[str, list[dict]]:
    """Rows of the wanted families for one file, whose text is read into tokens once. Null counts as empty."""
    text = content or ""
    row = {"path": path, "role": None, "layer": None, "is_valid": True, "is_declaration": path.endswith((".d.ts", ".d.mts", ".d.cts")), "n_lines": text.count("\n") + 1, "content_hash": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()}
    row |= {"has_intent_doc": False, "export_names": [], "type_only_export_names": []}
    out: dict[str, list[dict]] = {f: [] for f in wanted}
    notes = []
    note = lambda phase, code, message, category, at: notes.append({"path": path, "phase": phase, "code": code, "message": message, "category": category, "line": getattr(at, "line", 1), "col": getattr(at, "col", 0)})
    try:
        s = L.lex(text, path.endswith((".tsx", ".jsx")))
        d = L.declarations(s)
        names = exports(path, s, d)
        head = s.comments[0] if s.comments else None
        row |= {"has_intent_doc": bool(head and head[0] == 1 and len(re.findall(r"\w{3,}", head[1])) > 2), "export_names": [e["name"] for e in names], "type_only_export_names": [e["name"] for e in names if e["is_type_only"]]}
    except Exception as fault:
        row["is_valid"] = False
        note("syntax", 0, str(fault), "error", fault)
    else:
        for family in wanted:
            if family in COLLECTORS:
                try:
                    out[family] = COLLECTORS[family](path, s, d)
                except Exception as fault:
                    note("extract", 1, f"{family}: {fault!r}", "warning", None)
    return out | {f: x for f, x in (("modules", [row]), ("diagnostics", notes)) if f in wanted}


def read(path: str, content: str | None, family: str) -> list[dict]:
    """Rows of one family for one file."""
    return read_all(path, content, (family,))[family]


def _dealt(source_files: DataFrame) -> DataFrame:
    """Texts by path over a fixed number of tasks: reading them takes far longer than their bytes, which decide how many tasks a scan has and how many adaptive execution leaves."""
    parts = PARTS * int(source_files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return source_files.select("path", "content").repartition(parts, "path")


def facts(source_files: DataFrame, family: str, signal: str | None = None) -> DataFrame:
    """The family's relation, read off ``source_files``; one pass, only path and content are read. Of signals it can be those of one family. A text without a sign that each row's text has (``SIGNS``) is passed over before it is dealt."""
    signs = SIGNS.get(signal or family)
    if signs:
        source_files = source_files.where(reduce(or_, [F.contains("content", F.lit(x)) for x in signs]))
    schema = SCHEMAS[family]
    names = schema.fieldNames()
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True) for r in read(p, c, family)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], arrow)

    found = _dealt(source_files).mapInArrow(run, schema)
    return found.where(F.col("family") == signal) if signal else found


def all_facts(source_files: DataFrame) -> DataFrame:
    """(family, one struct for each family): every fact of every file in one pass; of a row only its family's struct is set. Written once and filtered by family it serves all relations (``family_of``)."""
    schema = T.StructType([T.StructField("family", T.StringType()), *(T.StructField(f, SCHEMAS[f]) for f in ALL)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [{"family": f, f: r} for p, c in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True) for f, found in read_all(p, c).items() for r in found]
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return _dealt(source_files).mapInArrow(run, schema)


def family_of(table: DataFrame, family: str) -> DataFrame:
    """The relation of one family in a table of ``all_facts``."""
    return table.where(F.col("family") == family).select(f"{family}.*")
