"""Pattern queries over syntax rows, exact source, read plans and patch receipts."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators.filters import OPS, Operand, Predicate, Selector, where_all, where_terms

# fixed values: the kinds of items, imports and calls that a catalog asks for
CATALOGS = {
    "declarations": ("function", "class", "interface", "type", "enum", "namespace", "method", "property", "variable"),
    "imports": ("import", "export", "dynamic-import"),
    "calls": ("call", "new"),
}
WINDOW = 40  # lines that are read at once


def syntax_rows(catalog: str, items: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """(path, capture, kind, name, line, line_end, container) of a catalog's captures."""
    none = F.lit(None).cast("string")
    if catalog == "declarations":
        return items.select("path", F.lit("declaration").alias("capture"), "kind", "name", "line", "line_end", "container").where(F.col("kind").isin(*CATALOGS[catalog]))
    if catalog == "imports":
        return imports.select("path", F.lit("source").alias("capture"), "kind", F.col("module_specifier").alias("name"), "line", F.col("line").alias("line_end"), none.alias("container"))
    if catalog == "calls":
        return calls.select("path", F.lit("callee").alias("capture"), F.when(F.col("is_new"), "new").otherwise("call").alias("kind"), F.col("callee").alias("name"), "line", F.col("line").alias("line_end"), F.col("owner").alias("container"))
    raise ValueError(f"unknown catalog {catalog!r}; known: {', '.join(CATALOGS)}")


@dataclass(frozen=True)
class Plan:
    """A compiled pattern query."""

    catalog: str
    kinds: tuple[str, ...] = ()
    predicates: tuple[Predicate, ...] = ()
    terms: tuple[str, ...] = ()
    selector: str | None = None


def run_plan(plan: Plan, items: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows of the catalog within the selector that hold all terms and predicates, by path and line. An expression without a compiled plan is not taken."""
    rows = syntax_rows(plan.catalog, items, imports, calls)
    if plan.selector:
        rows = rows.where(Selector.parse(plan.selector).column())
    if plan.kinds:
        rows = rows.where(F.col("kind").isin(*plan.kinds))
    if plan.terms:
        rows = where_terms(rows, list(plan.terms), ["name", "kind", "capture", "container"])
    return where_all(rows, list(plan.predicates)).orderBy("path", "line", "name")


PLAN_FIELDS = {"id", "catalog", "captures", "kinds", "predicates", "terms", "selector", "expression", "compiled"}
MOST_PLANS = 1_000  # plans of one scan: each is an expression over every row


class BadPlan(ValueError):
    """A plan that can't be run; the text says why."""


def _strings(value: object, name: str) -> tuple[str, ...]:
    if value is None:
        return ()
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise BadPlan(f"{name} must be a list of strings")
    return tuple(value)


def parse_plan(text: str) -> tuple[Plan, tuple[str, ...]]:
    """A plan and its captures from JSON: catalog, captures, kinds, predicates ({op, capture, values}, where a value is a string or {capture}), terms, selector.

    An ``expression`` is taken only beside ``"compiled": true``, that is, with captures, kinds and predicates that stand for it.
    """
    try:
        data = json.loads(text)
    except (TypeError, ValueError):
        raise BadPlan("not JSON") from None
    if not isinstance(data, dict):
        raise BadPlan("not an object")
    if strange := sorted(set(data) - PLAN_FIELDS):
        raise BadPlan(f"unknown field {strange[0]}")
    if data.get("catalog") not in CATALOGS:
        raise BadPlan(f"unknown catalog {data.get('catalog')!r}")
    if data.get("expression") is not None and data.get("compiled") is not True:
        raise BadPlan("an inline expression has no compiled plan")
    predicates = []
    for p in data.get("predicates") or []:
        if not isinstance(p, dict) or p.get("op") not in OPS:
            raise BadPlan(f"unknown predicate {p.get('op') if isinstance(p, dict) else p!r}")
        if p.get("capture") not in ("name", "kind", "capture", "container", "path"):
            raise BadPlan(f"unknown capture {p.get('capture')!r}")
        values = p.get("values")
        if not isinstance(values, list) or not values:
            raise BadPlan("a predicate needs values")
        operands = []
        for v in values:
            if isinstance(v, str):
                operands.append(Operand(v))
            elif isinstance(v, dict) and v.get("capture") in ("name", "kind", "capture", "container", "path"):
                operands.append(Operand(v["capture"], is_capture=True))
            else:
                raise BadPlan("a value is a string or a capture")
        if p["op"] in ("match", "any-match", "not-match"):
            for o in operands:
                try:
                    re.compile(o.value)
                except re.error:
                    raise BadPlan(f"not a pattern: {o.value}") from None
        predicates.append(Predicate(p["op"], p["capture"], tuple(operands)))
    selector = data.get("selector")
    if selector is not None:
        try:
            Selector.parse(selector)
        except (TypeError, ValueError):
            raise BadPlan("not a selector") from None
    return Plan(data["catalog"], _strings(data.get("kinds"), "kinds"), tuple(predicates), _strings(data.get("terms"), "terms"), selector), _strings(data.get("captures"), "captures")


def plan_column(plan: Plan, captures: tuple[str, ...] = ()) -> Column:
    """The one condition that a plan puts on its catalog's rows."""
    held = F.lit(True) if plan.selector is None else Selector.parse(plan.selector).column()
    if captures:
        held = held & F.col("capture").isin(*captures)
    if plan.kinds:
        held = held & F.col("kind").isin(*plan.kinds)
    text = F.lower(F.concat_ws("\n", "name", "kind", "capture", "container"))
    for t in plan.terms:
        held = held & F.contains(text, F.lit(t.lower()))
    for p in plan.predicates:
        held = held & p.column()
    return F.coalesce(held, F.lit(False))


def run_plans(plans: DataFrame, rows: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(hits, errors) of a table of plans (plan string, text string, JSON): hits are the catalogs' rows with the plan they belong to, errors (plan, error) those that can't be run.

    ``rows`` has each catalog's relation. The plans, ``MOST_PLANS`` at most, are read to the driver; each catalog is scanned once for all its plans, and a row is copied once for each plan that takes it.
    """
    spark = plans.sparkSession
    given = plans.select("plan", "text").limit(MOST_PLANS + 1).collect()
    if len(given) > MOST_PLANS:
        raise BadPlan(f"more than {MOST_PLANS} plans")
    good: dict[str, list[tuple[str, Column]]] = {}
    bad: list[tuple[str, str]] = []
    for r in given:
        try:
            plan, captures = parse_plan(r.text)
            good.setdefault(plan.catalog, []).append((r.plan, plan_column(plan, captures)))
        except BadPlan as e:
            bad.append((r.plan, str(e)))
    hits = None
    for catalog, columns in good.items():
        df = rows[catalog].select("path", "capture", "kind", "name", "line", "line_end", "container")
        taken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in columns]), lambda x: x.isNotNull())
        found = df.withColumn("plan", F.explode(taken))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = spark.createDataFrame([], "path string, capture string, kind string, name string, line int, line_end int, container string, plan string")
    return hits, spark.createDataFrame(bad, "plan string, error string")


FLOW_TERMS = ("source.call", "sink.constructs", "scope.fn")  # fixed values: all three are needed


def parse_flow(text: str) -> dict[str, str]:
    """The three terms of a flow query, as name=value, in any order; each once and none empty."""
    out: dict[str, str] = {}
    for word in text.split():
        name, equals, value = word.partition("=")
        if name not in FLOW_TERMS:
            raise BadPlan(f"unknown term {name!r}")
        if not equals or not value:
            raise BadPlan(f"{name} needs a value")
        if name in out:
            raise BadPlan(f"{name} is given twice")
        out[name] = value
    if lacking := [t for t in FLOW_TERMS if t not in out]:
        raise BadPlan(f"{lacking[0]} is missing")
    return out


def flow_query(text: str, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """``flow_lite`` of the terms in ``text``."""
    from factloom.operators.graph import flow_lite

    t = parse_flow(text)
    return flow_lite(functions, calls, t["scope.fn"], t["source.call"], t["sink.constructs"])


def exact_source(files: DataFrame, selector: str) -> DataFrame:
    """(path, start, end, text) of a file's lines."""
    s = Selector.parse(selector)
    text = F.col("content") if s.start is None else S.line_window(F.col("content"), F.lit(s.start), F.lit(s.end))
    n = F.size(S.source_lines(F.col("content")))
    start, end = (F.lit(1), n) if s.start is None else (F.lit(min(s.start, s.end)), F.least(F.lit(max(s.start, s.end)), n))
    return files.where(F.col("path") == s.path).select("path", start.alias("start"), end.alias("end"), text.alias("text"))


def range_windows(ranges: DataFrame, width: int = WINDOW) -> DataFrame:
    """(path, start, end) cut into consecutive windows of ``width`` lines at most."""
    start = F.explode(F.sequence("start", F.greatest("start", "end"), F.lit(width)))
    return ranges.withColumn("from", start).select("path", F.col("from").alias("start"), F.least(F.col("from") + width - 1, "end").alias("end"))


def read_plan(ranges: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """What to read of each range: itself if it is short; of a longer one the short items in it, clipped, or, where there are none, windows. mode is direct or frontier."""
    r = ranges.withColumn("length", F.col("end") - F.col("start") + 1)
    direct = r.where(F.col("length") <= width).select("path", "start", "end", F.lit("direct").alias("mode"))
    long = r.where(F.col("length") > width)
    i = items.where(F.col("line_end") - F.col("line") < width).select("path", "line", "line_end")
    # by bands of lines, so that a file's ranges don't meet all its items
    bands = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    pairs = long.withColumn("band", bands("start", "end")).join(i.withColumn("band", bands("line", "line_end")), ["path", "band"])
    once = F.col("band") == F.floor(F.greatest("line", "start") / width)
    inner = pairs.where((F.col("line") <= F.col("end")) & (F.col("line_end") >= F.col("start")) & once).select("path", F.greatest("line", "start").alias("start"), F.least("line_end", "end").alias("end"), F.struct("start", "end").alias("range"))
    bare = long.join(inner.select("path", F.col("range.start").alias("start"), F.col("range.end").alias("end")).distinct(), ["path", "start", "end"], "left_anti")
    return direct.unionByName(inner.select("path", "start", "end", F.lit("frontier").alias("mode"))).unionByName(range_windows(bare.select("path", "start", "end"), width).withColumn("mode", F.lit("frontier")))


# fixed values
PATCH_OPERATIONS = ("replace", "insert_before", "insert_after")


def patch_dry_run(files: DataFrame, operation: str, selector: str, expected: str, most: int) -> DataFrame:
    """A receipt (path, matches, status, reason) of an edit that is never made: the operation must be known and the expected text lie in the range ``most`` times at most."""
    s = Selector.parse(selector)
    window = S.line_window(F.col("content"), F.lit(s.start), F.lit(s.end)) if s.start is not None else F.col("content")
    n = S.occurrences(window, F.lit(expected))
    reason = F.when(F.lit(operation not in PATCH_OPERATIONS), "unknown operation").when(n == 0, "expected text isn't in the range").when(n > most, "too many matches")
    out = files.where(F.col("path") == s.path).select("path", n.alias("matches"), reason.alias("reason"))
    return out.select("path", "matches", F.when(F.col("reason").isNull(), "ready").otherwise("rejected").alias("status"), "reason")


def patch_receipts(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(edit, path, matches, status, reason) of a table of edits (edit, path, operation, start, end, expected, most), none of which is made.

    An edit is rejected if its operation is unknown, its file isn't there, its lines are reversed or past the file's end, its expected text is missing from them or is
    there more than ``most`` times, or if it shares a line with another edit of the file (both are). Files (path, content) are split once for all their edits; lines are
    compared in order of start with the furthest end before and the next start after, a running window that keeps one row.
    """
    by_file = Window.partitionBy("path").orderBy("start", "end", "edit")
    placed = edits.withColumns({"reach": F.max("end").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), "next": F.lead("start").over(by_file)})
    shared = (F.col("reach") >= F.col("start")) | (F.col("next") <= F.col("end"))
    lines = files.select("path", S.source_lines(F.col("content")).alias("lines"))
    e = placed.withColumn("shared", F.coalesce(shared, F.lit(False))).join(lines, "path", "left")
    n_lines = F.size("lines")
    window = F.array_join(F.slice("lines", F.col("start"), F.least(F.col("end"), n_lines) - F.col("start") + 1), "\n")
    fits = F.col("lines").isNotNull() & (F.col("start") >= 1) & (F.col("end") >= F.col("start")) & (F.col("start") <= n_lines)
    n = F.when(fits, S.occurrences(window, F.col("expected")))
    reason = (
        F.when(~F.col("operation").isin(*PATCH_OPERATIONS), "unknown operation").when(F.col("lines").isNull(), "no such file").when(~fits, "the range isn't in the file")
        .when(n == 0, "expected text isn't in the range").when(n > F.col("most"), "too many matches").when(F.col("shared"), "shares lines with another edit")
    )
    return e.select("edit", "path", n.alias("matches"), reason.alias("reason")).select("edit", "path", "matches", F.when(F.col("reason").isNull(), "ready").otherwise("rejected").alias("status"), "reason")


def projection(items: DataFrame, most: int = 32) -> DataFrame:
    """An outline of each file: its first ``most`` items with id, parent, role, label, depth and fingerprint."""
    w = Window.partitionBy("path").orderBy("line", F.col("container").isNotNull(), "name")
    rows = items.withColumn("node", F.row_number().over(w)).where(F.col("node") <= most)
    parents = rows.where("container IS NULL").groupBy("path", "name").agg(F.min("node").alias("parent")).withColumnRenamed("name", "container")
    label = F.concat_ws(" ", "kind", "name")
    return rows.join(parents, ["path", "container"], "left").select("path", "node", "parent", "kind", label.alias("label"), F.when(F.col("container").isNull(), 0).otherwise(1).alias("depth"), F.when(F.col("is_exported"), "public").otherwise("internal").alias("role"), S.fingerprint16(F.concat_ws(":", "path", "kind", "name")).alias("fingerprint"))
