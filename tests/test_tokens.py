"""Families as plans over tokens beside the extractor, which reads each text by itself."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.plans import catalog, project
from factloom.plans.source_queries import SOURCES
from factloom.sources import tokens as K
from factloom.sources import typescript

MORE = {
    "src/more.ts": """#!/usr/bin/env node
import def, { type A, type B } from "m1"
import * as all from 'm2'
import "m3"
import type Only from "m4"
import type, { x } from "m5";
import old = require("m6");
export * from "m7"
export type * as T from "m8"
export { a, type b as c }
export const { p, q: { r }, ...rest } = f(), other = 2
export default async function () { await g(`a ${h(1)} b`) }
declare module "far" { }
const re = /[/"(]import\\(/g, z = a / b / c
abstract class Q<T extends A> extends R<T> { private x = make(); static async go(y = 1): Promise<void> { this.x.run(new Map<string, number>()); } get v() { return 1 } }
const enum E { One, Two }
type F = { m(x: number): string } | typeof import("m9")
let late = async () => {
  const m = await import('m10')
  if (m) { m.default?.start() } else { call(x => y(x)) }
}
export = late
""",
    "src/empty.ts": "",
}
NESTED = {
    "src/nested.tsx": """export function Board({ id, isOpen }: Props) {
  const q = useQuery({ queryKey: [id], queryFn: () => Effect.runPromise(load(id)) });
  if (!isOpen) return null;
  const late = useMemo(() => 1, []);
  const both = isOpen && useFlag("x");
  try { useRisky(); } catch { use(thing); }
  while (isOpen) { useState(0); }
  const onClick = () => { window.name = "y"; Math.random(); useNothing(); };
  if (isOpen == 1) { localStorage.last = id; } else { useElse(); }
  const at = new Date();
  function useInner() { return 1 }
  return <b onClick={onClick}>{q.data}</b>;
}
function Hidden() { const n = Math.random(); if (n) { useState(n); } }
export const useAll = () => {
  switch (mode) { case 1: useReducer(r, {}); }
  if (a) { return 1; }
  useRef(null);
  return React.useId();
};
""",
    "src/loops.ts": """export async function walk(xs: string[], appRuntime: R) {
  for await (const x of stream(xs)) { if (x) { await go(x); } }
  const body = await res.json();
  await Promise.allSettled(xs.map(f));
  return appRuntime.runFork(Effect.withSpan("walk")(Effect.tryPromise(() => fetch(body))));
}
class Loader {
  open() { return Effect.scoped(Effect.acquireRelease(a, b)); }
  leak() { return Effect.acquireRelease(a, b); }
  both() { return Effect.promise(() => { if (x) { throw y; } return Promise.reject(z); }); }
  fine() { return Effect.promise(() => get()).pipe(Effect.retry(3), Effect.log("x")); }
  many() { return Effect.forEach(xs, f, { concurrency: "unbounded" }); }
  each() { return Effect.validateAll(xs, (x) => Schema.decodeUnknown(S)(JSON.parse(x))); }
}
""",
}


def _rows(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(p.replace("§", "1"), t.replace("§", "1"), "x") for p, t in {**SOURCES, **MORE}.items() if "broken" not in p]
    return spark.createDataFrame([*rows, ("src/null.ts", None, "x")], "path string, content string, line string")


@pytest.fixture(scope="module")
def found(texts):
    return K.tokens(texts).cache()


@pytest.mark.parametrize("family, columns, where", [
    ("imports", ["path", "seq", "module_specifier", "kind", "is_type_only", "line"], "true"), ("exports", ["path", "name", "kind", "is_type_only", "line"], "kind <> 'export-assignment'"),
    ("items", ["path", "name", "kind", "is_exported", "line", "line_end"], "container IS NULL"), ("calls", ["path", "owner", "callee", "is_new", "line"], "true"),
])
def test_agrees_with_the_extractor(texts, found, family, columns, where):
    ours, theirs = _rows(K.FAMILIES[family](found), columns), _rows(typescript.facts(texts.select("path", "content"), family).where(where), columns)
    assert (ours - theirs, theirs - ours) == (Counter(), Counter())


def test_signals_agree_with_the_extractor(spark):
    rows = [(p.replace("§", "1"), t.replace("§", "1")) for p, t in {**SOURCES, **NESTED}.items()]
    files = spark.createDataFrame(rows, "path string, content string")
    joined = lambda df: df.withColumn("kinds", F.array_join("kinds", ","))
    columns = ["path", "family", "owner", "callee", "kinds", "line"]
    ours, theirs = _rows(joined(K.signals(K.tokens(files))), columns), _rows(joined(typescript.facts(files, "signals").withColumnRenamed("owner_name", "owner")), columns)
    assert len(ours) > 30 and (ours - theirs, theirs - ours) == (Counter(), Counter())


def test_loops_that_await(spark):
    """Functions inside a loop are not entered; any form of loop counts, and each that holds the await."""
    text = """export async function walk(xs) {
  for (const x of xs) { xs.map(async y => { await go(y); }); }
  do { await tick(); } while (more());
  while (a) { for (;;) { await b(); } }
  xs.forEach(async x => { for (const y of x) { await c(y); } });
}
"""
    rows = K.signals(K.tokens(spark.createDataFrame([("p", text)], "path string, content string"))).collect()
    assert sorted((r.callee, r.line) for r in rows) == [("do", 3), ("for", 4), ("for", 5), ("while", 4)]


def test_a_project_can_take_its_facts_from_tokens(spark, texts):
    files = texts.select("path", "content").withColumn("mtime_ms", F.lit(0).cast("bigint"))
    rules, names = ["TS-EXT-EFFECT-R001", "TS-EXT-EFFECT-R006", "TS-EXT-REACT-R002"], ["path", "rule_id", "line", "summary"]
    manifest = '{"dependencies": {"effect": "3", "react": "19"}}'
    by_tokens, by_extractor = (_rows(project.check(project.build(files, manifest, "{}", by_tokens=b), rules=rules), names) for b in (True, False))
    assert by_tokens and by_tokens == by_extractor


def test_tokens_keep_every_sign_but_space_and_comments(spark):
    text = "a /* ( */ .b(`x ${ `y` } z`, \"// no\", /[(]/) // {\n}"
    rows = K.tokens(spark.createDataFrame([("p", text)], "path string, content string")).orderBy("at").collect()
    assert [r.text for r in rows] == ["a", ".", "b", "(", "`x ${ `y` } z`", ",", '"// no"', ",", "/[(]/", ")", "}"]
    assert [r.line for r in rows] == [1] * 10 + [2] and [r.depth for r in rows if r.text in "()"] == [0, 0]


def test_long_texts_end(spark):
    n = 300_000
    texts = ['f("' + "\\n" * n + '");', "f(`" + "${a}" * n + "`);", "a" + ".b" * n + "(1);", "f(1); /*" + "*" * n + "*/", "f(" + "(" * n + ")" * n + ");", "f(/" + "[a]" * n + "/);", "f<" + "A, " * n + "B>(1);", "f('" + "x" * n]
    files = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, content string")
    called = Counter(r.path for r in K.calls(K.tokens(files)).collect())
    assert called == Counter({f"p{i}": 1 for i in range(8)})


def test_empty_table(spark):
    nothing = K.tokens(spark.createDataFrame([], "path string, content string"))
    assert all(family(nothing).count() == 0 for family in K.FAMILIES.values())


def test_tokens_are_written_once(spark, texts):
    facts = K.facts(texts)
    assert "facts-" in facts["tokens"].inputFiles()[0] and facts["imports"].count() == K.imports(K.tokens(texts)).count()


def test_methods_of_objects_are_no_calls(spark):
    files = spark.createDataFrame([("p", "const o = { method(x) { return inner(x) }, async other() {}, plain: outer(2) };")], "path string, content string")
    assert sorted(r.callee for r in K.calls(K.tokens(files)).collect()) == ["inner", "outer"]


def test_one_exchange(spark):
    files = spark.range(9).selectExpr("'p' || id AS path", "'f(' || id || ')' AS content")
    plan = K.calls(K.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Python" not in plan


@pytest.mark.parametrize("family", ["items", "calls", "flow_counts", "signals"])
def test_no_token_is_exchanged(spark, family):
    files = spark.createDataFrame([("p", "f();")], "path string, content string")
    plan = K.FAMILIES[family](K.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange " not in plan[: plan.index("Generate ")]  # texts are dealt before they are cut


@pytest.mark.parametrize("name", ["t_imports", "t_exports", "t_items", "t_flow_counts", "t_runtime_calls", "t_combinators", "t_signals"])
def test_lines_are_dealt_once(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count("FileScan ")  # lines are dealt, neither their texts nor their tokens


def test_windows_that_do_not_build_on_each_other_are_one(spark):
    files = spark.createDataFrame([("p", "f();")], "path string, content string")
    plan = K.calls(K.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert sum(line.lstrip(" :+-*(0123456789)").startswith("Window ") for line in plan.splitlines()) <= 5


@pytest.mark.parametrize("family", ["imports", "exports"])
def test_tokens_are_cut_once(spark, family):
    files = spark.createDataFrame([("p", "f();")], "path string, content string")
    plan = K.FAMILIES[family](K.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_a_task_has_bounded_texts(spark):
    """However few partitions a session has."""
    texts = spark.range(1000).selectExpr("'p' || id AS path", "repeat('f();', 10000) AS content")  # 40 MB
    assert K.tokens(texts).select("path").rdd.getNumPartitions() <= 32 < K.dealt(texts, 40 * F.octet_length("content")).rdd.getNumPartitions() == 763
    nothing = texts.where("id < 0")
    assert K.dealt(nothing, F.octet_length("content")).rdd.getNumPartitions() == 32


def test_parsed_json_is_held_beside_decoding_in_one_pass(spark, sf_dir):
    plan = catalog.QUERIES["t_unvalidated_json"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan ") == plan.count("Generate ") == 1 and "Join" not in plan
    text = "JSON.parse(a); function f() { JSON.parse(b); x.json(); } function g() { Schema.decode(S)(JSON.parse(c)); }"
    called = K.calls(K.tokens(spark.createDataFrame([("p", text), ("q", "Schema.is(S); JSON.parse(a);")], "path string, content string")))
    assert sorted((r.path, r.owner or "", r.callee) for r in K.unvalidated_json(called).collect()) == [("p", "", "JSON.parse"), ("p", "f", "JSON.parse"), ("p", "f", "x.json")]


def test_tokens_and_what_is_near_are_one_window(spark):
    files = spark.createDataFrame([("p", "f();")], "path string, content string")
    windows = lambda df: sum(line.lstrip(" :+-*(0123456789)").startswith("Window ") for line in df._jdf.queryExecution().executedPlan().toString().splitlines())
    found = K.tokens(files)
    assert windows(found) == 1 and windows(K.calls(found)) <= 4 and windows(K.imports(found)) <= 4


def test_comments_and_type_arguments_lie_in_a_piece_with_their_token(spark):
    text = "/* a\n */ // b\n f<A,\n B<C>>(x) /* c */ . y;\n<b>'tis so</b>; x = /[<]/g // end\n"
    rows = K.tokens(spark.createDataFrame([("p", text), ("q", " // only\n")], "path string, content string")).orderBy("at").collect()
    assert [(r.text, r.line) for r in rows] == [("f", 3), ("(", 4), ("x", 4), (")", 4), (".", 4), ("y", 4), (";", 4), ("<", 5), ("b", 5), (">", 5), ("'tis so", 5), (";", 5), ("x", 5), ("=", 5), ("/[<]/g", 5)]
    assert rows[-1].next is None and [r.prev_line for r in rows[:3]] == [None, 3, 4]


def test_signals_sort_by_depth_once(spark):
    files = spark.createDataFrame([("p", "f();")], "path string, content string")
    plan = K.signals(K.tokens(files))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 6 and plan.count("depth") and sum("Sort [" in x and "depth" in x for x in plan.splitlines()) == 1


def test_a_return_behind_brackets_and_loops_inside_callbacks(spark):
    text = """export const useA = (x) => {
  if (x) return 1;
  useB();
  for (const y of x) { xs.map(async () => { while (y) { await g(); } }); }
  return useQuery({ queryFn: function () { for (const z of x) { Effect.runPromise(z); } await k(); } });
};
"""
    rows = K.signals(K.tokens(spark.createDataFrame([("p", text)], "path string, content string"))).collect()
    assert sorted((r.family, r.callee, ",".join(r.kinds), r.line) for r in rows) == [("concurrency", "while", "await-in-loop", 4), ("hook-call", "useB", "after-return", 3), ("hook-call", "useQuery", "after-return", 5), ("runtime-call", "Effect.runPromise", "query-hook", 5)]


def test_texts_made_of_rows_are_made_once(spark, sf_dir):
    plan = catalog.QUERIES["t_items"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("export async function f") == 1
