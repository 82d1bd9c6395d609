"""Every fact family read off source texts. Each supplier is a project of the same hand-written files, its key in paths and
names, so that the lexing passes run at the tables' scale; what each file must yield is stated as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.analogues import table
from factloom.plans.registry import add
from factloom.schemas import SCHEMAS
from factloom.sources import typescript

KEY = "§"
SOURCES = {
    "src/store§.ts": """/** Keeps the rows of a store for later use. */
import { parse§, type Options } from "./parse.js";
import type { Row } from "@scope/rows/deep";
import fs = require("node:fs");
export { parse§ as parser } from "./parse.js";
export * as helpers from "./helpers";
export type { Row as Line } from "./row";
const lazy = () => import("./lazy");
type Far = import("far").Thing;
export function save§(path: string, isForce: boolean, canRetry: true | false, point: [number, string]): [string, number] {
  if (path === "a") { return parse§(path); } else if ("b" === path) { return parse§(path); } else if (path === ("c")) {} else if (path === "d") {}
  const out = [];
  for (const row of rows) { out.push(row); }
  return out;
}
export interface Entry { userId: string; sizeBytes: number; state?: string; readonly tags: string[] }
export type UserId§ = string;
export type Level = number | string;
export type Shape = { kind: "circle"; radiusMs: number; centerId: string } | { kind: "line"; fromPath: string };
export default class Store { private secret = 1; open(name: string) { return new Set(name); } }
export const { one, two: [three] } = lazy();
boot();
""",
    "src/effects§.ts": """import { Effect, Schema } from "effect";
export const load§ = (): Effect.Effect<string, Error, Db> => Effect.promise(async () => { throw new Boom(); });
export async function run§(): Promise<void> {
  Effect.runPromise(load§());
  await Promise.all([a(), b()]);
  for (const x of xs) { await go(x); }
  const d = JSON.parse(text);
  Effect.acquireRelease(open, close);
  Effect.forEach(xs, go);
  fetch("http://x");
}
export function safe§() {
  const u = useQuery({ queryFn: () => Effect.runPromise(load§()) });
  const v = Schema.decode(S)(JSON.parse(t));
  return Effect.all(xs, { concurrency: 3 });
}
export interface Service§ { find(id: string): Effect.Effect<Row, never, Db>; drop: (id: string) => Effect.Effect<void, any> }
""",
    "src/view§.tsx": """export function Panel§(props: { isOpen: boolean; isBig: boolean }) {
  if (props.isOpen) { useEffect(() => { a(); b(); }); }
  const now = Date.now();
  const Inner = () => <b>{now}</b>;
  document.title = "x";
  return <Ctx.Provider value={{ a, b, c }}><p>http://x (y</p></Ctx.Provider>;
}
export function useThing§() {
  for (;;) { useState(1); }
  return { one: 1, ...{ two: 2 }, ...rest };
}
""",
    "tests/store§.test.ts": """import { save§ } from "../src/store§";
function testHelper() { writeFileSync(join(dir, "src", "a.ts"), `line one
line two`); }
test("saves", () => { save§("a", true, false, [1, ""]); });
it("reads", async () => {});
""",
    "src/broken§.ts": "export const a = ;\n",
    "src/plain§.ts": "function hidden() {}\nexport const quiet = 1;\n",
}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    parts = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(t).alias("content")) for p, t in SOURCES.items()])
    rows = table(spark, sf_dir, "supplier").select(k.alias("k"), F.explode(parts).alias("f"))
    filled = lambda c: F.replace(F.col(f"f.{c}"), F.lit(KEY), F.col("k")).alias(c)
    return rows.select(filled("path"), filled("content"), F.lit(0).cast("bigint").alias("mtime_ms"))


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _expected(columns: str, rows: list[tuple]) -> str:
    """SQL of the rows for each supplier, the key filled into texts."""
    names = columns.split()
    values = ", ".join(f"({', '.join(map(_literal, r))})" for r in rows)
    texts = [any(isinstance(r[i], str) for r in rows) for i in range(len(names))]
    picked = ", ".join(f"replace(v.{n}, '{KEY}', k) AS {n}" if t else f"v.{n}" for n, t in zip(names, texts, strict=True))
    return f"SELECT {picked} FROM (SELECT CAST(s_suppkey AS VARCHAR) AS k FROM supplier), (VALUES {values}) v({', '.join(names)})"


def _plain(df: DataFrame, columns: str) -> DataFrame:
    """The columns, arrays joined by commas."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    return df.select(*[(F.array_join(c, ",") if c in arrays else F.col(c)).alias(c) for c in columns.split()])


def family(name: str, columns: str, rows: list[tuple], signal: str | None = None, query: str = "") -> None:
    add(query or f"x_{name}", lambda spark, sf_dir: _plain(typescript.facts(files(spark, sf_dir), name, signal), columns), _expected(columns, rows))


_A, _E, _V, _T, _P = "src/store§.ts", "src/effects§.ts", "src/view§.tsx", "tests/store§.test.ts", "src/plain§.ts"

family("modules", "path is_valid is_declaration has_intent_doc n_lines export_names type_only_export_names", [
    (_A, True, False, True, 23, "parser,helpers,Line,save§,Entry,UserId§,Level,Shape,Store,one,three", "Line,Entry,UserId§,Level,Shape"), (_E, True, False, False, 18, "load§,run§,safe§,Service§", "Service§"), (_V, True, False, False, 12, "Panel§,useThing§", ""), (_T, True, False, False, 6, "", ""),
    ("src/broken§.ts", False, False, False, 2, "", ""), (_P, True, False, False, 3, "quiet", ""),
])
family("diagnostics", "path phase code category line col", [("src/broken§.ts", "syntax", 0, "error", 1, 15)])
family("imports", "path seq module_specifier kind is_type_only line", [
    (_A, 0, "./parse.js", "import", False, 2), (_A, 1, "@scope/rows/deep", "import", True, 3), (_A, 2, "node:fs", "import", False, 4), (_A, 3, "./parse.js", "export", False, 5), (_A, 4, "./helpers", "export", False, 6), (_A, 5, "./row", "export", True, 7),
    (_A, 6, "./lazy", "dynamic-import", False, 8), (_A, 7, "far", "import", True, 9), (_E, 0, "effect", "import", False, 1), (_T, 0, "../src/store§", "import", False, 1),
])
family("exports", "path name kind is_type_only line", [
    (_A, "parser", "reexport", False, 5), (_A, "helpers", "namespace-reexport", False, 6), (_A, "Line", "reexport", True, 7), (_A, "save§", "function", False, 10), (_A, "Entry", "interface", True, 16), (_A, "UserId§", "type", True, 17), (_A, "Level", "type", True, 18), (_A, "Shape", "type", True, 19),
    (_A, "Store", "class", False, 20), (_A, "one", "variable", False, 21), (_A, "three", "variable", False, 21), (_E, "load§", "variable", False, 2), (_E, "run§", "function", False, 3), (_E, "safe§", "function", False, 12), (_E, "Service§", "interface", True, 17), (_V, "Panel§", "function", False, 1),
    (_V, "useThing§", "function", False, 8), (_P, "quiet", "variable", False, 2),
])
family("items", "path name kind is_exported is_private line line_end container", [
    (_A, "lazy", "variable", False, False, 8, 8, None), (_A, "Far", "type", False, False, 9, 9, None), (_A, "save§", "function", True, False, 10, 15, None), (_A, "Entry", "interface", True, False, 16, 16, None), (_A, "userId", "property", True, False, 16, 16, "Entry"), (_A, "sizeBytes", "property", True, False, 16, 16, "Entry"),
    (_A, "state", "property", True, False, 16, 16, "Entry"), (_A, "tags", "property", True, False, 16, 16, "Entry"), (_A, "UserId§", "type", True, False, 17, 17, None), (_A, "Level", "type", True, False, 18, 18, None), (_A, "Shape", "type", True, False, 19, 19, None), (_A, "Store", "class", True, False, 20, 20, None),
    (_A, "secret", "property", False, True, 20, 20, "Store"), (_A, "open", "method", True, False, 20, 20, "Store"), (_A, "one", "variable", True, False, 21, 21, None), (_A, "three", "variable", True, False, 21, 21, None), (_E, "load§", "variable", True, False, 2, 2, None), (_E, "run§", "function", True, False, 3, 11, None),
    (_E, "safe§", "function", True, False, 12, 16, None), (_E, "Service§", "interface", True, False, 17, 17, None), (_E, "find", "method", True, False, 17, 17, "Service§"), (_E, "drop", "property", True, False, 17, 17, "Service§"), (_V, "Panel§", "function", True, False, 1, 7, None), (_V, "useThing§", "function", True, False, 8, 11, None),
    (_T, "testHelper", "function", False, False, 2, 3, None), (_P, "hidden", "function", False, False, 1, 1, None), (_P, "quiet", "variable", True, False, 2, 2, None),
])
family("calls", "path owner callee is_new line", [
    (_A, "save§", "parse§", False, 11), (_A, "save§", "parse§", False, 11), (_A, "save§", "out.push", False, 13), (_A, "open", "Set", True, 20), (_A, None, "require", False, 4), (_A, None, "lazy", False, 21), (_A, None, "boot", False, 22), (_E, "load§", "Effect.promise", False, 2), (_E, "load§", "Boom", True, 2),
    (_E, "run§", "Effect.runPromise", False, 4), (_E, "run§", "load§", False, 4), (_E, "run§", "Promise.all", False, 5), (_E, "run§", "a", False, 5), (_E, "run§", "b", False, 5), (_E, "run§", "go", False, 6), (_E, "run§", "JSON.parse", False, 7), (_E, "run§", "Effect.acquireRelease", False, 8),
    (_E, "run§", "Effect.forEach", False, 9), (_E, "run§", "fetch", False, 10), (_E, "safe§", "useQuery", False, 13), (_E, "safe§", "Effect.runPromise", False, 13), (_E, "safe§", "load§", False, 13), (_E, "safe§", "Schema.decode", False, 14), (_E, "safe§", "JSON.parse", False, 14), (_E, "safe§", "Effect.all", False, 15),
    (_V, "Panel§", "useEffect", False, 2), (_V, "Panel§", "a", False, 2), (_V, "Panel§", "b", False, 2), (_V, "Panel§", "Date.now", False, 3), (_V, "useThing§", "useState", False, 9), (_T, "testHelper", "writeFileSync", False, 2), (_T, "testHelper", "join", False, 2), (_T, None, "test", False, 4), (_T, None, "save§", False, 4),
    (_T, None, "it", False, 5),
])
family("params", "path function_name function_line param_name type_text primitive_type flag_type", [
    (_A, "save§", 10, "path", "string", "string", None), (_A, "save§", 10, "isForce", "boolean", "boolean", "boolean"), (_A, "save§", 10, "canRetry", "true | false", None, "boolean"), (_A, "save§", 10, "point", "[number, string]", None, None), (_A, "open", 20, "name", "string", "string", None),
    (_E, "find", 17, "id", "string", "string", None), (_V, "Panel§", 1, "props", "{ isOpen: boolean; isBig: boolean }", None, None),
])
family("tuple_surfaces", "path function_name surface_name type_text element_types", [(_A, "save§", "point", "[number, string]", "number,string"), (_A, "save§", "return", "[string, number]", "string,number")])
family("data_fields", "path type_kind type_name type_line field_name type_text primitive_type", [
    (_A, "interface", "Entry", 16, "userId", "string", "string"), (_A, "interface", "Entry", 16, "sizeBytes", "number", "number"), (_A, "interface", "Entry", 16, "state", "string", "string"), (_A, "interface", "Entry", 16, "tags", "string[]", None), (_E, "interface", "Service§", 17, "drop", "(id: string) => Effect.Effect<void, any>", None),
])
family("type_aliases", "path alias_name type_text primitive_type line", [
    (_A, "UserId§", "string", "string", 17), (_A, "Level", "number | string", "number | string", 18), (_A, "Shape", '{ kind: "circle"; radiusMs: number; centerId: string } | { kind: "line"; fromPath: string }', None, 19),
])
family("variant_fields", "path union_name variant_name discriminant_name field_name primitive_type line", [
    (_A, "Shape", "circle", "kind", "radiusMs", "number", 19), (_A, "Shape", "circle", "kind", "centerId", "string", 19), (_A, "Shape", "line", "kind", "fromPath", "string", 19),
])
family("control_flows", "path function_name line_span statements branches loops max_nesting max_literal_chain manual_transform_loops max_block_statements", [
    (_A, "save§", 6, 10, 4, 1, 4, 4, 1, 4), (_A, "open", 1, 1, 0, 0, 0, 0, 0, 1), (_E, "load§", 1, 1, 0, 0, 0, 0, 0, 1), (_E, "run§", 9, 8, 0, 1, 1, 0, 0, 7), (_E, "safe§", 5, 3, 0, 0, 0, 0, 0, 3), (_V, "Panel§", 7, 8, 1, 0, 1, 0, 0, 5), (_V, "useThing§", 4, 3, 0, 1, 1, 0, 0, 2),
])
family("responsibilities", "path kind name line_span", [
    (_A, "variable", "lazy", 1), (_A, "type", "Far", 1), (_A, "function", "save§", 6), (_A, "interface", "Entry", 1), (_A, "type", "UserId§", 1), (_A, "type", "Level", 1), (_A, "type", "Shape", 1), (_A, "class", "Store", 1), (_A, "variable", "one", 1), (_A, "variable", "three", 1), (_A, "call", "require", 1), (_A, "call", "boot", 1),
    (_E, "variable", "load§", 1), (_E, "function", "run§", 9), (_E, "function", "safe§", 5), (_E, "interface", "Service§", 1), (_V, "function", "Panel§", 7), (_V, "function", "useThing§", 4), (_T, "function", "testHelper", 2), (_T, "call", "test", 1), (_T, "call", "save§", 1), (_T, "call", "it", 1), (_P, "function", "hidden", 1), (_P, "variable", "quiet", 1),
])
family("async_surfaces", "path name is_async returns_promise returns_effect error_text error_kind requirements", [(_E, "load§", False, False, True, "Error", "weak", "Db"), (_E, "run§", True, True, False, None, None, None)])
family("service_methods", "path container_kind container_name method_name requirements error_kind", [(_E, "interface", "Service§", "find", "Db", "none"), (_E, "interface", "Service§", "drop", "never", "weak")])
family("fixtures", "path fixture_path line line_end", [(_T, "src/a.ts", 2, 3)])
for _name, _rows in {
    "runtime-call": [(_E, "run§", "Effect.runPromise", "", 4), (_E, "safe§", "Effect.runPromise", "query-hook", 13)], "promise-interop": [(_E, "load§", "Effect.promise", "async-callback,throws", 2)], "resource-scope": [(_E, "run§", "Effect.acquireRelease", "", 8)],
    "concurrency": [(_E, "run§", "Promise.all", "promise-combinator", 5), (_E, "run§", "Effect.forEach", "unbounded-collection", 9), (_E, "run§", "for", "await-in-loop", 6)], "schema-boundary": [(_E, "run§", "JSON.parse", "unvalidated-json", 7)],
    "production-boundary": [(_E, "load§", "Effect.promise", "observability,resilience", 2), (_E, "run§", "fetch", "observability,resilience", 10)], "render-purity": [(_V, "Panel§", "Date.now", "impure-call", 3), (_V, "Panel§", "document", "global-assignment", 5)],
    "hook-call": [(_V, "Panel§", "useEffect", "conditional", 2), (_V, "useThing§", "useState", "loop", 9)], "static-definition": [(_V, "Panel§", "Inner", "component", 4)],
}.items():
    family("signals", "path owner_name callee kinds line", _rows, _name, "x_" + _name.replace("-", "_"))
family("function_shapes", "path name exported is_async n_params n_boolean_params statements max_nesting branches loops awaits returns", [
    (_A, "lazy", False, False, 0, 0, 0, 1, 0, 0, 0, None), (_A, "save§", True, False, 4, 1, 15, 3, 4, 1, 0, "[string, number]"), (_E, "load§", True, False, 0, 0, 0, 1, 0, 0, 0, "Effect.Effect<string, Error, Db>"), (_E, "run§", True, True, 0, 0, 9, 3, 0, 1, 2, "Promise<void>"), (_E, "safe§", True, False, 0, 0, 3, 2, 0, 0, 0, None),
    (_V, "Panel§", True, False, 1, 0, 7, 3, 1, 0, 0, None), (_V, "useThing§", True, False, 0, 0, 4, 3, 0, 1, 0, None), (_T, "testHelper", False, False, 0, 0, 1, 2, 0, 0, 0, None), (_P, "hidden", False, False, 0, 0, 0, 1, 0, 0, 0, None),
])
family("react_shapes", "path name n_boolean_props n_context_props effect_statements", [(_V, "Panel§", 2, 3, 2)])
family("return_shapes", "path function_name fields spreads line", [(_V, "useThing§", "one,two", "two,rest", 8)])


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.plans import project

    c = project.build(files(spark, sf_dir), keep=False)
    return c["edges"].select("from_path", "to_path", "module_specifier", "resolution")


add("x_import_edges", _edges, _expected("from_path to_path module_specifier resolution", [
    (_A, None, "./parse.js", "unresolved"), (_A, None, "@scope/rows/deep", "external"), (_A, None, "node:fs", "external"), (_A, None, "./parse.js", "unresolved"), (_A, None, "./helpers", "unresolved"), (_A, None, "./row", "unresolved"), (_A, None, "./lazy", "unresolved"), (_A, None, "far", "external"),
    (_E, None, "effect", "external"), (_T, "src/store§.ts", "../src/store§", "relative"),
]))
