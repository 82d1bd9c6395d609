"""A small project from texts to findings, searches and plans."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import patterns, rules, search, verify
from factloom.operators.filters import Operand, Predicate
from factloom.plans import project
from factloom.schemas import relation
from factloom.sources import candidates, files, lexer, sinks, typescript
from factloom.streaming import incremental

SOURCES = {
    "src/index.ts": '/** The package entry point. */\nexport * from "./store";\nexport { parseConfig } from "./config/parse.js";\n',
    "src/store.ts": 'import { parseConfig } from "./config/parse";\nimport gone from "./gone";\nimport fs from "node:fs";\nexport function saveStore(path: string, isForce: boolean, canRetry: boolean) { return parseConfig(path); }\nexport interface Row { userId: string; filePath: string; sizeBytes: number; state: string }\n',
    "src/config/parse.ts": "export function parseConfig(text: string): [string, number] { return [text, 1]; }\nexport type UserId = string;\n",
    "src/lonely.ts": "export const alone = 1;\n",
    "tests/store.test.ts": 'import { saveStore } from "../src/store";\ntest("saves", () => { saveStore("a", true, false); });\n',
    "src/broken.ts": "export function (",
}
MANIFEST = json.dumps({"name": "demo", "main": "./dist/index.js", "exports": {".": {"import": "./dist/index.js", "types": "./dist/none.d.ts"}}, "scripts": {"test": "node --test"}, "dependencies": {"lodash": "^4"}})


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(p, t, i) for i, (p, t) in enumerate(SOURCES.items())]
    c = project.build(spark.createDataFrame(rows, "path string, content string, mtime_ms long"), MANIFEST, '{"compilerOptions": {"outDir": "dist", "rootDir": "src"}} // note')
    for name in ("modules", "edges", *project.FAMILIES):  # small and asked for often
        c.relations[name] = spark.createDataFrame(c[name].collect(), c[name].schema).coalesce(1)
    return c


def test_roles_and_validity(catalog):
    got = {r.path: (r.role, r.is_valid) for r in catalog["modules"].collect()}
    assert got == {"src/index.ts": ("facade", True), "src/store.ts": ("source", True), "src/config/parse.ts": ("source", True), "src/lonely.ts": ("source", True), "tests/store.test.ts": ("test", True), "src/broken.ts": ("source", False)}


def test_edges(catalog):
    got = {(r.from_path, r.module_specifier): (r.to_path, r.resolution) for r in catalog["edges"].collect()}
    assert got["src/index.ts", "./config/parse.js"] == ("src/config/parse.ts", "relative")
    assert got["src/store.ts", "./gone"] == (None, "unresolved")
    assert got["src/store.ts", "node:fs"] == (None, "external")
    assert got["tests/store.test.ts", "../src/store"] == ("src/store.ts", "relative")


def test_findings(catalog):
    got = {(r.rule_id, r.path) for r in project.check(catalog).collect()}
    assert ("TS-SYN-R001", "src/broken.ts") in got
    assert ("TS-AGENT-POLICY-001", "src/store.ts") in got
    assert ("TS-AGENT-POLICY-002", "package.json") in got
    assert ("TS-AGENT-POLICY-004", "src/store.ts") in got
    assert ("TS-AGENT-POLICY-006", "src/config/parse.ts") in got
    assert ("TS-AGENT-POLICY-009", "src/store.ts") in got
    assert ("TS-AGENT-POLICY-010", "src/config/parse.ts") in got
    assert ("TS-AGENT-POLICY-011", "src/store.ts") in got
    assert ("TS-AGENT-PROJECT-005", "tsconfig.json") in got
    assert not any(r == "TS-MOD-R001" for r, _ in got)


def test_policy_config(catalog):
    h = project.Settings().with_disabled_packs("agent-policy").with_rule_severity("TS-SYN-R001", "info").with_disabled_rules("TS-AGENT-PROJECT-005")
    found = project.check(catalog, h)
    assert {r.rule_id for r in found.collect()} == {"TS-SYN-R001"}
    project.assert_clean(found, h)
    with pytest.raises(project.NotClean):
        project.assert_agent_clean(found)
    with pytest.raises(project.NotClean):
        project.assert_clean(project.check(catalog))


def test_views(catalog):
    hits = search.search(catalog, "symbol", "parseConfig")["hits"].collect()
    assert hits[0].score == 10
    tests = search.search(catalog, "tests", "src/config/parse.ts")["edges"].collect()
    assert [(r.reason, r.depth) for r in tests] == [("transitive-import", 2)]
    lexical = search.search(catalog, "lexical", "saveStore")["hits"].collect()
    assert lexical[0].path in {"src/store.ts", "tests/store.test.ts"}
    piped = search.search(catalog, "lexical", "saveStore", pipes=("tests",))
    assert piped["hits"].collect() == lexical and ("src/store.ts", "tests/store.test.ts", "direct-import") in {(r.target, r.test_path, r.reason) for r in piped["tests"].collect()}
    owner = search.search(catalog, "owner", "src/store")
    assert owner["owners"].first().path == "src/store.ts"
    assert {r.direction for r in owner["edges"].collect()} == {"in", "out"}
    assert search.search(catalog, "import", "./gone")["hits"].count() == 1
    assert search.search(catalog, "policy", "flag parameters")["hits"].first().rule_id == "TS-AGENT-POLICY-004"
    assert search.search(catalog, "api", "saveStore")["hits"].first().score == 12
    assert search.search(catalog, "runtime-source", "x")["facts"].count() == 0
    assert search.search(catalog, "prime")["owners"].first().rank >= 100
    with pytest.raises(ValueError, match="unknown view"):
        search.search(catalog, "nothing")


def test_query_set_prefers_covering_owners(catalog):
    packet = search.search(catalog, "lexical", "", query_set=["saveStore", "parseConfig"])
    assert packet["hits"].first().owner_path == "src/store.ts"
    assert {r.term: r.status for r in packet["coverage"].collect()} == {"saveStore": "hit", "parseConfig": "hit"}


def test_pattern_query(catalog):
    plan = patterns.Plan("declarations", ("function",), (Predicate("match", "name", (Operand("^parse"),)),), selector="src")
    rows = patterns.run_plan(plan, catalog["items"], catalog["imports"], catalog["calls"]).collect()
    assert [(r.path, r.name) for r in rows] == [("src/config/parse.ts", "parseConfig")]


def test_exact_source_and_patch(catalog):
    r = patterns.exact_source(catalog["source_files"], "src/index.ts:2:1").first()
    assert (r.start, r.end) == (1, 2)
    assert r.text.endswith('"./store";')
    assert patterns.patch_dry_run(catalog["source_files"], "replace", "src/index.ts", "export", 5).first().status == "ready"
    assert patterns.patch_dry_run(catalog["source_files"], "replace", "src/index.ts", "export", 1).first().reason == "too many matches"
    assert patterns.patch_dry_run(catalog["source_files"], "burn", "src/index.ts", "export", 5).first().status == "rejected"


def test_read_windows(spark, catalog):
    r = spark.createDataFrame([("a", 1, 100), ("b", 5, 9)], "path string, start int, end int")
    got = sorted(map(tuple, patterns.read_plan(r, catalog["items"]).collect()))
    assert got == [("a", 1, 40, "frontier"), ("a", 41, 80, "frontier"), ("a", 81, 100, "frontier"), ("b", 5, 9, "direct")]


def test_verification(spark, catalog):
    hints = relation(spark, "profile_hints", [
        {"seq": 1, "owner_path": "src/store.ts", "responsibilities": ["public_api", "persistence"]}, {"seq": 2, "owner_path": "src/none.ts", "responsibilities": ["public_api"]}, {"seq": 3, "owner_path": "src/lonely.ts", "responsibilities": ["pure_domain_logic"]},
        {"seq": 4, "owner_path": "src/index.ts", "responsibilities": ["public_api"], "task_kinds": ["security"]},
    ])
    tasks = verify.plan(hints, catalog["modules"])
    kinds = {(r.owner_path, r.kind): r for r in tasks.collect()}
    assert set(kinds) == {("src/store.ts", "chaos"), ("src/store.ts", "stress"), ("src/none.ts", "review"), ("src/index.ts", "review")}
    t = kinds["src/store.ts", "stress"]
    assert t.fingerprint == verify.fingerprint_of({"kind": "stress", "owner": "src/store.ts", "responsibilities": "persistence,public_api"})
    receipts = relation(spark, "receipts", [{"seq": 1, "kind": "stress", "owner_path": "src/store.ts", "fingerprint": t.fingerprint, "status": "passed"}, {"seq": 2, "kind": "stress", "owner_path": "src/store.ts", "fingerprint": t.fingerprint, "status": "failed"}])
    chaos = kinds["src/store.ts", "chaos"]
    waiver = {"seq": 1, "kind": "chaos", "owner_path": "src/store.ts", "fingerprint": chaos.fingerprint, "owner": "me", "reason": "later"}
    state = lambda w: {r.kind: (r.state, r.note) for r in verify.resolved(tasks, receipts, relation(spark, "waivers", [w])).where("owner_path = 'src/store.ts'").collect()}
    assert state(waiver) == {"stress": ("satisfied", None), "chaos": ("pending", "waiver is incomplete")}
    assert state(waiver | {"expires_at": "2000-01-01"})["chaos"] == ("waived", None)


def test_incremental(spark, catalog):
    before = incremental.snapshot_of(catalog["source_files"])
    changed = catalog["source_files"].where("path != 'src/lonely.ts'").withColumn("content", F.when(F.col("path") == "src/index.ts", F.lit("export {};")).otherwise(F.col("content")))
    after, changes = incremental.update(changed, before)
    assert {r.path: r.change for r in changes.collect()} == {"src/index.ts": "changed", "src/lonely.ts": "removed"}
    assert incremental.reuse_stats(before, after).first().asDict() == {"n_files": 5, "n_reused": 3, "n_read": 2}
    full = incremental.snapshot_of(changed)
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, full.collect()))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"path": "x.ts", "content": "export const a = 1;", "mtime_ms": 1000}) + "\n")
    got = []
    q = incremental.stream_facts(spark.readStream.schema("path string, content string, mtime_ms long").json(str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.path for r in got] == ["x.ts"]


def test_snapshot_cache(spark, tmp_path, catalog):
    assert sinks.read_snapshot(spark, str(tmp_path / "none")).count() == 0
    assert sinks.write_modules(incremental.snapshot_of(catalog["source_files"]), str(tmp_path / "s"))
    assert sinks.read_snapshot(spark, str(tmp_path / "s")).count() == 5
    assert not sinks.write_modules(incremental.snapshot_of(catalog["source_files"]).where("NOT is_valid"), str(tmp_path / "t"))


def test_renderers(catalog):
    found = project.check(catalog)
    assert any("TS-SYN-R001" in r.line for r in sinks.advice(found).collect())
    assert json.loads(sinks.packet_json(search.search(catalog, "symbol", "parse"), "symbol"))["view"] == "symbol"
    assert sinks.compact_lines(catalog["params"], "param").first().line.startswith("param path=")
    assert any(r.line.startswith("- src/index.ts [facade]") for r in sinks.tree_snapshot(search.branches(catalog), catalog["edges"]).collect())
    assert sinks.tokenize_command("a 'b c' \"d e\"") == ["a", "b c", "d e"]


def test_scan(spark, tmp_path):
    for p in ("src/a.ts", "src/b.txt", "node_modules/x.ts", ".hid/c.ts", "src/d.tsx"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("export {};")
    assert sorted(r.path for r in files.scan(spark, str(tmp_path)).collect()) == ["src/a.ts", "src/d.tsx"]


def test_workspaces(spark):
    d = spark.createDataFrame([("packages/a",), ("packages/a/b",), ("apps/x",), ("packages",)], "path string")
    assert {(r.path, r.pattern) for r in files.expand_workspaces(d, ["packages/*", "packages/**", "!apps/*"]).collect()} == {("packages/a", "packages/*"), ("packages/a/b", "packages/**")}
    assert files.yaml_packages("packages:\n  - 'a/*'\n  - b # c\nother: 1\n") == ["a/*", "b"]


@pytest.mark.parametrize(("text", "fmt"), [("a\0b", "path-list-nul"), ('{"type":"match"}', "rg-json"), ("diff --git a/x b/y", "diff-paths"), ("a.ts:1:2:x", "vimgrep"), ("a.ts:1:x", "rg-n"), ("src/a.ts", "path-list"), ("what", "unknown")])
def test_detect(spark, text, fmt):
    assert candidates.detect(text, {"src/a.ts"}) == fmt
    rows = spark.createDataFrame([(0, text)], "seq long, line string")
    assert candidates.detect_rows(rows, spark.createDataFrame([("src/a.ts",)], "path string")).first().format == fmt


def test_ingest_knows_every_path_of_a_large_project(spark):
    files = spark.range(0, 12_000, 1, 1).selectExpr("concat('src/f', id, '.ts') AS path", "'' AS content", "id AS mtime_ms")
    c = rules.Catalog(spark, {"source_files": files})
    got = search.search(c, "ingest", stream="src/f11999.ts\nno such line\n")["hits"].collect()
    assert [(r.path, r.reason) for r in got] == [("src/f11999.ts", "path-list"), ("no such line", "path-list")]
    assert search.search(c, "ingest", stream="what\nno such line")["hits"].count() == 0


def test_parse_streams(spark):
    rows = lambda *x: spark.createDataFrame(list(enumerate(x)), "seq long, line string")
    got = lambda fmt, *x: [tuple(r)[1:5] for r in candidates.parse(rows(*x), fmt).orderBy("seq").collect()]
    assert got("vimgrep", "./a.ts:3:7:let x", "nonsense") == [("a.ts", 3, 7, "let x")]
    assert got("rg-n", "a.ts:3:let x") == [("a.ts", 3, None, "let x")]
    assert got("diff-paths", "diff --git a/x.ts b/y.ts", "+++") == [("y.ts", None, None, None)]
    match = json.dumps({"type": "match", "data": {"path": {"text": "a.ts"}, "line_number": 4, "submatches": [{"start": 2}], "lines": {"text": "ab\n"}}})
    assert got("rg-json", match, "{broken", '{"type":"end"}') == [("a.ts", 4, 3, "ab")]


def test_lexer_faults():
    with pytest.raises(lexer.SyntaxFault):
        lexer.lex("function (")
    assert [t.text for t in lexer.lex("a = /x[/]y/g / 2; `t ${`u`} v`").tokens][2] == "/x[/]y/g"


def test_control_flow_metrics():
    text = 'export function f(x: string) { const out = []; for (const a of b) { out.push(a); } if (x === "a") { } else if (x === "b") { } else if (x === "c") { } return out; }'
    r = typescript.read("a.ts", text, "control_flows")[0]
    assert (r["loops"], r["max_literal_chain"], r["manual_transform_loops"], r["max_nesting"]) == (1, 3, 1, 3)  # an else-if lies in its if


@pytest.mark.parametrize(("field", "at", "fires"), [("max_nesting", 5, True), ("max_nesting", 4, False), ("max_literal_chain", 4, True), ("max_literal_chain", 3, False), ("branches", 12, True), ("branches", 11, False)])
def test_flow_thresholds(spark, field, at, fires):
    base = {"path": "a.ts", "seq": 0, "function_name": "f", "line_span": 1, "statements": 1, "branches": 0, "loops": 0, "max_nesting": 0, "max_literal_chain": 0, "manual_transform_loops": 0, "max_block_statements": 1, "line": 1, "col": 0}
    c = rules.Catalog(spark, {"modules": relation(spark, "modules", [{"path": "a.ts", "role": "source", "is_valid": True}]), "control_flows": relation(spark, "control_flows", [base | {field: at}])})
    assert (rules.evaluate(c, ["TS-AGENT-POLICY-007"]).count() > 0) == fires


def test_effect_rules_need_the_extension(spark):
    signal = relation(spark, "signals", [{"path": "a.ts", "seq": 0, "family": "concurrency", "owner_name": "f", "callee": "Promise.all", "kinds": ["promise-combinator"], "line": 3, "col": 0}])
    base = {"modules": relation(spark, "modules", [{"path": "a.ts", "role": "source", "is_valid": True, "export_names": []}]), "signals": signal}
    assert rules.evaluate(rules.Catalog(spark, base), ["TS-EXT-EFFECT-R008"]).count() == 0
    on = base | {"extensions": relation(spark, "extensions", [{"name": "effect", "activation": "dependency", "installed": True}])}
    assert rules.evaluate(rules.Catalog(spark, on), ["TS-EXT-EFFECT-R008"]).first().line == 3


def test_all_rules_run_on_an_empty_catalog(spark):
    assert rules.evaluate(rules.Catalog(spark, {})).count() == 0


# a text on which the rule fires, and one on which it doesn't
PAIRS = {
    "AGENT-TS-R001": ("src/a.ts", "export const a = 1;", "// What it is for.\nexport const a = 1;"),
    "AGENT-TS-R006": ("src/a.ts", "export function f(a: boolean, b: boolean) {}", "export function f(a: boolean, b: string) {}"),
    "AGENT-TS-R008": ("src/a.ts", "export function f() { if (a) { for (;;) { while (b) { if (c) { if (d) { x(); } } } } } }", "export function f() { if (a) { x(); } }"),
    "TS-SYN-R001": ("src/a.ts", "const a = (", "const a = 1;"),
    "TS-AGENT-PROJECT-003": ("src/index.ts", "export const a = 1;", "export * from './a';"),
    "TS-REACT-R001": ("src/a.tsx", "export function A() { return window.x; }", "export function A() { return 1; }"),
    "TS-REACT-R004": ("src/a.tsx", "export function A(p: { isOn: boolean; isBig: boolean }) { return 1; }", "export function A(p: { isOn: boolean }) { return 1; }"),
    "TS-EFFECT-R002": ("src/a.ts", "import { Effect } from 'effect';\nexport const a = process.env.X;", "export const a = process.env.X;"),
    "TS-EFFECT-R003": ("src/a.ts", "import { Effect } from 'effect';\nimport { it } from 'vitest';", "import { Effect } from 'effect';"),
    "R007": ("src/a.ts", "export function f(a: string, b: string, c: string, d: string) {}", "function f(a: string, b: string, c: string, d: string) {}"),
    "R010": ("src/a.ts", "export function f(): [string, number] { return x; }", "export function f(): string { return x; }"),
    "R011": ("src/a.ts", "export function f(a: any) {}", "export function f(a: many) {}"),
}


def test_syntax_rules_in_pairs(spark):
    rows = [(f"{side}/{rule}/{path}", (good, bad)[side == "pos"], 0) for rule, (path, bad, good) in PAIRS.items() for side in ("pos", "neg")]
    rows = [r for r in rows if "PROJECT-003" not in r[0]]
    c = project.build(spark.createDataFrame(rows, "path string, content string, mtime_ms long"))
    found = {(r.rule_id, r.path.split("/")[0], r.path.split("/")[1]) for r in project.check_syntax(c).collect()}
    for rule in PAIRS:
        if rule != "TS-AGENT-PROJECT-003":
            assert (rule, "pos", rule) in found
            assert (rule, "neg", rule) not in found


def test_first_index_only_reexports(spark):
    for text, fires in ((PAIRS["TS-AGENT-PROJECT-003"][1], True), (PAIRS["TS-AGENT-PROJECT-003"][2], False)):
        c = project.build(spark.createDataFrame([("src/index.ts", text, 0)], "path string, content string, mtime_ms long"))
        assert ("TS-AGENT-PROJECT-003" in {r.rule_id for r in project.check_syntax(c).collect()}) == fires


def test_a_project_reads_each_text_once(spark, catalog):
    """The plan of the rules reads written facts; no lexing pass is left in it."""
    c = project.build(catalog["source_files"], MANIFEST)
    plan = project.check(c, rules=["TS-SYN-R001", "TS-AGENT-POLICY-004", "TS-AGENT-POLICY-007", "TS-AGENT-POLICY-009"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 0
    bare = project.build(catalog["source_files"], MANIFEST, keep=False)
    assert sorted(map(repr, bare["params"].collect())) == sorted(map(repr, catalog["params"].collect()))


DOCUMENTS = {
    "packages/a/package.json": '{"name": "@demo/a"}', "packages/a/tsconfig.json": '{ // note "x"\n "compilerOptions": {"composite": true, "paths": {"x": ["http://y//z"],},} }', "packages/b/package.json": '{"name": "@demo/b"}',
    "packages/c/package.json": "broken", "packages/c/tsconfig.json": "broken", "other/d/package.json": '{"name": "d"}', "schemas/user.schema.json": '{"$id": "user-id", "title": "A user", "properties": {"email/work": {"type": "string"}}}',
}


def test_build_makes_the_relations_of_the_overview_views(spark):
    manifest = json.dumps({"name": "demo", "workspaces": ["packages/*"], "dependencies": {}})
    config = '{"compilerOptions": {}, "references": [{"path": "./packages/a"}, {"path": "packages/b/tsconfig.json"}, {"path": "packages/c/"}, {"path": "none"}]}'
    files = spark.createDataFrame([("src/index.ts", 'import x from "@demo/a";\nimport "@demo/b/sub";\n', 0)], "path string, content string, mtime_ms long")
    c = project.build(files, manifest, config, documents=spark.createDataFrame(list(DOCUMENTS.items()), "path string, content string"))
    assert sorted((r.path, r.name, r.pattern) for r in c["workspace_packages"].collect()) == [("packages/a", "@demo/a", "packages/*"), ("packages/b", "@demo/b", "packages/*"), ("packages/c", None, "packages/*")]
    assert sorted(map(tuple, c["reference_packages"].collect())) == [
        ("none", None, None, None, None), ("packages/a", "@demo/a", "packages/a/tsconfig.json", True, False), ("packages/b", "@demo/b", None, None, None), ("packages/c", None, "packages/c/tsconfig.json", None, None),
    ]
    found = {(r.path, r.labels["lacks"]) for r in rules.evaluate(c, ["TS-AGENT-PROJECT-004"]).collect()}
    assert found == {("none/package.json", "config"), ("packages/a/tsconfig.json", "declaration"), ("packages/b/package.json", "config")}
    c.relations["findings"] = rules.numbered(rules.evaluate(c, ["TS-AGENT-PROJECT-004"]))
    w = search.search(c, "workspace")
    assert [r.name for r in w["packages"].collect()] == ["@demo/a", "@demo/b", None]
    assert [tuple(r) for r in w["edges"].collect()] == [("src/index.ts", "@demo/a", "package-name"), ("src/index.ts", "@demo/b", "package-subpath")]
    assert {r.rule_id for r in w["findings"].collect()} >= {"TS-AGENT-PROJECT-004"}
    docs = lambda q: [tuple(r) for r in search.search(c, "docs", q)["hits"].collect()]
    assert docs("user-id") == [("schemas/user.schema.json", 12, "/$id")]
    assert docs("work") == [("schemas/user.schema.json", 9, "/properties/email~1work")]
    assert search.search(c, "prime")["owners"].count() == 1


def test_edges_follow_the_order_of_paths(catalog):
    rows = [(r.from_path, r.line) for r in catalog["edges"].orderBy("seq").collect()]
    assert rows == sorted(rows) and len({r.seq for r in catalog["edges"].collect()}) == len(rows)


@pytest.mark.parametrize("text", ["export const a = ;", "const a = \"x", "let a b = 1;", "if x { }", "export function (a) {}", "const a = 1 2;", "const = 2;", "f(a, ...);", "const t = `a ${b}", "/* no end", "x = a &&;", "foo \"bar\";", "import ;"])
def test_syntax_errors_are_seen(text):
    assert [r["phase"] for r in typescript.read("a.ts", text, "diagnostics")] == ["syntax"]


@pytest.mark.parametrize(("path", "text"), [
    ("a.tsx", "const x = <a>http://x y</a>;"), ("a.tsx", "export function A() { return (<p>(a</p>); }"), ("a.tsx", "export const f = <T,>(x: T) => x;"), ("a.tsx", "const a = b ? <A x={1} y='2' {...p}>it's {n} <b/> {/* c */}</A> : null;"), ("a.tsx", "const a = <></>;"),
    ("a.tsx", "const f: <T>(x: T) => T = g; x = a < b ? c : d;"), ("a.ts", "type A = { -readonly [K in keyof T]-?: T[K] };"), ("a.ts", 'export * from "./a"; import * as x from "y" with { type: "json" };'), ("a.ts", "for await (const x of y) { x!; }"),
    ("a.ts", "const r = /[\"']/.test(s) && x ?? y; if (a) /x[)]/.test(b);"), ("a.ts", 'class A { "m"() { return 1 } get x() { return 2 } static y = 3; #p = 1 }'), ("a.ts", 'let a: "x" | "y" = "x"; switch (a) { case "x": break; default: }'), ("a.ts", 'declare module "x" { export const y: number; }'),
    ("a.ts", "const f = (a?: string, ...b: number[]): a is string => true"), ("a.ts", "const t = `a ${b('}')} c`; export default class { a = 1 as const; }"), ("a.ts", "abstract class A<T extends B = C> { protected constructor(private readonly x: T) { super(); } async *g() { yield* h(); } }"),
])
def test_valid_texts_stay_valid(path, text):
    assert typescript.read(path, text, "diagnostics") == []


def test_a_collector_that_fails_leaves_a_diagnostic(monkeypatch):
    monkeypatch.setitem(typescript.COLLECTORS, "params", lambda *_: 1 / 0)
    got = typescript.read_all("a.ts", "export function f(a: string) {}")
    assert got["params"] == [] and len(got["items"]) == 1
    assert [(r["phase"], r["category"], r["message"].split(":")[0]) for r in got["diagnostics"]] == [("extract", "warning", "params")]


FLOWS = [  # body, statements, branches, loops, nesting, chain, transforms, block
    ('if ("a" === x) {} else if ((x) === "b") {} else if (("c") == (x)) {} else if (x === `d`) {} else { y(); }', (5, 4, 0, 4, 4, 0, 1)),
    ("if (k(x) === 1) {} else if (k(x) === 2) {} else if (k(y) === 3) {}", (3, 3, 0, 3, 2, 0, 1)), ("if (x === y) {} if (x === 'a' && z) {} if (1 === 2) {}", (3, 3, 0, 1, 0, 0, 3)),
    ("const out = []; for (const a of b) { out.push(a); } return (out);", (4, 0, 1, 1, 0, 1, 3)), ("const out = []; for (const a of b) { out.push(1); } return out;", (4, 0, 1, 1, 0, 0, 3)), ("for (const a of b) { out.push(a); } return () => { return out; };", (4, 0, 1, 1, 0, 0, 2)),
    ("switch (x) { case 1: a(); break; default: b(); } try { c(); } catch (e) { d(); } finally { e(); } return x ? 1 : y ? 2 : 3;", (8, 5, 0, 2, 0, 0, 3)), ("xs.map((v) => { if (v) { return v; } return 0; }); while (a) b(); do { c() } while (d); return;", (9, 1, 2, 1, 0, 0, 4)), ("", (0, 0, 0, 0, 0, 0, 0)),
]


@pytest.mark.parametrize(("body", "want"), FLOWS)
def test_flow_metrics(body, want):
    r = typescript.read("a.ts", "export function f(x: string) {" + body + "}", "control_flows")[0]
    assert tuple(r[k] for k in ("statements", "branches", "loops", "max_nesting", "max_literal_chain", "manual_transform_loops", "max_block_statements")) == want


@pytest.mark.parametrize("read", [lambda f: typescript.facts(f, "calls"), typescript.all_facts])
def test_texts_of_one_partition_are_read_by_many_tasks(spark, read):
    texts = spark.range(0, 400, 1, 1).selectExpr("concat('src/a', id, '.ts') AS path", "concat('export const x = f', id, '();') AS content")
    found = read(texts).withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 8
    assert read(texts).select("path" if "path" in found.columns else "calls.path").where("path IS NOT NULL").distinct().count() == 400


def test_edges_read_the_texts_for_imports_once(spark):
    rows = [(p, t, 0) for p, t in SOURCES.items()]
    c = project.build(spark.createDataFrame(rows, "path string, content string, mtime_ms long"), keep=False)
    plan = c["edges"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= 1  # the modules'; imports are read from where they were written


def test_an_updated_snapshot_reads_texts_once(spark, sf_dir):
    from factloom.plans import catalog

    plan = catalog.QUERIES["u_incremental_equals_full"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # of the snapshot made anew; the others are read from where they were written


def test_signs_of_one_letter_need_no_pattern(monkeypatch):
    matched, pattern = [], lexer._TOKEN

    class Counted:
        def match(self, text, at):
            matched.append(at)
            return pattern.match(text, at)

    monkeypatch.setattr(lexer, "_TOKEN", Counted())
    s = lexer.lex("f((a), [b, {c: 1}]);\n")
    assert [t.text for t in s.tokens] == [*"f((a),[b,{c:1}]);"] and len(matched) == 6  # four names, a number and the line's end
    assert [(i, j) for i, j in sorted(s.pair.items()) if i < j] == [(1, 15), (2, 4), (6, 14), (9, 13)]


@pytest.mark.parametrize("family, signal", [("fixtures", None), ("signals", "runtime-call"), ("signals", "promise-interop"), ("signals", "resource-scope")])
def test_texts_without_a_sign_are_passed_over(spark, family, signal):
    bodies = ["Effect.runFork(a());", "appRuntime . runPromiseExit(a());", "Effect . promise(async () => { throw 1; });", "Effect.acquireRelease(a, b);", 'fs.writeFileSync("a", "b");', "a();", "runSync(a);", None]
    files = spark.createDataFrame([(f"p{i}.ts", b and f"export function f() {{ {b} }}") for i, b in enumerate(bodies)], "path string, content string")
    found = typescript.facts(files, family, signal)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Contains(content" in plan[plan.index("Exchange ") :]
    every = [r for f in files.collect() for r in typescript.read(f.path, f.content, family) if signal in (None, r.get("family"))]
    assert sorted(r.path for r in found.collect()) == sorted(r["path"] for r in every) != []
