"""Every policy rule over relations read off the driver's tables, with SQL that states its threshold anew.

Parts stand for modules, line items for the facts in them, so that counts fall on both sides of each threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import rules, syntax_rules
from factloom.plans.analogues import table
from factloom.plans.registry import add
from factloom.schemas import conform

Relations = dict[str, DataFrame]
ROLES = ("facade", "entrypoint", "test", "config", "source", "source")
_NAMED = ((7, ("ParseError", "ReadFailure")), (11, ("TestClockLive",)), (9, ("UserService",)), (10, ("forkAll",)))


def _path(key: Column) -> Column:
    return F.concat(F.lit("src/p"), key.cast("string"), F.lit(".ts"))


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    plain = F.slice(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("name"), i.cast("string"))), 1, (k % 12).cast("int"))
    more = [F.when(k % n == 0, _names(v)).otherwise(F.array().cast("array<string>")) for n, v in _NAMED]
    rows = table(spark, sf_dir, "part").select(
        _path(k).alias("path"), F.element_at(_names(ROLES), (k % 6 + 1).cast("int")).alias("role"), F.when(k % 5 == 0, "model").alias("layer"), (k % 13 != 0).alias("is_valid"), (k % 4 == 0).alias("has_intent_doc"),
        (k % 200 + 900).cast("int").alias("n_lines"), F.concat(plain, *more).alias("export_names"),
    )
    return conform(rows, "modules")


M = """m AS (SELECT 'src/p' || p_partkey || '.ts' AS path, p_partkey AS k, ['facade', 'entrypoint', 'test', 'config', 'source', 'source'][p_partkey % 6 + 1] AS role, p_partkey % 13 <> 0 AS is_valid, p_partkey % 4 = 0 AS doc, p_partkey % 200 + 900 AS n_lines,
   p_partkey % 12 + CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE 0 END + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 9 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END AS n_exports FROM part),
 src AS (SELECT * FROM m WHERE is_valid AND role NOT IN ('test', 'declaration', 'config')), eff AS (SELECT * FROM src WHERE role <> 'entrypoint'),
 l AS (SELECT 'src/p' || l_partkey || '.ts' AS path, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s FROM lineitem)"""


def facts(relation: str, /, **columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A relation of one row for each line item, its columns as expressions of n (line number), o (order) and s (supplier): path is its part's module, seq its place."""
    place = {"path": "concat('src/p', p, '.ts')", "seq": "int(o * 10 + n)", "line": "int(o % 97 + 1)", "col": "0"}

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS p", "l_orderkey AS o", "int(l_linenumber) AS n", "l_suppkey AS s")
        return conform(rows.selectExpr(*[f"{e} AS `{c}`" for c, e in (place | columns).items()]), relation)

    return make


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as resolved dependencies; a fifth of the specifiers name a style sheet, others packages."""
    N, O, S_ = F.col("l_linenumber"), F.col("l_orderkey"), F.col("l_suppkey")  # noqa: N806
    spec = F.when(S_ % 5 == 0, "./style.css").when(S_ % 5 == 1, "effect").when((S_ % 5 == 2) & (O % 40 == 0), "effect/FiberRef").otherwise(F.concat(F.lit("./f"), (S_ % 7).cast("string")))
    role = lambda k: F.element_at(_names(ROLES), (k % 6 + 1).cast("int"))
    target = O % 200 + 1
    return table(spark, sf_dir, "lineitem").select(
        (O * 10 + N).cast("bigint").alias("seq"), _path(F.col("l_partkey")).alias("from_path"), _path(target).alias("to_path"), spec.alias("module_specifier"), F.when(N % 2 == 0, "export").otherwise("import").alias("kind"), F.lit(False).alias("is_type_only"),
        F.when(N % 3 == 0, "unresolved").otherwise("relative").alias("resolution"), N.cast("int").alias("line"), F.lit(0).alias("col"), role(F.col("l_partkey")).alias("from_role"), role(target).alias("to_role"),
        ((role(F.col("l_partkey")) == "test") | (role(target) == "test")).alias("is_test_context"),
    )


D = f"""{M}, d AS (SELECT 'src/p' || l_partkey || '.ts' AS path, l_orderkey * 10 + l_linenumber AS seq, 'src/p' || (l_orderkey % 200 + 1) || '.ts' AS to_path, CASE WHEN l_suppkey % 5 = 0 THEN './style.css' WHEN l_suppkey % 5 = 1 THEN 'effect' WHEN l_suppkey % 5 = 2 AND l_orderkey % 40 = 0 THEN 'effect/FiberRef' ELSE './f' || (l_suppkey % 7) END AS spec,
   CASE WHEN l_linenumber % 2 = 0 THEN 'export' ELSE 'import' END AS kind, l_linenumber % 3 = 0 AS unresolved, ['facade', 'entrypoint', 'test', 'config', 'source', 'source'][l_partkey % 6 + 1] AS from_role, ['facade', 'entrypoint', 'test', 'config', 'source', 'source'][(l_orderkey % 200 + 1) % 6 + 1] AS to_role FROM lineitem)"""


def of(source: str, key: str, relation: str, /, **columns: str) -> Callable[[SparkSession, str], DataFrame]:
    """A relation of one row for each row of a table, its columns as expressions of the key k."""
    return lambda spark, sf_dir: conform(table(spark, sf_dir, source).selectExpr(f"{key} AS k").selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()]), relation)


def installed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.createDataFrame([(name, "dependency", True)], "name string, activation string, installed boolean")


def rule(id: str, sql: str, **relations: Callable[[SparkSession, str], DataFrame]) -> None:
    """Registers the rule's findings by path and how many each has."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = rules.Catalog(spark, {k: (lambda f=f: f(spark, sf_dir)) for k, f in ({"modules": modules, "edges": dependencies} | relations).items()})
        return rules.evaluate(c, [id]).groupBy("path").agg(F.count("*").alias("n"))

    add("r_" + id.lower().replace("-", "_"), plan, sql)


# --- syntax, semantic, project ----------------------------------------------------------------------------------------

_phases = facts("diagnostics", phase="element_at(array('syntax', 'semantic', 'config', 'package-json', 'extract', 'syntax', 'semantic'), n)", message="'m'", code="n")
for _id, _ns in (("TS-SYN-R001", "1, 6"), ("TS-SEM-R001", "2, 7"), ("TS-AGENT-PROJECT-002", "3"), ("TS-AGENT-PROJECT-003", "4")):
    rule(_id, f"WITH {M} SELECT path, count(*) AS n FROM l WHERE n IN ({_ns}) GROUP BY path", diagnostics=_phases)
_projects = of("nation", "n_nationkey", "project", mode="if(k % 2 = 0, 'project', 'paths')", config_path="CASE WHEN k % 3 != 0 THEN concat('p', k) END", module_resolution="CASE k % 5 WHEN 1 THEN 'NodeNext' WHEN 2 THEN 'bundler' WHEN 3 THEN 'classic' WHEN 4 THEN 'node16' END")
rule("TS-AGENT-PROJECT-001", "SELECT '.' AS path, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 = 0", project=_projects)
rule(
    "TS-AGENT-PROJECT-004", "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'q' || s_suppkey || '/package.json' ELSE 'c' || s_suppkey END AS path, 1 AS n FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 7 <> 0 AND NOT (s_suppkey % 2 = 0 AND s_suppkey % 5 = 0))",
    reference_packages=of("supplier", "s_suppkey", "reference_packages", path="concat('q', k)", config_path="CASE WHEN k % 3 != 0 THEN concat('c', k) END", composite="CASE WHEN k % 7 != 0 THEN k % 2 = 0 END", declaration="CASE WHEN k % 7 != 0 THEN k % 5 = 0 END"),
)
_entries = of("supplier", "s_suppkey", "package_entries", subpath="'.'", target="concat('./t', k)", source="CASE k % 3 WHEN 0 THEN 'exports' WHEN 1 THEN 'imports' ELSE 'main' END", resolution="if(k % 4 = 0, 'unresolved', 'external')")
rule("TS-AGENT-PROJECT-005", "SELECT CASE WHEN n_nationkey % 3 <> 0 THEN 'p' || n_nationkey ELSE '.' END AS path, count(*) AS n FROM nation WHERE n_nationkey % 5 IN (0, 3) GROUP BY 1", project=_projects, package_entries=_entries)
rule("TS-AGENT-PROJECT-006", "SELECT 'package.json' AS path, count(*) AS n FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0", build_tools=of("supplier", "s_suppkey", "build_tools", name="if(k % 2 = 0, 'rspack', 'rsbuild')", has_script="k % 3 = 0"))

# --- modularity and tests ---------------------------------------------------------------------------------------------

rule("TS-MOD-R001", f"WITH {D} SELECT path, count(*) AS n FROM d WHERE from_role NOT IN ('test', 'config', 'declaration') AND to_role = 'test' GROUP BY path", owner_dependencies=dependencies)
rule("TS-MOD-R002", f"WITH {M}, r AS (SELECT path, count(*) AS c FROM l WHERE n % 4 <> 0 GROUP BY path) SELECT m.path, 1 AS n FROM m JOIN r USING (path) WHERE n_lines > 1000 AND c > 8", responsibilities=facts("responsibilities", kind="element_at(array('variable', 'function', 'class', 'call'), n % 4 + 1)"))
rule(
    "TS-TEST-R001", f"WITH {M} SELECT path, 1 AS n FROM m WHERE role = 'test' AND NOT (path = 'src/p2.ts' OR path = 'src/p8.ts')",
    project=lambda spark, sf_dir: spark.createDataFrame([("project", ["src/p2.ts", "src/p8.ts"])], "mode string, test_roots array<string>"),
)

# --- agent policy -----------------------------------------------------------------------------------------------------

rule("TS-AGENT-POLICY-001", f"WITH {D} SELECT path, count(*) AS n FROM d WHERE unresolved AND spec NOT LIKE '%.css' GROUP BY path", owner_dependencies=dependencies)
rule("TS-AGENT-POLICY-002", "SELECT 'package.json' AS path, count(*) AS n FROM supplier WHERE s_suppkey % 3 IN (0, 1) AND s_suppkey % 4 = 0", package_entries=_entries)
rule("TS-AGENT-POLICY-003", f"WITH {D} SELECT path, 1 AS n FROM src JOIN d USING (path) WHERE role = 'facade' AND NOT doc AND kind = 'export' GROUP BY path HAVING count(DISTINCT to_path) >= 2", owner_dependencies=dependencies)
_params = facts("params", function_name="concat('f', s % 3)", function_line="1", param_name="concat('p', n)", type_text="'string'", flag_type="CASE WHEN n % 2 = 0 THEN 'boolean' END")
rule("TS-AGENT-POLICY-004", f"WITH {M}, g AS (SELECT path, s % 3 AS f FROM l WHERE n % 2 = 0 GROUP BY ALL HAVING count(*) >= 2) SELECT path, count(*) AS n FROM g JOIN src USING (path) GROUP BY path", params=_params)
rule("TS-AGENT-POLICY-005", f"WITH {M}, g AS (SELECT path, s % 3 AS f FROM l GROUP BY ALL HAVING count(*) >= 6) SELECT path, count(*) AS n FROM g JOIN src USING (path) GROUP BY path", params=_params)
rule("TS-AGENT-POLICY-006", f"WITH {M} SELECT path, count(*) AS n FROM l JOIN src USING (path) GROUP BY path", tuple_surfaces=facts("tuple_surfaces", function_name="'f'", surface_name="'p'", type_text="'[string, number]'"))
_flows = facts("control_flows", function_name="'f'", statements="o % 5 + 26", branches="s % 6 + 8", loops="n % 3", max_nesting="o % 7", max_literal_chain="s % 6", line_span="o % 6 + 86", manual_transform_loops="if(n = 5, 1, 0)", max_block_statements="s % 5 + 19")
rule("TS-AGENT-POLICY-007", f"WITH {M} SELECT path, count(*) AS n FROM l JOIN src USING (path) WHERE o % 7 >= 5 OR n % 3 >= 2 OR (s % 6 + 8 >= 12 AND n % 3 = 0) OR s % 6 >= 4 GROUP BY path", control_flows=_flows)
rule("TS-AGENT-POLICY-008", f"WITH {M}, x AS (SELECT path, CASE WHEN o % 7 <= 2 AND (o % 6 + 86 >= 90 AND o % 5 + 26 >= 28 OR s % 5 + 19 >= 22) THEN 1 ELSE 0 END + CASE WHEN n = 5 THEN 1 ELSE 0 END AS c FROM l JOIN src USING (path)) SELECT path, CAST(sum(c) AS BIGINT) AS n FROM x GROUP BY path HAVING sum(c) > 0", control_flows=_flows)
_fields = facts("data_fields", type_kind="'interface'", type_name="concat('T', s % 2)", type_line="2", field_name="element_at(array('userId', 'filePath', 'size_bytes', 'kindness', 'status', 'pageState', 'plain'), n)", type_text="'string'", primitive_type="CASE WHEN o % 5 != 0 THEN if(o % 2 = 0, 'string', 'number') END")
rule("TS-AGENT-POLICY-009", f"WITH {M}, g AS (SELECT path, s % 2 AS t FROM l WHERE n <= 3 AND o % 5 <> 0 GROUP BY ALL HAVING count(*) >= 3) SELECT path, count(*) AS n FROM g JOIN src USING (path) GROUP BY path", data_fields=_fields)
rule(
    "TS-AGENT-POLICY-010", f"WITH {M} SELECT path, count(*) AS n FROM l JOIN src USING (path) WHERE n <= 4 AND o % 5 <> 0 GROUP BY path",
    type_aliases=facts("type_aliases", alias_name="element_at(array('UserId', 'FilePath', 'RetryMs', 'PageURL', 'Identity', 'Pathway', 'Row'), n)", type_text="'string'", primitive_type="CASE WHEN o % 5 != 0 THEN 'string' END"),
)
rule("TS-AGENT-POLICY-011", f"WITH {M}, g AS (SELECT DISTINCT path, s % 2 AS t FROM l WHERE n IN (5, 6) AND o % 5 <> 0 AND o % 2 = 0) SELECT path, count(*) AS n FROM g JOIN src USING (path) GROUP BY path", data_fields=_fields)
rule(
    "TS-AGENT-POLICY-012", f"WITH {M}, g AS (SELECT path, s % 2 AS u, o % 2 AS v FROM l WHERE n <= 3 AND o % 5 <> 0 GROUP BY ALL HAVING count(*) >= 2) SELECT path, count(*) AS n FROM g JOIN src USING (path) WHERE k % 5 <> 0 GROUP BY path",
    variant_fields=facts("variant_fields", union_name="concat('U', s % 2)", variant_name="concat('v', o % 2)", discriminant_name="'kind'", field_name="element_at(array('userId', 'filePath', 'size_bytes', 'a', 'b', 'c', 'd'), n)", primitive_type="CASE WHEN o % 5 != 0 THEN 'string' END"),
)
_B = "b AS (SELECT * FROM m WHERE role <> 'test' AND (role IN ('entrypoint', 'facade', 'config') OR path IN (SELECT path FROM d WHERE kind = 'export') OR role = 'source' AND n_exports > 0))"
rule("TS-AGENT-POLICY-013", f"WITH {D}, {_B} SELECT path, 1 AS n FROM (SELECT path FROM b WHERE NOT doc AND (role = 'facade' AND n_exports >= 3 OR role = 'source' AND n_exports >= 8) ORDER BY role <> 'facade', n_exports DESC, path LIMIT 8)")
rule(
    "TS-AGENT-POLICY-014", f"""WITH {D}, {_B}, c AS (SELECT path, spec, count(*) AS n, min(seq) AS first FROM d WHERE from_role <> 'test' AND to_role <> 'test' AND path IN (SELECT path FROM b WHERE role IN ('source', 'facade')) GROUP BY ALL HAVING count(*) >= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first) AS k FROM c), t AS (SELECT * FROM r WHERE k <= 3 ORDER BY path, k LIMIT 20) SELECT path, count(*) AS n FROM t GROUP BY path""",
    owner_dependencies=dependencies,
)


def wide_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modules with 29 more exports."""
    return modules(spark, sf_dir).withColumn("export_names", F.concat("export_names", F.transform(F.sequence(F.lit(1), F.lit(29)), lambda i: F.concat(F.lit("more"), i.cast("string")))))


rule("TS-AGENT-POLICY-015", f"WITH {M} SELECT path, 1 AS n FROM (SELECT path FROM src WHERE role = 'facade' AND NOT doc AND n_exports + 29 > 30 ORDER BY path LIMIT 10)", modules=wide_modules)
rule("TS-AGENT-POLICY-016", f"WITH {M} SELECT path, 1 AS n FROM (SELECT path FROM src WHERE NOT doc AND k % 7 = 0 ORDER BY path LIMIT 20)")

# --- extensions -------------------------------------------------------------------------------------------------------

_many = lambda name: of("nation", "n_nationkey", "extensions", name=f"if(k % 2 = 0, '{name}', 'other')", installed="CASE k % 3 WHEN 0 THEN true WHEN 1 THEN false END")
for _id, _name in (("TS-EXT-EFFECT-R001", "effect"), ("TS-EXT-REACT-R001", "react")):
    rule(_id, "SELECT 'package.json' AS path, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0", extensions=_many(_name))
rule("TS-EXT-SHADCN-R001", "SELECT 'package.json' AS path, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0", extensions=_many("shadcn"), package_dependencies=lambda spark, sf_dir: spark.createDataFrame([("tailwind", "^1", "dependencies")], "name string, version_range string, source string"))
_async = facts("async_surfaces", name="'f'", is_async="n % 2 = 0", returns_promise="n % 3 = 0", returns_effect="o % 3 = 0", error_kind="element_at(array('none', 'weak', 'domain'), int(s % 3 + 1))")
_methods = facts("service_methods", container_kind="'class'", container_name="'C'", method_name="'m'", requirements="CASE n % 3 WHEN 0 THEN 'never' WHEN 1 THEN 'Db' END", error_kind="if(o % 4 = 0, 'weak', 'none')")
_on = installed("effect")
rule("TS-EXT-EFFECT-R002", f"WITH {M} SELECT DISTINCT path, 1 AS n FROM l JOIN eff USING (path) WHERE (n % 2 = 0 OR n % 3 = 0) AND o % 3 <> 0", async_surfaces=_async, extensions=_on)
rule("TS-EXT-EFFECT-R004", f"WITH {M} SELECT path, count(*) AS n FROM l JOIN src USING (path) WHERE n % 3 = 1 GROUP BY path", service_methods=_methods, extensions=_on)
rule("TS-EXT-EFFECT-R005", f"WITH {M} SELECT DISTINCT path, 1 AS n FROM l JOIN eff USING (path) WHERE s % 3 = 1 OR o % 4 = 0", async_surfaces=_async, service_methods=_methods, extensions=_on)
_FAMILIES = "'runtime-call', 'promise-interop', 'resource-scope', 'concurrency', 'schema-boundary', 'production-boundary', 'render-purity', 'hook-call', 'static-definition'"
_signals = facts("signals", family=f"element_at(array({_FAMILIES}), int(o % 9 + 1))", owner_name="'f'", callee="'c'", kinds="if(n % 2 = 0, array('query-hook'), CAST(array() AS ARRAY<STRING>))")
rule("TS-EXT-EFFECT-R003", f"WITH {M} SELECT DISTINCT path, 1 AS n FROM l JOIN eff USING (path) WHERE o % 9 = 0 AND n % 2 <> 0", signals=_signals, extensions=_on)
for _id, _at in (("TS-EXT-EFFECT-R006", 1), ("TS-EXT-EFFECT-R007", 2), ("TS-EXT-EFFECT-R008", 3), ("TS-EXT-EFFECT-R009", 4), ("TS-EXT-EFFECT-R010", 5)):
    rule(_id, f"WITH {M} SELECT DISTINCT path, 1 AS n FROM l JOIN eff USING (path) WHERE o % 9 = {_at}", signals=_signals, extensions=_on)
for _id, _at in (("TS-EXT-REACT-R002", 6), ("TS-EXT-REACT-R003", 7), ("TS-EXT-REACT-R004", 8)):
    rule(_id, f"WITH {M} SELECT DISTINCT path, 1 AS n FROM l JOIN src USING (path) WHERE o % 9 = {_at}", signals=_signals, extensions=installed("react"))
rule("TS-EXT-EFFECT-R011", f"WITH {M} SELECT path, 1 AS n FROM (SELECT path FROM src WHERE role = 'source' AND k % 11 = 0 ORDER BY path LIMIT 10)")
rule("TS-EXT-EFFECT-R012", f"WITH {D} SELECT path, 1 AS n FROM src WHERE k % 9 = 0 AND path IN (SELECT path FROM d WHERE spec LIKE 'effect%')", owner_dependencies=dependencies)
rule("TS-EXT-EFFECT-R013", f"WITH {D} SELECT path, 1 AS n FROM src WHERE k % 10 = 0 AND path NOT IN (SELECT path FROM d WHERE spec LIKE '%FiberRef%')", owner_dependencies=dependencies)

# --- the smaller model ------------------------------------------------------------------------------------------------


_shapes = facts(
    "function_shapes", name="'f'", exported="o % 3 != 0", n_params="s % 6", n_boolean_params="n % 4", max_nesting="o % 7", statements="s % 8 + 26", branches="o % 12", uses_any="s % 5 = 0", returns="CASE n WHEN 1 THEN '[string, number]' WHEN 2 THEN 'readonly [string]' WHEN 3 THEN 'string[]' END",
)
for _id, _where in (
    ("AGENT-TS-R006", "n % 4 > 1"), ("AGENT-TS-R008", "o % 7 > 4"), ("AGENT-TS-R009", "s % 8 + 26 > 30"), ("R004", "o % 3 <> 0 AND o % 7 > 4"), ("R005", "o % 3 <> 0 AND o % 12 > 8"), ("R007", "o % 3 <> 0 AND s % 6 > 3"), ("R010", "o % 3 <> 0 AND n IN (1, 2)"), ("R011", "o % 3 <> 0 AND s % 5 = 0"),
):
    add("b_" + _id.lower().replace("-", "_"), lambda spark, sf_dir, i=_id: syntax_rules.function_findings(_shapes(spark, sf_dir)).where(F.col("rule_id") == i).groupBy("path").agg(F.count("*").alias("n")), f"WITH {M} SELECT path, count(*) AS n FROM l WHERE {_where} GROUP BY path")
_react = facts("react_shapes", name="'A'", n_boolean_props="n % 4", n_context_props="o % 10", effect_statements="s % 6 + 12")
for _id, _where in (("TS-REACT-R004", "n % 4 > 1"), ("TS-REACT-R005", "o % 10 > 6"), ("TS-REACT-R006", "s % 6 + 12 > 15")):
    add("b_" + _id.lower().replace("-", "_"), lambda spark, sf_dir, i=_id: syntax_rules.react_findings(_react(spark, sf_dir)).where(F.col("rule_id") == i).groupBy("path").agg(F.count("*").alias("n")), f"WITH {M} SELECT path, count(*) AS n FROM l WHERE {_where} GROUP BY path")

_TEXTS = (
    "const a = 1;", "// What it is for.\nconst a = 1;", "/** Doc. */\nimport { Effect } from 'effect';\nexport const a = process.env.X;", "// c\nimport { Effect } from 'effect';\nimport { it } from 'vitest';", "// c\nexport function A() { return window.x; }",
    "// c\nimport * as Layer from 'effect/Layer';\nclass T extends Context.Tag('T') {}\nconst l = Layer.succeed(T, 1);\nEffect.runSync(x);", "// c\nimport { Effect } from \"effect\";\nexport async function f() {}\nconst e: Effect.Effect<string, any> = g;", "// c\nexport function useX() { const v = f(); return [v, 1]; }\nconst useY = 1;\nreturn <b> x</b>;",
)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by turns with eight texts; one of three in a bucket directory, one of two a component, exports 10 to 14, some star exports."""
    k = F.col("p_partkey")
    at = F.concat(F.when(k % 3 == 0, "src/utils/p").otherwise("src/p"), k.cast("string"), F.when(k % 5 == 0, "/index").otherwise(""), F.when(k % 2 == 0, ".tsx").otherwise(".ts"))
    kinds = F.concat(F.array_repeat(F.lit("function"), (k % 5 + 10).cast("int")), F.array_repeat(F.lit("star-reexport"), (k % 3).cast("int")))
    return table(spark, sf_dir, "part").select(at.alias("path"), F.element_at(_names(_TEXTS), (F.floor(k / 3) % 8 + 1).cast("int")).alias("content"), (k % 13 != 0).alias("is_valid"), kinds.alias("export_kinds"))


_T = "t AS (SELECT p_partkey AS k, p_partkey // 3 % 8 AS x, CASE WHEN p_partkey % 3 = 0 THEN 'src/utils/p' ELSE 'src/p' END || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '/index' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN '.tsx' ELSE '.ts' END AS path FROM part)"
for _id, _where in (
    ("TS-SYN-R001", "k % 13 = 0"), ("AGENT-TS-R001", "x = 0"), ("AGENT-TS-R003", "k % 3 = 0 AND k % 5 <> 0"), ("AGENT-TS-R012", "k % 5 + 10 > 12"), ("TS-REACT-R001", "k % 2 = 0 AND x = 4"), ("TS-REACT-R002", "k % 2 = 0 AND x = 7"), ("TS-REACT-R003", "x = 7"), ("TS-EFFECT-R001", "x = 5"), ("TS-EFFECT-R002", "x = 2"),
    ("TS-EFFECT-R003", "x = 3"), ("TS-EFFECT-R004", "x = 6"), ("TS-EFFECT-R006", "x = 5"), ("TS-EFFECT-R007", "x = 6"), ("TS-AGENT-PROJECT-003", "path = (SELECT min(path) FROM t WHERE k % 5 = 0)"),
):
    add("b_" + _id.lower().replace("-", "_"), lambda spark, sf_dir, i=_id: syntax_rules.module_findings(_texts(spark, sf_dir)).where(F.col("rule_id") == i).select("path", F.lit(1).alias("n")), f"WITH {_T} SELECT path, 1 AS n FROM t WHERE {_where}")
