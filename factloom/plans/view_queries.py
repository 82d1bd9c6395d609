"""Every search view over relations read off the driver's tables, with SQL of its own."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import search
from factloom.operators.rules import Catalog
from factloom.plans import analogues as R
from factloom.plans import rule_queries as Q
from factloom.plans.registry import add
from factloom.schemas import conform
from factloom.sources import files as src

_LOCK = json.dumps({"packages": {"node_modules/lib4": {"version": "4.0.1"}}})


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = Q.modules(spark, sf_dir).select("path", F.posexplode("export_names").alias("at", "name"))
    return conform(named.select("path", F.col("at").alias("seq"), "name", F.lit("function").alias("kind"), (F.col("at") + 1).alias("line")), "exports")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(R.files(spark, sf_dir).select("path", F.col("text").alias("content"), F.lit(0).cast("bigint").alias("mtime_ms")), "source_files")


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    text = F.to_json(F.struct(F.concat(F.lit("id-"), (k % 50).cast("string")).alias("$id"), F.col("c_mktsegment").alias("title"), F.struct(k.alias("number"), F.array(F.col("c_name")).alias("names")).alias("properties")))
    return src.all_schema_leaves(R.table(spark, sf_dir, "customer").select(F.concat(F.lit("schemas/c"), k.cast("string"), F.lit(".schema.json")).alias("path"), text.alias("content")))


RELATIONS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "modules": Q.modules, "owner_dependencies": Q.dependencies, "edges": Q.dependencies, "exports": _exports, "source_files": _files, "schema_leaves": _schemas, "findings": lambda spark, sf_dir: conform(R.findings(spark, sf_dir), "findings"),
    "package_dependencies": Q.of("supplier", "s_suppkey", "package_dependencies", name="concat(if(k % 3 = 0, '@types/', ''), 'lib', k % 40)", version_range="concat('^', k % 7)", source="if(k % 2 = 0, 'dependencies', 'devDependencies')"),
    "package_scripts": Q.of("nation", "n_nationkey", "package_scripts", name="concat('script', k)", command="concat('run ', k % 4)"),
    "workspace_packages": Q.of("supplier", "s_suppkey", "workspace_packages", path="concat(element_at(array('docs/', 'playground/', 'packages/tests/', 'packages/'), int(k % 4 + 1)), 'w', k)", name="concat('lib', k)", pattern="if(k % 3 = 0, 'packages/**', 'packages/*')"),
    "extensions": Q.of("region", "r_regionkey", "extensions", name="concat('ext', k)", activation="if(k % 2 = 0, 'dependency', 'config')", installed="true"),
    "project": lambda spark, sf_dir: R.table(spark, sf_dir, "region").agg(F.when(F.count("*") > 3, "Bundler").otherwise("Node16").alias("module_resolution")).selectExpr("'project' AS mode", "'tsconfig.json' AS config_path", "module_resolution", "array('src') AS source_roots", "array('tests') AS test_roots"),
    "build_tools": lambda spark, sf_dir: R.table(spark, sf_dir, "nation").where("n_regionkey = 2").selectExpr("concat('tool', n_nationkey) AS name", "n_nationkey % 2 = 0 AS has_script"),
    "imports": Q.facts("imports", module_specifier="concat('lib', s, if(n % 2 = 0, '/sub', ''))", kind="'import'"),
    "calls": Q.facts("calls", owner="'f'", callee="concat('x', o % 3, '.parse', n)", is_new="false"),
    "params": Q.facts("params", function_name="concat('open', n)", function_line="1", param_name="'p'", type_text="CASE WHEN o % 4 = 0 THEN concat('import(\"lib', s, '\").Row') WHEN o % 4 = 1 THEN 'Row' WHEN o % 4 = 2 THEN 'Array<string>' END"),
    "data_fields": Q.facts("data_fields", type_kind="'interface'", type_name="concat('Open', n)", type_line="1", field_name="concat('field', s % 5)", type_text="element_at(array('string', 'string[]', 'Map<string, Row>', 'Row'), int(o % 4 + 1))"),
    "type_aliases": Q.facts("type_aliases", alias_name="concat('Alias', n)", type_text="'string'"), "variant_fields": Q.facts("variant_fields", union_name="concat('Union', n)", variant_name="'v'", discriminant_name="'kind'", field_name="'f'"),
    "async_surfaces": Q.facts("async_surfaces", name="concat('open', n % 2)"), "service_methods": Q.facts("service_methods", container_kind="'class'", container_name="'C'", method_name="concat('reopen', n)"),
    "items": Q.facts("items", name="concat(if(n % 2 = 0, 'parse', 'item'), o)", kind="element_at(array('function', 'class', 'variable'), n % 3 + 1)", is_exported="true", is_private="false", line_end="int(o % 97 + 2)"),
}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, {k: (lambda f=f: f(spark, sf_dir)) for k, f in RELATIONS.items()})


#: Results that rest on fixed lists alone: name -> (plan, SQL); the tests hold them beside each other, they are no queries over tables.
FIXED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}


def view(name: str, result: str, columns: str, sql: str, query: str = "", as_: str = "", fixed: bool = False, **options: object) -> None:
    """Registers one result of a view, its columns picked by expressions; ``fixed`` ones for the tests only."""

    def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.search(catalog(spark, sf_dir), name, query, **options)[result].selectExpr(*columns.split("; "))

    if fixed:
        FIXED[as_ or "v_" + name.replace("-", "_")] = (plan, sql)
    else:
        add(as_ or "v_" + name.replace("-", "_"), plan, sql)


D, B = Q.D, Q._B
_NAMES = """names AS (SELECT path, i AS line, v[i] AS name FROM (SELECT 'src/p' || p_partkey || '.ts' AS path, list_concat(list_concat(list_concat(list_concat(list_transform(range(1, p_partkey % 12 + 1), lambda i: 'name' || i), CASE WHEN p_partkey % 7 = 0 THEN ['ParseError', 'ReadFailure'] ELSE [] END), CASE WHEN p_partkey % 11 = 0 THEN ['TestClockLive'] ELSE [] END),
   CASE WHEN p_partkey % 9 = 0 THEN ['UserService'] ELSE [] END), CASE WHEN p_partkey % 10 = 0 THEN ['forkAll'] ELSE [] END) AS v FROM part), unnest(range(1, len(v) + 1)) AS u(i))"""

view("symbol", "hits", "path; name; int(line) AS line; score", f"WITH {_NAMES} SELECT path, name, CAST(line AS INTEGER) AS line, CASE WHEN name = 'name1' THEN 10 ELSE 5 END AS score FROM names WHERE contains(name, 'name1') ORDER BY score DESC, path, line LIMIT 20", "Name1")
view("callsite", "hits", "from_path; to_path; seq; score", f"WITH {D}, {_NAMES} SELECT path AS from_path, to_path, seq, CASE WHEN kind = 'export' THEN 3 ELSE 4 END AS score FROM d WHERE path <> to_path AND to_path IN (SELECT path FROM names WHERE name = 'ParseError') ORDER BY score DESC, path, seq LIMIT 30", "parseError")
view("import", "hits", "from_path; module_specifier; seq; score", f"WITH {D} SELECT path AS from_path, spec AS module_specifier, seq, CASE WHEN spec = 'effect' THEN 6 ELSE 3 END AS score FROM d WHERE contains(spec, 'effect') ORDER BY score DESC, path, seq LIMIT 30", "effect")
view("import", "edges", "from_path; to_path", f"WITH {D}, h AS (SELECT path, to_path, seq, CASE WHEN spec = 'effect' THEN 6 ELSE 3 END AS score FROM d WHERE contains(spec, 'effect') ORDER BY score DESC, path, seq LIMIT 30) SELECT DISTINCT path AS from_path, to_path FROM h", "effect", "v_import_edges")
view("policy", "hits", "rule_id; severity", "SELECT * FROM (VALUES ('TS-AGENT-POLICY-003', 'info'), ('TS-AGENT-POLICY-015', 'info')) v(rule_id, severity)", "Facade", fixed=True)
_PD = "pd AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN '@types/' ELSE '' END || 'lib' || (s_suppkey % 40) AS name, '^' || (s_suppkey % 7) AS version_range, CASE WHEN s_suppkey % 2 = 0 THEN 'dependencies' ELSE 'devDependencies' END AS source FROM supplier)"
view("dependency", "hits", "name; source; score", f"WITH {_PD} SELECT name, source, CASE WHEN name = 'lib4' THEN 10 ELSE 6 END AS score FROM pd WHERE contains(name, 'lib4') ORDER BY score DESC, name, source LIMIT 12", "lib4")
view("deps", "hits", "name; source; status; scope", f"WITH {_PD} SELECT name, source, 'locked' AS status, 'current' AS scope FROM pd WHERE name = 'lib4'", "lib4::parse3", lockfile=_LOCK)
view("deps", "usage", "path; callee; call_line", f"WITH {_PD}, i AS (SELECT DISTINCT 'src/p' || l_partkey || '.ts' AS path FROM lineitem WHERE l_suppkey = 4 AND EXISTS (SELECT 1 FROM pd WHERE name = 'lib4')) SELECT path, 'x' || (l_orderkey % 3) || '.parse3' AS callee, CAST(l_orderkey % 97 + 1 AS INTEGER) AS call_line FROM lineitem JOIN i ON path = 'src/p' || l_partkey || '.ts' WHERE l_linenumber = 3", "lib4::parse3", "v_deps_usage", lockfile=_LOCK)
view("deps", "hits", "name; status; scope", f"WITH {_PD} SELECT name, 'external-version' AS status, 'external' AS scope FROM pd WHERE name = 'lib4'", "lib4@9.9.9::parse3", "v_deps_external", lockfile=_LOCK)
view("docs", "hits", "path; score; pointer", "SELECT 'schemas/c' || c_custkey || '.schema.json' AS path, 12 AS score, '/$id' AS pointer FROM customer WHERE contains('id-' || (c_custkey % 50), 'id-7') ORDER BY path LIMIT 12", "id-7")
view("docs", "hits", "path; score; pointer", "SELECT 'schemas/c' || c_custkey || '.schema.json' AS path, 8 AS score, '/title' AS pointer FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY path LIMIT 12", "Build", "v_docs_title")
_P = "'src/p' || l_partkey || '.ts'"
view(
    "api", "hits", "path; kind; symbol; score", f"""WITH r AS (SELECT {_P} AS path, l_orderkey % 97 + 1 AS line, l_linenumber AS n FROM lineitem), f AS (SELECT path, 'function' AS kind, 'open' || n AS symbol, CASE WHEN n = 1 THEN 12 END AS score, line FROM r UNION ALL SELECT path, 'data', 'Open' || n, CASE WHEN n = 1 THEN 10 END, line FROM r
 UNION ALL SELECT path, 'async', 'open' || (n % 2), CASE WHEN n % 2 = 1 THEN 9 END, line FROM r UNION ALL SELECT path, 'service', 'reopen' || n, CASE WHEN n = 1 THEN 4 END, line FROM r), g AS (SELECT path, kind, symbol, score, min(line) AS line FROM f WHERE score IS NOT NULL GROUP BY path, kind, symbol, score)
 SELECT path, kind, symbol, score FROM g ORDER BY score DESC, path, line, symbol LIMIT 20""",
    "open1",
)
view("api", "hits", "path", "SELECT 'x' AS path WHERE false", "lib4::open", "v_api_of_a_package", fixed=True)
view(
    "public-external-types", "nodes", "path; n_confirmed; n_possible", f"""WITH u AS (SELECT DISTINCT {_P} AS path FROM lineitem WHERE l_suppkey = 3), h AS (SELECT {_P} AS path, CASE WHEN l_orderkey % 4 = 0 AND l_suppkey = 3 THEN 'direct' WHEN l_orderkey % 4 IN (0, 1) AND {_P} IN (SELECT path FROM u) THEN 'possible' END AS match FROM lineitem
 UNION ALL SELECT {_P}, CASE WHEN l_orderkey % 4 IN (2, 3) AND {_P} IN (SELECT path FROM u) THEN 'possible' END FROM lineitem) SELECT path, count(*) FILTER (WHERE match = 'direct') AS n_confirmed, count(*) FILTER (WHERE match = 'possible') AS n_possible FROM h WHERE match IS NOT NULL GROUP BY path""",
    "lib3",
)
view(
    "workspace", "packages", "path; score", f"""WITH p AS (SELECT s_suppkey AS k, ['docs/', 'playground/', 'packages/tests/', 'packages/'][s_suppkey % 4 + 1] || 'w' || s_suppkey AS path FROM supplier), c AS (SELECT path, CASE k % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 40 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 10 ELSE 0 END - CASE WHEN k IN (SELECT l_suppkey FROM lineitem) THEN 5 ELSE 0 END AS score FROM p)
 SELECT path, score FROM c ORDER BY score, len(string_split(path, '/')), path LIMIT 24""",
)
view("workspace", "edges", "path; package; via", f"SELECT DISTINCT {_P} AS path, 'lib' || l_suppkey AS package, CASE WHEN l_linenumber % 2 = 0 THEN 'package-subpath' ELSE 'package-name' END AS via FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) ORDER BY path, package, via LIMIT 8", as_="v_workspace_edges")
view("workspace", "findings", "severity; rule_id; n", f"WITH {R.FINDINGS} SELECT severity, rule_id, count(*) AS n FROM findings GROUP BY severity, rule_id, title ORDER BY n DESC, rule_id LIMIT 8", as_="v_workspace_findings")
_RANK = "k AS (SELECT b.path, CASE WHEN role IN ('facade', 'entrypoint') THEN 100 ELSE 0 END + CASE WHEN role = 'entrypoint' THEN 80 ELSE 0 END + CASE WHEN n_exports > 0 THEN 40 ELSE 0 END + least(coalesce(x.n, 0), 10) AS rank FROM b LEFT JOIN (SELECT path, count(*) AS n FROM d GROUP BY path) x ON x.path = b.path ORDER BY rank DESC, b.path LIMIT 8)"
view("prime", "owners", "path; rank", f"WITH {D}, {B}, {_RANK} SELECT path, rank FROM k")
view("prime", "frontier", "path; n", f"WITH {D}, {B}, {_RANK} SELECT CASE WHEN path IN (SELECT path FROM k) THEN to_path ELSE path END AS path, count(*) AS n FROM d WHERE (path IN (SELECT path FROM k)) <> (to_path IN (SELECT path FROM k)) GROUP BY 1", as_="v_prime_frontier")
view(
    "prime", "axes", "id; kind; path; concat_ws(',', fields['source'], fields['tests'], fields['stories'], fields['activation'], fields['has_script'], fields['next']) AS fields", f"""WITH {Q.M}
 SELECT 'TSCONFIG:project' AS id, 'tsconfig' AS kind, 'tsconfig.json' AS path, 'typescript-config-parser' AS fields UNION ALL SELECT 'SURFACE:test', 'test_surface', '.', CAST(count(*) FILTER (WHERE role = 'test') AS VARCHAR) || ',0,tests:.' FROM m
 UNION ALL SELECT 'X:ext' || r_regionkey, 'extension', 'ext' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'dependency' ELSE 'config' END || ',extension:ext' || r_regionkey FROM region
 UNION ALL SELECT 'B:tool' || n_nationkey, 'build_tool', 'tool' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'true' ELSE 'false' END || ',build-tool:tool' || n_nationkey FROM nation WHERE n_regionkey = 2""",
    as_="v_prime_axes",
)
view("owner", "edges", "direction; peer; module_specifier; kind", f"WITH {D} SELECT 'out' AS direction, to_path AS peer, spec AS module_specifier, kind FROM d WHERE path = 'src/p6.ts' UNION ALL SELECT 'in', path, spec, kind FROM d WHERE to_path = 'src/p6.ts'", "src/p6")
view("owner", "owners", "path", f"WITH {D}, {B}, {_NAMES} SELECT min(path) AS path FROM b WHERE path IN (SELECT path FROM names WHERE name = 'forkAll')", "forkAll", "v_owner_by_export")
view(
    "tests", "edges", "test_path; source_path; reason; score", f"""WITH RECURSIVE {D}, g AS (SELECT DISTINCT path, to_path FROM d WHERE from_role <> 'test'), walk(node, depth) AS (SELECT 'src/p6.ts', 1 UNION SELECT g.path, w.depth + 1 FROM walk w JOIN g ON g.to_path = w.node WHERE w.depth < 8), reach AS (SELECT DISTINCT node FROM walk),
 c AS (SELECT seq, path AS test_path, CASE WHEN to_path = 'src/p6.ts' THEN 8 WHEN contains(path, 'src/p6.ts') THEN 4 WHEN from_role = 'test' AND node IS NOT NULL THEN 6 END AS score FROM d LEFT JOIN reach ON node = to_path WHERE from_role = 'test' OR to_role = 'test'), x AS (SELECT test_path, max(score) AS score FROM c WHERE score IS NOT NULL GROUP BY test_path)
 SELECT test_path, 'src/p6.ts' AS source_path, CASE score WHEN 8 THEN 'direct-import' WHEN 4 THEN 'test-path' ELSE 'transitive-import' END AS reason, score FROM x ORDER BY score DESC, test_path LIMIT 30""",
    "src/p6.ts",
)
view("lexical", "hits", "kind; path; score", f"WITH {R.LINES}, m AS (SELECT path, line, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM lines WHERE contains(lower(row), 'apache license')) SELECT 'text' AS kind, path, 26 AS score FROM m WHERE n <= 3 ORDER BY path, path || ':' || line || ':' || line LIMIT 12", "Apache License")
view("lexical", "coverage", "term; status", "SELECT * FROM (VALUES ('apache license', 'hit'), ('forkAll', 'hit'), ('§nowhere§', 'miss')) v(term, status)", as_="v_lexical_query_set", query_set=["apache license", "forkAll", "§nowhere§"])
view("reasoning", "edges", "direction; peer", f"WITH {D} SELECT 'out' AS direction, to_path AS peer FROM d WHERE path = 'src/p6.ts' UNION ALL SELECT 'in', path FROM d WHERE to_path = 'src/p6.ts'", "src/p6.ts", profile="owner-tests")
view("reasoning", "dependencies", "name; status", f"WITH {_PD} SELECT name, 'range-only' AS status FROM pd WHERE name = 'lib4'", "lib4", "v_reasoning_query_deps", profile="query-deps")
view("env", "facts", "kind; name; value", "SELECT 'script' AS kind, 'script' || n_nationkey AS name, 'run ' || (n_nationkey % 4) AS value FROM nation WHERE contains('script' || n_nationkey, 'script1') OR contains('script' || n_nationkey, 'script20')", "Script1 script20")
view("lang", "facts", "kind; name; value", "SELECT 'language' AS kind, 'typescript' AS name, CASE WHEN count(*) > 3 THEN 'Bundler' ELSE 'Node16' END AS value FROM region")
view("std", "facts", "name; value", f"WITH {_PD} SELECT name, version_range AS value FROM pd WHERE name LIKE '@types/%' AND contains(name, 'lib3')", "lib3")
view("capability", "facts", "name", "SELECT unnest(['policy', 'public-external-types']) AS name", "polic public", fixed=True)
view("extension", "facts", "name; value", "SELECT 'ext' || r_regionkey AS name, CASE WHEN r_regionkey % 2 = 0 THEN 'dependency' ELSE 'config' END AS value FROM region")
view("pattern", "facts", "name", "SELECT unnest(['TS-MOD-R001', 'TS-MOD-R002']) AS name", "ts-mod-r", fixed=True)
view("compare", "facts", "name; value", f"WITH {_PD} SELECT name, version_range AS value FROM pd WHERE contains(version_range, '^5')", "^5")
view("runtime-source", "facts", "name", "SELECT 'x' AS name WHERE false", fixed=True)
view("ingest", "hits", "path; score", "SELECT * FROM (VALUES ('src/p4.ts', 2), ('src/p9.ts', 2)) v(path, score)", stream="src/p4.ts:3:7:let x\nno record here\nsrc/p9.ts:5:1:let y\n")
view(
    "semantic-facts", "edges", "source; target; relation", f"""WITH f AS (SELECT {_P} AS path, l_orderkey % 97 + 1 AS line, 'Open' || l_linenumber AS owner, 'field' || (l_suppkey % 5) AS field FROM lineitem WHERE l_orderkey % 4 = 2 ORDER BY path, line, field LIMIT 64)
 SELECT DISTINCT * FROM (SELECT 'field:' || owner || '.' || field AS source, 'type:Map<string, Row>' AS target, 'has_type' AS relation FROM f UNION ALL SELECT 'type:Map<string, Row>', 'collection:map', 'collection_of' FROM f UNION ALL SELECT 'field:' || owner || '.' || field, 'owner:' || owner, 'belongs_to' FROM f UNION ALL SELECT 'query:fields map', 'field:' || owner || '.' || field, 'matches' FROM f)""",
    "fields map",
)
view(
    "semantic-facts", "edges", "source; target; relation", f"""WITH f AS (SELECT {_P} AS path, l_orderkey % 97 + 1 AS line, 'Open' || l_linenumber AS owner, 'field' || (l_suppkey % 5) AS field FROM lineitem WHERE l_orderkey % 4 = 2 AND {_P} IN ('src/p4.ts', 'src/p9.ts') ORDER BY path, line, field LIMIT 64)
 SELECT DISTINCT * FROM (SELECT 'field:' || owner || '.' || field AS source, 'type:Map<string, Row>' AS target, 'has_type' AS relation FROM f UNION ALL SELECT 'type:Map<string, Row>', 'collection:map', 'collection_of' FROM f UNION ALL SELECT 'field:' || owner || '.' || field, 'owner:' || owner, 'belongs_to' FROM f UNION ALL SELECT 'query:fields map', 'field:' || owner || '.' || field, 'matches' FROM f)""",
    "fields map", "v_semantic_facts_of_a_stream", stream="src/p4.ts:3:7:let x\nno record here\nsrc/p9.ts:5:1:let y\n",
)
