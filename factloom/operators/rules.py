"""Policy rules: each is a query over fact relations that returns findings.

``evaluate`` unions the rules that are asked for; relations that a catalog lacks count as empty. A rule of one's own is
added by ``register_rule``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.functions.roles import inside_any
from factloom.operators import aggregates as A
from factloom.schemas import SCHEMAS, empty


# fixed values
TEST_UTILITIES = ("TestClock", "TestServices", "TestAnnotations", "TestAnnotation", "TestContext", "TestLive", "TestSized", "TestConfig")


class Catalog:
    """Relations by name; those that are missing are empty. A relation may be given as a function that makes it when it is first asked for."""

    def __init__(self, spark: SparkSession, relations: dict[str, DataFrame | Callable[[], DataFrame]]):
        self.spark, self.relations = spark, relations

    def __getitem__(self, name: str) -> DataFrame:
        found = self.relations.get(name)
        if found is None:
            return empty(self.spark, name)
        if not isinstance(found, DataFrame):
            found = self.relations[name] = found()
        return found

    @property
    def source_modules(self) -> DataFrame:
        return self["modules"].where("is_valid AND role NOT IN ('test', 'declaration', 'config')")

    @property
    def effect_modules(self) -> DataFrame:
        return self.source_modules.where("role != 'entrypoint'")

    def of(self, relation: str, modules: DataFrame) -> DataFrame:
        return self[relation].join(modules.select("path"), "path", "left_semi")

    def has_extension(self, name: str) -> bool:
        return not self["extensions"].where(F.col("name") == name).isEmpty()

    @property
    def dependencies(self) -> DataFrame:
        from factloom.operators.joins import owner_dependencies

        return self["owner_dependencies"] if "owner_dependencies" in self.relations else owner_dependencies(self["edges"], self["modules"])


@dataclass(frozen=True)
class Rule:
    id: str
    pack: str
    severity: str
    title: str
    run: Callable[[Catalog], DataFrame] | None  # None: declared, never evaluated


RULES: dict[str, Rule] = {}


def register_rule(id: str, pack: str, severity: str, title: str) -> Callable:
    """A function from a catalog to rows of path, line, col and summary becomes a rule."""

    def add(f: Callable[[Catalog], DataFrame]) -> Callable[[Catalog], DataFrame]:
        RULES[id] = Rule(id, pack, severity, title, f)
        return f

    return add


_COLUMNS = ("path", "line", "col", "summary", "labels")


def _rows(df: DataFrame, summary: Column, line: Column | None = None, labels: dict[str, Column] | None = None, path: Column | None = None) -> DataFrame:
    """A finding for each row; without a line it stands at line 1, column 0."""
    at = F.coalesce(line, F.lit(1)) if line is not None else F.lit(1)
    col = F.coalesce(F.col("col"), F.lit(0)) if line is not None and "col" in df.columns else F.lit(0)
    pairs = [x for k, v in (labels or {}).items() for x in (F.lit(k), v.cast("string"))]
    return df.select((path if path is not None else F.col("path")).alias("path"), at.cast("int").alias("line"), col.cast("int").alias("col"), summary.cast("string").alias("summary"), (F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")).alias("labels"))


def _text(*parts: str | Column) -> Column:
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def evaluate(catalog: Catalog, ids: list[str] | None = None) -> DataFrame:
    """Findings of the rules, packs in order, with rule, pack, severity and title."""
    chosen = [r for r in RULES.values() if r.run is not None and (ids is None or r.id in ids)]
    each = [r.run(catalog).select(*_COLUMNS).select(F.lit(r.id).alias("rule_id"), F.lit(r.pack).alias("pack"), F.lit(r.severity).alias("severity"), F.lit(r.title).alias("title"), *_COLUMNS) for r in chosen]
    if not each:
        return empty(catalog.spark, "findings").drop("seq").select("rule_id", "pack", "severity", "title", *_COLUMNS)
    return reduce(DataFrame.unionByName, each)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r.id, r.pack, r.severity, r.title, r.title, {}) for r in RULES.values()], "rule_id string, pack string, severity string, title string, requirement string, labels map<string,string>")


# --- syntax, semantic, project ---------------------------------------------------------------------------------------


def _diagnostics(phase: str) -> Callable[[Catalog], DataFrame]:
    return lambda c: _rows(c["diagnostics"].where(F.col("phase") == phase), F.col("message"), F.col("line"), {"code": F.col("code")})


for _id, _pack, _severity, _title, _phase in (
    ("TS-SYN-R001", "syntax", "error", "Source parses", "syntax"),
    ("TS-SEM-R001", "semantic", "info", "Types check", "semantic"),
    ("TS-AGENT-PROJECT-002", "project", "error", "Compiler configuration is readable", "config"),
    ("TS-AGENT-PROJECT-003", "project", "info", "Package manifest is readable", "package-json"),
):
    register_rule(_id, _pack, _severity, _title)(_diagnostics(_phase))


@register_rule("TS-AGENT-PROJECT-001", "project", "warning", "Declare a compiler configuration")
def _no_config(c: Catalog) -> DataFrame:
    return _rows(c["project"].where("mode = 'project' AND config_path IS NULL"), F.lit("the project has no compiler configuration"), path=F.lit("."))


@register_rule("TS-AGENT-PROJECT-004", "project", "info", "Referenced packages are composite")
def _references(c: Catalog) -> DataFrame:
    """A package without a configuration, or whose options lack one of two; options that can't be known (null) are not judged."""
    known = F.col("config_path").isNotNull()
    lacks = F.array_compact(F.array(F.when(~known, "config"), F.when(known & ~F.col("composite"), "composite"), F.when(known & ~F.col("declaration"), "declaration")))
    r = c["reference_packages"].withColumn("lacks", lacks).where("size(lacks) > 0")
    return _rows(r, _text(F.coalesce("name", "path"), " lacks ", F.array_join("lacks", ", ")), labels={"lacks": F.array_join("lacks", ",")}, path=F.coalesce("config_path", F.concat("path", F.lit("/package.json"))))


@register_rule("TS-AGENT-PROJECT-005", "project", "info", "Module resolution knows package entries")
def _resolution(c: Catalog) -> DataFrame:
    entries = c["package_entries"].where("source IN ('exports', 'imports')").limit(1).select(F.lit(True).alias("has"))
    p = c["project"].where("coalesce(lower(module_resolution), '') NOT IN ('node16', 'nodenext', 'bundler')").join(entries)  # one row each
    return _rows(p, _text("module resolution is ", F.coalesce("module_resolution", F.lit("unset"))), path=F.coalesce("config_path", F.lit(".")))


@register_rule("TS-AGENT-PROJECT-006", "project", "info", "A visible build tool has a script")
def _build_tool(c: Catalog) -> DataFrame:
    return _rows(c["build_tools"].where("name = 'rspack' AND NOT has_script"), _text("no script runs ", F.col("name")), path=F.lit("package.json"))


# --- modularity and tests --------------------------------------------------------------------------------------------


@register_rule("TS-MOD-R001", "modularity", "info", "Production code doesn't depend on tests")
def _prod_on_test(c: Catalog) -> DataFrame:
    d = c.dependencies.where("from_role NOT IN ('test', 'config', 'declaration') AND to_role = 'test'")
    return _rows(d, _text("depends on ", F.col("to_path")), F.col("line"), {"target": F.col("to_path")}, F.col("from_path"))


@register_rule("TS-MOD-R002", "modularity", "info", "A module has bounded responsibilities")
def _bounded(c: Catalog) -> DataFrame:
    n = c["responsibilities"].where("kind IN ('function', 'class', 'call')").groupBy("path").agg(F.count("*").alias("n"))
    m = c["modules"].where("role != 'declaration' AND n_lines > 1000").join(n.where("n > 8"), "path")
    return _rows(m, _text(F.col("n_lines"), " lines, ", F.col("n"), " responsibilities"), labels={"lines": F.col("n_lines"), "responsibilities": F.col("n")})


@register_rule("TS-TEST-R001", "test-layout", "info", "Tests lie in test roots")
def _test_layout(c: Catalog) -> DataFrame:
    roots = [r for row in c["project"].select("test_roots").limit(1).collect() for r in row.test_roots or []]
    tests = c["modules"].where("role = 'test'")
    return _rows(tests.where(~inside_any(F.col("path"), roots)) if roots else tests.limit(0), F.lit("a test outside the test roots"))


# --- agent policy ----------------------------------------------------------------------------------------------------


@register_rule("TS-AGENT-POLICY-001", "agent-policy", "info", "Imports resolve")
def _unresolved(c: Catalog) -> DataFrame:
    asset = reduce(lambda a, e: a | F.col("module_specifier").endswith(e), S.ASSET_EXTENSIONS, F.lit(False))
    return _rows(c.dependencies.where((F.col("resolution") == "unresolved") & ~asset), _text("can't resolve ", F.col("module_specifier")), F.col("line"), {"specifier": F.col("module_specifier")}, F.col("from_path"))


@register_rule("TS-AGENT-POLICY-002", "agent-policy", "info", "Package entries resolve")
def _entries(c: Catalog) -> DataFrame:
    return _rows(c["package_entries"].where("source IN ('exports', 'imports') AND resolution = 'unresolved'"), _text(F.col("subpath"), " names ", F.col("target")), path=F.lit("package.json"))


@register_rule("TS-AGENT-POLICY-003", "agent-policy", "info", "A facade over several owners says why")
def _facade(c: Catalog) -> DataFrame:
    facades = c.source_modules.where("role = 'facade' AND NOT has_intent_doc").select("path")
    n = A.distinct_targets(c.dependencies.where("kind = 'export'"), 2).withColumnRenamed("from_path", "path")
    return _rows(facades.join(n, "path"), _text("re-exports ", F.col("n_targets"), " owners without a comment"), labels={"owners": F.col("n_targets")})


def _by_function(c: Catalog, where: str, least: int) -> DataFrame:
    p = c.of("params", c.source_modules).where(where)
    return p.groupBy("path", "function_name", F.col("function_line").alias("line")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "param_name"))), lambda x: x["param_name"]).alias("names")).where(F.col("n") >= least)


@register_rule("TS-AGENT-POLICY-004", "agent-policy", "info", "Few flag parameters")
def _flags(c: Catalog) -> DataFrame:
    return _rows(_by_function(c, "flag_type IS NOT NULL", 2), _text(F.col("function_name"), " takes flags ", F.array_join("names", ", ")), F.col("line"), {"function": F.col("function_name")})


@register_rule("TS-AGENT-POLICY-005", "agent-policy", "info", "Few parameters")
def _many_params(c: Catalog) -> DataFrame:
    return _rows(_by_function(c, "true", 6), _text(F.col("function_name"), " takes ", F.col("n"), " parameters"), F.col("line"), {"function": F.col("function_name")})


@register_rule("TS-AGENT-POLICY-006", "agent-policy", "info", "No primitive tuples in public surfaces")
def _tuples(c: Catalog) -> DataFrame:
    return _rows(c.of("tuple_surfaces", c.source_modules), _text(F.col("function_name"), " ", F.col("surface_name"), " is ", F.col("type_text")), F.col("line"), {"function": F.col("function_name")})


def flow_shapes() -> Column:
    """Which of the four shapes of hard control flow a row has."""
    return F.array_compact(F.array(
        F.when(F.col("max_nesting") >= 5, "deep-nesting"), F.when((F.col("loops") >= 2) & (F.col("branches") >= 4), "loops-and-branches"),
        F.when((F.col("branches") >= 12) & (F.col("loops") == 0), "many-branches"), F.when(F.col("max_literal_chain") >= 4, "literal-dispatch"),
    ))


@register_rule("TS-AGENT-POLICY-007", "agent-policy", "info", "Control flow stays shallow")
def _flow(c: Catalog) -> DataFrame:
    f = c.of("control_flows", c.source_modules).withColumn("shapes", flow_shapes()).where("size(shapes) > 0")
    return _rows(f, _text(F.col("function_name"), ": ", F.array_join("shapes", ", ")), F.col("line"), {"function": F.col("function_name"), "shapes": F.array_join("shapes", ",")})


@register_rule("TS-AGENT-POLICY-008", "agent-policy", "info", "Linear work is cut into steps")
def _linear(c: Catalog) -> DataFrame:
    f = c.of("control_flows", c.source_modules)
    long = f.where("max_nesting <= 2 AND (line_span >= 90 AND statements >= 28 OR max_block_statements >= 22)")
    a = _rows(long, _text(F.col("function_name"), " is one long sequence"), F.col("line"), {"function": F.col("function_name"), "shape": F.lit("linear")})
    b = _rows(f.where("manual_transform_loops > 0"), _text(F.col("function_name"), " builds a list by hand"), F.col("line"), {"function": F.col("function_name"), "shape": F.lit("manual-transform")})
    return a.unionByName(b)


def _by_type(c: Catalog, where: Column, least: int) -> DataFrame:
    f = c.of("data_fields", c.source_modules).where(F.col("primitive_type").isNotNull() & where)
    return f.groupBy("path", "type_kind", "type_name", F.col("type_line").alias("line")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "field_name"))), lambda x: x["field_name"]).alias("names")).where(F.col("n") >= least)


@register_rule("TS-AGENT-POLICY-009", "agent-policy", "info", "Semantic fields have types of their own")
def _semantic_fields(c: Catalog) -> DataFrame:
    return _rows(_by_type(c, S.is_semantic_name(F.col("field_name")), 3), _text(F.col("type_name"), " has plain ", F.array_join("names", ", ")), F.col("line"), {"type": F.col("type_name")})


@register_rule("TS-AGENT-POLICY-010", "agent-policy", "info", "Semantic aliases aren't plain primitives")
def _semantic_alias(c: Catalog) -> DataFrame:
    a = c.of("type_aliases", c.source_modules).where(F.col("primitive_type").isNotNull() & S.is_semantic_alias(F.col("alias_name")))
    return _rows(a, _text(F.col("alias_name"), " is ", F.col("type_text")), F.col("line"), {"alias": F.col("alias_name")})


@register_rule("TS-AGENT-POLICY-011", "agent-policy", "info", "States are closed unions")
def _states(c: Catalog) -> DataFrame:
    return _rows(_by_type(c, (F.col("primitive_type") == "string") & S.is_state_name(F.col("field_name")), 1), _text(F.col("type_name"), " keeps states as strings: ", F.array_join("names", ", ")), F.col("line"), {"type": F.col("type_name")})


@register_rule("TS-AGENT-POLICY-012", "agent-policy", "info", "Variants carry typed payloads")
def _variants(c: Catalog) -> DataFrame:
    v = c.of("variant_fields", c.source_modules.where("layer IS NULL OR layer != 'model'")).where(F.col("primitive_type").isNotNull() & S.is_semantic_name(F.col("field_name")))
    g = v.groupBy("path", "union_name", "variant_name", "discriminant_name").agg(F.min("line").alias("line"), F.count("*").alias("n")).where("n >= 2")
    return _rows(g, _text(F.col("union_name"), ".", F.col("variant_name"), " has ", F.col("n"), " plain fields"), F.col("line"), {"union": F.col("union_name")})


@register_rule("TS-AGENT-POLICY-013", "agent-policy", "info", "Owners say what they are for")
def _undocumented(c: Catalog) -> DataFrame:
    from factloom.operators.ranking import undocumented
    from factloom.operators.search import branches

    return _rows(undocumented(branches(c)), _text(F.size("export_names"), " exports and no comment that says what the module is for"), labels={"exports": F.size("export_names")})


@register_rule("TS-AGENT-POLICY-014", "agent-policy", "info", "One import for each specifier")
def _repeated(c: Catalog) -> DataFrame:
    from factloom.operators.search import branches

    own = branches(c).where("role IN ('source', 'facade')").select(F.col("path").alias("from_path"))
    d = c.dependencies.where("NOT is_test_context").join(own, "from_path", "left_semi")
    return _rows(A.repeated_specifiers(d), _text(F.col("module_specifier"), " is imported ", F.col("n"), " times"), labels={"specifier": F.col("module_specifier"), "count": F.col("n")}, path=F.col("from_path"))


@register_rule("TS-AGENT-POLICY-015", "agent-policy", "info", "A wide facade says why")
def _wide(c: Catalog) -> DataFrame:
    f = c.source_modules.where("role = 'facade' AND NOT has_intent_doc AND size(export_names) > 30").orderBy("path").limit(10)
    return _rows(f, _text(F.size("export_names"), " exports without a comment"))


@register_rule("TS-AGENT-POLICY-016", "agent-policy", "info", "Error types are documented")
def _errors(c: Catalog) -> DataFrame:
    named = F.filter("export_names", lambda n: n.rlike("(Error|Exception|Failure|Fault)$"))
    f = c.source_modules.where("NOT has_intent_doc").withColumn("names", named).where("size(names) >= 2").orderBy("path").limit(20)
    return _rows(f, _text("exports ", S.capped_names(F.col("names"), 5), " without a comment"))


# --- extensions ------------------------------------------------------------------------------------------------------


def _needs(c: Catalog, extension: str, packages: list[str]) -> DataFrame:
    missing = c["extensions"].where((F.col("name") == extension) & ~F.coalesce("installed", F.lit(False)))
    return _rows(missing, _text(extension, " is enabled without ", " or ".join(packages)), path=F.lit("package.json"))


def _first_per_module(df: DataFrame, what: str) -> DataFrame:
    """One finding for each module, at its first row, with the number of rows."""
    g = df.groupBy("path").agg(F.min_by(F.struct("line", F.coalesce("owner_name", F.lit("")).alias("owner"), F.coalesce("callee", F.lit("")).alias("callee")), "seq").alias("first"), F.count("*").alias("n"))
    return _rows(g, _text(what, ": ", F.col("first.owner"), " ", F.col("first.callee"), " (", F.col("n"), ")"), F.col("first.line"), {"owner": F.col("first.owner"), "count": F.col("n")})


def _signals(c: Catalog, family: str, modules: DataFrame, extension: str, what: str) -> DataFrame:
    s = c.of("signals", modules).where(F.col("family") == family)
    return _first_per_module(s if c.has_extension(extension) else s.limit(0), what)


@register_rule("TS-EXT-EFFECT-R001", "effect", "error", "The extension's package is installed")
def _effect_missing(c: Catalog) -> DataFrame:
    return _needs(c, "effect", ["effect"])


@register_rule("TS-EXT-EFFECT-R002", "effect", "info", "Public asynchronous surfaces return effects")
def _effect_async(c: Catalog) -> DataFrame:
    s = c.of("async_surfaces", c.effect_modules).where("(is_async OR returns_promise) AND NOT returns_effect")
    s = s.withColumn("owner_name", F.col("name")).withColumn("callee", F.lit(""))
    return _first_per_module(s if c.has_extension("effect") else s.limit(0), "a promise surface")


@register_rule("TS-EXT-EFFECT-R003", "effect", "info", "Effects run at boundaries")
def _effect_run(c: Catalog) -> DataFrame:
    s = c.of("signals", c.effect_modules).where("family = 'runtime-call' AND NOT array_contains(kinds, 'query-hook')")
    return _first_per_module(s if c.has_extension("effect") else s.limit(0), "an effect runs outside a boundary")


@register_rule("TS-EXT-EFFECT-R004", "effect", "info", "Service methods have no requirements")
def _effect_requirements(c: Catalog) -> DataFrame:
    s = c.of("service_methods", c.source_modules).where("requirements IS NOT NULL AND requirements != 'never'")
    return _rows(s if c.has_extension("effect") else s.limit(0), _text(F.col("container_name"), ".", F.col("method_name"), " requires ", F.col("requirements")), F.col("line"), {"method": F.col("method_name")})


@register_rule("TS-EXT-EFFECT-R005", "effect", "info", "Error channels are typed")
def _effect_errors(c: Catalog) -> DataFrame:
    a = c.of("async_surfaces", c.effect_modules).where("error_kind = 'weak'").select("path", "seq", "line", F.col("name").alias("owner_name"), F.lit("").alias("callee"))
    b = c.of("service_methods", c.effect_modules).where("error_kind = 'weak'").select("path", (F.col("seq") + 1_000_000).alias("seq"), "line", F.col("container_name").alias("owner_name"), F.col("method_name").alias("callee"))
    both = a.unionByName(b)
    return _first_per_module(both if c.has_extension("effect") else both.limit(0), "a weak error channel")


for _id, _family, _what in (
    ("TS-EXT-EFFECT-R006", "promise-interop", "promise interop that can reject"), ("TS-EXT-EFFECT-R007", "resource-scope", "a resource without a scope"), ("TS-EXT-EFFECT-R008", "concurrency", "unbounded concurrency"),
    ("TS-EXT-EFFECT-R009", "schema-boundary", "JSON that no schema decodes"), ("TS-EXT-EFFECT-R010", "production-boundary", "external work without observability or resilience"),
):
    register_rule(_id, "effect", "info", _what.capitalize())(lambda c, f=_family, w=_what: _signals(c, f, c.effect_modules, "effect", w))


@register_rule("TS-EXT-EFFECT-R011", "effect", "warning", "Sources export no test utilities")
def _test_exports(c: Catalog) -> DataFrame:
    named = F.filter("export_names", lambda n: n.rlike("|".join(TEST_UTILITIES)))
    m = c.source_modules.where("role = 'source' AND path NOT LIKE '%/test/%' AND path NOT LIKE '%.test.%'").withColumn("names", named).where("size(names) > 0").orderBy("path").limit(10)
    return _rows(m, _text("exports ", S.capped_names(F.col("names"), 5)))


@register_rule("TS-EXT-EFFECT-R012", "effect", "warning", "Services are layers")
def _services(c: Catalog) -> DataFrame:
    uses = c.dependencies.where("module_specifier = 'effect' OR module_specifier LIKE 'effect/%'").select(F.col("from_path").alias("path"))
    m = c.source_modules.where(F.exists("export_names", lambda n: n.contains("Service"))).join(uses.distinct(), "path", "left_semi")
    return _rows(m, F.lit("exports a service beside an effect import"))


@register_rule("TS-EXT-EFFECT-R013", "effect", "warning", "Forks keep their fiber refs")
def _forks(c: Catalog) -> DataFrame:
    refs = c.dependencies.where("module_specifier LIKE '%FiberRef%'").select(F.col("from_path").alias("path"))
    m = c.source_modules.where(F.exists("export_names", lambda n: F.lower(n).contains("fork"))).join(refs.distinct(), "path", "left_anti")
    return _rows(m, F.lit("exports a fork without fiber refs"))


@register_rule("TS-EXT-REACT-R001", "react", "error", "The extension's package is installed")
def _react_missing(c: Catalog) -> DataFrame:
    return _needs(c, "react", ["react"])


for _id, _severity, _family, _what in (("TS-EXT-REACT-R002", "info", "render-purity", "an impure render"), ("TS-EXT-REACT-R003", "error", "hook-call", "a hook out of order"), ("TS-EXT-REACT-R004", "info", "static-definition", "a definition inside a render")):
    register_rule(_id, "react", _severity, _what.capitalize())(lambda c, f=_family, w=_what: _signals(c, f, c.source_modules, "react", w))


@register_rule("TS-EXT-SHADCN-R001", "shadcn", "error", "Tailwind is installed")
def _shadcn(c: Catalog) -> DataFrame:
    tailwind = c["package_dependencies"].where("name = 'tailwindcss'").select(F.lit(1).alias("one")).limit(1)
    missing = c["extensions"].where("name = 'shadcn'").join(tailwind, how="left_anti")  # a few rows
    return _rows(missing, F.lit("shadcn is enabled without tailwindcss"), path=F.lit("package.json"))


for _id, _title in (("TS-EXT-SHADCN-R002", "Components are owned"), ("TS-EXT-SHADCN-R003", "Variants are declared")):
    RULES[_id] = Rule(_id, "shadcn", "info", _title, None)


def exit_code(findings: DataFrame, errors: DataFrame | None = None) -> int:
    """0: clean, 1: blocking findings, 2: something asked for can't be run (``errors`` has a row)."""
    from factloom.operators.filters import blocking

    if errors is not None and not errors.isEmpty():
        return 2
    return 0 if blocking(findings).isEmpty() else 1


def numbered(findings: DataFrame) -> DataFrame:
    """The findings with their sequence: packs as evaluated, then path, line and summary."""
    order = F.create_map(*[x for i, r in enumerate(RULES) for x in (F.lit(r), F.lit(i))])
    w = Window.partitionBy("rule_id").orderBy("path", "line", "summary")
    return findings.withColumn("seq", (order[F.col("rule_id")].cast("bigint") * 1_000_000_000 + F.row_number().over(w)).cast("bigint"))


__all__ = ["Catalog", "RULES", "SCHEMAS", "evaluate", "exit_code", "numbered", "register_rule", "rule_table"]
