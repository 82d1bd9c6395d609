"""A project from files to findings: configuration, relations of facts, resolution of imports, roles, evaluation, reports."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import cut, stored
from factloom.functions import roles
from factloom.functions import scalar as S
from factloom.operators import filters, joins, trees
from factloom.operators.rules import Catalog, evaluate, numbered
from factloom.schemas import conform, relation
from factloom.sources import files as src
from factloom.sources import tokens, typescript


@dataclass(frozen=True)
class Settings:
    """What a run takes into account; every ``with_`` method returns a changed copy."""

    source_dirs: tuple[str, ...] = ("src",)
    test_dirs: tuple[str, ...] = ("tests", "test")
    ignored_dirs: tuple[str, ...] = src.IGNORED_DIRECTORIES
    hidden_dirs: tuple[str, ...] = ()
    include_tests: bool = True
    blocking_severities: tuple[str, ...] = ("warning", "error")
    blocking_rules: tuple[str, ...] = ()
    disabled_rules: tuple[str, ...] = ()
    disabled_packs: tuple[str, ...] = ()
    rule_severities: tuple[tuple[str, str], ...] = ()
    pack_severities: tuple[tuple[str, str], ...] = ()
    disabled_task_kinds: tuple[str, ...] = ()
    extensions: tuple[str, ...] = field(default=())

    def _more(self, name: str, *values: object) -> Settings:
        return replace(self, **{name: tuple(dict.fromkeys((*getattr(self, name), *values)))})

    def with_disabled_rules(self, *ids: str) -> Settings:
        return self._more("disabled_rules", *ids)

    def with_disabled_packs(self, *packs: str) -> Settings:
        return self._more("disabled_packs", *packs)

    def with_rule_severity(self, rule: str, severity: str) -> Settings:
        return replace(self, rule_severities=tuple((dict(self.rule_severities) | {rule: severity}).items()))

    def with_pack_severity(self, pack: str, severity: str) -> Settings:
        return replace(self, pack_severities=tuple((dict(self.pack_severities) | {pack: severity}).items()))

    def with_source_dirs(self, *names: str) -> Settings:
        return self._more("source_dirs", *names)

    def with_test_dirs(self, *names: str) -> Settings:
        return self._more("test_dirs", *names)

    def with_ignored_dirs(self, *names: str) -> Settings:
        return self._more("ignored_dirs", *names)

    def with_hidden_dirs(self, *names: str) -> Settings:
        return self._more("hidden_dirs", *names)

    def with_blocking_severities(self, *severities: str) -> Settings:
        return replace(self, blocking_severities=severities)

    def with_blocking_rules(self, *ids: str) -> Settings:
        return self._more("blocking_rules", *ids)

    def with_disabled_task_kinds(self, *kinds: str) -> Settings:
        return self._more("disabled_task_kinds", *kinds)

    def with_extensions(self, *names: str) -> Settings:
        return self._more("extensions", *names)

    def without_tests(self) -> Settings:
        return replace(self, include_tests=False)

    def overrides(self, spark: SparkSession) -> DataFrame:
        rows = [("rule", r, True, None) for r in self.disabled_rules] + [("pack", p, True, None) for p in self.disabled_packs]
        rows += [("rule", r, False, s) for r, s in self.rule_severities] + [("pack", p, False, s) for p, s in self.pack_severities]
        return spark.createDataFrame(rows, "scope string, name string, disabled boolean, severity string")


FAMILIES = tuple(typescript.COLLECTORS)


def build(files: DataFrame, manifest: str | None = None, config: str | None = None, settings: Settings | None = None, mode: str = "project", documents: DataFrame | None = None, keep: bool = True, discovery: str | None = None, by_tokens: bool = False) -> Catalog:
    """All relations of a project over ``files`` (path, content, mtime_ms). ``documents`` (path, content) are its JSON files (manifests, configurations and schemas) and its
    workspace file, if it has one; ``discovery`` is the text of the nearest discovery configuration, whose lists of directories are added to those of the settings.

    All texts are read in one pass, and the facts are written to the shared folder by family. Without ``keep`` nothing is
    written: each family that a query reads is read off the texts anew, which suits a query or two. With ``by_tokens`` imports, calls and signals
    are plans over the relation of tokens (``sources/tokens.py``), without Python workers and without columns of positions.
    """
    h, spark = settings or Settings(), files.sparkSession
    if discovery is not None:
        lists = src.discovery_config(discovery)
        h = h.with_ignored_dirs(*lists.get("ignoredDirNames", [])).with_hidden_dirs(*lists.get("includeHiddenDirNames", []))
        files = files.where(src.wanted(F.col("path"), h.ignored_dirs, h.hidden_dirs))
    m, c = src.parse_manifest(manifest), src.parse_config(config)
    files = conform(files, "source_files")
    table = stored(typescript.all_facts(files), "family") if keep else None
    facts = {f: typescript.family_of(table, f) if keep else typescript.facts(files, f) for f in (*FAMILIES, "diagnostics", "modules")}
    if by_tokens:
        found = tokens.facts(files) if keep else {f: tokens.FAMILIES[f](tokens.tokens(files)) for f in ("imports", "calls", "signals")}
        facts |= {"imports": conform(found["imports"], "imports"), "calls": conform(found["calls"], "calls"), "signals": conform(tokens.numbered_signals(found["signals"]), "signals")}
    bins = [e["target"].removeprefix("./") for e in m.entries if e["source"] == "bin"]
    role = roles.module_role(F.col("path"), F.col("is_declaration"), list(h.source_dirs), list(h.test_dirs), bins)
    modules = facts["modules"].withColumn("role", role).withColumn("layer", roles.module_layer(F.col("path"), F.col("role")))
    if not h.include_tests:
        modules = modules.where("role != 'test'")
    notes = [{"path": "tsconfig.json", "phase": "config", "code": 0, "message": d, "category": "error", "line": 1, "col": 0} for d in c.diagnostics]
    notes += [{"path": "package.json", "phase": "package-json", "code": 0, "message": d, "category": "error", "line": 1, "col": 0} for d in m.diagnostics]
    entries = joins.manifest_targets(relation(spark, "package_entries", m.entries).drop("resolution", "to_path"), modules, c.options.get("outDir", "dist").removeprefix("./"), (c.options.get("rootDir") or "src").removeprefix("./"))
    extensions = [*m.extensions, *({"name": e, "activation": "config", "installed": any(x["name"] == e for x in m.extensions)} for e in h.extensions if all(x["name"] != e for x in m.extensions))]
    project = [{"mode": mode, "config_path": "tsconfig.json" if config is not None else None, "module_resolution": c.options.get("moduleResolution"), "source_roots": list(h.source_dirs), "test_roots": list(h.test_dirs)}]
    texts = documents.select("path", "content") if documents is not None else spark.createDataFrame([], "path string, content string")
    listed = [p for r in texts.where(F.col("path") == WORKSPACE_FILE).limit(1).collect() for p in src.yaml_packages(r.content)]  # one small file
    patterns = list(dict.fromkeys([*m.workspaces, *listed]))
    catalog = Catalog(spark, facts | {
        "source_files": files, "modules": modules, "edges": lambda: import_edges(facts["imports"], modules, c.aliases), "diagnostics": facts["diagnostics"].unionByName(relation(spark, "diagnostics", notes)), "package_entries": entries,
        "package_scripts": relation(spark, "package_scripts", m.scripts), "package_dependencies": relation(spark, "package_dependencies", m.dependencies), "extensions": relation(spark, "extensions", extensions),
        "build_tools": relation(spark, "build_tools", m.build_tools), "project": relation(spark, "project", project),
        "reference_packages": src.reference_packages(texts, c.references), "workspace_packages": src.workspace_packages(texts, patterns), "file_scopes": lambda: file_scopes(files, texts, manifest is not None), "schema_leaves": src.all_schema_leaves(texts.where(F.col("path").endswith(".schema.json"))),
    })
    catalog.relations["findings"] = lambda: check(catalog, h)
    return catalog


WORKSPACE_FILE = "pnpm-workspace.yaml"  # fixed value


def file_scopes(files: DataFrame, documents: DataFrame, at_root: bool = False) -> DataFrame:
    """(path, scope): the nearest directory above each file that has a manifest, '' for the root; null where none has. ``at_root`` says that the root has one that isn't among the documents."""
    manifest = F.col("path").rlike(r"(^|/)package\.json$")
    places = documents.where(manifest).select(F.when(F.contains("path", F.lit("/")), S.dirname(F.col("path"))).otherwise(F.lit("")).alias("place"))
    if at_root:
        places = places.unionAll(documents.sparkSession.createDataFrame([("",)], "place string"))
    return trees.nearest(files, places).withColumnRenamed("place", "scope")


def nearest_configuration(documents: DataFrame, root: str, name: str) -> str | None:
    """The text of the deepest file of a name in ``root`` or above it, among documents (path, content); the files above one root are few."""
    above = ["/".join(root.split("/")[:n]) for n in range(len(root.split("/")) + 1)]
    wanted = {f"{d}/{name}".lstrip("/"): len(d) for d in above}
    found = documents.where(F.col("path").isin(list(wanted))).collect()
    return max(found, key=lambda r: wanted[r.path]).content if found else None


def import_edges(imports: DataFrame, modules: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Imports with resolution and target: relative ones by their path, aliased ones by the alias' targets in order; the first candidate that is a module. ``seq`` follows the order of paths and, in a file, of its imports."""
    imports = stored(imports.select("path", "seq", "module_specifier", "kind", "is_type_only", "line", "col"))  # read four times below, and made from texts only once
    asked = imports.withColumn("_id", F.concat_ws(":", "path", "seq"))
    spec = F.col("module_specifier")
    places = [joins.relative_target(F.col("path"), spec)]
    for pattern, targets in (aliases or {}).items():
        head, star, tail = pattern.partition("*")
        hit = (spec.startswith(head) & spec.endswith(tail)) if star else spec == pattern
        inner = F.substr(spec, F.lit(len(head) + 1), F.length(spec) - len(head) - len(tail))
        for t in targets:
            a, _, b = t.removeprefix("./").partition("*")
            places.append(F.when(hit, F.concat(F.lit(a), inner, F.lit(b)) if star else F.lit(t.removeprefix("./"))))
    tried = asked.select("_id", F.posexplode(F.array(*places)).alias("place", "at")).where("at IS NOT NULL")
    tried = tried.withColumn("_k", F.concat_ws("#", "_id", "place"))
    found = tried.join(joins.resolve_paths(tried, modules, "_k", "at"), "_k").groupBy("_id").agg(F.min_by("to_path", "place").alias("to_path"))
    # a file's number: its partition in a range order, its place there; written, so that a task run again sees the same ranges
    order = cut(imports.select("path").distinct().repartitionByRange("path").sortWithinPartitions("path").withColumn("_at", F.monotonically_increasing_id()))
    number = F.shiftleft(F.shiftrightunsigned("_at", 33), 43) + F.shiftleft(F.col("_at").bitwiseAND(F.lit((1 << 26) - 1)), 17)
    e = asked.join(found, "_id", "left").join(order, "path")
    resolution = roles.import_resolution(spec, F.col("to_path"), list(aliases or {}))
    return e.select((number + F.col("seq")).cast("bigint").alias("seq"), F.col("path").alias("from_path"), "to_path", "module_specifier", "kind", "is_type_only", resolution.alias("resolution"), "line", "col")


def check(catalog: Catalog, settings: Settings | None = None, rules: list[str] | None = None) -> DataFrame:
    """Findings after the configuration: disabled rules and packs gone, severities overridden."""
    h = settings or Settings()
    found = numbered(evaluate(catalog, rules))
    return filters.apply_policy(found, h.overrides(catalog.spark))


def check_changed(catalog: Catalog, settings: Settings | None = None) -> DataFrame:
    """A full run in which a missing configuration only informs."""
    return check(catalog, (settings or Settings()).with_rule_severity("TS-AGENT-PROJECT-001", "info"))


class NotClean(AssertionError):
    pass


def assert_clean(findings: DataFrame, settings: Settings | None = None) -> None:
    """Raises with the first blocking findings."""
    h = settings or Settings()
    bad = filters.blocking(findings, list(h.blocking_severities), list(h.blocking_rules)).orderBy("seq").limit(20).collect()
    if bad:
        raise NotClean("\n".join(f"{r.rule_id} {r.path}:{r.line} {r.summary}" for r in bad))


def assert_agent_clean(findings: DataFrame) -> None:
    """Raises if anything at all was found."""
    if not findings.isEmpty():
        raise NotClean(f"{findings.count()} findings")


def check_syntax(catalog: Catalog) -> DataFrame:
    """Findings of the smaller model, errors first."""
    from factloom.operators import syntax_rules

    kind = F.when(F.col("kind") == "star", "star-reexport").when(F.col("kind") == "reexport", "named-reexport").otherwise(F.col("kind"))
    kinds = catalog["exports"].groupBy("path").agg(F.collect_list(kind).alias("export_kinds"))
    m = catalog["source_files"].select("path", "content").join(catalog["modules"].select("path", "is_valid"), "path").join(kinds, "path", "left")
    m = m.withColumn("export_kinds", F.coalesce("export_kinds", F.array().cast("array<string>")))
    return syntax_rules.ordered(syntax_rules.module_findings(m).unionAll(syntax_rules.function_findings(catalog["function_shapes"])).unionAll(syntax_rules.react_findings(catalog["react_shapes"])))


def owner_summary(catalog: Catalog) -> DataFrame:
    return catalog["modules"].select("path", S.namespace(F.col("path")).alias("owner"), "role", "layer", F.size("export_names").alias("n_exports"))
