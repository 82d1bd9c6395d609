"""Search views: each is a builder from a project's relations to named results. ``search`` dispatches over a closed set."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import cut
from factloom.functions import scalar as S
from factloom.operators import aggregates as A
from factloom.operators import filters as P
from factloom.operators import graph as G
from factloom.operators import joins as J
from factloom.operators import ranking as W
from factloom.operators.rules import Catalog, rule_table

Packet = dict[str, DataFrame]
VIEWS: dict[str, Callable[..., Packet]] = {}
PROFILES = {"owner-tests": "owner and its tests", "owner-query": "owner and a query", "query-deps": "a query and dependencies", "flow": "data flow", "policy": "policy of an owner"}


def view(name: str):
    def add(f: Callable[..., Packet]) -> Callable[..., Packet]:
        VIEWS[name] = f
        return f

    return add


def search(c: Catalog, name: str, query: str = "", **options: object) -> Packet:
    """The view's results by name."""
    if name not in VIEWS:
        raise ValueError(f"unknown view {name!r}; known: {', '.join(sorted(VIEWS))}")
    return VIEWS[name](c, query, **options)


def branches(c: Catalog) -> DataFrame:
    """Owners outside tests that root, configure, re-export or export something."""
    out = c["edges"].where("kind = 'export' AND resolution != 'external'").select(F.col("from_path").alias("path")).distinct().withColumn("re", F.lit(True))
    m = c["modules"].where("role != 'test'").join(out, "path", "left")
    return m.where("role IN ('entrypoint', 'facade', 'config') OR re OR role = 'source' AND size(export_names) > 0").drop("re")


@view("workspace")
def _workspace(c: Catalog, query: str) -> Packet:
    used = c["imports"].select(S.package_root(F.col("module_specifier")).alias("name"))
    return {"packages": W.workspace_packages(c["workspace_packages"], used), "edges": J.package_imports(c["imports"], c["workspace_packages"]).select("path", "package", "via").distinct().orderBy("path", "package", "via").limit(W.CAPS["workspace_edges"]), "findings": A.finding_groups(c["findings"]).orderBy(F.desc("n"), "rule_id").limit(W.CAPS["findings"])}


@view("prime")
def _prime(c: Catalog, query: str) -> Packet:
    top = G.owner_rank(branches(c), c["findings"], c["edges"]).orderBy(F.desc("rank"), "path").limit(W.CAPS["prime_owners"])
    d = c.dependencies.where("to_path IS NOT NULL")
    touching = d.join(top.select(F.col("path").alias("from_path")), "from_path", "left_semi").unionByName(d.join(top.select(F.col("path").alias("to_path")), "to_path", "left_semi").select(*d.columns))
    return {"owners": top, "edges": J.first_wins(touching, list(J.DEPENDENCY_KEY)).orderBy("from_path", "to_path", "seq").limit(W.CAPS["prime_edges"]), "frontier": A.frontier(c["edges"], top), "axes": prime_axes(c)}


def packet_hashes(packet: Packet, files: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(path, sha256) of the files that a packet's rows point at (path, from_path, to_path, test_path), and of ``more`` paths, as far as they are there."""
    named = [df.select(F.col(c).alias("path")) for df in packet.values() for c in ("path", "from_path", "to_path", "test_path") if c in df.columns]
    if more:
        named.append(files.sparkSession.createDataFrame([(p,) for p in more], "path string"))
    if not named:
        return files.select("path", F.lit("").alias("sha256")).limit(0)
    asked = reduce(DataFrame.union, named).where("path IS NOT NULL").distinct()
    return files.join(asked, "path", "left_semi").select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"))


def prime_axes(c: Catalog) -> DataFrame:
    """(id, kind, path, fields): the configuration, the test surface, and each extension and build tool of a project; fields without a value go."""
    fields = lambda **kw: S.compact(F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), v.cast("string"))]))
    missing = F.col("config_path").isNull()
    config = c["project"].select(F.lit("TSCONFIG:project").alias("id"), F.lit("tsconfig").alias("kind"), F.coalesce("config_path", F.lit("tsconfig.json")).alias("path"), fields(source=F.when(missing, "missing").otherwise("typescript-config-parser"), moduleResolution=F.col("module_resolution")).alias("fields"))
    test = (F.col("role") == "test") | S.is_test_path(F.col("path"))
    counts = c["modules"].agg(F.count_if(test).alias("tests"), F.count_if(F.col("path").rlike(r"\.(stories|story)\.[cm]?[jt]sx?$")).alias("stories"), F.count_if(test & F.col("path").rlike("(^|/)e2e(/|$)")).alias("e2e"))
    surface = counts.select(F.lit("SURFACE:test").alias("id"), F.lit("test_surface").alias("kind"), F.lit(".").alias("path"), fields(tests=F.col("tests"), stories=F.col("stories"), e2e=F.col("e2e"), next=F.lit("tests:.")).alias("fields"))
    extensions = c["extensions"].select(F.concat(F.lit("X:"), "name").alias("id"), F.lit("extension").alias("kind"), F.col("name").alias("path"), fields(activation=F.col("activation"), installed=F.col("installed"), next=F.concat(F.lit("extension:"), "name")).alias("fields"))
    tools = c["build_tools"].select(F.concat(F.lit("B:"), "name").alias("id"), F.lit("build_tool").alias("kind"), F.col("name").alias("path"), fields(has_script=F.col("has_script"), next=F.concat(F.lit("build-tool:"), "name")).alias("fields"))
    return config.unionByName(surface).unionByName(extensions).unionByName(tools)


def find_owner(c: Catalog, query: str) -> DataFrame:
    """One branch: by path, else by namespace, else by export name."""
    q = query.strip().removeprefix("./")
    tier = F.when(F.col("path") == q, 1).when(S.namespace(F.col("path")) == q, 2).when(F.array_contains("export_names", q), 3)
    return branches(c).withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", "path").limit(1).drop("tier")


@view("owner")
def _owner(c: Catalog, query: str) -> Packet:
    owner = find_owner(c, query)
    path = (owner.select("path").first() or [query])[0]
    near = G.neighbourhood(c.dependencies, path)
    return {"owners": owner, "edges": near, "frontier": near.select("direction", "peer").distinct().orderBy("direction", "peer").limit(8), "findings": c["findings"].where(F.col("path") == path), "items": W.item_order(c["items"].where(F.col("path") == path))}


@view("dependency")
def _dependency(c: Catalog, query: str) -> Packet:
    d = c["package_dependencies"].withColumn("module_specifier", F.col("name"))
    return {"hits": W.dependency_scores(d, query, F.lit(True)).orderBy(F.desc("score"), "name", "source").limit(W.CAPS["lexical"])}


@view("deps")
def _deps(c: Catalog, query: str, lockfile: str | None = None) -> Packet:
    """dep[/sub][@version][::api]: manifest rows with their version's scope; uses of the api only if the version is the project's own."""
    from factloom.sources.files import locked_version

    q = S.parse_dependency_query(query)
    if q is None:
        return {"hits": c["package_dependencies"].limit(0)}
    own = c["package_dependencies"].where(F.col("name") == q["name"])
    status = S.version_status(F.lit(q["version"]).cast("string"), F.lit(locked_version(lockfile, q["name"])).cast("string"), F.col("version_range"))
    hits = own.withColumn("status", status).withColumn("scope", S.version_scope(F.col("status")))
    out = {"hits": hits}
    if q["api"]:
        current = hits.where("scope = 'current'").select("name").distinct()
        uses = c["imports"].withColumn("name", S.package_root(F.col("module_specifier"))).join(current, "name", "left_semi")
        calls = c["calls"].where(F.substring_index("callee", ".", -1) == q["api"]).select("path", "callee", F.col("line").alias("call_line"))
        out["usage"] = uses.select("path").distinct().join(calls, "path")
    return out


@view("docs")
def _docs(c: Catalog, query: str) -> Packet:
    """Schema documents (relation schema_leaves): $id 12, path 10, key 9, title 8, value 6; a key that matches hides its value."""
    q = query.strip()
    s = c["schema_leaves"]
    hit = lambda col: S.contains_ci(F.col(col), q)
    score = F.when((F.col("key") == "$id") & hit("value"), 12).when(hit("path"), 10).when(hit("key"), 9).when((F.col("key") == "title") & hit("value"), 8).when(hit("value"), 6)
    best = s.withColumn("score", score).where("score IS NOT NULL").groupBy("path").agg(F.max(F.struct("score", "pointer")).alias("x"))
    return {"hits": best.select("path", "x.score", "x.pointer").orderBy(F.desc("score"), "path").limit(W.CAPS["schema"])}


@view("api")
def _api(c: Catalog, query: str) -> Packet:
    """Six families of public surfaces: exact and contained names with the scores of each."""
    if "::" in query:
        return {"hits": c["params"].limit(0).select("path", F.lit("").alias("kind"), F.lit("").alias("symbol"), F.lit(0).alias("score"), F.lit(0).alias("line"))}
    q = query.strip().lower()

    def family(name: str, kind: str, column: str, exact: int, part: int) -> DataFrame:
        low = F.lower(F.col(column))
        score = F.when(low == q, exact).when(F.contains(low, F.lit(q)), part)
        return c[name].select("path", F.lit(kind).alias("kind"), F.col(column).alias("symbol"), score.alias("score"), "line").where("score IS NOT NULL")

    parts = [
        family("params", "function", "function_name", 12, 7), family("data_fields", "data", "type_name", 10, 5), family("type_aliases", "alias", "alias_name", 9, 4),
        family("variant_fields", "variant", "union_name", 8, 4), family("async_surfaces", "async", "name", 9, 4), family("service_methods", "service", "method_name", 8, 4),
    ]
    rows = reduce(DataFrame.unionByName, parts).groupBy("path", "kind", "symbol", "score").agg(F.min("line").alias("line"))
    return {"hits": rows.orderBy(F.desc("score"), "path", "line", "symbol").limit(W.CAPS["symbol"])}


@view("public-external-types")
def _external_types(c: Catalog, query: str) -> Packet:
    """Public surfaces that name the package's types (9), or name types of their own in modules that import it (4)."""
    spec = query.strip()
    uses = c["imports"].where(S.package_root(F.col("module_specifier")) == spec).select("path").distinct().withColumn("imports", F.lit(True))
    surface = lambda name, kind, symbol: c[name].select("path", F.lit(kind).alias("kind"), F.col(symbol).alias("symbol"), "type_text", "line")
    rows = surface("params", "param", "function_name").unionByName(surface("data_fields", "field", "type_name")).unionByName(surface("type_aliases", "alias", "alias_name")).unionByName(surface("tuple_surfaces", "tuple", "function_name"))
    direct = S.mentions_import_type(F.col("type_text"), spec)
    match = F.when(direct, "direct").when(F.col("imports") & S.has_custom_type(F.col("type_text")), "possible")
    hits = rows.where("type_text IS NOT NULL").join(uses, "path", "left").withColumn("match", match).where("match IS NOT NULL").withColumn("score", F.when(F.col("match") == "direct", 9).otherwise(4))
    return {"hits": hits.orderBy(F.desc("score"), "path", "line").limit(W.CAPS["symbol"]), "nodes": A.surface_counts(hits)}


@view("policy")
def _policy(c: Catalog, query: str) -> Packet:
    packs = ("agent-policy", "modularity", "project", "test-layout")
    return {"hits": P.policy_handles(rule_table(c.spark).where(F.col("pack").isin(*packs)), query)}


@view("symbol")
def _symbol(c: Catalog, query: str) -> Packet:
    q = query.strip().lower()
    score = F.when(F.lower("name") == q, 10).when(F.contains(F.lower("name"), F.lit(q)), 5)
    return {"hits": c["exports"].withColumn("score", score if q else F.lit(None)).where("score IS NOT NULL").orderBy(F.desc("score"), "path", "line").limit(W.CAPS["symbol"])}


@view("callsite")
def _callsite(c: Catalog, query: str) -> Packet:
    return {"hits": J.callsites(query, c["exports"], c.dependencies).orderBy(F.desc("score"), "from_path", "seq").limit(W.CAPS["import"])}


@view("import")
def _import(c: Catalog, query: str) -> Packet:
    q = query.strip().lower()
    fields = [F.lower("module_specifier"), F.lower("from_path"), F.lower(F.coalesce("to_path", F.lit("")))]
    score = F.when(reduce(lambda a, b: a | b, [f == q for f in fields]), 6).when(reduce(lambda a, b: a | b, [F.contains(f, F.lit(q)) for f in fields]), 3)
    hits = c.dependencies.withColumn("score", score if q else F.lit(None)).where("score IS NOT NULL").orderBy(F.desc("score"), "from_path", "seq").limit(W.CAPS["import"])
    return {"hits": hits, "edges": hits.where("to_path IS NOT NULL").select("from_path", "to_path").distinct()}


@view("tests")
def _tests(c: Catalog, query: str) -> Packet:
    path = (find_owner(c, query).select("path").first() or [query.strip()])[0]
    return {"edges": G.tests_for_owner(c.dependencies, path, query, W.CAPS["import"])}


@view("lexical")
def _lexical(c: Catalog, query: str, query_set: list[str] | None = None, owner: str | None = None, pipes: tuple[str, ...] = ()) -> Packet:
    """Fuzzy hits in paths, exports and lines; several terms are merged by coverage. The pipe ``tests`` adds the tests of the hits' owners, of which there are no more than hits."""
    files = c["source_files"].select("path", F.col("content").alias("text"), "mtime_ms")
    b = branches(c)
    terms = query_set or [query]
    nothing = F.lit(None).cast("string")

    def named(df: DataFrame, kind: str, symbol: Column, value: str) -> DataFrame:
        """Hits of all terms in one value of a row."""
        found = F.filter(F.array(*[F.struct(F.lit(t).alias("term"), S.fuzzy_match_of(F.lower(value), t)["score"].alias("score")) for t in terms]), lambda x: x["score"].isNotNull())
        rows = df.withColumns({"symbol": symbol, "found": found}).where(F.size("found") > 0).select("path", "symbol", "mtime_ms", F.explode("found").alias("x"), F.transform("found", lambda x: x["term"]).alias("terms"))
        return rows.select("x.term", F.lit(kind).alias("kind"), "path", "symbol", nothing.alias("line_range"), "x.score", F.lit(f"{kind}-fuzzy").alias("reason"), nothing.alias("snippet"), "mtime_ms", "terms")

    exports = b.select("path", F.explode("export_names").alias("value")).join(files.select("path", "mtime_ms"), "path", "left")
    lines = W.line_hits(files, terms, keep=("mtime_ms",)).select("term", F.lit("text").alias("kind"), "path", nothing.alias("symbol"), F.concat_ws(":", "line", "line").alias("line_range"), "score", F.lit("source-text-fuzzy").alias("reason"), "snippet", "mtime_ms", "terms")
    rows = named(files, "path", nothing, "path").unionByName(named(exports, "export", F.col("value"), "value")).unionByName(lines).withColumn("owner_path", F.col("path"))
    if owner:
        rows = rows.where(F.col("path") == owner)
    if not query_set:
        hits = W.top_hits(rows.drop("terms"))
        if "tests" not in pipes:
            return {"hits": hits}
        hits = cut(hits)
        owners = hits.select(F.col("owner_path").alias("path")).distinct().join(c["modules"].where("role = 'test'").select("path"), "path", "left_anti").where(~S.is_test_path(F.col("path")))
        return {"hits": hits, "tests": G.tests_for_owners(c.dependencies, sorted(r.path for r in owners.collect()))}
    first = W.first_hits(rows, [*W.hit_order(), F.asc("kind"), F.asc("symbol")]).withColumnRenamed("depth", "seq")
    return {"hits": W.query_set(first, b, terms), "coverage": A.query_coverage(c.spark.createDataFrame([(t,) for t in terms], "term string"), rows, W.interleave(first)), "owners": W.synthesis_owners(rows)}


@view("reasoning")
def _reasoning(c: Catalog, query: str, profile: str = "owner-tests", owner: str | None = None) -> Packet:
    """Three of the five profiles that are described run."""
    if profile == "owner-tests":
        return _owner(c, query) | {"tests": _tests(c, query)["edges"]}
    if profile == "owner-query":
        return _owner(c, owner or query) | {"hits": _lexical(c, query, owner=owner)["hits"]}
    if profile == "query-deps":
        return _lexical(c, query) | {"dependencies": _deps(c, query)["hits"]}
    raise ValueError(f"profile {profile!r} has no implementation")


def _knowledge(c: Catalog, query: str, axis: str) -> Packet:
    """Static and manifest facts of one axis that any term matches; all without a term."""
    facts = {
        "env": c["package_scripts"].select(F.lit("script").alias("kind"), "name", F.col("command").alias("value")),
        "lang": c["project"].select(F.lit("language").alias("kind"), F.lit("typescript").alias("name"), F.col("module_resolution").alias("value")),
        "std": c["package_dependencies"].where("name LIKE '@types/%'").select(F.lit("types").alias("kind"), "name", F.col("version_range").alias("value")),
        "capability": c.spark.createDataFrame([("view", v, "search") for v in sorted(VIEWS)], "kind string, name string, value string"),
        "extension": c["extensions"].select(F.lit("extension").alias("kind"), "name", F.col("activation").alias("value")),
        "pattern": rule_table(c.spark).select(F.lit("rule").alias("kind"), F.col("rule_id").alias("name"), F.col("title").alias("value")),
        "compare": c["package_dependencies"].select(F.lit("version").alias("kind"), "name", F.col("version_range").alias("value")),
        "runtime-source": c["package_scripts"].limit(0).select(F.lit("").alias("kind"), "name", F.col("command").alias("value")),
    }[axis]
    terms = query.lower().split()
    text = F.lower(F.concat_ws(" ", "kind", "name", "value"))
    return {"facts": facts.where(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))) if terms else facts}


for _axis in ("env", "lang", "std", "capability", "extension", "pattern", "compare", "runtime-source"):
    VIEWS[_axis] = lambda c, query="", axis=_axis: _knowledge(c, query, axis)


def _stream_hits(c: Catalog, stream: str) -> DataFrame:
    """The records of a candidate stream that name source files, in whatever of the known forms it has."""
    from factloom.sources import candidates as I

    fmt = I.detect(stream)
    rows = c.spark.createDataFrame(list(enumerate([stream] if fmt == "path-list-nul" else stream.replace("\r\n", "\n").split("\n"))), "seq long, line string")
    if fmt == "unknown":  # a list of paths if any line is one
        fmt = I.detect(stream, {r.path for r in c["source_files"].select("path").join(rows.select(F.col("line").alias("path")), "path", "left_semi").limit(1).collect()})
    return I.ingest_hits(I.parse(rows, fmt), c["source_files"], fmt)


@view("ingest")
def _ingest(c: Catalog, query: str, stream: str = "") -> Packet:
    return {"hits": _stream_hits(c, stream)}


@view("semantic-facts")
def _facts(c: Catalog, query: str, stream: str = "") -> Packet:
    """Facts of fields as a graph; with a candidate stream, of the files that it names."""
    fields = c["data_fields"]
    if stream:
        fields = fields.join(_stream_hits(c, stream).select("path").distinct(), "path", "left_semi")
    f = fields.select("path", "line", F.col("type_name").alias("container_name"), "field_name", F.col("type_text").alias("type_value"), S.collection_kind(F.col("type_text")).alias("collection_kind"))
    nodes, edges = G.fact_graph(P.graph_fact_filter(f, query), c["package_dependencies"], query)
    return {"nodes": nodes, "edges": edges}
