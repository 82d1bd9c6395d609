"""Graph operators over edge relations. Iterations join the frontier only and cut their lineage in the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.checkpoints import Turns, cut
from factloom.operators.components import on_cycles, reached


def reachable(edges: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth): nodes reached from the roots (column node), roots at depth 0, at least depth, to depth ``most``.

    Breadth first: each turn joins the last frontier with the edges, and stops when nothing is new, so that cycles end.
    Edges are (src, dst). A frontier with many out-edges in one node is split by the skew join.
    """
    e = cut(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    seen = cut(roots.select("node").where("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)))
    front, depth = seen.select("node"), 0
    while most is None or depth < most:
        depth += 1
        new = e.join(front.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = cut(new.withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            break
        seen, front = seen.unionAll(new), new.select("node")
        if depth % 8 == 0:  # a union of written parts; made one before the plan grows long
            seen = cut(seen)
    return seen


def reachable_sql(edges: DataFrame, roots: DataFrame, most: int) -> DataFrame:
    """The same to a bounded depth as one recursive query; its rows are walks, so it suits graphs of few paths."""
    spark = edges.sparkSession
    edges.select("src", "dst").distinct().createOrReplaceTempView("_reach_edges")
    roots.select("node").distinct().createOrReplaceTempView("_reach_roots")
    return spark.sql(
        f"""WITH RECURSIVE walk(node, depth) AS (
              SELECT node, 0 FROM _reach_roots
              UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN _reach_edges e ON e.src = w.node WHERE w.depth < {int(most)})
            SELECT node, MIN(depth) AS depth FROM walk GROUP BY node"""
    )


def orphans(modules: DataFrame, dependencies: DataFrame, visible: DataFrame) -> DataFrame:
    """Source modules that no entrypoint, facade or module visible in the manifest reaches over edges outside tests; none if there are no roots."""
    source = modules.where(F.col("role").isin("source", "facade", "entrypoint")).select("path", "role")
    listed = visible.where("resolution = 'parser-visible'").select(F.col("to_path").alias("path"), F.lit(True).alias("visible")).distinct()
    roots = cut(source.join(listed, "path", "left").where(F.col("role").isin("entrypoint", "facade") | F.coalesce("visible", F.lit(False))).select(F.col("path").alias("node")))
    nodes = source.select("path")
    edges = dependencies.where("NOT is_test_context AND to_path IS NOT NULL").select(F.col("from_path").alias("src"), F.col("to_path").alias("dst"))
    edges = edges.join(nodes.withColumnRenamed("path", "src"), "src", "left_semi").join(nodes.withColumnRenamed("path", "dst"), "dst", "left_semi")
    lost = source.where("role = 'source'").join(reached(edges, roots).select(F.col("node").alias("path")), "path", "left_anti").select("path")
    return lost if not roots.isEmpty() else lost.limit(0)


def depth_to_target(dependencies: DataFrame, target: str, most: int = 8) -> DataFrame:
    """(node, depth): owners from which ``target`` is reached within ``most`` steps, the target itself at depth 1; edges from tests don't count. One search from the target over reversed edges serves all tests."""
    edges = dependencies.where("to_path IS NOT NULL AND from_role != 'test'").select(F.col("to_path").alias("src"), F.col("from_path").alias("dst"))
    spark = dependencies.sparkSession
    found = reachable(edges, spark.createDataFrame([(target,)], "node string"), most - 1)
    return found.select("node", (F.col("depth") + 1).alias("depth"))


def depths_to_targets(dependencies: DataFrame, targets: list[str], most: int = 8) -> DataFrame:
    """(target, node, depth) of several targets at once: one join a turn for all of them; the frontier alone is joined."""
    edges = cut(dependencies.where("to_path IS NOT NULL AND from_role != 'test'").select(F.col("to_path").alias("node"), F.col("from_path").alias("_next")).distinct())
    found = frontier = cut(dependencies.sparkSession.createDataFrame([(t, t, 1) for t in targets], "target string, node string, depth int"))
    for _ in range(most - 1):
        near = frontier.join(edges, "node").select("target", F.col("_next").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        frontier = cut(near.join(found, ["target", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
    return found


def tests_for_owners(dependencies: DataFrame, targets: list[str]) -> DataFrame:
    """(target, seq, test_path, source_path, reason, score, depth): what ``tests_for_owner`` finds for each of a few targets, none capped, each target's own path as its query. The edges are read once for all."""
    none = "target string, seq bigint, test_path string, source_path string, reason string, score int, depth int"
    if not targets:
        return dependencies.sparkSession.createDataFrame([], none)
    dependencies = cut(dependencies.where("to_path IS NOT NULL").select("seq", "from_path", "to_path", "module_specifier", "from_role", "is_test_context"))
    d = dependencies.where("is_test_context").withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
    d = d.join(depths_to_targets(dependencies, targets).withColumnRenamed("node", "to_path"), ["target", "to_path"], "left")
    t = F.col("target")
    direct = (F.col("to_path") == t) | F.endswith("to_path", F.concat(F.lit("/"), t))
    by_path, by_name, far = F.contains("from_path", t), F.contains("module_specifier", t), (F.col("from_role") == "test") & F.col("depth").isNotNull()
    reason = F.when(direct, "direct-import").when(by_path, "test-path").when(by_name, "specifier").when(far, "transitive-import")
    score = F.when(direct, 8).when(by_path, 4).when(by_name, 3).when(far, 6)
    source = F.when(direct | ~by_path & by_name, F.col("to_path")).otherwise(t)
    hits = d.withColumn("reason", reason).where("reason IS NOT NULL").select("target", "seq", F.col("from_path").alias("test_path"), source.alias("source_path"), "reason", score.alias("score"), F.when(F.col("reason") == "transitive-import", F.col("depth")).alias("depth"))
    return hits.groupBy("target", "test_path", "source_path").agg(F.min_by(F.struct("seq", "reason", "score", "depth"), F.struct(-F.col("score"), "seq")).alias("x")).select("target", "x.seq", "test_path", "source_path", "x.reason", "x.score", "x.depth")


def tests_for_owner(dependencies: DataFrame, target: str, query: str, most: int = 30) -> DataFrame:
    """Test edges of an owner, the best of each (source, test): a direct import 8, by the test's path 4, by the specifier 3, over other owners 6; the first reason that holds counts for an edge."""
    # written once, narrow: the search and its result both read it
    dependencies = cut(dependencies.where("to_path IS NOT NULL").select("seq", "from_path", "to_path", "module_specifier", "from_role", "is_test_context"))
    reach = depth_to_target(dependencies, target)
    d = dependencies.where("is_test_context").join(reach.withColumnRenamed("node", "to_path"), "to_path", "left")
    direct = (F.col("to_path") == target) | F.col("to_path").endswith("/" + target)
    by_path, by_name = F.contains("from_path", F.lit(target)), F.contains("module_specifier", F.lit(query))
    far = (F.col("from_role") == "test") & F.col("depth").isNotNull()
    reason = F.when(direct, "direct-import").when(by_path, "test-path").when(by_name, "specifier").when(far, "transitive-import")
    score = F.when(direct, 8).when(by_path, 4).when(by_name, 3).when(far, 6)
    source = F.when(direct, F.col("to_path")).when(by_path, F.lit(target)).when(by_name, F.col("to_path")).otherwise(F.lit(target))
    hits = d.withColumn("reason", reason).where("reason IS NOT NULL").select("seq", F.col("from_path").alias("test_path"), source.alias("source_path"), "reason", score.alias("score"), F.when(F.col("reason") == "transitive-import", F.col("depth")).alias("depth"))
    from factloom.operators.aggregates import best_per_key

    return best_per_key(hits, ["source_path", "test_path"]).orderBy(F.desc("score"), "test_path").limit(most)


def neighbourhood(dependencies: DataFrame, owner: str) -> DataFrame:
    """Edges to and from an owner with their direction."""
    out = dependencies.where((F.col("from_path") == owner) & F.col("to_path").isNotNull()).select(F.lit("out").alias("direction"), F.col("to_path").alias("peer"), "module_specifier", "kind")
    into = dependencies.where(F.col("to_path") == owner).select(F.lit("in").alias("direction"), F.col("from_path").alias("peer"), "module_specifier", "kind")
    return out.unionAll(into)


def owner_rank(branches: DataFrame, findings: DataFrame, edges: DataFrame) -> DataFrame:
    """100 for a root or facade, 80 for an entrypoint, 40 for exports, 30 for findings, and the out-degree, 10 at most."""
    found = findings.select("path").distinct().withColumn("found", F.lit(True))
    degree = edges.groupBy(F.col("from_path").alias("path")).agg(F.count("*").alias("degree"))
    role = F.col("role")
    rank = (
        F.when(role.isin("root", "facade", "entrypoint"), 100).otherwise(0) + F.when(role == "entrypoint", 80).otherwise(0) + F.when(F.size("export_names") > 0, 40).otherwise(0)
        + F.when(F.col("found"), 30).otherwise(0) + F.least(F.coalesce("degree", F.lit(0)), F.lit(10))
    ).cast("int")
    return branches.join(found, "path", "left").join(degree, "path", "left").select("path", "role", rank.alias("rank"))


def roots(owners: DataFrame, edges: DataFrame) -> DataFrame:
    """Owners without an inbound edge."""
    return owners.join(edges.select(F.col("to_owner").alias("owner")).distinct(), "owner", "left_anti")


def fact_graph(fields: DataFrame, packages: DataFrame, query: str, most: int = 64) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the first field facts: field has_type type, type collection_of collection, query matches field, field belongs_to its container, package dependency nodes."""
    f = fields.orderBy("path", "line", "field_name").limit(most)
    node = lambda kind, c: f.select(F.lit(kind).alias("kind"), F.concat(F.lit(kind + ":"), c).alias("id"), c.alias("label"))
    field, type_, owner = F.concat_ws(".", "container_name", "field_name"), F.col("type_value"), F.col("container_name")
    nodes = node("field", field).union(node("type", type_)).union(node("owner", owner)).union(node("collection", F.col("collection_kind")).where("label IS NOT NULL"))
    nodes = nodes.union(packages.select(F.lit("dependency"), F.concat(F.lit("dependency:"), "name"), "name")).union(f.sparkSession.createDataFrame([("query", f"query:{query}", query)], "kind string, id string, label string")).distinct()
    edge = lambda relation, a, ca, b, cb: f.where(cb.isNotNull()).select(F.concat(F.lit(a + ":"), ca).alias("source"), F.concat(F.lit(b + ":"), cb).alias("target"), F.lit(relation).alias("relation"))
    edges = edge("has_type", "field", field, "type", type_).union(edge("collection_of", "type", type_, "collection", F.col("collection_kind"))).union(edge("belongs_to", "field", field, "owner", owner)).union(edge("matches", "query", F.lit(query), "field", field)).distinct()
    return nodes, edges


def evidence_graph(owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (owner, kind, id, status) and edges (owner, source, target, relation) of the graph around each owner (owner, has_tests, has_receipt): the owner, a claim about it, a test and a receipt that support the claim; a gap where evidence lacks."""
    fresh = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "fresh").otherwise("stale")
    lacks = ~(F.coalesce("has_tests", F.lit(False)) & F.coalesce("has_receipt", F.lit(False)))
    node = lambda kind, status: F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), "owner").alias("id"), status.alias("status"))
    held = F.array(node("owner", F.lit("fresh")), node("claim", F.lit("fresh")), node("test", fresh("has_tests")), node("receipt", fresh("has_receipt")), F.when(lacks, node("gap", F.lit("open"))))
    nodes = owners.select("owner", F.explode(F.array_compact(held)).alias("n")).select("owner", "n.*")
    edge = lambda a, b, relation: F.struct(F.concat(F.lit(f"{a}:"), "owner").alias("source"), F.concat(F.lit(f"{b}:"), "owner").alias("target"), F.lit(relation).alias("relation"))
    edges = owners.select("owner", F.explode(F.array(edge("claim", "owner", "about"), edge("test", "claim", "supports"), edge("receipt", "claim", "supports"))).alias("e")).select("owner", "e.*")
    return nodes, edges


def personalised_rank(edges: DataFrame, seeds: DataFrame, weights: dict[str, float] | None = None, damping: float = 0.85, tolerance: float = 1e-7) -> DataFrame:
    """(node, p): where walks are that return to the seeds (column node) with 1 - ``damping`` at each step; they sum to one.

    Edges are (src, dst) and, if weighted, relation; an edge counts as much as ``weights`` has for its relation (else 1), parallel edges together. From a node
    without a way out a walk goes back to the seeds. Residuals are pushed: a node whose residual is above a threshold keeps its share and hands the
    rest on, until none is above; then at most ``tolerance`` is left in all, and stays where it is. A turn holds ``PUSHES`` pushes, each an
    equi join and a sum, and writes the state, one row a node.
    """
    weight = F.lit(1.0)
    for relation, w in (weights or {}).items():
        weight = F.when(F.col("relation") == relation, F.lit(float(w))).otherwise(weight)
    e = edges.where("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.sum(weight).alias("w")).where("w > 0")
    whole = e.groupBy("src").agg(F.sum("w").alias("all"))
    start = cut(seeds.select(F.col("node").cast("string")).where("node IS NOT NULL").distinct())
    kind = seeds.schema["node"].dataType.simpleString()
    named = e.join(whole, "src").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), (F.col("w") / F.col("all") * damping).alias("share"))
    nodes = cut(named.select(F.col("src").alias("node")).union(named.select("dst")).union(start).distinct())
    n_seeds = max(start.count(), 1)
    # walks from nodes without a way out meet in one place, which hands everything on to the seeds
    lost = nodes.join(named.select(F.col("src").alias("node")), "node", "left_anti").select(F.col("node").alias("src"), F.lit(_BACK).alias("dst"), F.lit(damping).alias("share"))
    back = start.select(F.lit(_BACK).alias("src"), F.col("node").alias("dst"), F.lit(1.0 / n_seeds).alias("share"))
    ways = cut(named.unionByName(lost).unionByName(back))
    threshold = tolerance / max(nodes.count(), 1)
    turns = Turns(edges.sparkSession)
    state = turns.put(start.select("node", F.lit(0.0).alias("p"), F.lit(1.0 / n_seeds).alias("r")))
    high = F.col("r") > threshold
    while not state.where(high).isEmpty():
        pushed = state
        for _ in range(PUSHES):
            handed = ways.join(pushed.where(high).select(F.col("node").alias("src"), "r"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("share")).alias("r"))
            keeps = F.when(F.col("node") == _BACK, 0.0).otherwise(F.col("r") * (1 - damping))
            own = pushed.select("node", (F.col("p") + F.when(high, keeps).otherwise(0.0)).alias("p"), F.when(high, 0.0).otherwise(F.col("r")).alias("r"))
            pushed = own.unionByName(handed.select("node", F.lit(0.0).alias("p"), "r")).groupBy("node").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
        state = turns.put(pushed)
    left = state.where(F.col("node") == _BACK).agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("back")).first().back
    here = state.where(F.col("node") != _BACK).join(start.select("node", F.lit(left / n_seeds).alias("more")), "node", "left")
    return here.select(F.col("node").cast(kind).alias("node"), (F.col("p") + F.col("r") + F.coalesce("more", F.lit(0.0))).alias("p"))


PUSHES = 3
_BACK = "\x00back"


def diverse(ranked: DataFrame, budget: int = 8, fade: float = 0.5) -> DataFrame:
    """(node, kind, p, place): ``budget`` nodes chosen one after another, each the best when every node of a kind counts ``fade`` times as much for each one of its kind that was chosen before.

    In a kind the choice goes by p, so that the k-th best of a kind counts p x fade^(k - 1) when its turn comes, and the choice is the first of all by that. Each task keeps ``budget`` rows of a kind.
    """
    w = Window.partitionBy("kind").orderBy(F.desc("p"), "node")
    of_kind = ranked.withColumn("k", F.row_number().over(w)).where(F.col("k") <= budget)
    chosen = of_kind.withColumn("worth", F.col("p") * F.pow(F.lit(fade), F.col("k") - 1)).orderBy(F.desc("worth"), "node").limit(budget)
    return chosen.select("node", "kind", "p", F.row_number().over(Window.orderBy(F.desc("worth"), "node")).alias("place"))


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, in whatever number of steps."""
    return on_cycles(edges)


def flow_lite(functions: DataFrame, calls: DataFrame, function: str, source: str, sink: str) -> DataFrame:
    """The first function of a name, its first call ending in ``source`` and its first call or construction whose name holds ``sink``; bounded if both are there. Neither order nor data flow is checked."""
    f = functions.where(F.col("name") == function).orderBy("path", "line").limit(1).select("path", F.col("name").alias("owner"), F.col("line").alias("function_line"))
    c = calls.join(f, ["path", "owner"])
    terminal = F.substring_index("callee", ".", -1)
    first = lambda hit: F.min(F.when(hit, F.col("line")))
    return c.groupBy("path", "owner", "function_line").agg(first(terminal == source).alias("source_line"), first(F.contains("callee", F.lit(sink))).alias("sink_line")).withColumn("bounded", F.col("source_line").isNotNull() & F.col("sink_line").isNotNull())
