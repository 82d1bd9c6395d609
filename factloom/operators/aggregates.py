"""Aggregations over facts. Counts and minima combine on the map side; ordered lists carry their sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators.joins import last_wins

RESOLUTIONS = ("relative", "path-alias", "package-import", "external", "unresolved")


def import_summary(edges: DataFrame) -> DataFrame:
    """Of each module its imports in all and by resolution."""
    counts = [F.count_if(F.col("resolution") == r).alias(f"n_{r.replace('-', '_')}") for r in RESOLUTIONS]
    return edges.groupBy("from_path").agg(F.count("*").alias("n_imports"), *counts)


def first_and_count(df: DataFrame, key: list[str], value: str, seq: str = "seq") -> DataFrame:
    """Of each group the value of its first row, and its size."""
    return df.groupBy(*key).agg(F.min_by(value, seq).alias(value), F.count("*").alias("n"))


def ordered_lists(df: DataFrame, key: list[str], value: str, seq: str = "seq") -> DataFrame:
    """Of each group its values in order of ``seq``."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    return df.groupBy(*key).agg(F.transform(pairs, lambda x: x["v"]).alias(f"{value}s"))


def distinct_targets(edges: DataFrame, least: int = 2) -> DataFrame:
    return edges.where(F.col("to_path").isNotNull()).groupBy("from_path").agg(F.countDistinct("to_path").alias("n_targets")).where(F.col("n_targets") >= least)


def repeated_specifiers(edges: DataFrame, least: int = 5, per_branch: int = 3, overall: int = 20) -> DataFrame:
    """Specifiers that a branch uses so often: of each branch those first seen, and the first branches by path."""
    n = edges.groupBy("from_path", "module_specifier").agg(F.count("*").alias("n"), F.min("seq").alias("first")).where(F.col("n") >= least)
    w = Window.partitionBy("from_path").orderBy("first", "module_specifier")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_branch).orderBy("from_path", "rank").limit(overall).drop("first")


def term_coverage(hits: DataFrame) -> DataFrame:
    """Of each owner the number of distinct terms, case aside, that hit it."""
    return hits.groupBy("owner_path").agg(F.countDistinct(F.lower("term")).alias("coverage"))


def query_coverage(terms: DataFrame, hits: DataFrame, selected: DataFrame) -> DataFrame:
    """Of each term: hits, selected hits, the first eight owners, and hit, partial (hits, none selected) or miss."""
    n = hits.groupBy("term").agg(F.count("*").alias("n_hits"), F.transform(F.slice(F.array_sort(F.collect_set("owner_path")), 1, 8), lambda x: x).alias("owners"))
    s = selected.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_selected"))
    out = terms.join(n, "term", "left").join(s, "term", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    status = F.when(F.coalesce("n_selected", F.lit(0)) > 0, "hit").when(F.coalesce("n_hits", F.lit(0)) > 0, "partial").otherwise("miss")
    return out.select("term", zero("n_hits"), zero("n_selected"), F.coalesce("owners", F.array().cast("array<string>")).alias("owners"), status.alias("status"))


def out_degree(edges: DataFrame, most: int = 10) -> DataFrame:
    return edges.groupBy("from_path").agg(F.least(F.count("*"), F.lit(most)).alias("degree"))


def frontier(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Of each owner outside the selected set the number of edges to or from it."""
    s = selected.select("path").distinct()
    inside = lambda c, n: s.select(F.col("path").alias(c), F.lit(True).alias(n))
    e = edges.where(F.col("to_path").isNotNull()).join(inside("from_path", "_f"), "from_path", "left").join(inside("to_path", "_t"), "to_path", "left")
    crossing = e.where(F.col("_f").isNull() != F.col("_t").isNull())
    return crossing.select(F.when(F.col("_f").isNull(), F.col("from_path")).otherwise(F.col("to_path")).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


def best_per_key(df: DataFrame, key: list[str], score: str = "score", seq: str = "seq") -> DataFrame:
    """Of each key the row of the highest score, the first of equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(score), seq)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def least_class(lines: DataFrame, term: str) -> DataFrame:
    """Of each file the lowest class of its lines that hold the term."""
    held = lines.where(S.contains_ci(F.col("text"), term))
    return held.groupBy("path").agg(F.min(S.line_class(F.col("text"), term)).alias("line_class"))


def weighted_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_owner", "to_owner").agg(F.sum("weight").alias("weight"))


def owner_groups(modules: DataFrame) -> DataFrame:
    """Modules by namespace: members, and the primary one: an index file before others, then the most exports, then the first path."""
    m = modules.withColumn("owner", S.namespace(F.col("path")))
    best = F.struct((S.stem(S.basename(F.col("path"))) != "index").alias("a"), (-F.size("export_names")).alias("b"), F.col("path").alias("path"))
    return m.groupBy("owner").agg(F.count("*").alias("n"), F.min(best).alias("best")).select("owner", "n", F.col("best.path").alias("primary_path"))


def shadowed_owners(modules: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Namespaces of two source files or more of which none re-exports another."""
    m = modules.where(F.col("role").isin("source", "facade", "entrypoint")).select("path", S.namespace(F.col("path")).alias("owner"))
    side = lambda c, o: m.select(F.col("path").alias(c), F.col("owner").alias(o))
    inner = dependencies.where("kind = 'export'").join(side("from_path", "a"), "from_path").join(side("to_path", "b"), "to_path").where("a = b").select(F.col("a").alias("owner")).distinct()
    groups = m.groupBy("owner").agg(F.array_sort(F.collect_list("path")).alias("paths")).where(F.size("paths") > 1)
    return groups.join(inner, "owner", "left_anti")


def evidence_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.col("kind") == "owner").alias("n_owners"), F.count_if(F.col("kind") == "claim").alias("n_claims"), F.count_if(F.col("status") == "stale").alias("n_stale"), F.count_if(F.col("kind") == "gap").alias("n_gaps"))
    return n.crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def surface_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.count_if(F.col("match") == "direct").alias("n_confirmed"), F.count_if(F.col("match") == "possible").alias("n_possible"))


def group_fingerprint(atoms: DataFrame, key: list[str]) -> DataFrame:
    """Token estimates summed, and the hash of the sorted hashes joined by colons."""
    return atoms.groupBy(*key).agg(F.sum(S.token_estimate(F.col("text"))).alias("tokens"), S.fingerprint16(F.array_join(F.array_sort(F.collect_list("fingerprint")), ":")).alias("fingerprint"))


def snapshot_counts(modules: DataFrame, edges: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: modules, roots (nothing imports them), branches and dependencies of the smaller model, findings."""
    inner = edges.where("to_path IS NOT NULL AND from_path != to_path")
    roots = modules.join(inner.select(F.col("to_path").alias("path")).distinct(), "path", "left_anti").agg(F.count("*").alias("n_roots"))
    return modules.agg(F.count("*").alias("n_modules")).crossJoin(roots).crossJoin(inner.agg(F.count("*").alias("n_dependencies"), F.countDistinct("from_path").alias("n_branches"))).crossJoin(findings.agg(F.count("*").alias("n_findings")))


def test_function_counts(calls: DataFrame, items: DataFrame, most: int = 64) -> DataFrame:
    """Of each test file: functions named test* and calls of test and it; the first files by path."""
    a = items.where((F.col("kind") == "function") & F.col("name").startswith("test")).select("path")
    b = calls.where(F.col("callee").isin("test", "it")).select("path")
    return a.unionAll(b).where(S.is_test_path_for_prefilter(F.col("path"))).groupBy("path").agg(F.count("*").alias("n_tests")).orderBy("path").limit(most)


def topology(dependencies: DataFrame) -> DataFrame:
    """Fan-in and fan-out of each owner, test edges aside."""
    e = dependencies.where("to_path IS NOT NULL AND NOT is_test_context")
    ends = e.select(F.explode(F.array(F.struct(F.col("from_path").alias("path"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_path").alias("path"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.path").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def grouped_edges(edges: DataFrame) -> tuple[str, DataFrame]:
    """Edges (from_path, to_path, label) by source or by target, whichever makes fewer groups; by target only if they are fewer than both the edges and the groups by source."""
    out = edges.groupBy(F.col("from_path").alias("owner"), "label").agg(F.array_sort(F.collect_set("to_path")).alias("peers"))
    in_ = edges.groupBy(F.col("to_path").alias("owner"), "label").agg(F.array_sort(F.collect_set("from_path")).alias("peers"))
    n_edges, n_out, n_in = edges.count(), out.count(), in_.count()
    return ("fan-in", in_) if n_in < n_edges and n_in < n_out else ("fan-out", out)


def finding_groups(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "rule_id", "title").agg(F.count("*").alias("n"), F.min_by("path", "seq").alias("first_path"))


def dependency_lines(edges: DataFrame, packages: DataFrame, entries: DataFrame) -> DataFrame:
    """Edges, package owners and entries as distinct lines, sorted."""
    line = lambda df, a, b: df.where(F.col(b).isNotNull()).select(F.concat(F.col(a), F.lit(" -> "), F.col(b)).alias("line"))
    return line(edges, "from_path", "to_path").union(line(packages, "from_path", "package")).union(line(entries, "subpath", "to_path")).distinct().orderBy("line")


def latest(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    return last_wins(df, key, seq)


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)
