"""Joins between facts. All are equi joins, so that they shuffle by key and split when skewed; ranges and prefixes are made equal by exploding the bounded side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S

DEPENDENCY_KEY = ("from_path", "to_path", "module_specifier", "kind", "is_type_only")

# fixed values: what stands for a source extension in an import, and the endings tried in order
IMPORT_EXTENSIONS = (".d.mts", ".d.cts", ".d.ts", ".mjs", ".cjs", ".jsx", ".js")
CANDIDATE_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".d.ts", "/index.ts", "/index.tsx", "/index.mts", "/index.cts")


def last_wins(df: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    """Of rows with one key the last in ``seq``; nulls in a key are equal."""
    w = Window.partitionBy(*key).orderBy(F.desc(seq))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, key: list[str], seq: str = "seq") -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.asc(seq))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def owner_dependencies(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges between known modules with both roles: external edges and those from unknown modules go, edges without a target stay; the last of equal edges wins."""
    of = lambda side: modules.select(F.col("path").alias(f"{side}_path"), F.col("role").alias(f"{side}_role"))
    known = edges.where(F.col("resolution") != "external").join(of("from"), "from_path").join(of("to"), "to_path", "left")
    test = (F.col("from_role") == "test") | F.coalesce(F.col("to_role") == "test", F.lit(False))
    return last_wins(known.withColumn("is_test_context", test), list(DEPENDENCY_KEY))


def candidate_paths(path: Column) -> Column:
    """Where an import of ``path`` may lie, in order: itself, without an import extension, and with each ending."""
    bare = F.regexp_replace(path, "(" + "|".join(e.replace(".", r"\.") for e in IMPORT_EXTENSIONS) + ")$", "")
    return F.concat(F.array(path, bare), F.array(*[F.concat(bare, F.lit(e)) for e in CANDIDATE_ENDINGS]))


def resolve_paths(requests: DataFrame, modules: DataFrame, key: str = "id", path: str = "path") -> DataFrame:
    """(key, to_path): the first candidate that is a module; requests without one don't appear."""
    tried = requests.select(key, F.posexplode(candidate_paths(F.col(path))).alias("pos", "to_path"))
    return tried.join(modules.select(F.col("path").alias("to_path")).distinct(), "to_path").groupBy(key).agg(F.min_by("to_path", "pos").alias("to_path"))


def manifest_targets(entries: DataFrame, modules: DataFrame, out_dir: str | None, root_dir: str | None) -> DataFrame:
    """Entries with resolution and to_path: a target that isn't relative is external; else the module there, or where it would be built from."""
    clean = F.regexp_replace("target", r"^\./", "")
    built = clean
    if out_dir is not None:
        built = F.when(clean.startswith(out_dir.rstrip("/") + "/"), F.concat(F.lit((root_dir or "").rstrip("/") + "/" if root_dir else ""), F.substring(clean, len(out_dir.rstrip("/")) + 2, 1 << 30))).otherwise(clean)
    asked = entries.withColumn("_id", F.monotonically_increasing_id()).withColumn("_a", clean).withColumn("_b", built)
    first = resolve_paths(asked, modules, "_id", "_a").withColumnRenamed("to_path", "_x")
    second = resolve_paths(asked, modules, "_id", "_b").withColumnRenamed("to_path", "_y")
    found = asked.join(first, "_id", "left").join(second, "_id", "left").withColumn("to_path", F.coalesce("_x", "_y"))
    resolution = F.when(~F.col("target").startswith("."), "external").when(F.col("to_path").isNotNull(), "parser-visible").otherwise("unresolved")
    return found.withColumn("resolution", resolution).withColumn("to_path", F.when(F.col("resolution") != "external", F.col("to_path"))).select(*[c for c in entries.columns if c not in ("resolution", "to_path")], "resolution", "to_path")


def package_imports(imports: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports of named packages: by name, or below it; the first by name. A specifier's prefixes are exploded, so that the match is an equi join."""
    parts = F.split("module_specifier", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = imports.withColumn("_id", F.monotonically_increasing_id())
    tried = asked.select("_id", "module_specifier", F.explode(prefixes).alias("name")).join(packages.select("name").distinct(), "name")
    best = tried.groupBy("_id").agg(F.min("name").alias("package"))
    via = F.when(F.col("module_specifier") == F.col("package"), "package-name").otherwise("package-subpath")
    return asked.join(best, "_id").withColumn("via", via).drop("_id")


def reference_packages(references: DataFrame, packages: DataFrame) -> DataFrame:
    """Each reference with its package's name, found by path or by configuration path, the first by path; external without one."""
    named = packages.select("name", "path", "config_path")
    keys = named.select("name", "path", F.explode(F.array("path", "config_path")).alias("at")).where(F.col("at").isNotNull())
    best = keys.groupBy("at").agg(F.min_by("name", "path").alias("package"))
    asked = references.withColumnRenamed("path", "at")
    out = asked.join(best, "at", "left").withColumnRenamed("at", "path")
    return out.withColumn("resolution", F.when(F.col("package").isNull(), "external").otherwise("workspace"))


def owners_of_hits(hits: DataFrame, branches: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct owner paths of hits with a role: the branch's, else the module's, else unknown; in order of the first hit."""
    first = hits.groupBy("owner_path").agg(F.min("seq").alias("seq"))
    b = branches.select(F.col("path").alias("owner_path"), F.col("role").alias("_b"))
    m = modules.select(F.col("path").alias("owner_path"), F.col("role").alias("_m"))
    return first.join(b, "owner_path", "left").join(m, "owner_path", "left").select("seq", "owner_path", F.coalesce("_b", "_m", F.lit("unknown")).alias("role"))


def owners_of_paths(paths: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches of the given paths, in the given order; unknown paths go."""
    return paths.join(branches, "path")


def callsites(query: str, exports: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Modules that import the files defining a name; 4 for an import, 3 for a re-export; a file's own import doesn't count."""
    needle = query.strip().lower()
    files = exports.where(F.lower("name") == needle).select(F.col("path").alias("to_path")).distinct()
    used = dependencies.where(F.col("to_path").isNotNull() & (F.col("from_path") != F.col("to_path"))).join(files, "to_path", "left_semi")
    return used.withColumn("score", F.when(F.col("kind") == "export", 3).otherwise(4))


def params_with_flow(params: DataFrame, flows: DataFrame) -> DataFrame:
    """Parameters beside their function's first control-flow row, by name alone."""
    first = first_wins(flows, ["path", "function_name"]).select("path", "function_name", "branches", "loops", "max_nesting")
    return params.join(first, ["path", "function_name"], "left")


def manifest_usage(dependencies: DataFrame, imports: DataFrame) -> DataFrame:
    """Each package of the manifest or of an import: sources and versions declared, number of imports."""
    declared = dependencies.groupBy(F.col("name").alias("package")).agg(F.array_sort(F.collect_set("source")).alias("sources"), F.array_sort(F.collect_set("version_range")).alias("versions"))
    used = imports.withColumn("package", S.package_root(F.col("module_specifier"))).where(F.col("package").isNotNull()).groupBy("package").agg(F.count("*").alias("n_imports"))
    nothing = F.array().cast("array<string>")
    return declared.join(used, "package", "full").select("package", F.coalesce("sources", nothing).alias("sources"), F.coalesce("versions", nothing).alias("versions"), F.coalesce("n_imports", F.lit(0)).alias("n_imports"))


def overlapping(rows: DataFrame, selectors: DataFrame, width: int = 64) -> DataFrame:
    """Rows (path, start, end, item_start, item_end) of which the capture or the item overlaps a selector (path, sel_start, sel_end).

    An interval join by bands of lines: both sides are exploded into bands of ``width`` lines, joined by path and band, and
    checked; each pair once. Selectors may be reversed.
    """
    low, high = F.least("sel_start", "sel_end"), F.greatest("sel_start", "sel_end")
    bands = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    sel = selectors.select("path", low.alias("sel_start"), high.alias("sel_end")).distinct().withColumn("_band", bands(F.col("sel_start"), F.col("sel_end")))
    r = rows.withColumn("_id", F.monotonically_increasing_id())
    r = r.withColumn("_band", bands(F.least("start", "item_start"), F.greatest("end", "item_end")))
    hit = lambda a, b: (F.col(a) <= F.col("sel_end")) & (F.col(b) >= F.col("sel_start"))
    first_band = F.col("_band") == F.floor(F.greatest(F.least("start", "item_start"), "sel_start") / width)
    return r.join(sel, ["path", "_band"]).where((hit("start", "end") | hit("item_start", "item_end")) & first_band).select(*rows.columns, "sel_start", "sel_end")


def lines_in_intervals(lines: DataFrame, intervals: DataFrame) -> DataFrame:
    """Lines (path, line) beside the interval that holds them, if any; of several the last. Intervals are exploded to lines."""
    points = intervals.select("path", "seq", "fixture_path", F.explode(F.sequence("line", F.greatest("line", "line_end"))).alias("line"))
    return lines.join(last_wins(points, ["path", "line"]).drop("seq"), ["path", "line"], "left")


def hints_with_modules(hints: DataFrame, modules: DataFrame) -> DataFrame:
    m = modules.select(F.col("path").alias("owner_path"), F.col("role"), F.lit(True).alias("known"))
    return hints.join(m, "owner_path", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def reusable(current: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, to_parse): cached rows of unchanged, valid files, and the current files without one."""
    valid = cached.where("is_valid")
    reused = valid.join(current.select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    return reused, current.join(valid.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def relative_target(from_path: Column, specifier: Column) -> Column:
    """The path that a relative specifier names, dots resolved; null for any other."""
    joined = F.concat_ws("/", F.nullif(S.dirname(from_path), F.lit("")), specifier)
    up = F.aggregate(
        F.filter(F.split(joined, "/"), lambda p: ~p.isin("", ".")), F.array().cast("array<string>"),
        lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.when(specifier.startswith("."), F.array_join(up, "/"))


def syntax_owner_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """The smaller model's edges between owners: relative imports of files that exist, own edges aside, weights summed."""
    asked = imports.where(F.col("module_specifier").startswith(".")).withColumn("_id", F.monotonically_increasing_id()).withColumn("_at", relative_target(F.col("path"), F.col("module_specifier")))
    found = asked.join(resolve_paths(asked, modules, "_id", "_at"), "_id")
    owner = lambda c: S.namespace(F.col(c))
    edges = found.select(owner("path").alias("from_owner"), owner("to_path").alias("to_owner"), F.lit(1).alias("weight"))
    return edges.where("from_owner != to_owner").groupBy("from_owner", "to_owner").agg(F.sum("weight").alias("weight"))


def resolve_tasks(tasks: DataFrame, receipts: DataFrame, waivers: DataFrame) -> DataFrame:
    """Each task's state: of its first receipt (passed: satisfied, failed: failed), else waived by a waiver whose owner, reason and end aren't blank, else pending; a waiver that lacks one leaves a note."""
    key = ["kind", "fingerprint", "owner_path"]
    r = first_wins(receipts, key).select(*key, "status")
    full = (F.trim(F.coalesce("owner", F.lit(""))) != "") & (F.trim(F.coalesce("reason", F.lit(""))) != "") & (F.trim(F.coalesce("expires_at", F.lit(""))) != "")
    w = first_wins(waivers, key).select(*key, full.alias("waived"))
    state = F.when(F.col("status") == "passed", "satisfied").when(F.col("status") == "failed", "failed").when(F.col("waived"), "waived").otherwise("pending")
    note = F.when((F.col("state") == "pending") & (F.col("waived") == F.lit(False)), "waiver is incomplete")
    return tasks.drop("state", "note").join(r, key, "left").join(w, key, "left").withColumn("state", state).withColumn("note", note).drop("status", "waived")


def dependency_signals(dependencies: DataFrame, signals: DataFrame) -> DataFrame:
    """Responsibilities that an owner's dependencies suggest, distinct and sorted."""
    hit = dependencies.withColumn("package", S.package_root(F.col("module_specifier"))).join(signals, "package")
    return hit.groupBy(F.col("from_path").alias("owner_path")).agg(F.array_sort(F.collect_set("responsibility")).alias("responsibilities"))


def hint_coverage(candidates: DataFrame, hints: DataFrame) -> DataFrame:
    """missing without a hint, configured if it covers what is suggested, else drift."""
    h = hints.groupBy("owner_path").agg(F.array_distinct(F.flatten(F.collect_list("responsibilities"))).alias("has"))
    state = F.when(F.col("has").isNull(), "missing").when(F.size(F.array_except("suggested", "has")) == 0, "configured").otherwise("drift")
    return candidates.join(h, "owner_path", "left").withColumn("state", state).drop("has")


def rule_owners(rules: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rules beside the owner and tests that a fixed catalog (a row for each pack) names."""
    return rules.join(catalog, "pack", "left")
