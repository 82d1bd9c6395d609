"""Verification planning: responsibilities become tasks, receipts and waivers resolve them, indexes and obligations read them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators.joins import hint_coverage, hints_with_modules, last_wins, resolve_tasks

# fixed values
KINDS_OF = {
    "public_api": ["stress"], "latency_sensitive": ["performance"], "external_dependency": ["chaos"], "persistence": ["chaos"], "availability_critical": ["chaos"], "security_boundary": ["security"], "pure_domain_logic": [],
}
AUTHORITY = {"parser-fact": 5, "compiler-fact": 4, "test-receipt": 3, "human-note": 2, "llm-prose": 1}
SYNTAX_KINDS = ("unit", "property", "contract", "integration", "render", "effect", "performance")


def task_kinds(responsibilities: Column, override: Column | None = None, policy: dict[str, list[str]] | None = None) -> Column:
    """Kinds that the responsibilities ask for, distinct and sorted; an override replaces them. ``policy`` says for some responsibilities which kinds they ask for here."""
    table = F.create_map(*[x for k, v in (KINDS_OF | (policy or {})).items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]).cast("array<string>"))])
    nothing = F.array().cast("array<string>")
    asked = F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(responsibilities, nothing), lambda r: F.coalesce(F.try_element_at(table, r), nothing)))))
    return F.coalesce(F.array_sort(F.array_distinct(override)), asked) if override is not None else asked


def fingerprint(fields: dict[str, Column]) -> Column:
    """tsv: and 16 hexadecimal digits of the hash of the fields as JSON, keys sorted, nulls left out."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(json.dumps(k) + ":"), quoted(v))) for k, v in sorted(fields.items())]
    return F.concat(F.lit("tsv:"), S.fingerprint16(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), plain, F.lit('"'))


def fingerprint_of(value: object) -> str:
    """The same of a driver-side value."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "tsv:" + hashlib.sha256(text.encode()).hexdigest()[:16]


def task_contracts(tasks: DataFrame, defaults: DataFrame, by_policy: DataFrame, by_hint: DataFrame) -> DataFrame:
    """Tasks with (phase, evidence): the hint's for owner and kind, else the policy's for the kind, else the default's; null where none has one.

    A contract is taken whole: a level that leaves its evidence empty still hides the levels below. Of several of one key the last by ``seq`` counts.
    """
    def level(df: DataFrame, name: str, *keys: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.max_by(F.struct("phase", "evidence"), "seq").alias(name))

    t = tasks.join(level(by_hint, "_hint", "owner_path", "kind"), ["owner_path", "kind"], "left").join(level(by_policy, "_policy", "kind"), "kind", "left").join(level(defaults, "_default", "kind"), "kind", "left")
    return t.withColumn("_c", F.coalesce("_hint", "_policy", "_default")).select(*tasks.columns, "_c.phase", "_c.evidence")


def plan(hints: DataFrame, modules: DataFrame, disabled: list[str] | None = None, skills: DataFrame | None = None, policy: dict[str, list[str]] | None = None) -> DataFrame:
    """Tasks (kind, owner_path, fingerprint, note, seq) of all hints.

    A hint of an unknown owner, without responsibilities, that overrides kinds without a rationale, asks for a disabled kind or
    calls a pure domain something else too becomes a review task with a note; any other becomes a task for each kind. Of tasks
    with one owner, kind and fingerprint the last stays.
    """
    h = hints_with_modules(hints, modules)
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    kinds = task_kinds(F.col("responsibilities"), F.col("task_kinds"), policy)
    off = F.arrays_overlap(kinds, F.array(*[F.lit(d) for d in disabled or [""]]))
    note = (
        F.when(~F.col("known"), "the owner is unknown").when(size(F.col("responsibilities")) == 0, "no responsibilities").when((size(F.col("task_kinds")) > 0) & (F.trim(F.coalesce("rationale", F.lit(""))) == ""), "kinds are overridden without a rationale")
        .when(off, "a kind is disabled").when(F.array_contains("responsibilities", "pure_domain_logic") & (size(F.col("responsibilities")) > 1), "a pure domain has other responsibilities")
    )
    h = h.withColumn("note", note).withColumn("kind", F.explode(F.when(F.col("note").isNotNull(), F.array(F.lit("review"))).otherwise(kinds)))
    tasks = h.select("kind", "owner_path", fingerprint({"kind": F.col("kind"), "owner": F.col("owner_path"), "responsibilities": F.array_join(F.array_sort(F.coalesce("responsibilities", F.array().cast("array<string>"))), ",")}).alias("fingerprint"), "note", "seq")
    if skills is not None:
        tasks = tasks.unionByName(skills.select("kind", "owner_path", "fingerprint", F.lit(None).cast("string").alias("note"), "seq"))
    return last_wins(tasks, ["owner_path", "kind", "fingerprint"])


def resolved(tasks: DataFrame, receipts: DataFrame, waivers: DataFrame) -> DataFrame:
    """Tasks with their state, ordered; notes of the plan stay where the resolution has none."""
    out = resolve_tasks(tasks.withColumnRenamed("note", "plan_note"), receipts, waivers)
    return out.withColumn("note", F.coalesce("note", "plan_note")).drop("plan_note").orderBy("owner_path", "kind", "fingerprint")


def active(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("state").isin("pending", "failed"))


def task_index(tasks: DataFrame, skills: DataFrame) -> DataFrame:
    """Active tasks of kinds with a skill."""
    return active(tasks).join(skills.select("kind", "skill"), "kind").orderBy("owner_path", "kind")


def performance_index(tasks: DataFrame) -> DataFrame:
    return active(tasks).where("kind = 'performance'").orderBy("owner_path")


def report_obligations(tasks: DataFrame) -> DataFrame:
    """Three rows at most: what a report owes to failed, pending and review tasks."""
    n = active(tasks).agg(F.count_if(F.col("state") == "failed").alias("failed"), F.count_if((F.col("state") == "pending") & (F.col("kind") != "review")).alias("pending"), F.count_if(F.col("kind") == "review").alias("review"))
    rows = n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("obligation"), F.col(k).alias("n")) for k in ("failed", "pending", "review")])).alias("x"))
    return rows.select("x.obligation", "x.n").where("n > 0")


def missing_keys(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def profile_index(modules: DataFrame, dependencies: DataFrame, signals: DataFrame, hints: DataFrame) -> DataFrame:
    """Candidate owners with the responsibilities that their imports suggest (an external one, or three owners depended on, suggest external_dependency; not made distinct) and whether hints cover them."""
    d = dependencies.withColumn("package", S.package_root(F.col("module_specifier")))
    by_package = d.join(signals, "package").groupBy(F.col("from_path").alias("owner_path")).agg(F.collect_set("responsibility").alias("a"))
    by_degree = d.groupBy(F.col("from_path").alias("owner_path")).agg(((F.count_if(F.col("resolution") == "external") > 0) | (F.countDistinct("to_path") >= 3)).alias("far"))
    public = modules.where(F.col("role").isin("facade", "entrypoint")).select(F.col("path").alias("owner_path"), F.lit(True).alias("public"))
    none = F.array().cast("array<string>")
    all_ = by_degree.join(by_package, "owner_path", "left").join(public, "owner_path", "full")
    suggested = F.array_sort(F.concat(F.coalesce("a", none), F.when(F.col("far"), F.array(F.lit("external_dependency"))).otherwise(none), F.when(F.col("public"), F.array(F.lit("public_api"))).otherwise(none)))
    return hint_coverage(all_.select("owner_path", suggested.alias("suggested")).where("size(suggested) > 0"), hints)


def authority_rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in AUTHORITY.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(0))


def syntax_plan(modules: DataFrame) -> DataFrame:
    """The smaller model's tasks: of (path, has_exports, has_types, has_react, has_effect, n_dependencies, has_loops), a row for each kind with its phase and hash."""
    kinds = F.array_compact(F.array(
        F.when(F.col("has_exports"), "unit"), F.when(F.col("has_types"), "property"), F.when(F.col("has_exports") & F.col("has_types"), "contract"), F.when(F.col("n_dependencies") >= 3, "integration"),
        F.when(F.col("has_react"), "render"), F.when(F.col("has_effect"), "effect"), F.when(F.col("has_loops"), "performance"),
    ))
    t = modules.select("path", F.explode(kinds).alias("kind"))
    phase = F.when(F.col("kind").isin("unit", "property", "contract"), "local").when(F.col("kind") == "performance", "measure").otherwise("system")
    return t.select("path", "kind", phase.alias("phase"), S.fingerprint16(F.concat_ws(":", "path", "kind")).alias("fingerprint"))


def syntax_resolved(tasks: DataFrame, receipts: DataFrame, waivers: DataFrame) -> DataFrame:
    """Receipts match by fingerprint; a waiver, by kind alone, waives if it is complete and changes nothing if not."""
    r = receipts.groupBy("fingerprint").agg(F.min_by("status", "seq").alias("status"))
    whole = (F.trim("owner") != "") & (F.trim("reason") != "") & (F.trim("expires_at") != "")
    w = waivers.groupBy("kind").agg(F.bool_or(F.coalesce(whole, F.lit(False))).alias("waived"))
    state = F.when(F.col("status") == "passed", "satisfied").when(F.col("status") == "failed", "failed").when(F.col("waived"), "waived").otherwise("pending")
    return tasks.join(r, "fingerprint", "left").join(w, "kind", "left").withColumn("state", state).drop("status", "waived")
