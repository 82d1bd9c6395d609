"""Queries of verification indexes and of the smaller model's plan, and of functions that none of the others reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import verify
from factloom.plans import analogues as R
from factloom.plans.registry import query

_TASKS = """t AS (SELECT 'o' || o_custkey AS owner_path, ['stress', 'performance', 'chaos', 'review'][o_orderkey % 4 + 1] AS kind, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'satisfied' END AS state, o_orderkey AS fingerprint FROM orders)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("stress", "performance", "chaos", "review")]), (k % 4 + 1).cast("int"))
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "pending").otherwise("satisfied")
    return R.table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("owner_path"), kind.alias("kind"), state.alias("state"), k.alias("fingerprint"))


@query(f"WITH {_TASKS}, s AS (SELECT ['stress', 'performance', 'chaos'][r_regionkey + 1] AS kind, r_name AS skill FROM region WHERE r_regionkey < 3) SELECT owner_path, kind, fingerprint, skill FROM t JOIN s USING (kind) WHERE state IN ('pending', 'failed')")
def v_task_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("stress"), F.lit("performance"), F.lit("chaos")), (F.col("r_regionkey") + 1).cast("int"))
    skills = R.table(spark, sf_dir, "region").where("r_regionkey < 3").select(kinds.alias("kind"), F.col("r_name").alias("skill"))
    return verify.task_index(_tasks(spark, sf_dir), skills).select("owner_path", "kind", "fingerprint", "skill")


@query(f"WITH {_TASKS} SELECT owner_path, state, fingerprint FROM t WHERE state IN ('pending', 'failed') AND kind = 'performance'")
def v_performance_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.performance_index(_tasks(spark, sf_dir)).select("owner_path", "state", "fingerprint")


@query(f"""WITH {_TASKS}, a AS (SELECT * FROM t WHERE state IN ('pending', 'failed')) SELECT * FROM (SELECT 'failed' AS obligation, count(*) FILTER (WHERE state = 'failed') AS n FROM a UNION ALL SELECT 'pending', count(*) FILTER (WHERE state = 'pending' AND kind <> 'review') FROM a
 UNION ALL SELECT 'review', count(*) FILTER (WHERE kind = 'review') FROM a) WHERE n > 0""")
def v_report_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.report_obligations(_tasks(spark, sf_dir))


_SYNTAX = """m AS (SELECT 'src/p' || p_partkey || '.ts' AS path, p_partkey % 2 = 0 AS e, p_partkey % 3 = 0 AS t, p_partkey % 5 = 0 AS r, p_partkey % 7 = 0 AS f, p_size % 6 AS d, p_partkey % 11 = 0 AS l FROM part),
 k AS (SELECT path, unnest(list_filter([CASE WHEN e THEN 'unit' END, CASE WHEN t THEN 'property' END, CASE WHEN e AND t THEN 'contract' END, CASE WHEN d >= 3 THEN 'integration' END, CASE WHEN r THEN 'render' END, CASE WHEN f THEN 'effect' END, CASE WHEN l THEN 'performance' END], lambda x: x IS NOT NULL)) AS kind FROM m),
 plan AS (SELECT path, kind, CASE WHEN kind IN ('unit', 'property', 'contract') THEN 'local' WHEN kind = 'performance' THEN 'measure' ELSE 'system' END AS phase, substr(sha256(path || ':' || kind), 1, 16) AS fingerprint FROM k)"""


def _syntax_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    on = lambda n, name: (k % n == 0).alias(name)
    m = R.table(spark, sf_dir, "part").select(F.concat(F.lit("src/p"), k.cast("string"), F.lit(".ts")).alias("path"), on(2, "has_exports"), on(3, "has_types"), on(5, "has_react"), on(7, "has_effect"), (F.col("p_size") % 6).alias("n_dependencies"), on(11, "has_loops"))
    return verify.syntax_plan(m)


@query(f"WITH {_SYNTAX} SELECT path, kind, phase, fingerprint FROM plan")
def b_verification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _syntax_plan(spark, sf_dir)


@query(f"""WITH {_SYNTAX}, rec AS (SELECT substr(sha256('src/p' || s_suppkey || '.ts:unit'), 1, 16) AS fingerprint, CASE WHEN s_nationkey % 2 = 0 THEN 'passed' ELSE 'failed' END AS status FROM supplier),
 w AS (SELECT ['render', 'effect'][r_regionkey % 2 + 1] AS kind, bool_or(r_regionkey >= 2) AS waived FROM region WHERE r_regionkey IN (0, 1, 2) GROUP BY 1)
 SELECT path, kind, CASE WHEN status = 'passed' THEN 'satisfied' WHEN status = 'failed' THEN 'failed' WHEN waived THEN 'waived' ELSE 'pending' END AS state FROM plan LEFT JOIN rec USING (fingerprint) LEFT JOIN w USING (kind)""")
def b_resolved_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts by fingerprint, waivers by kind; one of the waivers has no reason."""
    plan = _syntax_plan(spark, sf_dir)
    receipts = R.table(spark, sf_dir, "supplier").select(S.fingerprint16(F.concat(F.lit("src/p"), F.col("s_suppkey").cast("string"), F.lit(".ts:unit"))).alias("fingerprint"), F.when(F.col("s_nationkey") % 2 == 0, "passed").otherwise("failed").alias("status"), F.col("s_suppkey").alias("seq"))
    r = F.col("r_regionkey")
    waivers = R.table(spark, sf_dir, "region").where("r_regionkey IN (0, 1, 2)").select(F.when(r % 2 == 0, "render").otherwise("effect").alias("kind"), F.lit("team").alias("owner"), F.when(r >= 2, "known").otherwise("").alias("reason"), F.lit("2030-01-01").alias("expires_at"))
    return verify.syntax_resolved(plan, receipts, waivers).select("path", "kind", "state")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'type' WHEN 1 THEN 'tuple' WHEN 2 THEN 'interface' WHEN 3 THEN 'function' WHEN 4 THEN 'union' END AS k, CASE l_suppkey % 8 WHEN 0 THEN 'param:x' WHEN 1 THEN 'return' WHEN 2 THEN 'error' WHEN 3 THEN 'field:y' WHEN 4 THEN 'alias' WHEN 5 THEN 'variant:z' WHEN 6 THEN 'other' END AS s,
   CASE l_partkey % 8 WHEN 0 THEN '[Row, Row]' WHEN 1 THEN 'Row | string' WHEN 2 THEN 'Row | Cell' WHEN 3 THEN 'Array<Row>' WHEN 4 THEN 'Row[]' WHEN 5 THEN '{ a: Row }' WHEN 6 THEN 'Row' END AS x FROM lineitem)
 SELECT CASE WHEN x IS NULL THEN 'unknown' WHEN k = 'tuple' OR x LIKE '[%' THEN 'tuple' WHEN k = 'type' THEN 'alias' WHEN x LIKE '%string%' THEN 'primitive' WHEN contains(x, '|') THEN 'union' WHEN x IN ('Array<Row>', 'Row[]') THEN 'array' WHEN x LIKE '{%' THEN 'object' ELSE 'external' END AS carrier,
  CASE WHEN k = 'type' THEN 'alias' WHEN k IN ('tuple', 'union', 'interface') THEN k WHEN s = 'field:y' THEN 'object' WHEN k IS NULL THEN 'unknown' ELSE 'function' END AS kind,
  CASE WHEN s = 'param:x' THEN 'api-input' WHEN s = 'return' THEN 'api-output' WHEN s = 'error' THEN 'api-error' WHEN s = 'field:y' THEN 'api-field' WHEN s = 'alias' OR k = 'type' THEN 'public-type-alias' WHEN s = 'variant:z' THEN 'api-field' ELSE 'external-dependency' END AS role, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def f_type_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda c, n, values: F.get(F.array(*[F.lit(v) for v in values]), (F.col(c) % n).cast("int"))
    kind, surface = pick("l_linenumber", 7, ["type", "tuple", "interface", "function", "union", None, None]), pick("l_suppkey", 8, ["param:x", "return", "error", "field:y", "alias", "variant:z", "other", None])
    text = pick("l_partkey", 8, ["[Row, Row]", "Row | string", "Row | Cell", "Array<Row>", "Row[]", "{ a: Row }", "Row", None])
    shapes = R.table(spark, sf_dir, "lineitem").select(S.type_carrier(text, kind).alias("carrier"), S.type_surface_kind(kind, surface).alias("kind"), S.type_surface_role(kind, surface).alias("role"))
    return shapes.groupBy("carrier", "kind", "role").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, strftime(make_timestamp(o_orderkey * 1234567891000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, strftime(make_timestamp(o_orderkey * 1234567891000), '%Y-%m-%dT%H-%M-%SZ') AS file_stamp, CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 5 <> 0 THEN o_orderstatus END AS const,
 'a=' || CASE WHEN o_orderkey % 2 = 0 THEN 'over' ELSE 'base' END || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '' END || ',c=1' AS fields FROM orders""")
def f_stamps_maps_and_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTC stamps, a string at a place in JSON, and a map laid over another, its nulls gone."""
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    inner = F.when(k % 3 == 1, F.lit("7")).otherwise(F.concat(F.lit('"'), status, F.lit('"')))
    text = F.when(k % 5 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"a b": {"c": '), inner, F.lit("}}")))
    base = F.create_map(F.lit("a"), F.lit("base"), F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("1"))
    over = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit("over"))).otherwise(F.create_map().cast("map<string,string>"))
    held = S.compact(S.merged(base, over))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries(held), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    ms = k * 1234567891
    return R.table(spark, sf_dir, "orders").select("o_orderkey", S.utc_stamp(ms).alias("stamp"), S.utc_stamp(ms, for_file=True).alias("file_stamp"), S.const_at(text, ["a b", "c"]).alias("const"), fields.alias("fields"))


@query(f"""WITH {_TASKS}, u AS (SELECT DISTINCT owner_path, kind FROM t),
 h AS (SELECT 'o' || c_custkey AS owner_path, ['stress', 'performance', 'chaos', 'review'][c_nationkey % 4 + 1] AS kind, 'hint' AS phase, 'h' || c_custkey AS evidence FROM customer),
 p AS (SELECT ['stress', 'chaos'][r_regionkey % 2 + 1] AS kind, 'policy' AS phase, arg_max('p' || r_name, r_regionkey) AS evidence FROM region GROUP BY 1),
 d AS (SELECT ['stress', 'performance', 'chaos'][n_nationkey % 3 + 1] AS kind, 'default' AS phase, arg_max('d' || n_name, n_nationkey) AS evidence FROM nation GROUP BY 1)
 SELECT u.owner_path, u.kind, coalesce(h.phase, p.phase, d.phase) AS phase, coalesce(h.evidence, p.evidence, d.evidence) AS evidence FROM u LEFT JOIN h USING (owner_path, kind) LEFT JOIN p ON p.kind = u.kind LEFT JOIN d ON d.kind = u.kind""")
def v_task_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def contracts(table: str, key: str, kinds: tuple[str, ...], phase: str, text, *more):
        kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col(key) % len(kinds) + 1).cast("int"))
        return R.table(spark, sf_dir, table).select(kind.alias("kind"), F.lit(phase).alias("phase"), text.alias("evidence"), *more)

    hint = contracts("customer", "c_nationkey", ("stress", "performance", "chaos", "review"), "hint", F.concat(F.lit("h"), F.col("c_custkey").cast("string")), F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("owner_path"), F.col("c_custkey").alias("seq"))
    policy = contracts("region", "r_regionkey", ("stress", "chaos"), "policy", F.concat(F.lit("p"), F.col("r_name")), F.col("r_regionkey").alias("seq"))
    default = contracts("nation", "n_nationkey", ("stress", "performance", "chaos"), "default", F.concat(F.lit("d"), F.col("n_name")), F.col("n_nationkey").alias("seq"))
    return verify.task_contracts(_tasks(spark, sf_dir).select("owner_path", "kind").distinct(), default, policy, hint)
