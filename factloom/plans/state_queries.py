"""Queries of trees, caches, streams, plans and edits over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import shared_folder
from factloom.operators import graph as G
from factloom.operators import patterns, trees
from factloom.plans import analogues as R
from factloom.plans.graph_queries import _URGENT
from factloom.plans.registry import query
from factloom.streaming import findings, incremental, sessions


def _hash() -> Column:
    return F.sha2(F.encode("text", "UTF-8"), 256)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- trees -----------------------------------------------------------------------------------------------------------

_TREES = """d AS (SELECT 'src/' || source || '/' || lang || '/d' || doc_id || '.ts' AS path, sha256(text) AS h, doc_id, source FROM documents),
 b AS (SELECT path, h AS bh FROM d), a AS (SELECT path, CASE WHEN doc_id % 60 = 0 THEN 'x' ELSE h END AS ah FROM d WHERE doc_id % 90 <> 7 AND source <> 'src3' UNION ALL SELECT 'bench/b' || item_id || '.ts', sha256(text) FROM benchmark),
 f AS (SELECT path, bh, ah, string_split(path, '/') AS parts FROM b FULL JOIN a USING (path)),
 up AS (SELECT bh, ah, array_to_string(parts[1:i], '/') AS dir FROM f, unnest(range(0, len(parts))) AS u(i)),
 dirs AS (SELECT dir, count(bh) AS nb, count(ah) AS na, bool_or(bh IS DISTINCT FROM ah) AS differs FROM up GROUP BY dir), two AS (SELECT dir FROM dirs WHERE nb > 0 AND na > 0)"""


@query(f"""WITH {_TREES}
 SELECT dir AS path, true AS is_directory, CASE WHEN nb = 0 THEN 'added' WHEN na = 0 THEN 'removed' ELSE 'changed' END AS change, CASE WHEN na > 0 THEN na ELSE nb END AS n_files FROM dirs
  WHERE differs AND (nb > 0 AND na > 0 OR CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END IN (SELECT dir FROM two))
 UNION ALL SELECT path, false, CASE WHEN bh IS NULL THEN 'added' WHEN ah IS NULL THEN 'removed' ELSE 'changed' END, 1 FROM f WHERE bh IS DISTINCT FROM ah AND regexp_replace(path, '/[^/]*$', '') IN (SELECT dir FROM two)""")
def u3_tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of a tree of documents: texts altered and lost, one directory gone, one new."""
    d = R.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".ts"))
    k = F.col("doc_id")
    before = d.select(path.alias("path"), _hash().alias("content_hash"))
    after = d.where((k % 90 != 7) & (F.col("source") != "src3")).select(path.alias("path"), F.when(k % 60 == 0, "x").otherwise(_hash()).alias("content_hash"))
    new = R.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench/b"), F.col("item_id").cast("string"), F.lit(".ts")).alias("path"), _hash().alias("content_hash"))
    return trees.tree_diff(trees.tree_entries(before), trees.tree_entries(after.unionAll(new)))


@query("""WITH d AS (SELECT 'src/' || source || '/' || lang || '/d' || doc_id || '.ts' AS path, sha256(text) AS h FROM documents), f AS (SELECT path, h, string_split(path, '/') AS parts FROM d),
 e AS (SELECT array_to_string(parts[1:i], '/') AS dir, sha256(array_to_string(parts[i + 1:], '/') || chr(0) || h) AS x FROM f, unnest(range(0, len(parts))) AS u(i)),
 s AS (SELECT dir, count(*) AS n, sum(CAST('0x' || substr(x, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(x, 16, 15) AS BIGINT)) AS b, sum(CAST('0x' || substr(x, 31, 15) AS BIGINT)) AS c, sum(CAST('0x' || substr(x, 46, 15) AS BIGINT)) AS d FROM e GROUP BY dir)
 SELECT dir AS path, n AS n_files, sha256(n || ':' || a || ':' || b || ':' || c || ':' || d) AS digest FROM s""")
def f_directory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("src/"), "source", F.lit("/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".ts"))
    entries = trees.tree_entries(R.table(spark, sf_dir, "documents").select(path.alias("path"), _hash().alias("content_hash")))
    return entries.where("is_directory").select("path", "n_files", "digest")


_PLACED = """p AS (SELECT array_to_string(w, '/') || '/f' || p_partkey || '.ts' AS path, w, p_size FROM (SELECT [p_type, p_brand, 's' || p_size % 7] AS w, * FROM part)),
 places AS (SELECT DISTINCT CASE WHEN p_size % 3 = 0 THEN w[1] WHEN p_size % 3 = 1 THEN w[1] || '/' || w[2] ELSE w[1] || '/' || w[2] || '/' || w[3] END AS place FROM p WHERE p_size IN (1, 2, 3, 10))"""


@query(f"WITH {_PLACED} SELECT path, (SELECT arg_max(place, length(place)) FROM places WHERE starts_with(p.path, place || '/')) AS place FROM p")
def s3_nearest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest directory with a manifest above each file; manifests lie at three depths, inside each other."""
    p = R.table(spark, sf_dir, "part").select("p_partkey", "p_size", F.array("p_type", "p_brand", F.concat(F.lit("s"), (F.col("p_size") % 7).cast("string"))).alias("w"))
    files = p.select(F.concat(F.array_join("w", "/"), F.lit("/f"), F.col("p_partkey").cast("string"), F.lit(".ts")).alias("path"))
    depth = F.when(F.col("p_size") % 3 == 0, 1).when(F.col("p_size") % 3 == 1, 2).otherwise(3)
    return trees.nearest(files, p.where("p_size IN (1, 2, 3, 10)").select(F.array_join(F.slice("w", F.lit(1), depth), "/").alias("place")))


# --- caches and streams ----------------------------------------------------------------------------------------------

_FINDING = "path string, rule_id string, target string"


@query("""WITH m AS (SELECT 'src/d' || doc_id || '.ts' AS path, text, 'src/d' || (doc_id // 2) || '.ts' AS target, doc_id FROM documents)
 SELECT m.path, 'IMPORTS-LICENSE' AS rule_id, m.target FROM m JOIN m t ON t.path = m.target WHERE m.doc_id > 0 AND contains(lower(t.text), 'license')""")
def u_findings_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that rest on what a module imports, brought up to date from an older state: texts altered, modules new and gone."""
    k = F.col("doc_id")
    path = lambda c: F.concat(F.lit("src/d"), c.cast("string"), F.lit(".ts"))
    now = R.table(spark, sf_dir, "documents").select(path(k).alias("path"), "text", k.alias("doc_id"))
    gone = now.where(k % 40 == 5).select(F.concat(F.lit("old/"), "path").alias("path"), "text", "doc_id")
    before = now.where(k % 70 != 4).withColumn("text", F.when(k % 50 == 3, F.concat(F.lit("License "), "text")).otherwise(F.col("text"))).unionByName(gone)
    folder = _folder(spark, "findings")
    for state in (before, now):
        edges = state.where("doc_id > 0").select(F.col("path").alias("from_path"), path(F.expr("doc_id div 2")).alias("to_path"))
        holding = state.where(F.contains(F.lower("text"), F.lit("license"))).select(F.col("path").alias("to_path"))
        evaluate = lambda todo, edges=edges, holding=holding: edges.join(todo.withColumnRenamed("path", "from_path"), "from_path", "left_semi").join(holding, "to_path", "left_semi").select(F.col("from_path").alias("path"), F.lit("IMPORTS-LICENSE").alias("rule_id"), F.col("to_path").alias("target"))
        findings.update(state.select("path", _hash().alias("content_hash")), edges, evaluate, folder, _FINDING, buckets=32)
    return findings.findings(spark, folder, _FINDING)


@query("SELECT CAST(conv_id AS VARCHAR) AS session, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def k8_streamed_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' turns as commands of sessions, arriving in three parts; the stream is started anew for each and counts on from its checkpoint."""
    c = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.timestamp_seconds(F.col("turn") * 60 + 1_000_000_000).alias("at"), "turn").distinct()
    arriving, log, checkpoint = (_folder(spark, n) for n in ("arriving", "log", "log-checkpoint"))
    for part in ("turn < 2", "turn >= 2 AND turn < 5", "turn >= 5"):
        c.where(part).select("session", "at").write.mode("append").parquet(arriving)
        sessions.stream_log(spark.readStream.schema("session string, at timestamp").parquet(arriving), log, checkpoint).awaitTermination()
    return spark.read.parquet(log).select("session", ((F.unix_seconds("at") - 1_000_000_000) / 60).cast("long").alias("turn"), "ordinal")


_ATOMS = """t AS (SELECT CAST(conv_id AS VARCHAR) AS context, CAST(turn AS INT) AS pos, CASE role WHEN 'system' THEN 'immutable' WHEN 'user' THEN 'session' WHEN 'assistant' THEN 'stable' ELSE 'tail' END AS cache_class, any_value(text) AS text, CAST(ceil(length(any_value(text)) / 3.0) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id, turn, role),
 u AS (SELECT *, (hash_pos % 11 = 0) AS altered FROM (SELECT *, (CAST(context AS BIGINT) * 5 + pos * 3) AS hash_pos FROM t))"""


@query(f"""WITH {_ATOMS}, f AS (SELECT context, min(pos) FILTER (WHERE altered) AS first_change FROM u GROUP BY context)
 SELECT u.context, count(*) AS n_atoms, count(*) FILTER (WHERE f.first_change IS NULL OR pos < f.first_change) AS n_reused, sum(tokens) AS tokens, coalesce(sum(tokens) FILTER (WHERE f.first_change IS NULL OR pos < f.first_change), 0) AS tokens_reused, min(f.first_change) AS first_change
 FROM u JOIN f USING (context) GROUP BY u.context""")
def u_atom_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each conversation's atoms is reused when some of its turns were others before."""
    c = R.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn", "role").agg(F.any_value("text").alias("text"))
    cls = F.when(F.col("role") == "system", "immutable").when(F.col("role") == "user", "session").when(F.col("role") == "assistant", "stable").otherwise("tail")
    after = c.select(F.col("conv_id").cast("string").alias("context"), F.col("turn").cast("int").alias("pos"), cls.alias("cache_class"), F.substring(_hash(), 1, 16).alias("fingerprint"), F.ceil(F.length("text") / 3).cast("long").alias("tokens"))
    altered = (F.col("context").cast("long") * 5 + F.col("pos") * 3) % 11 == 0
    before = after.withColumn("fingerprint", F.when(altered, "was another").otherwise(F.col("fingerprint")))
    return incremental.atom_reuse(before, after).drop("tokens_by_class")


# --- plans and edits -------------------------------------------------------------------------------------------------

_PLAN_ROWS = """r AS (SELECT 'src/' || p_brand AS path, split_part(p_name, ' ', 2) AS kind, p_name AS name, p_size AS line, p_size + 4 AS line_end, p_type AS container FROM part)"""


@query(f"""WITH {_PLAN_ROWS}, n AS (SELECT n_nationkey, n_name, n_regionkey FROM nation)
 SELECT n_name AS plan, path, name, line FROM n, r WHERE n_nationkey % 6 <> 5 AND CASE n_regionkey WHEN 0 THEN kind = 'bolt' WHEN 1 THEN contains(lower(name), 'blue') AND kind IN ('widget', 'ring') WHEN 2 THEN regexp_matches(name, '^[a-h]') AND container <> 'STANDARD' WHEN 3 THEN line <= 20 AND line_end >= n_nationkey AND path = 'src/Brand#11' ELSE path = 'src/Brand#12' END
 UNION ALL SELECT n_name, NULL, CASE WHEN n_nationkey % 2 = 0 THEN 'an inline expression has no compiled plan' ELSE 'unknown catalog ''trees''' END, NULL FROM n WHERE n_nationkey % 6 = 5""")
def q_plan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan of each nation, as JSON, run against one scan; those that can't be run come out with why."""
    bodies = [
        '"kinds": ["bolt"]', '"terms": ["blue"], "kinds": ["widget", "ring"]', '"predicates": [{"op": "match", "capture": "name", "values": ["^[a-h]"]}, {"op": "not-eq", "capture": "container", "values": ["STANDARD"]}]', '"selector": "src/Brand#11:@:20"', '"selector": "src/Brand#12"',
    ]
    region, key = F.col("n_regionkey"), F.col("n_nationkey")
    body = F.lit(bodies[4])
    for i, b in enumerate(bodies[:4]):
        body = F.when(region == i, F.replace(F.lit(b), F.lit("@"), key.cast("string"))).otherwise(body)
    good = F.concat(F.lit('{"catalog": "declarations", '), body, F.lit("}"))
    bad = F.when(key % 2 == 0, F.lit('{"catalog": "declarations", "expression": "(class)"}')).otherwise(F.lit('{"catalog": "trees"}'))
    plans = R.table(spark, sf_dir, "nation").select(F.col("n_name").alias("plan"), F.when(key % 6 == 5, bad).otherwise(good).alias("text"))
    rows = R.table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), "p_brand").alias("path"), F.lit("declaration").alias("capture"), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("kind"), F.col("p_name").alias("name"), F.col("p_size").alias("line"), (F.col("p_size") + 4).alias("line_end"), F.col("p_type").alias("container"))
    hits, errors = patterns.run_plans(plans, {"declarations": rows})
    none = lambda t: F.lit(None).cast(t)
    return hits.select("plan", "path", "name", "line").unionAll(errors.select("plan", none("string").alias("path"), F.col("error").alias("name"), none("int").alias("line")))


@query("""WITH f AS (SELECT 'd' || doc_id AS path, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS rows FROM documents),
 e AS (SELECT o_orderkey AS edit, 'd' || (o_custkey % 400) AS path, CASE o_orderkey % 7 WHEN 0 THEN 'burn' WHEN 1 THEN 'insert_after' ELSE 'replace' END AS operation, CAST(o_orderkey % 40 + 1 AS INT) AS s, CAST(o_orderkey % 40 + 1 + o_orderkey % 3 AS INT) AS e FROM orders),
 j AS (SELECT e.*, rows, EXISTS (SELECT 1 FROM e o WHERE o.path = e.path AND o.edit <> e.edit AND o.s <= e.e AND o.e >= e.s) AS shared FROM e LEFT JOIN f USING (path)),
 n AS (SELECT *, rows IS NOT NULL AND s <= len(rows) AS fits, array_to_string(rows[s:least(e, len(rows))], chr(10)) AS t FROM j),
 m AS (SELECT *, CASE WHEN fits THEN CAST((length(t) - length(replace(t, 'th', ''))) / 2 AS INT) END AS matches FROM n),
 r AS (SELECT *, CASE WHEN operation = 'burn' THEN 'unknown operation' WHEN rows IS NULL THEN 'no such file' WHEN NOT fits THEN 'the range isn''t in the file' WHEN matches = 0 THEN 'expected text isn''t in the range' WHEN matches > 3 THEN 'too many matches' WHEN shared THEN 'shares lines with another edit' END AS reason FROM m)
 SELECT edit, path, matches, CASE WHEN reason IS NULL THEN 'ready' ELSE 'rejected' END AS status, reason FROM r""")
def q_patch_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edit of each order on the text of a document, with the edits that get in each other's way."""
    k = F.col("o_orderkey")
    start = (k % 40 + 1).cast("int")
    edits = R.table(spark, sf_dir, "orders").select(
        k.alias("edit"), F.concat(F.lit("d"), (F.col("o_custkey") % 400).cast("string")).alias("path"), F.when(k % 7 == 0, "burn").when(k % 7 == 1, "insert_after").otherwise("replace").alias("operation"),
        start.alias("start"), (start + (k % 3).cast("int")).alias("end"), F.lit("th").alias("expected"), F.lit(3).alias("most"),
    )
    files = R.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
    return patterns.patch_receipts(files, edits)


# --- ranking ---------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_URGENT.replace("SELECT DISTINCT", "SELECT").replace(" FROM orders", ", CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'O' THEN 0.5 ELSE 1.0 END AS w FROM orders")},
 s AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9500), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT node FROM s), k AS (SELECT count(*) AS k FROM s),
 g AS (SELECT src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS share FROM e GROUP BY src, dst UNION ALL SELECT n.node, s.node, 1.0 / k FROM n, s, k WHERE n.node NOT IN (SELECT src FROM e)),
 x(t, node, p) AS (SELECT 0, node, CAST(1.0 / k AS DOUBLE) FROM s, k UNION ALL SELECT t, node, sum(p) FROM (SELECT x.t + 1 AS t, g.dst AS node, 0.85 * x.p * g.share AS p FROM x JOIN g ON g.src = x.node WHERE x.t < 110 UNION ALL SELECT DISTINCT x.t + 1, s.node, 0.15 / k FROM x, s, k WHERE x.t < 110) GROUP BY t, node),
 ranked AS (SELECT x.node, coalesce(c_mktsegment, 'none') AS kind, p FROM x LEFT JOIN customer ON c_custkey = x.node WHERE t = 110),
 o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY p DESC, node) AS j FROM ranked), w AS (SELECT *, p * power(0.5, j - 1) AS worth FROM o)
 SELECT node, kind, round(p, 5) AS p, row_number() OVER (ORDER BY worth DESC, node) AS place FROM w ORDER BY worth DESC, node LIMIT 8""")
def gr8_diverse_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight customers of different segments near those of high balance, over urgent orders weighted by their status."""
    o = R.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    edges = o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") * 13) % 1500).alias("dst"), F.col("o_orderstatus").alias("relation"))
    c = R.table(spark, sf_dir, "customer")
    ranked = G.personalised_rank(edges, c.where("c_acctbal > 9500").select(F.col("c_custkey").alias("node")), {"F": 2.0, "O": 0.5})
    kinds = ranked.join(c.select(F.col("c_custkey").alias("node"), "c_mktsegment"), "node", "left").select("node", F.coalesce("c_mktsegment", F.lit("none")).alias("kind"), "p")
    return G.diverse(kinds).select("node", "kind", F.round("p", 5).alias("p"), "place")
