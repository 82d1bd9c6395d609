"""Fact relations read off the driver's tables, which hold no source code: parts stand for modules, line items for imports,
events for findings, documents for files. The same derivations as SQL texts serve the independent check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def module_path(key: Column) -> Column:
    return F.concat(F.lit("src/m"), (key % 97).cast("string"), F.lit("/"), F.when(key % 11 == 0, F.lit("index")).otherwise(F.concat(F.lit("f"), (key % 1009).cast("string"))), F.lit(".ts"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module for each path; its first part decides."""
    p = table(spark, sf_dir, "part").groupBy(module_path(F.col("p_partkey")).alias("path")).agg(F.min_by(F.struct("p_size", "p_name", "p_brand"), "p_partkey").alias("p"))
    kind = F.col("p.p_size") % 10
    role = F.when(kind == 0, "facade").when(kind == 1, "entrypoint").when(kind == 2, "test").when(kind == 3, "config").otherwise("source")
    names = F.filter(F.split("p.p_name", " "), lambda n: n != "")
    return p.select("path", role.alias("role"), F.when(F.col("p.p_size") % 3 == 0, F.slice(names, 1, 0)).otherwise(names).alias("export_names"), (F.col("p.p_size") % 4 == 0).alias("has_intent_doc"))


MODULES = """
 parts AS (SELECT *, 'src/m' || CAST(p_partkey % 97 AS VARCHAR) || '/' || CASE WHEN p_partkey % 11 = 0 THEN 'index' ELSE 'f' || CAST(p_partkey % 1009 AS VARCHAR) END || '.ts' AS path FROM part),
 modules AS (SELECT path,
    CASE arg_min(p_size, p_partkey) % 10 WHEN 0 THEN 'facade' WHEN 1 THEN 'entrypoint' WHEN 2 THEN 'test' WHEN 3 THEN 'config' ELSE 'source' END AS role,
    CASE WHEN arg_min(p_size, p_partkey) % 3 = 0 THEN CAST([] AS VARCHAR[]) ELSE list_filter(string_split(arg_min(p_name, p_partkey), ' '), lambda n: n <> '') END AS export_names,
    arg_min(p_size, p_partkey) % 4 = 0 AS has_intent_doc
  FROM parts GROUP BY path)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    n = F.col("l_linenumber")
    resolution = F.when(n == 4, "external").when(n == 2, "path-alias").when(n == 3, "package-import").when(n == 7, "unresolved").otherwise("relative")
    return li.select(
        (F.col("l_orderkey") * 10 + n).alias("seq"), module_path(F.col("l_partkey")).alias("from_path"), F.when(n.isin(4, 7), F.lit(None)).otherwise(module_path(F.col("l_partkey") * 7 + F.col("l_suppkey") * 13)).alias("to_path"),
        F.concat(F.lit("./f"), (F.col("l_suppkey") % 5).cast("string")).alias("module_specifier"), F.when(F.col("l_returnflag") == "R", "export").otherwise("import").alias("kind"), (F.col("l_linestatus") == "O").alias("is_type_only"), resolution.alias("resolution"),
    )


def _path_sql(key: str) -> str:
    return f"'src/m' || CAST(({key}) % 97 AS VARCHAR) || '/' || CASE WHEN ({key}) % 11 = 0 THEN 'index' ELSE 'f' || CAST(({key}) % 1009 AS VARCHAR) END || '.ts'"


EDGES = f"""
 edges AS (SELECT l_orderkey * 10 + l_linenumber AS seq, {_path_sql("l_partkey")} AS from_path,
    CASE WHEN l_linenumber IN (4, 7) THEN NULL ELSE {_path_sql("l_partkey * 7 + l_suppkey * 13")} END AS to_path,
    './f' || CAST(l_suppkey % 5 AS VARCHAR) AS module_specifier, CASE WHEN l_returnflag = 'R' THEN 'export' ELSE 'import' END AS kind, l_linestatus = 'O' AS is_type_only,
    CASE l_linenumber WHEN 4 THEN 'external' WHEN 2 THEN 'path-alias' WHEN 3 THEN 'package-import' WHEN 7 THEN 'unresolved' ELSE 'relative' END AS resolution
  FROM lineitem)"""

DEPENDENCIES = f"""{MODULES}, {EDGES},
 deps AS (SELECT * EXCLUDE (n) FROM (
    SELECT e.*, f.role AS from_role, t.role AS to_role, (f.role = 'test' OR coalesce(t.role = 'test', false)) AS is_test_context,
      row_number() OVER (PARTITION BY e.from_path, e.to_path, e.module_specifier, e.kind, e.is_type_only ORDER BY e.seq DESC) AS n
    FROM edges e JOIN modules f ON f.path = e.from_path LEFT JOIN modules t ON t.path = e.to_path WHERE e.resolution <> 'external') WHERE n = 1)"""


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    severity = F.when(F.col("value") >= 80, "error").when(F.col("value") >= 50, "warning").otherwise("info")
    return e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("R-"), "event_type").alias("rule_id"), F.when(F.col("user_id") % 2 == 0, "core").otherwise("extra").alias("pack"), severity.alias("severity"), F.upper("event_type").alias("title"),
        F.concat(F.lit("src/u"), (F.col("user_id") % 200).cast("string"), F.lit(".ts")).alias("path"), (F.col("event_id") % 120).cast("int").alias("line"), F.concat(F.lit("v"), F.floor("value").cast("string")).alias("summary"),
    )


FINDINGS = """
 findings AS (SELECT event_id AS seq, 'R-' || event_type AS rule_id, CASE WHEN user_id % 2 = 0 THEN 'core' ELSE 'extra' END AS pack,
    CASE WHEN value >= 80 THEN 'error' WHEN value >= 50 THEN 'warning' ELSE 'info' END AS severity, upper(event_type) AS title,
    'src/u' || CAST(user_id % 200 AS VARCHAR) || '.ts' AS path, CAST(event_id % 120 AS INTEGER) AS line, 'v' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS summary FROM events)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("src/"), "source", F.lit("/"), F.when(F.col("doc_id") % 7 == 0, F.lit("tests/")).otherwise(F.lit("")), F.lit("d"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), "text", "doc_id", "source", "lang")


FILES = """
 files AS (SELECT 'src/' || source || '/' || CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END || 'd' || CAST(doc_id AS VARCHAR) || '.ts' AS path, text, doc_id, source, lang FROM documents)"""

LINES = f"""{FILES},
 split AS (SELECT path, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS rows FROM files WHERE text IS NOT NULL),
 lines AS (SELECT path, CAST(i AS INTEGER) AS line, rows[i] AS row FROM split, unnest(range(1, len(rows) + 1)) AS u(i))"""

TERMS = ("license", "apache", "rights")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each term the lines that hold it, the first three of each file, as hits in order of path and line."""
    from factloom.operators.ranking import lexical_lines
    from pyspark.sql import Window

    f = files(spark, sf_dir).select("path", "text")
    each = [lexical_lines(f, t, fuzzy=False).select(F.lit(t).alias("term"), "path", "line", "score", "snippet") for t in TERMS]
    rows = each[0].unionAll(each[1]).unionAll(each[2])
    order = Window.partitionBy("term").orderBy(F.desc("score"), "path", F.concat_ws(":", "path", F.concat_ws(":", "line", "line")))
    return rows.select(
        F.row_number().over(order).cast("bigint").alias("seq"), "term", F.lit("text").alias("kind"), F.col("path").alias("owner_path"), F.lit(None).cast("string").alias("symbol"), "path",
        F.concat_ws(":", "line", "line").alias("line_range"), "score", F.lit("source-text").alias("reason"), "snippet", F.lit(0).cast("bigint").alias("mtime_ms"),
    )


HITS = f"""{LINES}, terms AS (SELECT unnest(['license', 'apache', 'rights']) AS term),
 capped AS (SELECT * FROM (SELECT t.term, l.path, l.line, CASE WHEN contains(l.row, t.term) THEN 2 ELSE 1 END AS score, substr(trim(l.row, ' '), 1, 160) AS snippet,
      row_number() OVER (PARTITION BY t.term, l.path ORDER BY l.line) AS n FROM lines l JOIN terms t ON contains(lower(l.row), t.term)) WHERE n <= 3),
 hits AS (SELECT row_number() OVER (PARTITION BY term ORDER BY score DESC, path, path || ':' || line || ':' || line) AS seq, term, path AS owner_path, path, CAST(line AS VARCHAR) || ':' || CAST(line AS VARCHAR) AS line_range, score, snippet FROM capped)"""
