"""All queries over the driver's tables, with the SQL each must agree with.

A query applies an operator of this library to relations read off the tables (``analogues``); its SQL is written apart from
the operator. Queries without SQL are those that it can't express; the tests hold them against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import roles
from factloom.functions import scalar as S
from factloom.operators import aggregates as A
from factloom.operators import filters as P
from factloom.operators import graph as G
from factloom.operators import joins as J
from factloom.operators import ranking as W
from factloom.operators import sets as U
from factloom.plans import analogues as R
from factloom.plans import graph_queries, rule_queries, search_queries, source_queries, state_queries, token_queries, verify_queries, view_queries  # noqa: F401  they register their queries
from factloom.plans.registry import ORACLE_SQL, QUERIES, query

FLAGSHIP = "w1_fuzzy_line_search"


def _deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.owner_dependencies(R.edges(spark, sf_dir), R.modules(spark, sf_dir))


# --- text search -----------------------------------------------------------------------------------------------------

_FUZZY = "tnedin"


@query(
    f"""WITH {R.LINES},
 p AS (SELECT path, line, row, lower(row) AS t FROM lines),
 p1 AS (SELECT *, strpos(t, 't') AS a FROM p), p2 AS (SELECT *, CASE WHEN a > 0 AND strpos(substr(t, a + 1), 'n') > 0 THEN a + strpos(substr(t, a + 1), 'n') ELSE 0 END AS b FROM p1),
 p3 AS (SELECT *, CASE WHEN b > 0 AND strpos(substr(t, b + 1), 'e') > 0 THEN b + strpos(substr(t, b + 1), 'e') ELSE 0 END AS c FROM p2), p4 AS (SELECT *, CASE WHEN c > 0 AND strpos(substr(t, c + 1), 'd') > 0 THEN c + strpos(substr(t, c + 1), 'd') ELSE 0 END AS d FROM p3),
 p5 AS (SELECT *, CASE WHEN d > 0 AND strpos(substr(t, d + 1), 'i') > 0 THEN d + strpos(substr(t, d + 1), 'i') ELSE 0 END AS e FROM p4), p6 AS (SELECT *, CASE WHEN e > 0 AND strpos(substr(t, e + 1), 'n') > 0 THEN e + strpos(substr(t, e + 1), 'n') ELSE 0 END AS f FROM p5),
 m AS (SELECT path, line, CASE WHEN contains(t, '{_FUZZY}') THEN 18 WHEN f > 0 AND f - a + 1 <= 18 THEN 4 + greatest(0, 12 - (f - a + 1 - 6)) END AS score, CASE WHEN contains(t, '{_FUZZY}') THEN strpos(t, '{_FUZZY}') ELSE a END AS col FROM p6),
 r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM m WHERE score IS NOT NULL)
 SELECT path, line, score, col FROM r WHERE n <= 3 ORDER BY score DESC, path, path || ':' || line LIMIT 12"""
)
def w1_fuzzy_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, P2, W1-W3: lines that fuzzily match, three of each file at most, the top twelve."""
    hits = W.lexical_lines(R.files(spark, sf_dir), _FUZZY)
    return hits.orderBy(F.desc("score"), "path", F.concat_ws(":", "path", "line")).limit(12).select("path", "line", "score", F.col("column").alias("col"))


@query(f"WITH {R.LINES}, m AS (SELECT path, line, CASE WHEN contains(row, 'Apache') THEN 2 ELSE 1 END AS score, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM lines WHERE contains(lower(row), 'apache')) SELECT path, line, score FROM m WHERE n <= 3")
def p1_exact_line_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.lexical_lines(R.files(spark, sf_dir), "Apache", fuzzy=False).select("path", "line", "score")


@query(f"WITH {R.LINES} SELECT path, count(*) AS n_lines, sum(length(row)) AS n_signs, max(line) AS last_line FROM lines GROUP BY path")
def g1_line_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.files(spark, sf_dir).where("text IS NOT NULL").select("path", F.posexplode(S.source_lines(F.col("text"))).alias("pos", "row"))
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum(F.length("row")).alias("n_signs"), (F.max("pos") + 1).alias("last_line"))


_KEY = "'text' || chr(0) || owner_path || chr(0) || '' || chr(0) || path || chr(0) || line_range || chr(0) || 'source-text'"
_INTERLEAVED = f"""{R.HITS}, spec AS (SELECT term, len(list_distinct(string_split(term, ''))) + length(term) AS spec FROM terms),
 placed AS (SELECT h.*, s.spec, row_number() OVER (ORDER BY h.seq, s.spec DESC, h.term) AS place FROM hits h JOIN spec s USING (term)),
 keyed AS (SELECT owner_path, line_range, min(place) AS place, arg_min(score, place) AS score, string_agg(term, ',' ORDER BY term) AS terms, count(*) AS n_terms FROM placed GROUP BY owner_path, line_range),
 merged AS (SELECT * FROM keyed ORDER BY place LIMIT 12)"""


@query(f"WITH {_INTERLEAVED} SELECT owner_path, line_range, score, terms FROM merged")
def w4_query_set_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.interleave(R.hits(spark, sf_dir)).select("owner_path", "line_range", "score", F.array_join("terms", ",").alias("terms"))


@query("SELECT term, len(list_distinct(string_split(lower(term), ''))) + length(term) + 8 * (length(term) - length(regexp_replace(term, '[._/\"''()\\[\\]:]', '', 'g'))) AS spec FROM (SELECT DISTINCT p_name AS term FROM part UNION SELECT DISTINCT url FROM pages)")
def w5_term_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = R.table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).union(R.table(spark, sf_dir, "pages").select("url")).distinct()
    return terms.select("term", S.specificity(F.col("term")).alias("spec"))


@query(f"WITH {R.HITS} SELECT owner_path, count(DISTINCT term) AS coverage FROM hits GROUP BY owner_path")
def a6_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.term_coverage(R.hits(spark, sf_dir))


@query(
    f"""WITH {_INTERLEAVED}, per AS (SELECT term, count(*) AS n_hits, array_to_string(list_sort(list_distinct(list(owner_path)))[1:8], ',') AS owners FROM hits GROUP BY term),
 chosen AS (SELECT t AS term, count(*) AS n_selected FROM merged, unnest(string_split(terms, ',')) AS u(t) GROUP BY t)
 SELECT a.term, coalesce(n_hits, 0) AS n_hits, coalesce(n_selected, 0) AS n_selected, coalesce(owners, '') AS owners, CASE WHEN coalesce(n_selected, 0) > 0 THEN 'hit' WHEN coalesce(n_hits, 0) > 0 THEN 'partial' ELSE 'miss' END AS status
 FROM (SELECT term FROM terms UNION ALL SELECT 'nowhere') a LEFT JOIN per USING (term) LEFT JOIN chosen USING (term)"""
)
def a7_query_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = R.hits(spark, sf_dir)
    terms = spark.createDataFrame([(t,) for t in (*R.TERMS, "nowhere")], "term string")
    return A.query_coverage(terms, hits, W.interleave(hits)).withColumn("owners", F.array_join("owners", ","))


@query(f"WITH {R.HITS}, o AS (SELECT owner_path, count(DISTINCT term) AS n_terms, max(score) AS score, CASE WHEN contains(owner_path, '/tests/') THEN 'test' ELSE 'edit' END AS side FROM hits GROUP BY owner_path), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n_terms DESC, score DESC, owner_path) AS n FROM o) SELECT owner_path, n_terms, score, side FROM r WHERE n <= 4")
def w9_synthesis_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.synthesis_owners(R.hits(spark, sf_dir)).select("owner_path", "n_terms", "score", "side")


@query(
    f"""WITH {_INTERLEAVED},
 body AS (SELECT m.*, (SELECT any_value(h.snippet) FROM hits h WHERE h.owner_path = m.owner_path AND h.line_range = m.line_range) AS snippet FROM merged m),
 cover AS (SELECT owner_path, CAST(contains(lower(owner_path || chr(10) || snippet), 'license') AS INT) + CAST(contains(lower(owner_path || chr(10) || snippet), 'apache') AS INT) + CAST(contains(lower(owner_path || chr(10) || snippet), 'rights') AS INT) AS n FROM body),
 rows AS (SELECT owner_path, line_range, score + n_terms AS score, 'source-text' AS reason FROM merged
   UNION ALL SELECT owner_path, NULL, 100 + max(n) * 10 + CASE WHEN contains(owner_path, '/tests/') THEN 0 ELSE 2 END + max(n), 'query-set-owner-coverage' FROM cover WHERE n >= 2 GROUP BY owner_path
   UNION ALL SELECT 'src/license' || s_suppkey || '.ts', NULL, 124, 'query-set-owner-coverage' FROM supplier WHERE s_suppkey % 3 = 0)
 SELECT owner_path, line_range, score, reason FROM rows"""
)
def w6_coverage_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, W7: the merged hits and the rows that owners matching two terms add, before the last cut."""
    k = F.col("s_suppkey")
    named = R.table(spark, sf_dir, "supplier").select(F.concat(F.lit("src/license"), k.cast("string"), F.lit(".ts")).alias("path"), F.when(k % 3 == 0, F.array(F.lit("Other"), F.lit("Apache"))).otherwise(F.array(F.lit("other"))).alias("export_names"))
    return W.query_set(R.hits(spark, sf_dir), R.modules(spark, sf_dir).select("path", "export_names").unionByName(named), list(R.TERMS), k=1 << 30).select("owner_path", "line_range", "score", "reason")


@query(f"WITH {R.HITS}, o AS (SELECT owner_path, count(DISTINCT term) AS n_terms FROM hits WHERE NOT contains(owner_path, '/tests/') AND contains(lower(owner_path), 'src1') GROUP BY owner_path) SELECT owner_path, n_terms FROM o")
def w8_owner_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.owner_frontier(R.hits(spark, sf_dir), ["src1", "license"]).select("owner_path", "n_terms")


@query(f"WITH {R.LINES} SELECT path, min(CASE WHEN regexp_matches(row, '(?i)^\\s*(export\\s+)?(async\\s+)?(function|class|interface|type|enum|const|let|var)\\s+under\\b') THEN 0 WHEN regexp_matches(row, '(?i)\\bunder\\s*\\(') THEN 1 WHEN regexp_matches(row, '(?i)\\bexport\\b') THEN 2 ELSE 3 END) AS line_class FROM lines WHERE contains(lower(row), 'under') GROUP BY path")
def a11_least_line_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.files(spark, sf_dir).select("path", F.explode(S.source_lines(F.col("text"))).alias("text"))
    return A.least_class(lines, "under")


@query(
    """WITH f AS (SELECT page_id, url, string_split(url, '/')[-1] AS name FROM pages)
 SELECT page_id, CASE WHEN contains(lower(name), 'pageref') THEN 80 ELSE 0 END + CASE WHEN contains(lower(name), 'page') THEN 25 ELSE 0 END + CASE WHEN contains(lower(name), 'ref') THEN 25 ELSE 0 END + CASE WHEN contains(lower(name), 'top') THEN 70 ELSE 0 END AS score FROM f"""
)
def w12_filename_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "pages").select("page_id", S.filename_score(S.basename(F.col("url")), "pageRef", "top").alias("score"))


@query(
    """SELECT doc_id, CASE WHEN contains(lower(source), 'the') THEN 40 ELSE 0 END + 10 * least(8, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS INT)) + CASE WHEN regexp_matches(lower(text), '\\b(function|class|interface|type|enum)\\s+the\\b') THEN 30 ELSE 0 END
   + CASE WHEN regexp_matches(lower(text), '\\b(const|let|var)\\s+the\\b') THEN 20 ELSE 0 END AS score FROM documents WHERE text IS NOT NULL"""
)
def w12_text_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", S.text_score(F.col("source"), F.col("text"), "the").alias("score"))


# --- predicates and selectors ----------------------------------------------------------------------------------------

_MATRIX = [("eq", ("click",)), ("any-eq", ("click", "view")), ("any-of", ("view",)), ("match", ("^c",)), ("any-match", ("ck$", "^v")), ("not-eq", ("click",)), ("not-match", ("^p",))]


@query(
    """SELECT 'eq' AS op, count(*) AS n FROM events WHERE event_type = 'click' UNION ALL SELECT 'any-eq', count(*) FROM events WHERE event_type IN ('click', 'view') UNION ALL SELECT 'any-of', count(*) FROM events WHERE event_type = 'view'
 UNION ALL SELECT 'match', count(*) FROM events WHERE event_type LIKE 'c%' UNION ALL SELECT 'any-match', count(*) FROM events WHERE event_type LIKE '%ck' OR event_type LIKE 'v%'
 UNION ALL SELECT 'not-eq', count(*) FROM events WHERE event_type <> 'click' UNION ALL SELECT 'not-match', count(*) FROM events WHERE event_type NOT LIKE 'p%'"""
)
def p4_predicate_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4: one scan counts all seven."""
    e = R.table(spark, sf_dir, "events")
    counts = [F.count_if(P.Predicate(op, "event_type", tuple(P.Operand(v) for v in values)).column()).alias(op) for op, values in _MATRIX]
    return e.agg(*counts).select(F.explode(F.map_from_arrays(F.array(*[F.lit(op) for op, _ in _MATRIX]), F.array(*[F.col(f"`{op}`") for op, _ in _MATRIX]))).alias("op", "n"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name || chr(10) || p_brand || chr(10) || p_type), '1') AND contains(lower(p_name || chr(10) || p_brand || chr(10) || p_type), 'brand')")
def p5_term_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.where_terms(R.table(spark, sf_dir, "part"), ["Brand", "1"], ["p_name", "p_brand", "p_type"]).select("p_partkey")


@query(f"WITH {R.FINDINGS} SELECT seq, path, line FROM findings WHERE path = 'src/u7.ts' AND line <= 60 AND line >= 20")
def p6_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.findings(spark, sf_dir).withColumn("line_end", F.col("line"))
    return rows.where(P.Selector.parse("src/u7.ts:20:60").column()).select("seq", "path", "line")


@query(f"WITH {R.FINDINGS} SELECT severity, count(*) AS n FROM findings WHERE severity IN ('warning', 'error') OR rule_id = 'R-view' GROUP BY severity")
def p18_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.blocking(R.findings(spark, sf_dir), rule_ids=["R-view"]).groupBy("severity").agg(F.count("*").alias("n"))


@query(f"WITH {R.FINDINGS} SELECT rule_id, pack, CASE WHEN rule_id = 'R-click' THEN 'error' WHEN pack = 'extra' THEN 'warning' ELSE severity END AS severity, count(*) AS n FROM findings WHERE rule_id <> 'R-view' GROUP BY ALL")
def p19_policy_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame([("rule", "R-click", False, "error"), ("rule", "R-view", True, None), ("pack", "extra", False, "warning")], "scope string, name string, disabled boolean, severity string")
    return P.apply_policy(R.findings(spark, sf_dir), overrides).groupBy("rule_id", "pack", "severity").agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT page_id, u.href FROM pages, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS u(href)), c AS (SELECT page_id, href, '/' || (page_id % 9) AS known FROM l),
 t AS (SELECT page_id, href, CASE WHEN href LIKE '/t%' THEN 'src' || href ELSE NULL END AS target FROM l)
 SELECT resolution, count(*) AS n FROM (SELECT CASE WHEN target IS NULL THEN CASE WHEN href LIKE '.%' OR href LIKE '#%' OR href LIKE '/a%' THEN 'unresolved' ELSE 'external' END WHEN href LIKE '/th%' THEN 'path-alias' ELSE 'package-import' END AS resolution FROM t) GROUP BY resolution"""
)
def p9_import_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = R.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    target = F.when(F.col("href").startswith("/t"), F.concat(F.lit("src"), "href"))
    return links.select(roles.import_resolution(F.col("href"), target, ["/th*", "/a*"], "src").alias("resolution")).groupBy("resolution").agg(F.count("*").alias("n"))


@query(f"WITH {R.FILES}, c AS (SELECT path, CASE WHEN contains(path, '/src0/') THEN 'test' WHEN contains(path, '/d1.ts') THEN 'entrypoint' ELSE 'source' END AS role FROM files) SELECT role, CASE WHEN role = 'test' THEN 'test' WHEN path LIKE 'src/src1/%' THEN 'harness' ELSE 'harness' END AS layer, count(*) AS n FROM c GROUP BY ALL")
def p10_roles_and_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [f"src/src{i}/{t}d1.ts" for i in range(64) for t in ("", "tests/")]
    role = roles.module_role(F.col("path"), F.lit(False), ["src"], ["src/src0"], entries)
    f = R.files(spark, sf_dir).select("path", role.alias("role"))
    return f.groupBy("role", roles.module_layer(F.col("path"), F.col("role")).alias("layer")).agg(F.count("*").alias("n"))


@query(f"WITH {R.FILES} SELECT count(*) FILTER (WHERE regexp_matches(lower(path), '/tests?/|/__tests__/|\\.test\\.|\\.spec\\.')) AS as_search, count(*) FILTER (WHERE regexp_matches(substr(path, 5), '^tests?$|(^|/)tests?/|\\.(test|spec)\\.tsx?$')) AS as_prefilter FROM files")
def p13_test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.files(spark, sf_dir)
    return f.agg(F.count_if(S.is_test_path(F.col("path"))).alias("as_search"), F.count_if(S.is_test_path_for_prefilter(F.substring("path", 5, 1 << 30))).alias("as_prefilter"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query(f"WITH {R.DEPENDENCIES} SELECT from_path, to_path, module_specifier, kind, is_type_only, seq, from_role, to_role, is_test_context FROM deps")
def j1_owner_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, W19."""
    return _deps(spark, sf_dir).select("from_path", "to_path", "module_specifier", "kind", "is_type_only", "seq", "from_role", "to_role", "is_test_context")


@query(
    f"""WITH {R.MODULES}, asked AS (SELECT c_custkey AS id, 'src/m' || CAST(c_custkey % 97 AS VARCHAR) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '/f' || CAST(c_custkey % 1009 AS VARCHAR) || '.js' END AS path FROM customer),
 bare AS (SELECT id, path, regexp_replace(path, '\\.js$', '') AS b FROM asked),
 tried AS (SELECT id, 0 AS pos, path AS to_path FROM bare UNION ALL SELECT id, 1, b FROM bare UNION ALL SELECT id, 2, b || '.ts' FROM bare UNION ALL SELECT id, 7, b || '/index.ts' FROM bare)
 SELECT id, arg_min(to_path, pos) AS to_path FROM tried WHERE to_path IN (SELECT path FROM modules) GROUP BY id"""
)
def j2_candidate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    path = F.concat(F.lit("src/m"), (key % 97).cast("string"), F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("/f"), (key % 1009).cast("string"), F.lit(".js"))))
    return J.resolve_paths(R.table(spark, sf_dir, "customer").select(key.alias("id"), path.alias("path")), R.modules(spark, sf_dir))


@query(
    f"""WITH {R.MODULES}, e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'lib' || CAST(s_suppkey AS VARCHAR) ELSE './dist/m' || CAST(s_suppkey % 97 AS VARCHAR) || '/f' || CAST(s_suppkey % 1009 AS VARCHAR) || '.js' END AS target FROM supplier),
 t AS (SELECT *, 'src/' || substr(regexp_replace(target, '\\.js$', ''), 8) || '.ts' AS at FROM e)
 SELECT s_suppkey, CASE WHEN target NOT LIKE '.%' THEN 'external' WHEN m.path IS NOT NULL THEN 'parser-visible' ELSE 'unresolved' END AS resolution, CASE WHEN target LIKE '.%' THEN m.path END AS to_path FROM t LEFT JOIN modules m ON m.path = t.at"""
)
def j3_manifest_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    target = F.when(key % 4 == 0, F.concat(F.lit("lib"), key.cast("string"))).otherwise(F.concat(F.lit("./dist/m"), (key % 97).cast("string"), F.lit("/f"), (key % 1009).cast("string"), F.lit(".js")))
    return J.manifest_targets(R.table(spark, sf_dir, "supplier").select("s_suppkey", target.alias("target")), R.modules(spark, sf_dir), "dist", "src").select("s_suppkey", "resolution", "to_path")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, 'pkg' || CAST(l_suppkey % 40 AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '/sub' ELSE '' END AS s FROM lineitem), p AS (SELECT DISTINCT 'pkg' || CAST(n_nationkey AS VARCHAR) AS name FROM nation)
 SELECT p.name AS package, CASE WHEN i.s = p.name THEN 'package-name' ELSE 'package-subpath' END AS via, count(*) AS n FROM i JOIN p ON i.s = p.name OR starts_with(i.s, p.name || '/') GROUP BY ALL""")
def j4_package_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = F.concat(F.lit("pkg"), (F.col("l_suppkey") % 40).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, F.lit("/sub")).otherwise(F.lit("")))
    packages = R.table(spark, sf_dir, "nation").select(F.concat(F.lit("pkg"), F.col("n_nationkey").cast("string")).alias("name"))
    return J.package_imports(R.table(spark, sf_dir, "lineitem").select(spec.alias("module_specifier")), packages).groupBy("package", "via").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT n_name AS name, 'packages/' || n_nationkey AS path, 'packages/' || n_nationkey || '/tsconfig.json' AS config_path FROM nation), r AS (SELECT c_custkey, 'packages/' || (c_nationkey + c_custkey % 3) || CASE WHEN c_custkey % 2 = 0 THEN '/tsconfig.json' ELSE '' END AS path FROM customer)
 SELECT c_custkey, p.name AS package, CASE WHEN p.name IS NULL THEN 'external' ELSE 'workspace' END AS resolution FROM r LEFT JOIN p ON r.path = p.path OR r.path = p.config_path""")
def j5_reference_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.concat(F.lit("packages/"), F.col("n_nationkey").cast("string"))
    packages = R.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), at.alias("path"), F.concat(at, F.lit("/tsconfig.json")).alias("config_path"))
    path = F.concat(F.lit("packages/"), (F.col("c_nationkey") + F.col("c_custkey") % 3).cast("string"), F.when(F.col("c_custkey") % 2 == 0, F.lit("/tsconfig.json")).otherwise(F.lit("")))
    return J.reference_packages(R.table(spark, sf_dir, "customer").select("c_custkey", path.alias("path")), packages).select("c_custkey", "package", "resolution")


@query(f"WITH {R.MODULES}, {R.FINDINGS}, h AS (SELECT 'src/m' || CAST(seq % 97 AS VARCHAR) || '/f' || CAST(seq % 1009 AS VARCHAR) || '.ts' AS owner_path, min(seq) AS seq FROM findings GROUP BY 1) SELECT seq, owner_path, coalesce(m.role, 'unknown') AS role FROM h LEFT JOIN modules m ON m.path = h.owner_path")
def j6_owners_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.modules(spark, sf_dir)
    owner = F.concat(F.lit("src/m"), (F.col("seq") % 97).cast("string"), F.lit("/f"), (F.col("seq") % 1009).cast("string"), F.lit(".ts"))
    return J.owners_of_hits(R.findings(spark, sf_dir).select("seq", owner.alias("owner_path")), m.where("role IN ('facade', 'entrypoint')"), m)


@query(f"WITH {R.DEPENDENCIES}, d AS (SELECT DISTINCT path FROM modules WHERE list_contains(list_transform(export_names, lambda n: lower(n)), 'widget')) SELECT from_path, to_path, kind, CASE WHEN kind = 'export' THEN 3 ELSE 4 END AS score, count(*) AS n FROM deps JOIN d ON d.path = to_path WHERE from_path <> to_path GROUP BY ALL")
def j8_callsites(spark: SparkSession, sf_dir: str) -> DataFrame:
    exports = R.modules(spark, sf_dir).select("path", F.explode("export_names").alias("name"))
    return J.callsites("Widget", exports, _deps(spark, sf_dir)).groupBy("from_path", "to_path", "kind", "score").agg(F.count("*").alias("n"))


_TARGET = "src/m5/index.ts"


@query(
    f"""WITH RECURSIVE {R.DEPENDENCIES}, g AS (SELECT DISTINCT from_path, to_path FROM deps WHERE to_path IS NOT NULL AND from_role <> 'test'),
 walk(node, depth) AS (SELECT '{_TARGET}', 1 UNION SELECT g.from_path, w.depth + 1 FROM walk w JOIN g ON g.to_path = w.node WHERE w.depth < 8)
 SELECT node, min(depth) AS depth FROM walk GROUP BY node"""
)
def gr2_bounded_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.depth_to_target(_deps(spark, sf_dir), _TARGET)


@query(
    f"""WITH RECURSIVE {R.DEPENDENCIES}, g AS (SELECT DISTINCT from_path, to_path FROM deps WHERE to_path IS NOT NULL AND from_role <> 'test'),
 walk(node, depth) AS (SELECT '{_TARGET}', 1 UNION SELECT g.from_path, w.depth + 1 FROM walk w JOIN g ON g.to_path = w.node WHERE w.depth < 8), reach AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node),
 c AS (SELECT seq, from_path AS test_path, CASE WHEN to_path = '{_TARGET}' THEN to_path WHEN contains(from_path, '{_TARGET}') THEN '{_TARGET}' WHEN contains(module_specifier, 'f4') THEN to_path WHEN from_role = 'test' AND depth IS NOT NULL THEN '{_TARGET}' END AS source_path,
   CASE WHEN to_path = '{_TARGET}' THEN 8 WHEN contains(from_path, '{_TARGET}') THEN 4 WHEN contains(module_specifier, 'f4') THEN 3 WHEN from_role = 'test' AND depth IS NOT NULL THEN 6 END AS score
   FROM deps LEFT JOIN reach ON node = to_path WHERE is_test_context AND to_path IS NOT NULL),
 b AS (SELECT *, row_number() OVER (PARTITION BY source_path, test_path ORDER BY score DESC, seq) AS n FROM c WHERE score IS NOT NULL)
 SELECT score, count(*) AS n FROM b WHERE n = 1 GROUP BY score"""
)
def j9_tests_for_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, A10 over all test edges; a view would cut it to thirty."""
    return G.tests_for_owner(_deps(spark, sf_dir), _TARGET, "f4", most=1 << 30).groupBy("score").agg(F.count("*").alias("n"))


@query(
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) SELECT o_orderkey, l_quantity AS branches FROM orders LEFT JOIN f ON l_orderkey = o_orderkey AND n = 1"""
)
def j10_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.col(c).cast("string").alias("function_name")
    params = R.table(spark, sf_dir, "orders").select(F.lit("a").alias("path"), "o_orderkey", name("o_orderkey"))
    place = F.struct(F.col("l_linenumber").isNull(), "l_linenumber", "_metadata.file_path", "_metadata.row_index")  # nulls come last; line numbers repeat in an order: of equal ones the table's first row wins
    flows = R.table(spark, sf_dir, "lineitem").select(F.lit("a").alias("path"), name("l_orderkey"), place.alias("seq"), F.col("l_quantity").alias("branches"), F.lit(0).alias("loops"), F.lit(0).alias("max_nesting"))
    return J.params_with_flow(params, flows).select("o_orderkey", "branches")


@query("""WITH d AS (SELECT 'pkg' || CAST(s_suppkey AS VARCHAR) AS package, string_agg(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'dev' ELSE 'prod' END, ',') AS sources FROM supplier GROUP BY 1), u AS (SELECT 'pkg' || CAST(l_suppkey * 2 AS VARCHAR) AS package, count(*) AS n FROM lineitem GROUP BY 1)
 SELECT coalesce(d.package, u.package) AS package, coalesce(d.sources, '') AS sources, coalesce(u.n, 0) AS n_imports FROM d FULL JOIN u ON d.package = u.package""")
def j11_manifest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "supplier").select(F.concat(F.lit("pkg"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "dev").otherwise("prod").alias("source"), F.lit("^1").alias("version_range"))
    i = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("pkg"), (F.col("l_suppkey") * 2).cast("string"), F.lit("/x")).alias("module_specifier"))
    return J.manifest_usage(d, i).select("package", F.array_join("sources", ",").alias("sources"), "n_imports")


@query("""WITH r AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn, turn AS s, turn + 1 AS e FROM conversations), sel AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS path, 2 AS a, 4 AS b FROM conversations WHERE conv_id % 2 = 0)
 SELECT r.path, turn, count(*) AS n FROM r JOIN sel ON r.path = sel.path AND r.s <= sel.b AND r.e >= sel.a GROUP BY ALL""")
def j12_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("path"), "turn", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.col("turn").alias("item_start"), (F.col("turn") + 1).alias("item_end"))
    sel = c.where("conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("path"), F.lit(4).alias("sel_start"), F.lit(2).alias("sel_end"))
    return J.overlapping(rows, sel, width=3).groupBy("path", "turn").agg(F.count("*").alias("n"))


@query("""WITH l AS (SELECT CAST(l_suppkey AS VARCHAR) AS path, CAST(l_quantity AS INT) AS line, l_orderkey, l_linenumber FROM lineitem), f AS (SELECT CAST(s_suppkey AS VARCHAR) AS path, 1 AS seq, 5 AS a, 20 AS b FROM supplier UNION ALL SELECT CAST(s_suppkey AS VARCHAR), 2, 15, 30 FROM supplier)
 SELECT l_orderkey, l_linenumber, (SELECT max(seq) FROM f WHERE f.path = l.path AND l.line BETWEEN f.a AND f.b) AS fixture FROM l""")
def j13_line_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13, G14."""
    lines = R.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("path"), F.col("l_quantity").cast("int").alias("line"), "l_orderkey", "l_linenumber")
    s = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"))
    one = lambda seq, a, b: s.select("path", F.lit(seq).alias("seq"), F.lit(str(seq)).alias("fixture_path"), F.lit(a).alias("line"), F.lit(b).alias("line_end"))
    return J.lines_in_intervals(lines, one(1, 5, 20).unionAll(one(2, 15, 30))).select("l_orderkey", "l_linenumber", F.col("fixture_path").cast("int").alias("fixture"))


@query(f"WITH {R.MODULES}, h AS (SELECT c_custkey, {R._path_sql('c_custkey')} AS owner_path FROM customer) SELECT c_custkey, owner_path, m.role, m.path IS NOT NULL AS known FROM h LEFT JOIN modules m ON m.path = h.owner_path")
def j14_hints_to_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = R.table(spark, sf_dir, "customer").select("c_custkey", R.module_path(F.col("c_custkey")).alias("owner_path"))
    return J.hints_with_modules(hints, R.modules(spark, sf_dir)).select("c_custkey", "owner_path", "role", "known")


@query(
    """WITH r AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id % 5 <> 0 GROUP BY doc_id), w AS (SELECT doc_id, min(toxic) AS toxic FROM labels WHERE doc_id % 2 = 0 GROUP BY doc_id)
 SELECT d.doc_id, CASE WHEN quality = 1 THEN 'satisfied' WHEN quality = 0 THEN 'failed' WHEN toxic = 0 THEN 'waived' ELSE 'pending' END AS state, CASE WHEN quality IS NULL AND toxic = 1 THEN 'waiver is incomplete' END AS note FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN w USING (doc_id)"""
)
def j15_task_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = [F.lit("stress").alias("kind"), F.lit("f").alias("fingerprint"), F.col("doc_id").cast("string").alias("owner_path")]
    labels = R.table(spark, sf_dir, "labels")
    receipts = labels.where("doc_id % 5 <> 0").select(F.col("quality").alias("seq"), *key, F.when(F.col("quality") == 1, "passed").otherwise("failed").alias("status"))
    waivers = labels.where("doc_id % 2 = 0").select(F.col("toxic").alias("seq"), *key, F.lit("me").alias("owner"), F.lit("why").alias("reason"), F.when(F.col("toxic") == 0, "2099-01-01").otherwise("").alias("expires_at"))
    tasks = R.table(spark, sf_dir, "documents").select("doc_id", *key)
    return J.resolve_tasks(tasks, receipts, waivers).select("doc_id", "state", "note")


@query("""WITH d AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS owner_path, 'pkg' || CAST(l_suppkey % 6 AS VARCHAR) AS package FROM lineitem), s AS (SELECT 'pkg0' AS package, 'security' AS r UNION ALL SELECT 'pkg0', 'persistence' UNION ALL SELECT 'pkg3', 'latency_sensitive')
 SELECT owner_path, string_agg(DISTINCT r, ',' ORDER BY r) AS responsibilities FROM d JOIN s USING (package) GROUP BY owner_path""")
def j16_dependency_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).cast("string").alias("from_path"), F.concat(F.lit("pkg"), (F.col("l_suppkey") % 6).cast("string"), F.lit("/x")).alias("module_specifier"))
    s = spark.createDataFrame([("pkg0", "security"), ("pkg0", "persistence"), ("pkg3", "latency_sensitive")], "package string, responsibility string")
    return J.dependency_signals(d, s).select("owner_path", F.array_join("responsibilities", ",").alias("responsibilities"))


@query("""WITH need AS (SELECT c_custkey, list_distinct([c_mktsegment, 'BUILDING']) AS s FROM customer), has AS (SELECT o_custkey, list(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE 'BUILDING' END) AS h FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey)
 SELECT c_custkey, CASE WHEN h IS NULL THEN 'missing' WHEN list_has_all(h, s) THEN 'configured' ELSE 'drift' END AS state FROM need LEFT JOIN has ON o_custkey = c_custkey""")
def j17_hint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = R.table(spark, sf_dir, "customer")
    need = c.select("c_custkey", F.col("c_custkey").cast("string").alias("owner_path"), F.array_distinct(F.array("c_mktsegment", F.lit("BUILDING"))).alias("suggested"))
    o = R.table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    hints = o.select(F.col("o_custkey").cast("string").alias("owner_path"), F.array(F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).otherwise("BUILDING")).alias("responsibilities"))
    return J.hint_coverage(need, hints).select("c_custkey", "state")


@query("WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents), old AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS h, doc_id % 3 <> 0 AS ok FROM documents WHERE doc_id % 4 <> 0) SELECT 'reused' AS what, count(*) AS n FROM old JOIN c USING (doc_id, h) WHERE ok UNION ALL SELECT 'parsed', count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM old WHERE ok AND old.doc_id = c.doc_id AND old.h = c.h)")
def j18_incremental_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = R.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"))
    old = d.where("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("content_hash")).alias("content_hash"), (F.col("doc_id") % 3 != 0).alias("is_valid"))
    reused, parsed = J.reusable(d, old)
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(reused, "reused").unionAll(count(parsed, "parsed"))


@query(
    f"""WITH {R.MODULES}, i AS (SELECT from_path AS path, './' || string_split(to_path, '/')[-1] AS s FROM (SELECT {R._path_sql("l_partkey")} AS from_path, {R._path_sql("l_partkey + 97 * l_suppkey")} AS to_path FROM lineitem)),
 t AS (SELECT regexp_replace(path, '\\.ts$', '') AS a, regexp_extract(path, '^(.*)/', 1) || '/' || substr(s, 3) AS b FROM i),
 e AS (SELECT CASE WHEN a LIKE '%/index' THEN regexp_replace(a, '/index$', '') ELSE a END AS from_owner, CASE WHEN b LIKE '%/index.ts' THEN regexp_replace(b, '/index\\.ts$', '') ELSE regexp_replace(b, '\\.ts$', '') END AS to_owner FROM t WHERE b IN (SELECT path FROM modules))
 SELECT from_owner, to_owner, count(*) AS weight FROM e WHERE from_owner <> to_owner GROUP BY ALL"""
)
def j19_syntax_owner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19, A12."""
    li = R.table(spark, sf_dir, "lineitem")
    imports = li.select(R.module_path(F.col("l_partkey")).alias("path"), F.concat(F.lit("./"), S.basename(R.module_path(F.col("l_partkey") + 97 * F.col("l_suppkey")))).alias("module_specifier"))
    return J.syntax_owner_edges(imports, R.modules(spark, sf_dir))


# --- aggregations ----------------------------------------------------------------------------------------------------


@query(f"WITH {R.EDGES} SELECT from_path, count(*) AS n_imports, count(*) FILTER (WHERE resolution = 'relative') AS n_relative, count(*) FILTER (WHERE resolution = 'path-alias') AS n_path_alias, count(*) FILTER (WHERE resolution = 'package-import') AS n_package_import, count(*) FILTER (WHERE resolution = 'external') AS n_external, count(*) FILTER (WHERE resolution = 'unresolved') AS n_unresolved FROM edges GROUP BY from_path")
def a1_import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.import_summary(R.edges(spark, sf_dir))


@query(f"WITH {R.FINDINGS} SELECT rule_id, path, arg_min(summary, seq) AS summary, count(*) AS n FROM findings GROUP BY rule_id, path")
def a2_first_and_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_and_count(R.findings(spark, sf_dir), ["rule_id", "path"], "summary")


@query(f"WITH {R.FINDINGS} SELECT path, string_agg(rule_id, ',' ORDER BY seq) AS rule_ids FROM findings GROUP BY path")
def a3_ordered_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.ordered_lists(R.findings(spark, sf_dir), ["path"], "rule_id").select("path", F.array_join("rule_ids", ",").alias("rule_ids"))


@query(f"WITH {R.EDGES} SELECT from_path, count(DISTINCT to_path) AS n_targets FROM edges WHERE to_path IS NOT NULL GROUP BY from_path HAVING count(DISTINCT to_path) >= 2")
def a4_distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_targets(R.edges(spark, sf_dir))


@query(f"WITH {R.EDGES}, c AS (SELECT from_path, module_specifier, count(*) AS n, min(seq) AS first FROM edges GROUP BY ALL HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY from_path ORDER BY first, module_specifier) AS rank FROM c) SELECT from_path, module_specifier, n, rank FROM r WHERE rank <= 3 ORDER BY from_path, rank LIMIT 20")
def a5_repeated_specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.repeated_specifiers(R.edges(spark, sf_dir))


@query(f"WITH {R.EDGES} SELECT from_path, least(count(*), 10) AS degree FROM edges GROUP BY from_path")
def a8_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.out_degree(R.edges(spark, sf_dir))


@query(f"WITH {R.MODULES}, {R.EDGES}, s AS (SELECT path FROM modules WHERE role = 'facade') SELECT CASE WHEN a.path IS NULL THEN from_path ELSE to_path END AS path, count(*) AS n FROM edges LEFT JOIN s a ON a.path = from_path LEFT JOIN s b ON b.path = to_path WHERE to_path IS NOT NULL AND (a.path IS NULL) <> (b.path IS NULL) GROUP BY 1")
def a9_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.frontier(R.edges(spark, sf_dir), R.modules(spark, sf_dir).where("role = 'facade'"))


@query(f"WITH {R.MODULES}, o AS (SELECT *, CASE WHEN path LIKE '%/index.ts' THEN regexp_replace(path, '/index\\.ts$', '') ELSE regexp_replace(path, '\\.ts$', '') END AS owner FROM modules), r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY path NOT LIKE '%/index.ts', len(export_names) DESC, path) AS k, count(*) OVER (PARTITION BY owner) AS n FROM o) SELECT owner, n, path AS primary_path FROM r WHERE k = 1")
def a13_owner_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.owner_groups(R.modules(spark, sf_dir))


@query("""WITH f AS (SELECT p_partkey AS k, 'src/g' || (p_partkey % 40) || CASE p_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' ELSE '/index.ts' END AS path FROM part), u AS (SELECT DISTINCT path FROM f), o AS (SELECT path, regexp_replace(regexp_replace(path, '\\.tsx?$', ''), '/index$', '') AS owner FROM u),
 joined AS (SELECT DISTINCT a.owner FROM f JOIN o a ON a.path = f.path JOIN o b ON b.path = a.owner || '.ts' WHERE f.k % 120 < 5 AND a.owner = b.owner) SELECT owner, string_agg(path, ',' ORDER BY path) AS paths FROM o WHERE owner NOT IN (SELECT owner FROM joined) GROUP BY owner HAVING count(*) > 1""")
def a14_shadowed_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    f = R.table(spark, sf_dir, "part").select(k, F.concat(F.lit("src/g"), (k % 40).cast("string"), F.when(k % 3 == 0, ".ts").when(k % 3 == 1, ".tsx").otherwise("/index.ts")).alias("path"))
    exported = f.where("p_partkey % 120 < 5").select(F.col("path").alias("from_path"), F.concat(S.namespace(F.col("path")), F.lit(".ts")).alias("to_path"), F.lit("export").alias("kind"))
    return A.shadowed_owners(f.select("path", F.lit("source").alias("role")).distinct(), exported).select("owner", F.array_join("paths", ",").alias("paths"))


@query(f"WITH {R.FILES} SELECT source, sum(CAST(ceil(length(text) / 3.0) AS BIGINT)) AS tokens, substr(sha256(string_agg(substr(sha256(text), 1, 16), ':' ORDER BY substr(sha256(text), 1, 16))), 1, 16) AS fingerprint FROM files GROUP BY source")
def a17_group_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.files(spark, sf_dir)
    return A.group_fingerprint(f.withColumn("fingerprint", S.fingerprint16(F.col("text"))), ["source"])


@query(f"WITH {R.MODULES}, {R.EDGES}, {R.FINDINGS}, i AS (SELECT * FROM edges WHERE to_path IS NOT NULL AND from_path <> to_path) SELECT (SELECT count(*) FROM modules) AS n_modules, (SELECT count(*) FROM modules WHERE path NOT IN (SELECT to_path FROM i)) AS n_roots, (SELECT count(*) FROM i) AS n_dependencies, (SELECT count(DISTINCT from_path) FROM i) AS n_branches, (SELECT count(*) FROM findings) AS n_findings")
def a18_snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.snapshot_counts(R.modules(spark, sf_dir), R.edges(spark, sf_dir), R.findings(spark, sf_dir))


@query(f"WITH {R.DEPENDENCIES}, e AS (SELECT from_path, to_path FROM deps WHERE to_path IS NOT NULL AND NOT is_test_context) SELECT path, sum(i) AS fan_in, sum(o) AS fan_out FROM (SELECT from_path AS path, 0 AS i, 1 AS o FROM e UNION ALL SELECT to_path, 1, 0 FROM e) GROUP BY path")
def a20_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.topology(_deps(spark, sf_dir))


@query("WITH e AS (SELECT 'c' || c_nationkey AS a, 's' || (c_custkey % 7) AS b, c_mktsegment AS label FROM customer) SELECT b AS owner, label, string_agg(DISTINCT a, ',' ORDER BY a) AS peers FROM e GROUP BY b, label")
def a21_fan_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A21: seven targets make fewer groups than twenty-five sources."""
    c = R.table(spark, sf_dir, "customer")
    e = c.select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("from_path"), F.concat(F.lit("s"), (F.col("c_custkey") % 7).cast("string")).alias("to_path"), F.col("c_mktsegment").alias("label"))
    return A.grouped_edges(e)[1].select("owner", "label", F.array_join("peers", ",").alias("peers"))


@query(f"WITH {R.FINDINGS} SELECT severity, rule_id, title, count(*) AS n, arg_min(path, seq) AS first_path FROM findings GROUP BY severity, rule_id, title")
def a22_finding_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.finding_groups(R.findings(spark, sf_dir))


@query(f"WITH {R.EDGES} SELECT DISTINCT from_path || ' -> ' || to_path AS line FROM edges WHERE to_path IS NOT NULL UNION SELECT from_path || ' -> pkg' FROM edges WHERE resolution = 'external' UNION SELECT './s' || s_suppkey || ' -> src/f' || s_suppkey || '.ts' FROM supplier")
def a23_dependency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = R.edges(spark, sf_dir), F.col("s_suppkey").cast("string")
    packages = e.where("resolution = 'external'").select("from_path", F.lit("pkg").alias("package"))
    entries = R.table(spark, sf_dir, "supplier").select(F.concat(F.lit("./s"), k).alias("subpath"), F.concat(F.lit("src/f"), k, F.lit(".ts")).alias("to_path"))
    return A.dependency_lines(e, packages, entries)


# --- graphs ----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH RECURSIVE {R.DEPENDENCIES}, s AS (SELECT path, role FROM modules WHERE role IN ('source', 'facade', 'entrypoint')), few AS (SELECT path FROM s WHERE role = 'facade'),
 g AS (SELECT DISTINCT from_path, to_path FROM deps WHERE NOT is_test_context AND from_path IN (SELECT path FROM s) AND to_path IN (SELECT path FROM s)),
 walk(node) AS (SELECT path FROM s WHERE role IN ('facade', 'entrypoint') UNION SELECT g.to_path FROM walk w JOIN g ON g.from_path = w.node)
 SELECT path FROM s WHERE role = 'source' AND path NOT IN (SELECT node FROM walk)"""
)
def gr1_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    nothing = spark.createDataFrame([], "resolution string, to_path string")
    return G.orphans(R.modules(spark, sf_dir), _deps(spark, sf_dir), nothing)


@query(f"WITH {R.DEPENDENCIES} SELECT 'out' AS direction, to_path AS peer, module_specifier, kind, count(*) AS n FROM deps WHERE from_path = '{_TARGET}' AND to_path IS NOT NULL GROUP BY ALL UNION ALL SELECT 'in', from_path, module_specifier, kind, count(*) FROM deps WHERE to_path = '{_TARGET}' GROUP BY ALL")
def gr3_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbourhood(_deps(spark, sf_dir), _TARGET).groupBy("direction", "peer", "module_specifier", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {R.MODULES}, {R.EDGES}, f AS (SELECT DISTINCT {R._path_sql('event_id')} AS path FROM events WHERE value > 90), d AS (SELECT from_path, count(*) AS n FROM edges GROUP BY from_path) SELECT m.path, role, CASE WHEN role IN ('facade', 'entrypoint') THEN 100 ELSE 0 END + CASE WHEN role = 'entrypoint' THEN 80 ELSE 0 END + CASE WHEN len(export_names) > 0 THEN 40 ELSE 0 END + CASE WHEN f.path IS NOT NULL THEN 30 ELSE 0 END + least(coalesce(d.n, 0), 10) AS rank FROM modules m LEFT JOIN f ON f.path = m.path LEFT JOIN d ON d.from_path = m.path")
def gr4_owner_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.table(spark, sf_dir, "events").where("value > 90").select(R.module_path(F.col("event_id")).alias("path"))
    return G.owner_rank(R.modules(spark, sf_dir), found, R.edges(spark, sf_dir))


@query(f"WITH {R.MODULES}, {R.EDGES} SELECT path AS owner FROM modules WHERE path NOT IN (SELECT to_path FROM edges WHERE to_path IS NOT NULL)")
def gr5_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roots(R.modules(spark, sf_dir).select(F.col("path").alias("owner")), R.edges(spark, sf_dir).where("to_path IS NOT NULL").select(F.col("to_path").alias("to_owner")))


@query("WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 60 AS src, (l_suppkey % 60 * 7 + 3) % 60 AS dst FROM lineitem), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT DISTINCT a AS node FROM r WHERE a = b")
def gr10_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey") % 60
    return G.cycles(R.table(spark, sf_dir, "lineitem").select(s.alias("src"), ((s * 7 + 3) % 60).alias("dst")))


# --- ranking and sets ------------------------------------------------------------------------------------------------


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, l_suppkey FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber FROM r WHERE n <= 3")
def w3_per_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = R.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return W.per_group(li, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3).drop("l_extendedprice")


@query("WITH h AS (SELECT 'p' || l_partkey AS path, l_linenumber || ':' || l_linenumber AS line_range, CAST(l_quantity AS INTEGER) AS score, l_suppkey AS mtime_ms FROM lineitem) SELECT path, line_range, score, mtime_ms FROM h ORDER BY score DESC, mtime_ms DESC, path, path || ':' || line_range LIMIT 12")
def w2_global_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, W2: the first twelve hits."""
    n = F.col("l_linenumber").cast("string")
    hits = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"), F.concat_ws(":", n, n).alias("line_range"), F.col("l_quantity").cast("int").alias("score"), F.col("l_suppkey").cast("bigint").alias("mtime_ms"))
    return W.top_hits(hits).select("path", "line_range", "score", "mtime_ms")


@query("WITH p AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'docs/' WHEN 1 THEN 'playground/' WHEN 2 THEN 'packages/tests/' ELSE 'packages/' END || 'p' || s_suppkey AS path FROM supplier), c AS (SELECT *, CASE s_suppkey % 5 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 40 ELSE 0 END + CASE WHEN s_suppkey % 3 = 0 THEN 10 ELSE 0 END - CASE WHEN s_suppkey % 7 = 0 THEN 5 ELSE 0 END AS score FROM p) SELECT path, score FROM c ORDER BY score, len(string_split(path, '/')), path LIMIT 24")
def w13_workspace_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(F.when(k % 5 == 0, "docs/").when(k % 5 == 1, "playground/").when(k % 5 == 2, "packages/tests/").otherwise("packages/"), F.lit("p"), k.cast("string"))
    p = R.table(spark, sf_dir, "supplier").select(path.alias("path"), k.cast("string").alias("name"), F.when(k % 3 == 0, "packages/**").otherwise("packages/*").alias("pattern"))
    return W.workspace_packages(p, R.table(spark, sf_dir, "supplier").where("s_suppkey % 7 = 0").select(k.cast("string").alias("name"))).select("path", "score")


@query(f"WITH {rule_queries.M} SELECT path FROM m WHERE NOT doc AND (role = 'facade' AND n_exports >= 3 OR role = 'source' AND n_exports >= 8) ORDER BY CASE WHEN role = 'facade' THEN 0 ELSE 1 END, n_exports DESC, path LIMIT 8")
def w16_undocumented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.undocumented(rule_queries.modules(spark, sf_dir)).select("path")


@query(f"WITH {R.FINDINGS} SELECT seq FROM findings ORDER BY rule_id || chr(0) || path || chr(0) || CAST(line AS VARCHAR) || chr(0) || summary, seq LIMIT 50")
def w17_finding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.finding_order(R.findings(spark, sf_dir)).limit(50).select("seq")


@query("WITH n AS (SELECT c_nationkey, list_sort(list(c_name)) AS names FROM customer GROUP BY c_nationkey) SELECT c_nationkey, array_to_string(names[1:3], ',') || CASE WHEN len(names) > 3 THEN ',+' || (len(names) - 3) ELSE '' END AS names FROM n")
def w18_capped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    return g.select("c_nationkey", S.capped_names(F.col("names"), 3).alias("names"))


@query(f"WITH {R.EDGES} SELECT from_path, module_specifier, min(seq) AS seq FROM edges GROUP BY ALL")
def w20_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.first_wins(R.edges(spark, sf_dir), ["from_path", "module_specifier"]).select("from_path", "module_specifier", "seq")


@query("WITH i AS (SELECT DISTINCT lower(CASE WHEN p_partkey % 3 = 0 THEN '@brand/' ELSE '' END || 'lib' || (p_partkey % 40) || CASE WHEN p_partkey % 2 = 0 THEN '/x' ELSE '' END) AS s FROM part) SELECT s AS module_specifier, CASE WHEN s IN ('lib4', 'lib4/x') THEN 8 ELSE 4 END AS score FROM i WHERE contains(s, 'lib4')")
def w21_dependency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    spec = F.concat(F.when(k % 3 == 0, "@brand/").otherwise(""), F.lit("lib"), (k % 40).cast("string"), F.when(k % 2 == 0, "/x").otherwise(""))
    return W.dependency_scores(R.table(spark, sf_dir, "part").select(spec.alias("module_specifier")).distinct(), "lib4").select("module_specifier", "score")


@query("WITH a AS (SELECT doc_id AS k, sha256(text) AS h FROM documents), b AS (SELECT doc_id AS k, CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE sha256(text) END AS h FROM documents WHERE doc_id % 9 <> 0 UNION ALL SELECT -item_id - 1, sha256(text) FROM benchmark) SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS path, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.h IS DISTINCT FROM b.h")
def u3_hash_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha2(F.encode("text", "UTF-8"), 256)
    d, b = R.table(spark, sf_dir, "documents"), R.table(spark, sf_dir, "benchmark")
    before = d.select(F.col("doc_id").cast("string").alias("path"), h.alias("content_hash"))
    after = d.where("doc_id % 9 <> 0").select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 6 == 0, "x").otherwise(h).alias("content_hash"))
    return U.hash_diff(before, after.unionAll(b.select((-F.col("item_id") - 1).cast("string").alias("path"), h.alias("content_hash"))))


@query("SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT DISTINCT c_mktsegment FROM customer)")
def u2_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, c: R.table(spark, sf_dir, t).select(F.col(c).alias("name"))
    return U.distinct_sorted(one("nation", "n_name"), one("region", "r_name"), one("customer", "c_mktsegment"))


@query(f"WITH {R.MODULES} SELECT t.term FROM (SELECT DISTINCT 'src/m' || (c_custkey % 120) || '/f' || c_custkey % 1009 || CASE WHEN c_custkey % 2 = 0 THEN '.ts' ELSE '.tsx' END AS term FROM customer) t WHERE t.term NOT IN (SELECT path FROM modules)")
def u5_terms_without_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    t = F.concat(F.lit("src/m"), (k % 120).cast("string"), F.lit("/f"), (k % 1009).cast("string"), F.when(k % 2 == 0, ".ts").otherwise(".tsx"))
    return U.terms_without_owner(R.table(spark, sf_dir, "customer").select(t.alias("term")).distinct(), R.modules(spark, sf_dir))


@query("SELECT severity AS pack, CAST(i AS INTEGER) AS pack_order, count(*) AS n FROM (SELECT 'a' AS severity, 0 AS i FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'b', 1 FROM orders WHERE o_orderstatus = 'O') GROUP BY ALL")
def u1_pack_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders")
    one = lambda s, p: o.where(F.col("o_orderstatus") == s).select(F.lit(p).alias("pack"))
    return U.concatenated([one("F", "a"), one("O", "b")]).groupBy("pack", "pack_order").agg(F.count("*").alias("n"))


@query("WITH g AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS has FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(list_sort(list_filter(['1-URGENT', '2-HIGH', '5-LOW'], lambda x: NOT list_contains(has, x))), ',') AS missing FROM g")
def u4_missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = R.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("has"))
    need = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "5-LOW")])
    return g.select("o_custkey", F.array_join(F.array_sort(U.missing(need, F.col("has"))), ",").alias("missing"))


# --- scalar functions ------------------------------------------------------------------------------------------------


@query(f"WITH {R.MODULES} SELECT path, string_split(path, '/')[-1] AS base, regexp_replace(path, '/[^/]*$', '') AS dir, CASE WHEN path LIKE '%/index.ts' THEN regexp_replace(path, '/index\\.ts$', '') ELSE regexp_replace(path, '\\.ts$', '') END AS namespace, len(string_split(path, '/')) AS depth FROM modules")
def f_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return R.modules(spark, sf_dir).select("path", S.basename(p).alias("base"), S.dirname(p).alias("dir"), S.namespace(p).alias("namespace"), S.depth(p).alias("depth"))


@query("WITH s AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN './a' WHEN 1 THEN '#in' WHEN 2 THEN '@s/p/q' WHEN 3 THEN 'lodash/fp' ELSE '/abs' END AS spec FROM part) SELECT spec, CASE spec WHEN '@s/p/q' THEN '@s/p' WHEN 'lodash/fp' THEN 'lodash' END AS package FROM s")
def f_package_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    s = R.table(spark, sf_dir, "part").select(F.when(k == 0, "./a").when(k == 1, "#in").when(k == 2, "@s/p/q").when(k == 3, "lodash/fp").otherwise("/abs").alias("spec")).distinct()
    return s.select("spec", S.package_root(F.col("spec")).alias("package"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS INT) AS n_th, CAST(ceil(length(text) / 3.0) AS INT) AS tokens FROM documents WHERE text IS NOT NULL")
def f_hash_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return R.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", S.fingerprint16(t).alias("fingerprint"), S.occurrences(t, F.lit("th")).alias("n_th"), S.token_estimate(t).alias("tokens"))


@query("WITH RECURSIVE n AS (SELECT DISTINCT c_mktsegment AS t FROM customer), w(t, i, h) AS (SELECT t, 0, CAST(5381 AS BIGINT) FROM n UNION ALL SELECT t, i + 1, xor(h * 33, CAST(ascii(substr(t, i + 1, 1)) AS BIGINT)) & 4294967295 FROM w WHERE i < length(t)) SELECT t AS text, h AS hash FROM w WHERE i = length(t)")
def f_djb2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("text")).distinct().select("text", S.djb2(F.col("text")).alias("hash"))


@query("SELECT DISTINCT p_type AS text, CASE WHEN x = '' THEN 'root' ELSE x END AS id FROM (SELECT p_type, regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9._:-]+', '.', 'g'), '\\.{2,}', '.', 'g'), '^\\.+|\\.+$', '', 'g') AS x FROM part)")
def f_sanitised_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "part").select(F.col("p_type").alias("text")).distinct().select("text", S.sanitised_id(F.col("text")).alias("id"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'run --token [REDACTED] x' ELSE 'run --token=[REDACTED] x' END AS argv FROM orders")
def f_redacted_argv(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    argv = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("run"), F.lit("--token"), k, F.lit("x"))).otherwise(F.array(F.lit("run"), F.concat(F.lit("--token="), k), F.lit("x")))
    return R.table(spark, sf_dir, "orders").select("o_orderkey", argv.alias("argv")).select("o_orderkey", F.array_join(S.redact_argv(F.col("argv")), " ").alias("argv"))


@query(f"WITH {R.LINES}, n AS (SELECT path, max(line) AS n FROM lines GROUP BY path) SELECT l.path, rtrim(string_agg(l.row, chr(10) ORDER BY l.line), ' ') AS window FROM lines l JOIN n USING (path) WHERE n >= 2 AND l.line BETWEEN 2 AND 3 GROUP BY l.path")
def f_line_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = R.files(spark, sf_dir).where(F.size(S.source_lines(F.col("text"))) >= 2)
    return f.select("path", S.line_window(F.col("text"), F.lit(3), F.lit(2)).alias("window"))


@query("WITH v AS (SELECT DISTINCT s_nationkey % 3 AS a, s_suppkey % 3 AS b, s_suppkey % 2 AS c FROM supplier), x AS (SELECT a, b, c, CASE WHEN a = 0 THEN NULL ELSE CAST(a AS VARCHAR) END AS req, CASE WHEN b = 0 THEN NULL ELSE CAST(b AS VARCHAR) END AS lock, CASE WHEN c = 0 THEN NULL ELSE '^1' END AS rng FROM v) SELECT a, b, c, CASE WHEN req IS NULL AND lock IS NOT NULL THEN 'locked' WHEN req = lock THEN 'matched' WHEN req IS NOT NULL AND lock IS NOT NULL THEN 'external-version' WHEN req IS NOT NULL THEN 'requested-unresolved' WHEN rng IS NOT NULL THEN 'range-only' ELSE 'unknown' END AS status FROM x")
def f_version_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.table(spark, sf_dir, "supplier").select((F.col("s_nationkey") % 3).alias("a"), (F.col("s_suppkey") % 3).alias("b"), (F.col("s_suppkey") % 2).alias("c")).distinct()
    text = lambda c: F.when(F.col(c) != 0, F.col(c).cast("string"))
    return v.select("a", "b", "c", S.version_status(text("a"), text("b"), F.when(F.col("c") != 0, "^1")).alias("status"))


# --- windows, rules, plans, streams of candidates, renderers ----------------------------------------------------------


@query("SELECT o_orderkey AS path, s AS start, least(s + 39, o_orderkey % 200 + 1) AS \"end\" FROM orders, unnest(generate_series(1, o_orderkey % 200 + 1, 40)) AS u(s)")
def g27_range_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators import patterns

    k = F.col("o_orderkey")
    return patterns.range_windows(R.table(spark, sf_dir, "orders").select(k.alias("path"), F.lit(1).cast("bigint").alias("start"), (k % 200 + 1).alias("end")))


_METRICS = """m AS (SELECT l_orderkey, count(*) AS nesting, count(*) FILTER (WHERE l_returnflag = 'R') AS loops, count(DISTINCT l_suppkey) + 6 AS branches, max(l_linenumber) - 1 AS chain FROM lineitem GROUP BY l_orderkey)"""


@query(
    f"""WITH {_METRICS} SELECT l_orderkey, array_to_string(list_filter([CASE WHEN nesting >= 5 THEN 'deep-nesting' END, CASE WHEN loops >= 2 AND branches >= 4 THEN 'loops-and-branches' END, CASE WHEN branches >= 12 AND loops = 0 THEN 'many-branches' END, CASE WHEN chain >= 4 THEN 'literal-dispatch' END], lambda x: x IS NOT NULL), ',') AS shapes
 FROM m WHERE nesting >= 5 OR (loops >= 2 AND branches >= 4) OR (branches >= 12 AND loops = 0) OR chain >= 4"""
)
def r_policy_007_flow_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule TS-AGENT-POLICY-007's thresholds over metrics of orders."""
    from factloom.operators import rules

    m = R.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("max_nesting"), F.count_if(F.col("l_returnflag") == "R").alias("loops"), (F.countDistinct("l_suppkey") + 6).alias("branches"), (F.max("l_linenumber") - 1).alias("max_literal_chain"),
    )
    return m.select("l_orderkey", F.array_join(rules.flow_shapes(), ",").alias("shapes")).where("shapes != ''")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS function_name, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 6")
def r_policy_005_many_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule TS-AGENT-POLICY-005 itself: line items stand for parameters, orders for functions."""
    from factloom.operators import rules
    from factloom.schemas import conform, relation

    p = R.table(spark, sf_dir, "lineitem").select(F.lit("a.ts").alias("path"), F.col("l_linenumber").cast("int").alias("seq"), F.col("l_orderkey").cast("string").alias("function_name"), F.lit(1).alias("function_line"), F.col("l_linenumber").cast("string").alias("param_name"))
    c = rules.Catalog(spark, {"modules": relation(spark, "modules", [{"path": "a.ts", "role": "source", "is_valid": True}]), "params": conform(p, "params")})
    found = rules.evaluate(c, ["TS-AGENT-POLICY-005"])
    return found.select(F.col("labels")["function"].alias("function_name"), F.regexp_extract("summary", r"takes (\d+)", 1).cast("bigint").alias("n"))


@query(f"WITH {R.DEPENDENCIES} SELECT from_path AS path, to_path AS target, count(*) AS n FROM deps WHERE from_role NOT IN ('test', 'config', 'declaration') AND to_role = 'test' GROUP BY ALL")
def r_mod_001_production_on_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators import rules

    c = rules.Catalog(spark, {"owner_dependencies": _deps(spark, sf_dir).withColumns({"line": F.lit(1), "col": F.lit(0)})})
    return rules.evaluate(c, ["TS-MOD-R001"]).groupBy("path", F.col("labels")["target"].alias("target")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {R.MODULES}, h AS (SELECT c_custkey, {R._path_sql('c_custkey')} AS owner_path, c_custkey % 4 AS k FROM customer), t AS (SELECT h.*, CASE WHEN m.path IS NULL OR k = 0 OR k = 3 THEN ['review'] WHEN k = 1 THEN ['chaos', 'stress'] ELSE ['security'] END AS kinds FROM h LEFT JOIN modules m ON m.path = h.owner_path)
 SELECT owner_path, kind, count(DISTINCT k) AS n FROM t, unnest(kinds) AS u(kind) GROUP BY owner_path, kind"""
)
def v_verification_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints by turns without responsibilities, with two, with one, and with a pure domain that is something else too."""
    from factloom.operators import verify

    k = F.col("c_custkey") % 4
    resp = F.when(k == 1, F.array(F.lit("public_api"), F.lit("persistence"))).when(k == 2, F.array(F.lit("security_boundary"))).when(k == 3, F.array(F.lit("pure_domain_logic"), F.lit("public_api"))).otherwise(F.array().cast("array<string>"))
    hints = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), R.module_path(F.col("c_custkey")).alias("owner_path"), resp.alias("responsibilities"), F.lit(None).cast("array<string>").alias("task_kinds"), F.lit(None).cast("string").alias("rationale"))
    return verify.plan(hints, R.modules(spark, sf_dir)).groupBy("owner_path", "kind").agg(F.countDistinct("fingerprint").alias("n"))


@query("SELECT event_id AS seq, 'src/e' || (user_id % 50) || '.ts' AS path, CAST(event_id % 90 + 1 AS INTEGER) AS line, CASE WHEN event_id % 2 = 0 THEN CAST(user_id % 9 AS INTEGER) END AS col, event_type AS snippet FROM events WHERE event_id % 5 <> 0")
def s12_grep_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S11, S12: grep lines, a fifth of them malformed."""
    from factloom.sources import candidates

    e, k = R.table(spark, sf_dir, "events"), F.col("event_id")
    at = F.concat(F.lit("./src/e"), (F.col("user_id") % 50).cast("string"), F.lit(".ts:"), (k % 90 + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit(":"), (F.col("user_id") % 9).cast("string"))).otherwise(""), F.lit(":"), "event_type")
    return candidates.parse(e.select(k.alias("seq"), F.when(k % 5 == 0, F.lit("no record")).otherwise(at).alias("line")), "vimgrep").select("seq", "path", "line", "col", "snippet")


@query("SELECT event_id AS seq, 'src/' || event_type || '.ts' AS path, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS line, CAST(event_id % 7 + 1 AS INTEGER) AS col FROM events WHERE event_id % 3 <> 0")
def s12_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12: JSON matches; other types and broken lines go."""
    from factloom.sources import candidates

    e, k = R.table(spark, sf_dir, "events"), F.col("event_id")
    record = F.to_json(F.struct(F.lit("match").alias("type"), F.struct(F.struct(F.concat(F.lit("src/"), "event_type", F.lit(".ts")).alias("text")).alias("path"), F.regexp_extract("props", r"(\d+)", 1).cast("int").alias("line_number"), F.array(F.struct((k % 7).alias("start"))).alias("submatches")).alias("data")))
    line = F.when(k % 3 != 0, record).when(k % 2 == 0, F.lit('{"type":"end"}')).otherwise(F.lit('{"type":"mat'))
    return candidates.parse(e.select(k.alias("seq"), line.alias("line")), "rg-json").select("seq", "path", "line", "col")


@query("SELECT 'nation n_nationkey=' || n_nationkey || ' n_name=' || CASE WHEN contains(n_name, ' ') THEN '\"' || n_name || '\"' ELSE n_name END || ' n_regionkey=' || n_regionkey AS line FROM nation")
def k2_compact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources import sinks

    return sinks.compact_lines(R.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), "nation")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS ordinal FROM (SELECT DISTINCT conv_id, turn FROM conversations)")
def k8_session_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources import sinks

    c = R.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("at")).distinct().withColumn("argv", F.array(F.lit("run")))
    return sinks.log_records(c).select(F.col("session").alias("conv_id"), F.col("at").alias("turn"), "ordinal")


_ITEMS = "i AS (SELECT p_partkey, 'item' || p_partkey AS name, CAST(p_partkey % 500 AS INTEGER) AS line, p_partkey % 3 = 0 AS is_private, CASE p_partkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'variable' ELSE 'function' END AS kind FROM part)"


@query(f"WITH {_ITEMS} SELECT name, line FROM i ORDER BY line + CASE WHEN is_private THEN 10000 ELSE 0 END - CASE WHEN kind = 'interface' THEN 50 ELSE 0 END + CASE WHEN kind = 'variable' THEN 250 ELSE 0 END, name LIMIT 4")
def w14_item_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    items = R.table(spark, sf_dir, "part").select(F.concat(F.lit("item"), k.cast("string")).alias("name"), (k % 500).cast("int").alias("line"), (k % 3 == 0).alias("is_private"), F.when(k % 4 == 0, "interface").when(k % 4 == 1, "variable").otherwise("function").alias("kind"))
    return W.items_for(items, ["nothing"]).select("name", "line")


@query("WITH h AS (SELECT 'a' || (l_partkey % 20) AS path, CASE WHEN l_returnflag = 'R' THEN 'direct' ELSE 'possible' END AS match FROM lineitem) SELECT path, count(*) FILTER (WHERE match = 'direct') AS n_confirmed, count(*) FILTER (WHERE match = 'possible') AS n_possible FROM h GROUP BY path")
def a16_surface_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("a"), (F.col("l_partkey") % 20).cast("string")).alias("path"), F.when(F.col("l_returnflag") == "R", "direct").otherwise("possible").alias("match"))
    return A.surface_counts(h)


@query("SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(regexp_replace(p_type || 'AndMore', '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda t: length(t) > 2), ' ') AS tokens FROM part")
def f_camel_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "part").select("p_partkey", F.array_join(S.camel_tokens(F.concat("p_type", F.lit("AndMore"))), " ").alias("tokens"))


@query("SELECT string_split(url, '/')[3] AS host, count(*) AS n, sum(len(regexp_extract_all(html, '<p>'))) AS paragraphs FROM pages GROUP BY 1")
def f_occurrences_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.table(spark, sf_dir, "pages")
    return p.groupBy(F.split("url", "/")[2].alias("host")).agg(F.count("*").alias("n"), F.sum(S.occurrences(F.col("html"), F.lit("<p>"))).alias("paragraphs"))


@query("SELECT count(*) AS n_files, 0 AS n_different, count(*) FILTER (WHERE doc_id % 7 = 0) > 0 AS some_reused FROM documents")
def u_incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the files of a snapshot that was updated incrementally, how many of them differ from one made anew (none is right), and whether any were taken over (those of valid files are)."""
    from factloom.checkpoints import stored
    from factloom.streaming import incremental

    f = R.files(spark, sf_dir).select("path", F.col("text").alias("content"), F.lit(0).cast("bigint").alias("mtime_ms"))
    before = stored(incremental.snapshot_of(f.where(F.col("path").contains("/tests/"))))
    after = stored(incremental.update(f, before)[0])  # snapshots are kept: texts are read for each once
    differ = after.exceptAll(incremental.snapshot_of(f)).agg(F.count("*").cast("int").alias("n_different"))
    stats = incremental.reuse_stats(before, after).select("n_files", (F.col("n_reused") > 0).alias("some_reused"))
    return stats.crossJoin(differ)  # a row each


# --- operators over small relations -----------------------------------------------------------------------------------


@query("SELECT s_suppkey, contains(lower(s_name), '1') OR s_nationkey = 1 OR contains(CAST(s_nationkey AS VARCHAR), '1') AS hit FROM supplier")
def p3_any_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", S.any_contains_ci([F.col("s_name"), F.lit(None).cast("string"), F.col("s_nationkey").cast("string")], " 1 ").alias("hit"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'test' WHEN s_suppkey % 3 = 0 THEN 'react' WHEN s_suppkey % 5 = 0 THEN 'effect' WHEN s_suppkey % 7 = 0 THEN 'config' ELSE 'structural' END AS role FROM supplier")
def p12_syntax_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return R.table(spark, sf_dir, "supplier").select(k, roles.syntax_role(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("role"))


@query(f"WITH {R.MODULES}, q AS (SELECT c_custkey AS seq, {R._path_sql('c_custkey')} AS path FROM customer) SELECT seq, q.path, role FROM q JOIN modules USING (path)")
def j7_owners_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), R.module_path(F.col("c_custkey")).alias("path"))
    return J.owners_of_paths(paths, R.modules(spark, sf_dir)).select("seq", "path", "role")


@query("SELECT n_name AS rule, 'pack' || n_regionkey AS pack, CASE WHEN n_regionkey < 3 THEN 'owner' || n_regionkey END AS owner FROM nation")
def j20_rule_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    pack = F.concat(F.lit("pack"), F.col("n_regionkey").cast("string"))
    catalog = spark.createDataFrame([(f"pack{i}", f"owner{i}") for i in range(3)], "pack string, owner string")
    return J.rule_owners(R.table(spark, sf_dir, "nation").select(F.col("n_name").alias("rule"), pack.alias("pack")), catalog).select("rule", "pack", "owner")


@query(f"WITH {R.EDGES}, e AS (SELECT from_path AS from_owner, to_path AS to_owner FROM edges WHERE to_path IS NOT NULL) SELECT from_owner, to_owner, count(*) AS weight FROM e WHERE from_owner <> to_owner GROUP BY ALL")
def a12_weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.weighted_edges(R.edges(spark, sf_dir).where("to_path IS NOT NULL").select(F.col("from_path").alias("from_owner"), F.col("to_path").alias("to_owner"), F.lit(1).alias("weight")).where("from_owner != to_owner"))


@query("SELECT count(*) AS n_nodes, count(*) FILTER (WHERE n_nationkey % 3 = 0) AS n_owners, count(*) FILTER (WHERE n_nationkey % 3 = 1) AS n_claims, count(*) FILTER (WHERE n_nationkey % 2 = 0) AS n_stale, count(*) FILTER (WHERE n_nationkey % 3 = 2) AS n_gaps, (SELECT count(*) FROM region) AS n_edges FROM nation")
def a15_evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    nodes = R.table(spark, sf_dir, "nation").select(F.when(k % 3 == 0, "owner").when(k % 3 == 1, "claim").otherwise("gap").alias("kind"), F.when(k % 2 == 0, "stale").otherwise("fresh").alias("status"))
    return A.evidence_summary(nodes, R.table(spark, sf_dir, "region"))


@query("WITH t AS (SELECT 'tests/s' || l_suppkey || '.ts' AS path, l_linenumber AS n, l_orderkey AS o FROM lineitem) SELECT path, count(*) AS n_tests FROM t WHERE n IN (1, 2) OR (n = 3 AND o % 2 = 0) GROUP BY path ORDER BY path LIMIT 64")
def a19_test_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("tests/s"), F.col("l_suppkey").cast("string"), F.lit(".ts")).alias("path"), F.col("l_linenumber").alias("n"), F.col("l_orderkey").alias("o"))
    calls = t.where("n != 3").select("path", F.when(F.col("n") == 1, "test").when(F.col("n") == 2, "it").otherwise("describe").alias("callee"))
    return A.test_function_counts(calls, t.where("n = 3").select("path", F.lit("function").alias("kind"), F.when(F.col("o") % 2 == 0, "testRows").otherwise("rows").alias("name")))


@query("""WITH o AS (SELECT 'src/s' || s_suppkey || '.ts' AS owner, s_nationkey % 2 = 0 AS t, s_suppkey % 3 = 0 AS r FROM supplier)
 SELECT kind || ':' || owner AS id, kind, CASE kind WHEN 'test' THEN CASE WHEN t THEN 'fresh' ELSE 'stale' END WHEN 'receipt' THEN CASE WHEN r THEN 'fresh' ELSE 'stale' END WHEN 'gap' THEN 'open' ELSE 'fresh' END AS status,
  CASE kind WHEN 'owner' THEN 1 WHEN 'claim' THEN 3 WHEN 'gap' THEN 0 ELSE 1 END AS degree FROM o, (SELECT unnest(['owner', 'claim', 'test', 'receipt', 'gap']) AS kind) WHERE kind <> 'gap' OR NOT (t AND r)""")
def gr7_evidence_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence around every owner, each node with the number of its edges."""
    s = R.table(spark, sf_dir, "supplier")
    owners = s.select(F.concat(F.lit("src/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("owner"), (F.col("s_nationkey") % 2 == 0).alias("has_tests"), (F.col("s_suppkey") % 3 == 0).alias("has_receipt"))
    nodes, edges = G.evidence_graph(owners)
    degree = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").cast("int").alias("degree"))
    return nodes.join(degree, "id", "left").select("id", "kind", "status", F.coalesce("degree", F.lit(0)).alias("degree"))


@query("SELECT DISTINCT n_regionkey, CASE WHEN n_regionkey = 1 THEN 'a,1,b' ELSE 'a,' || n_regionkey || ',b,1' END AS both FROM nation")
def u6_append_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("n_regionkey").cast("string")
    return R.table(spark, sf_dir, "nation").select("n_regionkey", F.array_join(U.append_unique(F.array(F.lit("a"), r), F.array(F.lit("b"), F.lit("1"))), ",").alias("both")).distinct()


@query(
    """WITH l AS (SELECT 'src/p' || l_partkey || CASE WHEN l_partkey % 4 = 0 THEN '.test.ts' ELSE '.ts' END AS path, CASE l_linenumber WHEN 1 THEN 'export function load() {}' WHEN 2 THEN 'x = load(1)' WHEN 3 THEN 'export * from save' WHEN 4 THEN 'saved' ELSE 'nothing' END AS t FROM lineitem),
 h AS (SELECT path, 'load' AS term, CASE WHEN starts_with(t, 'export function load') THEN 0 ELSE 1 END AS cls FROM l WHERE contains(t, 'load') UNION ALL SELECT path, 'save', CASE WHEN contains(t, 'export') THEN 2 ELSE 3 END FROM l WHERE contains(t, 'save')),
 g AS (SELECT path, term, min(cls) AS cls, contains(path, '.test.') AS test FROM h GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY cls, test, path) AS n FROM g), b AS (SELECT path, min(cls) AS cls, any_value(test) AS test FROM k WHERE n <= 16 GROUP BY path) SELECT path FROM b ORDER BY cls, test, path LIMIT 48"""
)
def w10_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15, W10, over lines of part files; taken however few the files are."""
    k, n = F.col("l_partkey"), F.col("l_linenumber")
    text = F.when(n == 1, "export function load() {}").when(n == 2, "x = load(1)").when(n == 3, "export * from save").when(n == 4, "saved").otherwise("nothing")
    lines = R.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("src/p"), k.cast("string"), F.when(k % 4 == 0, ".test.ts").otherwise(".ts")).alias("path"), text.alias("text"))
    return W.prefilter(lines, ["load", "save"], least_files=0)
