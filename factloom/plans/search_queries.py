"""Queries of the search index and of the query set in one scan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import shared_folder
from factloom.operators import ranking as W
from factloom.operators import search_index as I
from factloom.plans import analogues as R
from factloom.plans.registry import query

NEEDLES = ("Apache", "copyright notice", "th", "zzzqqq")


def _index(spark: SparkSession, sf_dir: str) -> str:
    """An index of an older state of the files, brought up to date: every fifth text was another one, every seventh file is new, every ninth old one is gone."""
    files = R.files(spark, sf_dir)
    k = F.col("doc_id")
    before = files.where(k % 7 != 0).withColumn("text", F.when(k % 5 == 0, F.concat(F.lit("apache\n"), "text")).otherwise(F.col("text")))
    gone = files.where(k % 9 == 0).withColumns({"path": F.concat(F.lit("old/"), "path")})
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    I.build(before.unionByName(gone).select("path", "text"), path, buckets=16)
    I.refresh(files.select("path", "text"), path, buckets=16)
    return path


def _sql(needle: str) -> str:
    return f"""SELECT '{needle}' AS needle, path, line, CASE WHEN contains(row, '{needle}') THEN 2 ELSE 1 END AS score, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM lines WHERE contains(lower(row), lower('{needle}'))"""


@query(f"WITH {R.LINES}, m AS ({' UNION ALL '.join(map(_sql, NEEDLES))}) SELECT needle, path, line, score FROM m WHERE n <= 3")
def s15_indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact searches through the index, one of them too short for it, give the rows of a full scan."""
    path = _index(spark, sf_dir)
    found = None
    for needle in NEEDLES:
        rows = I.indexed_lines(spark, path, needle).select(F.lit(needle).alias("needle"), "path", "line", "score")
        found = rows if found is None else found.unionAll(rows)
    return found


@query(f"""WITH {R.FILES}, low AS (SELECT path, lower(text) AS t FROM files WHERE text IS NOT NULL), q AS (SELECT unnest(['apache', 'copyright notice']) AS needle),
 g AS (SELECT DISTINCT needle, substr(needle, CAST(i AS INT), 3) AS gram FROM q, unnest(range(1, length(needle) - 1)) AS u(i)),
 n AS (SELECT needle, gram, (SELECT count(*) FROM low WHERE contains(t, gram)) AS n FROM g), rare AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY n, gram) AS k FROM n) WHERE k <= 3),
 c AS (SELECT needle, path FROM rare JOIN low ON contains(t, gram) GROUP BY needle, path HAVING count(*) = 3)
 SELECT q.needle, count(c.path) AS n_candidates, count(c.path) FILTER (WHERE contains(low.t, q.needle)) AS n_holding FROM q LEFT JOIN c USING (needle) LEFT JOIN low USING (path) GROUP BY q.needle""")
def s15_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts remain after the rarest grams' lists have met, and how many of these hold the needle: all texts that do."""
    path = _index(spark, sf_dir)
    found = None
    for needle in ("apache", "copyright notice"):
        texts = I.texts_for(spark, path, needle)
        row = texts.agg(F.count("*").alias("n_candidates"), F.count(F.when(F.contains(F.lower("text"), F.lit(needle)), 1)).alias("n_holding")).select(F.lit(needle).alias("needle"), "n_candidates", "n_holding")
        found = row if found is None else found.unionAll(row)
    return found


@query(f"""WITH {R.HITS}, spec AS (SELECT term, len(list_distinct(string_split(term, ''))) + length(term) AS spec FROM terms),
 placed AS (SELECT h.*, row_number() OVER (ORDER BY h.seq, s.spec DESC, h.term) AS place FROM hits h JOIN spec s USING (term))
 SELECT owner_path, line_range, arg_min(score, place) AS score, arg_min(snippet, place) AS snippet, string_agg(term, ',' ORDER BY term) AS terms FROM placed GROUP BY owner_path, line_range ORDER BY min(place) LIMIT 12""")
def w4_one_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set's line hits, of all terms from one scan, merged depth by depth."""
    merged = W.query_set_lines(R.files(spark, sf_dir).select("path", "text"), list(R.TERMS), fuzzy=False)
    return merged.select("owner_path", "line_range", "score", "snippet", F.array_join("terms", ",").alias("terms"))
