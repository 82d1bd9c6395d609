"""Queries of strongly connected components and of reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import components as C
from factloom.plans import analogues as R
from factloom.plans.registry import query

_URGENT = """e AS (SELECT DISTINCT o_custkey AS src, (o_custkey * 7 + o_orderkey * 13) % 1500 AS dst FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _urgent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = R.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return o.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") * 13) % 1500).alias("dst"))


@query(f"""WITH RECURSIVE {_URGENT}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b)
 SELECT n.node, least(n.node, coalesce(min(x.b), n.node)) AS component FROM n LEFT JOIN (SELECT r.a, r.b FROM r JOIN r AS back ON back.a = r.b AND back.b = r.a) x ON x.a = n.node GROUP BY n.node""")
def gr10_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's component over the edges that urgent orders make between customers."""
    return C.strong_components(_urgent(spark, sf_dir))


@query(f"""WITH RECURSIVE {_URGENT}, r(node) AS (SELECT c_custkey FROM customer WHERE c_acctbal > 9000 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node) SELECT node FROM r""")
def gr1_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the customers of high balance reach over the same edges, without a limit of depth."""
    return C.reached(_urgent(spark, sf_dir), R.table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("node")))
