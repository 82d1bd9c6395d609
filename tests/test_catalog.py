import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import connect, same

import __spark_entry__ as entry
from factloom.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    same(df, con, catalog.ORACLE_SQL[name])


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(catalog.ORACLE_SQL) == set(catalog.QUERIES)


def test_cycles_query_reads_all_lines(spark, tmp_path):
    rows = [(k + 4, x) for k, x in enumerate((31, 40, 43, 4))]  # 31 -> 40 -> 43 -> 4 -> 31
    spark.createDataFrame(rows, "l_linenumber int, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.node for r in catalog.gr10_cycles(spark, str(tmp_path)).collect()) == [4, 31, 40, 43]


def test_coverage_query_reads_the_modules(spark, sf_dir, monkeypatch):
    m = spark.createDataFrame([("src/license/apache.ts", "source", ["x"])], "path string, role string, export_names array<string>")
    monkeypatch.setattr(catalog.R, "modules", lambda *_: m)
    assert "src/license/apache.ts" in {r.owner_path for r in catalog.w6_coverage_hits(spark, sf_dir).collect()}


def test_first_match_takes_the_first_row_of_equal_lines(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    for name, n, copies in (("a", 1.0, 1), ("b", 2.0, 200)):  # Spark reads the larger file first
        keys = list(range(400)) * copies
        pq.write_table(pa.table({"l_orderkey": keys, "l_linenumber": pa.array([1] * len(keys), pa.int32()), "l_quantity": [n + i for i in range(len(keys))]}), tmp_path / "lineitem.parquet" / f"{name}.parquet")
    spark.range(400).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.o_orderkey: r.branches for r in catalog.j10_first_match(spark, str(tmp_path)).collect()} == {k: 1.0 + k for k in range(400)}


def test_first_match_takes_rows_without_a_line_last(spark, tmp_path):
    spark.createDataFrame([(1, None, 1.0), (1, 2, 2.0), (2, None, 3.0)], "l_orderkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 4).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.o_orderkey: r.branches for r in catalog.j10_first_match(spark, str(tmp_path)).collect()} == {1: 2.0, 2: 3.0, 3: None}
