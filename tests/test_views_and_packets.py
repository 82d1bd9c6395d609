import json

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import patterns as P
from factloom.plans import view_queries
from factloom.sources import sinks


@pytest.mark.parametrize("name", sorted(view_queries.FIXED))
def test_views_of_fixed_lists(spark, sf_dir, name):
    plan, sql = view_queries.FIXED[name]
    same(plan(spark, sf_dir), connect(sf_dir), sql)


def test_packets_of_any_length(spark, tmp_path, monkeypatch):
    packet = {"hits": spark.range(30), "owners": spark.range(2).select(F.lit("a").alias("path"))}
    assert len(json.loads(sinks.packet_json(packet, "x"))["hits"]) == 30
    sinks.write_packet(packet, f"{tmp_path}/p")
    assert spark.read.json(f"{tmp_path}/p/hits").count() == 30 and spark.read.json(f"{tmp_path}/p/owners").count() == 2
    monkeypatch.setattr(sinks, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="write_packet"):
        sinks.packet_json(packet, "x")


def test_flow_terms():
    assert P.parse_flow("scope.fn=main source.call=read sink.constructs=Store") == {"scope.fn": "main", "source.call": "read", "sink.constructs": "Store"}
    for text, why in (("scope.fn=a source.call=b", "sink.constructs is missing"), ("scope.fn=a scope.fn=b", "given twice"), ("scope.fn= x", "needs a value"), ("where=a", "unknown term"), ("", "missing")):
        with pytest.raises(P.BadPlan, match=why):
            P.parse_flow(text)


def test_flow_query(spark):
    functions = spark.createDataFrame([("a.ts", "main", 3), ("b.ts", "main", 1)], "path string, name string, line int")
    calls = spark.createDataFrame([("a.ts", "main", "io.read", 4), ("a.ts", "main", "new.Store", 6), ("b.ts", "main", "read", 2)], "path string, owner string, callee string, line int")
    r = P.flow_query("source.call=read sink.constructs=Store scope.fn=main", functions, calls).first()
    assert (r.path, r.source_line, r.sink_line, r.bounded) == ("a.ts", 4, 6, True)


def test_read_plan_is_the_plain_join(spark):
    import random

    rng = random.Random(2)
    items = [(f"f{rng.randint(0, 2)}", (a := rng.randint(1, 300)), a + rng.choice([0, 5, 39, 40, 200])) for _ in range(120)]
    ranges = [(f"f{k}", (a := rng.randint(1, 200)), a + rng.choice([3, 39, 60, 150])) for k in range(3) for _ in range(4)] + [("none", 1, 100)]
    got = sorted(map(tuple, P.read_plan(spark.createDataFrame(ranges, "path string, start int, end int"), spark.createDataFrame(items, "path string, line int, line_end int")).collect()))
    wanted = []
    for p, s, e in ranges:
        if e - s + 1 <= 40:
            wanted.append((p, s, e, "direct"))
            continue
        inner = [(p, max(a, s), min(b, e), "frontier") for q, a, b in items if q == p and b - a < 40 and a <= e and b >= s]
        wanted += inner or [(p, x, min(x + 39, e), "frontier") for x in range(s, e + 1, 40)]
    assert got == sorted(wanted)


def test_constants_in_json(spark):
    df = spark.createDataFrame([('{"a": {"b": "x"}}',), ('{"a": {"b": 1}}',), ('{"a": ["b"]}',), ("{",), (None,), ('{"a": {"b": null}}',), ('["a"]',)], "t string")
    assert [r.c for r in df.select(S.const_at(F.col("t"), ["a", "b"]).alias("c")).collect()] == ["x", None, None, None, None, None, None]
