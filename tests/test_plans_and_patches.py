import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import graph as G
from factloom.operators import patterns as P
from factloom.operators.rules import exit_code
from factloom.streaming import incremental

ROWS = "path string, capture string, kind string, name string, line int, line_end int, container string"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(f"src/{rng.choice('ab')}/f{rng.randint(0, 3)}.ts", "declaration", rng.choice(["function", "class", "type"]), rng.choice(["loadA", "loadB", "save", "x"]), (k := rng.randint(1, 90)), k + rng.randint(0, 9), rng.choice([None, "save", "Outer"])) for _ in range(400)]
    return spark.createDataFrame(data, ROWS)


GOOD = {
    "all": {"catalog": "declarations"},
    "kinds": {"catalog": "declarations", "kinds": ["class", "type"], "captures": ["declaration"]},
    "match": {"catalog": "declarations", "predicates": [{"op": "match", "capture": "name", "values": ["^load"]}]},
    "other": {"catalog": "declarations", "predicates": [{"op": "eq", "capture": "name", "values": [{"capture": "container"}]}]},
    "not": {"catalog": "declarations", "predicates": [{"op": "not-eq", "capture": "name", "values": ["x", "save"]}], "terms": ["outer"]},
    "range": {"catalog": "declarations", "selector": "src/a:10:20"},
    "compiled": {"catalog": "declarations", "expression": "(class)", "compiled": True, "kinds": ["class"]},
}
BAD = {
    "json": "{", "list": "[]", "null": None, "catalog": {"catalog": "nothing"}, "field": {"catalog": "calls", "stray": 1}, "inline": {"catalog": "declarations", "expression": "(class)"}, "op": {"catalog": "calls", "predicates": [{"op": "near", "capture": "name", "values": ["a"]}]},
    "capture": {"catalog": "calls", "predicates": [{"op": "eq", "capture": "nope", "values": ["a"]}]}, "values": {"catalog": "calls", "predicates": [{"op": "eq", "capture": "name", "values": []}]}, "pattern": {"catalog": "calls", "predicates": [{"op": "match", "capture": "name", "values": ["("]}]},
    "kinds": {"catalog": "calls", "kinds": "class"}, "selector": {"catalog": "calls", "selector": ""},
}


def table(spark, plans):
    return spark.createDataFrame([(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in plans.items()], "plan string, text string")


def test_many_plans_are_the_same_plans_one_by_one(spark, rows):
    hits, errors = P.run_plans(table(spark, GOOD), {"declarations": rows})
    assert errors.count() == 0 and exit_code(spark.createDataFrame([], "seq long, severity string, rule_id string"), errors) == 0
    got = sorted(map(repr, hits.select("plan", *rows.columns).collect()))
    wanted = []
    for name in GOOD:
        one, _ = P.run_plans(table(spark, {name: GOOD[name]}), {"declarations": rows})
        wanted += list(map(repr, one.select("plan", *rows.columns).collect()))
        plan, captures = P.parse_plan(json.dumps(GOOD[name]))
        assert one.count() == rows.where(P.plan_column(plan, captures)).count() > 0
    assert got == sorted(wanted)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1


def test_malformed_plans_become_error_rows(spark, rows):
    hits, errors = P.run_plans(table(spark, BAD | {"good": GOOD["all"]}), {"declarations": rows})
    assert {r.plan for r in errors.collect()} == set(BAD)
    assert {r.plan for r in hits.select("plan").distinct().collect()} == {"good"}
    assert exit_code(spark.createDataFrame([], "seq long, severity string, rule_id string"), errors) == 2
    assert P.run_plans(table(spark, {"json": "{"}), {})[0].count() == 0


def test_receipts_of_many_edits(spark):
    files = spark.createDataFrame([("a.ts", "one\ntwo two\nthree\nfour"), ("b.ts", "")], "path string, content string")
    edits = [
        (1, "a.ts", "replace", 1, 1, "one", 1), (2, "a.ts", "replace", 2, 2, "two", 1), (3, "a.ts", "burn", 4, 4, "four", 1), (4, "c.ts", "replace", 1, 1, "x", 1), (5, "b.ts", "insert_after", 5, 5, "x", 1), (6, "a.ts", "insert_before", 3, 3, "zzz", 1),
        (7, "b.ts", "replace", 1, 1, "", 0), (8, "b.ts", "replace", 0, 0, "x", 1),
    ]
    got = {r.edit: (r.status, r.reason) for r in P.patch_receipts(files, spark.createDataFrame(edits, "edit int, path string, operation string, start int, end int, expected string, most int")).collect()}
    assert got == {1: ("ready", None), 2: ("rejected", "too many matches"), 3: ("rejected", "unknown operation"), 4: ("rejected", "no such file"), 5: ("rejected", "the range isn't in the file"), 6: ("rejected", "expected text isn't in the range"), 7: ("rejected", "expected text isn't in the range"), 8: ("rejected", "the range isn't in the file")}


def test_edits_that_share_lines_are_found(spark):
    rng = random.Random(3)
    edits = [(k, f"f{rng.randint(0, 5)}.ts", "replace", (s := rng.randint(1, 60)), s + rng.choice([0, 0, 1, 30]), "x", 100) for k in range(60)]
    files = spark.createDataFrame([(f"f{k}.ts", "x\n" * 100) for k in range(6)], "path string, content string")
    got = {r.edit: r.reason for r in P.patch_receipts(files, spark.createDataFrame(edits, "edit int, path string, operation string, start int, end int, expected string, most int")).collect()}
    wanted = {a[0]: "shares lines with another edit" if any(a[0] != b[0] and a[1] == b[1] and a[3] <= b[4] and b[3] <= a[4] for b in edits) else None for a in edits}
    assert got == wanted


def test_atoms_are_reused_up_to_the_first_change(spark):
    rng = random.Random(4)
    schema = "context string, pos int, cache_class string, fingerprint string, tokens int"
    before = [(f"c{c}", k, rng.choice(incremental.CACHE_CLASSES), str(rng.randint(0, 1)), rng.randint(1, 9)) for c in range(12) for k in range(rng.randint(1, 8))]
    after = [(c, k, x, f if rng.random() < 0.8 else "new", t) for c, k, x, f, t in before if c != "c1"] + [("c2", 99, "tail", "z", 3), ("new", 0, "stable", "a", 2)]
    got = {r.context: r for r in incremental.atom_reuse(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema)).collect()}
    was = {(c, k): f for c, k, _, f, _ in before}
    for c in {a[0] for a in after}:
        ok, n, reused, tokens, first = True, 0, 0, 0, None
        classes = {}
        for _, k, x, f, t in sorted(a for a in after if a[0] == c):
            if ok and was.get((c, k)) != f:
                ok, first = False, k
            n, reused, tokens = n + 1, reused + ok, tokens + t * ok
            a, b = classes.get(x, (0, 0))
            classes[x] = (a + t, b + t * ok)
        r = got.pop(c)
        assert (r.n_atoms, r.n_reused, r.tokens_reused, r.first_change) == (n, reused, tokens, first)
        assert {x.cache_class: (x.tokens, x.reused) for x in r.tokens_by_class} == classes
    assert not got
    places = incremental.partition_atoms(spark.createDataFrame(after, schema)).where("context = 'c3'").orderBy("place").collect()
    assert [incremental.CACHE_CLASSES.index(r.cache_class) for r in places] == sorted(incremental.CACHE_CLASSES.index(r.cache_class) for r in places)


def test_rank_agrees_with_a_dense_solution(spark):
    rng = random.Random(6)
    n, d = 30, 0.85
    edges = [(rng.randrange(n), rng.randrange(n - 4), rng.choice(["calls", "owns", "none"])) for _ in range(70)]
    weights = {"calls": 2.0, "owns": 0.5}
    seeds = [1, 2]
    got = {r.node: r.p for r in G.personalised_rank(spark.createDataFrame(edges, "src int, dst int, relation string"), spark.createDataFrame([(s,) for s in seeds], "node int"), weights).collect()}
    nodes = sorted({*seeds, *(x for e in edges for x in e[:2])})
    at = {v: i for i, v in enumerate(nodes)}
    m, s = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for v in seeds:
        s[at[v]] = 1 / len(seeds)
    for a, b, r in edges:
        m[at[b], at[a]] += weights.get(r, 1.0)
    for i in range(len(nodes)):
        m[:, i] = m[:, i] / m[:, i].sum() if m[:, i].sum() else s
    x = np.linalg.solve(np.eye(len(nodes)) - d * m, (1 - d) * s)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got.get(v, 0.0) - x[at[v]]) < 1e-6 for v in nodes)


def test_diverse_choice_is_greedy(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice("abc"), rng.random()) for k in range(40)]
    got = [r.node for r in G.diverse(spark.createDataFrame(rows, "node int, kind string, p double")).orderBy("place").collect()]
    chosen, seen = [], {"a": 0, "b": 0, "c": 0}
    for _ in range(8):
        best = max((r for r in rows if r[0] not in chosen), key=lambda r: (r[2] * 0.5 ** seen[r[1]], -r[0]))
        chosen.append(best[0])
        seen[best[1]] += 1
    assert got == chosen
