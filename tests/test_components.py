import random

import pytest

from factloom.operators import components as C
from factloom.operators import graph as G


def closure(edges):
    nodes = {n for e in edges for n in e}
    out = {n: set() for n in nodes}
    for a, b in edges:
        out[a].add(b)
    reach = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        reach[n] = seen
    return reach


def plain(edges):
    r = closure(edges)
    return {n: min([n, *(m for m in r[n] if n in r[m])]) for n in r}


def frame(spark, edges):
    return spark.createDataFrame(edges, "src int, dst int")


def labels(df):
    rows = df.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


@pytest.mark.parametrize("seed", range(6))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([5, 12, 40, 120])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.8, 1.1, 1.6])))]
    assert labels(C.strong_components(frame(spark, edges))) == plain(edges)
    assert {r.node for r in C.on_cycles(frame(spark, edges)).collect()} == {n for n, r in closure(edges).items() if n in r}


def test_a_long_ring_with_tails(spark):
    edges = [(k, (k + 1) % 1000) for k in range(1000)] + [(5000 + k, 5001 + k) for k in range(200)] + [(17, 3000), (3000, 3001), (3001, 17), (3001, 4000), (4000, 4001)]
    got = labels(C.strong_components(frame(spark, edges)))
    assert all(got[k] == 0 for k in [*range(1000), 3000, 3001])
    assert all(got[k] == k for k in [4000, 4001, *range(5000, 5201)])


def test_a_hub(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, 0) for k in range(1, 1500)] + [(k, k) for k in range(2990, 2995)]
    got = labels(C.strong_components(frame(spark, edges)))
    assert all(got[k] == (0 if k < 1500 else k) for k in range(3000))
    assert {r.node for r in C.on_cycles(frame(spark, edges)).collect()} == {*range(1500), *range(2990, 2995)}


def test_empty_and_null_ends(spark):
    assert labels(C.strong_components(frame(spark, []))) == {}
    assert labels(C.strong_components(frame(spark, [(1, None), (None, 2), (3, 3)]))) == {3: 3}
    assert labels(C.strong_components(spark.createDataFrame([("b", "a"), ("a", "b"), ("b", "a")], "src string, dst string"))) == {"a": "a", "b": "a"}


@pytest.mark.parametrize("seed", range(4))
def test_reached_is_the_search(spark, seed):
    rng = random.Random(seed + 20)
    n = rng.choice([10, 60])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * 1.2))]
    roots = spark.createDataFrame([(k,) for k in rng.sample(range(n), 3)], "node int")
    got = [r.node for r in C.reached(frame(spark, edges), roots).collect()]
    assert sorted(got) == sorted(r.node for r in G.reachable(frame(spark, edges), roots).collect())


def test_reached_over_a_long_chain_and_past_a_lost_ring(spark):
    edges = [(k, k + 1) for k in range(500)] + [(900, 901), (901, 902), (902, 900), (902, 903)] + [(500, 600), (250, 600), (600, 601)]
    got = {r.node for r in C.reached(frame(spark, edges), spark.createDataFrame([(0,)], "node int")).collect()}
    assert got == {*range(501), 600, 601}
