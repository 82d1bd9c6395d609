import random

import pytest
from pyspark.sql import functions as F

from factloom.streaming import findings as C

SCHEMA = "path string, rule_id string, n long"


def state(rng, n, edges_of):
    return {f"m{k}": rng.randint(0, 2) for k in range(n)}, {f"m{k}": [f"m{rng.randrange(n)}" for _ in range(edges_of)] for k in range(n)}


class Project:
    """Modules with a number each; a module's finding is the sum over all that it reaches."""

    def __init__(self, spark, value, out):
        self.spark, self.value, self.out, self.seen = spark, value, out, []

    def frames(self):
        modules = [(m, f"{v}:{sorted(self.out[m])}") for m, v in self.value.items()]
        edges = [(m, t) for m in self.value for t in self.out[m]]
        return self.spark.createDataFrame(modules, "path string, content_hash string"), self.spark.createDataFrame(edges, "from_path string, to_path string")

    def total(self, m):
        seen, todo = {m}, [m]
        while todo:
            for t in self.out.get(todo.pop(), ()):
                if t in self.value and t not in seen:
                    seen.add(t)
                    todo.append(t)
        return sum(self.value[x] for x in seen)

    def evaluate(self, todo):
        paths = [r.path for r in todo.collect()]
        self.seen.append(len(paths))
        return self.spark.createDataFrame([(p, "R", self.total(p)) for p in paths if self.total(p)], SCHEMA)

    def full(self):
        return sorted((m, "R", self.total(m)) for m in self.value if self.total(m))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_full_run_after_changes(spark, tmp_path, seed):
    rng = random.Random(seed)
    value, out = state(rng, 60, 1)
    p = Project(spark, value, out)
    first = C.update(*p.frames(), p.evaluate, str(tmp_path), SCHEMA, buckets=32)
    assert first["evaluated"] == 60
    for turn in range(3):
        for m in rng.sample(sorted(p.value), 2):
            p.value[m] = rng.randint(3, 9)
        gone = rng.choice(sorted(p.value))
        del p.value[gone], p.out[gone]
        p.value[f"new{turn}"], p.out[f"new{turn}"] = 5, ["m1"]
        p.out[rng.choice([m for m in p.value])] = [f"new{turn}"]
        r = C.update(*p.frames(), p.evaluate, str(tmp_path), SCHEMA, buckets=32)
        assert sorted(map(tuple, C.findings(spark, str(tmp_path), SCHEMA).select("path", "rule_id", "n").collect())) == p.full()
        assert r["modules"] == len(p.value) and p.seen[-1] == r["evaluated"] < 60
    assert C.update(*p.frames(), p.evaluate, str(tmp_path), SCHEMA, buckets=32)["evaluated"] == 0


def test_untouched_buckets_are_not_written(spark, tmp_path):
    p = Project(spark, {f"m{k}": 1 for k in range(40)}, {f"m{k}": [] for k in range(40)} | {"m1": ["m0"]})
    C.update(*p.frames(), p.evaluate, str(tmp_path), SCHEMA, buckets=64)
    before = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    p.value["m0"] = 7
    r = C.update(*p.frames(), p.evaluate, str(tmp_path), SCHEMA, buckets=64)
    after = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*.parquet")}
    assert r["evaluated"] == 2 and r["buckets"] <= 2
    kept = {f.parent.name for f in before if after.get(f) == before[f]}
    assert len({f.parent.name for f in before}) - len(kept) <= 2
    assert sorted(map(tuple, C.findings(spark, str(tmp_path), SCHEMA).select("path", "rule_id", "n").collect())) == p.full()


def test_affected_is_the_closure_over_reversed_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("f", None)], "from_path string, to_path string")
    assert {r.path for r in C.affected(spark.createDataFrame([("c",)], "path string"), edges).collect()} == {"a", "b", "c"}
