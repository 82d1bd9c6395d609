import pytest
from oracle import connect

from factloom.operators import graph as G
from factloom.plans import analogues as R
from factloom.plans import catalog


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


SHAPES = {"chain": [("a", "b"), ("b", "c")], "diamond": [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "cycle": [("a", "b"), ("b", "c"), ("c", "a")], "loop": [("a", "a"), ("a", "b")]}


def depths(pairs, root):
    seen, front, d = {root: 0}, [root], 0
    while front:
        d += 1
        front = [y for x, y in pairs if x in front and y not in seen]
        seen |= {y: d for y in front}
    return seen


@pytest.mark.parametrize("shape", SHAPES)
def test_reachable(spark, shape):
    got = {r.node: r.depth for r in G.reachable(edges(spark, SHAPES[shape]), spark.createDataFrame([("a",)], "node string")).collect()}
    assert got == depths(SHAPES[shape], "a")


def test_reachable_sql_agrees(spark):
    e, r = edges(spark, SHAPES["cycle"]), spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, G.reachable_sql(e, r, 8).collect())) == sorted(map(tuple, G.reachable(e, r, 8).collect()))


def test_depth_limit(spark):
    pairs = [(f"n{i}", f"n{i + 1}", "source") for i in range(12)]
    d = spark.createDataFrame(pairs, "from_path string, to_path string, from_role string")
    got = {r.node: r.depth for r in G.depth_to_target(d, "n12").collect()}
    assert got == {f"n{12 - i}": i + 1 for i in range(8)}


def test_orphans(spark):
    modules = spark.createDataFrame([("index.ts", "facade"), ("a.ts", "source"), ("b.ts", "source")], "path string, role string")
    deps = spark.createDataFrame([("index.ts", "a.ts", False)], "from_path string, to_path string, is_test_context boolean")
    visible = spark.createDataFrame([], "resolution string, to_path string")
    assert [r.path for r in G.orphans(modules, deps, visible).collect()] == ["b.ts"]
    assert G.orphans(modules.where("role = 'source'"), deps, visible).count() == 0  # no roots: nothing


def test_cycles(spark):
    e = edges(spark, [*SHAPES["cycle"], ("x", "a"), ("c", "y")])
    assert sorted(r.node for r in G.cycles(e).collect()) == ["a", "b", "c"]


def test_personalised_rank_sums_to_one_without_sinks(spark):
    r = G.personalised_rank(edges(spark, SHAPES["cycle"]), spark.createDataFrame([("a",)], "node string"), tolerance=1e-7)
    got = {x.node: x.p for x in r.collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert got["a"] > got["c"]


def test_flow_lite(spark):
    f = spark.createDataFrame([("a.ts", "load", 1)], "path string, name string, line int")
    c = spark.createDataFrame([("a.ts", "load", "req.query", 2), ("a.ts", "load", "new Db", 3)], "path string, owner string, callee string, line int")
    r = G.flow_lite(f, c, "load", "query", "Db").first()
    assert (r.source_line, r.sink_line, r.bounded) == (2, 3, True)


def plain_dependencies(sf_dir):
    """All dependencies of the tables (from, to, from_role, is_test_context), and the modules' roles, without Spark."""
    con = connect(sf_dir)
    deps = con.execute(f"WITH {R.DEPENDENCIES} SELECT DISTINCT from_path, to_path, from_role, is_test_context FROM deps WHERE to_path IS NOT NULL").fetchall()
    return deps, dict(con.execute(f"WITH {R.MODULES} SELECT path, role FROM modules").fetchall())


def test_orphans_query_follows_every_edge(spark, sf_dir):
    deps, role = plain_dependencies(sf_dir)
    inside = {p for p, r in role.items() if r in ("source", "facade", "entrypoint")}
    seen = {p for p in inside if role[p] != "source"}
    front = seen
    while front:
        front = {b for a, b, _, test in deps if not test and a in front and b in inside} - seen
        seen = seen | front
    assert sorted(r.path for r in catalog.gr1_orphans(spark, sf_dir).collect()) == sorted(p for p in inside - seen if role[p] == "source")


def test_bounded_depth_query_goes_to_eight(spark, sf_dir, monkeypatch):
    deps, _ = plain_dependencies(sf_dir)
    into = [(b, a) for a, b, role, _ in deps if role != "test"]
    target = max({b for b, _ in into}, key=lambda t: (max(depths(into, t).values()), t))  # in this table the query's own target may have few
    monkeypatch.setattr(catalog, "_TARGET", target)
    want = {n: d + 1 for n, d in depths(into, target).items() if d < 8}
    assert max(want.values()) > 3
    assert {r.node: r.depth for r in catalog.gr2_bounded_depth(spark, sf_dir).collect()} == want


def test_tests_of_several_owners_are_those_of_each(spark):
    pairs = [("src/b", "src/a", "source", False), ("src/c", "src/b", "source", False), ("src/d", "src/c", "source", False), ("src/a", "src/d", "source", False)]
    pairs += [("tests/x", "src/a", "test", True), ("tests/y", "src/c", "test", True), ("tests/y", "src/e", "test", True), ("tests/src/b.test", "src/e", "test", True), ("tests/x", "src/a", "test", True), ("tests/z", None, "test", True)]
    rows = [(i, a, b, f"../{b}", role, ctx) for i, (a, b, role, ctx) in enumerate(pairs)]
    d = spark.createDataFrame(rows, "seq long, from_path string, to_path string, module_specifier string, from_role string, is_test_context boolean")
    targets, names = ["src/a", "src/b", "src/e", "src/none"], ["seq", "test_path", "source_path", "reason", "score", "depth"]
    got = sorted(map(tuple, G.tests_for_owners(d, targets).select("target", *names).collect()), key=repr)
    assert got == sorted(((t, *r) for t in targets for r in G.tests_for_owner(d, t, t, 1000).select(*names).collect()), key=repr)
    assert len(got) > 6 and G.tests_for_owners(d, []).count() == 0


def test_policy_says_what_responsibilities_ask_for(spark):
    from pyspark.sql import functions as F

    from factloom.operators import verify

    df = spark.createDataFrame([(["public_api", "persistence"],), ([],), (None,)], "r array<string>")
    policy = {"public_api": ["regression", "security"], "pure_domain_logic": ["responsibility_review"]}
    assert [x[0] for x in df.select(verify.task_kinds(F.col("r"), policy=policy)).collect()] == [["chaos", "regression", "security"], [], []]
