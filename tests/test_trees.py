import random

from pyspark.sql import functions as F

from factloom.operators import sets as U
from factloom.operators import trees as T


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content_hash string")


def random_tree(rng, n):
    return {"/".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) + f"/f{rng.randint(0, 5)}.ts": str(rng.randint(0, 3)) for _ in range(n)}


def clean(tree):
    return {k.lstrip("/"): v for k, v in tree.items()}


def above(path):
    parts = path.split("/")
    return ["/".join(parts[:k]) for k in range(len(parts))]


def plain_diff(b, a):
    dirs = lambda t: {d for p in t for d in above(p)}
    under = lambda t, d: {p: h for p, h in t.items() if d in above(p)}
    old, new, out = dirs(b), dirs(a), set()
    two_sided = lambda d: d in old and d in new
    for d in old | new:
        parent = above(d)[-1] if d else None
        if two_sided(d):
            if under(b, d) != under(a, d):
                out.add((d, True, "changed"))
        elif parent is None or two_sided(parent):
            out.add((d, True, "added" if d in new else "removed"))
    for p in b.keys() | a.keys():
        if b.get(p) != a.get(p) and two_sided(above(p)[-1]):
            out.add((p, False, "added" if p not in b else "removed" if p not in a else "changed"))
    return out


def test_random_trees(spark):
    rng = random.Random(1)
    for _ in range(4):
        b = clean(random_tree(rng, 60))
        a = {p: (h if rng.random() < 0.9 else "x") for p, h in b.items() if rng.random() < 0.9 and not p.startswith("a/b")} | clean(random_tree(rng, 5))
        left, right = T.tree_entries(frame(spark, list(b.items()))), T.tree_entries(frame(spark, list(a.items())))
        rows = T.tree_diff(left, right).collect()
        assert {(r.path, r.is_directory, r.change) for r in rows} == plain_diff(b, a) and len(rows) == len(plain_diff(b, a))
        # on the files it agrees with the plain difference, whole directories opened
        files = {(r.path, r.change) for r in U.hash_diff(frame(spark, list(b.items())), frame(spark, list(a.items()))).collect()}
        told = {(r.path, r.change) for r in rows if not r.is_directory}
        for r in rows:
            if r.is_directory and r.change != "changed":
                side = a if r.change == "added" else b
                told |= {(p, r.change) for p in side if p.startswith(r.path + "/") or r.path == ""}
        assert told == files


def test_digests_follow_content_and_places(spark):
    one = T.tree_entries(frame(spark, [("a/x.ts", "1"), ("b/x.ts", "1"), ("a/note.md", "9"), (None, "2")]))
    d = {r.path: r.digest for r in one.where("is_directory").collect()}
    assert d["a"] == d["b"] and d[""] != d["a"]
    assert {r.path: r.n_files for r in one.where("is_directory").collect()} == {"": 2, "a": 1, "b": 1}
    assert T.tree_diff(one, one).count() == 0
    assert T.tree_entries(frame(spark, [])).count() == 0


def test_nearest_on_random_trees(spark):
    rng = random.Random(5)
    paths = list(clean(random_tree(rng, 200)))
    places = {"", "a", "a/b", "c/c/a", "b/a"}
    for held in (places, places - {""}, set()):
        got = {r.path: r.place for r in T.nearest(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame([(p,) for p in held], "place string")).collect()}
        assert got == {p: max((d for d in above(p) if d in held), key=len, default=None) for p in paths}
