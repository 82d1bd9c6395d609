import json

import pytest
from pyspark.sql import functions as F

from factloom.__main__ import main
from factloom.operators.search import packet_hashes
from factloom.plans import project


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    r = tmp_path_factory.mktemp("tree")
    texts = {
        "package.json": json.dumps({"name": "demo", "workspaces": []}), "tsconfig.json": "{}", "src/store.ts": "export function saveStore(path: string) { return read(path); }\n", "src/index.ts": 'export * from "./store";\n', "pnpm-workspace.yaml": "packages:\n  - packages/*\n",
        "packages/a/package.json": '{"name": "a"}', "packages/a/src/x.ts": "export const x = 1;\n", "node_modules/z/index.ts": "export const z = 1;\n", "skipped/y.ts": "export const y = 1;\n",
    }
    for p, t in texts.items():
        (r / p).parent.mkdir(parents=True, exist_ok=True)
        (r / p).write_text(t)
    return str(r)


def test_usage_is_exit_code_2(spark, root, capsys):
    for args in ([], ["burn"], ["search"], ["search", "nothing", "--root", root], ["search", "lexical", "x"], ["flow", "scope.fn=a", "--root", root]):
        assert main(args, spark) == 2
    assert main(["views"]) == 0
    assert "lexical" in capsys.readouterr().out


def test_search_and_check(spark, root, capsys, tmp_path):
    assert main(["search", "lexical", "saveStore", "--root", root], spark) == 0
    assert main(["search", "lexical", "saveStore", "--root", root, "--pipe", "tests"], spark) == 0
    assert "path=src/store.ts" in capsys.readouterr().out
    assert main(["search", "lexical", "--query-set", "saveStore,index", "--root", root, "--json", f"{tmp_path}/out"], spark) == 0
    assert spark.read.json(f"{tmp_path}/out/hits").count() > 0
    assert main(["check", root], spark) in (0, 1)


def test_plans_file(spark, root, capsys, tmp_path):
    good = {"id": "functions", "catalog": "declarations", "kinds": ["function"]}
    (tmp_path / "plans").write_text(json.dumps(good) + "\n")
    assert main(["plans", f"{tmp_path}/plans", "--root", root], spark) == 0
    assert "name=saveStore" in capsys.readouterr().out
    (tmp_path / "bad").write_text(json.dumps(good) + "\n{\n")
    assert main(["plans", f"{tmp_path}/bad", "--root", root], spark) == 2
    assert "not JSON" in capsys.readouterr().out


def test_scopes_workspaces_and_discovery(spark):
    files = spark.createDataFrame([(p, "export const x = 1;\n", 0) for p in ("src/a.ts", "packages/a/src/x.ts", "packages/a/deep/b.ts", "skipped/y.ts", ".kept/z.ts")], "path string, content string, mtime_ms long")
    documents = spark.createDataFrame([("packages/a/package.json", '{"name": "a"}'), ("packages/a/deep/package.json", "{}"), ("pnpm-workspace.yaml", "packages:\n  - packages/*\n"), ("conf/disc.toml", "x"), ("disc.toml", "y")], "path string, content string")
    discovery = '[discovery]\nignoredDirNames = ["skipped"]\nincludeHiddenDirNames = [".kept"]\n'
    c = project.build(files, "{}", "{}", documents=documents, discovery=discovery)
    assert {r.path: r.scope for r in c["file_scopes"].collect()} == {"src/a.ts": "", "packages/a/src/x.ts": "packages/a", "packages/a/deep/b.ts": "packages/a/deep", ".kept/z.ts": ""}
    assert [(r.path, r.name) for r in c["workspace_packages"].select("path", "name").collect()] == [("packages/a", "a")]
    assert project.nearest_configuration(documents, "conf/sub", "disc.toml") == "x" and project.nearest_configuration(documents, "other", "disc.toml") == "y" and project.nearest_configuration(documents, "conf", "none") is None


def test_hashes_of_a_packet(spark):
    files = spark.createDataFrame([("a.ts", "A"), ("b.ts", "B"), ("c.ts", "C")], "path string, content string")
    packet = {"hits": spark.createDataFrame([("a.ts",), ("gone.ts",)], "path string"), "edges": spark.createDataFrame([("a.ts", None)], "from_path string, to_path string"), "n": spark.range(1)}
    got = {r.path: r.sha256 for r in packet_hashes(packet, files, more=("c.ts",)).collect()}
    assert sorted(got) == ["a.ts", "c.ts"] and got["a.ts"] == files.where("path = 'a.ts'").select(F.sha2(F.encode("content", "UTF-8"), 256).alias("h")).first().h
