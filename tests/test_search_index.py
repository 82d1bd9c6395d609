import random
from itertools import accumulate

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.operators import ranking as W
from factloom.operators import search_index as I

WORDS = ["Apache", "license", "loader", "été", "🙂🙂", "a\nb", "x", "THE", "über", "\r\n", "storeKey"]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(2)
    rows = [(f"src/f{k}.ts", " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12)))) for k in range(300)]
    return spark.createDataFrame([*rows, ("src/none.ts", None), ("src/ab.ts", "ab")], "path string, text string")


def lines(df):
    return sorted(map(tuple, df.select("path", "line", "score", "column", "snippet").collect()))


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    I.build(files, path, buckets=8)
    return path


@pytest.mark.parametrize("needle", ["apache", "Apache", "e l", "été", "🙂", "🙂🙂 ", "th", "a", "", "b", "nothing here", "ab", "storekey x"])
def test_same_rows_as_a_full_scan(spark, files, index, needle):
    assert lines(I.indexed_lines(spark, index, needle)) == lines(W.lexical_lines(files, needle, fuzzy=False))


def test_candidates_hold_the_grams_and_few_texts_are_read(spark, files, index):
    held = files.where(F.contains(F.lower("text"), F.lit("storekey"))).count()
    assert held <= I.candidates(spark, index, "storeKey").count() < 150
    assert I.texts_for(spark, index, "zzzz").count() == 0
    assert I.candidates(spark, index, "zz") is None and I.texts_for(spark, index, "zz").count() == 301


def test_refresh_rewrites_changed_buckets_only(spark, files, tmp_path):
    path = str(tmp_path)
    old = files.where("path <> 'src/f7.ts'").withColumn("text", F.when(F.col("path") == "src/f9.ts", "before apache").otherwise(F.col("text")))
    I.build(old.union(spark.createDataFrame([("src/gone.ts", "apache gone")], files.schema)), path, buckets=64)
    todo = I.refresh(files, path, buckets=64)
    assert 1 <= len(todo) <= 3
    assert lines(I.indexed_lines(spark, path, "apache")) == lines(W.lexical_lines(files, "apache", fuzzy=False))
    assert I.refresh(files, path, buckets=64) == []
    one = files.where("path = 'src/f9.ts'")
    assert len(I.refresh(one, path, buckets=64)) > 20
    assert [r.path for r in I.texts_for(spark, path, "ab").select("path").collect()] == ["src/f9.ts"]


def test_line_hits_are_those_of_each_term(spark, files):
    for fuzzy in (True, False):
        terms = ["Apache", "lcns", "THE", " ", "store"]
        got = sorted(map(tuple, W.line_hits(files, terms, fuzzy).select("term", "path", "line", "score", "column", "snippet").collect()))
        wanted = sorted((t, *r) for t in terms if t.strip() for r in lines(W.lexical_lines(files, t, fuzzy)))
        assert got == wanted
    hits = W.line_hits(files, ["Apache", "license"], False).collect()
    by_line = {}
    for r in hits:
        by_line.setdefault((r.path, r.line), set()).add(r.term)
    assert all(set(r.terms) == by_line[r.path, r.line] and r.terms == sorted(r.terms) for r in hits)


def test_query_set_is_one_scan_without_a_window_over_a_term(spark, files, tmp_path):
    files.write.parquet(f"{tmp_path}/files")
    df = W.query_set_lines(spark.read.parquet(f"{tmp_path}/files"), ["apache", "license", "the"], False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert plan.count("WindowGroupLimit") >= 2 and "Partial" in plan


@pytest.mark.parametrize("query", ["apc", "Apache", "", " ", "\t", "a^]-b", "é🙂", "t n e", "x.*"])
def test_literal_fuzzy_match_is_the_fold(spark, query):
    rng = random.Random(9)
    rows = [("".join(rng.choice("apch eé🙂^]-b.*xtnT\t") for _ in range(rng.randint(0, 40))),) for _ in range(300)] + [(None,), ("a" * 3000 + "p",), ("A p\tc",)]
    df = spark.createDataFrame(rows, "v string")
    fold, chain = S.fuzzy_match(F.col("v"), F.lit(query)), S.fuzzy_match_of(F.lower("v"), query)
    assert [r.a for r in df.select(fold.alias("a")).collect()] == [r.a for r in df.select(chain.alias("a")).collect()]


@pytest.mark.parametrize("fuzzy", [True, False])
def test_texts_are_split_once_and_not_for_each_line(spark, files, tmp_path, fuzzy):
    files.write.parquet(f"{tmp_path}/files")
    df = W.line_hits(spark.read.parquet(f"{tmp_path}/files"), ["apache"], fuzzy)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2  # the text, and the text in small letters
    assert not any("split(" in x for x in plan.split("\n") if x.strip(" +-:").startswith("Filter"))
    assert "transform(arrays_zip(split(" in plan


def test_a_bucket_is_shared_by_tasks_and_finds_the_same(spark, files, tmp_path):
    path = str(tmp_path)
    I.build(files, path, buckets=1)
    lists = I._table(spark, path, "postings").where("gram = 'apa'").collect()
    assert len(lists) > 4 and sum(r.n for r in lists) == files.where(F.contains(F.lower("text"), F.lit("apa"))).count()
    for needle in ("apache", "🙂🙂 ü", "storekey x"):
        assert lines(I.indexed_lines(spark, path, needle)) == lines(W.lexical_lines(files, needle, fuzzy=False))


def test_lists_of_blocks_are_those_of_all_texts(monkeypatch):
    rng = random.Random(4)
    texts = [(b, b % 2, k, "".join(rng.choice("abé🙂\n") for _ in range(rng.randint(0, 9)))) for b in range(2) for k in range(0, 80, 2)]
    monkeypatch.setattr(I, "BLOCK", 20)
    batches = [pa.RecordBatch.from_pylist([dict(zip(("bucket", "share", "id", "low"), x, strict=True)) for x in texts[at : at + 7]]) for at in range(0, len(texts), 7)]
    got, rows = {}, [r for b in I._lists(iter(batches)) for r in b.to_pylist()]
    for r in rows:
        got.setdefault((r["bucket"], r["gram"]), []).extend(accumulate(r["gaps"]))
        assert len(r["gaps"]) == r["n"]
    wanted = {}
    for bucket, _, k, low in texts:
        for g in I.grams(low):
            wanted.setdefault((bucket, g), []).append(k)
    assert got == wanted and len({(r["bucket"], r["start"]) for r in rows}) > 4
