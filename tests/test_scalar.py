import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import roles
from factloom.functions import scalar as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def fuzzy(candidate: str, query: str):
    q, text = query.strip().lower(), candidate.lower()
    if not q:
        return None
    if q in text:
        return 12 + len(q), text.index(q) + 1
    at, places = 0, []
    for c in "".join(q.split()):
        i = text.find(c, at)
        if i < 0:
            return None
        places.append(i)
        at = i + 1
    span, n = places[-1] - places[0] + 1, len(places)
    return None if span > max(3 * len(q), len(q) + 12) else (4 + max(0, 2 * n - (span - n)), places[0] + 1)


CASES = [("parseConfig", "config"), ("pXaYrZs", "pars"), ("a" + "x" * 40 + "b", "ab"), ("read the file", "rd fl"), ("abc", ""), ("", "a"), ("ABC", "abc"), ("Größe", "öß")]


@pytest.mark.parametrize(("candidate", "query"), CASES)
def test_fuzzy_match(spark, candidate, query):
    got = one(spark, S.fuzzy_match(F.lit(candidate), F.lit(query)))
    assert (None if got is None else tuple(got)) == fuzzy(candidate, query)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abc D", max_size=12), st.text("abcd ", max_size=4)), min_size=1, max_size=30))
def test_fuzzy_match_as_in_plain_python(spark, rows):
    got = spark.createDataFrame(rows, "c string, q string").select(S.fuzzy_match(F.col("c"), F.col("q")).alias("m")).collect()
    assert [None if r.m is None else tuple(r.m) for r in got] == [fuzzy(c, q) for c, q in rows]


@pytest.mark.parametrize(("path", "want"), [("src/a/index.ts", "src/a"), ("index.ts", "."), ("src/a.b.ts", "src/a.b"), ("x.ts", "x")])
def test_namespace(spark, path, want):
    assert one(spark, S.namespace(F.lit(path))) == want


@pytest.mark.parametrize(("spec", "want"), [("@s/p/q", "@s/p"), ("lodash/fp", "lodash"), ("./a", None), ("#x", None), ("/a", None), ("a", "a")])
def test_package_root(spark, spec, want):
    assert one(spark, S.package_root(F.lit(spec))) == want


def test_common_ancestor(spark):
    assert one(spark, S.common_ancestor(F.array(F.lit("src/a/b.ts"), F.lit("src/a/c/d.ts"), F.lit("src/a/x.ts")))) == "src/a"


def test_djb2_and_redaction(spark):
    h = 5381
    for c in "hello":
        h = (h * 33 ^ ord(c)) & 0xFFFFFFFF
    assert one(spark, S.djb2(F.lit("hello"))) == h
    argv = F.array(*[F.lit(x) for x in ("run", "--token", "s3cret", "--api-key=k", "x")])
    assert one(spark, S.redact_argv(argv)) == ["run", "--token", "[REDACTED]", "--api-key=[REDACTED]", "x"]


def test_line_window(spark):
    text = F.lit("a\r\nb\nc  \n")
    assert one(spark, S.line_window(text, F.lit(3), F.lit(2))) == "b\nc"
    assert one(spark, S.line_window(text, F.lit(1), F.lit(99))).startswith("a\nb")
    with pytest.raises(Exception, match="past the end"):
        one(spark, S.line_window(F.lit("a"), F.lit(5), F.lit(6)))


@pytest.mark.parametrize(("kind", "want"), [("string[]", "array"), ("Readonly<Map<string, A>>", "map"), ("readonly string[]", "array"), ("[a, b]", "tuple"), ("Set<A>", "set"), ("Record<string, A>", "record"), ("Foo", None)])
def test_collection_kind(spark, kind, want):
    assert one(spark, S.collection_kind(F.lit(kind))) == want


@pytest.mark.parametrize(("text", "want"), [("never", "none"), ("DbError | unknown", "weak"), ("DbError | NetError", "domain")])
def test_error_channel(spark, text, want):
    assert one(spark, S.error_channel(F.lit(text))) == want


def test_type_labels(spark):
    assert one(spark, S.primitive_type(F.lit("string | number"))) == "number | string"
    assert one(spark, S.primitive_type(F.lit("string | Foo"))) is None
    assert one(spark, S.flag_type(F.lit("true | undefined"))) == "boolean"


@pytest.mark.parametrize(("path", "role"), [("src/a.d.ts", "source"), ("tests/a.ts", "test"), ("src/a.spec.ts", "test"), ("vite.config.ts", "config"), ("src/main.ts", "entrypoint"), ("bin/x.ts", "entrypoint"), ("src/index.ts", "facade"), ("src/a.ts", "source"), ("x/a.ts", "unknown")])
def test_module_role(spark, path, role):
    assert one(spark, roles.module_role(F.lit(path), F.lit(False), ["src"], ["tests"])) == role


def test_declaration_comes_first(spark):
    assert one(spark, roles.module_role(F.lit("tests/a.d.ts"), F.lit(True), ["src"], ["tests"])) == "declaration"


@pytest.mark.parametrize(("query", "want"), [("react", ("react", None, None, None)), ("@s/p/sub@1.2::go", ("@s/p", "sub", "1.2", "go")), ("a::b", ("a", None, None, "b"))])
def test_dependency_query(query, want):
    assert tuple(S.parse_dependency_query(query).values()) == want


def test_test_paths_differ(spark):
    assert one(spark, S.is_test_path(F.lit("tests/x.ts"))) is False
    assert one(spark, S.is_test_path_for_prefilter(F.lit("tests/x.ts"))) is True


def test_token_estimate(spark):
    assert one(spark, S.token_estimate(F.lit("abcd"))) == math.ceil(4 / 3)


def test_stamps_beyond_four_digits(spark):
    assert one(spark, S.utc_stamp(F.lit(205256 * 1234567891))) == "10000-01-02T22:10:35Z"
    assert one(spark, S.utc_stamp(F.lit(205256 * 1234567891), for_file=True)) == "10000-01-02T22-10-35Z"
    assert one(spark, S.utc_stamp(F.lit(0))) == "1970-01-01T00:00:00Z"


def test_stamps_beyond_the_range_of_timestamps(spark):
    ms = [9_000_000 * 1234567891, 0, -1, 951782400000 + 400 * 31556952000 * 1000, 1 << 62, None, (1 << 63) - 1, -(1 << 63)]
    found = [r.x for r in spark.createDataFrame([(i, m) for i, m in enumerate(ms)], "i int, ms long").select("i", S.utc_stamp(F.col("ms")).alias("x")).orderBy("i").collect()]
    assert found[:4] == ["354067-02-02T23:30:00Z", "1970-01-01T00:00:00Z", "1969-12-31T23:59:59Z", "402000-02-29T00:00:00Z"]
    assert found[4] == "146140482-04-24T15:36:27Z" and found[5] is None and found[6] == "292278994-08-17T07:12:55Z" and found[7].startswith("-292275055-05-16T16:47:04")


def test_stamps_follow_no_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # half past two is left out there on that day
        assert one(spark, S.utc_stamp(F.lit(1710037800000))) == "2024-03-10T02:30:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
