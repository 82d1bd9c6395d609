import gzip
import time
import hashlib

from factloom.llm import fixity
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string"


def record(url, payload):
    data = payload.encode()
    return fixity.HEAD.format(url, len(data)).encode() + data + b"\r\n\r\n"


def found(spark, a, b):
    rec = lambda rows: fixity.records(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS file", "2 AS offset", "'x' AS digest"))
    return sorted(((r.key, r.status) for r in fixity.audit(rec(a), rec(b)).select(fixity.key_of(F.col("file"), F.col("offset")).alias("key"), "status").collect()), key=repr)


def test_differences_are_located(spark):
    a = [(i, f"u{i}", f"text {i}") for i in range(0, 9000, 7)]
    b = [(i, u, t + "!" if i == 700 else t) for i, u, t in a if i != 1400] + [(3, "u", "more")]
    assert found(spark, a, b) == [(1400, "missing"), (3, "extra"), (700, "changed")]
    assert found(spark, a, list(reversed(a))) == []


def test_keys_beyond_doubles_and_below_zero(spark):
    a = [(k, "u", f"text {k}") for k in (-(1 << 63), -4097, -4096, -1, 0, (1 << 53) + 1, (1 << 53) + 4097, (1 << 63) - 1)]
    for k, _, _ in a:
        assert found(spark, a, [(i, u, t + "?" if i == k else t) for i, u, t in a]) == [(k, "changed")]


def test_odd_rows(spark):
    a = [(1, None, None), (1, None, None), (2, "", ""), (None, "u", "t"), (-5, "u", "x" * 200_000)]
    assert found(spark, a, a) == []
    assert found(spark, a, a[1:]) == [(1, "changed")]  # one of two equal records is lost
    assert found(spark, a, [r for r in a if r[0] is not None]) == [(None, "missing")]
    assert found(spark, [], []) == []
    assert len(found(spark, a, [])) == 4


def test_byte_ranges_are_those_of_the_file(spark):
    a = [(i, f"http://x/ü{i}", "é" * (i * 37 % 400)) for i in range(50, 120)] + [(None, "u", "t"), (5000, None, None)]
    left = fixity.records(spark.createDataFrame(a, SCHEMA))
    rows = fixity.byte_ranges(fixity.audit(left, fixity.records(spark.createDataFrame([], SCHEMA))), left).collect()
    file = b"".join(record(u, t) for i, u, t in a if i is not None and i < 4096)
    at = {(r.byte_offset, r.n_bytes): r for r in rows if r.file == 0}
    assert len(at) == 70
    for (start, n), r in at.items():
        assert file[start : start + n] == record(*next((u, t) for i, u, t in a if i == r.offset))
    assert [(r.byte_offset, r.n_bytes) for r in rows if r.file == 1] == [(0, len(record("", "")))]
    assert [r.byte_offset for r in rows if r.file == fixity.NOWHERE] == [None]


def test_warc_files(spark, tmp_path):
    parts = [record(f"http://x/{i}", f"payload {i} " * (i + 1)) for i in range(300)]
    bad = list(parts)
    bad[123] = bad[123].replace(b"payload", b"paylOad")
    for name, records, pack in (("a", parts, bytes), ("b", bad, bytes), ("c", parts, lambda x: gzip.compress(x, mtime=0)), ("d", bad, lambda x: gzip.compress(x, mtime=0)), ("e", [*parts[:-1], parts[-1][:-9]], bytes), ("f", [], bytes)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(b"".join(map(pack, records)))
    read = lambda name: fixity.read_warc(spark, str(tmp_path / name))
    rows = read("a").orderBy("offset").collect()
    assert [(r.n_bytes, r.digest, r.uri) for r in rows] == [(len(p), hashlib.sha256(p).hexdigest(), f"http://x/{i}") for i, p in enumerate(parts)]
    assert [r.uri for r in read("c").orderBy("offset").collect()] == [r.uri for r in rows]
    where = lambda x, y: [(r.file, r.offset, r.status, r.n_bytes) for r in fixity.audit(read(x), read(y), fixity.WARC_BITS).collect()]
    place = sum(map(len, parts[:123]))
    assert where("a", "b") == [("x.warc", place, "changed", len(parts[123]))]
    assert [x[2] for x in where("c", "d")][:1] == ["changed"]
    assert where("a", "e") == [("x.warc", sum(map(len, parts[:-1])), "changed", len(parts[-1]))]
    assert where("a", "a") == [] and len(where("a", "f")) == 300


def test_members_are_read_once():
    """Each member used to be handed the whole rest of the file."""
    record = b"WARC/1.0\r\nWARC-Target-URI: http://a/%d\r\nContent-Length: 3000\r\n\r\n"
    data = b"".join(gzip.compress(record % k + bytes([k % 256]) * 3000 + b"\r\n\r\n", mtime=0) for k in range(8000))
    began = time.time()
    cut = list(fixity._cut(memoryview(data)))
    assert time.time() - began < 10
    assert [u for _, _, u in cut] == [f"http://a/{k}" for k in range(8000)]
    assert b"".join(part for _, part, _ in cut) == data
    damaged = data[: len(data) // 2] + b"\x00" * 50 + data[len(data) // 2 :]
    assert b"".join(part for _, part, _ in fixity._cut(memoryview(damaged))) == damaged
