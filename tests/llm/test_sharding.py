import zlib
from itertools import product

from pyspark.sql import functions as F

from factloom.llm import sharding


def test_curve_visits_every_cell_by_single_steps(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"c{i} int" for i in range(dims)))
        rows = sharding.with_hilbert_index(cells, [F.col(f"c{i}") for i in range(dims)], bits).orderBy("hilbert").collect()
        assert [r.hilbert for r in rows] == list(range(1 << bits * dims))
        assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(rows, rows[1:], strict=False))


def check(df, shards):
    rows = df.collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    order = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.hilbert for r in order] == sorted(r.hilbert for r in rows)
    return rows


def test_runs_are_even_and_in_order(documents):
    rows = check(sharding.hilbert_shards(documents, 8), 8)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 1, zlib.crc32(data))


def test_odd_rows(odd, nothing):
    rows = check(sharding.hilbert_shards(odd, 3), 3)
    assert len(rows) == 10
    assert {r["size"] for r in rows if r.doc_id in (2, 3)} == {1}
    assert sharding.hilbert_shards(nothing).count() == 0


def test_manifest_and_files(spark, documents, tmp_path):
    placed = sharding.hilbert_shards(documents, 4)
    m = sharding.pruning_manifest(placed).orderBy("shard").collect()
    assert sum(r.n_rows for r in m) == documents.count()
    assert all(a.hilbert_to <= b.hilbert_from for a, b in zip(m, m[1:], strict=False))
    sharding.write_shards(documents, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "shard", "slot").collect())) == sorted((r.doc_id, r.text, r.shard, r.slot) for r in placed.join(documents.select("doc_id", "text"), "doc_id").collect())


def test_every_odd_row_is_written_once(spark, odd, nothing, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    back = check(spark.read.parquet(str(tmp_path / "out")), 3)
    same = lambda rows: sorted((repr(r.doc_id), repr(r.text), r.lang, repr(r.source), r.digest) for r in rows)
    assert same(back) == same(odd.collect())
    assert {(r.doc_id, r.text_crc32) for r in back} == {(r.doc_id, r.text_crc32) for r in sharding.hilbert_shards(odd, 3).collect()}
    sharding.write_shards(nothing, str(tmp_path / "none"))


def test_manifest_of_odd_rows(odd, nothing):
    m = sharding.pruning_manifest(sharding.hilbert_shards(odd, 3)).collect()
    assert sum(r.n_rows for r in m) == 10 and sum(r["bytes"] for r in m) == sum(len((r.text or "").encode()) + 1 for r in odd.collect())
    assert sharding.pruning_manifest(sharding.hilbert_shards(nothing, 3)).count() == 0
