import random

from factloom.llm import decontam


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def least(item: str, text: str) -> int:
    """Least distance of the item to any part of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, y in enumerate(item):
            new.append(min(row[j] + (c != y), row[j + 1] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def words(rng, n):
    return " ".join(rng.choice(["the", "thin", "tion", "and", "ered", "onth", "her"]) + rng.choice("abcdes") for _ in range(n))


def test_as_brute_force():
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(2, 14))) for i in range(25)]
    matcher = decontam.Matcher(items, 8)
    for _ in range(60):
        text = words(rng, 30)
        if rng.random() < 0.7:
            s = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(s) // 7)):
                o = rng.randrange(len(s))
                s[o] = rng.choice(["", "x", s[o] + "y"])
            text = words(rng, 5) + " " + "".join(s) + " " + words(rng, 5)
        text = decontam.normal(text)
        want = {i: d for i, t in items if (d := least(t, text)) <= len(t) // 8}
        found = matcher.find(text)
        assert {x[0]: x[1] for x in found} == want
        assert all(distance(text[x[3] : x[4]], dict(items)[x[0]]) == x[1] for x in found)


def test_documents(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, decontam.normal(r.text)) for r in benchmark.collect()]
    want = {(d.doc_id, i) for d in documents.collect() for i, t in items if t in decontam.normal(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.find_passages(documents, benchmark).collect()}
    assert want <= got
    small = {(r.doc_id, r.item_id) for r in decontam.find_passages(documents, benchmark, block=2000).collect()}
    assert small == got
    left = {r.doc_id for r in decontam.without_passages(documents, benchmark, block=2000).collect()}
    assert left == {d.doc_id for d in documents.collect()} - {d for d, _ in got}


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "Gamma  DELTA epsilon"), (2, None), (3, ""), (4, "wordy"), (1, "gamma delta epsilon")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontam.find_passages(odd, items).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (1, 1), (5, 1), (5, 1)]
    assert decontam.find_passages(nothing, items).count() == 0
    assert decontam.find_passages(odd, items.limit(0)).count() == 0
    assert decontam.without_passages(odd, items).count() == 7


def test_documents_of_equal_texts_go_together(spark, odd):
    items = spark.createDataFrame([(i, x) for i, x in enumerate(("alpha beta gamma", "no id here", "words of no document", "lorem ipsum dolor"))], "item_id long, text string")
    docs = odd.selectExpr("*", "'q' AS _text")
    for block in (decontam.BLOCK, 5):  # one block, and one for each item
        left = decontam.without_passages(docs, items, block=block)
        assert left.columns == docs.columns
        assert sorted(repr(r.doc_id) for r in left.collect()) == ["2", "3", "6", "7", "8"]
        assert decontam.find_passages(docs, items, block=block).count() == 5


def test_documents_as_brute_force(spark, sf_dir, documents):
    """Distances of every document and item, by the plain recurrence, on a few documents and all items."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = {r.item_id: decontam.normal(r.text) for r in benchmark.collect()}
    items = dict(sorted(items.items(), key=lambda x: len(x[1]))[:12])
    some = [r for r in documents.collect() if r.text and len(r.text) < 700][:40]
    texts = [(r.doc_id, r.text) for r in some] + [(10_000 + i, f"before {t[: len(t) // 2]}q{t[len(t) // 2 + 1 :]} after") for i, t in items.items()]
    want = {(d, i, k) for d, text in texts for i, t in items.items() if (k := least(t, decontam.normal(text))) <= len(t) // decontam.PER_ERROR}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = decontam.find_passages(docs, benchmark.where(benchmark.item_id.isin(list(items)))).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in got} == want
    assert len(want) >= len(items)


def test_columns_of_clashing_names_keep_their_values(spark, odd):
    items = spark.createDataFrame([(k, " ".join(f"word{k}x{i}" for i in range(60))) for k in range(4)], "item_id long, text string")
    docs = odd.selectExpr("*", "'q' AS _text", "'r' AS of_text", "'s' AS OF_TEXT_")
    got = decontam.without_passages(docs, items, block=300)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, docs.collect()))
