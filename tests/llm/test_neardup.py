import random

from factloom.llm import neardup


def brute(rows, size, share):
    """doc_id → (n, component) over (doc_id, text)."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= share * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def agrees(df, want):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert got == want


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    agrees(neardup.near_duplicates(documents, 3, 85), brute(rows, 3, 85))
    agrees(neardup.near_duplicates(documents), brute(rows, 5, 80))


def copies(n, edits, seed=5):
    rng = random.Random(seed)
    base = [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(150)]
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            o = rng.randrange(len(w))
            if rng.random() < 0.6:
                del w[o]
            else:
                w[o] = "x" + str(rng.randrange(99))
        rows.append((k * 3 + 1, " ".join(w)))
    return rows


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LOAD", 20_000)  # several blocks
    rows = copies(350, 8)
    agrees(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 3, 85), brute(rows, 3, 85))


def test_exact_copies_and_order(spark):
    rows = [(9, "a b c d"), (3, "A  b\tc d"), (5, "a b c e"), (7, "x")]
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {9: (3, False), 3: (3, True), 5: (5, True), 7: (7, True)}


def test_agreement_grows_with_the_share():
    assert neardup.agreement(70) < neardup.agreement(80) < neardup.agreement(85) < neardup.agreement(95)


def test_odd_rows(odd, nothing):
    rows = neardup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == 10
    by = {r.doc_id: r for r in rows}
    assert (by[5].component_id, by[5].kept) == (1, False)
    assert (by[2].n_shingles, by[2].component_id, by[3].kept) == (0, 2, True)
    assert (by[None].component_id, by[None].kept) == (None, False)
    assert neardup.near_duplicates(nothing, 3, 85).count() == 0


def test_each_text_of_one_id_keeps_its_links(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (9, a), (11, a + " z"), (13, b + " z"), (20, "c d e f"), (20, b + " z y"), (30, "c d e f"), (40, "other words")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [*((i, 5) for i in (5, 5, 9, 11, 13, 20, 20, 30)), (40, 40)]


def test_rows_of_one_id_are_one_document_and_each_text_counts(spark):
    x, y = " ".join(f"x{i}" for i in range(40)), " ".join(f"y{i}" for i in range(40))
    rows = [(1, x), (1, y), (2, x + " more"), (3, "a b c d"), (4, "e f g h"), (5, "a b c d"), (5, "e f g h"), (5, "c d e f"), (7, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (5, 3), (5, 3), (7, 7)]
    assert sorted((r.doc_id, r.n_shingles) for r in got if r.text_kept) == [(1, 38), (1, 38), (3, 2), (4, 2), (5, 2), (7, 0)]


def test_long_list_of_several_groups(spark, monkeypatch):
    """Groups around texts of their own that share lists with one hub: only what is outside the hub's component meets all."""
    monkeypatch.setattr(neardup, "LOAD", 5_000)
    monkeypatch.setattr(neardup, "SHORT", 8)
    rows = copies(120, 6, seed=1) + [(i + 100_000, t) for i, t in copies(120, 14, seed=1)] + [(i + 200_000, t + " q1 q2 q3 q4 q5 q6 q7 q8") for i, t in copies(60, 9, seed=1)]
    agrees(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 3, 85), brute(rows, 3, 85))
