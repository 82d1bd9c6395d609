import random
import re
import zlib
from collections import Counter

import pytest

from factloom.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in RUN.findall(text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def near(words):
    """By definition: the words that come out of one deletion, or share one with its place."""
    by_gap, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            by_gap.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
            if (short := w[:i] + w[i + 1 :]) in out:
                out[w].add(short)
                out[short].add(w)
    for same in by_gap.values():
        for w in same:
            out[w] |= same - {w}
    return out


def plain(docs):
    n = counted(docs)
    found = near(n)
    form = {}
    for w in n:
        best = min(found[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(found[w]), n.get(form[w])))
    return sorted(rows)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def test_query_is_the_definition(spark, sf_dir, documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    wanted = plain(docs)
    assert got(queries.op13_spelling_variants(spark, sf_dir)) == wanted
    assert any(r[1] for r in wanted) and any(r[4] for r in wanted)


def test_composition_against_all_pairs():
    rng = random.Random(3)
    for _ in range(200):
        words = {"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))}
        pairs = list(spelling.one_edit(list(words)))
        wanted = {frozenset((w, x)) for w, found in near(words).items() for x in found}
        assert len(pairs) == len(set(map(frozenset, pairs))) and set(map(frozenset, pairs)) == wanted
        assert all(len(a) <= len(b) for a, b in pairs)


def test_acceptor_is_minimal():
    a = spelling.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    reached, todo = {0}, [0]
    while todo:
        new = set(a.arcs[todo.pop()].values()) - reached
        reached |= new
        todo += new
    assert len(reached) == 5


@pytest.mark.parametrize("group", [1, 2, 8, 10_000])
def test_halved_partitions_find_the_same_pairs(spark, group):
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.randint(7, 11))) for _ in range(400)}
    df = spark.createDataFrame([(w, len(w)) for w in sorted(words)], "word string, n long")
    rows = spelling.near_pairs(df, group=group).collect()
    pairs = [frozenset((r.a, r.b)) for r in rows]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset((w, x)) for w, found in near(words).items() for x in found}
    assert all(r.n_a == len(r.a) and r.n_b == len(r.b) for r in rows)


def test_chains_ties_and_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert got(spelling.variants(odd)) == plain(rows)
    assert got(spelling.variants(nothing)) == []
    long_word = "q" * 60_000
    texts = [("colours " * 300) + ("colors " * 20) + "colrs " * 2, "harbors " * 40 + "harbour " * 40 + "harbor " * 3, f"{long_word} {long_word} {long_word}r {long_word}r", "ÀÉÎÕÜàé " * 4 + "ÀÉÎÕÜàè " * 50 + "bcdefg×÷ " * 3]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "colours colours"), (None, None), (9, "colours"), (9, "colours")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS word", "1 AS n", "'k' AS key")
    n, shown = counted(docs), got(spelling.variants(df))
    short = [r for r in shown if len(r[0]) < 100]
    assert short == [r for r in plain([d for d in docs if d[0] != 2]) if len(r[0]) < 100]
    assert sorted(r[0] for r in shown) == sorted(n)
    assert [r[4] for r in shown if len(r[0]) >= 60_000] == [1] * sum(len(w) >= 60_000 for w in n)
