import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.llm import pii, queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in twice) % 10 == 0


def passes(kind: str, m: str) -> bool:
    digits = re.sub(r"\D", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def brute(text: str | None) -> list[tuple[str, int, int]]:
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


def base_of(spark, texts):
    df = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id")
    return [[(x.kind, x.s, x.e) for x in r.pii if x.kind in pii.BASE] for r in df.collect()]


CASES = [
    "a@b.c_d@e.f g@h.i.j@k.l", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.0003.4 1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111  4111  1111", "4111111111111111 4111111111111112 411111111111111100000", "+1 (555) 123-4567) +44.20.7946.0958- +1 2", "x..y@z-.q é@ü.de ü@a.b.c.",
    "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 " * 3, "+123456789012345678 +12345678", "", None, "🙂 a@b.cd 🙂 10.0.0.1", "- 4111 1111 1111 1111 -", "5500-0000 0000-0004.1.1.1",
]


def test_base_spans_as_in_plain_python(spark):
    assert base_of(spark, CASES) == [brute(t) for t in CASES]


def test_random_texts(spark):
    random.seed(3)
    texts = ["".join(random.choice("0123456789 .-+@()ab") for _ in range(random.randint(1, 120))) for _ in range(400)]
    assert base_of(spark, texts) == [brute(t) for t in texts]


def test_long_runs_end(spark):
    texts = ["a" * 60_000, "1" * 60_000, "1 " * 30_000, "1." * 30_000, "+1" + "2" * 60_000, "a." * 20_000 + "@b"]
    assert base_of(spark, texts) == [brute(t) for t in texts]


def test_query_on_documents(spark, sf_dir, documents):
    got = {r.doc_id: r for r in queries.op3_pii_spans(spark, sf_dir).collect()}
    for d in documents.collect():
        spans = brute(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [got[d.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in spans) for k in pii.BASE]


@pytest.mark.parametrize(("text", "kinds"), [("my IBAN is DE89 3704 0044 0532 0130 00.", ["iban"]), ("my IBAN is DE88 3704 0044 0532 0130 00.", []), ("GB82WEST12345698765432", ["iban"]), ("social security 123-45-6789", ["ssn"]), ("part 123-45-6789", [])])
def test_checksums_and_context(spark, text, kinds):
    r = pii.find_pii(spark.createDataFrame([(text,)], "text string")).first()
    assert [x.kind for x in r.pii] == kinds


def test_context_raises_the_score(spark):
    rows = pii.find_pii(spark.createDataFrame([("host 10.0.0.1",), ("v 10.0.0.1",)], "text string")).collect()
    assert rows[0].pii[0].score > rows[1].pii[0].score >= pii.THRESHOLD


def test_redaction(spark):
    texts = ["call +1 (555) 123-4567 or a@b.org.", "nothing", "", None, "pay 4111 1111 1111 1111 +4111 1111 1111"]
    rows = pii.redact(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [r.text for r in rows[:4]] == ["call <phone> or <email>.", "nothing", "", None]
    assert "4111" not in rows[4].text


def test_odd_rows(odd, nothing):
    rows = pii.find_pii(odd).select("doc_id", F.size("pii").alias("n")).collect()
    assert len(rows) == 10
    assert sum(r.n for r in rows) == 2
    assert pii.redact(odd).columns == odd.columns
    assert pii.find_pii(nothing).count() == 0


@pytest.mark.parametrize(("text", "kinds"), [("078-05-1120 (social security number)", ["ssn"]), ("078-05-1120 SSN", ["ssn"]), ("078-05-1120 is a part" + " " * 40 + "ssn", []), ("078-05-1120 lessons", [])])
def test_context_after_a_span(spark, text, kinds):
    df = spark.createDataFrame([(text,)], "text string")
    assert [x.kind for x in pii.find_pii(df).first().pii] == kinds
    assert ("078" in pii.redact(df).first().text) == (not kinds)


def test_long_addresses_and_many_spans_end(spark):
    """Many labels used to recurse once each; many spans used to take a walk over the whole text each."""
    texts = ["a@" + "b." * 50_000 + "c", "x" * 30 + " a@b.cd" * 100_000, "4111 1111 1111 1111, 10.0.0.1; " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    began = time.time()
    found = {r.i: [(x.kind, x.s, x.e) for x in r.pii if x.kind in pii.BASE] for r in pii.find_pii(df).collect()}
    assert [found[i] for i in range(3)] == [brute(t) for t in texts]
    clean = {r.i: r.text for r in pii.redact(df).collect()}
    assert clean[0] == "<email>"
    assert clean[1] == "x" * 30 + " <email>" * 100_000
    assert clean[2] == "<card>, <ip>; " * 20_000
    assert time.time() - began < 120


def plain_redaction(text, spans):
    out, at = [], 0
    for s, e, kind in sorted(((s, -e, k) for k, s, e in spans)):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, -e)
    return "".join(out) + text[at:]


def test_redaction_is_the_definition(spark):
    random.seed(8)
    parts = ["4111 1111 1111 1111", "+1 (555) 123-4567", "a@b.org", "10.0.0.1", "+41 1111 1111 1111 1111", " ", "é🙂", "card", "x", "DE89370400440532013000", "1.2.3.4@5.6"]
    texts = ["".join(random.choice(parts) for _ in range(random.choice([3, 30, 1500]))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    spans = {r.i: [(x.kind, x.s, x.e) for x in r.pii] for r in pii.find_pii(df).collect()}
    assert {r.i: r.text for r in pii.redact(df).collect()} == {i: plain_redaction(t, spans[i]) for i, t in enumerate(texts)}


def test_running_sums_over_blocks(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        df = spark.createDataFrame([([k % 7 for k in range(n)],)], "v array<int>")
        got = df.select(pii.running(F.col("v"), lambda a, x: a + x).alias("r")).first().r
        assert got == [sum(k % 7 for k in range(i)) for i in range(n)]


def test_clashing_columns_keep_their_values(spark):
    names = ["_whole", "_pii", "_email", "_ip", "_card", "_phone", "_iban", "_ssn", "PII"]
    df = spark.createDataFrame([(1, "a@b.org", *names)], ", ".join(["doc_id int", "text string", *(f"{n} string" for n in names)]))
    assert pii.find_pii(df, out="found").first().asDict() | {"found": 0} == {"doc_id": 1, "text": "a@b.org", "found": 0} | {n: n for n in names}
    assert pii.redact(df).first().asDict() == {"doc_id": 1, "text": "<email>"} | {n: n for n in names}
