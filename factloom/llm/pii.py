"""Personal data: patterns propose spans, checksums confirm them, context words nearby move the score.

Native: regular expressions, split and higher-order functions of Spark only; one pass over each text, no shuffle.

The base kinds are email, ip, card and phone; iban and ssn are added by the method. Patterns are written so that a long run
of one class is walked once: a match can only begin where a run begins or where the match before it ended, and no
repeated group gives back what it took (the matcher would recurse for each turn). Time is linear in the spans of a text: places
are running sums made block by block, and context comes from the neighbouring pieces, never from the whole text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import free_name

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
THRESHOLD = 0.5
NEAR = 40  # code points before a span, and after it, in which context words count
REACH = 20  # neighbouring matches that can lie in so many code points: each has two at least
BLOCK = 256  # entries that one fold gathers; a fold copies what it has gathered

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]*[0-9]",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Whether a text can hold a span of the kind at all; cheaper than looking for it.
POSSIBLE = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}
#: Score of a confirmed span by itself; context adds CONTEXT. Base kinds pass without, ssn only with.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT = 0.3
WORDS = {
    "email": "mail|contact|write|reply",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|debit|payment|carte|tarjeta|karte",
    "phone": "phone|call|tel|fax|mobile|whatsapp",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
_SPANS = "array<struct<kind:string,s:int,e:int,score:double>>"


def mod97(iban: Column) -> Column:
    """Whether an account number, four first signs moved to the end and letters read as 10 to 35, leaves 1 by 97."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    code = lambda c: F.ascii(c) - F.when(c <= "9", F.lit(48)).otherwise(F.lit(55))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(c <= "9", F.lit(10)).otherwise(F.lit(100)) + code(c)) % 97))
    return F.length(plain).between(15, 34) & (rest == 1)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: F.when(F.length(plain(p)) <= 3, plain(p).try_cast("int") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        digits = F.regexp_replace(m, "[^0-9]", "")
        return F.when(F.length(digits).between(16, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(values: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What ``step`` makes, from 0 on, of all whole numbers before each: block totals first, then each block by itself."""

    def before(block: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(block, first, lambda a, x: F.struct(step(a["at"], x).cast("int").alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def all_of(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(0), lambda a, v: step(a, v).cast("int")))
        return _let(before(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda x, b: before(x, F.get(starts, b)))))

    return _let(values, lambda v: _let(_blocks(v), all_of))


def _confirmed_spans(z: Column, kind: str) -> Column:
    """Of pieces p and the matches m between them: the confirmed spans with places and scores. Pieces are cut to the signs that context can reach."""
    lengths = F.transform(F.arrays_zip(z["p"], z["m"]), lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0)))
    cut = F.struct(F.transform(z["p"], lambda x: F.right(x, F.lit(NEAR))).alias("tail"), F.transform(z["p"], lambda x: F.substring(x, 1, NEAR)).alias("head"))
    word = rf"\b(?:{WORDS[kind]})"

    def scored(x: Column, near: Column) -> Column:
        i = x["i"]
        first = F.greatest(i - REACH, F.lit(0))
        left = F.concat(F.array_join(F.transform(F.sequence(first, i), lambda k: F.concat(F.get(near["tail"], k), F.when(k < i, F.get(z["m"], k)).otherwise(F.lit("")))), ""))
        last = F.least(i + REACH, F.size(z["m"]))
        right = F.array_join(F.transform(F.sequence(i + 1, last), lambda k: F.concat(F.get(near["head"], k), F.coalesce(F.get(z["m"], k), F.lit("")))), "")
        right = F.when(last > i, right).otherwise(F.lit(""))
        held = F.lower(F.right(left, F.lit(NEAR))).rlike(word) | F.lower(F.substring(right, 1, NEAR)).rlike(word)
        score = F.least(F.lit(SCORES[kind]) + F.when(held, F.lit(CONTEXT)).otherwise(F.lit(0.0)), F.lit(1.0))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e"), score.alias("score"))

    def placed(at: Column) -> Column:
        found = F.transform(z["m"], lambda m, i: F.struct(m.alias("m"), (F.get(at, i) + F.length(F.get(z["p"], i))).alias("s"), i.alias("i")))
        return F.filter(found, lambda x: _confirmed(kind, x["m"]))

    spans = _let(cut, lambda near: F.transform(_let(running(lengths, lambda a, x: a + x), placed), lambda x: scored(x, near)))
    return F.filter(spans, lambda v: v["score"] >= THRESHOLD)


def spans_of(text: Column, kind: str) -> Column:
    """The kind's spans in a text that isn't null: array of (kind, s, e, score), in order, e exclusive, in code points.

    Matches and the pieces between them alternate, so that places are sums of lengths; only confirmed spans are gathered.
    """
    read = text
    if kind == "card":  # where separators stand side by side a number ends: they become a sign that is neither digit nor letter, and a number is one run
        read = F.regexp_replace(text, r"(?<=[\x20-])[\x20-]|[\x20-](?=[\x20-])", "\x01")
    split = F.struct(F.split(read, PATTERNS[kind], -1).alias("p"), F.regexp_extract_all(read, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"))
    none = F.array().cast(_SPANS)
    return F.when(POSSIBLE[kind](text), _let(split, lambda z: F.when(F.size(z["m"]) > 0, _confirmed_spans(z, kind).cast(_SPANS)).otherwise(none))).otherwise(none)


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds ``out``: the text's spans of all kinds, by kind as listed, then start. A null text counts as empty: no spans.

    Other columns stay as they are, one of the name ``out`` is replaced; equal rows and ties are treated alike, row by row;
    an empty table stays empty; very long texts, with any number of spans, take time in proportion.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return df.withColumn(out, F.concat(*[spans_of(whole, k) for k in KINDS]))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The same columns, each span in the text replaced by its kind in angle brackets; of overlapping spans the first begun (then the longer) names the whole stretch they cover. Null texts stay null, other columns as they are."""
    spans, body = free_name(df, "pii"), F.col(text)
    flat = lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))

    def named(block: Column) -> Column:
        """The block's stretches, each after what stands before it: the block's text is taken from the whole once."""
        first, last = F.get(block, F.lit(0)), F.element_at(block, -1)
        own = F.substr(body, first["after"] + 1, last["s"] - first["after"])
        return _let(own, lambda t: F.array_join(F.transform(block, lambda x: F.concat(F.substr(t, x["after"] - first["after"] + 1, x["s"] - x["after"]), F.lit("<"), x["kind"], F.lit(">"))), ""))

    def clean(sorted_spans: Column) -> Column:
        ends = F.transform(sorted_spans, lambda x: -x["e"])
        after = lambda c: F.transform(sorted_spans, lambda x, i: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), F.get(c, i).alias("after")))
        stretches = F.filter(_let(running(ends, lambda a, x: F.greatest(a, x)), after), lambda x: x["s"] >= x["after"])
        rest = F.substr(body, F.array_max(ends) + 1, F.length(body))
        return F.concat(F.array_join(_let(stretches, lambda v: F.transform(_blocks(v), named)), ""), rest)

    found = find_pii(df, text, spans)
    return found.withColumn(text, F.when(F.size(spans) > 0, _let(F.array_sort(F.transform(spans, flat)), clean)).otherwise(body)).drop(spans)
