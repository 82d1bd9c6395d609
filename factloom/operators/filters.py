"""Predicates over fact rows: syntax predicates, selectors, policy handles, terms, configuration of severities."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("eq", "any-eq", "any-of", "match", "any-match", "not-eq", "not-match")


@dataclass(frozen=True)
class Operand:
    """A string, or the name of another capture."""

    value: str
    is_capture: bool = False


@dataclass(frozen=True)
class Predicate:
    """``capture`` is a column of captured text (string or array of strings)."""

    op: str
    capture: str
    values: tuple[Operand, ...]
    is_list: bool = False

    def column(self) -> Column:
        own = F.col(self.capture) if self.is_list else F.array(F.col(self.capture))
        value = lambda o: F.col(o.value) if o.is_capture else F.lit(o.value)
        eq = lambda t: reduce(lambda a, b: a | b, [t == value(o) for o in self.values])
        match = lambda t: reduce(lambda a, b: a | b, [t.rlike(o.value) if not o.is_capture else F.call_function("rlike", t, F.col(o.value)) for o in self.values])
        table = {
            "eq": lambda: F.forall(own, eq), "any-eq": lambda: F.exists(own, eq), "any-of": lambda: F.exists(own, eq), "match": lambda: F.forall(own, match), "any-match": lambda: F.exists(own, match),
            "not-eq": lambda: F.forall(own, lambda t: ~eq(t)), "not-match": lambda: F.forall(own, lambda t: ~match(t)),
        }
        if self.op not in table:
            raise ValueError(f"unknown predicate {self.op}; known: {', '.join(OPS)}")
        return F.coalesce(table[self.op](), F.lit(False))


def where_all(rows: DataFrame, predicates: list[Predicate]) -> DataFrame:
    """The rows that every predicate holds for."""
    return rows.where(reduce(lambda a, b: a & b, [p.column() for p in predicates], F.lit(True)))


def where_terms(rows: DataFrame, terms: list[str], columns: list[str]) -> DataFrame:
    """Every term lies in the columns' joined text, case aside."""
    text = F.lower(F.concat_ws("\n", *columns))
    return rows.where(reduce(lambda a, b: a & b, [F.contains(text, F.lit(t.lower())) for t in terms], F.lit(True)))


@dataclass(frozen=True)
class Selector:
    """``path[:start[:end]]`` or ``typescript://path#item/kind/name``."""

    path: str
    start: int | None = None
    end: int | None = None
    kind: str | None = None
    name: str | None = None

    @staticmethod
    def parse(text: str) -> Selector:
        if m := re.fullmatch(r"typescript://([^#]+)#item/([^/]+)/(.+)", text):
            return Selector(m[1], kind=m[2], name=m[3])
        m = re.fullmatch(r"(.+?)(?::(\d+))?(?::(\d+))?", text)
        if m is None or not m[1]:
            raise ValueError(f"not a selector: {text!r}")
        start = int(m[2]) if m[2] else None
        return Selector(m[1], start, int(m[3]) if m[3] else start)

    def column(self) -> Column:
        """On rows of path, line, line_end and, for items, kind and name: a file or what lies below a directory; lines that overlap the range."""
        at = (F.col("path") == self.path) | F.col("path").startswith(self.path.rstrip("/") + "/")
        if self.start is not None:
            low, high = min(self.start, self.end or self.start), max(self.start, self.end or self.start)
            at = at & (F.col("line") <= high) & (F.col("line_end") >= low)
        if self.name is not None:
            at = at & (F.col("kind") == self.kind) & (F.col("name") == self.name)
        return at


def policy_handles(rules: DataFrame, text: str) -> DataFrame:
    """Rules whose id, pack, title, requirement or labels hold the text, both reduced to words of a-z and 0-9."""
    words = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    needle = re.sub("[^a-z0-9]+", " ", text.lower()).strip()
    labels = F.array_join(F.transform(F.map_entries("labels"), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
    return rules.where(F.contains(words(F.concat_ws(" ", "rule_id", "pack", "title", "requirement", labels)), F.lit(needle)) if needle else F.lit(True))


def graph_fact_filter(facts: DataFrame, query: str) -> DataFrame:
    """Field facts by a query of shape, collection and context terms; every other term must lie in the fact's text.

    Shape terms: field, type, collection, scalar. Collection terms: array, tuple, map, set, record. Context terms only say what is asked for.
    """
    terms = [t for t in re.split(r"[\s,|]+", query.lower()) if t]
    kinds = [t for t in terms if t in ("array", "tuple", "map", "set", "record")]
    where = F.lit(True)
    if "collection" in terms and not kinds:
        where = where & F.col("collection_kind").isNotNull()
    if "scalar" in terms:
        where = where & F.col("collection_kind").isNull()
    if kinds:
        where = where & F.col("collection_kind").isin(kinds)
    plain = [t for t in terms if t not in ("field", "type", "collection", "scalar", "facts", "fields", "types", "owner", "context", *kinds)]
    text = F.lower(F.concat_ws(" ", "container_name", "field_name", "type_value", "path"))
    return facts.where(reduce(lambda a, t: a & F.contains(text, F.lit(t)), plain, where))


def blocking(findings: DataFrame, severities: list[str] | None = None, rule_ids: list[str] | None = None) -> DataFrame:
    """Findings whose severity or rule blocks; warnings and errors by default."""
    return findings.where(F.col("severity").isin(severities if severities is not None else ["warning", "error"]) | F.col("rule_id").isin([*(rule_ids or []), ""]))


def advisory(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity") == "info")


def is_clean(findings: DataFrame) -> bool:
    return blocking(findings).isEmpty()


def apply_policy(findings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Findings without those of disabled rules and packs; the severity is the rule's override, else the pack's, else its own.

    ``overrides`` has scope (rule or pack), name, disabled, severity; it is a configuration of at most a few rows a rule.
    """
    of = lambda scope: overrides.where(F.col("scope") == scope).groupBy("name").agg(F.bool_or(F.coalesce("disabled", F.lit(False))).alias(f"{scope}_off"), F.max("severity").alias(f"{scope}_severity"))
    by_rule, by_pack = of("rule").withColumnRenamed("name", "rule_id"), of("pack").withColumnRenamed("name", "pack")
    out = findings.join(by_rule, "rule_id", "left").join(by_pack, "pack", "left")
    out = out.where(~(F.coalesce("rule_off", F.lit(False)) | F.coalesce("pack_off", F.lit(False))))
    return out.withColumn("severity", F.coalesce("rule_severity", "pack_severity", "severity")).select(*findings.columns)
