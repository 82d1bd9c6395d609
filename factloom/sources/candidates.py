"""Candidate streams: lines of paths, grep results, JSON matches or diffs, told apart and read by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("path-list-nul", "rg-json", "diff-paths", "vimgrep", "rg-n", "path-list", "unknown")
_SCHEMA = "type string, data struct<path:struct<text:string>,line_number:int,submatches:array<struct<start:int>>,lines:struct<text:string>>"


def detect(text: str, known: set[str] | None = None) -> str:
    """The stream's format: the first of NUL-separated paths, JSON lines, a diff, path:line:column:, path:line:, existing paths."""
    import re

    lines = [x for x in text.replace("\r\n", "\n").split("\n") if x]
    first = lines[0].lstrip() if lines else ""
    if "\0" in text:
        return "path-list-nul"
    if first.startswith("{"):
        return "rg-json"
    if first.startswith("diff --git "):
        return "diff-paths"
    if any(re.match(r"^.+?:\d+:\d+:", x) for x in lines):
        return "vimgrep"
    if any(re.match(r"^.+?:\d+:", x) for x in lines):
        return "rg-n"
    return "path-list" if any(x in (known or ()) for x in lines) else "unknown"


def detect_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """One row, the format of a large stream (seq, line): the same order of tests as one aggregate; a line is a path if ``known`` has it."""
    lines = rows.where("line != ''")
    hit = lines.join(known.select(F.col("path").alias("line")).distinct(), "line", "left_semi").agg((F.count("*") > 0).alias("is_path"))
    facts = lines.agg(F.bool_or(F.contains("line", F.lit("\0"))).alias("nul"), F.ltrim(F.min_by("line", "seq")).alias("first"), F.bool_or(F.col("line").rlike(r"^.+?:\d+:\d+:")).alias("vim"), F.bool_or(F.col("line").rlike(r"^.+?:\d+:")).alias("rg"))
    fmt = F.when(F.col("nul"), "path-list-nul").when(F.col("first").startswith("{"), "rg-json").when(F.col("first").startswith("diff --git "), "diff-paths").when(F.col("vim"), "vimgrep").when(F.col("rg"), "rg-n").when(F.col("is_path"), "path-list").otherwise("unknown")
    return facts.crossJoin(hit).select(fmt.alias("format"))  # one row each


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), r"^\./", "")


def parse(rows: DataFrame, fmt: str) -> DataFrame:
    """(seq, path, line, col, snippet, kind) of a stream's lines (seq, line); malformed lines go. A JSON match's column is its first submatch's start plus one."""
    r = rows.select("seq", F.col("line").alias("raw")).where("raw != ''")
    none = lambda t: F.lit(None).cast(t)
    paths = lambda df, p: df.select("seq", _clean(p).alias("path"), none("int").alias("line"), none("int").alias("col"), none("string").alias("snippet"), F.lit("path").alias("kind")).where("path != ''")
    if fmt == "path-list-nul":
        return paths(r.select("seq", F.explode(F.split("raw", "\0")).alias("raw")), F.col("raw"))
    if fmt == "path-list":
        return paths(r, F.col("raw"))
    if fmt == "diff-paths":
        return paths(r.where(F.col("raw").rlike(r"^diff --git a/.+? b/.+$")), F.regexp_extract("raw", r"^diff --git a/(.+?) b/(.+)$", 2))
    if fmt in ("vimgrep", "rg-n"):
        rx = r"^(.+?):(\d+)(?::(\d+))?:(.*)$"
        part = lambda i: F.regexp_extract("raw", rx, i)
        number = lambda c: F.nullif(c, F.lit("")).try_cast("int")
        return r.where(F.col("raw").rlike(rx)).select("seq", _clean(part(1)).alias("path"), number(part(2)).alias("line"), number(part(3)).alias("col"), part(4).alias("snippet"), F.lit("text").alias("kind"))
    if fmt == "rg-json":
        j = r.select("seq", F.from_json("raw", _SCHEMA).alias("j")).where("j.type = 'match' AND j.data.path.text IS NOT NULL")
        start = F.get(F.col("j.data.submatches"), F.lit(0))["start"]
        return j.select("seq", _clean(F.col("j.data.path.text")).alias("path"), F.col("j.data.line_number").alias("line"), (start + 1).alias("col"), F.rtrim(F.regexp_replace("j.data.lines.text", r"\s+$", "")).alias("snippet"), F.lit("text").alias("kind"))
    return paths(r.limit(0), F.col("raw"))


def ingest_hits(records: DataFrame, files: DataFrame, fmt: str, k: int = 12) -> DataFrame:
    """The newest files' records as hits: 2 with a line, 1 without."""
    m = files.select("path", "mtime_ms")
    scored = records.join(m, "path", "left").withColumn("score", F.when(F.col("line").isNotNull(), 2).otherwise(1))
    return scored.orderBy(F.desc(F.coalesce("mtime_ms", F.lit(0))), "path", "seq").limit(k).select("kind", "path", "line", "score", F.lit(fmt).alias("reason"), "snippet")
