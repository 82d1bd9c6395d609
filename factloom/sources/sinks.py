"""Renderers and writers: JSON, line protocols, advice, snapshots, caches, command logs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalar as S
from factloom.schemas import SCHEMAS, conform, empty


MOST_ROWS = 10_000  # of a list that goes through the driver


def json_lines(df: DataFrame) -> DataFrame:
    """Each row as JSON, nulls left out."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def packet_json(packet: dict[str, DataFrame], view: str) -> str:
    """A search result as one JSON document, for lists of ``MOST_ROWS`` rows at most; ``write_packet`` writes those of any length."""
    parts = []
    for name, df in packet.items():
        rows = json_lines(df).limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows: use write_packet")
        parts.append(f'"{name}":[{",".join(r.json for r in rows)}]')
    return "{" + ",".join([f'"view":"{view}"', *parts]) + "}"


def write_packet(packet: dict[str, DataFrame], path: str) -> None:
    """Each list of a search result as JSON lines in a folder of its name, written by the tasks that have the rows."""
    for name, df in packet.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def _escaped(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.rlike(r'[\s"=]'), F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(text)


def compact_lines(df: DataFrame, kind: str) -> DataFrame:
    """kind name=value … of each row; empty fields go."""
    fields = []
    for f in df.schema:
        v = F.array_join(F.col(f.name).cast("array<string>"), ",") if f.dataType.typeName() == "array" else F.to_json(f.name) if f.dataType.typeName() in ("map", "struct") else F.col(f.name)
        fields.append(F.when(v.isNotNull() & (v.cast("string") != ""), F.concat(F.lit(f"{f.name}="), _escaped(v))))
    return df.select(F.concat_ws(" ", F.lit(kind), *fields).alias("line"))


def graph_seeds(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """The k nodes of most edges as seed lines; drawn here, without another process."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    top = nodes.join(ends, "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(k)
    return top.select(F.concat_ws(" ", F.lit("seed"), "kind", "id", F.concat(F.lit("degree="), F.coalesce("degree", F.lit(0)).cast("string"))).alias("line"))


def tree_snapshot(branches: DataFrame, edges: DataFrame, most: int = 24, children: int = 8) -> DataFrame:
    """A line for each of the first branches with its first targets."""
    w = Window.partitionBy("from_path").orderBy("to_path")
    e = edges.where("to_path IS NOT NULL").select("from_path", "to_path").distinct().withColumn("n", F.row_number().over(w))
    all_ = e.groupBy("from_path").agg(F.max("n").alias("total"), F.array_sort(F.collect_list(F.when(F.col("n") <= children, F.col("to_path")))).alias("targets"))
    b = branches.orderBy(F.when(F.col("role").isin("entrypoint", "facade"), 0).otherwise(1), "path").limit(most)
    more = F.when(F.col("total") > children, F.concat(F.lit(" +"), (F.col("total") - children).cast("string"))).otherwise(F.lit(""))
    return b.join(all_.withColumnRenamed("from_path", "path"), "path", "left").select("path", F.concat(F.lit("- "), F.col("path"), F.lit(" ["), F.col("role"), F.lit("] "), F.coalesce(F.concat(F.array_join("targets", ", "), more), F.lit(""))).alias("line")).orderBy("path")


def advice(findings: DataFrame, groups: int = 6, targets: int = 4, actions: int = 8) -> DataFrame:
    """Findings by rule: errors first, then the most frequent; the first targets of each, eight lines at most."""
    w = Window.partitionBy("rule_id").orderBy("path", "line")
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    g = findings.withColumn("n", F.row_number().over(w)).groupBy("rule_id", "title", "severity").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("n") <= targets, F.concat_ws(":", "path", "line")))).alias("at"))
    top = g.orderBy(rank, F.desc("total"), "rule_id").limit(groups)
    return top.select("rule_id", F.concat(F.col("severity"), F.lit(" "), F.col("rule_id"), F.lit(": "), F.col("title"), F.lit(" — "), F.array_join("at", ", ")).alias("line")).limit(actions)


def write_plan(tasks: DataFrame, path: str, project_root: str) -> None:
    """A verification plan as JSON files; the project's root is cut out of every string."""
    root = re.escape(project_root.rstrip("/") + "/")
    cut = [F.regexp_replace(f.name, root, "").alias(f.name) if f.dataType.typeName() == "string" else F.col(f.name) for f in tasks.schema]
    tasks.select(*cut).write.mode("overwrite").json(path)


def write_hashes(files: DataFrame, path: str) -> None:
    files.select("path", F.sha2(F.encode("content", "UTF-8"), 256).alias("content_hash")).write.mode("overwrite").parquet(path)


def write_modules(snapshot: DataFrame, path: str) -> bool:
    """Valid modules only; nothing is written if there are none."""
    valid = conform(snapshot, "snapshot").where("is_valid")
    if valid.isEmpty():
        return False
    valid.write.mode("overwrite").parquet(path)
    return True


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A cache as it was written; empty if it is missing or can't be read."""
    try:
        df = spark.read.schema(SCHEMAS["snapshot"]).parquet(path)
        df.limit(1).collect()
        return df
    except Exception as fault:
        if not re.search("PATH_NOT_FOUND|FAILED_READ_FILE|CANNOT_READ_FILE|not a Parquet", str(fault)):
            raise
        return empty(spark, "snapshot")


def normalise_command(argv: Iterable[str]) -> str:
    """The command without paths, numbers and values."""
    return " ".join(re.sub(r"\d+", "N", re.sub(r"=.*$", "=…", a.rsplit("/", 1)[-1] if "/" in a else a)) for a in argv)


def log_records(commands: DataFrame) -> DataFrame:
    """Commands (session, at, argv) as log records: secrets redacted, numbered within their session."""
    w = Window.partitionBy("session").orderBy("at")
    return commands.select("session", F.row_number().over(w).alias("ordinal"), "at", S.redact_argv(F.col("argv")).alias("argv"))


def tokenize_command(text: str) -> list[str]:
    """Words of a command line; quotes of both kinds group."""
    return [a or b or c for a, b, c in re.findall(r"""'([^']*)'|"([^"]*)"|([^\s'"]+)""", text)]
