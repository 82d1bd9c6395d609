"""Incremental facts: unchanged valid files are reused, the rest is read again; as a batch job and over an arriving stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.joins import reusable
from factloom.operators.sets import hash_diff
from factloom.schemas import conform
from factloom.sources import typescript


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))


def snapshot_of(files: DataFrame) -> DataFrame:
    """(path, content_hash, is_valid, facts) read anew."""
    m = typescript.facts(files, "modules")
    return conform(m.withColumn("facts", F.to_json(F.struct("export_names", "n_lines", "has_intent_doc"))), "snapshot")


def update(files: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, changes): what was valid and hasn't changed is taken over; invalid modules are read again every time."""
    current = with_hash(files)
    reused, todo = reusable(current, before)
    after = reused.unionByName(snapshot_of(todo.select("path", "content", "mtime_ms")))
    return after, hash_diff(before, current)


def reuse_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: files, reused, read anew."""
    a = after.select("path", "content_hash")
    same = a.join(before.where("is_valid").select("path", "content_hash"), ["path", "content_hash"], "left_semi")
    return a.agg(F.count("*").alias("n_files")).crossJoin(same.agg(F.count("*").alias("n_reused"))).withColumn("n_read", F.col("n_files") - F.col("n_reused"))


def stream_facts(arriving: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Facts of an arriving stream of files (path, content, mtime_ms): each version of a file once, by its content's hash; late repeats within a day are dropped by the watermark's state."""
    fresh = with_hash(arriving).withColumn("at", F.timestamp_millis("mtime_ms")).withWatermark("at", "1 day").dropDuplicatesWithinWatermark(["path", "content_hash"])

    def each(batch: DataFrame, number: int) -> None:
        sink(snapshot_of(batch.select("path", "content", "mtime_ms")), number)

    return fresh.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def context_atoms(rows: DataFrame) -> DataFrame:
    """Atoms (kind, text) with class, fingerprint and token estimate: contract and structure are immutable or stable, repairs and the branch's tail change."""
    from factloom.functions import scalar as S

    cls = F.when(F.col("kind") == "contract", "immutable").when(F.col("kind") == "structure", "stable").when(F.col("kind") == "policy", "session").when(F.col("kind") == "repair", "volatile").otherwise("tail")
    return rows.select("kind", cls.alias("cache_class"), "text", S.fingerprint16(F.col("text")).alias("fingerprint"), S.token_estimate(F.col("text")).alias("tokens"))


# fixed values: what counts as kept apart from what changes
CACHE_CLASSES = ("immutable", "stable", "session", "volatile", "tail")


def atom_reuse(before: DataFrame, after: DataFrame) -> DataFrame:
    """(context, n_atoms, n_reused, tokens, tokens_reused, first_change, tokens_by_class) of ordered atoms (context, pos, cache_class, fingerprint, tokens), now and before.

    A prefix is reused up to the first atom that differs from the one at its place before (or has none there); all after it are misses. The first change is a
    minimum, formed in each task before the exchange, so that a long context is no hot group; tokens by class are (class, tokens, reused).
    """
    old = before.select("context", "pos", F.col("fingerprint").alias("was"))
    both = after.join(old, ["context", "pos"], "left").withColumn("same", F.coalesce(F.col("fingerprint") == F.col("was"), F.lit(False)))
    first = both.groupBy("context").agg(F.min(F.when(~F.col("same"), F.col("pos"))).alias("first_change"))
    placed = both.join(first, "context").withColumn("reused", F.coalesce(F.col("pos") < F.col("first_change"), F.lit(True)))
    of_class = placed.groupBy("context", "first_change", "cache_class").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("reused"), 1)).alias("n_reused"), F.sum("tokens").cast("long").alias("tokens"), F.coalesce(F.sum(F.when(F.col("reused"), F.col("tokens"))), F.lit(0)).cast("long").alias("tokens_reused")
    )
    by_class = F.array_sort(F.collect_list(F.struct(F.col("cache_class").alias("cache_class"), F.col("tokens").alias("tokens"), F.col("tokens_reused").alias("reused"))))  # five classes at most
    return of_class.groupBy("context", "first_change").agg(
        F.sum("n").alias("n_atoms"), F.sum("n_reused").alias("n_reused"), F.sum("tokens").alias("tokens"), F.sum("tokens_reused").alias("tokens_reused"), by_class.alias("tokens_by_class")
    ).select("context", "n_atoms", "n_reused", "tokens", "tokens_reused", "first_change", "tokens_by_class")


def partition_atoms(atoms: DataFrame) -> DataFrame:
    """The atoms (context, pos, cache_class, ...) with their place when those that change least come first: by class, then as given."""
    order = F.array_position(F.array(*[F.lit(c) for c in CACHE_CLASSES]), F.col("cache_class"))
    w = Window.partitionBy("context").orderBy(order, "pos")
    return atoms.withColumn("place", F.row_number().over(w))
