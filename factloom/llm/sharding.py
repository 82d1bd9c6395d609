"""Hilbert-curve ordering: quantise several metadata dimensions, sort by curve index, cut runs.

Native: DataFrame functions only. The curve index needs no lookup and no statistics, so the same row has the same index
whatever it is stored with. The global rank comes from one range exchange of narrow rows; no window runs over the table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, stored


def log_cell(value: Column, bits: int, per_octave: int = 2) -> Column:
    """A number's cell on a logarithmic scale; null and what lies below 1 get cell 0, what lies beyond the last cell gets that."""
    cell = F.floor(F.log2(F.greatest(value.cast("double"), F.lit(1.0))) * per_octave)
    return F.least(F.coalesce(cell, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def name_cell(value: Column, bits: int) -> Column:
    """A category's cell: equal names share one; null gets the cell of the empty name."""
    return (F.crc32(F.encode(F.coalesce(value.cast("string"), F.lit("")), "UTF-8")) % (1 << bits)).cast("int")


def with_hilbert_index(df: DataFrame, cells: list[Column], bits: int, name: str = "hilbert") -> DataFrame:
    """Adds the index (long) on the Hilbert curve through the grid of ``cells``, each an int of ``bits`` bits.

    The cells are turned from axes to the transposed index, from the high bit to the low one, and then interleaved.
    """
    n = len(cells)
    if n * bits > 62:
        raise ValueError("the index must fit into a long")
    turns = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - F.lit(1)
        inverts = x[s["i"]].bitwiseAND(s["q"]) != 0
        swap = x[0].bitwiseXOR(x[s["i"]]).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(inverts, F.when(j == 0, v.bitwiseXOR(low)).otherwise(v)).when((j == 0) | (j == s["i"]), v.bitwiseXOR(F.when(s["i"] == 0, F.lit(0)).otherwise(swap))).otherwise(v))

    axes = F.array(*[c.cast("int") for c in cells])
    out = df.withColumn("_axes", F.aggregate(turns, axes, turn) if bits > 1 else axes)
    gray = [reduce(lambda a, b: a.bitwiseXOR(b), [F.col("_axes")[k] for k in range(i + 1)]) for i in range(n)]
    out = out.withColumn("_gray", F.array(*gray))
    flips = [F.when(F.col("_gray")[n - 1].bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in range(bits - 1, 0, -1)]
    out = out.withColumn("_flip", reduce(lambda a, b: a.bitwiseXOR(b), flips, F.lit(0)))
    parts = [F.shiftleft(F.shiftright(F.col("_gray")[i].bitwiseXOR(F.col("_flip")), b).bitwiseAND(F.lit(1)).cast("long"), b * n + n - 1 - i) for b in range(bits) for i in range(n)]
    return out.withColumn(name, reduce(lambda a, b: a + b, parts)).drop("_axes", "_gray", "_flip")


def cut_runs(df: DataFrame, order: list[str], shards: int, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Adds shard (int) and slot (long): the rows in global ``order``, cut into ``shards`` runs of row counts at most one apart.

    Rows are dealt by range and sorted in place; a row's rank is its place in its partition plus the counts of the
    partitions before. The ranked rows are cut off from their plan first (by ``keep``), so that a task run again can't see other ranges.
    """
    ranked = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = ranked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    # one row for each shuffle partition: bounded by the number of partitions, so it is sent to all
    placed = ranked.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # in whole numbers: a double's quotient could fall on the wrong side of a cut
    placed = placed.withColumn("_rank", rank).withColumn("shard", F.expr(f"CAST((_rank * {shards}L) DIV _all AS INT)"))
    return placed.withColumn("slot", F.expr(f"_rank - (shard * _all + {shards - 1}L) DIV {shards}L")).drop("_at", "_part", "_before", "_all", "_rank")


def _measured(documents: DataFrame, bits: int) -> DataFrame:
    """The rows with size, text_crc32 and hilbert; columns of these names are replaced."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = documents.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))})
    return with_hilbert_index(sized, [log_cell(F.col("size"), bits), name_cell(F.col("source"), bits), name_cell(F.col("lang"), bits)], bits)


ORDER = ["hilbert", "doc_id", "text_crc32"]


def hilbert_shards(documents: DataFrame, shards: int = 8, bits: int = 5) -> DataFrame:
    """All documents in ``shards`` runs of the curve over size, source and language.

    Returns doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32, source, lang, hilbert, shard, slot.
    Null ids, sources and languages keep their rows (ids sort first); equal rows each get a slot of their own; an empty
    table gives no rows; columns beyond doc_id, text, lang and source are not read.
    """
    measured = _measured(documents.select("doc_id", "text", "source", "lang"), bits)
    return cut_runs(measured.select("doc_id", "size", "text_crc32", "source", "lang", "hilbert"), ORDER, shards)


def pruning_manifest(placed: DataFrame) -> DataFrame:
    """What a reader needs to skip whole shards: each one's rows, bytes and ranges of every dimension."""
    return placed.groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.sum("size").alias("bytes"), F.min("hilbert").alias("hilbert_from"), F.max("hilbert").alias("hilbert_to"),
        F.min("size").alias("size_from"), F.max("size").alias("size_to"), F.collect_set("lang").alias("langs"), F.min("source").alias("source_from"), F.max("source").alias("source_to"),
    )


def write_shards(documents: DataFrame, path: str, shards: int = 8, bits: int = 5) -> None:
    """The documents, every row once and all columns, as Parquet: one folder for each shard, in slot order within each file, with size, text_crc32, hilbert and slot.

    The rows themselves go through the one range exchange and are cut where ``hilbert_shards`` cuts them, so that null ids, repeated
    ids and equal rows need no join. Columns of the added names are replaced; of an empty table only the schema is written.
    """
    placed = cut_runs(_measured(documents.drop("shard", "slot"), bits), ORDER, shards, keep=stored)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
