"""Set operations over relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def concatenated(packs: list[DataFrame]) -> DataFrame:
    """Union of all rows; ``pack_order`` keeps the packs' order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("pack_order", F.lit(i)) for i, p in enumerate(packs)])


def distinct_sorted(*columns: DataFrame) -> DataFrame:
    """Distinct values of one-column relations, sorted."""
    return reduce(DataFrame.union, columns).distinct().orderBy(F.col(columns[0].columns[0]))


def hash_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, changed or removed; unchanged paths go."""
    b, a = before.select("path", F.col("content_hash").alias("_b")), after.select("path", F.col("content_hash").alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").otherwise("changed")
    return b.join(a, "path", "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("path", change.alias("change"))


def missing(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def terms_without_owner(terms: DataFrame, owners: DataFrame) -> DataFrame:
    """Terms that look like paths and are no owner's."""
    looks = F.col("term").rlike(r"/|\.[cm]?tsx?$")
    return terms.where(looks).join(owners.select(F.col("path").alias("term")), "term", "left_anti")


def append_unique(a: Column, b: Column) -> Column:
    return F.array_union(a, b)
