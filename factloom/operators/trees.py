"""Directory hashes and the difference of two trees, and the nearest ancestor of a path.

A directory's digest is made of sums over all files below it, each file's part hashed from its path inside the directory and its content's
hash: sums are formed in each task before the exchange, so that the root, which holds all files, is no hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.checkpoints import cut

SOURCE_FILES = r"\.tsx?$"  # fixed value: what a directory's hash covers


def ancestors(path: Column, itself: bool = False) -> Column:
    """The directories above a path, the root ('') first; with ``itself`` the path too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - (0 if itself else 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def tree_entries(files: DataFrame, covers: str | None = SOURCE_FILES) -> DataFrame:
    """(path, parent, is_directory, digest, n_files) of files (path, content_hash) and of all directories above them, the root ('') included, whose parent is null.

    A directory's digest is the SHA-256 of its number of files and of four sums, of 60-bit parts of SHA-256(path inside the directory, NUL, content hash).
    Files outside ``covers`` (a pattern), and null paths, don't count.
    """
    held = files.where("path IS NOT NULL").select("path", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
    if covers is not None:
        held = held.where(F.col("path").rlike(covers))
    each = held.select("content_hash", "path", F.explode(ancestors(F.col("path"))).alias("directory"))
    inside = F.substr("path", F.when(F.col("directory") == "", F.lit(1)).otherwise(F.length("directory") + 2))
    part = F.sha2(F.encode(F.concat(inside, F.lit("\x00"), F.col("content_hash")), "UTF-8"), 256)
    sums = [F.sum(F.conv(F.substring("part", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")) for k in range(4)]
    rolled = each.select("directory", part.alias("part")).groupBy("directory").agg(F.count("*").alias("n_files"), F.concat_ws(":", *[s.cast("string") for s in sums]).alias("sums"))
    digest = F.sha2(F.encode(F.concat_ws(":", F.col("n_files").cast("string"), "sums"), "UTF-8"), 256)
    parent = lambda c: F.when(F.contains(c, F.lit("/")), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    above = F.when(F.col("directory") != "", parent(F.col("directory")))
    directories = rolled.select(F.col("directory").alias("path"), above.alias("parent"), F.lit(True).alias("is_directory"), digest.alias("digest"), "n_files")
    return directories.unionByName(held.select("path", parent(F.col("path")).alias("parent"), F.lit(False).alias("is_directory"), F.col("content_hash").alias("digest"), F.lit(1).cast("long").alias("n_files")))


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, is_directory, change, n_files) of two trees' entries, top down: a directory on both sides with different digests is ``changed`` and
    is gone into; one on a single side is ``added`` or ``removed`` as a whole, and what lies in it isn't listed; then the files that differ.

    Each turn joins just the entries whose parents differ; there are as many turns as directories are deep. ``n_files`` is what the entry holds on its side, after where it has both.
    """
    side = lambda df, s: df.select("parent", "path", "is_directory", F.col("digest").alias(f"digest_{s}"), F.col("n_files").alias(f"n_{s}"))
    old, new = cut(side(before, "b")), cut(side(after, "a"))

    def compared(b: DataFrame, a: DataFrame) -> DataFrame:
        change = F.when(F.col("digest_b").isNull(), "added").when(F.col("digest_a").isNull(), "removed").otherwise("changed")
        both = b.drop("parent").join(a.drop("parent"), ["path", "is_directory"], "full").where(~F.col("digest_b").eqNullSafe(F.col("digest_a")))
        return cut(both.select("path", "is_directory", change.alias("change"), F.coalesce("n_a", "n_b").alias("n_files")))

    level = compared(old.where("parent IS NULL"), new.where("parent IS NULL"))
    found = level
    while True:
        open_ = level.where("is_directory AND change = 'changed'").select(F.col("path").alias("parent"))
        if open_.isEmpty():
            return found
        level = compared(old.join(open_, "parent", "left_semi"), new.join(open_, "parent", "left_semi"))
        found = found.unionByName(level)


def nearest(paths: DataFrame, places: DataFrame) -> DataFrame:
    """(path, place): the deepest of ``places`` (place, a directory, '' for the root) above each path, or null if there is none.

    Prefixes are exploded for the distinct directories of the paths only; a directory may itself be a place.
    """
    parent = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    held = paths.select("path", parent.alias("directory"))
    up = held.select("directory").distinct().select("directory", F.explode(F.array_distinct(F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(ancestors(F.col("directory"), itself=True)))).alias("place"))
    known = places.select("place").where("place IS NOT NULL").distinct()
    deepest = up.join(known, "place").groupBy("directory").agg(F.max_by("place", F.length("place")).alias("place"))
    return held.join(deepest, "directory", "left").select("path", "place")
