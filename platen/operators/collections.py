"""Hand-ordered collections: counts, members, appending, reordering, removing and restoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .library import subtree

KEY = ["collection_id", "image_id"]


def counts(collections: DataFrame, members: DataFrame, gone: DataFrame) -> DataFrame:
    """Collections with how many of their members' files are present, in one pass over the members."""
    marked = members.join(gone.select("image_id", F.lit(True).alias("_gone")), "image_id", "left")
    n = marked.groupBy("collection_id").agg(F.count_if(F.col("_gone").isNull()).alias("members"))
    return collections.join(n, collections["id"] == n["collection_id"], "left").select(*collections.columns, F.coalesce("members", F.lit(0)).cast("long").alias("members"))


def members(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Members whose files are present, numbered by position and then image."""
    rank = F.row_number().over(Window.partitionBy("collection_id").orderBy("position", "image_id"))
    return rows.join(gone, "image_id", "left_anti").select(*KEY, rank.cast("long").alias("rank"))


def appended(rows: DataFrame, asked: DataFrame, images: DataFrame) -> DataFrame:
    """The rows that appending ``asked`` (with ordinal from 1) adds.

    Positions go on from the greatest; one that an image already holds, or
    that names no image, is skipped but still counts.
    """
    top = rows.groupBy("collection_id").agg(F.max("position").alias("_top"))
    fresh = asked.join(images.select("image_id"), "image_id", "left_semi").join(rows.select(*KEY), KEY, "left_anti")
    return fresh.join(top, "collection_id", "left").select(*KEY, (F.coalesce("_top", F.lit(0)) + F.col("ordinal")).cast("long").alias("position"))


def reordered(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed images take 1..n; the others keep their order after them."""
    size = listed.groupBy("collection_id").agg(F.count("*").alias("_n"))
    out = rows.join(listed, KEY, "left").join(size, "collection_id", "left")
    return out.select(*KEY, F.coalesce("ordinal", F.col("position") + F.coalesce("_n", F.lit(0))).cast("long").alias("position"))


def swapped(rows: DataFrame, column: str, a: int, b: int) -> DataFrame:
    c = F.col(column)
    return rows.withColumn(column, F.when(c == a, b).when(c == b, a).otherwise(c))


def holding(rows: DataFrame) -> DataFrame:
    """Which collections hold each image."""
    return rows.groupBy("image_id").agg(F.array_sort(F.collect_set("collection_id")).alias("held_by"))


def holds(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    return pairs.join(rows.select(*KEY, F.lit(True).alias("_held")), KEY, "left").select(*KEY, F.col("_held").isNotNull().alias("holds"))


def taken_out(rows: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, what was removed with its positions)."""
    return rows.join(images, KEY, "left_anti"), rows.join(images, KEY, "left_semi")


def put_back(rows: DataFrame, removed: DataFrame, images: DataFrame) -> DataFrame:
    """Removed members at their old places, where the image still exists and isn't held again."""
    return rows.unionByName(removed.join(images.select("image_id"), "image_id", "left_semi").join(rows.select(*KEY), KEY, "left_anti").select(*rows.columns))


def removed(collections: DataFrame, rows: DataFrame, root: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(collections left, members left, the removed collections with their depth). The target mark falls to the quick one."""
    gone = subtree(collections, root)
    left = collections.join(gone.select("id"), "id", "left_anti")
    targets = left.agg(F.count_if("is_target").alias("_t"))  # one row
    left = left.crossJoin(F.broadcast(targets)).withColumn("is_target", F.when(F.col("_t") == 0, F.col("is_quick")).otherwise(F.col("is_target"))).drop("_t")
    return left, rows.join(gone.select(F.col("id").alias("collection_id")), "collection_id", "left_anti"), collections.join(gone, "id").orderBy("depth", "id")


def restored(collections: DataFrame, removed: DataFrame, first_id: int) -> DataFrame:
    """Removed collections under fresh ids, their parents among them renamed likewise (ids by depth, then id)."""
    fresh = removed.select(F.col("id").alias("_old"), (F.lit(first_id) + F.row_number().over(Window.orderBy("depth", "id")) - 1).cast("long").alias("_new"))  # one removed subtree
    parents = fresh.select(F.col("_old").alias("parent_id"), F.col("_new").alias("_parent"))
    moved = removed.join(fresh, removed["id"] == fresh["_old"]).join(parents, "parent_id", "left")
    moved = moved.withColumn("id", F.col("_new")).withColumn("parent_id", F.coalesce("_parent", "parent_id"))
    return collections.unionByName(moved.select(*collections.columns))
