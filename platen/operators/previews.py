"""Rendered previews: what is outstanding, what covers a size, upserts and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The levels with a bounded edge.
LEVELS = (("thumb", 256), ("small", 1024), ("standard", 2560))


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level string, edge int")


def outstanding(heads: DataFrame, levels: DataFrame, previews: DataFrame, renderer: str) -> DataFrame:
    """Per image the levels without a preview of its head's hash by this renderer, smallest first."""
    fresh = previews.where(F.col("renderer") == renderer).select("image_id", "level", "hash")
    wanted = heads.crossJoin(F.broadcast(levels)).join(fresh, ["image_id", "level", "hash"], "left_anti")  # a handful of levels
    names = F.transform(F.array_sort(F.collect_list(F.struct("edge", "level"))), lambda s: s["level"])
    return wanted.groupBy("image_id").agg(F.array_join(names, ",").alias("wanted"))


def covering(previews: DataFrame, heads: DataFrame, renderer: str, needed: int) -> DataFrame:
    """Per image the smallest fresh preview of at least the needed edge."""
    edge = F.greatest("width", "height")
    fit = previews.where((F.col("renderer") == renderer) & (edge >= needed)).join(heads, ["image_id", "hash"])
    return fit.groupBy("image_id").agg(F.min_by("level", edge).alias("level"), F.min(edge).alias("edge"))


def tally(previews: DataFrame) -> DataFrame:
    return previews.agg(F.count("*").alias("previews"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def sweep(listed: DataFrame, known: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """One row: files of the suffix that no preview names, and their bytes."""
    stray = listed.where(F.endswith("path", F.lit(suffix))).join(known, "path", "left_anti")
    return stray.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed"))


def recorded(previews: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (image, level)."""
    return previews.join(new.select("image_id", "level"), ["image_id", "level"], "left_anti").unionByName(new)


def relative_path(image: str = "image_id", level: str = "level", hash: str = "hash") -> Column:
    """Two hex digits of the id, then id, level and the hash's first twelve digits."""
    folder = F.lpad(F.lower(F.hex(F.col(image) % 256)), 2, "0")
    return F.concat(folder, F.lit("/"), F.concat_ws("-", F.col(image).cast("string"), level, F.substring(hash, 1, 12)), F.lit(".jpg"))
