"""Volumes, backups, viewports and formats as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .paths import mount_unescaped


def plain_path(path: Column) -> Column:
    """A Windows path without the prefix that turns parsing off."""
    return F.when(path.startswith("\\\\?\\UNC\\"), F.concat(F.lit("\\\\"), F.substr(path, F.lit(9)))).when(path.startswith("\\\\?\\"), F.substr(path, F.lit(5))).otherwise(path)


def share_of(root: Column) -> tuple[Column, Column]:
    """Host and share of a network root; both null for local devices and for a host alone."""
    local = ~root.startswith("\\\\") | root.startswith("\\\\?\\") | root.startswith("\\\\.\\")
    parts = F.filter(F.split(F.substr(root, F.lit(3)), r"\\"), lambda p: p != "")
    fine = ~local & (F.size(parts) >= 2)
    return F.when(fine, F.get(parts, F.lit(0))), F.when(fine, F.get(parts, F.lit(1)))


def mounts_of(paths: DataFrame, mounts: DataFrame, levels: int = 64) -> DataFrame:
    """``paths`` (id, path) with the device and mount point of the longest mount that holds the path.

    mounts: (device, mount), octal escapes as the system writes them. A path
    meets its own prefixes only (an equi-join), not every mount.
    """
    own = mounts.select(mount_unescaped(F.col("device")).alias("device"), F.regexp_replace(mount_unescaped(F.col("mount")), r"(?<=.)/$", "").alias("mount"))
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.when(n == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")))
    met = paths.select("id", F.explode(F.array_distinct(ups)).alias("mount")).join(own, "mount")
    best = met.groupBy("id").agg(F.max_by(F.struct("device", "mount"), F.length("mount")).alias("b"))
    return paths.join(best, "id", "left").select("id", "path", F.col("b.device").alias("device"), F.col("b.mount").alias("mount"))


def stamp(seconds: Column) -> Column:
    """YYYY-MM-DDTHH-MM-SSZ, as snapshots are named."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH-mm-ss'Z'")


def is_snapshot(name: Column, stem: str, suffix: str) -> Column:
    """Whether a file is a snapshot of this store: the stem, a stamp, the suffix."""
    shape = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}-[0-9]{2}-[0-9]{2}Z"
    return name.rlike(rf"^\Q{stem}\E-{shape}\Q{suffix}\E$")


def pruned(files: DataFrame, stem: str, suffix: str, keep: int = 10) -> DataFrame:
    """The snapshots (name) to remove so that the newest ``keep`` stay; other files are never named."""
    ours = files.where(is_snapshot(F.col("name"), stem, suffix))
    newest = ours.orderBy(F.col("name").desc()).limit(keep)
    oldest = newest.agg(F.min("name").alias("_least"), F.count("*").alias("_n"))
    return ours.crossJoin(F.broadcast(oldest)).where((F.col("_n") == keep) & (F.col("name") < F.col("_least"))).select("name")  # one row


def export_format(extension: Column) -> Column:
    """The format that a file extension asks for; null for others."""
    e = F.lower(extension)
    return F.when(e.isin("jpg", "jpeg"), "jpeg").when(e == "png", "png16").when(e.isin("tif", "tiff"), "tiff16")


def orientation(flip: Column) -> Column:
    """How an image is turned; mirrored ones count as upright."""
    return F.when(flip == 3, "rotate180").when(flip == 5, "rotate270").when(flip == 6, "rotate90").otherwise("as_shot")


def image_at(center: Column, screen: Column, size: Column, scale: Column) -> Column:
    """The image coordinate under a screen coordinate, along one axis."""
    return center + (screen - size / 2.0) / scale


def visible_span(center: Column, size: Column, scale: Column, extent: Column) -> tuple[Column, Column]:
    """The part of an axis that a viewport shows."""
    return F.greatest(image_at(center, F.lit(0.0), size, scale), F.lit(0.0)), F.least(image_at(center, size.cast("double"), size, scale), extent.cast("double"))


def fit_scale(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """The scale at which an image fills a canvas; null for a canvas without area."""
    return F.when((width != 0) & (height != 0), F.least(width / image_width, height / image_height))


def clamped_center(center: Column, size: Column, scale: Column, extent: Column, cropping: bool = False) -> Column:
    """The centre that leaves no empty canvas beside the image, if it can; while cropping any place on the image."""
    if cropping:
        return F.least(F.greatest(center, F.lit(0.0)), extent.cast("double"))
    half = F.when(scale > 0, size / (scale * 2.0)).otherwise(0.0)
    return F.when(half * 2 >= extent, extent / 2.0).otherwise(F.least(F.greatest(center, half), extent - half))


def max_level(width: Column, height: Column, tile: int) -> Column:
    """Halvings until the longer edge fits a tile."""
    edge = F.greatest(width, height).cast("double")
    return F.when(edge <= tile, 0).otherwise(F.least(F.ceil(F.log2(edge / float(tile)) - 1e-12), F.lit(255))).cast("int")
