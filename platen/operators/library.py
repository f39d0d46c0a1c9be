"""The library view: filters, the ordered sequence, tallies, folder roll-ups, point look-ups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled


@dataclass(frozen=True)
class Filter:
    """What a view admits; an unset axis admits everything, and so does min_rating 0."""

    flag: str | None = None
    unflagged: bool = False
    min_rating: int = 0
    colour: str | None = None

    def is_everything(self) -> bool:
        return self == Filter() or (self.flag is None and not self.unflagged and self.min_rating <= 0 and self.colour is None)

    def column(self) -> Column:
        """The filter as one predicate over images; a null judgement never meets a set axis."""
        parts = []
        if self.unflagged:
            parts.append(F.col("flag").isNull())
        elif self.flag is not None:
            parts.append(F.col("flag") == self.flag)
        if self.min_rating > 0:
            parts.append(F.col("rating") >= self.min_rating)
        if self.colour is not None:
            parts.append(F.col("colour_label") == self.colour)
        out = F.lit(True)
        for p in parts:
            out = out & p
        return out




def path_of() -> Column:
    """mount/relative/file with doubled slashes made single; an unknown mount is empty."""
    joined = F.concat_ws("/", F.coalesce("last_mount_path", F.lit("")), "relative_path", "filename")
    return F.regexp_replace(joined, "/{2,}", "/")


def sequence(images: DataFrame, files: DataFrame, folders: DataFrame, volumes: DataFrame, filter: Filter = Filter(), within: DataFrame | None = None) -> DataFrame:
    """Present images with their files, folders and volumes that pass the filter, unordered.

    within: folder ids (column ``id``) that a file's folder must be among.
    """
    files = files.where(~F.col("missing"))
    if within is not None:
        files = files.join(within.select(F.col("id").alias("folder_id")), "folder_id", "left_semi")
    f = files.select(F.col("id").alias("file_id"), "folder_id", "filename", "captured_at", "size")
    d = folders.select(F.col("id").alias("folder_id"), "volume_id", "relative_path")
    v = volumes.select(F.col("id").alias("volume_id"), "last_mount_path")
    return images.where(filter.column()).withColumnRenamed("id", "image_id").join(f, "file_id").join(d, "folder_id").join(v, "volume_id").withColumn("path", path_of())


def ranked(df: DataFrame, order: list[Column], name: str = "place", start: int = 1) -> DataFrame:
    """``df`` with its row number in a total order, without gathering rows in one task.

    Rows are dealt by ranges of the order and sorted there; a row's number is
    its place in its range after the rows of the ranges before. The dealt rows
    are settled first, as both passes must see the same ranges.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = settled(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_at")))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    return dealt.join(F.broadcast(before), "_range").withColumn(name, F.col("_at") + F.col("_before") + start).drop("_range", "_at", "_before")


def in_order(seen: DataFrame, ties: list[str] = (), name: str = "place") -> DataFrame:
    return ranked(seen, [F.col("captured_at").asc_nulls_last(), F.col("filename").asc(), F.col("image_id").asc(), *[F.col(c).asc() for c in ties]], name)


def admitted(images: DataFrame, filter: Filter) -> DataFrame:
    """Ids that pass; images of missing files are not left out here."""
    return images.where(filter.column()).select("id")


def matches(images: DataFrame, files: DataFrame, filter: Filter) -> DataFrame:
    """Rows (id, found): whether each image passes and its file is there."""
    present = files.where(~F.col("missing")).select(F.col("id").alias("file_id"), F.lit(True).alias("_there"))
    passes = F.coalesce(filter.column(), F.lit(False)) & F.col("_there").isNotNull()
    return images.join(present, "file_id", "left").groupBy("id").agg(F.max(passes).alias("found"))


def camera_label(make: str = "camera_make", model: str = "camera_model") -> Column:
    """Model alone where it begins with the make (whatever the case), else make and model; null without either."""
    both = F.when(F.startswith(F.lower(F.col(model)), F.lower(F.col(make))), F.col(model)).otherwise(F.concat_ws(" ", make, model))
    return F.when(F.col(make).isNull(), F.col(model)).when(F.col(model).isNull(), F.col(make)).otherwise(both)


def label_of(filename: str = "filename", copy_name: str = "copy_name") -> Column:
    return F.concat_ws(" · ", filename, copy_name)


def stem_of(filename: str = "filename", copy_name: str = "copy_name") -> Column:
    """The file's name without its extension, and a copy's name made fit for a file."""
    stem = F.regexp_replace(F.col(filename), r"\.[^.]*$", "")
    safe = F.regexp_replace(F.col(copy_name), r"[\s/\\:]", "-")
    return F.when(F.col(copy_name).isNull(), stem).otherwise(F.concat(stem, F.lit("-"), safe))


def tally(images: DataFrame, files: DataFrame) -> DataFrame:
    """One row: images on present files, and how many are picked and rejected."""
    present = files.where(~F.col("missing")).select(F.col("id").alias("file_id"))
    return images.join(present, "file_id", "left_semi").agg(
        F.count("*").alias("total"), F.count_if(F.col("flag") == "pick").alias("picked"), F.count_if(F.col("flag") == "reject").alias("rejected")
    )


def missing_count(images: DataFrame, files: DataFrame) -> DataFrame:
    gone = files.where("missing").select(F.col("id").alias("file_id"))
    return images.join(gone, "file_id", "left_semi").agg(F.count("*").alias("missing"))


def closure(nodes: DataFrame, most: int = 64) -> DataFrame:
    """Rows (ancestor, id, depth) for each node and itself and all above it, loops ending where they close.

    Each round doubles the distance climbed, so a forest of depth d takes
    log2(d) joins; ``most`` bounds the rounds.
    """
    own = nodes.select(F.col("id"), F.col("parent_id").alias("ancestor"))
    known = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    up = own.where(F.col("ancestor").isNotNull() & (F.col("ancestor") != F.col("id"))).join(nodes.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id", "ancestor", F.lit(1).alias("depth"))
    known = settled(known.unionByName(up))
    size = known.count()
    for _ in range(most):
        step = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.id")).select(F.col("a.id").alias("id"), F.col("b.ancestor").alias("ancestor"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        known = settled(step.groupBy("id", "ancestor").agg(F.min("depth").alias("depth")))
        now = known.count()
        if now == size:
            break
        size = now
    return known


def folder_tree(folders: DataFrame, files: DataFrame, images: DataFrame) -> DataFrame:
    """Folders with their own and their subtree's images; folders without any are left out, orphans' parents null."""
    present = files.where(~F.col("missing")).select(F.col("id").alias("file_id"), "folder_id")
    own = images.join(present, "file_id").groupBy("folder_id").agg(F.count("*").alias("own"))
    up = closure(folders)
    total = up.join(own, up["id"] == own["folder_id"]).groupBy("ancestor").agg(F.sum("own").alias("total"))
    parents = folders.select(F.col("id").alias("_p"))
    out = folders.join(parents, folders["parent_id"] == F.col("_p"), "left").withColumn("parent_id", F.col("_p")).drop("_p")
    out = out.join(own.withColumnRenamed("folder_id", "id"), "id", "left").join(total.withColumnRenamed("ancestor", "id"), "id")
    return out.select("id", "volume_id", "parent_id", "relative_path", F.coalesce("own", F.lit(0)).cast("long").alias("own"), "total")


def below(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (id, depth) of the ``roots`` (column id) that are nodes and of all below them, at their least depth.

    Walks down from the roots, a join a level, so that the rest of the forest
    is never climbed; a loop ends where it meets what is found already.
    """
    edges = nodes.where(F.col("parent_id").isNotNull()).select("id", "parent_id")
    front = settled(nodes.select("id").join(roots.select("id").distinct(), "id", "left_semi").distinct().withColumn("depth", F.lit(0)))
    found = front
    while not front.isEmpty():
        step = edges.join(front.select(F.col("id").alias("parent_id"), "depth"), "parent_id").groupBy("id").agg((F.min("depth") + 1).alias("depth"))
        front = settled(step.join(found.select("id"), "id", "left_anti"))
        found = found.unionByName(front)
    return found


def subtree(nodes: DataFrame, root: int) -> DataFrame:
    """Ids of a node and all below it, with their depth."""
    return below(nodes, nodes.where(F.col("id") == root).select("id"))


def cells(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """Judgements of the wanted ids (id, ordinal) in the order asked for; defaults where there is no image."""
    facts = images.groupBy("id").agg(F.max("rating").alias("rating"), F.max("flag").alias("flag"), F.max("colour_label").alias("colour_label"))
    return wanted.join(facts, "id", "left").select("ordinal", "id", F.coalesce("rating", F.lit(0)).alias("rating"), F.coalesce("flag", F.lit("none")).alias("flag"), F.coalesce("colour_label", F.lit("none")).alias("colour_label"))


def narrowed(places: DataFrame, standing: int) -> DataFrame:
    """The cursor under a new filter: the first admitted place at or after the old one, else the last."""
    return places.agg(F.coalesce(F.min(F.when(F.col("place") >= standing, F.col("place"))), F.max("place")).alias("cursor"))


def page(seen: DataFrame, start: int, size: int, place: str = "place") -> DataFrame:
    return seen.where(F.col(place).between(start, start + size - 1))
