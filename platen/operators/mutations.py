"""Writes to the catalog as tables before and after: judgements, names, and rows forgotten and put back.

Each takes a whole batch of wishes at once and returns new tables; what cannot
be done is returned beside them with its reason, never dropped in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import name_key

MOST_STARS = 5


def judged(images: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``images`` with the rating, flag and colour_label of ``marks`` (id, one row each), and the marks refused (id, reason).

    A mark replaces all three, nulls included. Ratings beyond MOST_STARS and
    marks of unknown images are refused.
    """
    three = ("rating", "flag", "colour_label")
    named = marks.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in three], (F.coalesce("rating", F.lit(0)) > MOST_STARS).alias("_beyond"))
    met = images.join(named.where("NOT _beyond").withColumn("_met", F.lit(True)), "id", "left")
    new = met.select(*[F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in three else F.col(c) for c in images.columns])
    unknown = named.where("NOT _beyond").join(images.select("id"), "id", "left_anti").select("id", F.lit("no such image").alias("reason"))
    return new, named.where("_beyond").select("id", F.lit("too many stars").alias("reason")).unionByName(unknown)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def created(collections: DataFrame, wishes: DataFrame) -> DataFrame:
    """``collections`` (id, parent_id, name, name_key) with a row for each wish (n, parent_id, name); n counts from 1 and gives the id.

    A wish without a name makes none; its number stays unused.
    """
    last = F.broadcast(collections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last")))  # one row
    name = _trimmed(F.col("name"))
    new = wishes.where(name != "").crossJoin(last).select((F.col("_last") + F.col("n")).cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"), name.alias("name"), name_key(name).alias("name_key"))
    return collections.select("id", "parent_id", "name", "name_key").unionByName(new)


def renamed(collections: DataFrame, names: DataFrame) -> DataFrame:
    """``collections`` with the names of ``names`` (id, name) that are not blank; the key follows the name."""
    asked = names.select("id", _trimmed(F.col("name")).alias("_name")).where("_name <> ''")
    met = collections.join(asked, "id", "left")
    new = F.coalesce("_name", "name")
    return met.select("id", "parent_id", new.alias("name"), F.when(F.col("_name").isNotNull(), name_key(F.col("_name"))).otherwise(F.col("name_key")).alias("name_key"))


def forgotten(rows: DataFrame, asked: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays of ``rows``, the rows that ``asked`` names by ``keys``), the second whole, so that it can be put back."""
    named = asked.select(*keys).distinct()
    return rows.join(named, keys, "left_anti"), rows.join(named, keys, "left_semi")


def put_back(rows: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with those of ``gone`` whose keys nothing has taken since, and those refused."""
    held = rows.select(*keys)
    return rows.unionByName(gone.join(held, keys, "left_anti").select(*rows.columns)), gone.join(held, keys, "left_semi")


def chosen(profiles: DataFrame, cameras: DataFrame) -> DataFrame:
    """Each of ``cameras`` (make, model) with the path of its profile; null for none."""
    return cameras.join(profiles.select("make", "model", "path"), ["make", "model"], "left")


def marked(sequence: DataFrame, ids: DataFrame) -> DataFrame:
    """The places of the marked images that the sequence (id, position) shows."""
    return sequence.join(ids.select("id").distinct(), "id", "left_semi").select("id", "position")
