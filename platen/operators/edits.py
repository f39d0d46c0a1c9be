"""Edit documents: versions, history, groups, presets, snapshots, virtual copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(json: str = "json") -> Column:
    """The hash of the stored bytes; documents are stored in one canonical spelling."""
    return F.sha2(F.col(json), 256)


def versions(saved: DataFrame, order: list[str], content: str = "content") -> DataFrame:
    """Saves numbered from 1 per image; one equal to the save before it makes no version."""
    w = Window.partitionBy("image_id").orderBy(*order)
    old = F.lag(content).over(w)
    fresh = saved.withColumn("_old", old).where(~F.col("_old").eqNullSafe(F.col(content))).drop("_old")
    return fresh.withColumn("version", F.row_number().over(w))


def appended(edits: DataFrame, saves: DataFrame, content: str = "content") -> DataFrame:
    """One new save per image after its head, unless equal to the head's content."""
    head = latest(edits, content).select("image_id", F.col("version").alias("_v"), F.col(content).alias("_c"))
    new = saves.join(head, "image_id", "left").where(~F.col(content).eqNullSafe(F.col("_c")))
    return new.withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v", "_c")


def latest(edits: DataFrame, content: str = "content") -> DataFrame:
    """Each image's newest version: a partial aggregate, no sort."""
    return edits.groupBy("image_id").agg(F.max("version").alias("version"), F.max_by(content, "version").alias(content))


def history(edits: DataFrame, content: str = "content") -> DataFrame:
    steps = F.array_sort(F.collect_list(F.struct("version", content)))
    text = F.transform(steps, lambda s: F.concat_ws(":", s["version"].cast("string"), s[content]))
    return edits.groupBy("image_id").agg(F.array_join(text, ",").alias("history"))


def snapshot_states(snapshots: DataFrame, edits: DataFrame) -> DataFrame:
    return snapshots.join(edits, ["image_id", "version"])


def adopt(state: str, look: str, groups: list[str]) -> Column:
    """``state`` with the named groups taken whole from ``look``."""
    out = F.col(state)
    for g in groups:
        out = out.withField(g, F.col(f"{look}.{g}"))
    return out


def touched(state: str, defaults: dict[str, Column]) -> Column:
    """Names of the groups that differ from their defaults, in order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{state}.{g}").eqNullSafe(d), g) for g, d in defaults.items()]))


def pasted(heads: DataFrame, look: Column, content: str = "content") -> DataFrame:
    """New versions where the pasted look changes something."""
    return heads.where(~F.col(content).eqNullSafe(look)).select("image_id", (F.col("version") + 1).alias("version"), look.alias(content))


def profiles_of(images: DataFrame, files: DataFrame, profiles: DataFrame) -> DataFrame:
    """Images with the profile of their camera; null makes or models meet none."""
    f = files.select(F.col("id").alias("file_id"), F.col("camera_make").alias("make"), F.col("camera_model").alias("model"))
    return images.join(f, "file_id").join(profiles, ["make", "model"])


def next_free(used: DataFrame, key: str, number: str) -> DataFrame:
    """The least number from 1 that no row of the key uses (a gap or the one after the last)."""
    own = used.select(key, number).distinct()
    rank = F.row_number().over(Window.partitionBy(key).orderBy(number))
    # Up to the first gap the numbers equal their ranks.
    run = own.where(F.col(number) >= 1).withColumn("_r", rank).groupBy(key).agg(F.count_if(F.col(number) == F.col("_r")).alias("_n"))
    return used.select(key).distinct().join(run, key, "left").select(key, (F.coalesce("_n", F.lit(0)) + 1).cast("long").alias("n"))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows take the place of old ones of the same key."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def validated(states: DataFrame, ranges: dict[str, tuple[float, float]], newest: int = 1) -> DataFrame:
    """``states`` (struct column ``state``) with ``faults``: the names of what is out of range, null or too new."""
    checks = [F.when(F.col("state.schema_version") > newest, F.lit("schema_version"))]
    for path, (low, high) in ranges.items():
        c = F.col(f"state.{path}").cast("double")
        checks.append(F.when(c.isNull() | F.isnan(c) | ~c.between(low, high), F.lit(path)))
    return states.withColumn("faults", F.array_compact(F.array(*checks)))


def parsed(edits: DataFrame, schema: str, json: str = "json") -> DataFrame:
    """Edit documents as structs; text that is no document has a null state and fails no other."""
    state = F.from_json(json, schema, {"mode": "PERMISSIVE"})
    return edits.withColumn("state", F.when(F.try_parse_json(F.col(json)).isNotNull(), state))
