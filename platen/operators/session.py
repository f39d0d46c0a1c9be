"""The event-sourced develop session: coalescing, undo and redo, stale results, debounce, tile plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: steps kept for undo.
DEPTH = 200


def steps(commands: DataFrame, order: list[str], key: list[str] = ["user_id"], same: list[str] = ["event_type"], breaks: Column | None = None) -> DataFrame:
    """Commands grouped into undo steps: a run of the same command is one step until a break."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.lit(False)
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    if breaks is not None:
        new = new | F.coalesce(F.lag(breaks).over(w), F.lit(True))
    return commands.withColumn("step", F.sum(F.when(new, 1).otherwise(0)).over(w))


def debounced(writes: DataFrame, order: str, wait: int, key: str = "user_id") -> DataFrame:
    """The saves that happen: a change with no later one of its key within ``wait`` milliseconds.

    Times are rounded, not cut, to whole milliseconds (halves away from the
    epoch) before they are compared; a change without a time comes last.
    """
    at = F.round(F.unix_micros(F.col(order).cast("timestamp")), -3)
    later = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last(), F.col("event_id").asc_nulls_last())
    return writes.withColumn("_gap", F.lead(at).over(later) - at).where(F.col("_gap").isNull() | (F.col("_gap") >= wait * 1000)).drop("_gap")


def current(results: DataFrame, heads: DataFrame, key: str = "tile") -> DataFrame:
    """Results of their tile's current generation; late ones are rejected."""
    return results.join(heads, [key, "generation"], "left_semi")


def folded(commands: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Applies each session's commands in order: rows (key, seq, value, past, future).

    set changes the value and clears what was undone; undo and redo move
    between values. A session's commands are one user's and are folded in one
    pass; only the last DEPTH values are kept.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}
        for f in frames:
            values, pasts, futures = [], [], []
            for k, command, value in zip(f["_k"], f["command"], f["value"]):
                now, past, future = state.setdefault(k, [0.0, [], []])
                if command == "set":
                    past.append(now)
                    del past[:-DEPTH]
                    future.clear()
                    now = value
                elif command == "undo" and past:
                    future.append(now)
                    now = past.pop()
                elif command == "redo" and future:
                    past.append(now)
                    now = future.pop()
                state[k][0] = now
                values.append(now)
                pasts.append(len(past))
                futures.append(len(future))
                if len(state) > 4096:  # sorted by session: those before are over
                    state = {k: state[k]}
            yield pd.DataFrame({key: f["_k"], "seq": f["seq"], "value": values, "past": pasts, "future": futures})

    kind = commands.schema[key].dataType.simpleString()
    rows = commands.select(F.col(key).alias("_k"), "seq", "command", F.col("value").cast("double").alias("value"), *order)
    dealt = rows.repartition("_k").sortWithinPartitions("_k", *order)
    return dealt.select("_k", "seq", "command", "value").mapInPandas(fold, f"{key} {kind}, seq long, value double, past int, future int")


def level_of(scale: Column, most: int) -> Column:
    """The pyramid level for a scale: floor(log2(1 / scale)) within 0..most; 0 at full size, most if not positive."""
    return F.when(scale <= 0, most).when(scale >= 1, 0).otherwise(F.least(F.greatest(F.floor(F.log2(1.0 / scale)), F.lit(0)), F.lit(most))).cast("int")


def visible_tiles(views: DataFrame, tile: int = 256) -> DataFrame:
    """Rows of the tiles (tx, ty) that each view's rectangle touches, with their distance from its centre."""
    xs = F.sequence(F.floor(F.col("left") / tile).cast("int"), F.floor((F.col("right") - 1) / tile).cast("int"))
    ys = F.sequence(F.floor(F.col("top") / tile).cast("int"), F.floor((F.col("bottom") - 1) / tile).cast("int"))
    t = views.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys))
    dx = (F.col("tx") + 0.5) * tile - (F.col("left") + F.col("right")) / 2
    dy = (F.col("ty") + 0.5) * tile - (F.col("top") + F.col("bottom")) / 2
    return t.select("view", "tx", "ty", (dx * dx + dy * dy).alias("distance"))


def pending(tiles: DataFrame, rendered: DataFrame) -> DataFrame:
    """Visible tiles without a result, in order from the centre out."""
    left = tiles.join(rendered.select("view", "tx", "ty"), ["view", "tx", "ty"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("view").orderBy("distance", "tx", "ty")))


#: The develop stages in order, their domain, and whether previews run them.
STAGES = (
    ("Decode", "Sensor", True), ("SpotRemoval", "Sensor", True), ("Demosaic", "Sensor", True),
    ("LensCorrection", "SceneLinear", True), ("WhiteBalance", "SceneLinear", True), ("CameraProfile", "SceneLinear", True),
    ("SceneLinearOps", "SceneLinear", True), ("LocalAdjustments", "SceneLinear", True), ("ToneMap", "ToneMap", True),
    ("DisplayReferredOps", "DisplayReferred", True), ("ColourAdjustments", "DisplayReferred", True), ("Look", "DisplayReferred", True),
    ("OutputTransform", "Output", True), ("Export", "Output", False),
)


def stages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(STAGES)], "place int, stage string, domain string, preview boolean")
