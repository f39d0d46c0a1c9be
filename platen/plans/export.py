"""Bulk export plans: the selection, output names, sizes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import families


def fit(width: Column, height: Column, most: int | None) -> tuple[Column, Column]:
    """The size within ``most`` on the longer edge; never larger than the source, at least one pixel."""
    if most is None:
        return width, height
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(c * scale + 0.5).cast("int")) for c in (width, height))  # type: ignore[return-value]


def names(chosen: DataFrame, stem: str = "stem", extension: str = "jpg") -> DataFrame:
    """Distinct output names: who comes first by id has the name it wants, whoever finds it taken counts on from -2 until one is free.

    Compared without case. Each name depends on those given before it, but only
    within a family (``families``); families are dealt to tasks, and a task reads
    its own in order and keeps the names of one at a time.
    """

    def run(batches):
        family, taken, after = None, set(), {}
        for batch in batches:
            out = []
            for f, want in zip(batch.column("_f").to_pylist(), batch.column("_stem").to_pylist()):
                if f != family:
                    family, taken, after = f, set(), {}
                low = (want or "").lower()
                n, name = after.get(low, 1), want
                while n > 1 and f"{low}-{n}" in taken or n == 1 and low in taken:
                    n += 1
                after[low] = n + 1 if n > 1 else 1
                name = want if n == 1 else f"{want}-{n}"
                taken.add((name or "").lower())
                out.append(None if name is None else f"{name}.{extension}")
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "output"])

    rows = chosen.select(F.col("id").cast("long").alias("id"), F.col(stem).alias("_stem"), families(F.lower(stem)).alias("_f"))
    dealt = rows.repartition("_f").sortWithinPartitions("_f", "id", "_stem")
    return chosen.join(dealt.mapInArrow(run, "id long, output string"), "id")


def gathered(ordered: DataFrame, edits: DataFrame, profiles: DataFrame, default: str) -> DataFrame:
    """A selection (id, ordinal, camera) with each image's newest edit, or the default, and its profile if it has one.

    An image that the list names twice appears once, at its first place.
    """
    once = ordered.groupBy("id").agg(F.min_by(F.struct(*[c for c in ordered.columns if c != "id"]), "ordinal").alias("_r")).select("id", "_r.*")
    out = once.join(edits.select(F.col("image_id").alias("id"), "content"), "id", "left").join(profiles, "camera", "left")
    return out.withColumn("content", F.coalesce("content", F.lit(default)))
