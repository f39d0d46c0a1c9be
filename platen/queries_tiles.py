"""Queries over tiles by numpy: tested against plain versions, as SQL can't express them (but for the curve)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import tiles as T
from .standins import Library

QUERIES: dict = {}
ORACLES: dict = {}


def _apply(name: str, run):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = T.mapped(Library(spark, sf_dir).raw("embeddings"), "vec_id", "embedding", 8, 8, run)
        return made.select("vec_id", F.posexplode("t").alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)

    QUERIES[name] = f


_apply("tile_demosaic", lambda a: T.demosaiced(a + 1.0))
_apply("tile_local_laplacian", T.local_laplacian)
_apply("tile_straighten", lambda a: T.warped(a, T.rotation(5.0, 8, 8, 1.1), 8, 8))
_apply("tile_keystone", lambda a: T.warped(a, T.homography(np.array([[1, 0.05, 0], [0, 1.1, 0], [0, 0.01, 1]])), 8, 8))
_apply("tile_heal", lambda a: T.healed(a + 1.0, (2.0, 2.0), (5.0, 5.0), 2.0))
_apply("tile_curve", lambda a: T.looked_up(np.clip(a + 0.5, 0, 1), T.curve_lut([(0, 0), (0.3, 0.2), (0.7, 0.85), (1, 1)])))

_POINTS = [(0.0, 0.0), (0.25, 0.2), (0.5, 0.6), (1.0, 1.0)]
ORACLES["curve_linear"] = """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS pk, round(CASE WHEN v < 0.25 THEN v * 0.8::DOUBLE WHEN v < 0.5 THEN 0.2::DOUBLE + (v - 0.25::DOUBLE) * 1.6::DOUBLE
ELSE 0.6::DOUBLE + (v - 0.5::DOUBLE) * 0.8::DOUBLE END + 1e-9::DOUBLE, 5) + 0.0 AS v FROM (SELECT *, l_quantity / 50 AS v FROM lineitem)"""


def curve_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve through points, straight between them, as one expression."""
    v = F.col("l_quantity") / 50
    out = F.lit(_POINTS[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(_POINTS, _POINTS[1:]))):
        out = F.when(v < x1, y0 + (v - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    li = Library(spark, sf_dir).raw("lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), (F.round(out + 1e-9, 5) + 0.0).alias("v"))


QUERIES["curve_linear"] = curve_linear
