"""Rasters as arrays, row by row of a table: stencils, pyramids, histograms, quantiles, masks.

A tile is an array<double> in row-major order. Stencils are expressions over
the array (no shuffle, no explosion); statistics over pixels are partial
aggregates over (bin) keys of a fixed number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.colour import clamp, smoothstep


def place(at: Column, size: int, border: str) -> Column:
    """A coordinate brought inside 0..size-1: clamp to the edge, or mirror about it (the edge not repeated)."""
    if border == "clamp":
        return F.least(F.greatest(at, F.lit(0)), F.lit(size - 1))
    folded = F.pmod(at, F.lit(2 * (size - 1)))
    return F.least(folded, F.lit(2 * (size - 1)) - folded)


def _pixels(tile: Column, width: int, height: int, f) -> Column:
    """An array of f(x, y, read) for each pixel; read(x, y) gives a value, null outside."""

    def read(x: Column, y: Column) -> Column:
        return F.get(tile, y * width + x)

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: f(i % width, F.floor(i / width).cast("int"), read))


def stencil(tile: Column, width: int, height: int, taps: list[tuple[int, int, float]], border: str = "clamp") -> Column:
    """A weighted sum of neighbours; border drop leaves out what lies outside and divides by what counts."""

    def at(x: Column, y: Column, read) -> Column:
        if border == "drop":
            inside = [(F.when((x + dx).between(0, width - 1) & (y + dy).between(0, height - 1), F.lit(w)).otherwise(0.0), dx, dy) for dx, dy, w in taps]
            total, weight = F.lit(0.0), F.lit(0.0)
            for w, dx, dy in inside:
                total = total + F.when(w != 0, w * read(x + dx, y + dy)).otherwise(0.0)
                weight = weight + w
            return total / weight
        out = F.lit(0.0)
        for dx, dy, w in taps:
            out = out + read(place(x + dx, width, border), place(y + dy, height, border)) * w
        return out

    return _pixels(tile, width, height, at)


def box(reach: int) -> list[tuple[int, int, float]]:
    n = (2 * reach + 1) ** 2
    return [(dx, dy, 1 / n) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]


def gaussian(reach: int, sigma: float) -> list[tuple[int, int, float]]:
    raw = {(dx, dy): math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma)) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)}
    total = sum(raw.values())
    return [(dx, dy, w / total) for (dx, dy), w in raw.items()]


def bilateral(tile: Column, width: int, height: int, reach: int, sigma: float, spread: float, border: str = "clamp") -> Column:
    """Neighbours weighted by distance and by how near their values are."""

    def at(x: Column, y: Column, read) -> Column:
        here = read(x, y)
        total, weight = F.lit(0.0), F.lit(0.0)
        for dy in range(-reach, reach + 1):
            for dx in range(-reach, reach + 1):
                v = read(place(x + dx, width, border), place(y + dy, height, border))
                w = F.exp(-F.pow((v - here) / spread, F.lit(2.0)) / 2) * math.exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))
                total, weight = total + v * w, weight + w
        return total / weight

    return _pixels(tile, width, height, at)


SOBEL_X = [(-1, -1, -1.0), (1, -1, 1.0), (-1, 0, -2.0), (1, 0, 2.0), (-1, 1, -1.0), (1, 1, 1.0)]
SOBEL_Y = [(-1, -1, -1.0), (0, -1, -2.0), (1, -1, -1.0), (-1, 1, 1.0), (0, 1, 2.0), (1, 1, 1.0)]


def sobel(tile: Column, width: int, height: int, border: str = "clamp") -> Column:
    """Gradient magnitudes."""
    return F.zip_with(stencil(tile, width, height, SOBEL_X, border), stencil(tile, width, height, SOBEL_Y, border), lambda a, b: F.hypot(a, b))


def unsharp(tile: Column, width: int, height: int, amount: float, reach: int = 2, sigma: float = 0.7) -> Column:
    soft = stencil(tile, width, height, gaussian(reach, sigma))
    return F.zip_with(tile, soft, lambda a, b: a + (a - b) * amount)


def mosaic_reduced(tile: Column, width: int, height: int) -> Column:
    """Halves a mosaic keeping its 2x2 phases: each 4x4 block gives the means of its like-phased four; remainders drop."""
    w, h = width // 4 * 2, height // 4 * 2

    def at(i: Column) -> Column:
        x, y = i % w, F.floor(i / w).cast("int")
        bx, by = F.floor(x / 2).cast("int") * 4 + x % 2, F.floor(y / 2).cast("int") * 4 + y % 2
        return (F.get(tile, by * width + bx) + F.get(tile, by * width + bx + 2) + F.get(tile, (by + 2) * width + bx) + F.get(tile, (by + 2) * width + bx + 2)) / 4

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), at)


#: The five-tap filter of image pyramids.
FIVE = (1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16)


def downsampled(tile: Column, width: int, height: int) -> Column:
    """Five taps either way, every second pixel kept, sizes rounded up, edges clamped."""
    w, h = -(-width // 2), -(-height // 2)

    def at(i: Column) -> Column:
        x, y = (i % w) * 2, F.floor(i / w).cast("int") * 2
        out = F.lit(0.0)
        for b, wy in enumerate(FIVE):
            for a, wx in enumerate(FIVE):
                out = out + F.get(tile, place(y + (b - 2), height, "clamp") * width + place(x + (a - 2), width, "clamp")) * (wx * wy)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), at)


def upsampled(tile: Column, width: int, height: int, to_width: int, to_height: int) -> Column:
    """Zeros between the pixels, five taps doubled, edges clamped."""

    def at(i: Column) -> Column:
        x, y = i % to_width, F.floor(i / to_width).cast("int")
        out = F.lit(0.0)
        for b, wy in enumerate(FIVE):
            for a, wx in enumerate(FIVE):
                px, py = place(x + (a - 2), to_width, "clamp"), place(y + (b - 2), to_height, "clamp")
                there = (px % 2 == 0) & (py % 2 == 0)
                out = out + F.when(there, F.get(tile, F.least(F.floor(py / 2).cast("int"), F.lit(height - 1)) * width + F.least(F.floor(px / 2).cast("int"), F.lit(width - 1)))).otherwise(0.0) * (4 * wx * wy)
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(to_width * to_height - 1)), at)


def laplacian(fine: Column, coarse: Column, width: int, height: int) -> Column:
    """What the coarse level, brought up again, lacks of the fine one."""
    return F.zip_with(fine, upsampled(coarse, -(-width // 2), -(-height // 2), width, height), lambda a, b: a - b)


def normalised(sample: Column, black: Column, white: float) -> Column:
    return (sample - black) / (white - black)


# --- statistics ---------------------------------------------------------------------------------


def histogram(df: DataFrame, channels: dict[str, Column], bins: int = 256) -> DataFrame:
    """Rows (channel, bin, n) of values in 0..bins-1: one pass, counted before any shuffle."""
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("channel"), v.cast("int").alias("bin")) for k, v in channels.items()])).alias("s")
    return df.select(both).select("s.*").where(F.col("bin").between(0, bins - 1)).groupBy("channel", "bin").agg(F.count("*").alias("n"))


def quantile_bins(counts: DataFrame, wanted: list[float], strict: bool, size: float, start: float = 0.0) -> DataFrame:
    """Rows (q, bin, value): the first bin whose running count passes floor(total * q).

    strict: the count must exceed it (else reach it). ``counts`` has a row a bin.
    """
    run = F.sum("n").over(Window.orderBy("bin"))  # bins are of a fixed number
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    seen = counts.withColumn("_seen", run).withColumn("_total", total)
    asked = seen.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in wanted])))
    need = F.floor(F.col("_total") * F.col("q"))
    hit = asked.where(F.col("_seen") > need if strict else F.col("_seen") >= need)
    return hit.groupBy("q").agg(F.min("bin").alias("bin")).withColumn("value", (F.col("bin") + 0.5) * size + start)


def sliding_best(counts: DataFrame, bins: int, reach: int) -> DataFrame:
    """One row: the bin about which most weight lies within ``reach`` bins (the first of equals)."""
    spine = counts.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    dense = spine.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    around = F.sum("n").over(Window.orderBy("bin").rowsBetween(-reach, reach))  # bins are of a fixed number
    return dense.withColumn("weight", around).agg(F.min_by("bin", F.struct(-F.col("weight"), F.col("bin"))).alias("bin"), F.max("weight").alias("weight"))


def slope_through_origin(df: DataFrame, x: Column, y: Column, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(x * y) / F.sum(x * x)).alias("slope"), F.count("*").alias("samples"))


def hough(edges: DataFrame, angles: int, cell: float, x: str = "x", y: str = "y", weight: str = "weight") -> DataFrame:
    """Weighted votes (theta, rho) of edge points: each votes once an angle, summed before the shuffle."""
    theta = F.explode(F.sequence(F.lit(0), F.lit(angles - 1))).alias("theta")
    voted = edges.select(x, y, weight, theta)
    turn = F.col("theta") * (math.pi / angles)
    rho = F.floor((F.col(x) * F.cos(turn) + F.col(y) * F.sin(turn)) / cell).cast("int")
    return voted.groupBy("theta", rho.alias("rho")).agg(F.sum(weight).alias("votes"))


def peaks(votes: DataFrame, angles: int, share: float) -> DataFrame:
    """Cells of at least ``share`` of the greatest that no neighbour exceeds; angles wrap round, distances do not."""
    top = votes.agg(F.max("votes").alias("_top"))
    strong = votes.crossJoin(F.broadcast(top)).where(F.col("votes") >= F.col("_top") * share).drop("_top")  # one row
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(r).alias("r")) for a in (-1, 0, 1) for r in (-1, 0, 1) if a or r])).alias("o")
    near = votes.select("votes", "theta", "rho", offsets).select(F.pmod(F.col("theta") + F.col("o.a"), F.lit(angles)).alias("theta"), (F.col("rho") + F.col("o.r")).alias("rho"), "votes")
    most = near.groupBy("theta", "rho").agg(F.max("votes").alias("_most"))
    return strong.join(most, ["theta", "rho"], "left").where(F.col("_most").isNull() | (F.col("votes") >= F.col("_most"))).drop("_most")


# --- masks ----------------------------------------------------------------------------------------


def linear_mask(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float]) -> Column:
    """1 at the start line, 0 at the end line, a smooth step between."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    along = ((x - start[0]) * dx + (y - start[1]) * dy) / max(dx * dx + dy * dy, 1e-12)
    return 1.0 - smoothstep(0.0, 1.0, along)


def radial_mask(x: Column, y: Column, centre: tuple[float, float], radii: tuple[float, float], angle: float, feather: float) -> Column:
    """1 inside a turned ellipse, fading over its feather."""
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    dx, dy = x - centre[0], y - centre[1]
    r = F.hypot((dx * c + dy * s) / radii[0], (dy * c - dx * s) / radii[1])
    return 1.0 - smoothstep(1.0 - feather, 1.0, r)


def range_mask(value: Column, low: float, high: float, feather: float) -> Column:
    return F.least(smoothstep(low - feather, low, value), 1.0 - smoothstep(high, high + feather, value))


def brush_mask(x: Column, y: Column, strokes: list[dict]) -> Column:
    """Strokes in order: the greatest of the paint so far, or what an eraser leaves."""
    out = F.lit(0.0)
    for stroke in strokes:
        pts = stroke["points"]
        near = None
        for (ax, ay), (bx, by) in zip(pts, pts[1:] or pts):
            dx, dy = bx - ax, by - ay
            t = clamp(((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-12), 0.0, 1.0)
            d = F.hypot(x - ax - t * dx, y - ay - t * dy)
            near = d if near is None else F.least(near, d)
        w = 1.0 - smoothstep(stroke["radius"] * (1 - stroke["feather"]), stroke["radius"], near)
        out = F.least(out, 1.0 - w) if stroke.get("erase") else F.greatest(out, w)
    return out


def combined(first: Column, refinements: list[tuple[str, Column]], invert: bool = False) -> Column:
    """Fuzzy union (add), difference (subtract) and intersection, in order."""
    out = first
    for op, m in refinements:
        out = {"add": lambda a, b: F.greatest(a, b), "subtract": lambda a, b: F.least(a, 1.0 - b), "intersect": lambda a, b: F.least(a, b)}[op](out, m)
    return 1.0 - out if invert else out


def lanczos_taps(spark, width: int, to_width: int, lobes: int = 3) -> DataFrame:
    """Rows (target, source, weight): normalised taps of each target pixel, edges clamped; wider when shrinking."""
    ratio = width / to_width
    scale = max(1.0, ratio)
    reach = math.ceil(lobes * scale)
    t = spark.range(to_width).select(F.col("id").cast("int").alias("target"))
    centre = (F.col("target") + 0.5) * ratio - 0.5
    raw = t.select("target", centre.alias("c"), F.explode(F.sequence(F.floor(centre).cast("int") - reach, F.floor(centre).cast("int") + reach + 1)).alias("at"))
    z = (F.col("at") - F.col("c")) / scale * math.pi
    w = F.when(F.abs(z) < 1e-9, 1.0).when(F.abs(z) < lobes * math.pi, F.sin(z) / z * F.sin(z / lobes) / (z / lobes)).otherwise(0.0)
    taps = raw.select("target", F.least(F.greatest("at", F.lit(0)), F.lit(width - 1)).alias("source"), w.alias("w")).where("w <> 0")
    summed = taps.groupBy("target", "source").agg(F.sum("w").alias("w"))
    return summed.withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy("target"))).drop("w")


def resampled(rows: DataFrame, taps: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Applies taps along one axis: a join with the (small, fixed) tap table and a partial sum."""
    return rows.join(F.broadcast(taps), rows[at] == taps["source"]).groupBy(*by, "target").agg(F.sum(F.col(value) * F.col("weight")).alias(value)).withColumnRenamed("target", at)
