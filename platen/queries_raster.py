"""Queries over pixels and tiles, with their SQL twins.

Pixels are line items (discount, tax and quantity brought to 0..1); tiles are
embeddings read as 8 by 8 arrays.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import colour as K
from .operators import raster as R
from .standins import Library

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# --- tiles ------------------------------------------------------------------------------------------

_TILE = """tiles AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS t FROM embeddings),
px AS (SELECT vec_id, t, unnest(range(0, 64)) AS i FROM tiles), xy AS (SELECT vec_id, t, i, i % 8 AS x, i // 8 AS y FROM px)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Library(spark, sf_dir).raw("embeddings").where("size(embedding) = 64").select("vec_id", F.col("embedding").cast("array<double>").alias("t"))


def _shown(df: DataFrame, out, name: str = "v") -> DataFrame:
    """One row a pixel; rounding evens out the engines' orders of addition."""
    return df.select("vec_id", F.posexplode(out).alias("i", name)).withColumn(name, F.round(name, 6) + 0.0)


def _read(x: str, y: str, border: str) -> str:
    if border == "clamp":
        return f"t[least(greatest({y}, 0), 7) * 8 + least(greatest({x}, 0), 7) + 1]"

    def fold(c: str) -> str:
        m = f"((({c}) % 14 + 14) % 14)"
        return f"least({m}, 14 - {m})"

    return f"t[{fold(y)} * 8 + {fold(x)} + 1]"


def _sum_sql(taps, border: str) -> str:
    return " + ".join(f"{_read(f'x + ({dx})', f'y + ({dy})', border)} * {w!r}::DOUBLE" for dx, dy, w in taps)


def _tile_sql(value: str) -> str:
    return f"WITH {_TILE} SELECT vec_id, i::INTEGER AS i, round({value}, 6) + 0.0 AS v FROM xy"


_STENCILS = {"mean3": (R.box(1), "clamp"), "mean5": (R.box(2), "clamp"), "mean3_mirror": (R.box(1), "mirror"), "gauss": (R.gaussian(2, 0.7), "clamp")}
for _name, (_taps, _border) in _STENCILS.items():

    def _stencil(spark: SparkSession, sf_dir: str, taps=_taps, border=_border) -> DataFrame:
        d = _tiles(spark, sf_dir)
        return _shown(d, R.stencil(F.col("t"), 8, 8, taps, border))

    query(f"stencil_{_name}", _tile_sql(_sum_sql(_taps, _border)))(_stencil)


@query(
    "stencil_mean3_drop",
    f"""WITH {_TILE}, n AS (SELECT a.vec_id, a.i, avg(b.t[b.i + 1]) AS m FROM xy a JOIN xy b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2)
SELECT vec_id, i::INTEGER AS i, round(m, 6) + 0.0 AS v FROM n""",
)
def stencil_mean3_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tiles(spark, sf_dir), R.stencil(F.col("t"), 8, 8, R.box(1), "drop"))


def _bilateral_sql() -> str:
    ws, vs = [], []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            v = _read(f"x + ({dx})", f"y + ({dy})", "clamp")
            w = f"exp(-pow(({v} - t[i + 1]) / 0.2::DOUBLE, 2) / 2) * {math.exp(-(dx * dx + dy * dy) / 2)!r}::DOUBLE"
            ws.append(w)
            vs.append(f"{v} * {w}")
    return f"({' + '.join(vs)}) / ({' + '.join(ws)})"


@query("stencil_bilateral", _tile_sql(_bilateral_sql()))
def stencil_bilateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tiles(spark, sf_dir), R.bilateral(F.col("t"), 8, 8, 1, 1.0, 0.2))


@query("stencil_sobel", _tile_sql(f"sqrt(pow({_sum_sql(R.SOBEL_X, 'clamp')}, 2) + pow({_sum_sql(R.SOBEL_Y, 'clamp')}, 2))"))
def stencil_sobel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tiles(spark, sf_dir), R.sobel(F.col("t"), 8, 8))


@query("stencil_unsharp", _tile_sql(f"t[i + 1] + (t[i + 1] - ({_sum_sql(R.gaussian(2, 0.7), 'clamp')})) * 0.3::DOUBLE"))
def stencil_unsharp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tiles(spark, sf_dir), R.unsharp(F.col("t"), 8, 8, 0.3))


@query(
    "mosaic_reduce",
    f"""WITH {_TILE}, g AS (SELECT vec_id, x // 4 * 2 + x % 2 AS ox, y // 4 * 2 + y % 2 AS oy, t[i + 1] AS v FROM xy)
SELECT vec_id, (oy * 4 + ox)::INTEGER AS i, round(avg(v), 6) + 0.0 AS v FROM g GROUP BY vec_id, ox, oy""",
)
def mosaic_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tiles(spark, sf_dir), R.mosaic_reduced(F.col("t"), 8, 8))


_DOWN = " + ".join(f"{_read(f'ox * 2 + ({a - 2})', f'oy * 2 + ({b - 2})', 'clamp')} * {wx * wy!r}::DOUBLE" for b, wy in enumerate(R.FIVE) for a, wx in enumerate(R.FIVE))


@query("pyramid_down", f"WITH {_TILE}, o AS (SELECT vec_id, t, unnest(range(0, 16)) AS i FROM tiles), q AS (SELECT *, i % 4 AS ox, i // 4 AS oy FROM o) SELECT vec_id, i::INTEGER AS i, round({_DOWN}, 6) + 0.0 AS v FROM q")
def pyramid_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_tiles(spark, sf_dir), R.downsampled(F.col("t"), 8, 8))


def _up(x: int, y: int) -> str:
    """A zero-filled sample of the coarse level, clamped to the fine one's edges."""
    px, py = f"least(greatest(x + ({x}), 0), 7)", f"least(greatest(y + ({y}), 0), 7)"
    return f"CASE WHEN {px} % 2 = 0 AND {py} % 2 = 0 THEN c[{py} // 2 * 4 + {px} // 2 + 1] ELSE 0.0::DOUBLE END"


_UP = " + ".join(f"{_up(a - 2, b - 2)} * {4 * wx * wy!r}::DOUBLE" for b, wy in enumerate(R.FIVE) for a, wx in enumerate(R.FIVE))


@query(
    "pyramid_laplacian",
    f"""WITH {_TILE}, o AS (SELECT vec_id, t, unnest(range(0, 16)) AS i FROM tiles), q AS (SELECT *, i % 4 AS ox, i // 4 AS oy FROM o),
d AS (SELECT vec_id, list({_DOWN} ORDER BY i) AS c FROM q GROUP BY vec_id) SELECT xy.vec_id, i::INTEGER AS i, round(t[i + 1] - ({_UP}), 6) + 0.0 AS v FROM xy JOIN d ON xy.vec_id = d.vec_id""",
)
def pyramid_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _tiles(spark, sf_dir).withColumn("c", R.downsampled(F.col("t"), 8, 8))
    return _shown(d, R.laplacian(F.col("t"), F.col("c"), 8, 8))


@query(
    "guide_grid",
    f"""WITH {_TILE} SELECT vec_id, (y // 2 * 4 + x // 2)::INTEGER AS cell, round(avg(t[i + 1]), 6) + 0.0 AS mean, round(max(t[i + 1]) - min(t[i + 1]), 6) + 0.0 AS spread FROM xy GROUP BY 1, 2""",
)
def guide_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _tiles(spark, sf_dir).select("vec_id", F.posexplode("t").alias("i", "v"))
    cell = (F.floor(F.col("i") / 16) * 4 + F.floor(F.col("i") % 8 / 2)).cast("int")
    return px.groupBy("vec_id", cell.alias("cell")).agg((F.round(F.avg("v"), 6) + 0.0).alias("mean"), (F.round(F.max("v") - F.min("v"), 6) + 0.0).alias("spread"))


@query(
    "lanczos_plan",
    """WITH c AS (SELECT target, (target + 0.5::DOUBLE) * 2.5::DOUBLE - 0.5::DOUBLE AS c FROM (SELECT unnest(range(0, 16)) AS target)),
a AS (SELECT target, c, unnest(range(floor(c)::BIGINT - 8, floor(c)::BIGINT + 10)) AS tap FROM c), z AS (SELECT *, (tap - c) / 2.5::DOUBLE * pi() AS z FROM a),
w AS (SELECT target, least(greatest(tap, 0), 39) AS source, CASE WHEN abs(z) < 1e-9 THEN 1.0::DOUBLE WHEN abs(z) < 3 * pi() THEN sin(z) / z * sin(z / 3) / (z / 3) ELSE 0.0::DOUBLE END AS w FROM z),
s AS (SELECT target, source, sum(w) AS w FROM w WHERE w <> 0 GROUP BY ALL)
SELECT target::INTEGER AS target, source::INTEGER AS source, round(w / sum(w) OVER (PARTITION BY target), 6) + 0.0 AS weight FROM s""",
)
def lanczos_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lanczos_taps(spark, 40, 16).withColumn("weight", F.round("weight", 6) + 0.0)


@query(
    "lanczos_rows",
    f"""WITH {_TILE}, c AS (SELECT target, (target + 0.5::DOUBLE) * 2 - 0.5::DOUBLE AS c FROM (SELECT unnest(range(0, 4)) AS target)),
a AS (SELECT target, c, unnest(range(floor(c)::BIGINT - 6, floor(c)::BIGINT + 8)) AS tap FROM c), z AS (SELECT *, (tap - c) / 2 * pi() AS z FROM a),
w AS (SELECT target, least(greatest(tap, 0), 7) AS source, CASE WHEN abs(z) < 1e-9 THEN 1.0::DOUBLE WHEN abs(z) < 3 * pi() THEN sin(z) / z * sin(z / 3) / (z / 3) ELSE 0.0::DOUBLE END AS w FROM z),
s AS (SELECT target, source, sum(w) AS w FROM w WHERE w <> 0 GROUP BY ALL), p AS (SELECT target, source, w / sum(w) OVER (PARTITION BY target) AS weight FROM s)
SELECT vec_id, y::INTEGER AS y, target::INTEGER AS x, round(sum(t[i + 1] * weight), 6) + 0.0 AS v FROM xy JOIN p ON x = source GROUP BY vec_id, y, target""",
)
def lanczos_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _tiles(spark, sf_dir).select("vec_id", F.posexplode("t").alias("i", "v")).select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), "v")
    return R.resampled(px, R.lanczos_taps(spark, 8, 4), ["vec_id", "y"], "x", "v").withColumn("v", F.round("v", 6) + 0.0)


_EDGES = f"""{_TILE}, e AS (SELECT x, y, abs(t[i + 1]) AS weight FROM xy WHERE abs(t[i + 1]) > 0.2),
v AS (SELECT th AS theta, floor((x * cos(th * (pi() / 36)) + y * sin(th * (pi() / 36))) / 2 + 0.0)::INTEGER AS rho, weight FROM e, range(0, 36) r(th)),
votes AS (SELECT theta::INTEGER AS theta, rho, sum(weight) AS votes FROM v GROUP BY ALL)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = _tiles(spark, sf_dir).select(F.posexplode("t").alias("i", "v")).where("abs(v) > 0.2")
    return R.hough(px.select((F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y"), F.abs("v").alias("weight")), 36, 2.0)


@query("hough_votes", f"WITH {_EDGES} SELECT theta, rho, round(votes, 4) + 0.0 AS votes FROM votes")
def hough_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).withColumn("votes", F.round("votes", 4) + 0.0)


@query(
    "hough_peaks",
    f"""WITH {_EDGES} SELECT theta, rho, round(votes, 4) + 0.0 AS votes FROM votes a WHERE votes >= (SELECT max(votes) FROM votes) * 0.5
AND NOT EXISTS (SELECT 1 FROM votes b WHERE abs(b.rho - a.rho) <= 1 AND (abs(b.theta - a.theta) <= 1 OR abs(b.theta - a.theta) = 35) AND b.votes > a.votes)""",
)
def hough_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.peaks(_votes(spark, sf_dir), 36, 0.5).withColumn("votes", F.round("votes", 4) + 0.0)


# --- pixels -----------------------------------------------------------------------------------------

_PX = "px AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS pk, l_discount * 10 AS r, l_tax / 0.08::DOUBLE AS g, l_quantity / 50 AS b FROM lineitem)"
_SRGB = "CASE WHEN {0} <= 0.0031308::DOUBLE THEN {0} * 12.92::DOUBLE ELSE pow({0}, 1 / 2.4::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END"
_LUMA = "({0} * 0.2126::DOUBLE + {1} * 0.7152::DOUBLE + {2} * 0.0722::DOUBLE)"


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Library(spark, sf_dir).raw("lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), (F.col("l_discount") * 10).alias("r"), (F.col("l_tax") / 0.08).alias("g"), (F.col("l_quantity") / 50).alias("b"))


def _rgb() -> K.RGB:
    return F.col("r"), F.col("g"), F.col("b")


def _rounded(df: DataFrame, **out) -> DataFrame:
    return df.select("k", "n", "pk", *[(F.round(v + 1e-9, 5) + 0.0).alias(k) for k, v in out.items()])


def _out(rgb: K.RGB) -> dict:
    return dict(zip(("red", "green", "blue"), rgb))


def _code(c: str) -> str:
    return f"floor(least(greatest({_SRGB.format(f'greatest({c}, 0)')}, 0), 1) * 255 + 0.5::DOUBLE)::INTEGER"


@query(
    "hist_256",
    f"""WITH {_PX}, c AS (SELECT {_code('r')} AS r, {_code('g')} AS g, {_code('b')} AS b, {_code(_LUMA.format('r', 'g', 'b'))} AS l FROM px),
u AS (SELECT 'red' AS channel, r AS bin FROM c UNION ALL SELECT 'green', g FROM c UNION ALL SELECT 'blue', b FROM c UNION ALL SELECT 'luma', l FROM c)
SELECT channel, bin, count(*) AS n FROM u GROUP BY ALL""",
)
def hist_256(spark: SparkSession, sf_dir: str) -> DataFrame:
    rgb = _rgb()
    channels = {"red": rgb[0], "green": rgb[1], "blue": rgb[2], "luma": K.dot(rgb)}
    return R.histogram(_px(spark, sf_dir), {k: K.eight_bit(v) for k, v in channels.items()})


@query(
    "hist_clip",
    f"WITH {_PX}, c AS (SELECT {_code('r')} AS r, {_code('g')} AS g, {_code('b')} AS b FROM px) SELECT count(*) FILTER (greatest(r, g, b) = 255) AS white, count(*) FILTER (greatest(r, g, b) = 0) AS black FROM c",
)
def hist_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.greatest(*[K.eight_bit(c) for c in _rgb()])
    return _px(spark, sf_dir).agg(F.count_if(top == 255).alias("white"), F.count_if(top == 0).alias("black"))


_EV = f"""{_PX}, e AS (SELECT floor((log2({_LUMA.format('r', 'g', 'b')} + 1e-4) + 16) / 0.05::DOUBLE)::INTEGER AS bin FROM px),
h AS (SELECT bin, count(*) AS n FROM e WHERE bin BETWEEN 0 AND 479 GROUP BY 1), s AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS seen, sum(n) OVER () AS total FROM h),
q AS (SELECT unnest([0.005::DOUBLE, 0.5::DOUBLE, 0.995::DOUBLE]) AS q)"""


def _quantile_sql(op: str) -> str:
    return f"WITH {_EV}, f AS (SELECT q, min(bin) AS bin FROM s, q WHERE seen {op} floor(total * q) GROUP BY q) SELECT q, bin, round((bin + 0.5::DOUBLE) * 0.05::DOUBLE - 16, 6) AS value FROM f"


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    bin = F.floor((F.log2(K.dot(_rgb()) + 1e-4) + 16) / 0.05).cast("int")
    return R.histogram(_px(spark, sf_dir), {"ev": bin}, 480).select("bin", "n")


@query("scene_quantiles", _quantile_sql(">"))
def scene_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantile_bins(_ev(spark, sf_dir), [0.005, 0.5, 0.995], True, 0.05, -16.0).withColumn("value", F.round("value", 6))


@query("noise_percentile", _quantile_sql(">="))
def noise_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.quantile_bins(_ev(spark, sf_dir), [0.005, 0.5, 0.995], False, 0.05, -16.0).withColumn("value", F.round("value", 6))


@query(
    "veil_threshold",
    f"""WITH {_PX}, d AS (SELECT floor(least(r, g, b) * 1023)::INTEGER AS bin, greatest(r, g, b) AS top FROM px), h AS (SELECT bin, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS seen, sum(n) OVER () AS total FROM h), c AS (SELECT min(bin) AS cut FROM s WHERE seen >= floor(total * 0.999::DOUBLE))
SELECT cut AS bin, round(greatest(avg(top), 1e-4), 6) AS veil FROM d, c WHERE bin >= cut GROUP BY cut""",
)
def veil_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _px(spark, sf_dir).select(F.floor(F.least(*_rgb()) * 1023).cast("int").alias("bin"), F.greatest(*_rgb()).alias("top"))
    cut = R.quantile_bins(d.groupBy("bin").agg(F.count("*").alias("n")), [0.999], False, 1.0).select(F.col("bin").alias("cut"))
    return d.crossJoin(F.broadcast(cut)).where("bin >= cut").groupBy(F.col("cut").alias("bin")).agg(F.round(F.greatest(F.avg("top"), F.lit(1e-4)), 6).alias("veil"))  # one row


@query(
    "sliding_bins",
    """WITH h AS (SELECT (l_partkey % 360)::INTEGER AS bin, count(*) AS n FROM lineitem WHERE l_partkey % 360 <> 17 GROUP BY 1),
d AS (SELECT s.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 360))::INTEGER AS bin) s LEFT JOIN h ON h.bin = s.bin),
w AS (SELECT bin, sum(n) OVER (ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)::BIGINT AS weight FROM d)
SELECT bin, weight FROM w ORDER BY weight DESC, bin LIMIT 1""",
)
def sliding_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Library(spark, sf_dir).raw("lineitem")
    counts = li.where("l_partkey % 360 <> 17").groupBy((F.col("l_partkey") % 360).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return R.sliding_best(counts, 360, 4)


@query("least_squares", f"WITH {_PX} SELECT n, round(sum(r * b) / sum(r * r), 8) AS slope, count(*) AS samples FROM px GROUP BY n")
def least_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.slope_through_origin(_px(spark, sf_dir), F.col("r"), F.col("b"), ["n"]).withColumn("slope", F.round("slope", 8))


def _px_sql(body: str, *ctes: str) -> str:
    return f"WITH {', '.join([_PX, *ctes])} SELECT k, n, pk, {body}"


def _three(f: str) -> str:
    return ", ".join(f"round({f.format(c)} + 1e-9::DOUBLE, 5) + 0.0 AS {name}" for c, name in zip("rgb", ("red", "green", "blue")))


@query("srgb_encode", _px_sql(_three(_SRGB) + " FROM px"))
def srgb_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **_out(K.each(_rgb(), K.encode_srgb)))


@query("srgb_decode", _px_sql(_three("CASE WHEN {0} <= 0.04045::DOUBLE THEN {0} / 12.92::DOUBLE ELSE pow(({0} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END") + " FROM px"))
def srgb_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **_out(K.each(_rgb(), K.decode_srgb)))


_HSV = """h AS (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM px), hsv AS (SELECT *, CASE WHEN mx = mn THEN 0.0::DOUBLE
    WHEN mx = r THEN 60 * CASE WHEN g < b THEN (g - b) / (mx - mn) + 6 ELSE (g - b) / (mx - mn) END WHEN mx = g THEN 60 * (2 + (b - r) / (mx - mn)) ELSE 60 * (4 + (r - g) / (mx - mn)) END AS hue,
    CASE WHEN mx > 0 THEN (mx - mn) / mx ELSE 0.0::DOUBLE END AS sat FROM h)"""


@query("hue_of", _px_sql("round(hue + 1e-9::DOUBLE, 5) + 0.0 AS hue, round(sat + 1e-9::DOUBLE, 5) + 0.0 AS saturation, round(mx + 1e-9::DOUBLE, 5) + 0.0 AS value FROM hsv", _HSV))
def hue_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **dict(zip(("hue", "saturation", "value"), K.hsv(_rgb()))))


def _vivid(weight: str) -> str:
    return _px_sql(_three("grey + ({0} - grey) * greatest((1 + 0.2::DOUBLE) * (1 + 0.5::DOUBLE * " + weight + "), 0)") + " FROM s", f"s AS (SELECT *, {_LUMA.format('r', 'g', 'b')} AS grey, CASE WHEN greatest(r, g, b) > 1e-6 THEN (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) ELSE 0.0::DOUBLE END AS already FROM px)")


@query("vibrance", _vivid("(1 - already)"))
def vibrance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **_out(K.saturated(_rgb(), 0.2, 0.5)))


_ADJUST = [(0.3, 0.2, 0.1), (-0.2, 0.0, 0.05), (0.1, -0.3, 0.0), (0.0, 0.4, -0.1), (0.25, 0.1, 0.0), (-0.4, 0.0, 0.2), (0.0, -0.2, 0.0), (0.15, 0.3, -0.05)]


def _bands_sql() -> str:
    def table(k: int) -> str:
        return "[" + ", ".join(f"{a[k]!r}::DOUBLE" for a in _ADJUST) + "]"

    lows = [f"WHEN hue < {int(K.BANDS[i + 1])} THEN {{}}" for i in range(7)]
    band = "CASE " + " ".join(x.format(i) for i, x in enumerate(lows)) + " ELSE 7 END"
    weight = "CASE " + " ".join(x.format(f"(hue - {K.BANDS[i]}) / {K.BANDS[i + 1] - K.BANDS[i]}::DOUBLE") for i, x in enumerate(lows)) + " ELSE (hue - 320) / 40::DOUBLE END"

    def of(k: int) -> str:
        return f"({table(k)}[band + 1] * (1 - w) + {table(k)}[(band + 1) % 8 + 1] * w)"

    chan = "mx - mx * sat * least(greatest(least({0}, 4 - {0}), 0), 1)"
    ks = {"r": "((nh / 60 + 5) % 6)", "g": "((nh / 60 + 3) % 6)", "b": "((nh / 60 + 1) % 6)"}
    ctes = [
        _HSV,
        f"sp AS (SELECT *, {band} AS band, {weight} AS w FROM hsv)",
        f"ad AS (SELECT *, (hue + {of(0)} * 30 + 360) % 360 AS nh, greatest(1 + {of(1)}, 0) AS gain, greatest(1 + {of(2)}, 0) AS light FROM sp)",
        "tn AS (SELECT *, " + ", ".join(f"{chan.format(v)} AS t{c}" for c, v in ks.items()) + " FROM ad)",
        f"gr AS (SELECT *, {_LUMA.format('tr', 'tg', 'tb')} AS grey FROM tn)",
    ]
    return _px_sql(_three("CASE WHEN sat > 0 THEN (grey + (t{0} - grey) * gain) * light ELSE {0} END") + " FROM gr", *ctes)


@query("hsl_mix", _bands_sql())
def hsl_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.mixed_bands(_px(spark, sf_dir), _ADJUST), **_out(_rgb()))


def _grade_sql() -> str:
    ctes = [
        f"l AS (SELECT *, {_SRGB.format('y')} AS luma FROM (SELECT *, least(greatest({_LUMA.format('r', 'g', 'b')}, 0), 1) AS y FROM px))",
        "w AS (SELECT *, CASE WHEN luma < 0.5 THEN luma / 0.5::DOUBLE ELSE (luma - 0.5::DOUBLE) / 0.5::DOUBLE END AS u FROM l)",
        "v AS (SELECT *, pow(least(greatest(u, 0), 1), 3.0::DOUBLE) AS pa, pow(1 - least(greatest(u, 0), 1), 3.0::DOUBLE) AS pb FROM w)",
        "x AS (SELECT *, pa / (pa + pb) AS m FROM v)",
        "z AS (SELECT *, CASE WHEN luma < 0.5 THEN 1 - m ELSE 0.0::DOUBLE END AS ws, CASE WHEN luma < 0.5 THEN m ELSE 1 - m END AS wm, CASE WHEN luma < 0.5 THEN 0.0::DOUBLE ELSE m END AS wh FROM x)",
    ]
    prev = "z"
    for i, ((hue, sat, lum), w) in enumerate(zip(_GRADES, ("ws", "wm", "wh"))):
        wanted = K._plain_rgb(hue)
        there = max(sum(a * b for a, b in zip(wanted, K.LUMA)), 1e-4)
        t = f"least(greatest({w} * {sat!r}::DOUBLE * 0.5::DOUBLE, 0), 1)"
        here = _LUMA.format("r", "g", "b")
        new = ", ".join(f"({c} * (1 - {t}) + {here} * {k / there!r}::DOUBLE * {t}) * greatest(1 + {w} * {lum!r}::DOUBLE * 0.5::DOUBLE, 0) AS {c}" for c, k in zip("rgb", wanted))
        ctes.append(f"s{i} AS (SELECT * REPLACE ({new}) FROM {prev})")
        prev = f"s{i}"
    return _px_sql(_three("{0}") + f" FROM {prev}", *ctes)


_GRADES = ((220.0, 0.4, -0.1), (40.0, 0.2, 0.05), (50.0, 0.3, 0.2))


@query("grade", _grade_sql())
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(K.graded(_px(spark, sf_dir), *_GRADES), **_out(_rgb()))


def _tone_sql() -> str:
    p = repr(K.TONE_PIVOT) + "::DOUBLE"
    ctes = [
        f"a AS (SELECT *, least(greatest(pow(greatest(y, 0), 1 / 2.2::DOUBLE), 0), 1) AS p0 FROM (SELECT *, {_LUMA.format('r', 'g', 'b')} AS y FROM px))",
        f"b AS (SELECT *, CASE WHEN p0 <= {p} THEN {p} * pow(p0 / {p}, 1.3::DOUBLE) ELSE 1 - (1 - {p}) * pow((1 - p0) / (1 - {p}), 1.3::DOUBLE) END AS p1 FROM a)",
        f"""c AS (SELECT *, CASE WHEN p1 <= {p} THEN {p} * pow(p1 / {p}, 1 - 0.5::DOUBLE * 0.75::DOUBLE * ((1 - p1 / {p}) * (1 + 1.5::DOUBLE * (p1 / {p}) * (p1 / {p}))))
            ELSE 1 - (1 - {p}) * pow((1 - p1) / (1 - {p}), 1 + 0.4::DOUBLE * 0.75::DOUBLE * (1 - (1 - p1) / (1 - {p}))) END AS p2 FROM b)""",
    ]
    return _px_sql("round(p2 + 1e-9::DOUBLE, 5) + 0.0 AS shaped, round(y / (y + 0.33::DOUBLE) + 1e-9::DOUBLE, 5) + 0.0 AS mapped FROM c", *ctes)


@query("tone_curve", _tone_sql())
def tone_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = K.dot(_rgb())
    return _rounded(_px(spark, sf_dir), shaped=K.tone_shaped(y, 1.3, 0.4, 0.5), mapped=K.tone_mapped(y))


@query(
    "levels",
    _px_sql(
        _three(
            "pow(CASE WHEN hi <= 1 THEN least(greatest(u{0}, 0), 1) ELSE least(greatest(least(greatest(u{0}, 0), 1) * 0.4::DOUBLE + (u{0} / hi * (1 - t) + t) * 0.6::DOUBLE, 0), 1) END, 2.2::DOUBLE)"
        )
        + " FROM f",
        "u AS (SELECT *, (r - 0.05::DOUBLE) / 0.75::DOUBLE AS ur, (g - 0.05::DOUBLE) / 0.75::DOUBLE AS ug, (b - 0.05::DOUBLE) / 0.75::DOUBLE AS ub FROM px)",
        "e AS (SELECT *, greatest(ur, ug, ub) AS hi, least(ur, ug, ub) AS lo FROM u)",
        "f AS (SELECT *, least(greatest((hi - 1) / greatest(greatest(hi / greatest(lo, 1e-5), 1) - 1, 1e-5), 0), 1) AS t FROM e)",
    ),
)
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **_out(K.levelled(_rgb(), 0.05, 0.8, 0.6)))


@query(
    "dehaze",
    _px_sql(
        "round(greatest((r - 0.9::DOUBLE * (1 - t)) / t, 0) + 1e-9::DOUBLE, 5) + 0.0 AS red, round(greatest((g - 0.85::DOUBLE * (1 - t)) / t, 0) + 1e-9::DOUBLE, 5) + 0.0 AS green, round(greatest((b - 0.8::DOUBLE * (1 - t)) / t, 0) + 1e-9::DOUBLE, 5) + 0.0 AS blue FROM h",
        "h AS (SELECT *, least(greatest(1 - 0.95::DOUBLE * 0.5::DOUBLE * least(greatest(least(r, g, b) / 0.6::DOUBLE, 0), 1), 0.15::DOUBLE), 3.0::DOUBLE) AS t FROM px)",
    ),
)
def dehaze(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **_out(K.dehazed(_rgb(), _rgb(), (0.9, 0.85, 0.8), 0.5, 0.6)))


@query("clarity", _px_sql(_three("pow(0.4::DOUBLE * pow(greatest(pow(greatest({0}, 0), 1 / 2.2::DOUBLE) / 0.4::DOUBLE, 1e-5), 1.25::DOUBLE), 2.2::DOUBLE)") + " FROM px"))
def clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), **_out(K.each(_rgb(), lambda c: K.against(c, 0.4, 0.25))))


_STEP = "CASE WHEN {x} <= {a} THEN 0.0::DOUBLE WHEN {x} >= {b} THEN 1.0::DOUBLE ELSE pow(({x} - {a}) / ({b} - {a}), 2) * (3 - 2 * ({x} - {a}) / ({b} - {a})) END"


def _step(x: str, a: float, b: float) -> str:
    return _STEP.format(x=f"({x})", a=f"{a!r}::DOUBLE", b=f"{b!r}::DOUBLE")


@query("smoothstep", _px_sql(f"round({_step('r', 0.2, 0.7)} + 1e-9::DOUBLE, 5) + 0.0 AS soft, round(CASE WHEN b >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 5) AS hard FROM px"))
def smoothstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_px(spark, sf_dir), soft=K.smoothstep(0.2, 0.7, F.col("r")), hard=K.smoothstep(0.5, 0.5, F.col("b")))


_LIN = f"1 - ({_step('((r - 0.2::DOUBLE) * 0.6::DOUBLE + (b - 0.1::DOUBLE) * 0.5::DOUBLE) / 0.61::DOUBLE', 0.0, 1.0)})"
_C, _S = math.cos(math.radians(30)), math.sin(math.radians(30))
_RADIUS = f"sqrt(pow(((r - 0.5::DOUBLE) * {_C!r}::DOUBLE + (b - 0.5::DOUBLE) * {_S!r}::DOUBLE) / 0.4::DOUBLE, 2) + pow(((b - 0.5::DOUBLE) * {_C!r}::DOUBLE - (r - 0.5::DOUBLE) * {_S!r}::DOUBLE) / 0.3::DOUBLE, 2))"
_RAD = f"1 - ({_step(_RADIUS, 0.5, 1.0)})"
_RAN = f"least({_step('g', 0.2, 0.3)}, 1 - ({_step('g', 0.7, 0.8)}))"


def _masks() -> tuple:
    x, y, v = F.col("r"), F.col("b"), F.col("g")
    return R.linear_mask(x, y, (0.2, 0.1), (0.8, 0.6)), R.radial_mask(x, y, (0.5, 0.5), (0.4, 0.3), 30.0, 0.5), R.range_mask(v, 0.3, 0.7, 0.1)


@query("mask_linear", _px_sql(f"round({_LIN}, 4) + 0.0 AS weight FROM px"))
def mask_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir).select("k", "n", "pk", (F.round(_masks()[0], 4) + 0.0).alias("weight"))


@query("mask_radial", _px_sql(f"round({_RAD}, 4) + 0.0 AS weight FROM px"))
def mask_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir).select("k", "n", "pk", (F.round(_masks()[1], 4) + 0.0).alias("weight"))


@query("mask_range", _px_sql(f"round({_RAN}, 4) + 0.0 AS weight FROM px"))
def mask_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _px(spark, sf_dir).select("k", "n", "pk", (F.round(_masks()[2], 4) + 0.0).alias("weight"))


@query("mask_combine", _px_sql(f"round(1 - least(least(greatest({_LIN}, {_RAD}), 1 - ({_RAN})), 0.9::DOUBLE), 4) + 0.0 AS weight FROM px"))
def mask_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = _masks()
    out = R.combined(a, [("add", b), ("subtract", c), ("intersect", F.lit(0.9))], invert=True)
    return _px(spark, sf_dir).select("k", "n", "pk", (F.round(out, 4) + 0.0).alias("weight"))


@query(
    "vignette",
    _px_sql(
        f"round({_step('rad', 0.35, 0.65)}, 4) + 0.0 AS weight, round(greatest(1 + -0.4::DOUBLE * r4, 0.05::DOUBLE), 4) + 0.0 AS falloff FROM v",
        "v AS (SELECT *, sqrt(pow(abs(r * 100 - 50) / 50, 2) + pow(abs(b * 80 - 40) / 40, 2)) / sqrt(2) AS rad, pow((pow(r * 100 - 50, 2) + pow(b * 80 - 40, 2)) / (2500 + 1600), 2) AS r4 FROM px)",
    ),
)
def vignette(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, w, h = F.col("r") * 100, F.col("b") * 80, F.lit(100.0), F.lit(80.0)
    return _px(spark, sf_dir).select("k", "n", "pk", (F.round(K.vignette(x, y, w, h, 0.5, 0.0, 0.3), 4) + 0.0).alias("weight"), (F.round(K.falloff(x, y, w, h, -0.4), 4) + 0.0).alias("falloff"))


def _lab_sql() -> str:
    f = "CASE WHEN {0} > 216 / 24389::DOUBLE THEN pow({0}, 1 / 3::DOUBLE) ELSE ({0} * (24389 / 27::DOUBLE) + 16) / 116 END"
    xyz = ", ".join(f"({' + '.join(f'{c} * {m!r}::DOUBLE' for c, m in zip('rgb', row))}) / {w!r}::DOUBLE AS {name}" for row, w, name in zip(K.SRGB_XYZ, K.WHITE_D50, "XYZ"))
    return _px_sql(
        "round(116 * fy - 16, 4) + 0.0 AS l, round(500 * (fx - fy), 4) + 0.0 AS a, round(200 * (fy - fz), 4) + 0.0 AS b FROM lf",
        f"xyz AS (SELECT k, n, pk, {xyz} FROM px)",
        f"lf AS (SELECT k, n, pk, {f.format('X')} AS fx, {f.format('Y')} AS fy, {f.format('Z')} AS fz FROM xyz)",
    )


@query("lab", _lab_sql())
def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dict(zip("lab", K.lab(K.matrix(_rgb(), K.SRGB_XYZ))))
    return _px(spark, sf_dir).select("k", "n", "pk", *[(F.round(v, 4) + 0.0).alias(c) for c, v in out.items()])


@query("lab_delta_e")
def lab_delta_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _px(spark, sf_dir).withColumns(dict(zip(("sr", "sg", "sb"), K.saturated(_rgb(), 0.2, 0.0))))
    d = d.withColumns(dict(zip(("l1", "a1", "b1"), K.lab(K.matrix(_rgb(), K.SRGB_XYZ)))))
    d = d.withColumns(dict(zip(("l2", "a2", "b2"), K.lab(K.matrix((F.col("sr"), F.col("sg"), F.col("sb")), K.SRGB_XYZ)))))
    return _rounded(K.delta_e_2000(d, ("l1", "a1", "b1"), ("l2", "a2", "b2")), delta_e=F.col("delta_e"))


@query("normalise", "SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS pk, round((l_extendedprice - (900 + 10 * (l_linenumber % 4))) / (16383 - (900 + 10 * (l_linenumber % 4))), 6) + 0.0 AS v FROM lineitem")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = Library(spark, sf_dir).raw("lineitem")
    black = (F.lit(900) + F.col("l_linenumber") % 4 * 10).cast("double")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("pk"), (F.round(R.normalised(F.col("l_extendedprice"), black, 16383.0), 6) + 0.0).alias("v"))


@query("wb_mired", "SELECT p_partkey AS k, round(least(greatest((1e6 / (2500 + p_size * 100) - 1e6 / 2856) / (1e6 / 6504 - 1e6 / 2856), 0), 1), 6) + 0.0 AS weight, round(pow(2, (p_size - 25) / 10::DOUBLE), 6) + 0.0 AS gain FROM part")
def wb_mired(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Library(spark, sf_dir).raw("part")
    return p.select(F.col("p_partkey").alias("k"), (F.round(K.mired_blend((F.lit(2500.0) + F.col("p_size") * 100), 2856.0, 6504.0), 6) + 0.0).alias("weight"), (F.round(K.exposure((F.col("p_size") - 25) / 10), 6) + 0.0).alias("gain"))
