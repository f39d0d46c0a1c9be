"""Colour science as columns: everything stays in whole-stage code generation.

A colour is a tuple of three columns (r, g, b), scene- or display-linear.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

# Fixed values that results depend on.
LUMA = (0.2126, 0.7152, 0.0722)
TONE_PIVOT, TONE_GAMMA, TONE_TAPER, SHADOW_REACH = 0.45865646, 2.2, 0.75, 1.5
TONE_MAP_K = 0.33
HAZE_OMEGA, HAZE_FLOOR, HAZE_CEILING = 0.95, 0.15, 3.0
BLEACH_FROM, BLEACH_NEUTRAL, BLEACH_COLOURED = 0.80, 0.45, 0.40
EPS = 1e-5
BANDS = (0.0, 30.0, 60.0, 120.0, 180.0, 240.0, 280.0, 320.0)
HUE_RANGE = 30.0
GRADE_REACH = GRADE_LIFT = 0.5
WHITE_D50 = (0.9642, 1.0, 0.8249)


def lit(x: float | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(x, lit(low)), lit(high))


def blend(a: Column, b: Column, t: Column) -> Column:
    return a * (1.0 - t) + b * t


def each(rgb: RGB, f) -> RGB:
    return f(rgb[0]), f(rgb[1]), f(rgb[2])


def dot(rgb: RGB, weights: tuple[float, float, float] = LUMA) -> Column:
    return rgb[0] * weights[0] + rgb[1] * weights[1] + rgb[2] * weights[2]


def smoothstep(low: float | Column, high: float | Column, x: Column) -> Column:
    """Hermite step; edges that meet or cross make a hard step at the lower one."""
    low, high = lit(low), lit(high)
    t = clamp((x - low) / F.when(high > low, high - low).otherwise(1.0), 0.0, 1.0)
    return F.when(high > low, t * t * (3.0 - 2.0 * t)).otherwise(F.when(x >= low, 1.0).otherwise(0.0))


def encode_srgb(v: Column) -> Column:
    x = F.greatest(v, F.lit(0.0))
    return F.when(x <= 0.0031308, x * 12.92).otherwise(F.pow(x, F.lit(1 / 2.4)) * 1.055 - 0.055)


def decode_srgb(v: Column) -> Column:
    x = F.greatest(v, F.lit(0.0))
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def eight_bit(v: Column) -> Column:
    """A linear value as an 8-bit sRGB code."""
    return F.floor(clamp(encode_srgb(v), 0.0, 1.0) * 255.0 + 0.5).cast("int")


def hsv(rgb: RGB) -> RGB:
    """(hue in degrees, saturation, value); greys have hue 0."""
    r, g, b = rgb
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    safe = F.when(span > 0, span).otherwise(1.0)
    turn = F.when(top == r, (g - b) / safe).when(top == g, (b - r) / safe + 2.0).otherwise((r - g) / safe + 4.0)
    hue = F.when(span > 0, F.when(turn < 0, turn + 6.0).otherwise(turn) * 60.0).otherwise(0.0)
    return hue, F.when(top > 0, span / F.when(top > 0, top).otherwise(1.0)).otherwise(0.0), top


def rgb_of(hue: Column, saturation: Column, value: Column) -> RGB:
    """The inverse of hsv(): each channel is the value less its distance from the hue, once round."""

    def channel(n: float) -> Column:
        k = F.pmod(hue / 60.0 + n, F.lit(6.0))
        return value - value * saturation * clamp(F.least(k, 4.0 - k), 0.0, 1.0)

    return channel(5.0), channel(3.0), channel(1.0)


def saturated(rgb: RGB, saturation: float, vibrance: float) -> RGB:
    """About the luma; vibrance acts more on what is less (or, if negative, more) saturated already."""
    grey = dot(rgb)
    top, low = F.greatest(*rgb), F.least(*rgb)
    already = clamp(F.when(top > 1e-6, (top - low) / F.greatest(top, F.lit(1e-6))).otherwise(0.0), 0.0, 1.0)
    weight = 1.0 - already if vibrance > 0 else already
    scale = F.greatest((1.0 + saturation) * (1.0 + vibrance * weight), F.lit(0.0))
    return each(rgb, lambda c: grey + (c - grey) * scale)


def spanning(hue: Column) -> tuple[Column, Column, Column]:
    """(band, next band, weight of the next) about a hue; the last band's next is the first."""
    band, after, weight = F.lit(len(BANDS) - 1), F.lit(0), (hue - BANDS[-1]) / (360.0 - BANDS[-1])
    for i in range(len(BANDS) - 2, -1, -1):
        here = hue < BANDS[i + 1]
        band = F.when(here, i).otherwise(band)
        after = F.when(here, i + 1).otherwise(after)
        weight = F.when(here, (hue - BANDS[i]) / (BANDS[i + 1] - BANDS[i])).otherwise(weight)
    return band, after, weight


def mixed_bands(df: DataFrame, adjust: list[tuple[float, float, float]], names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """The eight-band mixer: (hue, saturation, luminance) of each band, linear between their centres.

    Works in named steps, so that no step's expression is repeated in the next.
    """
    rgb = tuple(F.col(n) for n in names)
    d = df.withColumns(dict(zip(("_h", "_s", "_v"), hsv(rgb))))
    band, after, weight = spanning(F.col("_h"))
    d = d.withColumns({"_band": band, "_after": after, "_weight": weight})

    def of(k: int) -> Column:
        table = F.array(*[F.lit(a[k]) for a in adjust])
        return blend(F.get(table, F.col("_band")), F.get(table, F.col("_after")), F.col("_weight"))

    d = d.withColumns({"_turn": F.pmod(F.col("_h") + of(0) * HUE_RANGE, F.lit(360.0)), "_gain": F.greatest(1.0 + of(1), F.lit(0.0)), "_light": F.greatest(1.0 + of(2), F.lit(0.0))})
    d = d.withColumns(dict(zip(("_tr", "_tg", "_tb"), rgb_of(F.col("_turn"), F.col("_s"), F.col("_v")))))
    turned = (F.col("_tr"), F.col("_tg"), F.col("_tb"))
    d = d.withColumn("_grey", dot(turned))
    out = each(turned, lambda c: (F.col("_grey") + (c - F.col("_grey")) * F.col("_gain")) * F.col("_light"))
    d = d.withColumns({n: F.when(F.col("_s") > 0, o).otherwise(c) for n, o, c in zip(names, out, rgb)})
    return d.drop("_h", "_s", "_v", "_band", "_after", "_weight", "_turn", "_gain", "_light", "_tr", "_tg", "_tb", "_grey")


def graded(df: DataFrame, shadows: tuple, midtones: tuple, highlights: tuple, blending: float = 0.5, balance: float = 0.0, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Three-way grading, each (hue, saturation, luminance), weighted by luma about a pivot; in named steps."""
    rgb = tuple(F.col(n) for n in names)
    d = df.withColumn("_y", clamp(dot(rgb), 0.0, 1.0))
    d = d.withColumn("_luma", encode_srgb(F.col("_y")))
    pivot = min(max(0.5 + balance * 0.35, 0.05), 0.95)
    steep = 1.0 + (1.0 - min(max(blending, 0.0), 1.0)) * 4.0
    dark = F.col("_luma") < pivot
    d = d.withColumn("_x", clamp(F.when(dark, F.col("_luma") / pivot).otherwise((F.col("_luma") - pivot) / max(1.0 - pivot, 1e-4)), 0.0, 1.0))
    d = d.withColumns({"_a": F.pow("_x", F.lit(steep)), "_b": F.pow(1.0 - F.col("_x"), F.lit(steep))})
    d = d.withColumn("_w", F.when(F.col("_a") + F.col("_b") > 1e-12, F.col("_a") / F.greatest(F.col("_a") + F.col("_b"), F.lit(1e-12))).otherwise(0.5))
    weights = (F.when(dark, 1.0 - F.col("_w")).otherwise(0.0), F.when(dark, F.col("_w")).otherwise(1.0 - F.col("_w")), F.when(dark, 0.0).otherwise(F.col("_w")))
    for (hue, saturation, luminance), w in zip((shadows, midtones, highlights), weights):
        wanted = _plain_rgb(hue)
        there = max(sum(a * b for a, b in zip(wanted, LUMA)), 1e-4)
        d = d.withColumns({"_here": dot(rgb), "_t": clamp(w * saturation * GRADE_REACH, 0.0, 1.0), "_lift": F.greatest(1.0 + w * luminance * GRADE_LIFT, F.lit(0.0))})
        d = d.withColumns({n: blend(c, F.col("_here") * (k / there), F.col("_t")) * F.col("_lift") for n, c, k in zip(names, rgb, wanted)})
    return d.drop("_y", "_luma", "_x", "_a", "_b", "_w", "_here", "_t", "_lift")


def _plain_rgb(hue: float) -> list[float]:
    out = []
    for n in (5.0, 3.0, 1.0):
        k = (hue / 60.0 + n) % 6.0
        out.append(1.0 - min(max(min(k, 4.0 - k), 0.0), 1.0))
    return out


def contrasted(p: Column, k: float) -> Column:
    """A power curve either side of the pivot."""
    low = TONE_PIVOT * F.pow(p / TONE_PIVOT, F.lit(k))
    high = 1.0 - (1.0 - TONE_PIVOT) * F.pow((1.0 - p) / (1.0 - TONE_PIVOT), F.lit(k))
    return F.when(p <= TONE_PIVOT, low).otherwise(high)


def shadow_highlight(p: Column, highlights: float, shadows: float) -> Column:
    v, u = p / TONE_PIVOT, (1.0 - p) / (1.0 - TONE_PIVOT)
    taper = (1.0 - v) * (1.0 + SHADOW_REACH * v * v)
    low = TONE_PIVOT * F.pow(F.when(p <= TONE_PIVOT, v).otherwise(1.0), 1.0 - shadows * TONE_TAPER * taper)
    high = 1.0 - (1.0 - TONE_PIVOT) * F.pow(F.when(p <= TONE_PIVOT, 1.0).otherwise(u), 1.0 + highlights * TONE_TAPER * (1.0 - u))
    return F.when(p <= TONE_PIVOT, low).otherwise(high)


def tone_shaped(y: Column, contrast: float, highlights: float, shadows: float) -> Column:
    p = clamp(F.pow(F.greatest(y, F.lit(0.0)), F.lit(1 / TONE_GAMMA)), 0.0, 1.0)
    return shadow_highlight(contrasted(p, contrast), highlights, shadows)


def levelled(rgb: RGB, black: float, white: float, keep: float = 1.0) -> RGB:
    """Black and white points; colours that would clip keep their hue, bleaching as they near white."""
    u = each(rgb, lambda c: (c - black) / (white - black))
    hi, lo = F.greatest(*u), F.least(*u)
    full = F.greatest(hi / F.greatest(lo, F.lit(EPS)), F.lit(1.0))
    t = clamp((hi - 1.0) / F.greatest(full - 1.0, F.lit(EPS)), 0.0, 1.0)

    def channel(c: Column) -> Column:
        flat = clamp(c, 0.0, 1.0)
        bleached = blend(c / F.greatest(hi, F.lit(EPS)), F.lit(1.0), t)
        kept = clamp(flat * (1.0 - keep) + bleached * keep, 0.0, 1.0)
        return F.pow(F.when((hi <= 1.0) | F.lit(keep <= 0), flat).otherwise(kept), F.lit(TONE_GAMMA))

    return each(u, channel)


def tone_mapped(x: Column) -> Column:
    c = F.greatest(x, F.lit(0.0))
    return c / (c + TONE_MAP_K)


def hue_preserved(source: RGB, mapped: RGB, norm: Column, peak: Column, keep: float) -> RGB:
    """Between a per-channel map and one that keeps the channels' ratios, bleached near white."""
    kept = each(source, lambda c: F.greatest(c, F.lit(0.0)) * (peak / F.greatest(norm, F.lit(EPS))))
    saturation = 1.0 - F.pow(F.least(*kept) / F.greatest(peak, F.lit(EPS)), F.lit(1 / TONE_GAMMA))
    onset = blend(F.lit(BLEACH_NEUTRAL), F.lit(BLEACH_FROM), smoothstep(0.0, BLEACH_COLOURED, saturation))
    bleach = smoothstep(onset, 1.0, peak)
    out = tuple(F.when(norm <= EPS, m).otherwise(m * (1.0 - keep) + blend(k, peak, bleach) * keep) for m, k in zip(mapped, kept))
    return out if keep > 0 else mapped  # type: ignore[return-value]


def dehazed(rgb: RGB, around: RGB, airlight: tuple[float, float, float], amount: float, level: float) -> RGB:
    """Dark-channel haze removal with the transmission bounded either way."""
    dark = F.least(*around)
    t = clamp(1.0 - HAZE_OMEGA * amount * clamp(dark / level, 0.0, 1.0), HAZE_FLOOR, HAZE_CEILING)
    return tuple(F.greatest((c - a * (1.0 - t)) / t, F.lit(0.0)) for c, a in zip(rgb, airlight))  # type: ignore[return-value]


def against(c: Column, pivot: Column | float, amount: float) -> Column:
    """Contrast about a pivot in the gamma space: clarity if the pivot is the neighbourhood's mean."""
    around = F.greatest(lit(pivot), F.lit(EPS))
    coded = F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / TONE_GAMMA))
    return F.pow(around * F.pow(F.greatest(coded / around, F.lit(EPS)), F.lit(1.0 + amount)), F.lit(TONE_GAMMA))


def falloff(x: Column, y: Column, width: Column, height: Column, amount: float) -> Column:
    """Lens falloff 1 + a r^4, r being 1 in the corners."""
    r2 = (F.pow(x - width / 2, F.lit(2.0)) + F.pow(y - height / 2, F.lit(2.0))) / (F.pow(width / 2, F.lit(2.0)) + F.pow(height / 2, F.lit(2.0)))
    return F.greatest(1.0 + amount * r2 * r2, F.lit(0.05))


def vignette(x: Column, y: Column, width: Column, height: Column, midpoint: float, roundness: float, feather: float) -> Column:
    """How far the vignette acts at a place: a superellipse's radius, stepped about the midpoint."""
    n = 2.0 ** (1.0 + roundness * 2.0)
    dx, dy = F.abs(x - width / 2) / F.greatest(width / 2, F.lit(1.0)), F.abs(y - height / 2) / F.greatest(height / 2, F.lit(1.0))
    r = F.pow(F.pow(dx, F.lit(n)) + F.pow(dy, F.lit(n)), F.lit(1 / n)) / 2.0 ** (1 / n)
    wide = max(feather, 0.004) / 2
    return smoothstep(midpoint - wide, midpoint + wide, r)


def matrix(rgb: RGB, rows: tuple[tuple[float, float, float], ...]) -> RGB:
    return tuple(dot(rgb, row) for row in rows)  # type: ignore[return-value]


#: Linear sRGB to XYZ adapted to D50.
SRGB_XYZ = ((0.4360747, 0.3850649, 0.1430804), (0.2225045, 0.7168786, 0.0606169), (0.0139322, 0.0971045, 0.7141733))


def lab(xyz: RGB, white: tuple[float, float, float] = WHITE_D50) -> RGB:
    def f(c: Column) -> Column:
        return F.when(c > 216 / 24389, F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 3))).otherwise((c * (24389 / 27) + 16.0) / 116.0)

    x, y, z = (f(c / w) for c, w in zip(xyz, white))
    return y * 116.0 - 16.0, (x - y) * 500.0, (y - z) * 200.0


def lab_inverse(colour: RGB, white: tuple[float, float, float] = WHITE_D50) -> RGB:
    """The XYZ of a Lab colour."""

    def cube(c: Column) -> Column:
        third = c * c * c
        return F.when(third > 216 / 24389, third).otherwise((c * 116.0 - 16.0) * (27 / 24389))

    y = (colour[0] + 16.0) / 116.0
    x, z = y + colour[1] / 500.0, y - colour[2] / 200.0
    return tuple(cube(c) * w for c, w in zip((x, y, z), white))  # type: ignore[return-value]


#: The range of colour temperatures, tint steps to a unit of the chromaticity diagram, and the temperatures of illuminant codes.
KELVIN_LOW, KELVIN_HIGH, TINT_STEPS = 1667.0, 25000.0, 3000.0
ILLUMINANTS = {1: 5500, 2: 4200, 3: 2856, 4: 5500, 10: 5500, 11: 6500, 12: 7500, 17: 2856, 18: 4874, 19: 6774, 20: 5503, 21: 6504, 22: 7504, 23: 5003}
#: The published cubic fits of the blackbody locus, x in 1000 / T below and above 4000 K, y in x by ranges.
LOCUS_X = ((-0.2661239, -0.2343589, 0.8776956, 0.179910), (-3.0258469, 2.1070379, 0.2226347, 0.240390))
LOCUS_Y = ((-1.1063814, -1.3481102, 2.1855583, -0.20219683), (-0.9549476, -1.3741859, 2.0913702, -0.16748867), (3.081758, -5.8733867, 3.75113, -0.37001483))


def illuminant_kelvin(code: Column) -> Column:
    """The temperature of an illuminant code; of an unknown one that of daylight."""
    out = F.lit(6504.0)
    for known, kelvin in ILLUMINANTS.items():
        out = F.when(code == known, float(kelvin)).otherwise(out)
    return out


def _cubic(x: Column, c: tuple[float, float, float, float]) -> Column:
    return ((x * c[0] + c[1]) * x + c[2]) * x + c[3]


def locus(kelvin: Column) -> tuple[Column, Column]:
    """The blackbody of a temperature in the 1960 uniform chromaticity diagram."""
    t = F.lit(1000.0) / kelvin
    x = F.when(kelvin < 4000, _cubic(t, LOCUS_X[0])).otherwise(_cubic(t, LOCUS_X[1]))
    y = F.when(kelvin < 2222, _cubic(x, LOCUS_Y[0])).when(kelvin < 4000, _cubic(x, LOCUS_Y[1])).otherwise(_cubic(x, LOCUS_Y[2]))
    below = x * -2.0 + y * 12.0 + 3.0
    return x * 4.0 / below, y * 6.0 / below


def uv_of(xyz: RGB) -> tuple[Column, Column]:
    """A colour's place in the 1960 diagram; 0, 0 for none."""
    below = xyz[0] + xyz[1] * 15.0 + xyz[2] * 3.0
    none = F.abs(below) < 1e-9
    return F.when(none, 0.0).otherwise(xyz[0] * 4.0 / below), F.when(none, 0.0).otherwise(xyz[1] * 6.0 / below)


def white_point(df: DataFrame, kelvin: str, tint: str, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """``df`` with the XYZ (Y 1) of a light: a step along the locus's normal for each unit of tint, magenta positive."""
    own = df.columns
    t = clamp(F.col(kelvin), KELVIN_LOW, KELVIN_HIGH)
    d = df.withColumns({"_t": t, "_low": F.greatest(t * 0.999, lit(KELVIN_LOW)), "_high": F.least(t * 1.001, lit(KELVIN_HIGH))})
    for at in ("t", "low", "high"):
        u, v = locus(F.col(f"_{at}"))
        d = d.withColumns({f"_u{at}": u, f"_v{at}": v})
    d = d.withColumns({"_du": F.col("_uhigh") - F.col("_ulow"), "_dv": F.col("_vhigh") - F.col("_vlow")})
    length = F.greatest(F.sqrt(F.col("_du") * F.col("_du") + F.col("_dv") * F.col("_dv")), lit(1e-9))
    step = F.col(tint) / TINT_STEPS / length
    d = d.withColumns({"_u": F.col("_ut") - F.col("_dv") * step, "_v": F.col("_vt") + F.col("_du") * step})
    below = F.col("_u") * 2.0 - F.col("_v") * 8.0 + 4.0
    d = d.withColumns({"_x": F.col("_u") * 3.0 / below, "_y": F.col("_v") * 2.0 / below})
    none = F.abs("_y") < 1e-9
    x, z = F.col("_x") / F.col("_y"), (1.0 - F.col("_x") - F.col("_y")) / F.col("_y")
    return d.select(*own, F.when(none, WHITE_D50[0]).otherwise(x).alias(names[0]), F.lit(1.0).alias(names[1]), F.when(none, WHITE_D50[2]).otherwise(z).alias(names[2]))


def hash21(x: Column, y: Column) -> Column:
    """A cell's pseudo-random number in [0, 1), in double precision."""

    def part(c: Column) -> Column:
        return c - F.floor(c)

    a, b = part(x * 0.1031), part(y * 0.1030)
    turn = a * (b + 33.33) + b * (a + 33.33)
    a, b = a + turn, b + turn
    return part((a + b) * a)


def value_noise(x: Column, y: Column) -> Column:
    """Numbers of the four cells around a place, blended smoothly."""
    cx, cy = F.floor(x).cast("double"), F.floor(y).cast("double")
    fx, fy = x - cx, y - cy
    wx, wy = fx * fx * (3.0 - 2.0 * fx), fy * fy * (3.0 - 2.0 * fy)
    low = blend(hash21(cx, cy), hash21(cx + 1.0, cy), wx)
    return blend(low, blend(hash21(cx, cy + 1.0), hash21(cx + 1.0, cy + 1.0), wx), wy)


def delta_e_2000(df: DataFrame, p: tuple[str, str, str], q: tuple[str, str, str], name: str = "delta_e") -> DataFrame:
    """``df`` with the CIEDE2000 difference (unit weights) of two Lab colours, in named steps."""
    own = df.columns
    two = F.lit(2.0)

    def cosd(x: Column) -> Column:
        return F.cos(F.radians(x))

    d = df.withColumn("_c7", F.pow((F.hypot(p[1], p[2]) + F.hypot(q[1], q[2])) / 2, F.lit(7.0)))
    d = d.withColumn("_g", 1.5 - 0.5 * F.sqrt(F.col("_c7") / (F.col("_c7") + 25.0**7)))
    d = d.withColumns({"_a1": F.col(p[1]) * F.col("_g"), "_a2": F.col(q[1]) * F.col("_g")})
    for i, lab_ in (("1", p), ("2", q)):
        hue = F.pmod(F.degrees(F.atan2(F.col(lab_[2]), F.col("_a" + i))), F.lit(360.0))
        d = d.withColumns({"_c" + i: F.hypot("_a" + i, lab_[2]), "_h" + i: F.when((F.col("_a" + i) == 0) & (F.col(lab_[2]) == 0), 0.0).otherwise(hue)})
    d = d.withColumns({"_grey": F.col("_c1") * F.col("_c2") == 0, "_gap": F.col("_h2") - F.col("_h1"), "_sum": F.col("_h1") + F.col("_h2")})
    near = F.abs("_gap") <= 180
    d = d.withColumns(
        {
            "_dh": F.when(F.col("_grey"), 0.0).when(near, F.col("_gap")).when(F.col("_gap") > 180, F.col("_gap") - 360.0).otherwise(F.col("_gap") + 360.0),
            "_hm": F.when(F.col("_grey"), F.col("_sum")).when(near, F.col("_sum") / 2).when(F.col("_sum") < 360, (F.col("_sum") + 360.0) / 2).otherwise((F.col("_sum") - 360.0) / 2),
            "_cm": (F.col("_c1") + F.col("_c2")) / 2,
            "_off": F.pow((F.col(p[0]) + F.col(q[0])) / 2 - 50.0, two),
        }
    )
    hm, cm = F.col("_hm"), F.col("_cm")
    d = d.withColumns(
        {
            "_t": 1.0 - 0.17 * cosd(hm - 30.0) + 0.24 * cosd(hm * 2.0) + 0.32 * cosd(hm * 3.0 + 6.0) - 0.20 * cosd(hm * 4.0 - 63.0),
            "_cm7": F.pow(cm, F.lit(7.0)),
            "_turn": F.sin(F.radians(60.0 * F.exp(-F.pow((hm - 275.0) / 25.0, two)))),
        }
    )
    d = d.withColumns(
        {
            "_l": (F.col(q[0]) - F.col(p[0])) / (1.0 + 0.015 * F.col("_off") / F.sqrt(20.0 + F.col("_off"))),
            "_c": (F.col("_c2") - F.col("_c1")) / (1.0 + 0.045 * cm),
            "_h": 2.0 * F.sqrt(F.col("_c1") * F.col("_c2")) * F.sin(F.radians(F.col("_dh") / 2)) / (1.0 + 0.015 * cm * F.col("_t")),
            "_r": -2.0 * F.sqrt(F.col("_cm7") / (F.col("_cm7") + 25.0**7)) * F.col("_turn"),
        }
    )
    l, c, h = F.col("_l"), F.col("_c"), F.col("_h")
    return d.select(*own, F.sqrt(F.greatest(l * l + c * c + h * h + F.col("_r") * c * h, F.lit(0.0))).alias(name))


def exposure(ev: Column | float) -> Column:
    return F.pow(F.lit(2.0), lit(ev))


def mired_blend(kelvin: Column, low: float, high: float) -> Column:
    """The weight of the higher temperature's matrix, linear in reciprocal temperature."""
    return clamp((1e6 / kelvin - 1e6 / low) / (1e6 / high - 1e6 / low), 0.0, 1.0)


def invert3(m: list[list[float]]) -> list[list[float]] | None:
    """The inverse of a 3x3 matrix by cofactors; None if it is singular."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    if not math.isfinite(det) or abs(det) < 1e-12:
        return None
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]
