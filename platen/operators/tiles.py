"""Tile operators that expressions over arrays can't express well: numpy on Arrow batches.

Each works on a stack of tiles at once, (n, height, width) in double
precision, and is applied by mapped() to rows of array<double>.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def mapped(tiles: DataFrame, key: str, column: str, width: int, height: int, run, out: str = "t") -> DataFrame:
    """Rows (key, out) of run(stack) for rows of (key, array of width * height); other lengths and nulls give null.

    run gives (n, ...) values, flattened row by row. Batches of 256 tiles bound the memory.
    """
    kind = tiles.schema[key].dataType.simpleString()
    size = width * height

    def do(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                values = batch.column("v").to_pylist()
                good = [i for i, v in enumerate(values) if v is not None and len(v) == size and None not in v]
                result: list = [None] * len(values)
                if good:
                    stack = np.array([values[i] for i in good], float).reshape(-1, height, width)
                    for i, r in zip(good, np.asarray(run(stack)).reshape(len(good), -1)):
                        result[i] = r
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(result, pa.list_(pa.float64()))], names=[key, out])

    return tiles.select(key, tiles[column].cast("array<double>").alias("v")).mapInArrow(do, f"{key} {kind}, {out} array<double>")


def shifted(a: np.ndarray, dy: int, dx: int, mode: str) -> np.ndarray:
    """a[y + dy, x + dx], with places beyond the border by numpy's padding mode (reflect, edge)."""
    py, px = abs(dy), abs(dx)
    b = np.pad(a, ((0, 0), (py, py), (px, px)), mode=mode)
    return b[:, py + dy : py + dy + a.shape[1], px + dx : px + dx + a.shape[2]]


def phases(height: int, width: int, pattern: str = "RGGB") -> np.ndarray:
    """For each place which of R, G and B a mosaic measures there (0, 1, 2)."""
    code = np.array(["RGB".index(c) for c in pattern]).reshape(2, 2)
    return np.tile(code, (-(-height // 2), -(-width // 2)))[:height, :width]


def demosaiced(mosaic: np.ndarray, pattern: str = "RGGB") -> np.ndarray:
    """A mosaic's full colours (n, h, w, 3).

    Green is filled along the direction that changes less, corrected by the
    ratio to the local mean of what is measured; red and blue follow by their
    ratio to green. Measured values stay as they are; borders are mirrored,
    which keeps the phases.
    """
    n, h, w = mosaic.shape
    site = phases(h, w, pattern)
    eps = 1e-5
    m = np.maximum(mosaic, 0.0)

    def at(a, dy, dx):
        return shifted(a, dy, dx, "reflect")

    across = np.abs(at(m, 0, -1) - at(m, 0, 1)) + np.abs(2 * m - at(m, 0, -2) - at(m, 0, 2))
    down = np.abs(at(m, -1, 0) - at(m, 1, 0)) + np.abs(2 * m - at(m, -2, 0) - at(m, 2, 0))
    low_x = (2 * m + at(m, 0, -2) + at(m, 0, 2)) / 4
    low_y = (2 * m + at(m, -2, 0) + at(m, 2, 0)) / 4
    green_x = (at(m, 0, -1) + at(m, 0, 1)) / 2 * (m + eps) / (low_x + eps)
    green_y = (at(m, -1, 0) + at(m, 1, 0)) / 2 * (m + eps) / (low_y + eps)
    share = (down + eps) / (across + down + 2 * eps)
    green = np.where(site == 1, m, share * green_x + (1 - share) * green_y)
    out = np.empty((n, h, w, 3))
    out[..., 1] = green
    kernel = [(dy, dx, (1 if not (dy or dx) else 0.5 if not (dy and dx) else 0.25)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    for c in (0, 2):
        here = (site == c)[None]
        ratio = np.where(here, (m + eps) / (green + eps), 0.0)
        count = here.astype(float) * np.ones_like(m)
        top = sum(k * at(ratio, dy, dx) for dy, dx, k in kernel)
        weight = sum(k * at(count, dy, dx) for dy, dx, k in kernel)
        filled = (green + eps) * top / np.maximum(weight, eps) - eps
        out[..., c] = np.where(here, m, np.maximum(filled, 0.0))
    return out


_FIVE = np.array([1, 4, 6, 4, 1]) / 16


def down2(a: np.ndarray) -> np.ndarray:
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        b = np.pad(a, pad, mode="edge")
        n = a.shape[axis]
        a = sum(k * np.take(b, np.arange(i, i + n, 1)[::2], axis) for i, k in enumerate(_FIVE))
    return a


def up2(a: np.ndarray, height: int, width: int) -> np.ndarray:
    for axis, size in ((1, height), (2, width)):
        shape = list(a.shape)
        shape[axis] = size
        b = np.zeros(shape)
        spread = [slice(None)] * 3
        spread[axis] = slice(0, size, 2)
        b[tuple(spread)] = a
        pad = [(0, 0)] * 3
        pad[axis] = (2, 2)
        b = np.pad(b, pad, mode="edge")
        a = sum(2 * k * np.take(b, np.arange(i, i + size), axis) for i, k in enumerate(_FIVE))
    return a


def remapped(a: np.ndarray, centre: np.ndarray | float, sigma: float, power: float) -> np.ndarray:
    """Detail about a level raised to a power within sigma, its sign kept; beyond it unchanged."""
    d = a - centre
    inside = np.abs(d) <= sigma
    return np.where(inside, centre + np.sign(d) * sigma * (np.abs(d) / sigma) ** power, a)


def local_laplacian(a: np.ndarray, sigma: float = 0.2, power: float = 0.7, levels: int = 8, depth: int = 3) -> np.ndarray:
    """Edge-aware detail change: each pyramid level is taken from tiles remapped about the local mean's two nearest levels."""
    low, high = a.min(), a.max()
    if high <= low:
        return a
    steps = np.linspace(low, high, levels)
    gauss = [a]
    for _ in range(depth):
        if min(gauss[-1].shape[1:]) < 2:
            break
        gauss.append(down2(gauss[-1]))
    out = [np.zeros_like(g) for g in gauss[:-1]] + [gauss[-1]]
    for k, s in enumerate(steps):
        g = [remapped(a, s, sigma, power)]
        for _ in gauss[1:]:
            g.append(down2(g[-1]))
        for i in range(len(gauss) - 1):
            lap = g[i] - up2(g[i + 1], *g[i].shape[1:])
            near = np.clip(1 - np.abs(gauss[i] - s) / (steps[1] - steps[0]), 0, 1)
            out[i] += near * lap
    done = out[-1]
    for level in out[-2::-1]:
        done = up2(done, *level.shape[1:]) + level
    return done


def cubic_weights(t: np.ndarray) -> np.ndarray:
    """Catmull-Rom weights of the four neighbours of a fraction."""
    return np.stack([(-t**3 + 2 * t**2 - t) / 2, (3 * t**3 - 5 * t**2 + 2) / 2, (-3 * t**3 + 4 * t**2 + t) / 2, (t**3 - t**2) / 2])


def warped(a: np.ndarray, source, height: int, width: int) -> np.ndarray:
    """Reads the tile at source(x, y) of each target pixel, bicubic, edges clamped."""
    y, x = np.mgrid[0:height, 0:width].astype(float)
    sx, sy = source(x, y)
    ix, iy = np.floor(sx).astype(int), np.floor(sy).astype(int)
    wx, wy = cubic_weights(sx - ix), cubic_weights(sy - iy)
    out = np.zeros((len(a), height, width))
    for j in range(4):
        for i in range(4):
            rows = np.clip(iy + j - 1, 0, a.shape[1] - 1)
            cols = np.clip(ix + i - 1, 0, a.shape[2] - 1)
            out += a[:, rows, cols] * (wx[i] * wy[j])
    return out


def rotation(degrees: float, height: int, width: int, scale: float = 1.0):
    """The source of a turn about the centre, for warped()."""
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    cx, cy = (width - 1) / 2, (height - 1) / 2
    return lambda x, y: ((c * (x - cx) - s * (y - cy)) / scale + cx, (s * (x - cx) + c * (y - cy)) / scale + cy)


def homography(h: np.ndarray):
    """The source under a 3x3 projective map, for warped()."""

    def source(x, y):
        z = h[2, 0] * x + h[2, 1] * y + h[2, 2]
        return (h[0, 0] * x + h[0, 1] * y + h[0, 2]) / z, (h[1, 0] * x + h[1, 1] * y + h[1, 2]) / z

    return source


def healed(a: np.ndarray, centre: tuple[float, float], source: tuple[float, float], radius: float, feather: float = 0.5, clone: bool = False, phase: int = 2) -> np.ndarray:
    """A disc replaced by one shifted by whole phases, its brightness matched by the rings' means (1/4 to 4)."""
    if radius < 0.5:
        return a
    n, h, w = a.shape
    y, x = np.mgrid[0:h, 0:w]
    dx, dy = (int(round((s - c) / phase)) * phase for s, c in zip(source, centre))
    r = np.hypot(x - centre[0], y - centre[1])
    t = np.clip((radius - r) / max(radius * feather, 1e-6), 0, 1)
    weight = t * t * (3 - 2 * t)
    moved = a[:, np.clip(y + dy, 0, h - 1), np.clip(x + dx, 0, w - 1)]
    gain = np.ones((n, 1, 1))
    ring = (r >= radius) & (r <= radius * 1.5 + 1)
    if not clone and ring.any():
        here, there = a[:, ring].mean(1), moved[:, ring].mean(1)
        gain = np.clip(np.where(np.abs(there) > 1e-9, here / np.where(np.abs(there) > 1e-9, there, 1), 1), 0.25, 4)[:, None, None]
    return a * (1 - weight) + moved * gain * weight


def curve_lut(points: list[tuple[float, float]], size: int = 256) -> np.ndarray:
    """A monotone cubic through the points (Fritsch and Carlson's slopes), sampled at ``size`` places of 0..1."""
    x, y = np.array(points, float).T
    d = np.diff(y) / np.diff(x)
    m = np.concatenate([[d[0]], (d[:-1] + d[1:]) / 2, [d[-1]]])
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0
            continue
        a, b = m[i] / s, m[i + 1] / s
        if a < 0 or b < 0:
            m[i], m[i + 1] = max(a, 0) * s, max(b, 0) * s
            a, b = max(a, 0), max(b, 0)
        if a * a + b * b > 9:
            k = 3 / np.hypot(a, b)
            m[i], m[i + 1] = k * a * s, k * b * s
    at = np.linspace(0, 1, size)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(d) - 1)
    h = x[i + 1] - x[i]
    t = np.clip((at - x[i]) / h, 0, 1)
    return (1 + 2 * t) * (1 - t) ** 2 * y[i] + t * (1 - t) ** 2 * h * m[i] + t * t * (3 - 2 * t) * y[i + 1] + t * t * (t - 1) * h * m[i + 1]


def looked_up(values: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """Linear between a table's entries; outside 0..1 its ends."""
    return np.interp(values, np.linspace(0, 1, len(lut)), lut)


def hue_sat_mapped(hsv: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A (hue, saturation, value, 3) table of (degrees, factor, factor), trilinear, hue going round."""
    n = table.shape[:3]
    h = hsv[..., 0] / 360 * n[0]
    s, v = np.clip(hsv[..., 1], 0, 1) * (n[1] - 1), np.clip(hsv[..., 2], 0, 1) * (n[2] - 1)
    ih, i_s, iv = np.floor(h).astype(int), np.minimum(np.floor(s).astype(int), max(n[1] - 2, 0)), np.minimum(np.floor(v).astype(int), max(n[2] - 2, 0))
    out = np.zeros(hsv.shape)
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                k = np.abs(1 - a - (h - ih)) * np.abs(1 - b - (s - i_s)) * np.abs(1 - c - (v - iv))
                out += k[..., None] * table[(ih + a) % n[0], np.minimum(i_s + b, n[1] - 1), np.minimum(iv + c, n[2] - 1)]
    return np.stack([(hsv[..., 0] + out[..., 0]) % 360, np.clip(hsv[..., 1] * out[..., 1], 0, 1), hsv[..., 2] * out[..., 2]], -1)


def defringed(rgb: np.ndarray, clip: float = 0.95, reach: int = 4, amount: float = 1.0) -> np.ndarray:
    """Pulls colours near blown places towards grey, more the nearer: a maximum of weights falling off with distance."""
    blown = np.clip((rgb.max(-1) - (clip - 0.25)) / 0.25, 0, 1)
    near = np.zeros_like(blown)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            fall = max(0.0, 1 - np.hypot(dy, dx) / (reach + 1))
            near = np.maximum(near, fall * shifted(blown, dy, dx, "edge"))
    weight = amount * near * (1 - blown)
    grey = rgb @ np.array([0.2126, 0.7152, 0.0722])
    return rgb + (grey[..., None] - rgb) * weight[..., None]
