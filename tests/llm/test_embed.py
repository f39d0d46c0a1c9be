"""Links of vectors by brute force: recall for each number of turns, components end to end, odd rows."""

import math

import numpy as np
import pytest

from platen.llm import embed


def pairs_at(cosine, n, dim, seed=1):
    """n pairs of unit vectors at that cosine."""
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return x, cosine * x + math.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("n", [100, 10_000, 10**6, 10**8, 10**10])
def test_buckets_bring_pairs_together_at_any_size(n):
    turns, tables = embed.search_plan(n, 64)
    x, y = pairs_at(0.95, 400, 64)
    a, b = (embed.codes(v, tables, turns, embed.PROBES) for v in (x, y))
    met = (a[:, :, 0] == b[:, :, 0]) | (a[:, :, 1:] == b[:, :, :1]).any(2) | (b[:, :, 1:] == a[:, :, :1]).any(2)
    assert met.any(1).mean() >= 0.95
    far = np.bitwise_count((embed._signs(x) ^ embed._signs(y)) >> np.uint64(1))
    assert (far <= embed.sketch_radius(0.95)).mean() >= 0.995


@pytest.mark.parametrize("plan", [(1, 2), (2, 4), (3, 7)])
def test_components_end_to_end(spark, monkeypatch, plan):
    monkeypatch.setattr(embed, "BLOCK", 64)
    monkeypatch.setattr(embed, "NUMBERS", 64 * 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 64))
    x = np.concatenate([x, x[:40] + rng.normal(size=(40, 64)) * 0.15, np.repeat(x[:2], 30, 0), x[9] + rng.normal(size=(200, 64)) * 0.12]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, True)
    label = np.arange(len(x))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, [float(v) for v in r], "a") for i, r in enumerate(x)], "vec_id long, embedding array<float>, n string").repartition(4)
    got = {r.vec_id: r for r in embed.near_duplicates(df, plan=plan).collect()}
    links = sum(r.n_links for r in got.values())
    assert 0.97 * (near.sum() - len(x)) <= links <= near.sum() - len(x)
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<int>, class long, n long, root string"
    rows = [(1, [3, 4], 5, 6, "x"), (1, [3, 4], 5, 6, "x"), (2, [6, 8], 5, 6, "x"), (3, [4, -3], 0, 0, ""), (None, [3, 4], None, None, None), (None, None, None, None, None), (4, [0, 0], 1, 1, "y"), (5, [None, 1], 1, 1, "y")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (3, 0, 3, True), (None, 3, 1, True), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True)], key=repr)
    assert embed.near_duplicates(spark.createDataFrame([], schema)).count() == 0
