import numpy as np

from platen.operators import tiles as T


def test_flat_and_measured_values_stay():
    flat = np.full((2, 8, 8), 0.4)
    assert np.allclose(T.demosaiced(flat), 0.4)
    rng = np.random.default_rng(0)
    for pattern in ("RGGB", "BGGR", "GRBG", "GBRG"):
        m = rng.random((3, 10, 12))
        out, site = T.demosaiced(m, pattern), T.phases(10, 12, pattern)
        for c in range(3):
            assert np.allclose(out[:, site == c, c], m[:, site == c])


def test_demosaicing_a_smooth_field_beats_neighbours():
    y, x = np.mgrid[0:32, 0:32] / 32
    field = np.stack([0.3 + 0.3 * x, 0.4 + 0.2 * y, 0.5 + 0.2 * x * y], -1)
    site = T.phases(32, 32)
    mosaic = np.take_along_axis(field, site[..., None], -1)[None, ..., 0]
    gap = np.abs(T.demosaiced(mosaic)[0] - field)[4:-4, 4:-4]
    assert gap.max() < 0.01


def test_pyramids_and_laplacian_identity():
    a = np.random.default_rng(1).random((2, 9, 12))
    assert T.down2(a).shape == (2, 5, 6)
    assert np.allclose(T.local_laplacian(a, power=1.0), a)
    assert np.std(T.local_laplacian(a, power=0.5) - a) > 0


def test_warps():
    a = np.random.default_rng(2).random((1, 7, 9))
    assert np.allclose(T.warped(a, lambda x, y: (x, y), 7, 9), a)
    assert np.allclose(T.warped(a, T.rotation(180, 7, 9), 7, 9), a[:, ::-1, ::-1])
    assert np.allclose(T.warped(a, T.homography(np.eye(3)), 7, 9), a)
    t = np.linspace(0, 1, 11)
    assert np.allclose(T.cubic_weights(t).sum(0), 1)


def test_healing_leaves_the_rest_alone():
    a = np.ones((1, 16, 16))
    a[0, 4:6, 4:6] = 9
    out = T.healed(a, (4.5, 4.5), (10.0, 10.0), 3.0, feather=0.2)
    assert np.allclose(out[0, 4:6, 4:6], 1, atol=0.35) and np.allclose(out[0, 9:], a[0, 9:])
    assert T.healed(a, (4, 4), (9, 9), 0.3) is a


def test_curves_are_monotone_and_meet_their_points():
    points = [(0, 0), (0.2, 0.6), (0.25, 0.6), (0.9, 0.7), (1, 1)]
    lut = T.curve_lut(points, 1001)
    assert (np.diff(lut) >= -1e-12).all()
    assert np.allclose(T.looked_up(np.array([p[0] for p in points]), lut), [p[1] for p in points], atol=2e-3)


def test_hue_table_of_no_change_and_a_turn():
    hsv = np.random.default_rng(3).random((50, 3)) * [360, 1, 1]
    same = np.zeros((6, 4, 3, 3))
    same[..., 1:] = 1
    assert np.allclose(T.hue_sat_mapped(hsv, same), hsv)
    same[..., 0] = 10
    assert np.allclose(T.hue_sat_mapped(hsv, same)[:, 0], (hsv[:, 0] + 10) % 360)


def test_fringes_go_only_near_blown_places():
    rgb = np.full((1, 12, 24, 3), [0.2, 0.1, 0.6])
    rgb[:, :, :3] = 1.0
    out = T.defringed(rgb)
    assert np.allclose(out[:, :, 10:], rgb[:, :, 10:]) and np.ptp(out[0, 5, 3]) < np.ptp(rgb[0, 5, 3])
