import math

import numpy as np
import pytest

from seqloom.functions import kernels as K

RNG = np.random.default_rng(7)


def series(n=60, high=14, longest=25):
    return [RNG.integers(0, high, RNG.integers(2, longest)).astype(float) for _ in range(n)]


def in_band(i, j, n, m, constraint):
    if constraint is None:
        return True
    if constraint == "sakoe_chiba":
        return j - 5 <= i <= j + n - m + 5 if n > m else i - 5 <= j <= i + m - n + 5
    steep, flat = 3.0 * n / m, n / m / 3.0
    low = max(round(flat * j, 2), round(n - 1 - steep * (m - 1 - j), 2))
    high = min(round(steep * j, 2), round(n - 1 - flat * (m - 1 - j), 2))
    return math.ceil(low) <= i <= math.floor(high)


def brute(metric, a, b, constraint=None):
    n, m = len(a), len(b)
    start = 0.0 if metric == "lcss" else math.inf
    acc = [[start] * (m + 1) for _ in range(n + 1)]
    acc[0][0] = 0.0
    for i in range(n):
        for j in range(m):
            dg, up, lf, c = acc[i][j], acc[i][j + 1], acc[i + 1][j], (a[i] - b[j]) ** 2
            if not in_band(i, j, n, m, constraint):
                continue
            if metric == "lcss":
                acc[i + 1][j + 1] = dg + 1 if abs(a[i] - b[j]) <= 1 else max(up, lf)
            elif metric == "softdtw":
                low = min(dg, up, lf)
                acc[i + 1][j + 1] = c + low - math.log(sum(math.exp(low - x) for x in (dg, up, lf)))
            else:
                acc[i + 1][j + 1] = c + min(dg, up, lf)
    end = acc[n][m]
    return 1 - end / min(n, m) if metric == "lcss" else end if metric == "softdtw" else math.sqrt(end)


@pytest.mark.parametrize("metric,constraint", [
    ("dtw", None), ("dtw", "sakoe_chiba"), ("dtw", "itakura"), ("lcss", None), ("lcss", "sakoe_chiba"),
    ("lcss", "itakura"), ("softdtw", None)])
def test_against_cell_by_cell(metric, constraint):
    a, b = series(), series()
    got = K.distances(metric, a, b, constraint)
    assert np.allclose(got, [brute(metric, x, y, constraint) for x, y in zip(a, b)])


def test_golden_and_properties():
    assert K.distances("dtw", [np.array([1., 2, 3, 3])], [np.array([1., 2, 2, 4])])[0] == pytest.approx(math.sqrt(2))
    a, b = series(), series()
    assert np.allclose(K.distances("dtw", a, a), 0)
    assert np.allclose(K.distances("dtw", a, b), K.distances("dtw", b, a))
    assert np.all(K.distances("ctw", a[:10], a[:10]) < 1e-6)


def test_equal_length_limit_keeps_everything_within():
    a = RNG.integers(0, 6, (400, 12)).astype(float)
    b = RNG.integers(0, 6, (400, 12)).astype(float)
    exact = np.array([brute("dtw", x, y) for x, y in zip(a, b)])
    rows = np.arange(len(a))
    got = K.equal_length_dtw(a, b, rows, rows, 3.0)
    assert np.allclose(got[exact <= 3], exact[exact <= 3])
    assert np.all(got[exact > 3] > 3)


def test_fluss_finds_a_change_of_regime():
    t = np.arange(120)
    ts = np.where(t < 60, np.sin(t * 0.8) * 5, np.sign(np.sin(t * 0.35)) * 4)
    found = K.fluss_boundaries(ts, 6, 2)
    assert len(found) == 1 and abs(found[0] - 60) <= 12
    assert K.fluss_boundaries(np.arange(3.0), 3, 4) == []


@pytest.mark.parametrize("scale", [1.0, 1e13])
def test_near_pairs_are_those_of_all_pairs_within_a_cell(scale):
    """Bounds and single precision leave out no pair; rows of different cells and non-finite rows have none."""
    rng = np.random.default_rng(5)
    steps = rng.integers(0, 6, (150, 4)).astype(float)
    a, b = (np.repeat(x, 3, axis=1) + rng.choice([0.0, 0.1], (len(x), 12)) for x in (steps[:70], steps[40:]))
    a[3, 4], b[5, 0] = np.nan, np.inf
    a, b, limit = a * scale, b * scale, 2.5 * scale
    cell_a, cell_b = np.arange(70) % 3, np.arange(110) % 4
    ia, ib = (x.ravel() for x in np.meshgrid(np.arange(70), np.arange(110), indexing="ij"))
    same = (cell_a[ia] == cell_b[ib]) & np.isfinite(a[ia]).all(axis=1) & np.isfinite(b[ib]).all(axis=1)
    ia, ib = ia[same], ib[same]
    d = np.round(K.equal_length_dtw(a, b, ia, ib, limit), 9)
    want = sorted((i, j, x) for i, j, x in zip(ia, ib, d) if x <= limit)
    for rows in (1, 7, 64):
        assert sorted(zip(*K.near_pairs(a, b, limit, None, cell_a, cell_b, rows))) == want
    best = sorted(zip(*K.near_pairs(a, b, limit, 2, cell_a, cell_b)))
    assert set(best) <= set(want) and len(want) > 20
    for i in range(70):
        nearest = lambda rows: sorted(x for q, _, x in rows if q == i)[:2]
        assert nearest(best) == nearest(want)


@pytest.mark.parametrize("constraint,radius", [(None, 5), ("sakoe_chiba", 0), ("sakoe_chiba", 2), ("itakura", 5)])
def test_pairs_of_one_block_with_different_bands(constraint, radius):
    """Distances of pairs of many lengths at once are those of each pair alone; beyond its limit a pair may be infinite."""
    rnd = np.random.default_rng(3)
    a, b = ([rnd.integers(0, 9, rnd.integers(1, 25)).astype(float) for _ in range(60)] for _ in range(2))
    each = []
    for x, y in zip(a, b):
        acc = np.full((len(x) + 1, len(y) + 1), np.inf)
        acc[0, 0] = 0.0
        for i, j in np.ndindex(len(x), len(y)):
            size = [np.array([len(x)]), np.array([len(y)])]
            if constraint is None or K._allowed(np.array([i]), np.array([j]), *size, constraint, radius, 3.0)[0, 0]:
                acc[i + 1, j + 1] = (x[i] - y[j]) ** 2 + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
        each.append(np.sqrt(acc[-1, -1]))
    assert K.distances("dtw", a, b, constraint, radius).tolist() == each
    limit, at = rnd.uniform(1, 25, 60), np.arange(60)
    near = K.dtw_within(a, b, at, at, limit, False, constraint, radius)
    assert [x for x, y, m in zip(near, each, limit) if y <= m] == [y for y, m in zip(each, limit) if y <= m]
    assert all(x == y or x == np.inf for x, y, m in zip(near, each, limit) if y > m)
