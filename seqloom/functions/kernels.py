"""Elastic distances on batches of series pairs (NumPy, run inside Arrow batches).

Spark decides which pairs meet and where; these helpers only turn one batch of pairs into one
array of distances. All recurrences run on anti-diagonals over a whole block of pairs, so the
Python loop is over diagonals and never over pairs or cells.

Definitions: DTW is the square root of the cheapest sum of squared differences; LCSS is the
longest common subsequence within ``eps`` over the shorter length, returned as ``1 - sim``;
soft-DTW uses the soft minimum and no root (Cuturi & Blondel 2017).
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

CELLS = 4_000_000  # cells of the pairs of one block
PAIRS = 4_096  # pairs of one block of short series of equal length
NINE = Decimal("1e-9")


def _pad(series: list[np.ndarray], width: int) -> np.ndarray:
    """Columns are series: the pair axis is contiguous, so every step runs over whole rows."""
    out = np.zeros((width, len(series)))
    for i, s in enumerate(series):
        out[: len(s), i] = s
    return out


def _allowed(i: np.ndarray, j: np.ndarray, na: np.ndarray, nb: np.ndarray, constraint: str,
             radius: float, slope: float) -> np.ndarray:
    """Which of the cells (i, j) a path may use, per pair."""
    i, j = i[:, None], j[:, None]
    if constraint == "sakoe_chiba":
        slack = np.abs(na - nb)
        return np.where(na > nb, (j - radius <= i) & (i <= j + slack + radius),
                        (i - radius <= j) & (j <= i + slack + radius))
    if constraint == "itakura":
        steep, flat = slope * na / nb, na / nb / slope
        lower = np.maximum(np.round(flat * j, 2), np.round(na - 1 - steep * (nb - 1 - j), 2))
        upper = np.minimum(np.round(steep * j, 2), np.round(na - 1 - flat * (nb - 1 - j), 2))
        return (np.ceil(lower) <= i) & (i <= np.floor(upper))
    raise ValueError(f"unknown constraint {constraint!r}")


def _sweep(a: np.ndarray, b: np.ndarray, cell, combine, edge: float, rows: np.ndarray,
           cols: np.ndarray, limit: float | None = None) -> np.ndarray:
    """Fill a recurrence diagonal by diagonal; give cell (rows - 1, cols - 1) of each pair.

    ``cell(x, y, i, j)`` is the local value, ``combine(cell, diagonal, up, left)`` joins it with
    the three predecessors; outside the block they are ``edge``, and the virtual start before
    (0, 0) is 0. Only the two latest diagonals are kept, indexed by ``i + 1``. With a ``limit``,
    pairs whose two latest diagonals both exceed it everywhere are dropped as ``edge``.
    """
    n, m, size = len(a), len(b), a.shape[1]
    out = np.full(size, edge)
    alive = np.arange(size)
    older, old = np.full((n + 1, size), edge), np.full((n + 1, size), edge)
    older[0] = 0.0
    last = rows + cols - 2
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1), min(n - 1, d)
        i = np.arange(lo, hi + 1)
        x, y = a[lo:hi + 1], b[d - hi:d - lo + 1][::-1]
        new = np.full_like(old, edge)
        new[lo + 1:hi + 2] = combine(cell(x, y, i, d - i, alive), older[lo:hi + 1], old[lo:hi + 1], old[lo + 1:hi + 2])
        older, old = old, new
        ends = np.flatnonzero(last == d)
        out[alive[ends]] = new[rows[ends], ends]
        if limit is not None and d % 8 == 7:
            keep = np.minimum(old.min(axis=0), older.min(axis=0)) <= limit
            if keep.mean() < 0.8:
                a, b, older, old = a[:, keep], b[:, keep], older[:, keep], old[:, keep]
                alive, rows, cols, last = alive[keep], rows[keep], cols[keep], last[keep]
                if not len(alive):
                    break
    return out


def _soft_min(gamma: float):
    def combine(cell, diagonal, up, left):
        low = np.minimum(np.minimum(diagonal, up), left)
        safe = np.where(np.isfinite(low), low, 0.0)
        total = (np.exp(-(diagonal - safe) / gamma) + np.exp(-(up - safe) / gamma)
                 + np.exp(-(left - safe) / gamma))
        with np.errstate(divide="ignore"):
            return cell + safe - gamma * np.log(total)
    return combine


def _hard_min(cell, diagonal, up, left):
    best = np.minimum(diagonal, up)
    np.minimum(best, left, out=best)
    best += cell
    return best


def _square(x, y, i, j, alive):
    diff = x - y
    diff *= diff
    return diff


def _block(metric: str, a: list[np.ndarray], b: list[np.ndarray], constraint, radius, slope,
           eps, gamma) -> np.ndarray:
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    pa, pb = _pad(a, int(na.max())), _pad(b, int(nb.max()))

    def allowed(i, j, alive):
        return _allowed(i, j, na[alive], nb[alive], constraint, radius, slope)

    if metric == "lcss":
        def match(x, y, i, j, alive):
            code = (np.abs(x - y) <= eps).astype(float)
            return code if constraint is None else np.where(allowed(i, j, alive), code, -1.0)

        def longest(code, diagonal, up, left):
            return np.where(code > 0, diagonal + 1, np.where(code == 0, np.maximum(up, left), 0.0))

        return 1.0 - _sweep(pa, pb, match, longest, 0.0, na, nb) / np.minimum(na, nb)
    if metric == "softdtw":
        return _sweep(pa, pb, _square, _soft_min(gamma), np.inf, na, nb)

    return np.sqrt(_squares(pa, pb, na, nb, constraint, radius, slope))


def _band(na: np.ndarray, nb: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest ``i - j`` that a path of each pair may use within the Sakoe-Chiba radius."""
    slack, radius = np.abs(na - nb), int(np.floor(radius))
    return np.where(na > nb, -radius, -slack - radius), np.where(na > nb, slack + radius, radius)


def _squares(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, constraint: str | None, radius: float,
             slope: float, bound: np.ndarray | None = None) -> np.ndarray:
    """Squared DTW of the columns of ``a`` and ``b``, of ``na`` and ``nb`` values; beyond ``bound`` it may be infinite.

    The recurrence of `_sweep` without new arrays. Of each diagonal only the cells inside the widest band of the pairs
    are filled. Every eighth diagonal, pairs that are complete or exceed their bound everywhere leave.
    """
    n, m, size = len(a), len(b), a.shape[1]
    out, alive, last = np.full(size, np.inf), np.arange(size), na + nb - 2
    low, high = _band(na, nb, radius) if constraint == "sakoe_chiba" else (np.array([-m]), np.array([n]))
    widest = int(low.min()), int(high.max())
    each = bool((low > widest[0]).any() or (high < widest[1]).any())  # the bands of the pairs differ
    alike = bool((na == na[0]).all() and (nb == nb[0]).all())
    older, old, new = (np.full((n + 1, size), np.inf) for _ in range(3))
    older[0] = 0.0
    for d in range(n + m - 1):
        lo, hi = max(0, d - m + 1, -((-d - widest[0]) // 2)), min(n - 1, d, (d + widest[1]) // 2)
        if lo > hi:
            new[:] = np.inf
        else:
            cost = a[lo:hi + 1] - b[d - hi:d - lo + 1][::-1]
            cost *= cost
            i = np.arange(lo, hi + 1)
            if each:
                off = (2 * i - d)[:, None]
                cost[(off < low) | (off > high)] = np.inf
            elif constraint not in (None, "sakoe_chiba"):
                some = slice(0, 1) if alike else slice(None)
                ok = _allowed(i, d - i, na[some], nb[some], constraint, radius, slope)
                cost = np.where(ok, cost, np.inf)
            best = new[lo + 1:hi + 2]
            np.minimum(older[lo:hi + 1], old[lo:hi + 1], out=best)
            np.minimum(best, old[lo + 1:hi + 2], out=best)
            best += cost
            new[lo] = np.inf  # cells beside the diagonal hold an earlier one
            if hi + 2 <= n:
                new[hi + 2] = np.inf
        older, old, new = old, new, older
        ends = np.flatnonzero(last == d)
        out[alive[ends]] = old[na[ends], ends]
        if d % 8 == 7 and lo < hi:
            keep = last > d
            if bound is not None:
                keep &= ~(np.minimum(old[lo + 1:hi + 2].min(axis=0), older[lo:hi + 2].min(axis=0)) > bound)
            if np.count_nonzero(keep) < 0.75 * len(keep):
                some = np.flatnonzero(keep)
                if not len(some):
                    break
                a, b, older, old, na, nb = a[:, some], b[:, some], older[:, some], old[:, some], na[some], nb[some]
                new, alive, last = np.full_like(old, np.inf), alive[some], last[some]
                bound = None if bound is None else bound[some]
                low, high = (low[some], high[some]) if constraint == "sakoe_chiba" else (low, high)
    return out


def half_up(v: np.ndarray) -> np.ndarray:
    """Nine decimals, half up, as Spark rounds doubles: what is next to a tie is decided on its decimal digits."""
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(v) * 1e9
        out = np.where(y < 4e15, np.copysign(np.floor(y + 0.5), v) / 1e9 + 0.0, v)
        # beyond nine million, doubles have no more than nine decimals
        tie = np.flatnonzero((np.abs(y - np.floor(y) - 0.5) <= 1e-6 + 2 * np.spacing(y)) & (y < 4e15) | (y >= 4e15) & (y < 9e15))
    if len(tie):
        values, at = np.unique(v[tie], return_inverse=True)
        out[tie] = np.array([float(Decimal(repr(x)).quantize(NINE, ROUND_HALF_UP)) + 0.0 for x in values.tolist()])[at]
    return out


def resampled(x: np.ndarray, size: int) -> np.ndarray:
    """`series.resample_to` of one series: the same positions, products and rounding."""
    steps = max(size - 1, 1)
    num = np.arange(size) * (len(x) - 1)
    lo = num // steps
    frac = (num - lo * steps) / float(steps)
    return half_up(x[lo] * (1 - frac) + x[np.minimum(lo + 1, len(x) - 1)] * frac)


def resampled_rows(flat: np.ndarray, null: np.ndarray, start: np.ndarray, length: np.ndarray,
                   size: int) -> tuple[np.ndarray, np.ndarray]:
    """`resampled` of the series ``flat[start:start + length]``, one row each, and which values are null.

    Null is what lies between a null and something else, and every value of a series without values.
    """
    steps = max(size - 1, 1)
    out, lost = np.zeros((len(start), size)), np.ones((len(start), size), dtype=bool)
    held = np.flatnonzero(length > 0)
    start, last = start[held, None], length[held, None] - 1
    num = np.arange(size) * last
    lo = num // steps
    frac = (num - lo * steps) / float(steps)
    at, after = start + lo, start + np.minimum(lo + 1, last)
    with np.errstate(invalid="ignore", over="ignore"):
        out[held] = half_up((flat[at] * (1 - frac) + flat[after] * frac).ravel()).reshape(-1, size)
    lost[held] = null[at] | null[after]
    return out, lost


def dtw_within(a: list[np.ndarray], b: list[np.ndarray], ia: np.ndarray, ib: np.ndarray, limit: np.ndarray, stretch: bool,
               constraint: str | None = None, radius: float = 5, slope: float = 3.0) -> np.ndarray:
    """DTW of the pairs (a[ia], b[ib]); beyond the ``limit`` of a pair it may be infinite, as without an allowed path.

    With ``stretch``, both series of a pair are resampled to the length of the longer one, once per series and length.
    """
    out = np.full(len(ia), np.inf)
    na, nb = np.array([len(x) for x in a])[ia], np.array([len(x) for x in b])[ib]
    bound = (limit * (1 + 1e-12) + 1e-9) ** 2
    if stretch:
        na = nb = np.maximum(na, nb)
    order = np.lexsort((na, na - nb))
    sizes = na * nb
    # a mask of the slopes is one for all pairs of the same lengths
    apart = np.flatnonzero(np.diff(na[order])) + 1 if constraint == "itakura" and stretch else []
    for group in np.split(order, apart):
        for part in _parts(group, sizes):
            sides = []
            for x, at, n in ((a, ia[part], na[part]), (b, ib[part], nb[part])):
                which, column = np.unique(np.column_stack([at, n]), axis=0, return_inverse=True)
                held = [resampled(x[i], k) if stretch else x[i] for i, k in which.tolist()]
                sides.append(_pad(held, int(n.max()))[:, column.reshape(-1)])
            out[part] = np.sqrt(_squares(*sides, na[part], nb[part], constraint, radius, slope, bound[part]))
    return out


def _path(cost: np.ndarray) -> list[tuple[int, int]]:
    n, m = cost.shape
    acc = np.full((n + 1, m + 1), np.inf)
    acc[0, 0] = 0.0
    for i in range(n):
        for j in range(m):
            acc[i + 1, j + 1] = cost[i, j] + min(acc[i, j], acc[i, j + 1], acc[i + 1, j])
    i, j, out = n - 1, m - 1, [(n - 1, m - 1)]
    while i or j:
        steps = [(acc[i, j], i - 1, j - 1), (acc[i, j + 1], i - 1, j), (acc[i + 1, j], i, j - 1)]
        _, i, j = min(s for s in steps if s[1] >= 0 and s[2] >= 0)
        out.append((i, j))
    return out[::-1]


def ctw(a: np.ndarray, b: np.ndarray, max_iter: int = 100) -> float:
    """Canonical time warping of one-dimensional series (Zhou & de la Torre 2009).

    Alternates an alignment with the canonical projection of the aligned series, which in one
    dimension centres both and scales them to unit norm with the sign of their correlation.
    """
    pa, pb, path = a, b, None
    for _ in range(max_iter):
        new = _path((pa[:, None] - pb[None, :]) ** 2)
        if new == path:
            break
        path = new
        ia, ib = np.array(path).T
        ca, cb = a[ia].mean(), b[ib].mean()
        sa, sb = np.sqrt(((a[ia] - ca) ** 2).sum()), np.sqrt(((b[ib] - cb) ** 2).sum())
        sign = -1.0 if ((a[ia] - ca) * (b[ib] - cb)).sum() < 0 else 1.0
        pa = (a - ca) / (sa or 1.0)
        pb = sign * (b - cb) / (sb or 1.0)
    ia, ib = np.array(path).T
    return float(np.sqrt(((pa[ia] - pb[ib]) ** 2).sum()))


def distances(metric: str, a: list[np.ndarray], b: list[np.ndarray], constraint: str | None = None,
              radius: float = 5, slope: float = 3.0, eps: float = 1.0, gamma: float = 1.0) -> np.ndarray:
    """Distances of the pairs (a[i], b[i]); pairs of similar lengths share a block."""
    out = np.empty(len(a))
    if metric == "ctw":
        if constraint is not None:
            raise ValueError("canonical time warping has no banded form here")
        for i, (x, y) in enumerate(zip(a, b)):
            out[i] = ctw(x, y)
        return out
    sizes = np.array([len(x) * len(y) for x, y in zip(a, b)])
    order = np.lexsort(([len(y) for y in b], [len(x) for x in a]))
    for part in _parts(order, sizes):
        out[part] = _block(metric, [a[i] for i in part], [b[i] for i in part], constraint, radius,
                           slope, eps, gamma)
    return out


def _parts(order: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    start = 0
    for stop in range(1, len(order) + 1):
        if stop == len(order) or (stop - start + 1) * sizes[order[stop]] > CELLS:
            yield order[start:stop]
            start = stop


def equal_length_dtw(a: np.ndarray, b: np.ndarray, ia: np.ndarray, ib: np.ndarray, limit: float) -> np.ndarray:
    """DTW of the rows ``a[ia]`` and ``b[ib]``; pairs beyond ``limit`` may give infinity.

    A lower bound (how far the values of one series lie outside the range of the other) and the
    partial costs of the recurrence drop most of the distant pairs early.
    """
    out = np.full(len(ia), np.inf)
    bound = (limit + 1e-9) ** 2
    n = a.shape[1]
    lo_a, hi_a = a.min(axis=1, keepdims=True), a.max(axis=1, keepdims=True)
    lo_b, hi_b = b.min(axis=1, keepdims=True), b.max(axis=1, keepdims=True)

    def outside(x, low, high):
        excess = x - np.minimum(np.maximum(x, low), high)
        return np.einsum("ij,ij->i", excess, excess)

    for s in range(0, len(ia), PAIRS):
        i, j = ia[s:s + PAIRS], ib[s:s + PAIRS]
        x, y = a[i], b[j]
        near = np.flatnonzero((outside(x, lo_b[j], hi_b[j]) <= bound) & (outside(y, lo_a[i], hi_a[i]) <= bound))
        if len(near):
            ends = np.full(len(near), n)
            out[s + near] = np.sqrt(_sweep(np.ascontiguousarray(x[near].T), np.ascontiguousarray(y[near].T),
                                           _square, _hard_min, np.inf, ends, ends, bound))
    return out


def _pruned_squares(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Squared DTW of the columns of ``a`` and ``b``, all of one length; infinite where it exceeds the bound.

    The recurrence of `_sweep` in the precision of its input and without new arrays. Every fourth diagonal, pairs whose
    two latest diagonals exceed the bound everywhere leave.
    """
    n, size = a.shape
    out, alive = np.full(size, np.inf, a.dtype), np.arange(size)
    older, old, new = (np.full((n + 1, size), np.inf, a.dtype) for _ in range(3))
    older[0] = 0.0
    for d in range(2 * n - 1):
        lo, hi = max(0, d - n + 1), min(n - 1, d)
        cost = a[lo:hi + 1] - b[d - hi:d - lo + 1][::-1]
        cost *= cost
        best = new[lo + 1:hi + 2]
        np.minimum(older[lo:hi + 1], old[lo:hi + 1], out=best)
        np.minimum(best, old[lo + 1:hi + 2], out=best)
        best += cost
        new[lo] = np.inf  # cells beside the diagonal hold an earlier one
        if hi + 2 <= n:
            new[hi + 2] = np.inf
        older, old, new = old, new, older
        if d % 4 == 3 and d >= 7:
            keep = np.minimum(old[lo + 1:hi + 2].min(axis=0), older[max(0, lo):hi + 2].min(axis=0)) <= bound
            if np.count_nonzero(keep) < 0.75 * len(keep):
                some = np.flatnonzero(keep)
                if not len(some):
                    return out
                a, b, older, old = a[:, some], b[:, some], older[:, some], old[:, some]
                new, alive = np.full_like(old, np.inf), alive[some]
    out[alive] = np.where(old[n] <= bound, old[n], np.inf)
    return out


class _Sets:
    """Values of series as sets: which of them are how far from all values of another series.

    Every point of a series is matched with some point of the other, so the squares of its distances to the nearest
    values of the other bound their squared DTW from below. Values are counted in bins, from whose nearest edge distances
    are taken: the bound of all pairs is one matrix product.
    """

    def __init__(self, low: float, high: float, limit: float):
        self.low = low
        self.width = max(limit / 8, (high - low) / 96, 1e-12)
        self.bins = int((high - low) / self.width) + 1
        self.edges = (low + self.width * np.arange(self.bins)).astype(np.float32)

    def counts(self, x: np.ndarray) -> np.ndarray:
        at = np.clip(((x - self.low) / self.width).astype(np.int64), 0, self.bins - 1)
        flat = (at + np.arange(len(x))[:, None] * self.bins).ravel()
        return np.bincount(flat, minlength=len(x) * self.bins).reshape(len(x), self.bins).astype(np.float32)

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each bin to the nearest value of each series, a little less than exact."""
        near = np.full((len(x), self.bins), np.inf, np.float32)
        middle, half = self.edges + np.float32(self.width / 2), np.float32(self.width * 0.501)
        for column in x.astype(np.float32).T:
            np.minimum(near, np.abs(middle[None, :] - column[:, None]), out=near)
        near = np.maximum(near - half, 0.0) * np.float32(0.999)
        return near * near


def near_pairs(a: np.ndarray, b: np.ndarray, limit: float, k: int | None = None, cell_a: np.ndarray | None = None,
               cell_b: np.ndarray | None = None, rows_at_once: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of ``a``, row of ``b``) within the limit and their DTW; with ``k`` all that may be among the k of ``a``.

    Only rows of equal ``cell_a`` and ``cell_b`` are compared, all rows without them.
    Three bounds come before the recurrence: the ends, the largest and the smallest value, and the sets of values. The
    recurrence runs in single precision with a limit wide enough for its errors; what is left of it is found again in
    double precision.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(a) or not len(b):
        return none, none, np.zeros(0)
    n = a.shape[1]
    fa = np.column_stack([a[:, 0], a[:, -1], a.max(axis=1), a.min(axis=1)])
    fb = np.column_stack([b[:, 0], b[:, -1], b.max(axis=1), b.min(axis=1)])
    slack, bound = limit + 1e-9, (limit + 1e-9) ** 2
    fit_a, fit_b = np.isfinite(fa).all(axis=1), np.isfinite(fb).all(axis=1)
    most = max(np.abs(fa[fit_a]).max(initial=0.0), np.abs(fb[fit_b]).max(initial=0.0))
    single = max(most, limit) < 1e12
    # rounding of the values, of their differences and of the sums along a path of at most 2 n - 1 cells
    error = most * 2.0 ** -22
    loose = bound + 2 * limit * np.sqrt(2 * n) * error + 2 * n * error ** 2 + n * bound * 2.0 ** -21 if single else bound
    if single and fit_a.any() and fit_b.any():
        sets = _Sets(min(fa[fit_a, 3].min(), fb[fit_b, 3].min()), max(fa[fit_a, 2].max(), fb[fit_b, 2].max()), limit)
        clean_a, clean_b = np.where(fit_a[:, None], a, sets.low), np.where(fit_b[:, None], b, sets.low)
        count_a, square_a, count_b, square_b = (f(x) for x in (clean_a, clean_b) for f in (sets.counts, sets.squares))
    cell_a = np.zeros(len(a), np.int64) if cell_a is None else cell_a
    cell_b = np.zeros(len(b), np.int64) if cell_b is None else cell_b
    order = np.lexsort((fa[:, 3], fa[:, 2], fa[:, 1], fa[:, 0], cell_a))
    order = order[fit_a[order]]
    order_b = np.argsort(cell_b, kind="stable")
    order_b = order_b[fit_b[order_b]]
    # where the rows of a cell begin and end on both sides
    cells, begin = np.unique(cell_a[order], return_index=True)
    spans = zip(begin, [*begin[1:], len(order)], np.searchsorted(cell_b[order_b], cells, "left"),
                np.searchsorted(cell_b[order_b], cells, "right"))
    kind = np.float32 if single else np.float64
    ta, tb = np.ascontiguousarray(a.T.astype(kind)), np.ascontiguousarray(b.T.astype(kind))
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[np.ndarray, np.ndarray]] = []

    waiting = 0

    def measure() -> None:
        """Run the recurrence on the pairs that wait for it."""
        nonlocal waiting
        if not held:
            return
        ia, ib = (np.concatenate(x) for x in zip(*held))
        held.clear()
        waiting = 0
        for s in range(0, len(ia), PAIRS):
            i, j = ia[s:s + PAIRS], ib[s:s + PAIRS]
            d = _pruned_squares(np.take(ta, i, axis=1), np.take(tb, j, axis=1), loose)
            hit = np.flatnonzero(np.isfinite(d))
            found.append((i[hit], j[hit], d[hit].astype(np.float64)))

    for lo_a, hi_a, lo_b, hi_b in spans:
        others = order_b[lo_b:hi_b]
        for s in range(lo_a, hi_a if len(others) else lo_a, rows_at_once):
            rows, cols = order[s:min(s + rows_at_once, hi_a)], others
            if len(cols) > rows_at_once:
                low, high = fa[rows].min(axis=0) - slack, fa[rows].max(axis=0) + slack
                cols = cols[((fb[cols] >= low) & (fb[cols] <= high)).all(axis=1)]
            x, y = fa[rows], fb[cols]
            gap = [x[:, f, None] - y[None, :, f] for f in range(4)]
            ok = gap[0] * gap[0] + gap[1] * gap[1] <= bound
            ok &= np.abs(gap[2]) <= slack
            ok &= np.abs(gap[3]) <= slack
            if single and ok.any():
                ok &= square_a[rows] @ count_b[cols].T <= loose
                ok &= count_a[rows] @ square_b[cols].T <= loose
            i, j = np.nonzero(ok)
            if len(i):
                held.append((rows[i], cols[j]))
                waiting += len(i)
                if waiting >= 4 * PAIRS:
                    measure()
    measure()
    if not found:
        return none, none, np.zeros(0)
    ia, ib, d = (np.concatenate(x) for x in zip(*found))
    if k is not None and len(ia):
        # whoever is farther than the k-th by more than the error is not among the k
        order = np.lexsort((d, ia))
        ia, ib, d = ia[order], ib[order], d[order]
        first = np.maximum.accumulate(np.where(np.diff(ia, prepend=-1) != 0, np.arange(len(ia)), 0))
        kth = np.minimum(first + k - 1, len(ia) - 1)
        keep = (ia[kth] != ia) | (d <= d[kth] + 2 * (loose - bound) + 1e-8 * (1 + limit))
        ia, ib = ia[keep], ib[keep]
    d = np.round(equal_length_dtw(a, b, ia, ib, limit), 9)
    hit = d <= limit
    return ia[hit], ib[hit], d[hit]


def fluss_boundaries(ts: np.ndarray, m: int, n_regions: int) -> list[int]:
    """Region boundaries from the corrected arc curve (Gharghabi et al. 2017).

    Every subsequence of length ``m`` points to its z-normalised nearest neighbour; few arcs
    cross a change of regime. The ``n_regions - 1`` deepest minima are taken greedily, each
    blocking its surroundings of ``5 m`` samples.
    """
    count = len(ts) - m + 1
    if count < 2:
        return []
    sub = np.lib.stride_tricks.sliding_window_view(ts.astype(float), m)
    sd = sub.std(axis=1, keepdims=True)
    z = np.where(sd > 1e-9, (sub - sub.mean(axis=1, keepdims=True)) / np.where(sd > 1e-9, sd, 1.0), 0.0)
    arcs = np.zeros(count + 1)
    positions = np.arange(count)
    rows = max(1, CELLS // count)
    for s in range(0, count, rows):
        block = ((z[s:s + rows, None, :] - z[None, :, :]) ** 2).sum(axis=2)
        near = np.abs(positions[s:s + rows, None] - positions[None, :]) <= max(1, m // 2)
        nearest = np.where(near, np.inf, np.round(block, 9)).argmin(axis=1)
        own = positions[s:s + rows]
        np.add.at(arcs, np.minimum(own, nearest), 1)
        np.add.at(arcs, np.maximum(own, nearest), -1)
    crossing = np.cumsum(arcs)[:count]
    ideal = 2.0 * positions * (count - positions) / count
    cac = np.minimum(np.where(ideal > 0, crossing / np.where(ideal > 0, ideal, 1.0), 1.0), 1.0)
    guard = 5 * m
    cac[:guard] = 1.0
    cac[max(0, count - guard):] = 1.0
    found = []
    for _ in range(n_regions - 1):
        best = int(cac.argmin())
        if cac[best] >= 1.0:
            break
        found.append(best)
        cac[max(0, best - guard):best + guard + 1] = 1.0
    return sorted(found)
