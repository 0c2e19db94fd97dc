"""Convex spherical polygons as numpy arrays, many at a time: one polygon a column, so every step is over whole rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A point this near to an edge's plane counts as inside.
EDGE = 1e-12
#: Pairs whose separation is nearer to 0 than this are decided by corners and crossings.
NEAR = 1e-10
#: Slack of bounds on angles, in radians; far above what acos loses near 0.
SLACK = 1e-7


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def crosses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])


class Polygons:
    """``a``: corners, ``b``: the next ones, ``n``: unit normals of the edges, on whose lower side the inside
    lies (each corners x 3 x polygons); ``total``: the sum of the corners. Short polygons repeat
    their first corner and edge; an edge without a length stands for the longest one."""

    def __init__(self, a, b, n, total):
        self.a, self.b, self.n, self.total = a, b, n, total

    @classmethod
    def of(cls, packed: pa.Array) -> Polygons:
        """From lists of x, y, z, x, y, z..."""
        sizes = packed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) // 3
        flat = packed.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 3)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        flat = np.concatenate([flat, np.zeros((1, 3))])
        k = np.arange(max(1, sizes.max(initial=1)))[:, None]
        own, real = np.maximum(sizes, 1), k < sizes
        at = np.where(real, k, 0)
        none = np.where(sizes > 0, 0, len(flat) - 1)
        a = flat[np.where(sizes > 0, starts + at, none)].transpose(0, 2, 1)
        b = flat[np.where(sizes > 0, starts + (at + 1) % own, none)].transpose(0, 2, 1)
        n = crosses(a.transpose(1, 0, 2), b.transpose(1, 0, 2)).transpose(1, 0, 2)
        long = np.sqrt((n * n).sum(axis=1))
        most = long.argmax(axis=0)
        for e in range(len(n)):
            if (short := np.flatnonzero(long[e] == 0)).size:
                n[e][:, short] = n[most[short], :, short].T
                long[e, short] = long[most[short], short]
        n = n / np.where(long == 0, 1.0, long)[:, None, :]
        total = np.where(real[:, None, :], a, 0.0).sum(axis=0)
        sign = np.where((n * total).sum(axis=(0, 1)) > 0, -1.0, 1.0)
        return cls(np.ascontiguousarray(a), np.ascontiguousarray(b), np.ascontiguousarray(n * sign), total)

    def __getitem__(self, k) -> Polygons:
        return Polygons(self.a[:, :, k], self.b[:, :, k], self.n[:, :, k], self.total[:, k])

    def __len__(self) -> int:
        return self.total.shape[1]

    def height(self, p: np.ndarray) -> np.ndarray:
        """The greatest signed sine of a point's distance from an edge: below 0 inside."""
        top = dots(self.n[0], p)
        for e in self.n[1:]:
            top = np.maximum(top, dots(e, p))
        return top

    def holds(self, p: np.ndarray) -> np.ndarray:
        return (dots(self.total, p) > 0) & (self.height(p) <= EDGE)

    def circles(self, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Radii of the circles about a centre inside and around; below 0 inside for a centre out of the polygon."""
        far = np.arccos(np.clip(np.min([dots(c, centre) for c in self.a], axis=0), -1, 1)) + SLACK
        return -np.arcsin(np.clip(self.height(centre), -1, 1)) - SLACK, far

    def boundary(self, steps: int):
        """``steps`` points of each side, its first corner included."""
        for a, b in zip(self.a, self.b, strict=True):
            for k in range(steps):
                p = a + (b - a) * (k / steps)
                yield p / np.sqrt(dots(p, p)) if k else p


def crossing(p: Polygons, q: Polygons) -> np.ndarray:
    """Whether a side of one crosses a side of the other at an inner point of both."""
    found = np.zeros(len(p), bool)
    for a, b in zip(p.a, p.b, strict=True):
        n = crosses(a, b)
        for c, d in zip(q.a, q.b, strict=True):
            m = crosses(c, d)
            line = crosses(n, m)
            found |= (dots(n, c) * dots(n, d) < 0) & (dots(m, a) * dots(m, b) < 0) & (dots(line, a + b) * dots(line, c + d) > 0)
    return found


def share_a_point(p: Polygons, q: Polygons) -> np.ndarray:
    """Whether a corner of one lies in the other, or sides cross."""
    return inside_each_other(p, q, 1, 1) | crossing(p, q)


def inside_each_other(p: Polygons, q: Polygons, steps: int, other_steps: int) -> np.ndarray:
    """Whether one of the boundary points of ``p`` lies in ``q``, or the other way round."""
    found = np.zeros(len(p), bool)
    for a, b, n in ((p, q, steps), (q, p, other_steps)):
        for point in a.boundary(n):
            found |= b.holds(point)
    return found


def gap(p: Polygons, q: Polygons) -> np.ndarray:
    """Above 0 where an edge's plane parts the two; below 0 where no edge's does. Convex polygons in one
    half sphere meet exactly where no edge of either parts them."""
    most = np.full(len(p), -np.inf)
    for one, other in ((p, q), (q, p)):
        for e in one.n:
            low = dots(e, other.a[0])
            for c in other.a[1:]:
                low = np.minimum(low, dots(e, c))
            most = np.maximum(most, low)
    return most


def overlapping(p: Polygons, q: Polygons, one_half: np.ndarray) -> np.ndarray:
    """As :func:`share_a_point`, by the parting edge where that decides. ``one_half``: pairs known to lie in one half sphere."""
    s = gap(p, q)
    met = s < -NEAR
    unsure = np.flatnonzero(~(s > NEAR) & ~(met & one_half))
    if len(unsure):
        met[unsure] = share_a_point(p[unsure], q[unsure])
    return met


def boundaries_meet(p: Polygons, a: np.ndarray, q: Polygons, b: np.ndarray, steps: int) -> np.ndarray:
    """As :func:`inside_each_other` of ``p[a]`` and ``q[b]`` with ``steps`` on either side. Corners first, one at a time, as most
    pairs are decided by one of them."""
    met, left = np.zeros(len(a), bool), np.arange(len(a))
    for one, i, other, j in ((p, a, q, b), (q, b, p, a)):
        for corner in one.a:
            point, k = corner[:, i[left]], j[left]
            held = dots(other.total[:, k], point) > 0
            for e in other.n:
                held &= dots(e[:, k], point) <= EDGE
            met[left[held]] = True
            left = left[~held]
    left = left[~(gap(p[a[left]], q[b[left]]) > NEAR)]
    if len(left) and steps > 1:
        met[left] = inside_each_other(p[a[left]], q[b[left]], steps, steps)
    return met


def arc_distance(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance in degrees of a point from an arc (a, b)."""
    n = crosses(a, b)
    n = n / np.sqrt(dots(n, n))
    angle = lambda u, v: np.degrees(np.arccos(np.clip(dots(u, v), -1, 1)))
    beside = (dots(crosses(n, a), p) >= 0) & (dots(crosses(b, n), p) >= 0)
    return np.where(beside, np.degrees(np.arcsin(np.minimum(1.0, np.abs(dots(n, p))))), np.minimum(angle(a, p), angle(b, p)))
