"""Shortest-route helper: one task row in, its touching points or value table out.

A route is a path through layers of rim points, solved from the goal backwards
with NumPy for the few waypoints of one task.  The rows of many tasks are spread
by Spark; nothing here knows about more than one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

RIM_SPACING_M = 100.0     # a rim point at least every 100 m ...
RIM_MIN_POINTS = 144      # ... and never fewer than this many
ZOOM_LEVELS = 2           # re-sample around the chosen points
ZOOM_STEPS = 20           # candidates on each side
#: Between neighbouring rim points onward distances bend by at most this share of the spacing, or are not refined.
MAX_BEND = 0.1
ARC_STEPS = 40


def rim_size(radius: float) -> int:
    return 1 if radius <= 0 else max(RIM_MIN_POINTS, int(np.ceil(2 * np.pi * radius / RIM_SPACING_M)))


def _rim(x, y, r, angles):
    return np.column_stack([x + np.cos(angles) * r, y + np.sin(angles) * r])


def _layers(xs, ys, rs):
    angles = [2 * np.pi * np.arange(rim_size(r)) / rim_size(r) for r in rs]
    return angles, [_rim(x, y, max(r, 0.0), a) for x, y, r, a in zip(xs, ys, rs, angles)]


def _values(points, xs, ys, rs):
    """Distance still to fly from every point of every layer, with back-pointers.

    A point that already lies in the following zones has visited them, so its
    next layer is the first zone that does not contain it.
    """
    n = len(points)
    value = [np.zeros(len(p)) for p in points]
    nxt = [np.full(len(p), n) for p in points]
    pick = [np.zeros(len(p), dtype=int) for p in points]
    for i in range(n - 2, -1, -1):
        p = points[i]
        for j in range(n - 1, i, -1):
            outside = np.hypot(p[:, 0] - xs[j], p[:, 1] - ys[j]) > rs[j]
            nxt[i][outside] = j
        for j in np.unique(nxt[i]):
            if j == n:
                continue
            rows = np.nonzero(nxt[i] == j)[0]
            cost = np.hypot(p[rows, None, 0] - points[j][None, :, 0],
                            p[rows, None, 1] - points[j][None, :, 1]) + value[j][None, :]
            best = cost.argmin(axis=1)
            pick[i][rows] = best
            value[i][rows] = cost[np.arange(len(rows)), best]
    return value, nxt, pick


def _chosen(value, nxt, pick):
    """Layer -> index of the point the best route uses; visited-in-passing layers are absent."""
    n = len(value)
    i, q = 0, int(value[0].argmin())
    path = {}
    while i < n:
        path[i] = q
        i, q = int(nxt[i][q]), int(pick[i][q])
    return path


def touching_points(xs, ys, rs):
    """One route point per waypoint: where the shortest route first touches each zone."""
    xs, ys, rs = (np.asarray(v, dtype=float) for v in (xs, ys, rs))
    n = len(xs)
    angles, points = _layers(xs, ys, rs)
    step = [2 * np.pi / len(a) for a in angles]
    path = _chosen(*_values(points, xs, ys, rs))
    for _ in range(ZOOM_LEVELS):
        for i, q in path.items():
            if rs[i] <= 0:
                continue
            angles[i] = angles[i][q] + step[i] * np.arange(-ZOOM_STEPS, ZOOM_STEPS + 1) / ZOOM_STEPS
            step[i] /= ZOOM_STEPS
            points[i] = _rim(xs[i], ys[i], rs[i], angles[i])
        path = _chosen(*_values(points, xs, ys, rs))
    opt = np.zeros((n, 2))
    order = sorted(path)
    for i in range(n):
        if i in path:
            opt[i] = points[i][path[i]]
            continue
        before = max(k for k in order if k < i)
        after = min((k for k in order if k > i), default=before)
        a, b = points[before][path[before]], points[after][path[after]]
        leg = b - a
        length2 = float(leg @ leg)
        u = 0.0 if length2 <= 1e-18 else min(1.0, max(0.0, float((np.array([xs[i], ys[i]]) - a) @ leg) / length2))
        opt[i] = a + u * leg
    return _first_touch(opt, xs, ys, rs, path)


def _first_touch(opt, xs, ys, rs, path):
    """Move a point that is the far side of a straight pass to where the leg enters the zone."""
    moved = opt.copy()
    for i in sorted(path):
        if i == 0 or rs[i] <= 0:
            continue
        a, leg = opt[i - 1], opt[i] - opt[i - 1]
        rel = a - np.array([xs[i], ys[i]])
        if np.hypot(*rel) <= rs[i]:
            continue
        qa, qb, qc = float(leg @ leg), 2 * float(rel @ leg), float(rel @ rel) - rs[i] ** 2
        disc = qb * qb - 4 * qa * qc
        if qa < 1e-18 or disc < 0:
            continue
        u = (-qb - np.sqrt(disc)) / (2 * qa)
        if 0 <= u <= 1:
            moved[i] = a + u * leg
    return moved


_POINTS = T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("ox", "oy")])
VALUE_COLUMNS = "wp_ix int, q int, k int, qx double, qy double, v double, v_left double, v_right double, zx double, zy double, zr double"


@F.pandas_udf(_POINTS)
def route_points(xs: pd.Series, ys: pd.Series, rs: pd.Series) -> pd.DataFrame:
    solved = [touching_points(x, y, r) for x, y, r in zip(xs, ys, rs)]
    return pd.DataFrame({"ox": [s[:, 0].tolist() for s in solved],
                         "oy": [s[:, 1].tolist() for s in solved]})


def value_rows(batches):
    """Every rim point of every zone up to the stop with its shortest distance onward, that of its
    neighbours, the size of the rim, and the circle it lies on.

    For ``mapInArrow`` over (task_id, xs, ys, rs, stop).  The rows of one task leave at a time, so a
    worker never holds the rims of a whole batch of tasks.
    """
    for batch in batches:
        for task, x, y, r, last in zip(*(column.to_pylist() for column in batch.columns)):
            x, y, r = (np.asarray(v, dtype=float)[:last + 1] for v in (x, y, r))
            _, points = _layers(x, y, r)
            value, _, _ = _values(points, x, y, r)
            size = [len(v) for v in value]
            zone = lambda v: np.repeat(v, size)
            columns = [zone(np.arange(len(size), dtype=np.int32)), np.concatenate([np.arange(n, dtype=np.int32) for n in size]),
                       zone(np.asarray(size, dtype=np.int32)), *np.concatenate(points).T, np.concatenate(value),
                       np.concatenate([np.roll(v, 1) for v in value]), np.concatenate([np.roll(v, -1) for v in value]),
                       zone(x), zone(y), zone(np.maximum(r, 0.0))]
            yield pa.RecordBatch.from_arrays([pa.array([task] * sum(size), batch.schema.field(0).type), *map(pa.array, columns)],
                                             ["task_id", *[c.split()[0] for c in VALUE_COLUMNS.split(", ")]])


@F.pandas_udf(T.DoubleType())
def arc_minimum(x: pd.Series, y: pd.Series, q: pd.Series, k: pd.Series, zx: pd.Series, zy: pd.Series, zr: pd.Series,
                v: pd.Series, v_left: pd.Series, v_right: pd.Series) -> pd.Series:
    """Distance to fly by the best point of the arc around rim point ``q`` of ``k``, or null where it is not smooth.

    Onward distance is the parabola through the point and its neighbours.  The sum with the way there has one
    minimum on the arc, which shrinking thirds find, for all rows of a batch at once.
    """
    x, y, q, k, zx, zy, zr, v, v_left, v_right = (s.to_numpy(float) for s in (x, y, q, k, zx, zy, zr, v, v_left, v_right))
    step, turn, bend = 2 * np.pi / k, (v_right - v_left) / 2, (v_right + v_left) / 2 - v

    def total(s):
        angle = step * (q + s)
        return np.hypot(x - zx - np.cos(angle) * zr, y - zy - np.sin(angle) * zr) + v + turn * s + bend * s * s

    with np.errstate(all="ignore"):
        low, high = np.full(len(x), -1.0), np.full(len(x), 1.0)
        for _ in range(ARC_STEPS):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            left = total(a) <= total(b)
            low, high = np.where(left, low, a), np.where(left, b, high)
        best = total((low + high) / 2)
        smooth = (zr > 0) & (np.abs(bend) * 2 <= MAX_BEND * step * zr)
    return pd.Series(np.where(smooth, best, np.nan)).astype("Float64").where(smooth, None)
