"""Single formulas against published values and numeric integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyrank.functions import gap, geo, leading
from skyrank.functions.geodesic import direct_arrays, inverse_arrays
from skyrank.functions.route import touching_points


def values(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row.asDict()


@pytest.mark.parametrize("best,rows", [
    (3600, [(4122, 0.8), (5167, 0.5), (7200, 0.0)]),
    (7200, [(7938, 0.8), (9416, 0.5), (12291, 0.0)]),
    (10800, [(11704, 0.8), (13514, 0.5), (17035, 0.0)])])
def test_speed_fraction_table(spark, best, rows):
    got = values(spark, **{f"t{t}": gap.speed_fraction(F.lit(float(t)), F.lit(float(best))) for t, _ in rows})
    for t, want in rows:
        assert got[f"t{t}"] == pytest.approx(want, abs=5e-4)


def test_goal_altitude_factor(spark):
    alts = {150: 0.9968750, 18: 0.8492858, 6: 0.8174654, -13: 0.8}
    got = values(spark, **{f"a{i}": gap.goal_altitude_factor(F.lit(1000.0 + a), F.lit(1000.0), F.lit(200.0))
                           for i, a in enumerate(alts)})
    assert list(got.values()) == pytest.approx(list(alts.values()), abs=1e-6)


def test_weights_and_validity(spark):
    got = values(spark, none=gap.distance_weight(F.lit(0.0)), all=gap.distance_weight(F.lit(1.0)),
                 lead=gap.leading_weight(F.lit(0.9), F.lit(0.26), F.lit(0.0)),
                 lv=gap.launch_validity(F.lit(48), F.lit(50), F.lit(0.96)),
                 tv0=gap.time_validity(F.lit(None).cast("double"), F.lit(0.0), F.lit(5400.0), F.lit(60000.0)),
                 tv=gap.time_validity(F.lit(2700.0), F.lit(0.0), F.lit(5400.0), F.lit(60000.0)))
    assert got["none"] == pytest.approx(0.9)
    assert got["all"] == pytest.approx(0.361)
    assert got["lead"] == pytest.approx(0.1)
    assert got["lv"] == 1.0
    assert got["tv0"] == 0.0
    assert got["tv"] == pytest.approx(0.718, abs=1e-3)


def test_progress_weight_and_integral(spark):
    def w(x):
        u = 1 - x
        return (1 - 10 ** (9 * u - 9)) ** 5 * (1 - 10 ** (-3 * u)) ** 2

    got = values(spark, **{f"w{p}": leading.weight(F.lit(p / 100)) for p in (0, 10, 30, 100)},
                 part=leading.weight_integral(F.lit(0.13), F.lit(0.71)), whole=leading.weight_integral(F.lit(-1.0), F.lit(2.0)),
                 back=leading.weight_integral(F.lit(0.5), F.lit(0.4)))
    assert [got[f"w{p}"] for p in (0, 10, 30, 100)] == pytest.approx([0, 0.508, 0.974, 0], abs=1e-3)
    xs = np.linspace(0.13, 0.71, 20001)
    assert got["part"] == pytest.approx(np.trapezoid([w(x) for x in xs], xs), abs=1e-8)
    xs = np.linspace(0, 1, 20001)
    assert got["whole"] == pytest.approx(np.trapezoid([w(x) for x in xs], xs), abs=1e-7)
    assert got["back"] == 0.0


def test_zone_contact_cases(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    got = values(spark,
                 through=geo.chord_hits(*lit(-100, 10, 100, 10, 0, 0, 20)),
                 beside=geo.chord_hits(*lit(-100, 30, 100, 30, 0, 0, 20)),
                 short=geo.chord_hits(*lit(-100, 0, -50, 0, 0, 0, 20)),
                 frac=geo.first_contact_fraction(*lit(-100, 0, 100, 0, 0, 0, 50)),
                 miss=geo.first_contact_fraction(*lit(-100, 90, 100, 90, 0, 0, 50)))
    assert got == {"through": True, "beside": False, "short": False, "frac": 0.25, "miss": None}


def test_geodesic_inverse_and_direct():
    # Flinders Peak to Buninyong on the WGS84 ellipsoid
    lat1, lon1 = -(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600
    lat2, lon2 = -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600
    a = [np.array([v]) for v in (lat1, lon1, lat2, lon2)]
    d, first, _ = inverse_arrays(*a)
    assert d[0] == pytest.approx(54972.271, abs=0.01)
    assert first[0] == pytest.approx(306.86816, abs=1e-4)
    lat, lon = direct_arrays(a[0], a[1], first, d)
    assert (lat[0], lon[0]) == (pytest.approx(lat2, abs=1e-9), pytest.approx(lon2, abs=1e-9))


def test_route_is_shortest_by_random_search():
    rng = np.random.default_rng(7)
    for _ in range(5):
        xs, ys = rng.uniform(-20000, 20000, 5), np.arange(5) * 9000.0
        rs = np.array([0.0, 400, 3000, 1000, 400])
        p = touching_points(xs, ys, rs)
        length = lambda q: np.hypot(*np.diff(q, axis=0).T).sum()
        assert all(math.hypot(*(p[i] - (xs[i], ys[i]))) <= rs[i] + 1e-6 for i in range(5))
        best = length(p)
        for _ in range(4000):
            ang, rad = rng.uniform(0, 2 * np.pi, 5), rs * np.sqrt(rng.uniform(0, 1, 5))
            near = p + rng.normal(0, 200, (5, 2))
            off = near - np.column_stack([xs, ys])
            scale = np.minimum(1, rs / np.maximum(1e-9, np.hypot(*off.T)))
            q = np.column_stack([xs, ys]) + off * scale[:, None]
            assert length(q) >= best - 0.01
            q = np.column_stack([xs + np.cos(ang) * rad, ys + np.sin(ang) * rad])
            assert length(q) >= best - 0.01
