"""WGS84 geodesics as vectorised pandas UDFs (iterative, so not a closed-form column)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the WGS84 ellipsoid.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
WGS84_B = WGS84_A * (1 - WGS84_F)
MAX_ITERATIONS = 200
TOLERANCE = 1e-12


def _series_coefficients(cos2_alpha):
    u2 = cos2_alpha * (WGS84_A ** 2 - WGS84_B ** 2) / WGS84_B ** 2
    big_a = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    big_b = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big_a, big_b


def _delta_sigma(big_b, sin_s, cos_s, cos_2m):
    return big_b * sin_s * (cos_2m + big_b / 4 * (
        cos_s * (2 * cos_2m ** 2 - 1)
        - big_b / 6 * cos_2m * (4 * sin_s ** 2 - 3) * (4 * cos_2m ** 2 - 3)))


def inverse_arrays(lat1, lon1, lat2, lon2):
    """Distance (m), initial and final bearing (deg) for arrays of point pairs."""
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2)))
    big_l = np.radians(lon2 - lon1)
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = big_l.copy()
    live = np.ones(len(lam), dtype=bool)
    with np.errstate(all="ignore"):
        for _ in range(MAX_ITERATIONS):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s > 0, c1 * c2 * sl / np.where(sin_s > 0, sin_s, 1), 0.0)
            cos2_a = 1 - sin_a ** 2
            cos_2m = np.where(cos2_a > 1e-15, cos_s - 2 * s1 * s2 / np.where(cos2_a > 1e-15, cos2_a, 1), 0.0)
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            nxt = big_l + (1 - c) * WGS84_F * sin_a * (
                sigma + c * sin_s * (cos_2m + c * cos_s * (2 * cos_2m ** 2 - 1)))
            moved = np.abs(nxt - lam) >= TOLERANCE
            lam = np.where(live, nxt, lam)
            live &= moved
            if not live.any():
                break
        sl, cl = np.sin(lam), np.cos(lam)
        big_a, big_b = _series_coefficients(cos2_a)
        dist = WGS84_B * big_a * (sigma - _delta_sigma(big_b, sin_s, cos_s, cos_2m))
        first = np.degrees(np.arctan2(c2 * sl, c1 * s2 - s1 * c2 * cl)) % 360
        last = np.degrees(np.arctan2(c1 * sl, c1 * s2 * cl - s1 * c2)) % 360
    same = sin_s < 1e-15
    return np.where(same, 0.0, dist), np.where(same, 0.0, first), np.where(same, 0.0, last)


def direct_arrays(lat1, lon1, bearing, dist):
    """Point reached from (lat1, lon1) at a bearing (deg) and distance (m)."""
    a1 = np.radians(bearing)
    tan_u1 = (1 - WGS84_F) * np.tan(np.radians(lat1))
    c1 = 1 / np.sqrt(1 + tan_u1 ** 2)
    s1 = tan_u1 * c1
    sigma1 = np.arctan2(tan_u1, np.cos(a1))
    sin_a = c1 * np.sin(a1)
    cos2_a = 1 - sin_a ** 2
    big_a, big_b = _series_coefficients(cos2_a)
    base = dist / (WGS84_B * big_a)
    sigma = base.copy()
    for _ in range(MAX_ITERATIONS):
        cos_2m = np.cos(2 * sigma1 + sigma)
        nxt = base + _delta_sigma(big_b, np.sin(sigma), np.cos(sigma), cos_2m)
        done = np.abs(nxt - sigma) < TOLERANCE
        sigma = nxt
        if done.all():
            break
    ss, cs = np.sin(sigma), np.cos(sigma)
    cos_2m = np.cos(2 * sigma1 + sigma)
    x = s1 * ss - c1 * cs * np.cos(a1)
    lat2 = np.arctan2(s1 * cs + c1 * ss * np.cos(a1), (1 - WGS84_F) * np.hypot(sin_a, x))
    lam = np.arctan2(ss * np.sin(a1), c1 * cs - s1 * ss * np.cos(a1))
    c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
    big_l = lam - (1 - c) * WGS84_F * sin_a * (
        sigma + c * ss * (cos_2m + c * cs * (2 * cos_2m ** 2 - 1)))
    return np.degrees(lat2), lon1 + np.degrees(big_l)


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


@F.pandas_udf(_doubles("distance_m", "bearing", "final_bearing"))
def geodesic_inverse(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series,
                     lon2: pd.Series) -> pd.DataFrame:
    d, first, last = inverse_arrays(*(s.to_numpy(float) for s in (lat1, lon1, lat2, lon2)))
    return pd.DataFrame({"distance_m": d, "bearing": first, "final_bearing": last})


@F.pandas_udf(_doubles("lat", "lon"))
def geodesic_direct(lat1: pd.Series, lon1: pd.Series, bearing: pd.Series,
                    dist: pd.Series) -> pd.DataFrame:
    lat, lon = direct_arrays(*(s.to_numpy(float) for s in (lat1, lon1, bearing, dist)))
    return pd.DataFrame({"lat": lat, "lon": lon})


def ellipsoid_xy(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """Local Cartesian of a point: geodesic distance and bearing from the centre."""
    leg = geodesic_inverse(lat0, lon0, lat, lon)
    theta = F.radians(leg["bearing"])
    return leg["distance_m"] * F.sin(theta), leg["distance_m"] * F.cos(theta)


def ellipsoid_latlon(x: Column, y: Column, lat0: Column, lon0: Column) -> Column:
    """Inverse of :func:`ellipsoid_xy`; a struct of lat and lon."""
    return geodesic_direct(lat0, lon0, F.degrees(F.atan2(x, y)), F.sqrt(x * x + y * y))
