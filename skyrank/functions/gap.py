"""Scoring formulas as Column expressions, one definition for batch, stream and audit.

Coefficients and thresholds are fixed values of the published scoring rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEADING_TIME_RATIO_MAX = 0.26
GOAL_ALTITUDE_BAND_M = 300.0


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _cubic(x: Column, k0: float, k1: float, k2: float, k3: float) -> Column:
    return k0 + k1 * x + k2 * x * x + k3 * x * x * x


def round1(c: Column) -> Column:
    return F.round(c, 1)


# --- validity -----------------------------------------------------------------

def launch_validity(flying: Column, present: Column, nominal_launch: Column) -> Column:
    ratio = F.least(F.lit(1.0), flying / (present * nominal_launch))
    return F.when(present <= 0, F.lit(0.0)).otherwise(
        _clamp01(_cubic(ratio, 0.0, 0.028, 2.917, -1.944)))


def distance_validity(over_minimum: Column, flying: Column, best: Column, nominal_goal: Column,
                      nominal_distance: Column, minimum_distance: Column) -> Column:
    area = ((nominal_goal + 1) * (nominal_distance - minimum_distance)
            + F.greatest(F.lit(0.0), nominal_goal * (best - nominal_distance))) / 2
    return F.when((flying == 0) | (area <= 0), F.lit(0.0)).otherwise(
        F.least(F.lit(1.0), over_minimum / (flying * area)))


def time_validity(best_ess_time: Column, best_distance: Column, nominal_time: Column,
                  nominal_distance: Column) -> Column:
    ratio = (F.when(best_ess_time > 0, F.least(F.lit(1.0), best_ess_time / nominal_time))
             .when(nominal_distance != 0, F.least(F.lit(1.0), best_distance / nominal_distance))
             .otherwise(F.lit(0.0)))
    return _clamp01(_cubic(ratio, -0.271, 2.912, -2.098, 0.457))


# --- allocation ---------------------------------------------------------------

def distance_weight(goal_ratio: Column) -> Column:
    return _cubic(goal_ratio, 0.9, -1.665, 1.713, -0.587)


def leading_weight(dw: Column, leading_time_ratio: Column, goal_ratio: Column) -> Column:
    return F.when(goal_ratio == 0, 1 - dw).otherwise((1 - dw) * leading_time_ratio)


def available_points(validity: Column, weight: Column, integer_pots: bool = False) -> Column:
    pot = 1000 * validity * weight
    return F.bround(pot, 0) if integer_pots else pot


# --- pilot points -------------------------------------------------------------

def distance_points(dist: Column, best: Column, pot: Column) -> Column:
    return F.when(best <= 0, F.lit(0.0)).otherwise(
        round1(F.least(dist / best, F.lit(1.0)) * pot))


def speed_fraction(time_s: Column, best_s: Column) -> Column:
    best_h, time_h = best_s / 3600, time_s / 3600
    over = (time_h - best_h) / F.sqrt(best_h)
    return (F.when(best_s.isNull() | (best_s <= 0), F.lit(0.0))
            .when(time_h <= best_h, F.lit(1.0))
            .otherwise(F.greatest(F.lit(0.0), 1 - F.pow(over, F.lit(5.0 / 6.0)))))


def time_points(time_s: Column, best_s: Column, pot: Column, altitude_factor: Column,
                ess_factor: Column) -> Column:
    return F.when((best_s > 0) & (time_s != 0), round1(
        speed_fraction(time_s, best_s) * pot * altitude_factor * ess_factor)).otherwise(F.lit(0.0))


def leading_factor(lc: Column, lc_min: Column) -> Column:
    return F.when(lc_min <= 0, F.lit(0.0)).otherwise(F.greatest(
        F.lit(0.0), 1 - F.cbrt((lc - lc_min) * (lc - lc_min) / lc_min)))


def leading_points(lc: Column, lc_min: Column, pot: Column) -> Column:
    return F.when((lc > 0) & (lc_min > 0), round1(leading_factor(lc, lc_min) * pot)
                  ).otherwise(F.lit(0.0))


def goal_altitude_factor(crossing_alt: Column, goal_alt: Column, band: Column) -> Column:
    a = (crossing_alt - goal_alt) / band
    return (F.when(band <= 0, F.lit(1.0)).when(crossing_alt <= goal_alt, F.lit(0.8))
            .when(crossing_alt >= goal_alt + band, F.lit(1.0))
            .otherwise(_cubic(a, 0.8, 0.6, -0.6, 0.2)))


def ess_no_goal_factor(in_goal: Column, reached_ess: Column, configured: Column) -> Column:
    return F.when(in_goal, F.lit(1.0)).when(reached_ess, configured).otherwise(F.lit(0.0))


def scored_distance(raw: Column, minimum: Column, airborne: Column) -> Column:
    return F.when(airborne, F.greatest(minimum, F.greatest(F.lit(0.0), raw))).otherwise(F.lit(0.0))


def early_start_distance(launch_to_sss: Column, course: Column, policy: str = "launch_to_sss") -> Column:
    if policy not in ("launch_to_sss", "full_distance"):
        raise ValueError(f"unknown early-start policy {policy!r}")
    return F.greatest(F.lit(0.0), course if policy == "full_distance" else launch_to_sss)


# --- stopped tasks --------------------------------------------------------------

def stopped_validity(reached_ess: Column, duration: Column, minimum_time: Column, best: Column,
                     mean: Column, length_to_ess: Column, landed: Column, launched: Column) -> Column:
    spread = length_to_ess - best + 1
    distance_part = F.when(spread <= 0, F.lit(0.0)).otherwise(
        F.sqrt(F.greatest(F.lit(0.0), (best - mean) / spread)))
    pilots_part = F.when(launched <= 0, F.lit(0.0)).otherwise(F.pow(landed / launched, F.lit(3.0)))
    duration_part = F.when(duration >= minimum_time, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(reached_ess > 0, F.lit(1.0)).otherwise(
        duration_part * F.least(F.lit(1.0), distance_part + pilots_part))


def time_points_reduction(any_goal: Column, best_s: Column, reference_s: Column, pot: Column) -> Column:
    return F.when(any_goal & reference_s.isNotNull() & best_s.isNotNull(),
                  F.greatest(F.lit(0.0), speed_fraction(reference_s, best_s) * pot)
                  ).otherwise(F.lit(0.0))


def altitude_bonus(last_alt: Column, goal_alt: Column, glide_ratio: Column) -> Column:
    return F.greatest(F.lit(0.0), last_alt - goal_alt) * glide_ratio
