"""Leading-coefficient columns.

The progress weight is a product of powers of ten, so its antiderivative is a
finite sum of exponentials: the integral between two progress values is a
closed-form column, with no lookup table.
"""

from __future__ import annotations

from math import comb, log

from pyspark.sql import Column
from pyspark.sql import functions as F

LN10 = log(10.0)

#: weight(u) = (1 - 10^(9u-9))^5 * (1 - 10^(-3u))^2 over the remaining fraction u,
#: multiplied out: {exponent per u: coefficient}, by the binomial theorem.
WEIGHT_TERMS = [
    (9 * i - 3 * j, (-1) ** (i + j) * comb(5, i) * comb(2, j) * 10.0 ** (-9 * i))
    for i in range(6) for j in range(3)
]


def rising(u: Column) -> Column:
    return F.pow(1 - F.pow(F.lit(10.0), 9 * u - 9), F.lit(5.0))


def falling(u: Column) -> Column:
    return F.pow(1 - F.pow(F.lit(10.0), -3 * u), F.lit(2.0))


def weight(done: Column) -> Column:
    u = 1 - done
    return rising(u) * falling(u)


def _antiderivative(u: Column) -> Column:
    """Sum of c/(k ln10) 10^(k u), plus u for the constant term; Horner-free, 18 terms."""
    total = None
    for k, c in WEIGHT_TERMS:
        term = u * c if k == 0 else F.exp(u * (k * LN10)) * (c / (k * LN10))
        total = term if total is None else total + term
    return total


def weight_integral(done_from: Column, done_to: Column) -> Column:
    """Integral of the weight between two progress fractions, clamped to [0, 1]."""
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done_from))
    b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), done_to))
    return F.when(done_to <= done_from, F.lit(0.0)).otherwise(
        _antiderivative(1 - a) - _antiderivative(1 - b))


def weighted_term(task_time: Column, d_km: Column, prev_km: Column, section_km: Column) -> Column:
    """One sample's share of the weighted leading area."""
    return d_km * task_time * weight_integral(
        1 - F.try_divide(prev_km, section_km), 1 - F.try_divide(d_km, section_km))


def hump_term(task_time: Column, d_km: Column, prev_km: Column, section_km: Column) -> Column:
    """One sample's share of the HUMP_V2A area, weighted at the interval's midpoint."""
    d = F.least(section_km, F.greatest(F.lit(0.0), d_km))
    mid = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (prev_km + d) / (2 * section_km)))
    return F.when(d < prev_km, task_time * (prev_km - d) * rising(mid) * falling(mid)
                  ).otherwise(F.lit(0.0))


def finish_weighted(area: Column, min_km: Column, section_km: Column, max_time: Column) -> Column:
    missing = min_km * max_time * weight_integral(1 - F.try_divide(min_km, section_km), F.lit(1.0))
    return F.when(section_km <= 0, F.lit(0.0)).otherwise((area + missing) / (1800 * section_km))


def finish_hump(area: Column, min_km: Column, section_km: Column, max_time: Column,
                last_time: Column, best_time: Column) -> Column:
    tail = F.when(best_time > 0, best_time / 2 + 100 * min_km).otherwise(
        F.greatest(F.lit(0.0), max_time - last_time))
    missing = F.when(min_km > 0, tail * min_km * falling(F.try_divide(min_km, section_km))).otherwise(F.lit(0.0))
    return F.when(section_km <= 0, F.lit(0.0)).otherwise((area + missing) / (1800 * section_km))
