"""Scalar math: factors, logs, bumps, response curves, polynomials."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.plans.columns import let

# Log predictions.
LOG_STEP = 0.1
LOG_TRIES = 19
LOG_FALLBACK = 10_000
# Fixed value: what a response curve yields where it is undefined.
CURVE_GAP = 1e-8
# Fixed value: largest half-precision number, stands for infinity.
HALF_MAX = 65_504.0

_EXP_LIMIT = math.log(1.7976931348623157e308)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def finite(x: Column) -> Column:
    """NaN as 0 and +infinity as the largest half-precision number."""
    x = F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))
    return F.when(x == F.lit(float("inf")), F.lit(HALF_MAX)).otherwise(x)


def unlog(v: Column) -> Column:
    """``expm1``; overflowing values are lowered in steps of 0.1 at most 19 times.

    The number of steps follows from the distance to the largest exponent, so no loop is needed.
    What still overflows after the last step becomes ``|value| * 10000``.
    """
    clean = F.nanvl(v, F.lit(None).cast("double"))
    steps = F.greatest(F.ceil((clean - F.lit(_EXP_LIMIT)) / F.lit(LOG_STEP)), F.lit(0)).cast("double")
    # rounding may leave the computed step one short of finite, so the next one is tried as well
    lowered = F.expm1(clean - F.lit(LOG_STEP) * steps)
    again = F.expm1(clean - F.lit(LOG_STEP) * (steps + 1))
    infinite = F.lit(float("inf"))
    last = F.abs(clean - F.lit(LOG_STEP * LOG_TRIES)) * F.lit(float(LOG_FALLBACK))
    return (
        F.when((steps <= LOG_TRIES) & (lowered < infinite), lowered)
        .when((steps + 1 <= LOG_TRIES) & (again < infinite), again)
        .otherwise(last)
    )


def factors(
    weights: Sequence[float], bias: float | None, normalize: bool = True, bias_in_factors: bool = True
) -> tuple[list[float], float]:
    """Weights and additive bias actually used for a weighted factor model."""
    total = sum(weights) if normalize else 1.0
    used = [float(w) / total for w in weights]
    offset = float(bias or 0.0)
    if bias_in_factors and abs(offset) < 1.0:
        return [offset + w * (1.0 - offset) for w in used], 0.0
    return used, offset


def bump_values(xs: Sequence[float], mu: float = 0.0, sigma: float = 1.1) -> list[float]:
    """Gaussian bump over a fixed list of points, stretched to [0, 1]."""
    heights = [math.exp(-math.pi * sigma**2 - 0.5 * ((x - mu) / sigma) ** 2) for x in xs]
    low, high = min(heights), max(heights)
    return [(h - low) / (high - low) for h in heights]


def bump(points: Column, mu: Column | float = 0.0, sigma: float = 1.1) -> Column:
    """The same over an array column."""
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    heights = F.transform(
        points,
        lambda x: F.exp(F.lit(-math.pi * sigma**2) - F.lit(0.5) * F.pow((x - mu) / F.lit(sigma), F.lit(2.0))),
    )

    def stretched(h: Column) -> Column:
        ends = F.struct(F.array_min(h).alias("low"), F.array_max(h).alias("high"))
        return let(ends, lambda e: F.transform(h, lambda x: (x - e["low"]) / (e["high"] - e["low"])))

    return let(heights, stretched)


def adbudg(x: Column, gamma: float | Column, rho: float | Column, magnitude: bool = False) -> Column:
    """Saturating response ``s / (s + rho)`` with ``s = sign(x) |x|^gamma``."""
    gamma = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    rho = rho if isinstance(rho, Column) else F.lit(float(rho))
    size = F.pow(F.abs(x), gamma)
    if magnitude:
        return F.coalesce(F.signum(x) * F.try_divide(size, size + rho), F.lit(CURVE_GAP))
    signed = F.signum(x) * size
    return F.coalesce(F.nanvl(F.try_divide(signed, signed + rho), F.lit(None).cast("double")), F.lit(CURVE_GAP))


def lognormal(x: Column, sigma: float | Column, mu: float | Column, lowest: float = 0.0) -> Column:
    """Log-normal density after shifting by the smallest value and a hair more."""
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    mu = mu if isinstance(mu, Column) else F.lit(float(mu))
    moved = x + F.lit(float(lowest) + CURVE_GAP)
    spread = F.lit(2.0) * sigma * sigma
    inside = F.when(
        moved > 0,
        F.exp(-F.pow(F.log(moved) - mu, F.lit(2.0)) / spread) / (moved * F.sqrt(spread * F.lit(math.pi))),
    )
    return F.coalesce(inside, F.lit(CURVE_GAP))


def monomials(
    columns: Sequence[str], degree: int = 2, include_bias: bool = True, interaction_only: bool = False
) -> list[tuple[str, tuple[str, ...]]]:
    """Names and factor lists of all monomials, by degree and then by column position."""
    choose = combinations if interaction_only else combinations_with_replacement
    terms: list[tuple[str, tuple[str, ...]]] = [("1", ())] if include_bias else []
    for d in range(1, degree + 1):
        for picked in choose(columns, d):
            powers = {c: picked.count(c) for c in dict.fromkeys(picked)}
            label = " ".join(c if p == 1 else f"{c}^{p}" for c, p in powers.items())
            terms.append((label, picked))
    return terms


def polynomial(x: Column, coefficients: Sequence[float], cut: float | None = None) -> Column:
    """``sum coefficients[p] * x^p`` by nested multiplication, x clipped at ``cut`` from above."""
    if cut is not None:
        x = F.when(x > F.lit(float(cut)), F.lit(float(cut))).otherwise(x)
    total: Column = F.lit(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = total * x + F.lit(float(c))
    return total


def probit_tail(p: Column) -> Column:
    """What ``probit`` needs near 0 and 1; worth a column of its own because it is used many times."""
    return F.sqrt(F.lit(-2.0) * F.log(F.least(p, F.lit(1.0) - p)))


def probit(p: Column, tail: Column | None = None) -> Column:
    """Inverse normal distribution function: published rational approximation by P. J. Acklam."""
    # Published coefficients of the approximation.
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
    low = 0.02425

    def rising(x: Column, coefs: Sequence[float]) -> Column:
        return polynomial(x, list(reversed(coefs)))

    tail = probit_tail(p) if tail is None else tail
    outer = rising(tail, c) / (rising(tail, d) * tail + F.lit(1.0))
    centre = p - F.lit(0.5)
    r = centre * centre
    inner = rising(r, a) * centre / (rising(r, b) * r + F.lit(1.0))
    return F.when(p < low, outer).when(p > 1 - low, -outer).otherwise(inner)
