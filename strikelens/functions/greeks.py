"""Black-Scholes-Merton values as Column expressions.

Every formula takes Columns for spot, strike, year fraction and vol, and goes null
when one of them is not positive, so no row can divide by zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strikelens.functions.columns import positive

SQRT_TWO_PI = math.sqrt(2.0 * math.pi)

# Rational approximation of the normal tail (Hart 1968, as given by West 2005),
# coefficients from the highest power down.
TAIL_NUMERATOR = (
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
)
TAIL_DENOMINATOR = (
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
)
TAIL_SWITCH = 7.07106781186547
TAIL_SCALE = 2.506628274631


def _horner(coefficients, x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def _near_tail(x):
    return _horner(TAIL_NUMERATOR, x) / _horner(TAIL_DENOMINATOR, x)


def _far_tail(x):
    fraction = x + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = x + k / fraction
    return 1.0 / (fraction * TAIL_SCALE)


def norm_pdf(x: Column) -> Column:
    return F.exp(x * x * -0.5) / SQRT_TWO_PI


def norm_cdf(x: Column) -> Column:
    size = F.abs(x)
    tail = F.exp(size * size * -0.5) * F.when(size < TAIL_SWITCH, _near_tail(size)).otherwise(
        _far_tail(size)
    )
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def d1(spot, strike, tau, sigma, r: float, q: float = 0.0) -> Column:
    sigma = positive(sigma)
    drift = (F.lit(r - q) + sigma * sigma * 0.5) * tau
    return (F.ln(positive(spot) / positive(strike)) + drift) / (sigma * F.sqrt(positive(tau)))


def d2(spot, strike, tau, sigma, r: float, q: float = 0.0) -> Column:
    return d1(spot, strike, tau, sigma, r, q) - sigma * F.sqrt(tau)


def _carry(tau, q: float) -> Column:
    return F.exp(tau * -q) if q else F.lit(1.0)


def gamma(spot, strike, tau, sigma, r: float, q: float = 0.0) -> Column:
    density = norm_pdf(d1(spot, strike, tau, sigma, r, q))
    return _carry(tau, q) * density / (positive(spot) * positive(sigma) * F.sqrt(positive(tau)))


def delta(first: Column, tau: Column, call: Column, q: float = 0.0) -> Column:
    """Delta from ``d1``. Pass ``d1`` as a plain column: the normal CDF repeats its input."""
    upper = norm_cdf(first)
    return _carry(tau, q) * F.when(call, upper).otherwise(upper - 1.0)


def vanna(spot, strike, tau, sigma, r: float, q: float = 0.0) -> Column:
    """Change of delta per unit of vol; the same for calls and puts."""
    first = d1(spot, strike, tau, sigma, r, q)
    return -_carry(tau, q) * norm_pdf(first) * d2(spot, strike, tau, sigma, r, q) / positive(sigma)


def charm(
    spot, strike, tau, sigma, r: float, q: float = 0.0, dividend_delta: Column | None = None
) -> Column:
    """Change of delta per year.

    Calls and puts only differ with a dividend yield, whose term is ``q`` times the delta
    (:func:`delta`); pass that delta as ``dividend_delta`` when ``q`` is not zero.
    """
    first = d1(spot, strike, tau, sigma, r, q)
    second = d2(spot, strike, tau, sigma, r, q)
    width = positive(sigma) * F.sqrt(positive(tau))
    bracket = F.lit(r - q) / width - second / (positive(tau) * 2.0)
    common = -_carry(tau, q) * norm_pdf(first) * bracket
    return common + dividend_delta * q if q else common


def vega(spot, strike, tau, sigma, r: float, q: float = 0.0) -> Column:
    """Per unit of vol."""
    return (
        positive(spot) * _carry(tau, q) * norm_pdf(d1(spot, strike, tau, sigma, r, q))
        * F.sqrt(positive(tau))
    )


def with_price(
    options: DataFrame, *, spot: str, strike: str, tau: str, sigma: str, r: float, call: Column
) -> DataFrame:
    """Add ``bs_price``: the option value, or intrinsic value when an input is not positive."""
    inputs = [F.col(c) for c in (spot, strike, tau, sigma)]
    staged = options.withColumns({"_d1": d1(*inputs, r), "_d2": d2(*inputs, r)})
    discounted = F.col(strike) * F.exp(F.col(tau) * -r)
    upper = F.col(spot) * norm_cdf(F.col("_d1")) - discounted * norm_cdf(F.col("_d2"))
    # A put is the call less the forward (put-call parity).
    value = F.when(call, upper).otherwise(upper - F.col(spot) + discounted)
    reach = F.when(call, F.col(spot) - F.col(strike)).otherwise(F.col(strike) - F.col(spot))
    return staged.withColumn(
        "bs_price", F.coalesce(value, F.greatest(F.lit(0.0), reach))
    ).drop("_d1", "_d2")
