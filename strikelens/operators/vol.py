"""Implied vol: bulk fill, at-the-money vol, skew, surface, term structure, move tracker."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelens.functions import greeks
from strikelens.functions.columns import (
    is_call,
    is_put,
    price_last_first,
    year_fraction,
)
from strikelens.operators.snapshot import dte, with_spot

IV_LOW = 0.01
IV_HIGH = 5.0
#: The bracket is halved this often: the vol is known to 5e-9.
SOLVER_STEPS = 30


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def solved_vol(price: Column, spot: Column, strike: Column, tau: Column, rate: float, call: Column) -> Column:
    """The vol in [1 %, 500 %] that reproduces a price, null where none does.

    A fold over a short array that halves the bracket ``SOLVER_STEPS`` times; the vol is the middle
    of what is left. The resolution is part of the result: net exposures of deep options are small
    differences of large numbers, where the next digits of a vol can be seen. All inputs have to be positive.
    """
    inputs = F.struct(
        price.cast("double").alias("price"), spot.cast("double").alias("spot"), call.alias("call"),
        (F.lit(0.0) + tau).alias("tau"), F.sqrt(tau).alias("root"), F.ln(spot / strike).alias("away"),
        (strike * F.exp(tau * -rate)).alias("discounted"),
    )

    def value(of: Column, d: Column) -> Column:
        first, second, upper = d["first"], d["second"], of["call"]
        sign = F.when(upper, 1.0).otherwise(-1.0)
        return sign * (of["spot"] * greeks.norm_cdf(sign * first) - of["discounted"] * greeks.norm_cdf(sign * second))

    def at(of: Column, sigma: Column, body: Callable[[Column], Column]) -> Column:
        first = (of["away"] + (F.lit(rate) + sigma * sigma * 0.5) * of["tau"]) / (sigma * of["root"])
        return _let(first, lambda x: _let(F.struct(x.alias("first"), (x - sigma * of["root"]).alias("second")), body))

    def step(of: Column, now: Column) -> Column:
        def halved(middle: Column) -> Column:
            below = at(of, middle, lambda d: value(of, d)) < of["price"]
            return F.struct(
                F.when(below, middle).otherwise(now["low"]).alias("low"),
                F.when(below, now["high"]).otherwise(middle).alias("high"),
            )

        return _let((now["low"] + now["high"]) / 2.0, halved)

    def solve(of: Column) -> Column:
        begin = F.struct(F.lit(IV_LOW).alias("low"), F.lit(IV_HIGH).alias("high"))
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(SOLVER_STEPS)), begin, lambda now, _: step(of, now), lambda end: (end["low"] + end["high"]) / 2.0
        )
        under, over = (at(of, F.lit(x), lambda d: value(of, d)) for x in (IV_LOW, IV_HIGH))
        return F.when((under <= of["price"]) & (over >= of["price"]), found)

    return _let(inputs, solve)


def fill_iv(chain: DataFrame, *, as_of, rate: float = 0.05) -> DataFrame:
    """Solve vol where it is missing, not positive or above 500 %; then fill gamma and delta.

    Rows that cannot be solved keep the vol they had. All of it stays in the JVM, and the solver
    runs for the rows that need it.
    """
    call = F.upper("option_type") == "C"
    strike, spot = F.col("strike"), F.col("underlying_price")
    intrinsic = F.greatest(
        F.lit(0.0), F.when(call, spot - strike).otherwise(strike - spot)
    )
    invalid = F.col("iv").isNull() | (F.col("iv") <= 0) | (F.col("iv") > IV_HIGH)
    price = price_last_first()
    solvable = invalid & (spot > 0) & (strike > 0) & (price > 0) & (price >= intrinsic)
    solved = solved_vol(price, spot, strike, year_fraction(as_of), rate, F.coalesce(call, F.lit(False)))
    filled = chain.withColumn("iv", F.coalesce(F.when(solvable, solved), F.col("iv")))
    return fill_greeks(filled, as_of=as_of, rate=rate)


def known_greeks(chain: DataFrame, *, as_of) -> DataFrame:
    """``gamma`` and ``delta`` as 1 where :func:`fill_greeks` gives a value, null elsewhere.

    Coverage needs no normal distribution: a value is known where it is there already or where
    price, strike, vol and time are positive.
    """
    inputs = (F.col("underlying_price"), F.col("strike"), F.col("iv"), year_fraction(as_of))
    solvable = F.lit(True)
    for value in inputs:
        solvable = solvable & (F.coalesce(value, F.lit(0.0)) > 0)
    out = {}
    for name in ("gamma", "delta"):
        have = F.col(name).isNotNull() if name in chain.columns else F.lit(False)
        out[name] = F.when(have | solvable, 1.0)
    return chain.withColumns(out)


def fill_greeks(chain: DataFrame, *, as_of, rate: float = 0.05) -> DataFrame:
    """Analytic gamma and delta where they are null or zero and the inputs allow it."""
    tau = year_fraction(as_of)
    spot, strike, sigma = F.col("underlying_price"), F.col("strike"), F.col("iv")
    staged = chain.withColumns(
        {"_tau": tau, "_d1": greeks.d1(spot, strike, tau, sigma, rate)}
    )
    values = {
        "gamma": greeks.gamma(spot, strike, F.col("_tau"), sigma, rate),
        "delta": greeks.delta(F.col("_d1"), F.col("_tau"), F.upper("option_type") == "C"),
    }
    out = {}
    for name, value in values.items():
        have = F.col(name) if name in chain.columns else F.lit(None).cast("double")
        out[name] = F.when(have.isNull() | (have == 0), F.coalesce(value, have)).otherwise(have)
    return staged.withColumns(out).drop("_tau", "_d1")


def atm_iv(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Mean vol of all rows at the strike nearest spot, in the first expiry listed.

    Null when that expiry has no vol at all.
    """
    whole = Window.partitionBy(*keys)
    gap = F.abs(F.col("strike") - F.col("spot"))
    front = with_spot(chain, keys).where(F.col("spot").isNotNull()).withColumn(
        "_gap",
        F.when(
            F.col("iv").isNotNull() & (F.col("expiration") == F.min("expiration").over(whole)),
            gap,
        ),
    )
    nearest = front.withColumn("_nearest", F.min("_gap").over(whole))
    return nearest.groupBy(*keys).agg(
        F.avg(F.when(F.col("_gap") == F.col("_nearest"), F.col("iv"))).alias("atm_iv")
    )


def _nearest_delta(target: float, kind: Column) -> Column:
    """Vol of the row whose delta is nearest the target; the lower strike on ties."""
    fits = kind & F.col("iv").isNotNull() & F.col("delta").isNotNull()
    distance = F.struct(F.abs(F.col("delta") - target), F.col("strike"))
    return F.min_by("iv", F.when(fits, distance))


def iv_skew(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """25-delta call vol less 25-delta put vol, for expiries that have both sides."""
    legs = with_spot(chain, keys).where(F.col("spot").isNotNull()).groupBy(*keys, "expiration").agg(
        _nearest_delta(0.25, is_call()).alias("_call"),
        _nearest_delta(-0.25, is_put()).alias("_put"),
    )
    return legs.where(F.col("_call").isNotNull() & F.col("_put").isNotNull()).select(
        *keys, "expiration", (F.col("_call") - F.col("_put")).alias("skew")
    )


def iv_surface(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Every quoted vol: expiry, strike, type, vol, delta."""
    priced = with_spot(chain, keys).where(F.col("spot").isNotNull() & F.col("iv").isNotNull())
    return priced.select(*keys, "expiration", "strike", "option_type", "iv", "delta")


def term_structure(
    chain: DataFrame, *, as_of, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Per expiry: days left, at-the-money vol, 25-delta vols and their risk reversal.

    At-the-money is the mean over the two rows nearest spot, which may be two strikes.
    """
    group = [*keys, "expiration"]
    usable = with_spot(chain, keys).where(
        (F.col("iv") > 0)
        & F.col("strike").isNotNull()
        & F.col("expiration").isNotNull()
        & F.col("spot").isNotNull()
    )
    order = Window.partitionBy(*group).orderBy(
        F.abs(F.col("strike") - F.col("spot")), "strike", "option_type"
    )
    ranked = usable.withColumn("_near", F.row_number().over(order))
    legs = ranked.groupBy(*group).agg(
        F.avg(F.when(F.col("_near") <= 2, F.col("iv"))).alias("atm_iv"),
        _nearest_delta(0.25, is_call()).alias("call_25d_iv"),
        _nearest_delta(-0.25, is_put()).alias("put_25d_iv"),
    )
    return legs.select(
        *group,
        F.greatest(F.lit(0), dte(as_of)).alias("days_to_expiry"),
        "atm_iv",
        "call_25d_iv",
        "put_25d_iv",
        (F.col("call_25d_iv") - F.col("put_25d_iv")).alias("risk_reversal_25d"),
    )


def move_tracker(
    chain: DataFrame,
    *,
    as_of,
    opens: DataFrame | None = None,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Move since the open against the move the front straddle implies for one day.

    ``opens`` holds ``open_price`` per ``keys`` (see :func:`session_open`); without it
    only the implied side is known.
    """
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    priced = F.col("last_price").isNotNull() & F.col("strike").isNotNull()
    days = dte(as_of)
    front = with_spot(chain, keys).withColumn(
        "_dte", F.min(F.when(priced & (days >= 0), days)).over(whole)
    )
    in_front = priced & (days == F.col("_dte"))
    near = F.struct(F.abs(F.col("strike") - F.col("spot")), F.col("strike"))
    picked = front.withColumn(
        "_atm", F.min(F.when(in_front & F.col("spot").isNotNull(), near)).over(whole)["strike"]
    )
    at_money = in_front & (F.col("strike") == F.col("_atm"))
    straddle = picked.groupBy(*keys).agg(
        F.max("spot").alias("underlying_price"),
        F.max("_dte").alias("implied_dte"),
        F.max(F.when(at_money & is_call(), F.col("last_price"))).alias("_call"),
        F.max(F.when(at_money & is_put(), F.col("last_price"))).alias("_put"),
    )
    if opens is None:
        straddle = straddle.withColumn("open_price", F.lit(None).cast("double"))
    else:
        straddle = straddle.join(opens.select(*keys, "open_price"), keys, "left")
    total = F.col("_call") + F.col("_put")
    per_day = total / F.sqrt(F.greatest(F.col("implied_dte"), F.lit(1)))
    realized = F.when(
        F.col("open_price") > 0, F.abs(F.col("underlying_price") - F.col("open_price"))
    )
    moves = straddle.withColumns({"realized_move": realized, "implied_move": per_day})
    ratio = F.when(
        F.col("implied_move") > 0,
        F.col("realized_move") / F.nullif(F.col("implied_move"), F.lit(0.0)),
    )
    known = F.col("underlying_price").isNotNull()
    return moves.select(
        *keys,
        "underlying_price",
        "open_price",
        "realized_move",
        F.when(known, F.col("implied_move")).alias("implied_move"),
        F.when(known, F.col("implied_dte")).alias("implied_dte"),
        ratio.alias("ratio"),
    )


def session_open(prices: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """First price of the session per key, from a table of ``ts`` and ``price``.

    ``seq``, where there is one, decides between prices of one time, then the lower price.
    """
    order = [c for c in ("ts", "seq", "price") if c in prices.columns]
    return prices.where(F.col("price").isNotNull()).groupBy(*keys).agg(
        F.min_by("price", F.struct(*order)).alias("open_price")
    )
