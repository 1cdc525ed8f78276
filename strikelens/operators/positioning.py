"""Max pain, walls, regime score and the same-day pin table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelens.functions import greeks
from strikelens.functions.columns import MULTIPLIER, day, is_call, is_put
from strikelens.operators.exposure import gex_totals_of, strike_exposures
from strikelens.operators.snapshot import with_spot


def _strike_book(chain: DataFrame, group: Sequence[str]) -> DataFrame:
    def held(kind: Column) -> Column:
        return F.coalesce(F.sum(F.when(kind, F.coalesce("oi", F.lit(0)))), F.lit(0))

    return (
        chain.where(F.col("strike").isNotNull())
        .groupBy(*group, "strike")
        .agg(held(is_call()).alias("_calls"), held(is_put()).alias("_puts"))
    )


def _pain(book: DataFrame, group: Sequence[str]) -> DataFrame:
    """Dollar pain at every listed strike from running sums, not strike against strike."""
    below = Window.partitionBy(*group).orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*group).orderBy("strike").rowsBetween(1, Window.unboundedFollowing)
    k = F.col("strike")

    def total(value: Column, window) -> Column:
        return F.coalesce(F.sum(value).over(window), F.lit(0.0))

    calls, puts = F.col("_calls").cast("double"), F.col("_puts").cast("double")
    call_loss = k * total(calls, below) - total(calls * k, below)
    put_loss = total(puts * k, above) - k * total(puts, above)
    return book.select(*group, "strike", ((call_loss + put_loss) * MULTIPLIER).alias("pain"))


def max_pain_curve(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    group = [*keys, "expiration"]
    return _pain(_strike_book(chain, group), group)


def _lowest(curve: DataFrame, group: Sequence[str]) -> DataFrame:
    best = F.min(F.struct("pain", "strike"))
    return curve.groupBy(*group).agg(best.alias("_best")).select(
        *group, F.col("_best.strike").alias("strike"), F.col("_best.pain").alias("pain")
    )


def max_pain(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Strike with the least pain per expiry; the lowest strike on ties."""
    return _lowest(max_pain_curve(chain, keys), [*keys, "expiration"])


def max_pain_aggregate(
    chain: DataFrame, *, nearest: int = 5, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Max pain of the first expiries pooled into one book."""
    group = [*keys, "expiration"]
    book = _strike_book(chain, group)
    order = Window.partitionBy(*keys).orderBy("expiration")
    pooled = (
        book.withColumn("_rank", F.dense_rank().over(order))
        .where(F.col("_rank") <= nearest)
        .groupBy(*keys, "strike")
        .agg(F.sum("_calls").alias("_calls"), F.sum("_puts").alias("_puts"))
    )
    return _lowest(_pain(pooled, keys), keys)


def walls(
    chain: DataFrame, *, top_n: int = 3, mode: str = "both", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Largest strikes by open interest and by volume, for calls and for puts."""
    return walls_of(strike_exposures(chain, keys=keys), top_n=top_n, mode=mode, keys=keys)


def walls_of(
    strikes: DataFrame, *, top_n: int = 3, mode: str = "both", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The walls of a strike table."""
    weights = {"oi": ["oi"], "volume": ["volume"], "both": ["oi", "volume"]}[mode]
    entries = [
        F.struct(
            F.lit(weight).alias("weight"),
            F.lit(letter).alias("option_type"),
            F.col(f"{side}_{weight}").alias("value"),
        )
        for weight in weights
        for side, letter in (("call", "C"), ("put", "P"))
    ]
    order = Window.partitionBy(*keys, "weight", "option_type").orderBy(F.desc("value"), "strike")
    return (
        strikes.select(*keys, "strike", F.inline(F.array(*entries)))
        .where(F.col("value") > 0)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_n)
    )


def _clamp(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def regime(
    chain: DataFrame,
    *,
    top_n: int = 3,
    threshold: float = 0.2,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Bullish, bearish or neutral score per snapshot, by open interest and by volume."""
    strikes = strike_exposures(chain, keys=keys)
    return regime_of(strikes, top_n=top_n, threshold=threshold, keys=keys)


def regime_of(
    strikes: DataFrame,
    *,
    top_n: int = 3,
    threshold: float = 0.2,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """The regime of a strike table."""
    held = [f"{side}_{weight}" for weight in ("oi", "volume") for side in ("call", "put")]
    ranked = strikes.withColumns(
        {
            f"_rank_{c}": F.row_number().over(
                Window.partitionBy(*keys).orderBy(F.desc_nulls_last(c), "strike")
            )
            for c in held
        }
    )

    def wall(column: str) -> Column:
        counted = (F.col(f"_rank_{column}") <= top_n) & (F.col(column) > 0)
        return F.coalesce(F.sum(F.when(counted, F.col(column))), F.lit(0.0))

    both = gex_totals_of(
        ranked,
        keys,
        also={
            "call_wall_total": lambda weight: wall(f"call_{weight}"),
            "put_wall_total": lambda weight: wall(f"put_{weight}"),
        },
    )
    return score_regime(both, threshold=threshold).select(
        *keys, "weight", "score", "label", "call_wall_total", "put_wall_total", "net_gex"
    )


def score_regime(totals: DataFrame, *, threshold: float = 0.2) -> DataFrame:
    """Blend wall dominance (60 %) and net over gross gamma (40 %) into a labelled score."""
    stacked = F.col("call_wall_total") + F.col("put_wall_total")
    dominance = F.when(
        stacked > 0,
        (F.col("call_wall_total") - F.col("put_wall_total")) / F.nullif(stacked, F.lit(0.0)),
    ).otherwise(0.0)
    lean = F.when(
        F.col("gross_total") > 0,
        _clamp(F.col("net_total") / F.nullif(F.col("gross_total"), F.lit(0.0))),
    ).otherwise(0.0)
    scored = totals.withColumn("score", _clamp(dominance * 0.6 + lean * 0.4))
    label = F.when(F.col("score") > threshold, "bullish").when(
        F.col("score") < -threshold, "bearish"
    )
    return scored.withColumn("label", label.otherwise("neutral")).withColumn(
        "net_gex", F.col("net_total")
    )


def pin_probability(
    chain: DataFrame,
    *,
    as_of,
    sigma_floor: float = 1e-4,
    charm_weight: float = 0.5,
    rate: float = 0.05,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Relative closing likelihood of each strike expiring on ``as_of``."""
    tau = 1.0 / 365.0
    keys = list(keys)
    today = with_spot(chain, keys).where(
        (F.col("expiration") == day(as_of))
        & (F.col("iv") > 0)
        & (F.col("strike") > 0)
        & F.col("spot").isNotNull()
    )
    charm = greeks.charm(F.col("spot"), F.col("strike"), F.lit(tau), F.col("iv"), rate)
    typical = F.median("iv").over(Window.partitionBy(*keys))
    per_strike = today.withColumn("_median_iv", typical).groupBy(
        *keys, "spot", "_median_iv", "strike"
    ).agg(
        F.sum(F.coalesce("oi", F.lit(0))).alias("oi"),
        F.sum(F.abs(charm)).alias("abs_charm"),
        F.median("iv").alias("atm_iv"),
    )
    width = F.greatest(F.lit(sigma_floor), F.col("spot") * F.col("_median_iv") * (tau**0.5))
    distance = (F.col("strike") - F.col("spot")) / width
    raw = (F.col("oi") + F.col("abs_charm") * charm_weight) * F.exp(distance * distance * -0.5)
    total = F.sum("_raw").over(Window.partitionBy(*keys))
    return (
        per_strike.withColumn("_raw", raw)
        .withColumn("_total", total)
        .where((F.col("_total") > 0) & (F.col("_total") < float("inf")))
        .withColumn("prob", F.col("_raw") / F.col("_total"))
        .select(*keys, "strike", "prob", "oi", "abs_charm", "atm_iv")
    )
