"""Dealer exposure by strike: gamma, vanna, charm, and the zero-gamma level."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelens.functions import greeks
from strikelens.functions.columns import (
    MULTIPLIER,
    is_call,
    is_put,
    side_sign,
    year_fraction,
)
from strikelens.operators.snapshot import with_spot

ONE_PERCENT = 0.01
BUSINESS_DAYS = 252.0


def _weight(weight: str) -> Column:
    return F.coalesce(F.col(weight).cast("double"), F.lit(0.0))


def strike_exposures(
    chain: DataFrame,
    *,
    as_of=None,
    rate: float = 0.05,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Every weight and exposure per strike over all expiries, in one aggregate.

    Walls, curves and totals each select their part; the columns they leave out are pruned
    from the aggregate. Vanna and charm need ``as_of``; they are null at strikes where no
    option has a weight and a vol.
    """
    spot, strike = F.col("spot"), F.col("strike")
    dollars = F.lit(MULTIPLIER) * spot * spot * ONE_PERCENT
    columns = [F.count_if(is_call() | is_put()).alias("listed")]
    for weight in ("oi", "volume"):
        gex = F.coalesce(F.col("gamma") * _weight(weight), F.lit(0.0)) * dollars
        for side, kind, sign in (("call", is_call(), gex), ("put", is_put(), -gex)):
            columns += [
                F.coalesce(F.sum(F.when(kind, sign)), F.lit(0.0)).alias(f"{side}_gex_{weight}"),
                F.sum(F.when(kind, _weight(weight))).alias(f"{side}_{weight}"),
            ]
        columns.append(F.sum(F.abs(_weight(weight))).alias(f"gross_{weight}"))
    ready = with_spot(chain, keys)
    if as_of is not None:
        ready = ready.withColumn("tau", year_fraction(as_of))
        inputs = (spot, strike, F.col("tau"), F.col("iv"), rate)
        usable = (spot > 0) & (F.col("iv") > 0) & (strike > 0)
        for weight in ("oi", "volume"):
            held = F.when(usable & (_weight(weight) != 0), side_sign() * _weight(weight))
            vanna = greeks.vanna(*inputs) * MULTIPLIER * spot * ONE_PERCENT
            charm = greeks.charm(*inputs) * MULTIPLIER * spot / BUSINESS_DAYS
            columns += [
                F.sum(held * vanna).alias(f"vanna_{weight}"),
                F.sum(held * charm).alias(f"charm_{weight}"),
            ]
    return ready.groupBy(*keys, spot.alias("underlying_price"), "strike").agg(*columns)


def gex_curve(
    chain: DataFrame,
    *,
    weight: str = "oi",
    expiry: str = "all",
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Dollar gamma per strike over all expiries, or one: call, put and net.

    Snapshots without a spot or with no weight at all have no curve.
    """
    chain = with_spot(chain, keys)
    if expiry != "all":
        chain = chain.where(F.col("expiration") == F.lit(expiry).cast("date"))
    return gex_of(strike_exposures(chain, keys=keys), weight=weight, keys=keys)


def gex_of(
    strikes: DataFrame, *, weight: str = "oi", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The gamma curve of a strike table."""
    held = F.sum(f"gross_{weight}").over(Window.partitionBy(*keys))
    return (
        strikes.withColumn("_held", held)
        .where("_held > 0 AND listed > 0 AND underlying_price IS NOT NULL")
        .select(
            *keys,
            "underlying_price",
            "strike",
            F.col(f"call_gex_{weight}").alias("call_gex"),
            F.col(f"put_gex_{weight}").alias("put_gex"),
            net_gex(weight).alias("net_gex"),
        )
    )


def net_gex(weight: str) -> Column:
    """Net gamma of a row of the strike table."""
    return F.col(f"call_gex_{weight}") - F.abs(f"put_gex_{weight}")


def gex_totals(
    chain: DataFrame, *, weight: str = "oi", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Net and gross gamma per snapshot; zero where there is no curve."""
    totals = gex_totals_of(strike_exposures(chain, keys=keys), keys)
    return totals.where(F.col("weight") == weight).drop("weight")


def gex_totals_of(
    strikes: DataFrame,
    keys: Sequence[str] = ("symbol",),
    also: dict[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """Gamma totals of a strike table, one row per snapshot and weight.

    ``also`` names more aggregates to take per weight in the same pass.
    """
    parts = []
    for weight in ("oi", "volume"):
        net = F.when((F.col("listed") > 0) & F.col("underlying_price").isNotNull(), net_gex(weight))
        parts.append(
            F.struct(
                F.lit(weight).alias("weight"),
                F.coalesce(F.sum(net), F.lit(0.0)).alias("net_total"),
                F.coalesce(F.sum(F.abs(net)), F.lit(0.0)).alias("gross_total"),
                *(build(weight).alias(name) for name, build in (also or {}).items()),
            )
        )
    summed = strikes.groupBy(*keys).agg(
        F.max("underlying_price").alias("underlying_price"), F.array(*parts).alias("_parts")
    )
    return summed.select(*keys, "underlying_price", F.inline("_parts"))


def vanna_curve(
    chain: DataFrame,
    *,
    as_of,
    weight: str = "oi",
    rate: float = 0.05,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Dollar vanna per strike, for one vol point."""
    return greek_of(strike_exposures(chain, as_of=as_of, rate=rate, keys=keys), "vanna", weight, keys)


def charm_curve(
    chain: DataFrame,
    *,
    as_of,
    weight: str = "oi",
    rate: float = 0.05,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Dollar charm per strike, for one business day."""
    return greek_of(strike_exposures(chain, as_of=as_of, rate=rate, keys=keys), "charm", weight, keys)


def greek_of(
    strikes: DataFrame, greek: str, weight: str = "oi", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The vanna or charm curve of a strike table."""
    value = F.col(f"{greek}_{weight}")
    return strikes.where(value.isNotNull()).select(
        *keys, "underlying_price", "strike", value.alias(f"{greek}_exposure")
    )


def top_levels(
    curve: DataFrame, value: str, *, top_n: int = 5, keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """The largest and the smallest strikes of a curve, ranked; ties by lower strike."""
    high = Window.partitionBy(*keys).orderBy(F.desc(value), "strike")
    low = Window.partitionBy(*keys).orderBy(value, "strike")
    ranked = curve.withColumns(
        {"_high": F.row_number().over(high), "_low": F.row_number().over(low)}
    )
    sides = F.array(
        F.struct(F.lit("positive").alias("side"), F.col("_high").alias("rank")),
        F.struct(F.lit("negative").alias("side"), F.col("_low").alias("rank")),
    )
    return (
        ranked.where((F.col("_high") <= top_n) | (F.col("_low") <= top_n))
        .withColumn("_place", F.explode(sides))
        .where(F.col("_place.rank") <= top_n)
        .select(*keys, F.col("_place.side").alias("side"), F.col("_place.rank").alias("rank"),
                "strike", value)
    )


def gamma_profile(
    chain: DataFrame,
    *,
    as_of,
    weights: Sequence[str] = ("volume",),
    rate: float = 0.05,
    search_pct: float = 0.05,
    n_points: int = 401,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Total dealer dollar gamma per weight at each point of a spot grid around the spot.

    Options that share strike, year fraction and vol are merged before the grid is
    expanded; the expansion feeds a hash aggregate that keeps ``n_points`` rows per
    snapshot, so the product of grid and options is never stored. All weights share it.
    """
    held = [F.sum(side_sign() * _weight(w)).alias(f"_held_{w}") for w in weights]
    merged = (
        with_spot(chain, keys)
        .withColumn("tau", year_fraction(as_of))
        .where((F.col("spot") > 0) & (F.col("iv") > 0) & (F.col("strike") > 0))
        .groupBy(*keys, "spot", "strike", "tau", "iv")
        .agg(*held)
    )
    # A symbol's options spread before they are multiplied; the number keeps them from being put together again.
    parts = int(chain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = merged.repartition(parts, *keys, "strike", "tau", "iv")
    low = F.col("spot") * (1.0 - search_pct)
    step = (F.col("spot") * (1.0 + search_pct) - low) / float(n_points - 1)
    expanded = merged.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    expanded = expanded.withColumn("level", low + F.col("point") * step)
    width = F.col("iv") * F.sqrt("tau")
    first = (
        F.ln(F.col("level") / F.col("strike"))
        + (F.lit(rate) + F.col("iv") * F.col("iv") * 0.5) * F.col("tau")
    ) / width
    # gamma * level^2 * multiplier * 1 %: one power of the level cancels.
    unit = greeks.norm_pdf(first) * F.col("level") / width * (MULTIPLIER * ONE_PERCENT)
    return (
        expanded.withColumn("_unit", unit)
        .groupBy(*keys, "spot", "point", "level")
        .agg(*(F.sum(F.col("_unit") * F.col(f"_held_{w}")).alias(w) for w in weights))
    )


def zero_gamma(
    chain: DataFrame,
    *,
    as_of,
    weights: Sequence[str] = ("volume",),
    rate: float = 0.05,
    search_pct: float = 0.05,
    n_points: int = 401,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Per weight the spot level nearest to the current one where total gamma changes sign.

    Null when the grid has no sign change or a total is not finite.
    """
    profile = gamma_profile(
        chain, as_of=as_of, weights=weights, rate=rate, search_pct=search_pct,
        n_points=n_points, keys=keys,
    )
    along = Window.partitionBy(*keys).orderBy("point")
    stepped = profile.withColumns(
        {
            "_next_level": F.lead("level").over(along),
            **{f"_next_{w}": F.lead(w).over(along) for w in weights},
        }
    )

    def crossing(weight: str) -> Column:
        here, there = F.col(weight), F.col(f"_next_{weight}")
        crosses = there.isNotNull() & (F.signum(here) != F.signum(there))
        share = F.coalesce(-here / F.nullif(there - here, F.lit(0.0)), F.lit(0.0))
        level = F.col("level") + share * (F.col("_next_level") - F.col("level"))
        distance = F.struct(F.abs(F.col("level") - F.col("spot")), F.col("point"))
        finite = F.bool_and(~(F.isnan(here) | (F.abs(here) == float("inf"))))
        return F.when(finite, F.min_by(level, F.when(crosses, distance)))

    levels = F.array(
        *(F.struct(F.lit(w).alias("weight"), F.col(f"_zero_{w}").alias("zero_gamma")) for w in weights)
    )
    found = stepped.groupBy(*keys).agg(*(crossing(w).alias(f"_zero_{w}") for w in weights))
    return found.select(*keys, F.inline(levels))
