"""The long metric table: one row per timestamp, symbol, metric type, strike and expiry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelens.functions.columns import instant
from strikelens.operators import exposure, flow, positioning, profile, vol
from strikelens.operators.snapshot import with_spot
from strikelens.session import branch_by_branch

#: Expiry of metrics that belong to no single expiry.
# Metric names and their extra fields, here and in the rows below.
NO_EXPIRY = "1970-01-01"
#: Strikes listed at either end of an exposure curve.
TOP_LEVELS = 5
METRIC_KEY = ("ts", "symbol", "metric_type", "strike", "expiration")


def _metric(
    df: DataFrame,
    kind: str | Column,
    value: Column,
    *,
    ts: Column,
    symbol: Column | None = None,
    strike: Column | None = None,
    expiration: Column | None = None,
    extra: Column | None = None,
) -> DataFrame:
    return df.select(
        ts.alias("ts"),
        (F.col("symbol") if symbol is None else symbol).alias("symbol"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("metric_type"),
        (F.lit(0.0) if strike is None else strike).cast("double").alias("strike"),
        (F.lit(NO_EXPIRY) if expiration is None else expiration).cast("date").alias("expiration"),
        ts.alias("computed_at"),
        value.cast("double").alias("value"),
        (F.lit(None).cast("string") if extra is None else F.to_json(extra)).alias("extra"),
    )


def _listed(rows: Column) -> Column:
    return F.array_sort(F.collect_list(rows))


def _exposure_metrics(strikes, zero, *, ts, keys) -> list[DataFrame]:
    """Totals and levels of the four curves, kept together in one long table of strikes."""
    keys = list(keys)
    by_snapshot = Window.partitionBy(*keys)
    whole = strikes.withColumns(
        {f"_held_{w}": F.sum(f"gross_{w}").over(by_snapshot) for w in ("oi", "volume")}
    )

    def gamma(weight: str, tail: str) -> Column:
        net = exposure.net_gex(weight)
        listed = (F.col(f"_held_{weight}") > 0) & (F.col("listed") > 0)
        level = F.to_json(
            F.struct(
                "strike",
                F.col(f"call_gex_{weight}").alias("call_gex"),
                F.col(f"put_gex_{weight}").alias("put_gex"),
                net.alias("net_gex"),
            )
        )
        return F.struct(
            F.lit(f"GEX_NET_TOTAL{tail}").alias("total_type"),
            F.lit(f"GEX_LEVEL{tail}").alias("level_type"),
            F.lit(weight).alias("weight"),
            F.when(listed & F.col("underlying_price").isNotNull(), net).alias("value"),
            level.alias("level"),
        )

    def greek(name: str) -> Column:
        value = F.col(f"{name}_oi")
        return F.struct(
            F.lit(f"{name.upper()}_NET_TOTAL").alias("total_type"),
            F.lit(f"{name.upper()}_LEVEL").alias("level_type"),
            F.lit("oi").alias("weight"),
            value.alias("value"),
            F.to_json(F.struct("strike", value.alias(f"{name}_exposure"))).alias("level"),
        )

    curves = F.array(gamma("oi", ""), gamma("volume", "_VOL"), greek("vanna"), greek("charm"))
    long = whole.select(*keys, "underlying_price", "strike", F.inline(curves))
    levels = long.where(F.col("value").isNotNull())

    family = [*keys, "total_type"]
    by_family = Window.partitionBy(*family)
    ranked = long.withColumns(
        {
            "_high": F.row_number().over(by_family.orderBy(F.desc_nulls_last("value"), "strike")),
            "_low": F.row_number().over(by_family.orderBy(F.asc_nulls_last("value"), "strike")),
        }
    )
    present = F.col("value").isNotNull()

    def top(rank: str) -> Column:
        entry = F.struct(F.col(rank).alias("rank"), F.col("strike"), F.col("value"))
        return _listed(F.when(present & (F.col(rank) <= TOP_LEVELS), entry))

    totals = ranked.groupBy(*family, "weight").agg(
        F.max("underlying_price").alias("underlying_price"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("net_total"),
        _listed(F.when(present, F.struct("strike", "level"))).alias("_levels"),
        top("_high").alias("top_positive"),
        top("_low").alias("top_negative"),
    )
    kind = F.when(F.col("weight") == "oi", "GEX_NET_TOTAL").otherwise("GEX_NET_TOTAL_VOL")
    zero = zero.withColumn("total_type", kind)
    summary = totals.join(zero.drop("weight"), family, "left")
    points = F.from_json(
        F.concat(F.lit("["), F.array_join("_levels.level", ","), F.lit("]")), F.lit("array<variant>")
    )
    return [
        _metric(
            summary, F.col("total_type"), F.col("net_total"), ts=ts,
            extra=F.struct("underlying_price", points.alias("curve"), "top_positive",
                           "top_negative", "zero_gamma", F.col("weight").alias("weight_col")),
        ),
        _metric(
            levels, F.col("level_type"), F.col("value"), ts=ts, strike=F.col("strike"),
            extra=F.from_json("level", F.lit("map<string,double>")),
        ),
    ]


def chain_metrics(
    chain: DataFrame,
    *,
    as_of,
    ts: Column | None = None,
    rate: float = 0.05,
    opens: DataFrame | None = None,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """All chain metrics of all snapshots as long rows.

    ``chain`` is an enriched snapshot (spot, vol and greeks filled). Many branches read it,
    so callers persist it first; the strike table under the exposures is persisted here.
    """
    keys = list(keys)
    branch_by_branch(chain.sparkSession)
    if ts is None:
        ts = F.col("snapshot_ts") if "snapshot_ts" in keys else instant(as_of)
    chain = with_spot(chain, keys)
    strikes = exposure.strike_exposures(chain, as_of=as_of, rate=rate, keys=keys).persist()
    zero = exposure.zero_gamma(
        chain, as_of=as_of, weights=("oi", "volume"), rate=rate, keys=keys
    )
    rows = _exposure_metrics(strikes, zero, ts=ts, keys=keys)

    pains = positioning.max_pain_curve(chain, keys)
    expiry = [*keys, "expiration"]
    best = pains.groupBy(*expiry).agg(
        F.min(F.struct("pain", "strike")).alias("_best"),
        _listed(F.struct("strike", "pain")).alias("curve"),
    )
    rows.append(
        _metric(
            best, "MAX_PAIN", F.col("_best.pain"), ts=ts, strike=F.col("_best.strike"),
            expiration=F.col("expiration"), extra=F.struct("curve"),
        )
    )
    rows.append(
        _metric(
            positioning.max_pain_aggregate(chain, keys=keys), "MAX_PAIN_AGG", F.col("pain"),
            ts=ts, strike=F.col("strike"), extra=F.struct(F.lit(5).alias("window_expiries")),
        )
    )

    side = F.when(F.col("option_type") == "C", "CALL_WALL_").otherwise("PUT_WALL_")
    by = F.when(F.col("weight") == "oi", "OI").otherwise("VOL")
    rows.append(
        _metric(
            positioning.walls_of(strikes, keys=keys), F.concat(side, by), F.col("value"), ts=ts,
            strike=F.col("strike"), extra=F.struct("rank"),
        )
    )

    rows.append(
        _metric(
            vol.atm_iv(chain, keys).where(F.col("atm_iv").isNotNull()), "ATM_IV",
            F.col("atm_iv"), ts=ts,
        )
    )
    rows.append(
        _metric(vol.iv_skew(chain, keys), "IV_SKEW", F.col("skew"), ts=ts,
                expiration=F.col("expiration"))
    )
    points = F.struct("expiration", "strike", "option_type", "iv", "delta")
    surface = vol.iv_surface(chain, keys).groupBy(*keys).agg(_listed(points).alias("surface"))
    rows.append(
        _metric(surface, "IV_SURFACE", F.lit(None), ts=ts, extra=F.struct("surface"))
    )

    mode = F.when(F.col("weight") == "oi", "REGIME_OI").otherwise("REGIME_VOL")
    rows.append(
        _metric(
            positioning.regime_of(strikes, keys=keys), mode, F.col("score"), ts=ts,
            extra=F.struct("label", "call_wall_total", "put_wall_total", "net_gex"),
        )
    )

    term = vol.term_structure(chain, as_of=as_of, keys=keys)
    shape = ["days_to_expiry", "atm_iv", "call_25d_iv", "put_25d_iv", "risk_reversal_25d"]
    legs = F.to_json(F.struct("call_25d_iv", "put_25d_iv"))
    both = F.array(
        F.struct(
            F.lit("IV_TERM_STRUCTURE").alias("kind"),
            F.col("atm_iv").alias("value"),
            F.to_json(F.struct("expiration", *shape)).alias("extra"),
        ),
        F.struct(
            F.lit("RISK_REVERSAL_25D").alias("kind"),
            F.col("risk_reversal_25d").alias("value"),
            legs.alias("extra"),
        ),
    )
    split = term.select(*keys, "expiration", F.inline(both)).where(
        (F.col("kind") == "IV_TERM_STRUCTURE") | F.col("value").isNotNull()
    )
    rows.append(
        _metric(split, F.col("kind"), F.col("value"), ts=ts, expiration=F.col("expiration"),
                extra=F.from_json("extra", F.lit("map<string,variant>")))
    )

    moves = vol.move_tracker(chain, as_of=as_of, opens=opens, keys=keys)
    known = F.col("realized_move").isNotNull() | F.col("implied_move").isNotNull()
    rows.append(
        _metric(
            moves.where(known), "MOVE_TRACKER", F.col("ratio"), ts=ts,
            extra=F.struct("underlying_price", "open_price", "realized_move", "implied_move",
                           "implied_dte", "ratio"),
        )
    )
    pins = positioning.pin_probability(chain, as_of=as_of, rate=rate, keys=keys)
    rows.append(
        _metric(pins, "PIN_PROBABILITY", F.col("prob"), ts=ts, strike=F.col("strike"),
                extra=F.struct("strike", "prob", "oi", "abs_charm", "atm_iv"))
    )
    return reduce(DataFrame.unionByName, rows)


def flow_metrics(
    trades: DataFrame,
    ticks: DataFrame,
    underlying: DataFrame,
    *,
    as_of,
    bucket: str = "1 minute",
    root: str = "ES",
    bin_size: float = 0.25,
) -> DataFrame:
    """HIRO per symbol, basis of every symbol against one root, and that root's profile.

    ``trades`` and ``ticks`` cover the analysis window; ``underlying`` holds the newest
    ``underlying_price`` per symbol.
    """
    ts = instant(as_of)
    series = flow.hiro(trades, bucket=bucket)
    step = F.struct("ts", "call_premium", "put_premium", "net_premium", "cumulative")
    hiro = series.groupBy("symbol").agg(_listed(step).alias("series"))
    last = F.element_at("series", -1)["cumulative"]
    tape = profile.futures_tape(ticks, roots=[root])
    price = profile.last_prices(tape).withColumnRenamed("last_price", "futures")
    spots = underlying.select(
        "symbol", F.col("underlying_price").alias("spot"), F.lit(root).alias("symbol_root")
    )
    basis = profile.basis(spots.join(price, "symbol_root"))
    bins = profile.volume_bins(tape, bin_size=bin_size)
    listed = bins.groupBy("symbol_root").agg(
        _listed(F.struct("price", "total", "buy", "sell")).alias("bins")
    )
    shape = profile.value_area(bins).join(listed, "symbol_root")
    return reduce(
        DataFrame.unionByName,
        [
            _metric(hiro, "HIRO", last, ts=ts,
                    extra=F.struct(F.lit(bucket).alias("bucket_size"), F.col("series"),
                                   last.alias("cumulative"))),
            _metric(basis.where(F.col("basis").isNotNull()), "BASIS_SPX_ES", F.col("basis"),
                    ts=ts, extra=F.struct("spot", "futures", "basis", "basis_pct")),
            _metric(shape, "VOLUME_PROFILE_ES", F.col("poc"), ts=ts,
                    symbol=F.col("symbol_root"),
                    extra=F.struct(F.lit(bin_size).alias("bin_size"), F.col("poc"), F.col("vah"),
                                   F.col("val"), F.col("total_volume"), F.col("bins"))),
        ],
    )
