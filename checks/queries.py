"""The registered queries: one per operator, over whole tables, with their oracle SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from checks import oracle
from strikelens.functions import greeks
from strikelens.functions.columns import is_call, number, year_fraction
from strikelens.operators import alerts, exposure, flow, positioning, profile, quality, tape, vol
from strikelens.operators.snapshot import (
    basis_carry,
    fill_open_interest,
    futures_at,
    last_basis,
    latest_snapshot,
    latest_underlying,
    parity_spot,
    resolve_spot,
    snapshot_health,
    snapshot_series,
    watched,
    with_spot,
)
from strikelens.plans import metrics as metric_plans
from strikelens.plans import serving
from strikelens.plans.pipeline import enriched_snapshot, run_chain_pipeline
from strikelens.sources import demo, records, sinks, tables
from strikelens.streaming import alerts as alert_streams, late, stateful, windows
from strikelens.streaming.runner import ROCKSDB, Feed, drain, drain_batches, drain_closed, shared_folder

AS_OF = demo.AS_OF
HISTORY = ("snapshot_ts", "symbol")
HISTORY_STEP, HISTORY_LOOKBACK = "30 days", "60 days"

DAY_MS = 86_400_000

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

def present(df: DataFrame, columns: str) -> DataFrame:
    """The output columns in the formats of :func:`checks.oracle.select`."""
    out = []
    for spec in columns.split():
        name, _, kind = spec.partition(":")
        value = F.col(name)
        if kind == "d":
            value = F.date_format(name, "yyyy-MM-dd")
        elif kind == "t":
            value = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "n":
            value = value.cast("double")
        elif kind:
            value = F.round(value.cast("double"), int(kind)) + 0.0
        elif isinstance(df.schema[name].dataType, T.ArrayType):
            value = F.array_join(value, ",")
        out.append(value.alias(name))
    return df.select(*out)

def register(name: str, columns: str, source: str | None = None, where: str = "", tail: str = ""):
    def add(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(build(spark, sf_dir), columns)
        if source is not None:
            ORACLE[name] = oracle.select(columns, source, where, tail)
        return build

    return add

# Inputs shared by the queries.

def _snapshot(spark, sf) -> DataFrame:
    chain = demo.options_chain(spark, sf)
    return latest_snapshot(chain, as_of=AS_OF, lookback=None)

def _filled(spark, sf) -> DataFrame:
    return fill_open_interest(_snapshot(spark, sf), demo.eod_open_interest(spark, sf))

def _chain(spark, sf) -> DataFrame:
    return with_spot(vol.fill_greeks(_filled(spark, sf), as_of=AS_OF))

def _history(spark, sf) -> DataFrame:
    chain = demo.options_chain(spark, sf)
    series = snapshot_series(chain, every=HISTORY_STEP, lookback=HISTORY_LOOKBACK)
    series = fill_open_interest(series, demo.eod_open_interest(spark, sf))
    return with_spot(vol.fill_greeks(series, as_of=F.col("snapshot_ts")), HISTORY)

def _opens(spark, sf) -> DataFrame:
    prices = demo.options_chain(spark, sf).select(
        "symbol", "ts", (F.col("underlying_price") + 5).alias("price")
    )
    return vol.session_open(prices)

def _metrics(spark, sf) -> DataFrame:
    return metric_plans.chain_metrics(_chain(spark, sf).persist(), as_of=AS_OF)

def _history_metrics(spark, sf) -> DataFrame:
    history = _history(spark, sf).persist()
    return metric_plans.chain_metrics(history, as_of=F.col("snapshot_ts"), keys=HISTORY)

# Snapshots.

LEG = "symbol expiration:d strike option_type"
STORED_LEG = LEG.replace("strike", "strike:2")  # a decimal at rest

@register("latest_snapshot", f"{LEG} ts:t oi:n volume iv:6 bid:6 ask:6 last_price:6 underlying_price", "snap")
def latest(spark, sf):
    return _snapshot(spark, sf)

@register("latest_snapshot_recent", f"{LEG} ts:t oi:n volume iv:6", "live")
def latest_recent(spark, sf):
    return latest_snapshot(demo.options_chain(spark, sf), as_of=AS_OF, lookback="400 days")

@register("snapshot_series", f"snapshot_ts:t {LEG} ts:t oi:n volume iv:6", "daily")
def series(spark, sf):
    return snapshot_series(demo.options_chain(spark, sf), every="1 day")

@register("snapshot_series_monthly", f"snapshot_ts:t {LEG} ts:t oi:n volume iv:6", "hist")
def series_monthly(spark, sf):
    chain = demo.options_chain(spark, sf)
    return snapshot_series(chain, every=HISTORY_STEP, lookback=HISTORY_LOOKBACK)

@register("eod_oi_fill", f"{LEG} oi", "filled")
def eod_fill(spark, sf):
    return _filled(spark, sf)

@register("implied_greeks", f"{LEG} gamma:9 delta:7", "greeks")
def implied_greeks(spark, sf):
    return vol.fill_greeks(_filled(spark, sf), as_of=AS_OF)

@register("chain_spot", "symbol spot", "spots")
def chain_spot(spark, sf):
    return _chain(spark, sf).groupBy("symbol").agg(F.max("spot").alias("spot"))

@register("parity_spot", "symbol parity_spot:6", "parity")
def parity(spark, sf):
    return parity_spot(_snapshot(spark, sf), as_of=AS_OF)

@register("futures_at_snapshot", "symbol snapshot_ts:t futures_price:6", "fut_at")
def futures_at_hours(spark, sf):
    return futures_at(_hours(spark, sf), demo.futures_ticks(spark, sf), window="2 hours")

def _hours(spark, sf):
    hours = demo.table(spark, sf, "events").select(
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("snapshot_ts")
    ).distinct()
    symbols = F.explode(F.array(*(F.lit(s) for s in demo.SYMBOLS)))
    return hours.withColumn("symbol", symbols)

@register("basis_carry", "symbol snapshot_ts:t futures_price:6 parity_spot:6 basis:6 resolved_spot:6", "carried")
def carry(spark, sf):
    priced = futures_at_hours(spark, sf)
    even = F.hour("snapshot_ts") % 2 == 0
    implied = F.col("futures_price") - 3 - F.dayofmonth("snapshot_ts")
    return basis_carry(priced.withColumn("parity_spot", F.when(even, implied)))

@register("resolve_spot", f"{LEG} underlying_price:6", "resolved")
def resolved(spark, sf):
    dark = F.when(F.col("symbol") != "RUTW", F.col("underlying_price"))
    blind = _snapshot(spark, sf).withColumn("underlying_price", dark)
    return resolve_spot(blind, as_of=AS_OF, keys=("symbol",))

@register("snapshot_health", "symbol rows have_bid have_iv have_gamma no_underlying low_greek_coverage", "health")
def health(spark, sf):
    return snapshot_health(_chain(spark, sf))

# Exposure.

@register("gex_curve", "symbol underlying_price strike call_gex:2 put_gex:2 net_gex:2", "gex_oi")
def gex_curve(spark, sf):
    return exposure.gex_curve(_chain(spark, sf))

@register("gex_curve_volume", "symbol underlying_price strike call_gex:2 put_gex:2 net_gex:2", "gex_volume")
def gex_curve_volume(spark, sf):
    return exposure.gex_curve(_chain(spark, sf), weight="volume")

@register("gex_total", "symbol underlying_price net_total:2 gross_total:2", "gex_totals", "weight='oi'")
def gex_total(spark, sf):
    return exposure.gex_totals(_chain(spark, sf))

@register("gex_top_levels", "symbol side rank strike net_gex:2", "gex_tops")
def gex_tops(spark, sf):
    return exposure.top_levels(exposure.gex_curve(_chain(spark, sf)), "net_gex")

@register("vanna_curve", "symbol underlying_price strike vanna_exposure:2", "vanna")
def vanna(spark, sf):
    return exposure.vanna_curve(_chain(spark, sf), as_of=AS_OF)

@register("vanna_top_levels", "symbol side rank strike vanna_exposure:2", "vanna_tops")
def vanna_tops(spark, sf):
    return exposure.top_levels(vanna(spark, sf), "vanna_exposure")

@register("charm_curve", "symbol underlying_price strike charm_exposure:2", "charm")
def charm(spark, sf):
    return exposure.charm_curve(_chain(spark, sf), as_of=AS_OF)

@register("zero_gamma", "symbol weight zero_gamma:5", "zero_both")
def zero_gamma(spark, sf):
    return exposure.zero_gamma(_chain(spark, sf), as_of=AS_OF, weights=("oi", "volume"))


@register("gex_history", "snapshot_ts:t symbol underlying_price net_total:2 gross_total:2", "hist_gex")
def gex_history(spark, sf):
    return exposure.gex_totals(_history(spark, sf), keys=HISTORY)

@register("zero_gamma_history", "snapshot_ts:t symbol zero_gamma:5", "hist_zero")
def zero_history(spark, sf):
    return exposure.zero_gamma(_history(spark, sf), as_of=F.col("snapshot_ts"), keys=HISTORY)

# Positioning.

@register("max_pain_curve", "symbol expiration:d strike pain:2", "pain_curve")
def pain_curve(spark, sf):
    return positioning.max_pain_curve(_chain(spark, sf))

@register("max_pain", "symbol expiration:d strike pain:2", "pain_best")
def max_pain(spark, sf):
    return positioning.max_pain(_chain(spark, sf))

@register("max_pain_agg", "symbol strike pain:2", "pain_agg")
def max_pain_agg(spark, sf):
    return positioning.max_pain_aggregate(_chain(spark, sf))

@register("max_pain_history", "snapshot_ts:t symbol expiration:d strike pain:2", "hist_pain")
def max_pain_history(spark, sf):
    return positioning.max_pain(_history(spark, sf), HISTORY)

@register("walls", "symbol weight option_type rank strike value", "wall_ranks")
def walls(spark, sf):
    return positioning.walls(_chain(spark, sf))

@register("regime", "symbol weight score:6 label call_wall_total put_wall_total net_gex:2", "regimes")
def regime(spark, sf):
    return positioning.regime(_chain(spark, sf))

@register("pin_probability", "symbol strike prob:9 oi abs_charm:6 atm_iv:6", "pins")
def pins(spark, sf):
    return positioning.pin_probability(_chain(spark, sf), as_of=AS_OF)

# Vol.

@register("atm_iv", "symbol atm_iv:6", "atm")
def atm(spark, sf):
    return vol.atm_iv(_chain(spark, sf))

@register("iv_skew", "symbol expiration:d skew:6", "skews")
def skew(spark, sf):
    return vol.iv_skew(_chain(spark, sf))

@register("iv_surface", f"{LEG} iv:6 delta:7", "g", "iv IS NOT NULL")
def surface(spark, sf):
    return vol.iv_surface(_chain(spark, sf))

@register(
    "term_structure",
    "symbol expiration:d days_to_expiry atm_iv:6 call_25d_iv:6 put_25d_iv:6 risk_reversal_25d:6",
    "terms",
)
def terms(spark, sf):
    return vol.term_structure(_chain(spark, sf), as_of=AS_OF)

@register(
    "move_tracker",
    "symbol underlying_price open_price realized_move:6 implied_move:6 implied_dte ratio:6",
    "moves",
)
def moves(spark, sf):
    return vol.move_tracker(_chain(spark, sf), as_of=AS_OF, opens=_opens(spark, sf))

@register("iv_fill", f"{LEG} iv:5", "solved")
def iv_fill(spark, sf):
    return vol.fill_iv(_filled(spark, sf), as_of=AS_OF)

@register("option_price", f"{LEG} iv:6 bs_price:6 bs_vega:6", "priced")
def option_price(spark, sf):
    chain = _filled(spark, sf).withColumn("tau", year_fraction(AS_OF))
    valued = greeks.with_price(
        chain, spot="underlying_price", strike="strike", tau="tau", sigma="iv", r=0.05, call=is_call()
    )
    inputs = [F.col(c) for c in ("underlying_price", "strike", "tau", "iv")]
    return valued.withColumn("bs_vega", greeks.vega(*inputs, 0.05))

# Option tape.


def _contracts(spark, sf):
    """Contracts of two of the three underlyings, so that some records find none."""
    return records.option_contracts(demo.definition_records(spark, sf), ["SPXW", "NDXP"])

def _quotes_and_prints(spark, sf):
    records = demo.market_records(spark, sf)
    quotes = records.where("kind = 'quote'").select("instrument_id", "ts", "seq", "bid", "ask")
    prints = records.where("kind = 'trade'").select("instrument_id", "ts", "seq", "price", "size")
    return quotes, prints

@register("quote_at_trade", "instrument_id ts:t seq price size bid:6 ask:6", "quoted")
def quote_at_trade(spark, sf):
    quotes, prints = _quotes_and_prints(spark, sf)
    return tape.quote_at_trade(prints, quotes)

@register("quote_at_trade_ties", "instrument_id ts:t seq price size bid:6 ask:6", "quoted_ties")
def quote_at_trade_ties(spark, sf):
    quotes, prints = (df.withColumn("ts", F.date_trunc("hour", "ts")) for df in _quotes_and_prints(spark, sf))
    return tape.quote_at_trade(prints, quotes)

@register("trade_tape", "instrument_id ts:t seq side:n signed_premium:2", "sided")
def trade_tape(spark, sf):
    return tape.trade_tape(quote_at_trade(spark, sf))

@register("contract_lookup", f"instrument_id seq kind {LEG}", "looked_up")
def contract_lookup(spark, sf):
    return tape.with_contract(demo.market_records(spark, sf), _contracts(spark, sf))

def _versions(spark, sf):
    return records.option_versions(demo.definition_records(spark, sf), ["SPXW", "NDXP"])

@register("contract_versions", f"instrument_id ts:t seq kind {LEG}", "defined_then")
def contract_versions(spark, sf):
    """Strikes move mid-tape: a record has the strike of its time, not the newest one."""
    return tape.with_contract_at(demo.market_records(spark, sf), _versions(spark, sf))

@register("futures_versions", "instrument_id ts:t seq symbol expiration:d parent", "futures_then")
def futures_versions(spark, sf):
    versions = records.futures_versions(demo.definition_records(spark, sf))
    return tape.with_contract_at(demo.market_records(spark, sf), versions, columns=records.FUTURE)

@register("unmatched_records", "kind unmatched", "misses")
def unmatched(spark, sf):
    return tape.unmatched(demo.market_records(spark, sf), _contracts(spark, sf))

RECORD_KINDS = ("trade", "quote", "open_interest", "cumulative_volume")

@register("observed_unmatched", "kind unmatched", "misses")
def observed_unmatched(spark, sf):
    """The same numbers out of the pass that writes the matched records."""
    seen = Observation("unmatched")
    _kept(spark, tape.matched(demo.market_records(spark, sf), _contracts(spark, sf), seen, RECORD_KINDS))
    rows = [(kind, n) for kind, n in seen.get.items() if n]
    return spark.createDataFrame(rows, "kind string, unmatched bigint")

@register("observed_health", "rows have_bid have_iv have_gamma", "whole_health")
def observed_health(spark, sf):
    seen = Observation("health")
    _kept(spark, watched(_chain(spark, sf), seen))
    counts = {name: int(n) for name, n in seen.get.items()}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{name} bigint" for name in counts))

@register("chain_state", "instrument_id ts:t seq kind bid:6 ask:6 last_price:6 oi:n volume:n", "state")
def chain_state(spark, sf):
    return tape.chain_state(demo.market_records(spark, sf))

@register("lee_ready", "instrument_id ts:t seq mid:6 side signed_qty", "lr")
def lee_ready(spark, sf):
    return tape.lee_ready(demo.options_trades(spark, sf))

# Flow.

EVENT = f"event_type ts:t {LEG} side size price:6 legs venues"

@register("blocks", EVENT, "block_events")
def blocks(spark, sf):
    return flow.blocks(demo.options_trades(spark, sf), min_size=90)

@register("uoa", EVENT, "unusual")
def uoa(spark, sf):
    return flow.unusual_volume(demo.options_trades(spark, sf), min_volume=2000)

@register("uoa_vs_average", f"event_type ts:t {LEG} size legs", "unusual_adv")
def uoa_average(spark, sf):
    trades = demo.options_trades(spark, sf)
    averages = trades.where(F.col("option_type") == "C").groupBy(
        "symbol", "expiration", "strike", "option_type"
    ).agg((F.avg("size") * 20).alias("avg_daily_volume"))
    return flow.unusual_volume(trades, daily_average=averages, multiplier=3.0, min_volume=4000)

@register("sweeps", EVENT, "sweep_events")
def sweeps(spark, sf):
    return flow.sweeps(demo.options_trades(spark, sf), window_ms=DAY_MS, min_legs=2)

@register("flow_events", EVENT, "all_events")
def flow_events(spark, sf):
    return flow.flow_events(
        demo.options_trades(spark, sf),
        sweep={"window_ms": DAY_MS, "min_legs": 2},
        block_min_size=90,
        unusual={"min_volume": 2000},
    )

@register("recent_flow_events", EVENT, "all_events", "", "ORDER BY all_events.ts DESC LIMIT 50")
def recent_flow_events(spark, sf):
    return serving.recent_events(flow_events(spark, sf))

@register("premium_buckets", "symbol ts:t call_premium:2 put_premium:2", "premiums")
def premium_buckets(spark, sf):
    return flow.premium_buckets(demo.options_trades(spark, sf), bucket="1 hour")

@register("hiro", "symbol ts:t call_premium:2 put_premium:2 net_premium:2 cumulative:2", "hiro")
def hiro(spark, sf):
    return flow.hiro(demo.options_trades(spark, sf), bucket="1 hour")

# Futures.

def _futures(spark, sf):
    return profile.futures_tape(demo.futures_ticks(spark, sf))

@register("futures_tape", "symbol_root ts:t symbol seq price:6 size side:n", "rooted")
def futures_tape(spark, sf):
    return _futures(spark, sf)

@register("volume_profile", "symbol_root price total buy sell", "bins")
def volume_profile(spark, sf):
    return profile.volume_bins(_futures(spark, sf))

@register("value_area", "symbol_root poc vah val total_volume", "area")
def value_area(spark, sf):
    return profile.value_area(volume_profile(spark, sf))

@register("futures_last", "symbol_root last_price:6", "last_ticks")
def futures_last(spark, sf):
    return profile.last_prices(_futures(spark, sf))

@register("latest_underlying", "symbol underlying_price ts:t", "newest_underlying")
def newest_underlying(spark, sf):
    return latest_underlying(demo.options_chain(spark, sf))

@register("basis", "symbol spot futures:6 basis:6 basis_pct:9", "bases")
def basis(spark, sf):
    price = futures_last(spark, sf).where(F.col("symbol_root") == "ES")
    spots = newest_underlying(spark, sf).select(
        "symbol", F.col("underlying_price").alias("spot"), F.lit("ES").alias("symbol_root")
    )
    return profile.basis(
        spots.join(price.withColumnRenamed("last_price", "futures"), "symbol_root")
    )

# Metrics and serving.

METRIC = "symbol metric_type strike expiration:d value:4"

@register("metrics_long", METRIC, "metrics")
def metrics_long(spark, sf):
    return _metrics(spark, sf)

@register("chain_pipeline", "symbol metric_type strike expiration:d shown", None)
def chain_pipeline(spark, sf):
    """Snapshot, open interest, spot, solved vols and greeks, then every chain metric."""
    rows = run_chain_pipeline(
        demo.options_chain(spark, sf), demo.eod_open_interest(spark, sf), as_of=AS_OF, lookback=None
    )
    # A little off the value, so that no exact half meets two rules of rounding.
    value = F.col("value").cast("double") * 1.0000003 + 0.0
    return rows.withColumn("shown", F.when(value.isNotNull(), F.format_string("%.4e", value)))

ORACLE["chain_pipeline"] = oracle.select(
    "symbol metric_type strike expiration:d shown",
    f"(SELECT *, CASE WHEN value IS NOT NULL THEN printf('%.4e', value*1.0000003::DOUBLE + 0.0) END AS shown FROM {oracle.PIPELINE_METRICS})",
    needs=oracle.PIPELINE_METRICS,
)

@register("flow_metrics", "symbol metric_type value:2", "flow_metric_rows")
def flow_metrics(spark, sf):
    return metric_plans.flow_metrics(
        demo.options_trades(spark, sf),
        demo.futures_ticks(spark, sf),
        newest_underlying(spark, sf),
        as_of="2024-02-01 00:00:00",
        bucket="1 hour",
    )

@register("latest_metrics", METRIC, "latest_metric_rows")
def latest_metrics(spark, sf):
    return serving.latest_metrics(_metrics(spark, sf))

@register("latest_rows_history", f"ts:t {METRIC}", "hist_latest")
def latest_rows_history(spark, sf):
    kinds = ("GEX_NET_TOTAL", "ATM_IV", "MAX_PAIN")
    return serving.latest_rows(_history_metrics(spark, sf), *kinds)

@register("serve_gex", "symbol net_total:2 underlying_price zero_gamma:5", "served_gex")
def serve_gex(spark, sf):
    return serving.gex(_metrics(spark, sf), mode="volume")

@register("serve_max_pain", "symbol expiration:d strike pain:2", "nearest_pain")
def serve_max_pain(spark, sf):
    return serving.max_pain(_metrics(spark, sf))

@register("serve_walls", "symbol metric_type rank strike value", "served_walls")
def serve_walls(spark, sf):
    return serving.walls(_metrics(spark, sf), mode="oi")

@register("serve_iv", "symbol atm_iv:6 expiration skew:6", "served_iv")
def serve_iv(spark, sf):
    shown = serving.iv(_metrics(spark, sf))
    return shown.select("symbol", "atm_iv", F.explode("skew_per_expiry").alias("expiration", "skew"))

@register(
    "serve_snapshot",
    "symbol net_total:2 net_total_volume:2 zero_oi:5 zero_volume:5 underlying_price expiries walls "
    "pain_strike atm_iv:6 regime_oi:6 regime_vol:6 label_oi",
    "dashboard",
)
def serve_snapshot(spark, sf):
    shown = serving.snapshot(_metrics(spark, sf))
    return shown.select(
        "symbol",
        F.col("gex.net_total").alias("net_total"),
        F.col("gex_volume.net_total").alias("net_total_volume"),
        F.col("zero_gamma.oi").alias("zero_oi"),
        F.col("zero_gamma.volume").alias("zero_volume"),
        F.col("zero_gamma.underlying_price").alias("underlying_price"),
        F.size("max_pain").alias("expiries"),
        F.size("walls").alias("walls"),
        F.col("max_pain_aggregate.strike").alias("pain_strike"),
        "atm_iv",
        F.col("regime_oi.score").alias("regime_oi"),
        F.col("regime_vol.score").alias("regime_vol"),
        F.col("regime_oi.label").alias("label_oi"),
    )

@register(
    "serve_term_structure",
    "symbol expiration:d days_to_expiry atm_iv:6 call_25d_iv:6 put_25d_iv:6 risk_reversal_25d:6",
    "terms",
)
def serve_terms(spark, sf):
    return serving.latest_term_structure(_metrics(spark, sf))

@register("top_pins", "symbol strike probability:9 oi atm_iv:6", "best_pins")
def top_pins(spark, sf):
    return serving.top_pins(_metrics(spark, sf))

@register("metric_breakdown", "metric_type rows", "breakdown")
def metric_breakdown(spark, sf):
    return quality.metric_breakdown(_metrics(spark, sf), now=AS_OF)

LEVEL = "array<struct<rank:int,strike:double,value:double,call_gex:double,put_gex:double,net_gex:double>>"

@register("serve_gex_curve", "symbol strike call_gex:2 put_gex:2 net_gex:2", "gex_oi", "net_gex IS NOT NULL")
def serve_gex_curve(spark, sf):
    shown = serving.gex(_metrics(spark, sf), mode="oi")
    return shown.select("symbol", F.inline(F.from_json("curve", LEVEL)))

@register("serve_gex_tops", "symbol side rank strike value:2", "served_tops")
def serve_gex_tops(spark, sf):
    shown = serving.gex(_metrics(spark, sf), mode="oi")
    sides = [
        shown.select("symbol", F.lit(side).alias("side"), F.inline(F.from_json(f"top_{side}", LEVEL)))
        for side in ("positive", "negative")
    ]
    return sides[0].unionByName(sides[1])

@register("serve_iv_surface", f"symbol expiration strike option_type iv:6 delta:6", "served_surface")
def serve_iv_surface(spark, sf):
    point = "array<struct<expiration:string,strike:double,option_type:string,iv:double,delta:double>>"
    shown = serving.iv(_metrics(spark, sf))
    return shown.select("symbol", F.inline(F.from_json("surface", point)))

@register("serve_snapshot_lists", "symbol part name strike:2 value:4", "dashboard_lists")
def serve_snapshot_lists(spark, sf):
    """The lists of the dashboard, entry by entry."""
    shown = serving.snapshot(_metrics(spark, sf))
    day = F.date_format("expiration", "yyyy-MM-dd")
    parts = {
        "max_pain": (day, F.col("strike"), F.col("pain")),
        "walls": (F.concat_ws(" ", "wall", "rank"), F.col("strike"), F.col("value")),
        "skew": (day, F.lit(0.0), F.col("skew")),
    }
    rows = [
        shown.select("symbol", F.inline(part)).select(
            "symbol", F.lit(part).alias("part"), name.alias("name"), strike.cast("double").alias("strike"), value.cast("double").alias("value")
        )
        for part, (name, strike, value) in parts.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])

@register("metric_extras", "symbol metric_type expiration:d strike field value:4", "extras")
def metric_extras(spark, sf):
    """Every number beside the value of a metric, whatever its type, out of the stored JSON."""
    fields = F.from_json("extra", F.lit("map<string,variant>"))
    rows = _metrics(spark, sf).where(F.col("extra").isNotNull()).select(
        "symbol", "metric_type", "expiration", "strike", F.explode(fields).alias("field", "entry")
    )
    value = F.try_variant_get("entry", F.lit("$"), "double")
    numbers = rows.withColumn("value", value).where(F.schema_of_variant("entry").rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"))
    return numbers.where(F.col("value").isNotNull())

@register("flow_extras", "symbol metric_type place:t price:2 first:2 second:2 total:2", "flow_lists")
def flow_extras(spark, sf):
    """The series of HIRO and the bins of the profile, entry by entry, with the numbers of the basis."""
    rows = flow_metrics(spark, sf)
    lit = lambda kind: F.lit(None).cast(kind)
    step = "array<struct<ts:timestamp,call_premium:double,put_premium:double,net_premium:double,cumulative:double>>"
    bin_ = "array<struct<price:double,total:double,buy:double,sell:double>>"
    columns = ["symbol", "metric_type"]
    hiro_rows = rows.where("metric_type = 'HIRO'").select(*columns, F.inline(F.from_json(F.get_json_object("extra", "$.series"), step)))
    bins = rows.where("metric_type = 'VOLUME_PROFILE_ES'").select(*columns, F.inline(F.from_json(F.get_json_object("extra", "$.bins"), bin_)))
    number = lambda name: F.get_json_object("extra", f"$.{name}").cast("double")
    bases = rows.where("metric_type = 'BASIS_SPX_ES'")
    parts = [
        hiro_rows.select(*columns, F.col("ts").alias("place"), lit("double").alias("price"), F.col("call_premium").alias("first"),
                         F.col("put_premium").alias("second"), F.col("cumulative").alias("total")),
        bins.select(*columns, lit("timestamp").alias("place"), "price", F.col("buy").alias("first"), F.col("sell").alias("second"), "total"),
        bases.select(*columns, lit("timestamp").alias("place"), lit("double").alias("price"), number("spot").alias("first"),
                     number("futures").alias("second"), number("basis").alias("total")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])

@register("metric_store", METRIC.replace("strike", "strike:2"), "metrics")
def metric_store(spark, sf):
    """Two computations of one time; the second one is stored twice and counts."""
    path, found = shared_folder(spark), _metrics(spark, sf)
    sinks.append_metrics(found.withColumn("value", F.col("value") + 1), path, 0)
    for _ in range(2):
        sinks.append_metrics(found, path, 1)
    nothing = F.lit("1970-01-01").cast("date")
    return sinks.read_metrics(spark, path, first=nothing, last=F.lit(AS_OF))

@register("inspector", "section name value:4", "inspected")
def inspector(spark, sf):
    metrics = _metrics(spark, sf)
    fired = _fired(spark, sf)
    return serving.inspector(
        table_freshness(spark, sf), metrics, chain_quality(spark, sf), _rules(spark), fired, now=AS_OF
    )

@register("basis_memory", "symbol snapshot_ts:t basis:6", "last_bases")
def basis_memory(spark, sf):
    """What a history of snapshots leaves for the next live one."""
    priced = futures_at_hours(spark, sf)
    even = F.hour("snapshot_ts") % 2 == 0
    implied = F.col("futures_price") - 3 - F.dayofmonth("snapshot_ts")
    return last_basis(priced.withColumn("parity_spot", F.when(even, implied)))

@register("basis_live", "symbol underlying_price:6", "live_bases")
def basis_live(spark, sf):
    """A live snapshot without prices takes its spot from the futures and the remembered basis."""
    chain = _snapshot(spark, sf).withColumns(
        {c: F.lit(None).cast("double") for c in ("underlying_price", "bid", "ask", "last_price")}
    )
    futures = chain.select("symbol").distinct().withColumn("futures_price", F.lit(5000.0))
    filled = enriched_snapshot(
        chain, None, as_of=AS_OF, lookback=None, futures=futures, basis=basis_memory(spark, sf)
    )
    return filled.groupBy("symbol").agg(F.max("underlying_price").alias("underlying_price"))

@register("text_numbers", "event_id shown:6", "parsed")
def text_numbers(spark, sf):
    """Prices that come as text: what is no number, or not a number, is missing."""
    turn = F.col("event_id") % 6
    written = F.col("value").cast("string")
    text = F.when(turn == 0, F.concat(F.lit(" "), written, F.lit(" "))).when(turn == 1, "NaN").when(turn == 2, "n/a")
    text = text.when(turn == 3, "").when(turn == 4, F.concat(written, F.lit("e0"))).otherwise(written)
    return demo.table(spark, sf, "events").withColumn("price", text).select("event_id", number("price").alias("shown"))

@register("system_status", "symbol chain_rows metric_rows", "status")
def system_status(spark, sf):
    return serving.system_status(demo.options_chain(spark, sf), _metrics(spark, sf))

# Quality.

@register("table_freshness", "name rows latest_ts:t lag_seconds:6 lag_band", "freshness")
def table_freshness(spark, sf):
    tables = {
        "options_chain": (demo.options_chain(spark, sf), "ts"),
        "options_trades": (demo.options_trades(spark, sf), "ts"),
        "futures_ticks": (demo.futures_ticks(spark, sf), "ts"),
        "eod_open_interest": (demo.eod_open_interest(spark, sf), "oi_date"),
        "computed_metrics": (_metrics(spark, sf), "ts"),
        "flow_events": (flow_events(spark, sf), "ts"),
        "liquidity_snapshots": (records.books(demo.book_records(spark, sf)), "ts"),
        "alert_events": (_fired(spark, sf), "snapshot_ts"),
    }
    return quality.table_freshness(tables, now=AS_OF)

QUALITY = (
    "symbol rows_last_hour latest_ts:t bid:1 ask:1 last_price:1 iv:1 delta:1 gamma:1 oi:1 volume:1 "
    "underlying_price:1"
)

def _quality(spark, sf, now, window):
    chain = vol.known_greeks(demo.options_chain(spark, sf), as_of=AS_OF)
    return quality.chain_quality(chain, now=now, window=window)

@register("chain_quality", QUALITY, "quality_all")
def chain_quality(spark, sf):
    return _quality(spark, sf, AS_OF, "1 hour")

@register("chain_quality_recent", f"{QUALITY} iv_band oi_band", "quality_banded")
def chain_quality_recent(spark, sf):
    return quality.coverage_bands(_quality(spark, sf, "2001-06-01", "900 days"))

@register("health_alarm", "alarm", "alarms")
def health_alarm(spark, sf):
    return quality.health_alarm(_quality(spark, sf, AS_OF, "1 hour"))

# Alerts.

def _rules(spark):
    rules = demo.alert_rules()
    enabled = {rule["id"]: rule["enabled"] for rule in rules}
    return alerts.rule_table(spark, rules).withColumn(
        "enabled", F.col("id").isin([name for name, on in enabled.items() if on])
    )

def _fired(spark, sf):
    payloads = alerts.payload_history(_history_metrics(spark, sf)).persist()
    return alerts.evaluate_rules(payloads, alerts.load_rules(_rules(spark)))

@register("alert_payloads", "rule_id symbol snapshot_ts:t atm_iv:6 net_total:2 has_curve", "fired_payloads")
def alert_payloads(spark, sf):
    """What an alert carries: the numbers of its snapshot, long lists cut out."""
    payload = F.parse_json("payload")
    at = lambda path, kind: F.try_variant_get(payload, path, kind)
    return _fired(spark, sf).select(
        "rule_id", "symbol", "snapshot_ts",
        at("$.ATM_IV.value", "double").alias("atm_iv"), at("$.GEX_NET_TOTAL.value", "double").alias("net_total"),
        at("$.GEX_NET_TOTAL.curve", "string").isNotNull().alias("has_curve"),
    )

@register("alerts_fired", "rule_id symbol snapshot_ts:t matched", "fired_listed")
def alerts_fired(spark, sf):
    return _fired(spark, sf).withColumn("matched", F.array_join("matched", ";"))

@register("alert_cooldown", "rule_id symbol snapshot_ts:t", "cooled")
def alert_cooldown(spark, sf):
    return alerts.apply_cooldown(_fired(spark, sf).withColumn("cooldown_seconds", F.lit(200 * 86400)))


# Vendor records.


@register("option_trade_records", "instrument_id ts:t seq price:6 size exchange", "raw_prints")
def option_trade_records(spark, sf):
    return records.option_trades(demo.trade_records(spark, sf))


@register("option_quote_records", "instrument_id ts:t seq bid:6 ask:6", "raw_quotes")
def option_quote_records(spark, sf):
    return records.option_quotes(demo.book_records(spark, sf))


@register("statistic_records", "instrument_id ts:t seq kind quantity", "raw_statistics")
def statistic_records(spark, sf):
    return records.statistics(demo.statistic_records(spark, sf))


@register("ingest_chain", "instrument_id ts:t seq kind bid:6 ask:6 last_price:6 oi:n volume:n", "ingested")
def ingest_chain(spark, sf):
    """The whole ingest: vendor prints, quotes and statistics to chain rows."""
    together = records.chain_records(
        option_trade_records(spark, sf), option_quote_records(spark, sf), statistic_records(spark, sf)
    )
    return tape.chain_state(together)


@register("option_registry", f"instrument_id {LEG}", "registry")
def option_registry(spark, sf):
    return _contracts(spark, sf)


@register("futures_registry", "instrument_id symbol expiration:d parent", "futures_names")
def futures_registry(spark, sf):
    return records.futures_contracts(demo.definition_records(spark, sf))


@register("book_levels", "instrument_id ts:t seq bid:6 ask:6 depth_levels n_asks bid_size top_orders", "raw_books")
def book_levels(spark, sf):
    books = records.books(demo.book_records(spark, sf))
    total = F.aggregate("bids", F.lit(0).cast("bigint"), lambda acc, level: acc + level["size"])
    return books.withColumns(
        {
            "n_asks": F.size("asks"),
            "bid_size": total,
            "top_orders": F.element_at("asks", 1)["orders"],
        }
    )


@register("futures_trades", "symbol ts:t seq price:6 size aggressor:n bid:6 ask:6 venue", "raw_futures")
def futures_trades(spark, sf):
    prints = records.futures_trades(demo.trade_records(spark, sf, "click"))
    books = records.books(demo.book_records(spark, sf)).select(
        "instrument_id", "ts", "seq", "bid", "ask"
    )
    named = tape.with_contract(prints, futures_registry(spark, sf).select("instrument_id", "symbol"))
    return tape.quote_at_trade(named, books)


@register("chain_stubs", f"ts:t {LEG} oi:n iv:6", "stubs")
def chain_stubs(spark, sf):
    return records.chain_stubs(demo.listing_records(spark, sf), as_of=AS_OF)


@register("eod_oi_load", f"{LEG} open_interest oi_date:d", "eod_loaded")
def eod_oi_load(spark, sf):
    return records.eod_open_interest(demo.listing_records(spark, sf), as_of=AS_OF)


@register("eod_oi_upsert", f"{LEG} open_interest", "eod_upserted")
def eod_oi_upsert(spark, sf):
    stored = demo.eod_open_interest(spark, sf).withColumn(
        "updated_at", F.lit("2001-12-31").cast("timestamp")
    )
    return sinks.upsert_open_interest(stored, eod_oi_load(spark, sf).select(*stored.columns))


@register("merge_dedupe", f"{LEG} ts:t oi:n iv:6 bid:6 volume", "merged")
def merge_dedupe(spark, sf):
    chain = demo.options_chain(spark, sf)
    return sinks.merge_rows(chain, ["symbol", "expiration", "strike", "option_type"], ["ts"])


@register("retention", f"{LEG} ts:t volume", "young")
def retention(spark, sf):
    return sinks.retained(demo.options_chain(spark, sf), "options_chain", as_of="2000-06-01")


# Streams over the events table.


@register("stream_premium_buckets", "symbol ts:t call_premium:2 put_premium:2", "premiums")
def stream_premium_buckets(spark, sf):
    trades = demo.options_trades(spark, sf, stream=True)
    hours = lambda t: windows.premium_buckets(t, bucket="1 hour")
    return drain_closed(trades, hours, hold="2 hours", side=1, size=0, price=0.0)


@register("stream_blocks", EVENT, "block_events")
def stream_blocks(spark, sf):
    return drain(windows.blocks(demo.options_trades(spark, sf, stream=True), min_size=90))


@register("stream_chain_state", "instrument_id ts:t seq kind bid:6 ask:6 last_price:6 oi:n volume:n", "state")
def stream_chain_state(spark, sf):
    return drain(stateful.chain_rows(demo.market_records(spark, sf, stream=True)))


@register("stream_books", "symbol sampled_at:t ts:t depth_levels", "hour_books")
def stream_books(spark, sf):
    books = records.books(demo.book_records(spark, sf, stream=True)).withColumn(
        "symbol", demo.label(F.col("instrument_id"))
    )
    return drain_closed(books, lambda b: windows.sampled_books(b, every="1 hour"), hold="2 hours")


@register("stream_sweeps", f"ts:t {LEG} side size price:6 legs venues", "sweep_events")
def stream_sweeps(spark, sf):
    trades = demo.options_trades(spark, sf, stream=True)
    return drain_closed(trades, lambda t: stateful.sweeps(t, window_ms=DAY_MS, min_legs=2), hold="2 days")


# Stored tables: what the sinks write is read back by the scans.


def _stored(spark, df, table, **options):
    path = shared_folder(spark)
    tables.write_table(df, path, table, **options)
    return path


@register("scan_chain", f"ts:t {LEG} oi:n bid:6", "scanned_chain")
def scan_chain(spark, sf):
    path = _stored(spark, demo.options_chain(spark, sf), "options_chain")
    columns = ["ts", "symbol", "expiration", "strike", "option_type", "oi", "bid"]
    return tables.read_table(
        spark, path, "options_chain", start="1996-03-01 00:00:00", end="1996-03-20 12:00:00",
        symbols=["spxw", "RUTW"], columns=columns,
    )


@register("scan_trades", f"ts:t {LEG} seq price:6 size side:n", "scanned_trades")
def scan_trades(spark, sf):
    path = _stored(spark, demo.options_trades(spark, sf), "options_trades")
    return tables.read_table(
        spark, path, "options_trades", start="2024-01-05 00:00:00", end="2024-01-20 12:00:00", symbols=["NDXP"]
    )


@register("scan_futures", "symbol_root ts:t symbol seq price:6 size", "outrights")
def scan_futures(spark, sf):
    return profile.futures_tape(
        demo.futures_ticks(spark, sf), start="2024-01-05 00:00:00", end="2024-01-20 00:00:00", outrights_only=True
    )


@register("retention_drop", "day:d rows", "left_days")
def retention_drop(spark, sf):
    path = _stored(spark, demo.options_trades(spark, sf), "options_trades")
    sinks.drop_expired(spark, path, "options_trades", as_of=dt.date(2024, 1, 25))
    return spark.read.parquet(path).groupBy(F.col("dt").alias("day")).agg(F.count("*").alias("rows"))


@register("sink_round_trip", f"ts:t {STORED_LEG} oi:n volume iv:6 bid:6 last_price:6", "sunk")
def sink_round_trip(spark, sf):
    """Rows of one key within a batch and across two; one batch runs twice."""
    chain = demo.options_chain(spark, sf).withColumns(
        {"arrival": F.unix_micros("ts"), "ts": F.date_trunc("month", "ts")}
    )
    path = shared_folder(spark)
    write = sinks.batch_sink(path, "options_chain", order=["arrival"])
    for batch in (0, 1, 1):
        write(chain.where(F.col("volume") % 2 == batch), batch)
    return sinks.read_merged(spark, path, "options_chain")


@register("flow_event_store", f"event_id ts:t {STORED_LEG} side size price:6", "stored_events")
def flow_event_store(spark, sf):
    """Prints that share a time are told apart, and finding them again stores nothing."""
    trades = demo.options_trades(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    found = flow.with_event_id(flow.blocks(trades, min_size=90))
    path = shared_folder(spark)
    for _ in range(2):
        sinks.append_new_events(found, path)
    return spark.read.parquet(path)


def _edges(df, pieces=4, at="ts"):
    """Times that cut a table into pieces of about one size. On a large table they may differ from call to call."""
    shares = ", ".join(str(k / pieces) for k in range(1, pieces))
    return df.select(F.unix_micros(at).alias("us")).selectExpr(f"percentile_approx(us, array({shares}))").first()[0]


def _in_time(df, pieces=4, at="ts", edges=None):
    """A table cut into pieces by a time, the earliest first."""
    us = F.unix_micros(at)
    bounds = [None, *(_edges(df, pieces, at) if edges is None else edges), None]
    for low, high in zip(bounds, bounds[1:]):
        piece = df if low is None else df.where(us >= low)
        yield piece if high is None else piece.where(us < high)


def _fed(spark, df, build, at="ts", **options):
    """What a stream makes of a table that comes in pieces, started anew for each."""
    feed = Feed(spark, df.schema)
    return drain(build(feed.stream), steps=[lambda p=p: feed.put(p) for p in _in_time(df, at=at)], **options)


CHAIN_STATE = "instrument_id seq kind bid:6 ask:6 last_price:6 oi:n volume:n"


@register("stream_chain_state_gaps", CHAIN_STATE, "state")
def stream_chain_state_gaps(spark, sf):
    """Several micro-batches, with days between the records of an instrument."""
    slow = F.timestamp_micros(F.unix_micros("ts") * 30 - F.lit(29 * 1_704_067_200_000_000))
    rows = demo.market_records(spark, sf).withColumn("ts", slow)
    return _fed(spark, rows, stateful.chain_rows)


@register("stream_chain_state_resumed", CHAIN_STATE, "state")
def stream_chain_state_resumed(spark, sf):
    """A second stream without the first one's checkpoint, started from the chain that it stored."""
    first, second = _in_time(demo.market_records(spark, sf), pieces=2)
    feeds = [Feed(spark, first.schema) for _ in range(2)]
    stored = drain(stateful.chain_rows(feeds[0].stream), steps=[lambda: feeds[0].put(first)])
    resumed = stateful.chain_rows(feeds[1].stream, initial=stateful.known_state(stored))
    return stored.unionByName(drain(resumed, steps=[lambda: feeds[1].put(second)], store=ROCKSDB))


@register("stream_trade_tape", "instrument_id ts:t seq price bid:6 ask:6 side:n signed_premium:2", "streamed_tape")
def stream_trade_tape(spark, sf):
    return _fed(spark, demo.market_records(spark, sf), stateful.option_trades)


@register("stream_trade_tape_resumed", "instrument_id ts:t seq bid:6 ask:6 side:n signed_premium:2", "streamed_tape")
def stream_trade_tape_resumed(spark, sf):
    first, second = _in_time(demo.market_records(spark, sf), pieces=2)
    feeds = [Feed(spark, first.schema) for _ in range(2)]
    known = stateful.known_state(drain(stateful.chain_rows(feeds[0].stream), steps=[lambda: feeds[0].put(first)]))
    before = drain(stateful.option_trades(feeds[0].stream))
    after = drain(stateful.option_trades(feeds[1].stream, initial=known), steps=[lambda: feeds[1].put(second)], store=ROCKSDB)
    return before.unionByName(after)


@register("stream_contract_versions", f"instrument_id ts:t seq kind {LEG}", "defined_then")
def stream_contract_versions(spark, sf):
    """Definitions come as a second stream, piece by piece with the records, both cut at the same times."""
    market, versions = demo.market_records(spark, sf), _versions(spark, sf)
    feeds, edges = [Feed(spark, df.schema) for df in (market, versions)], _edges(market)
    pieces = zip(_in_time(market, edges=edges), _in_time(versions, at="defined_at", edges=edges), strict=True)

    def put(both):
        for feed, df in zip(feeds, both, strict=True):
            feed.put(df)

    steps = [lambda both=both: put(both) for both in pieces]
    return drain(stateful.matched_contracts(feeds[0].stream, feeds[1].stream), steps=steps)


@register("stream_late_premiums", "symbol ts:t call_premium:2 put_premium:2", "premiums")
def stream_late_premiums(spark, sf):
    """Every ninth print comes two days late; buckets that it belongs to are told again."""
    trades = demo.options_trades(spark, sf)
    arrival = F.when(F.col("seq") % 9 == 0, F.col("ts") + F.expr("INTERVAL 2 DAYS")).otherwise(F.col("ts"))
    feed, path = Feed(spark, trades.schema), shared_folder(spark)
    write = late.corrected_premiums(path, bucket="1 hour")
    steps = [lambda p=p: feed.put(p) for p in _in_time(trades, pieces=5, at=arrival)]
    drain_batches(feed.stream, write, steps=steps)
    return late.corrected_rows(spark, path, bucket="1 hour", late="2 minutes", ended=True)


@register("stream_alerts", "rule_id symbol snapshot_ts:t matched kept", "streamed_alerts")
def stream_alerts(spark, sf):
    payloads = alerts.payload_history(_history_metrics(spark, sf))
    rules = [{**rule, "cooldown_seconds": 200 * 86400} for rule in demo.alert_rules() if rule["enabled"]]
    at = "snapshot_ts"
    fired = _fed(spark, _kept(spark, payloads), lambda p: alert_streams.alert_stream(p, rules), at=at, store=ROCKSDB)
    return fired.withColumn("matched", F.array_join("matched", ";"))


def _kept(spark, df):
    """A table written once and read again."""
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@register("vendor_files", "status rows size:n", "filed")
def vendor_files(spark, sf):
    """Prints as files of JSON lines, a few of them cut short or with text for a price, read as a stream."""
    prints = demo.trade_records(spark, sf)
    line = F.to_json(F.struct(*prints.columns))
    turn = F.col("sequence") % 50
    line = F.when(turn == 7, F.substring(line, 1, 40)).when(turn == 9, F.regexp_replace(line, '"price":[0-9]+', '"price":"n/a"')).otherwise(line)
    path = shared_folder(spark)
    prints.select(line.alias("value")).repartition(5).write.text(path)
    found = drain(records.read_vendor_files(spark, path, prints.schema, stream=True, maxFilesPerTrigger=2))
    status = F.when(F.col(records.MALFORMED).isNull(), "sound").otherwise("set aside").alias("status")
    size = F.sum(F.when(F.col(records.MALFORMED).isNull(), F.col("size"))).alias("size")
    return found.groupBy(status).agg(F.count("*").alias("rows"), size)


@register("stream_upsert_restart", f"ts:t {STORED_LEG} oi:n volume iv:6 bid:6 last_price:6", "sunk")
def stream_upsert_restart(spark, sf):
    """The second batch is written, but the query dies before it commits, and is started again."""
    chain = demo.options_chain(spark, sf).withColumns(
        {"arrival": F.unix_micros("ts"), "ts": F.date_trunc("month", "ts")}
    )
    feed, path, progress = Feed(spark, chain.schema), shared_folder(spark), shared_folder(spark)
    write, seen = sinks.batch_sink(path, "options_chain", order=["arrival"]), []

    def dying(batch, batch_id):
        write(batch, batch_id)
        seen.append(batch_id)
        if seen == [0, 1]:
            raise RuntimeError("lost between write and commit")

    puts = [lambda p=p: feed.put(chain.where(F.col("volume") % 2 == p)) for p in (0, 1)]
    try:
        drain_batches(feed.stream, dying, steps=puts, progress=progress)
    except StreamingQueryException:
        drain_batches(feed.stream, dying, progress=progress)
    if seen != [0, 1, 1]:
        raise RuntimeError(f"the batches {seen} are not those of a restart")
    return sinks.read_merged(spark, path, "options_chain")


@register("stream_unusual_volume", f"{LEG} window_end:t size legs", "slid")
def stream_unusual_volume(spark, sf):
    trades = demo.options_trades(spark, sf, stream=True)
    volume = lambda t: windows.unusual_volume(t, span="2 days", every="1 day", min_volume=300)
    return drain_closed(trades, volume, hold="3 days")
