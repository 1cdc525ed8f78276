"""Queries over the metric table, the event tables and the chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelens.operators import quality

# The metric types shown by the inspector, in its order.
INSPECTED_TYPES = (
    "GEX_NET_TOTAL_VOL", "GEX_NET_TOTAL", "VANNA_NET_TOTAL", "CHARM_NET_TOTAL", "MAX_PAIN",
    "ATM_IV", "MOVE_TRACKER", "REGIME_VOL", "REGIME_OI", "HIRO", "BASIS_SPX_ES",
    "VOLUME_PROFILE_ES",
)


def latest_rows(metrics: DataFrame, *types: str, symbol: str | None = None) -> DataFrame:
    """All rows at the newest timestamp of each symbol and metric type.

    The rank limit works inside each task first, so only the newest rows are shuffled.
    """
    scope = metrics.where(F.col("metric_type").isin(*types)) if types else metrics
    if symbol is not None:
        scope = scope.where(F.col("symbol") == symbol.upper())
    newest = Window.partitionBy("symbol", "metric_type").orderBy(F.desc("ts"))
    return scope.withColumn("_age", F.rank().over(newest)).where(F.col("_age") == 1).drop("_age")


def latest_metrics(metrics: DataFrame, types: tuple[str, ...] = INSPECTED_TYPES) -> DataFrame:
    """One newest row per symbol and metric type; the lowest expiry and strike of that time."""
    order = Window.partitionBy("symbol", "metric_type").orderBy("expiration", "strike")
    return (
        latest_rows(metrics, *types)
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") == 1)
        .drop("_rn")
    )


def extra_field(path: str, kind: str = "string") -> Column:
    return F.get_json_object("extra", f"$.{path}").try_cast(kind)


def gex(metrics: DataFrame, *, mode: str = "oi", symbol: str | None = None) -> DataFrame:
    """Newest gamma total with its curve, top levels and zero-gamma level as JSON fields."""
    kind = {"oi": "GEX_NET_TOTAL", "volume": "GEX_NET_TOTAL_VOL"}[mode]
    return latest_rows(metrics, kind, symbol=symbol).select(
        "symbol",
        F.col("ts").alias("computed_at"),
        F.coalesce("value", F.lit(0.0)).alias("net_total"),
        extra_field("underlying_price", "double").alias("underlying_price"),
        extra_field("zero_gamma", "double").alias("zero_gamma"),
        extra_field("curve").alias("curve"),
        extra_field("top_positive").alias("top_positive"),
        extra_field("top_negative").alias("top_negative"),
    )


def max_pain(
    metrics: DataFrame, *, expiry: str = "nearest", symbol: str | None = None
) -> DataFrame:
    """Newest max pain: the nearest expiry, all of them, or one given date."""
    rows = latest_rows(metrics, "MAX_PAIN", symbol=symbol).select(
        "symbol", F.col("ts").alias("computed_at"), "expiration", "strike",
        F.coalesce("value", F.lit(0.0)).alias("pain"),
    )
    if expiry == "all":
        return rows
    if expiry != "nearest":
        return rows.where(F.col("expiration") == F.lit(expiry).cast("date"))
    order = Window.partitionBy("symbol").orderBy("expiration", "strike")
    return rows.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def max_pain_aggregate(metrics: DataFrame, *, symbol: str | None = None) -> DataFrame:
    return latest_rows(metrics, "MAX_PAIN_AGG", symbol=symbol).select(
        "symbol", F.col("ts").alias("computed_at"), "strike",
        F.coalesce("value", F.lit(0.0)).alias("pain"),
    )


def walls(metrics: DataFrame, *, mode: str = "both", symbol: str | None = None) -> DataFrame:
    """Newest ranked walls by open interest, by volume, or both."""
    tails = {"oi": ["OI"], "volume": ["VOL"], "both": ["OI", "VOL"]}[mode]
    kinds = [f"{side}_WALL_{tail}" for side in ("CALL", "PUT") for tail in tails]
    return latest_rows(metrics, *kinds, symbol=symbol).select(
        "symbol", F.col("ts").alias("computed_at"), "metric_type",
        extra_field("rank", "int").alias("rank"), "strike",
        F.coalesce("value", F.lit(0.0)).alias("value"),
    )


def iv(metrics: DataFrame, *, symbol: str | None = None) -> DataFrame:
    """Newest at-the-money vol, skew per expiry as a map, and the surface as JSON."""
    kind = F.col("metric_type")
    skews = F.collect_list(
        F.when(kind == "IV_SKEW", F.struct(F.col("expiration").cast("string"), F.col("value")))
    )
    return latest_rows(metrics, "ATM_IV", "IV_SKEW", "IV_SURFACE", symbol=symbol).groupBy(
        "symbol"
    ).agg(
        F.max("ts").alias("computed_at"),
        F.max(F.when(kind == "ATM_IV", F.col("value"))).alias("atm_iv"),
        F.map_from_entries(F.array_sort(skews)).alias("skew_per_expiry"),
        F.max(F.when(kind == "IV_SURFACE", extra_field("surface"))).alias("surface"),
    )


def snapshot(metrics: DataFrame, *, symbol: str | None = None) -> DataFrame:
    """The whole dashboard of a symbol in one row, from one pass over the newest rows."""
    kind = F.col("metric_type")

    def one(metric: str, value: Column) -> Column:
        return F.max(F.when(kind == metric, value))

    def many(prefix: str, row: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(kind.startswith(prefix), row)))

    def block(metric: str) -> Column:
        return F.struct(
            F.coalesce(one(metric, F.col("value")), F.lit(0.0)).alias("net_total"),
            one(metric, extra_field("underlying_price", "double")).alias("underlying_price"),
            one(metric, extra_field("zero_gamma", "double")).alias("zero_gamma"),
            one(metric, extra_field("curve")).alias("curve"),
            one(metric, extra_field("top_positive")).alias("top_positive"),
            one(metric, extra_field("top_negative")).alias("top_negative"),
        )

    def mode(metric: str) -> Column:
        return F.struct(
            one(metric, F.col("value")).alias("score"),
            one(metric, extra_field("label")).alias("label"),
            one(metric, extra_field("call_wall_total", "double")).alias("call_wall_total"),
            one(metric, extra_field("put_wall_total", "double")).alias("put_wall_total"),
            one(metric, extra_field("net_gex", "double")).alias("net_gex"),
        )

    types = [
        "GEX_NET_TOTAL", "GEX_NET_TOTAL_VOL", "MAX_PAIN", "MAX_PAIN_AGG", "CALL_WALL_OI",
        "PUT_WALL_OI", "CALL_WALL_VOL", "PUT_WALL_VOL", "ATM_IV", "IV_SKEW", "IV_SURFACE",
        "REGIME_OI", "REGIME_VOL",
    ]
    wall = F.struct(
        kind.alias("wall"), extra_field("rank", "int").alias("rank"), F.col("strike"), F.col("value")
    )
    is_wall = kind.contains("_WALL_")
    pain = F.struct("expiration", "strike", F.col("value").alias("pain"))
    dashboard = latest_rows(metrics, *types, symbol=symbol).groupBy("symbol").agg(
        F.max("ts").alias("computed_at"),
        block("GEX_NET_TOTAL").alias("gex"),
        block("GEX_NET_TOTAL_VOL").alias("gex_volume"),
        F.array_sort(F.collect_list(F.when(kind == "MAX_PAIN", pain))).alias("max_pain"),
        one("MAX_PAIN_AGG", F.struct("strike", F.col("value").alias("pain"))).alias("max_pain_aggregate"),
        F.array_sort(F.collect_list(F.when(is_wall, wall))).alias("walls"),
        one("ATM_IV", F.col("value")).alias("atm_iv"),
        many("IV_SKEW", F.struct("expiration", F.col("value").alias("skew"))).alias("skew"),
        one("IV_SURFACE", extra_field("surface")).alias("surface"),
        mode("REGIME_OI").alias("regime_oi"),
        mode("REGIME_VOL").alias("regime_vol"),
    )
    return dashboard.withColumn(
        "zero_gamma",
        F.struct(
            F.col("gex.zero_gamma").alias("oi"),
            F.col("gex_volume.zero_gamma").alias("volume"),
            F.coalesce("gex_volume.underlying_price", "gex.underlying_price").alias(
                "underlying_price"
            ),
        ),
    )


def latest_term_structure(metrics: DataFrame) -> DataFrame:
    """Term structure at its newest timestamp over all symbols."""
    rows = metrics.where(F.col("metric_type") == "IV_TERM_STRUCTURE")
    newest = rows.agg(F.max("ts").alias("ts"))
    return rows.join(newest, "ts", "left_semi").select(
        "symbol", "expiration",
        extra_field("days_to_expiry", "int").alias("days_to_expiry"),
        F.col("value").alias("atm_iv"),
        extra_field("call_25d_iv", "double").alias("call_25d_iv"),
        extra_field("put_25d_iv", "double").alias("put_25d_iv"),
        extra_field("risk_reversal_25d", "double").alias("risk_reversal_25d"),
    )


def top_pins(metrics: DataFrame, n: int = 15) -> DataFrame:
    """The likeliest pin strikes at the newest timestamp."""
    rows = metrics.where(F.col("metric_type") == "PIN_PROBABILITY")
    newest = rows.agg(F.max("ts").alias("ts"))
    return (
        rows.join(newest, "ts", "left_semi")
        .select(
            "symbol", "strike", F.col("value").alias("probability"),
            extra_field("oi", "bigint").alias("oi"),
            extra_field("abs_charm", "double").alias("abs_charm"),
            extra_field("atm_iv", "double").alias("atm_iv"),
        )
        .orderBy(F.desc("probability"), "symbol", "strike")
        .limit(n)
    )


def recent_events(events: DataFrame, n: int = 50, tie: str = "event_id") -> DataFrame:
    return events.orderBy(F.desc("ts"), tie).limit(n)


def recent_alerts(alerts: DataFrame, n: int = 20) -> DataFrame:
    return alerts.orderBy(F.desc("ts"), "rule_id").limit(n)


def inspector(
    freshness: DataFrame, metrics: DataFrame, coverage: DataFrame, rules: DataFrame, fired: DataFrame, *, now, n_alerts: int = 20
) -> DataFrame:
    """Everything an operator looks at first, as (``section``, ``name``, ``value``) rows of one job.

    ``freshness`` and ``coverage`` come from :mod:`strikelens.operators.quality`; tables and rule
    counts are a few rows, and of alerts and pins only the newest or likeliest are taken.
    """
    def rows(df: DataFrame, section: str, name: Column, value: Column) -> DataFrame:
        return df.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))

    counts = quality.rule_counts(rules)
    alerts = recent_alerts(fired.withColumn("ts", F.col("snapshot_ts")), n_alerts)
    shown = F.concat_ws(" ", "rule_id", "symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    pins = top_pins(metrics)
    parts = [
        rows(freshness, "table lag", F.col("name"), F.col("lag_seconds")),
        rows(quality.metric_breakdown(metrics, now=now), "metric rows", F.col("metric_type"), F.col("rows")),
        rows(counts, "rules", F.lit("total"), F.col("rules_total")),
        rows(counts, "rules", F.lit("enabled"), F.col("rules_enabled")),
        rows(alerts, "recent alert", shown, F.lit(None)),
        rows(pins, "pin", F.concat_ws(" ", "symbol", F.col("strike").cast("int")), F.col("probability")),
        *(rows(coverage, f"{field} pct", F.col("symbol"), F.col(field)) for field in quality.CHAIN_FIELDS),
    ]
    return reduce(DataFrame.unionByName, parts)


def system_status(chain: DataFrame, metrics: DataFrame) -> DataFrame:
    """Chain rows, metric rows and newest computation per symbol."""
    chain_rows = chain.groupBy("symbol").agg(F.count(F.lit(1)).alias("chain_rows"))
    metric_rows = metrics.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("metric_rows"), F.max("computed_at").alias("last_compute")
    )
    return chain_rows.join(metric_rows, "symbol", "full").na.fill(0, ["chain_rows", "metric_rows"])
