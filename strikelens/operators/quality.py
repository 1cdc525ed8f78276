"""Freshness, row counts and coverage reports over the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from strikelens.functions.columns import (
    coverage_band,
    coverage_pct,
    instant,
    lag_band,
    lag_seconds,
)

CHAIN_FIELDS = (
    "bid", "ask", "last_price", "iv", "delta", "gamma", "oi", "volume", "underlying_price",
)


def table_freshness(tables: dict[str, tuple[DataFrame, str]], *, now) -> DataFrame:
    """Rows, newest timestamp and lag of each table, given as ``{name: (table, column)}``."""
    parts = [
        df.agg(
            F.lit(name).alias("name"),
            F.count(F.lit(1)).alias("rows"),
            F.max(F.col(column).cast("timestamp")).alias("latest_ts"),
        )
        for name, (df, column) in tables.items()
    ]
    together = reduce(DataFrame.unionByName, parts)
    lagged = together.withColumn("lag_seconds", lag_seconds(F.col("latest_ts"), now))
    return lagged.withColumn("lag_band", lag_band(F.col("lag_seconds")))


def metric_breakdown(metrics: DataFrame, *, now) -> DataFrame:
    return metrics.groupBy("metric_type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    ).withColumn("lag_seconds", lag_seconds(F.col("last_seen"), now))


def chain_quality(chain: DataFrame, *, now, window: str = "1 hour") -> DataFrame:
    """Share of filled values per symbol over the last hour, or over all rows if it is empty.

    Both ranges come from one pass: each count is taken twice and the right one is picked.
    """
    recent = F.col("ts") > instant(now) - F.expr(f"INTERVAL {window}")
    counts = [
        F.count_if(recent).alias("_recent"),
        F.count(F.lit(1)).alias("_all"),
        F.max("ts").alias("latest_ts"),
    ]
    for field in CHAIN_FIELDS:
        counts.append(F.count(F.when(recent, F.col(field))).alias(f"_recent_{field}"))
        counts.append(F.count(field).alias(f"_all_{field}"))
    in_hour = F.col("_recent") > 0

    def pick(name: str):
        return F.when(in_hour, F.col(f"_recent{name}")).otherwise(F.col(f"_all{name}"))

    report = chain.groupBy("symbol").agg(*counts)
    return report.select(
        "symbol",
        pick("").alias("rows_last_hour"),
        "latest_ts",
        lag_seconds(F.col("latest_ts"), now).alias("lag_seconds"),
        *(coverage_pct(pick(f"_{f}"), pick("")).alias(f) for f in CHAIN_FIELDS),
    )


def coverage_bands(quality: DataFrame) -> DataFrame:
    return quality.withColumns({f"{f}_band": coverage_band(F.col(f)) for f in CHAIN_FIELDS})


def health_alarm(quality: DataFrame) -> DataFrame:
    """One row: true when some symbol has no gamma at all or no underlying price at all."""
    dark = (F.col("gamma") == 0) | (F.col("underlying_price") == 0)
    return quality.agg(F.coalesce(F.bool_or(dark), F.lit(False)).alias("alarm"))


def rule_counts(rules: DataFrame) -> DataFrame:
    return rules.agg(
        F.count(F.lit(1)).alias("rules_total"), F.count_if("enabled").alias("rules_enabled")
    )
