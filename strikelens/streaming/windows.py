"""Streaming operators that Spark's own windows and de-duplication express."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strikelens.functions.columns import CONTRACT
from strikelens.operators import flow


def sampled_books(
    books: DataFrame, *, late: str = "5 seconds", every: str = "1 second"
) -> DataFrame:
    """The last book of each symbol in every interval that had one."""
    newest = F.max_by(
        F.struct("ts", "bids", "asks", "depth_levels"), F.struct("ts", "seq")
    ).alias("_book")
    return (
        books.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", every))
        .agg(newest)
        .select("symbol", F.col("window.start").alias("sampled_at"), "_book.*")
    )


def premium_buckets(
    trades: DataFrame, *, bucket: str = "1 minute", late: str = "2 minutes"
) -> DataFrame:
    """Signed-premium buckets, each emitted once it can no longer change.

    :func:`strikelens.operators.flow.accumulate_buckets` fills gaps and accumulates them.
    """
    return flow.premium_buckets(trades.withWatermark("ts", late), bucket=bucket)


def blocks(trades: DataFrame, *, min_size: int = 100, late: str = "2 minutes") -> DataFrame:
    """Block prints, each reported once even when the feed repeats it."""
    found = flow.with_event_id(flow.blocks(trades, min_size=min_size))
    return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def unusual_volume(
    trades: DataFrame,
    *,
    span: str = "60 minutes",
    every: str = "1 minute",
    min_volume: int = 5000,
    late: str = "2 minutes",
) -> DataFrame:
    """Contracts whose volume in a sliding window reaches the floor.

    ``event_id`` names the contract and the window: a window that is looked at again gives the
    same event.
    """
    size = F.coalesce(F.col("size").cast("bigint"), F.lit(0))
    return (
        trades.withWatermark("ts", late)
        .groupBy(*CONTRACT, F.window("ts", span, every))
        .agg(F.sum(size).alias("size"), F.max("ts").alias("ts"), F.count(F.lit(1)).alias("legs"))
        .where(F.col("size") >= min_volume)
        .select(
            *CONTRACT,
            F.col("window.end").alias("window_end"),
            "ts",
            "size",
            "legs",
            F.sha2(
                F.concat_ws("|", F.lit("UOA"), *CONTRACT, F.unix_micros("window.start")), 256
            ).alias("event_id"),
        )
    )
