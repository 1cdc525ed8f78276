"""From the raw chain and tapes to the metric table, for all symbols in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from strikelens.operators import flow
from strikelens.operators.snapshot import (
    LOOKBACK,
    fill_open_interest,
    latest_snapshot,
    latest_underlying,
    resolve_spot,
    snapshot_series,
    with_spot,
)
from strikelens.operators.vol import fill_iv
from strikelens.plans.metrics import chain_metrics, flow_metrics


def enriched_snapshot(
    chain: DataFrame,
    eod: DataFrame | None,
    *,
    as_of,
    lookback: str | None = LOOKBACK,
    futures: DataFrame | None = None,
    basis: DataFrame | None = None,
    rate: float = 0.05,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Newest row per contract with open interest, spot, vol and greeks filled in.

    ``basis`` is what earlier snapshots left (:func:`strikelens.operators.snapshot.last_basis`).
    """
    snapshot = latest_snapshot(chain, as_of=as_of, lookback=lookback, tiebreak=tiebreak)
    if eod is not None:
        snapshot = fill_open_interest(snapshot, eod)
    snapshot = resolve_spot(snapshot, as_of=as_of, futures=futures, basis=basis, rate=rate, keys=("symbol",))
    return with_spot(fill_iv(snapshot, as_of=as_of, rate=rate))


def enriched_history(
    chain: DataFrame,
    eod: DataFrame | None,
    *,
    every: str,
    futures: DataFrame | None = None,
    rate: float = 0.05,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """:func:`enriched_snapshot` for every time bucket of the chain at once.

    Each snapshot is valued at its own date.
    """
    keys = ("snapshot_ts", "symbol")
    series = snapshot_series(chain, every=every, tiebreak=tiebreak)
    if eod is not None:
        series = fill_open_interest(series, eod)
    valued = F.col("snapshot_ts")
    series = resolve_spot(series, as_of=valued, futures=futures, rate=rate, keys=keys)
    return with_spot(fill_iv(series, as_of=valued, rate=rate), keys)


def run_chain_pipeline(
    chain: DataFrame, eod: DataFrame | None, *, as_of, rate: float = 0.05, **options
) -> DataFrame:
    """All chain metrics of the newest snapshot. The snapshot is persisted for its readers."""
    snapshot = enriched_snapshot(chain, eod, as_of=as_of, rate=rate, **options).persist()
    return chain_metrics(snapshot, as_of=as_of, rate=rate)


def run_history_pipeline(
    chain: DataFrame, eod: DataFrame | None, *, every: str, rate: float = 0.05, **options
) -> DataFrame:
    """All chain metrics of every snapshot in the chain's history."""
    keys = ("snapshot_ts", "symbol")
    history = enriched_history(chain, eod, every=every, rate=rate, **options).persist()
    return chain_metrics(history, as_of=F.col("snapshot_ts"), rate=rate, keys=keys)


def run_flow_pipeline(
    trades: DataFrame,
    ticks: DataFrame,
    chain: DataFrame,
    *,
    as_of,
    window: str = "60 minutes",
    bucket: str = "1 minute",
    **events,
) -> tuple[DataFrame, DataFrame]:
    """Flow events and flow metrics of the trailing window."""
    end = F.lit(str(as_of)).cast("timestamp")
    start = end - F.expr(f"INTERVAL {window}")
    recent = trades.where((F.col("ts") >= start) & (F.col("ts") <= end))
    prints = ticks.where((F.col("ts") >= start) & (F.col("ts") <= end))
    found = flow.flow_events(recent, **events)
    metrics = flow_metrics(
        recent, prints, latest_underlying(chain), as_of=as_of, bucket=bucket
    )
    return found, metrics
