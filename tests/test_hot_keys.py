"""Cutting tapes into slices of time must not change any result."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikelens.operators import alerts, flow, greedy, scan, tape
from strikelens.operators.snapshot import futures_at
from strikelens.sources import demo

DAY_MS = 86_400_000


def _quotes_and_prints(spark, sf_dir):
    records = demo.market_records(spark, sf_dir)
    quotes = records.where("kind = 'quote'").select("instrument_id", "ts", "seq", "bid", "ask")
    prints = records.where("kind = 'trade'").select("instrument_id", "ts", "seq", "price", "size")
    return quotes, prints


def _lee_ready(spark, sf_dir):
    return tape.lee_ready(demo.options_trades(spark, sf_dir))


def _quote_at_trade(spark, sf_dir):
    quotes, prints = _quotes_and_prints(spark, sf_dir)
    return tape.quote_at_trade(prints, quotes)


def _chain_state(spark, sf_dir):
    return tape.chain_state(demo.market_records(spark, sf_dir))


def _sweeps(spark, sf_dir):
    return flow.sweeps(demo.options_trades(spark, sf_dir), window_ms=DAY_MS, min_legs=2)


def _futures_at(spark, sf_dir):
    ticks = demo.futures_ticks(spark, sf_dir)
    snapshots = ticks.select(
        F.date_trunc("hour", "ts").alias("snapshot_ts"), F.lit("SPX").alias("symbol")
    ).distinct()
    return futures_at(snapshots, ticks, window="3 hours")


OPERATORS = [_lee_ready, _quote_at_trade, _chain_state, _sweeps, _futures_at]


@pytest.mark.parametrize("build", OPERATORS, ids=lambda f: f.__name__.strip("_"))
def test_slices_of_any_length_give_the_same_rows(spark, sf_dir, rows, build, monkeypatch):
    found = []
    for seconds, windows in ((10 * 365 * 86_400, 1 << 20), (3_600, 64), (60, 2)):
        spark.conf.set("strikelens.sliceSeconds", str(seconds))
        monkeypatch.setattr(flow, "SLICE_WINDOWS", windows)
        try:
            found.append(rows(build(spark, sf_dir)))
        finally:
            spark.conf.unset("strikelens.sliceSeconds")
    assert found[0] and found[0] == found[1] == found[2]


def test_planning_starts_no_job_of_its_own(spark, sf_dir):
    status = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    try:
        for build in OPERATORS:
            build(spark, sf_dir)._jdf.queryExecution().executedPlan()
        # Reading a table's schema is a job; nothing else is.
        assert len(status.getJobIdsForGroup("planning")) == len(OPERATORS)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_busy_key_is_cut_into_balanced_slices(spark, short_slices):
    # One instrument holds a third of all rows.
    tape_rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("instrument_id"),
        F.timestamp_seconds("id").alias("ts"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 7 == 0, F.col("id").cast("double")).alias("x"),
    )
    cut = scan.with_slices(tape_rows, ["ts", "seq"])
    busy = cut.where("instrument_id = 0")
    sizes = [r["count"] for r in busy.groupBy(scan.SLICE).count().collect()]
    assert sum(sizes) == 300 and len(sizes) > 8 and max(sizes) < 60
    known = scan.last_known(cut, {"last_x": F.col("x")}, ["instrument_id"], ["ts", "seq"])
    total = scan.running_total(cut, {"n": F.lit(1)}, ["instrument_id"], ["ts", "seq"])
    wrong = "instrument_id = 0 AND NOT (last_x <=> CAST(21 * floor(seq / 21) AS DOUBLE))"
    assert known.where(wrong).count() == 0
    assert total.where("instrument_id = 0 AND n <> seq / 3 + 1").count() == 0


def test_dense_one_sided_tape_sweeps_like_the_walk(spark, monkeypatch):
    """One contract, one side, no gap above the window: one chain over many slices."""
    monkeypatch.setattr(flow, "SLICE_WINDOWS", 2)
    step_us, window_us, n = 20_000, 100_000, 1500
    tape_rows = spark.range(n).select(
        F.lit("SPXW").alias("symbol"),
        F.lit("2024-01-05").cast("date").alias("expiration"),
        F.lit(5800.0).alias("strike"),
        F.lit("C").alias("option_type"),
        F.timestamp_micros(F.col("id") * step_us).alias("ts"),
        F.col("id").alias("seq"),
        F.lit(1).alias("side"),
        (F.col("id") + 1).alias("size"),
        F.lit(2.0).alias("price"),
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("exchange"),
    )
    found = flow.sweeps(tape_rows).orderBy("ts").collect()
    legs = window_us // step_us + 1
    assert [r["size"] for r in found] == [
        sum(range(i + 1, i + legs + 1)) for i in range(0, n, legs)
    ]
    assert {r.price for r in found} == {2.0}


def _walk(prints, window_us, min_legs, min_venues):
    """Sweeps one print after another, straight from the definition."""
    out, at = [], 0
    while at < len(prints):
        end = at + 1
        while end < len(prints) and prints[end][1] == prints[at][1] and prints[end][0] - prints[at][0] <= window_us:
            end += 1
        venues = {p[2] for p in prints[at:end] if p[2] >= 0}
        if prints[at][1] and end - at >= min_legs and len(venues) >= min_venues:
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def test_sweep_arrays_equal_the_walk():
    rng = np.random.default_rng(11)
    for _ in range(300):
        n = int(rng.integers(0, 60))
        us = np.sort(rng.integers(0, 400, n))
        side, venue = rng.integers(-1, 2, n), rng.integers(-1, 4, n)
        side = np.repeat(side, 3)[:n]
        legs, venues = int(rng.integers(1, 4)), int(rng.integers(1, 4))
        following, hit = flow.greedy_sweeps(us, side, venue, 50, legs, venues)
        starts, _ = greedy.walked(following, hit, 0, n)
        assert [(i, int(following[i])) for i in starts] == _walk(list(zip(us, side, venue)), 50, legs, venues)


def test_cooldown_equals_the_walk(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows_ = []
    for rule, pause, last in (("a", 300, None), ("b", 0, None), ("c", 45, dt.datetime(2024, 1, 1, 0, 30))):
        for s in sorted(set(rng.integers(0, 86_400, 400).tolist())):
            rows_.append((dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), "SPXW", rule, ["x"], pause, last, "{}"))
    want = []
    for rule in "abc":
        kept = None
        for r in (r for r in rows_ if r[2] == rule):
            kept = kept or r[5]
            if kept is None or r[0] >= kept + dt.timedelta(seconds=r[4]):
                want.append((rule, r[0]))
                kept = r[0]
    schema = "snapshot_ts timestamp, symbol string, rule_id string, matched array<string>, cooldown_seconds int, last_fired_at timestamp, payload string"
    fired = spark.createDataFrame(rows_, schema).repartition(4)
    for pauses in (1 << 20, 64, 2):
        monkeypatch.setattr(alerts, "SLICE_PAUSES", pauses)
        found = sorted((r.rule_id, r.snapshot_ts) for r in alerts.apply_cooldown(fired).collect())
        assert found == sorted(want)
    assert alerts.apply_cooldown(fired.limit(0)).count() == 0


def test_many_slices_come_in_few_calls(spark, sf_dir):
    """A call for each slice, and one task that put the slices of all keys in order, took most of the time."""
    plan = _sweeps(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMap" not in plan and plan.count("MapInArrow") == 3


def test_runs_go_on_over_batches():
    import pyarrow as pa

    values = [None, None, "a", "a", "a", "b", "c", "c"]
    for size in range(1, 9):
        table = pa.table({"k": pa.array(values), "n": range(8)})
        found = [t["n"].to_pylist() for t in greedy.runs(iter(table.to_batches(size)), ["k"])]
        assert found == [[0, 1], [2, 3, 4], [5], [6, 7]]
