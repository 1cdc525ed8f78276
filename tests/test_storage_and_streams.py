"""Sinks, stored tables and streams on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strikelens.operators import flow, tape
from strikelens.plans.pipeline import run_flow_pipeline
from strikelens.schemas import TABLES, to_storage
from strikelens.sources import demo, sinks, tables
from strikelens.streaming import stateful, windows
from strikelens.streaming.alerts import alert_sink
from strikelens.streaming.runner import drain

START = dt.datetime(2024, 1, 2, 14, 30)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def ticks(spark, *rows):
    schema = "ts timestamp, symbol string, seq bigint, price double, size bigint, bid double"
    return spark.createDataFrame(list(rows), schema)


def test_merge_takes_the_newest_filled_value(spark):
    df = ticks(
        spark, (at(0), "ESM6", 1, 1.0, 5, 0.5), (at(1), "ESM6", 1, None, 7, None), (at(0), "ESM6", 2, 9.0, 1, None)
    )
    found = {r.seq: (r.price, r["size"], r.bid) for r in sinks.merge_rows(df, ["symbol", "seq"], ["ts"]).collect()}
    assert found == {1: (1.0, 7, 0.5), 2: (9.0, 1, None)}


def test_batch_sink_is_idempotent_and_later_batches_win(spark, tmp_path):
    path = str(tmp_path / "ticks")
    write = sinks.batch_sink(path, "futures_ticks", order=["arrival"])
    arrived = lambda *rows: ticks(spark, *rows).withColumn("arrival", F.monotonically_increasing_id())
    write(arrived((at(0), "ESM6", 1, 1.0, 5, 0.5)), 0)
    for _ in range(2):
        write(arrived((at(0), "ESM6", 1, 2.0, None, None), (at(1), "ESM6", 2, 3.0, 1, None)), 1)
    assert spark.read.parquet(path).count() == 3
    found = {r.seq: (float(r.price), r["size"]) for r in sinks.read_merged(spark, path, "futures_ticks").collect()}
    assert found == {1: (2.0, 5), 2: (3.0, 1)}


def test_metrics_replace_rows_of_the_same_key(spark, tmp_path):
    path = str(tmp_path / "metrics")
    schema = (
        "ts timestamp, symbol string, metric_type string, strike double, expiration date, "
        "computed_at timestamp, value double, extra string"
    )
    def metric(value, minute=0):
        row = (at(minute), "SPXW", "ATM_IV", 0.0, dt.date(1970, 1, 1), at(minute), value, None)
        return spark.createDataFrame([row], schema)
    sinks.append_metrics(metric(0.1), path, 0)
    for _ in range(2):  # a batch that runs again replaces itself
        sinks.append_metrics(metric(0.2).unionByName(metric(0.3, 1)), path, 1)
    assert sorted(float(r.value) for r in sinks.read_metrics(spark, path).collect()) == [0.2, 0.3]


def test_events_are_stored_once(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    found = flow.with_event_id(flow.blocks(demo.options_trades(spark, sf_dir), min_size=95))
    for _ in range(2):
        sinks.append_new_events(found, path)
    assert spark.read.parquet(path).count() == found.count() > 0


def test_stored_table_round_trip_prunes(spark, sf_dir, tmp_path):
    path = str(tmp_path / "trades")
    rows = demo.options_trades(spark, sf_dir)
    tables.write_table(rows, path, "options_trades")
    read = tables.read_table(
        spark, path, "options_trades", start="2024-01-05 00:00:00", end="2024-01-06 12:00:00",
        symbols=["spxw"], columns=["ts", "symbol", "price", "size"],
    )
    expected = rows.where(
        "ts >= '2024-01-05 00:00:00' AND ts <= '2024-01-06 12:00:00' AND symbol = 'SPXW'"
    )
    assert read.count() == expected.count() > 0
    assert dict(read.dtypes)["price"] == "double"
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "GreaterThanOrEqual(ts" in plan
    assert "exchange" not in plan.split("ReadSchema")[1]


def test_storage_types(spark):
    stored = to_storage(ticks(spark, (at(0), "ESM6", 1, 1.0, 5, None)), "futures_ticks")
    assert stored.schema == TABLES["futures_ticks"].schema


def test_expired_days_are_dropped(spark, tmp_path):
    path = str(tmp_path / "chain")
    days = [dt.date(2024, 1, d) for d in (1, 5, 9)]
    spark.createDataFrame([(d.day, d) for d in days], "v int, dt date").write.partitionBy("dt").parquet(path)
    assert sinks.drop_expired(spark, path, "options_chain", as_of=dt.date(2024, 1, 10)) == ["2024-01-01"]
    assert spark.read.parquet(path).count() == 2
    assert sinks.drop_expired(spark, str(tmp_path / "none"), "options_chain", as_of=dt.date(2024, 1, 10)) == []


def test_the_order_of_a_sink_is_outside_its_key(spark, tmp_path):
    for order in ([], ["ts"], ["size", "seq"]):
        with pytest.raises(ValueError):
            sinks.batch_sink(str(tmp_path / "ticks"), "futures_ticks", order=order)


def test_the_later_of_many_rows_of_a_key_is_stored(spark, tmp_path):
    path = str(tmp_path / "ticks")
    rows = [(at(0), "ESM6", 1, float(i), i, None) for i in range(50)]
    write = sinks.batch_sink(path, "futures_ticks", order=["size"])
    write(ticks(spark, *rows).repartition(4), 0)
    [found] = sinks.read_merged(spark, path, "futures_ticks").collect()
    assert (found["size"], float(found.price)) == (49, 49.0)


def test_compaction_changes_no_value(spark, tmp_path, rows):
    path = str(tmp_path / "ticks")
    write = sinks.batch_sink(path, "futures_ticks", order=["size"])
    for batch in range(3):
        write(ticks(spark, (at(0), "ESM6", 1, 1.0 + batch, 5, None), (at(batch), "ESM6", 2, 3.0, 1, 0.5)), batch)
    before = rows(sinks.read_merged(spark, path, "futures_ticks"))
    sinks.compact(spark, path, "futures_ticks", day=START.date())
    assert rows(sinks.read_merged(spark, path, "futures_ticks")) == before
    assert spark.read.parquet(path).select("batch").distinct().count() == 1


def test_only_a_missing_table_counts_as_empty(spark, tmp_path):
    assert sinks.stored_or_none(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "broken.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        sinks.stored_or_none(spark, str(tmp_path / "broken.parquet"))


def test_prints_of_one_microsecond_have_their_own_ids(spark):
    trade = "ts timestamp, seq bigint, symbol string, expiration date, strike double, option_type string, price double, size bigint, side int, exchange string"
    base = (dt.date(2024, 1, 5), 5800.0, "C")
    rows_ = [(at(0), 1, "SPXW", *base, 5.0, 100, 1, "A"), (at(0), 2, "SPXW", *base, 5.1, 100, 1, "B")]
    found = flow.with_event_id(flow.blocks(spark.createDataFrame(rows_, trade)))
    assert found.select("event_id").distinct().count() == 2
    # A growing tape flags a contract once a day.
    unusual = [
        flow.with_event_id(flow.unusual_volume(spark.createDataFrame(rows_[:n], trade), min_volume=50)).first().event_id
        for n in (1, 2)
    ]
    assert unusual[0] == unusual[1]


@pytest.fixture
def split_records(spark, sf_dir, tmp_path):
    """The demo records as four files in time order, streamed one file per batch."""
    def stream(df, name):
        path = str(tmp_path / name)
        edges = df.selectExpr("percentile_approx(unix_micros(ts), array(0.25, 0.5, 0.75))").first()[0]
        bounds = [None, *edges, None]
        for low, high in zip(bounds, bounds[1:]):
            us = F.unix_micros("ts")
            piece = df.where((us >= low) if low else F.lit(True)).where((us < high) if high else F.lit(True))
            piece.coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream


def test_chain_stream_equals_the_batch(spark, sf_dir, rows, split_records):
    records = demo.market_records(spark, sf_dir)
    names = ["instrument_id", "seq", "bid", "ask", "last_price", "oi", "volume"]
    as_numbers = lambda df: df.select(*(F.col(c).cast("double").alias(c) for c in names))
    streamed = drain(stateful.chain_rows(split_records(records, "records")))
    assert rows(as_numbers(streamed)) == rows(as_numbers(tape.chain_state(records)))


def test_chain_stream_survives_a_weekend(spark, split_records):
    """A quote and open interest on Friday, a trade on Monday."""
    schema = "instrument_id bigint, ts timestamp, seq bigint, kind string, price double, size bigint, bid double, ask double, quantity bigint"
    friday, monday = dt.datetime(2024, 1, 5, 20), dt.datetime(2024, 1, 8, 14)
    records = spark.createDataFrame(
        [
            (1, friday, 1, "quote", None, None, 5.0, 5.2, None),
            (1, friday, 2, "open_interest", None, None, None, None, 700),
            (2, dt.datetime(2024, 1, 7, 12), 3, "quote", None, None, 1.0, 1.1, None),
            (2, dt.datetime(2024, 1, 8, 9), 4, "quote", None, None, 1.0, 1.1, None),
            (1, monday, 5, "trade", 5.1, 3, None, None, None),
        ],
        schema,
    )
    found = drain(stateful.chain_rows(split_records(records, "weekend"))).where("seq = 5").first()
    assert (found.bid, found.ask, found.oi) == (5.0, 5.2, 700.0)


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    """A row within the allowance counts, one behind it doesn't."""
    path = str(tmp_path / "late")
    trade = "ts timestamp, seq bigint, symbol string, expiration date, strike double, option_type string, price double, size bigint, side int, exchange string"
    row = lambda minute, seq: (at(minute), seq, "SPXW", dt.date(2024, 1, 5), 5800.0, "C", 1.0, 1, 1, "A")
    for batch in ([row(0, 1)], [row(10, 2)], [row(11, 7)], [row(10, 3), row(0, 4)], [row(30, 5)], [row(31, 6)]):
        spark.createDataFrame(batch, trade).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    found = {r.ts: r.call_premium for r in drain(windows.premium_buckets(stream)).collect()}
    assert found == {at(0): -100.0, at(10): -200.0, at(11): -100.0}


def test_sweep_stream_equals_the_batch(spark, sf_dir, rows, split_records):
    trades = demo.options_trades(spark, sf_dir)
    # Prints ten days later close every open window.
    last = trades.orderBy(F.desc("ts")).limit(1)
    closing = last.withColumns(
        {"ts": F.col("ts") + F.expr("INTERVAL 10 DAYS"), "side": F.lit(0).cast("smallint"), "seq": F.lit(-1).cast("bigint")}
    )
    after = closing.withColumn("ts", F.col("ts") + F.expr("INTERVAL 10 DAYS"))
    whole = trades.unionByName(closing).unionByName(after)
    options = {"window_ms": 86_400_000, "min_legs": 2}
    streamed = drain(stateful.sweeps(split_records(whole, "trades"), **options))
    batch = flow.sweeps(trades, **options)
    names = ["symbol", "strike", "option_type", "ts", "side", "size", "price", "legs", "venues"]
    assert rows(streamed.select(*names)) == rows(batch.select(*names))


def test_repeated_blocks_are_reported_once(spark, sf_dir, split_records):
    trades = demo.options_trades(spark, sf_dir)
    doubled = trades.unionByName(trades)
    streamed = drain(windows.blocks(split_records(doubled, "doubled"), min_size=90, late="40 days"))
    assert streamed.count() == flow.blocks(trades, min_size=90).count()


def test_alert_stream_remembers_previous_payload_and_cooldown(spark, tmp_path):
    metrics_path, events_path = str(tmp_path / "metrics"), str(tmp_path / "alerts")
    schema = (
        "ts timestamp, symbol string, metric_type string, strike double, expiration date, "
        "computed_at timestamp, value double, extra string"
    )
    rules = [
        {"id": "up", "symbol": "SPXW", "cooldown_seconds": 0, "last_fired_at": None,
         "rule": {"field": "ATM_IV.value", "op": "cross_above", "value": 2}},
        {"id": "high", "symbol": "SPXW", "cooldown_seconds": 120, "last_fired_at": None,
         "rule": {"field": "ATM_IV.value", "op": "gt", "value": 2}},
    ]
    evaluate = alert_sink(metrics_path, events_path, rules)
    for batch_id, (minute, value) in enumerate([(0, 1.0), (3 * 1440, 3.0), (3 * 1440 + 1, 3.0), (3 * 1440 + 2, 3.0)]):
        row = (at(minute), "SPXW", "ATM_IV", 0.0, dt.date(1970, 1, 1), at(minute), value, None)
        batch = spark.createDataFrame([row], schema)
        sinks.append_metrics(batch, metrics_path, batch_id)
        for _ in range(2):  # a batch that runs again changes nothing
            evaluate(batch, batch_id)
    found = sorted((r.rule_id, int((r.ts - START).total_seconds()) // 60 - 3 * 1440) for r in spark.read.parquet(events_path).collect())
    assert found == [("high", 0), ("high", 2), ("up", 0)]  # over a long weekend


def test_trade_stream_equals_the_batch(spark, sf_dir, rows, split_records):
    records = demo.market_records(spark, sf_dir)
    quotes = records.where("kind = 'quote'").select("instrument_id", "ts", "seq", "bid", "ask")
    prints = records.where("kind = 'trade'").select("instrument_id", "ts", "seq", "price", "size")
    batch = tape.trade_tape(tape.quote_at_trade(prints, quotes))
    streamed = drain(stateful.option_trades(split_records(records, "market")))
    names = ["instrument_id", "seq", "price", "bid", "ask", "side", "signed_premium"]
    assert rows(streamed.select(*names)) == rows(batch.select(*names))


def test_sliding_volume_stream(spark, sf_dir, rows, split_records):
    trades = demo.options_trades(spark, sf_dir)
    found = drain(
        windows.unusual_volume(split_records(trades, "sliding"), span="2 days", every="1 day", min_volume=300)
    )
    contract = ["symbol", "expiration", "strike", "option_type"]
    batch = trades.groupBy(*contract, F.window("ts", "2 days", "1 day")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("legs")
    ).select(*contract, F.col("window.end").alias("window_end"), "size", "legs")
    closed = batch.where("size >= 300 AND window_end <= '2024-01-30'")
    streamed = found.where("window_end <= '2024-01-30'").drop("ts", "event_id")
    assert rows(streamed) == rows(closed) and closed.count() > 0


def test_flow_pipeline_covers_the_last_hour(spark, sf_dir):
    events, metrics = run_flow_pipeline(
        demo.options_trades(spark, sf_dir), demo.futures_ticks(spark, sf_dir),
        demo.options_chain(spark, sf_dir), as_of="2024-01-10 12:00:00", window="2 days", block_min_size=90,
    )
    assert events.where("ts <= '2024-01-08 12:00:00' OR ts > '2024-01-10 12:00:00'").count() == 0
    kinds = {r.metric_type for r in metrics.select("metric_type").distinct().collect()}
    assert kinds == {"HIRO", "BASIS_SPX_ES", "VOLUME_PROFILE_ES"}
    assert events.where("event_type = 'BLOCK'").count() > 0
