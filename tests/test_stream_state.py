"""Streams that keep state, end, start again, and are corrected."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from strikelens.operators import alerts, tape
from strikelens.sources import records
from strikelens.streaming import alerts as alert_streams
from strikelens.streaming import late, stateful, windows
from strikelens.streaming.runner import ROCKSDB, Feed, drain, drain_batches, drain_closed

START = dt.datetime(2024, 1, 2, 10)
PRINT = "symbol string, expiration date, strike double, option_type string, ts timestamp, seq long, side int, size long, price double, exchange string"


def _print(minute, seq, side=1, symbol="SPX", size=1):
    return (symbol, dt.date(2024, 2, 2), 100.0, "C", START + dt.timedelta(minutes=minute), seq, side, size, 1.0, "X")


def _put(spark, feed, rows):
    return lambda: feed.put(spark.createDataFrame(rows, PRINT))


def _sums(df):
    return {(r.symbol, (r.ts - START).total_seconds() / 60): r.call_premium for r in df.collect()}


def test_a_bounded_source_leaves_no_window_open(spark):
    rows = [_print(m, m, side=-1) for m in (0, 0, 3, 61, 62)]
    feed = Feed(spark, spark.createDataFrame([], PRINT).schema)
    _put(spark, feed, rows)()
    build = lambda t: windows.premium_buckets(t, bucket="1 minute")
    assert _sums(drain(build(feed.stream))) == {("SPX", 0): 200, ("SPX", 3): 100}
    closed = drain_closed(feed.stream, build, hold="1 hour", side=1, size=0, price=0.0)
    assert sorted(_sums(closed)) == [("SPX", 0), ("SPX", 3), ("SPX", 61), ("SPX", 62)]
    assert closed.count() == 4


def test_an_empty_source_can_be_closed(spark):
    feed = Feed(spark, spark.createDataFrame([], PRINT).schema)
    build = lambda t: windows.premium_buckets(t, bucket="1 minute")
    assert drain_closed(feed.stream, build, hold="1 hour", side=1).count() == 0


def test_sweeps_come_out_once_each(spark):
    day = [("SPX", dt.date(2024, 2, 2), 100.0, "C", START + dt.timedelta(seconds=s), s, 1, 5, 1.0, e) for s in (0, 9, 18) for e in "AB"]
    feed = Feed(spark, spark.createDataFrame([], PRINT).schema)
    _put(spark, feed, day)()
    found = drain_closed(feed.stream, lambda t: stateful.sweeps(t, min_legs=2), hold="1 minute")
    assert sorted((r.ts - START).total_seconds() for r in found.collect()) == [0, 9, 18]


def test_late_prints_are_kept_and_correct_their_bucket(spark, tmp_path):
    feed, path = Feed(spark, spark.createDataFrame([], PRINT).schema), str(tmp_path)
    write = late.corrected_premiums(path, bucket="1 minute")
    options = {"bucket": "1 minute", "late": "2 minutes"}
    steps = [
        _put(spark, feed, [_print(0, 1, -1), _print(5, 2, -1), _print(5, 3, 0)]),
        _put(spark, feed, [_print(0, 4, -1, size=2), _print(1, 5, -1), _print(4.5, 6, -1)]),  # two late, one in time
        _put(spark, feed, [_print(9, 7, -1), _print(0, 8, 0)]),  # a print without a side corrects nothing
    ]
    told = []
    for step in steps:
        drain_batches(feed.stream, write, steps=[step], progress=f"{path}/progress")
        told.append(_sums(late.corrected_rows(spark, path, **options)))
    assert told == [
        {("SPX", 0): 100},
        {("SPX", 0): 300, ("SPX", 1): 100},
        {("SPX", 0): 300, ("SPX", 1): 100, ("SPX", 4): 100, ("SPX", 5): 100},
    ]
    ended = late.corrected_rows(spark, path, **options, ended=True)
    assert _sums(ended) == {**told[-1], ("SPX", 9): 100}
    assert {(r.symbol, r.revisions) for r in ended.collect() if r.ts == START} == {("SPX", 1)}
    assert sorted(r.seq for r in late.late_rows(spark, path).collect()) == [4, 5]
    # The batch runs again, as after a lost driver: nothing is counted twice.
    again = spark.createDataFrame([_print(9, 7, -1), _print(0, 8, 0)], PRINT)
    write(again, 2)
    assert _sums(late.corrected_rows(spark, path, **options)) == told[-1]


def test_batches_without_prints_change_nothing(spark, tmp_path):
    write = late.corrected_premiums(str(tmp_path), bucket="1 minute")
    write(spark.createDataFrame([], PRINT), 0)
    write(spark.createDataFrame([_print(0, 1, -1), _print(9, 2, -1)], PRINT), 1)
    write(spark.createDataFrame([], PRINT), 2)
    write(spark.createDataFrame([_print(0, 3, -1)], PRINT), 3)
    assert _sums(late.corrected_rows(spark, str(tmp_path), bucket="1 minute", late="2 minutes")) == {("SPX", 0): 200}


PAYLOAD = "symbol string, snapshot_ts timestamp, payload string"
RULES = [
    {"id": "up", "symbol": "SPX", "rule": {"field": "IV.value", "op": "cross_above", "value": 10}, "cooldown_seconds": 0},
    {"id": "hot", "symbol": "SPX", "rule": {"any": [{"field": "IV.value", "op": "gt", "value": 11},
                                                   {"field": "IV.list.1", "op": "eq", "value": 7}]}, "cooldown_seconds": 3600},
    {"id": "none", "symbol": "SPX", "rule": {}, "cooldown_seconds": 0},
    {"id": "text", "symbol": "SPX", "rule": {"field": "IV.value", "op": "gt", "value": "x"}, "cooldown_seconds": 0},
    {"id": "other", "symbol": "NDX", "rule": {"all": [{"field": "IV.value", "op": "lt", "value": 99}]}, "cooldown_seconds": 0,
     "last_fired_at": START + dt.timedelta(hours=1)},
]


def _payload(minute, value, symbol="SPX"):
    body = {"IV": {"value": value, "list": [1, 7] if value == 3 else list(range(20))}}
    return symbol, START + dt.timedelta(minutes=minute), json.dumps(body)


def _fired(df):
    return sorted((r.rule_id, (r.snapshot_ts - START).total_seconds() / 60, ";".join(r.matched), r.kept) for r in df.collect())


PAYLOADS = [
    [_payload(0, 9), _payload(1, 12), _payload(1, 5, "NDX")],
    [_payload(2, 3), _payload(30, 12)],
    [_payload(90, 9), _payload(91, 11), _payload(200, None, "NDX"), _payload(300, 5, "NDX")],
]


def test_alert_state_goes_on_across_batches(spark):
    schema = spark.createDataFrame([], PAYLOAD).schema
    feed = Feed(spark, schema)
    steps = [lambda rows=rows: feed.put(spark.createDataFrame(rows, PAYLOAD)) for rows in PAYLOADS]
    found = drain(alert_streams.alert_stream(feed.stream, RULES), steps=steps, store=ROCKSDB)
    whole = spark.createDataFrame([row for rows in PAYLOADS for row in rows], PAYLOAD)
    fired = alerts.evaluate_rules(whole, RULES)
    kept = {(r.rule_id, r.snapshot_ts) for r in alerts.apply_cooldown(fired).collect()}
    want = sorted((r.rule_id, (r.snapshot_ts - START).total_seconds() / 60, ";".join(r.matched), (r.rule_id, r.snapshot_ts) in kept) for r in fired.collect())
    assert _fired(found) == want
    assert {r[0] for r in want} == {"up", "hot", "other"} and not all(r[3] for r in want)
    payloads = {(r.rule_id, r.snapshot_ts): r.payload for r in fired.collect()}
    assert {(r.rule_id, r.snapshot_ts): r.payload for r in found.collect()} == payloads


def test_a_late_payload_is_judged_alone(spark):
    feed = Feed(spark, spark.createDataFrame([], PAYLOAD).schema)
    batches = [[_payload(10, 9)], [_payload(5, 12)], [_payload(11, 12)]]
    steps = [lambda rows=rows: feed.put(spark.createDataFrame(rows, PAYLOAD)) for rows in batches]
    found = drain(alert_streams.alert_stream(feed.stream, RULES[:1]), steps=steps, store=ROCKSDB)
    assert _fired(found) == [("up", 11, "IV.value cross_above 10", True)]


RECORD = "instrument_id long, ts timestamp, seq long, kind string, price double, size long, bid double, ask double, quantity long"


def _record(seq, kind, **values):
    row = dict.fromkeys(("price", "size", "bid", "ask", "quantity"))
    row.update(values)
    return (7, START + dt.timedelta(seconds=seq), seq, kind, *row.values())


def test_a_stream_starts_from_the_stored_chain(spark):
    first = [_record(1, "quote", bid=1.0, ask=2.0), _record(2, "cumulative_volume", quantity=50), _record(3, "open_interest", quantity=9)]
    second = [_record(4, "trade", price=1.5, size=4), (8, *_record(4, "quote", bid=5.0)[1:])]
    schema = spark.createDataFrame([], RECORD).schema
    known = stateful.known_state(tape.chain_state(spark.createDataFrame(first, RECORD)))
    feed = Feed(spark, schema)
    feed.put(spark.createDataFrame(second, RECORD))
    rows = drain(stateful.chain_rows(feed.stream, initial=known), store=ROCKSDB).collect()
    got = {r.instrument_id: (r.bid, r.ask, r.last_price, r.oi, r.volume) for r in rows}
    assert got == {7: (1.0, 2.0, 1.5, 9.0, 54.0), 8: (5.0, None, None, None, None)}
    blind = drain(stateful.chain_rows(feed.stream)).where("instrument_id = 7").first()
    assert (blind.bid, blind.volume) == (None, 4.0)


VERSION = "instrument_id long, defined_at timestamp, symbol string, expiration date, strike double, option_type string"


def _version(second, strike, instrument=7):
    return instrument, START + dt.timedelta(seconds=second), "SPX", dt.date(2024, 2, 2), strike, "C"


VERSIONS = [_version(2, 100.0), _version(5, 105.0), _version(9, 110.0), _version(0, 50.0, 9)]
SEEN = [_record(s, "trade", price=1.0, size=1) for s in (1, 2, 4, 5, 8, 9, 20)]
STRIKES = {2: 100.0, 4: 100.0, 5: 105.0, 8: 105.0, 9: 110.0, 20: 110.0}


def test_a_record_meets_the_definition_of_its_time(spark, short_slices):
    found = tape.with_contract_at(spark.createDataFrame(SEEN, RECORD), spark.createDataFrame(VERSIONS, VERSION))
    assert {r.seq: r.strike for r in found.collect()} == STRIKES
    assert found.where("price = 1.0 and size = 1 and kind = 'trade'").count() == 6


@pytest.mark.parametrize("cuts", [[20], [4, 8, 20], [1, 2, 3, 4, 5, 9, 20]])
def test_definitions_come_as_a_stream(spark, cuts):
    records, versions = (spark.createDataFrame(rows, schema) for rows, schema in ((SEEN, RECORD), (VERSIONS, VERSION)))
    feeds = [Feed(spark, df.schema) for df in (records, versions)]
    steps = []
    for low, high in zip([-1, *cuts], cuts):  # noqa: B905
        bounds = [F.lit(START + dt.timedelta(seconds=s)) for s in (low, high)]

        def put(a=bounds[0], b=bounds[1]):
            feeds[0].put(records.where((F.col("ts") > a) & (F.col("ts") <= b)))
            feeds[1].put(versions.where((F.col("defined_at") > a) & (F.col("defined_at") <= b)))

        steps.append(put)
    found = drain(stateful.matched_contracts(*(f.stream for f in feeds), late="1 second"), steps=steps)
    assert {r.seq: r.strike for r in found.collect()} == STRIKES


def test_definitions_are_cut_where_their_records_are(spark, sf_dir, monkeypatch, rows):
    """Approximate shares of a large table may differ from call to call."""
    from checks import queries

    plain, calls = type(spark.range(1)).selectExpr, []

    def wavering(df, *parts):
        if "percentile_approx" in parts[0]:
            calls.append(parts)
            parts = [f"percentile_approx(us, array({', '.join(str(k / 4 - 0.2 * (len(calls) > 1)) for k in (1, 2, 3))}))"]
        return plain(df, *parts)

    monkeypatch.setattr(type(spark.range(1)), "selectExpr", wavering)
    streamed = rows(queries.QUERIES["stream_contract_versions"](spark, sf_dir))
    assert calls and streamed == rows(queries.QUERIES["contract_versions"](spark, sf_dir))


def test_instruments_that_share_a_state_are_kept_apart(spark, monkeypatch):
    """All instruments in one part, the null one among them, over several batches."""
    monkeypatch.setattr(stateful, "PARTS", 1)
    batches = [
        [_record(1, "quote", bid=1.0, ask=2.0), (9, *_record(1, "trade", price=3.0, size=2)[1:]), (None, *_record(1, "trade", price=4.0, size=1)[1:])],
        [(8, *_record(2, "cumulative_volume", quantity=50)[1:]), (9, *_record(2, "trade", price=None, size=5)[1:])],
        [_record(3, "trade", price=1.5, size=4), (8, *_record(3, "trade", price=7.0, size=1)[1:]), (None, *_record(3, "quote", ask=9.0)[1:])],
    ]
    feed = Feed(spark, spark.createDataFrame([], RECORD).schema)
    steps = [lambda b=b: feed.put(spark.createDataFrame(b, RECORD)) for b in batches]
    found = drain(stateful.chain_rows(feed.stream), steps=steps)
    names = ("instrument_id", "seq", "bid", "ask", "last_price", "oi", "volume")
    whole = tape.chain_state(spark.createDataFrame([r for b in batches for r in b], RECORD))
    both = [sorted((tuple(r) for r in df.select(*(F.col(n).cast("double") for n in names)).collect()), key=str) for df in (found, whole)]
    assert both[0] == both[1] and len(both[0]) == 8


def test_vendor_files_set_bad_lines_aside(spark, tmp_path):
    lines = ['{"instrument_id": 1, "price": 5}', '{"instrument_id": 2, "price": "n/a"}', '{"instrument', "", '{"price": 7}', "[1]"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    (tmp_path / "b.json").write_text('{"instrument_id": 9, "price": 1, "more": 2}\n')
    schema = spark.createDataFrame([], "instrument_id long, price long").schema
    for stream in (False, True):
        found = records.read_vendor_files(spark, str(tmp_path), schema, stream=stream)
        found = drain(found) if stream else found.cache()
        assert sorted(map(tuple, records.sound(found).collect()), key=str) == [(1, 5), (9, 1), (None, 7)]
        bad = records.set_aside(found).collect()
        assert sorted(r.malformed for r in bad) == ["[1]", '{"instrument', '{"instrument_id": 2, "price": "n/a"}']
