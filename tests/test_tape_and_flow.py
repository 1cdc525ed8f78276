"""Hand and randomized examples for the tape, flow, futures and alert operators."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from strikelens.operators import alerts, flow, profile, tape
from strikelens.sources import records

START = dt.datetime(2024, 1, 2, 14, 30)
TRADE = (
    "ts timestamp, seq bigint, symbol string, expiration date, strike double, option_type string, "
    "price double, size bigint, side int, exchange string, bid double, ask double"
)


def trades(spark, *prints):
    """Prints as (milliseconds, price, size, side, exchange, bid, ask) of one contract."""
    rows = []
    for i, p in enumerate(prints):
        ms, price, size, side, exchange, bid, ask = (list(p) + [None] * 7)[:7]
        at = START + dt.timedelta(milliseconds=ms)
        rows.append((at, i, "SPXW", dt.date(2024, 1, 5), 5800.0, "C", price, size, side, exchange, bid, ask))
    return spark.createDataFrame(rows, TRADE)


def test_lee_ready_sides(spark):
    tape_rows = trades(
        spark, (0, 5.10, 7, None, None, 5.0, 5.1), (1, 5.0, 11, None, None, 5.0, 5.1)
    )
    found = tape.lee_ready(tape_rows).orderBy("seq").collect()
    assert [r.side for r in found] == [1, -1] and [r.signed_qty for r in found] == [7, -11]


def test_lee_ready_falls_back_to_the_previous_price(spark):
    prices = [5.05, 5.05, 5.04, 5.05]
    rows = trades(spark, *[(i, p, 1, None, None, p - 0.05, p + 0.05) for i, p in enumerate(prices)])
    assert [r.side for r in tape.lee_ready(rows).orderBy("seq").collect()] == [0, 0, -1, 1]


def test_quote_rule_and_premium(spark):
    df = spark.createDataFrame(
        [(5.1, 5.0, 5.1), (5.0, 5.0, 5.1), (5.0, 4.5, 5.5), (5.0, None, 5.1), (5.0, 0.0, 5.1)],
        "price double, bid double, ask double",
    ).withColumn("size", F.lit(10))
    found = tape.trade_tape(df).collect()
    assert [r.side for r in found] == [1, -1, 0, None, None]
    assert [r.signed_premium for r in found] == [-5100.0, 5000.0, None, None, None]


def test_blocks_and_unusual_volume(spark):
    rows = trades(spark, (0, 1.0, 99, 1, "A"), (1, 2.0, 100, -1, None), (2, 2.0, 5900, 1, "B"))
    found = flow.blocks(rows).orderBy("ts").collect()
    assert [(r.size, r.venues) for r in found] == [(100, []), (5900, ["B"])]
    unusual = flow.unusual_volume(rows).first()
    assert (unusual.size, unusual.legs) == (6099, 3)
    high = rows.select("symbol", "expiration", "strike", "option_type").distinct()
    assert flow.unusual_volume(rows, daily_average=high.withColumn("avg_daily_volume", F.lit(5000))).count() == 0


def test_sweep_over_three_venues(spark):
    rows = trades(spark, (0, 1.0, 10, 1, "A"), (50, 2.0, 20, 1, "B"), (90, 3.0, 30, 1, "C"))
    row = flow.sweeps(rows).first()
    assert (row.size, row.legs, row.venues) == (60, 3, ["A", "B", "C"])
    assert row.price == pytest.approx(140 / 60)
    apart = trades(spark, *[(i * 60_000, 1.0, 10, 1, v) for i, v in enumerate("ABC")])
    assert flow.sweeps(apart).count() == 0


def walk(prints, window=100, legs=3):
    """Sweeps found by walking the tape: (start index, legs, size)."""
    found, i = [], 0
    while i < len(prints):
        j = i
        if prints[i][3] == 0:
            i += 1
            continue
        while (
            j + 1 < len(prints)
            and prints[j + 1][3] == prints[i][3]
            and prints[j + 1][0] - prints[i][0] <= window
        ):
            j += 1
        cluster = prints[i : j + 1]
        if len(cluster) >= legs and len({p[4] for p in cluster}) >= 2:
            found.append((i, len(cluster), sum(p[2] for p in cluster)))
            i = j + 1
        else:
            i += 1
    return found


def test_sweeps_equal_the_walk_on_random_tapes(spark):
    rng = random.Random(7)
    parts, expected = [], []
    for contract in range(60):
        at, prints = 0, []
        for _ in range(60):
            at += rng.choice([0, 10, 30, 60, 120])
            prints.append((at, 1.0, rng.randint(1, 9), rng.choice([1, 1, 1, -1, 0]), rng.choice("AB")))
        for seq, p in enumerate(prints):
            parts.append((START + dt.timedelta(milliseconds=p[0]), seq, f"S{contract}", dt.date(2024, 1, 5),
                          1.0, "C", p[1], p[2], p[3], p[4], None, None))
        for i, n, size in walk(prints):
            expected.append((f"S{contract}", START + dt.timedelta(milliseconds=prints[i][0]), n, size))
    found = flow.sweeps(spark.createDataFrame(parts, TRADE)).collect()
    assert sorted((r.symbol, r.ts, r.legs, r.size) for r in found) == sorted(expected)
    assert len(expected) > 50


def test_hiro_signs_and_empty_buckets(spark):
    rows = trades(spark, (0, 1.0, 10, 1, "A"), (1000, 9.0, 5, 0, "A"), (180_000, 2.0, 5, -1, "A"))
    found = flow.hiro(rows).orderBy("ts").collect()
    assert [r.net_premium for r in found] == [-1000, 0, 0, 1000]
    assert [r.cumulative for r in found] == [-1000, -1000, -1000, 0]


def test_event_ids_are_stable(spark):
    rows = trades(spark, (0, 1.0, 200, 1, "A"), (1, 1.0, 300, 1, "A"))
    first = {r.event_id for r in flow.flow_events(rows).collect()}
    again = {r.event_id for r in flow.flow_events(rows).collect()}
    assert first == again and len(first) == 2


def grow(bins, share=0.7):
    """Value area by growing from the largest bin."""
    prices, totals = zip(*sorted(bins.items()))
    at = totals.index(max(totals))
    lo = hi = at
    got, target = totals[at], share * sum(totals)
    while got < target and (lo > 0 or hi < len(totals) - 1):
        below = totals[lo - 1] if lo > 0 else -1
        above = totals[hi + 1] if hi < len(totals) - 1 else -1
        if above >= below:
            hi += 1
            got += above
        else:
            lo -= 1
            got += below
    return prices[at], prices[hi], prices[lo]


def test_value_area_equals_the_growing_walk(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    for n in range(150):
        bins = {float(p): rng.randint(1, 6) for p in rng.sample(range(40), rng.randint(1, 25))}
        rows += [(f"R{n}", p, t, 0, 0) for p, t in bins.items()]
        expected[f"R{n}"] = grow(bins)
    table = spark.createDataFrame(rows, "symbol_root string, price double, total bigint, buy bigint, sell bigint")
    found = {r.symbol_root: (r.poc, r.vah, r.val) for r in profile.value_area(table).collect()}
    assert found == expected


def test_volume_profile(spark):
    ticks = spark.createDataFrame(
        [("ESM6", 5800.1, 5, 1), ("ESM6", 5799.9, 7, -1), ("NQM6", 1.0, 1, None), ("6EM6", 1.0, 9, 1)],
        "symbol string, price double, size bigint, aggressor int",
    ).withColumns({"ts": F.lit(START), "seq": F.lit(1)})
    bins = profile.volume_bins(profile.futures_tape(ticks, roots=["ES"]))
    assert [tuple(r) for r in bins.collect()] == [("ES", 5800.0, 12, 5, 7)]


def test_basis_needs_both_prices(spark):
    rows = [(5800.0, 5810.0), (5800.0, None), (0.0, 5810.0)]
    found = profile.basis(spark.createDataFrame(rows, "spot double, futures double")).collect()
    assert [r.basis for r in found] == [10, None, None]


def test_vendor_prices_types_and_sides(spark):
    raw = spark.createDataFrame(
        [(1, 1_700_000_000_000_000_500, 0, "5250000000", "3", 1, 1), (1, 5, 9, "x", "3", 2, 2),
         (1, 5, 9, "5.25", "3", 2, 2)],
        "instrument_id int, ts_event bigint, sequence bigint, price string, size string, "
        "aggressor_side int, publisher_id int",
    )
    found = records.futures_trades(raw).orderBy("seq").collect()
    assert [r.price for r in found] == [5.25, 5.25]
    assert [r.aggressor for r in found] == [-1, 1]
    assert [r.seq for r in found] == [9, 1_700_000_000_000_000_500]


def rule(tree, **other):
    return {"id": "r", "symbol": "SPXW", "rule": tree, "cooldown_seconds": 0, "last_fired_at": None, **other}


def fire(spark, tree, *payloads):
    rows = [("SPXW", START + dt.timedelta(minutes=i), json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "symbol string, snapshot_ts timestamp, payload string")
    return alerts.evaluate_rules(df, [rule(tree)]).orderBy("snapshot_ts").collect()


def leaf(field, op, value):
    return {"field": field, "op": op, "value": value}


GEX = {"GEX": {"value": -5.0, "curve": [{"net": 1}, {"net": 7}], "text": "abc"}}


@pytest.mark.parametrize(
    "tree, matched",
    [
        (leaf("GEX.value", "lt", 0), ["GEX.value lt 0"]),
        (leaf("GEX.value", "abs_gt", 4), ["GEX.value abs_gt 4"]),
        (leaf("GEX.value", "gt", 0), None),
        (leaf("GEX.curve.1.net", "eq", 7), ["GEX.curve.1.net eq 7"]),
        (leaf("GEX.missing", "ne", 0), None),
        (leaf("GEX.text", "ne", 0), None),
        (leaf("GEX.value", "nope", 0), None),
        ({"all": []}, []),
        ({"any": []}, None),
        ({"any": [leaf("GEX.value", "lt", 0), leaf("GEX.value", "lt", 1)]}, ["GEX.value lt 0"]),
        # A matched clause stays listed though the branch around it fails.
        (
            {"any": [{"all": [leaf("GEX.value", "lt", 0), leaf("GEX.value", "gt", 0)]},
                     leaf("GEX.value", "le", -5)]},
            ["GEX.value lt 0", "GEX.value le -5"],
        ),
        ({"all": [leaf("GEX.value", "gt", 0), leaf("GEX.value", "lt", 0)]}, None),
    ],
)
def test_rule_trees(spark, tree, matched):
    found = fire(spark, tree, GEX)
    assert [r.matched for r in found] == ([] if matched is None else [matched])


def test_crossings_need_a_previous_payload(spark):
    levels = [{"A": {"value": v}} for v in (3, 1, 2, 3, 1)]
    above = fire(spark, leaf("A.value", "cross_above", 2), *levels)
    below = fire(spark, leaf("A.value", "cross_below", 2), *levels)
    minute = lambda rows: [(r.snapshot_ts - START).seconds // 60 for r in rows]
    assert minute(above) == [3] and minute(below) == [1, 4]


def test_many_rules_plan_like_few(spark):
    payloads = spark.createDataFrame([(START, "SPXW", json.dumps(GEX[0] if isinstance(GEX, list) else GEX))], "snapshot_ts timestamp, symbol string, payload string")
    seconds = []
    for n in (10, 10_000):
        table = alerts.rule_table(spark, [rule(leaf("A.value", "gt", i), id=f"r{i}") for i in range(n)])
        begun = time.perf_counter()
        alerts.evaluate_rules(payloads, table)._jdf.queryExecution().executedPlan()
        seconds.append(time.perf_counter() - begun)
    assert seconds[1] < 5 * seconds[0] + 2


def test_rules_remember_their_last_firing(spark):
    table = alerts.rule_table(spark, [rule(leaf("A.value", "gt", 0), id=i) for i in ("a", "b")])
    fired = spark.createDataFrame([("a", START), ("a", START + dt.timedelta(minutes=3))], "rule_id string, snapshot_ts timestamp")
    found = {r.id: r.last_fired_at for r in alerts.with_last_fired(table, fired).collect()}
    assert found == {"a": START + dt.timedelta(minutes=3), "b": None}


def test_long_lists_are_trimmed(spark):
    payload = {"A": {"value": 1, "long": list(range(11)), "short": list(range(10))}}
    kept = json.loads(fire(spark, leaf("A.value", "gt", 0), payload)[0].payload)
    assert set(kept["A"]) == {"value", "short"}


@pytest.mark.parametrize("last, expected", [(None, [0, 5, 12]), (-2, [3, 12]), (-60, [0, 5, 12])])
def test_cooldown(spark, last, expected):
    minutes = [0, 1, 3, 4, 5, 7, 12]
    fired_before = None if last is None else START + dt.timedelta(minutes=last)
    rows = [("r", "SPXW", START + dt.timedelta(minutes=m), 300, fired_before) for m in minutes]
    df = spark.createDataFrame(
        rows, "rule_id string, symbol string, snapshot_ts timestamp, cooldown_seconds int, last_fired_at timestamp"
    )
    kept = alerts.apply_cooldown(df).orderBy("snapshot_ts").collect()
    assert [(r.snapshot_ts - START).seconds // 60 for r in kept] == expected


def test_payload_keeps_metrics_for_ten_minutes(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = [(at(0), "A", 1.0, '{"x": [1]}'), (at(5), "B", 2.0, None), (at(11), "B", 3.0, None)]
    metrics = spark.createDataFrame(
        rows, "ts timestamp, metric_type string, value double, extra string"
    ).withColumns({"symbol": F.lit("SPXW"), "strike": F.lit(0.0), "expiration": F.lit("1970-01-01").cast("date")})
    history = alerts.payload_history(metrics).orderBy("snapshot_ts").collect()
    seen = [{k: v["value"] for k, v in json.loads(r.payload).items()} for r in history]
    assert seen == [{"A": 1}, {"A": 1, "B": 2}, {"B": 3}]
    assert json.loads(history[0].payload)["A"]["x"] == [1]
    single = json.loads(alerts.payload_at(metrics, as_of=at(6)).first().payload)
    assert {k: v["value"] for k, v in single.items()} == {"A": 1, "B": 2}
