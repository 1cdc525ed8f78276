"""Hand examples for the snapshot, exposure, positioning and vol operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from strikelens.functions import greeks
from strikelens.functions.columns import number
from strikelens.operators import exposure, positioning, quality, vol
from strikelens.operators.snapshot import (
    basis_carry,
    fill_open_interest,
    latest_snapshot,
    parity_spot,
    resolve_spot,
)
from strikelens.plans import metrics, serving
from strikelens.plans.pipeline import run_chain_pipeline, run_history_pipeline
from strikelens.sources import demo

TODAY = dt.date(2024, 1, 2)
SCHEMA = (
    "symbol string, expiration date, strike double, option_type string, oi bigint, volume bigint, "
    "iv double, delta double, gamma double, last_price double, bid double, ask double, "
    "underlying_price double"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]


def chain(spark, *legs, **common):
    """Chain rows from dictionaries; what a leg leaves out comes from the common values."""
    base = {"symbol": "SPXW", "expiration": TODAY + dt.timedelta(days=30), "underlying_price": 100.0}
    rows = [tuple({**base, **common, **leg}.get(f) for f in FIELDS) for leg in legs]
    return spark.createDataFrame(rows, SCHEMA)


def leg(strike, option_type, **values):
    return {"strike": float(strike), "option_type": option_type, **values}


def test_gex_of_one_call(spark):
    row = exposure.gex_curve(chain(spark, leg(100, "C", oi=1000, gamma=0.05))).first()
    assert row.call_gex == pytest.approx(500_000) and row.net_gex == pytest.approx(500_000)


def test_gex_net_is_call_less_absolute_put(spark):
    book = chain(spark, leg(100, "C", oi=10, gamma=0.05), leg(100, "P", oi=1000, gamma=0.05))
    row = exposure.gex_curve(book).first()
    assert row.put_gex < 0 and row.net_gex == pytest.approx(row.call_gex + row.put_gex)


def test_gex_without_weights_has_a_zero_total_and_no_curve(spark):
    book = chain(spark, leg(100, "C", oi=0, volume=5, gamma=0.05))
    assert exposure.gex_curve(book).count() == 0
    total = exposure.gex_totals(book).first()
    assert total.net_total == 0 and total.underlying_price == 100
    assert exposure.gex_curve(book, weight="volume").count() == 1


def test_gex_without_spot_is_empty(spark):
    book = chain(spark, leg(100, "C", oi=10, gamma=0.05), underlying_price=None)
    assert exposure.gex_curve(book).count() == 0


def test_gex_of_one_expiry(spark):
    book = chain(
        spark, leg(100, "C", oi=10, gamma=0.05), leg(100, "C", oi=30, gamma=0.05, expiration=TODAY)
    )
    one = exposure.gex_curve(book, expiry=str(TODAY)).first().net_gex
    assert one == pytest.approx(0.75 * exposure.gex_curve(book).first().net_gex)


def test_zero_gamma_lies_between_the_books_and_ignores_scale(spark):
    def level(scale):
        legs = [leg(80, "P", iv=0.18, volume=10_000 * scale) for _ in range(5)]
        legs += [leg(120, "C", iv=0.18, volume=10_000 * scale) for _ in range(5)]
        found = exposure.zero_gamma(
            chain(spark, *legs), as_of=TODAY, search_pct=0.4, n_points=801
        )
        return found.first().zero_gamma

    once = level(1)
    assert 70 < once < 140 and level(7) == pytest.approx(once)


def test_zero_gamma_needs_a_sign_change(spark):
    calls = chain(spark, leg(100, "C", iv=0.2, volume=10))
    assert exposure.zero_gamma(calls, as_of=TODAY).first().zero_gamma is None


def test_vanna_and_charm_double_with_the_weights(spark):
    def totals(scale):
        legs = [
            leg(k, t, iv=0.18, oi=1000 * scale) for k in (95, 100, 105) for t in ("C", "P")
        ][:5]
        book = chain(spark, *legs)
        vanna = exposure.vanna_curve(book, as_of=TODAY).agg(F.sum("vanna_exposure")).first()[0]
        charm = exposure.charm_curve(book, as_of=TODAY).agg(F.sum("charm_exposure")).first()[0]
        return vanna, charm

    assert totals(2) == pytest.approx([2 * v for v in totals(1)])


def test_max_pain_of_a_symmetric_book(spark):
    legs = [leg(k, t, oi=100) for k in range(90, 111, 5) for t in ("C", "P")]
    assert positioning.max_pain(chain(spark, *legs)).first().strike == 100
    assert positioning.max_pain_aggregate(chain(spark, *legs)).first().strike == 100


def test_max_pain_takes_the_lowest_strike_on_ties(spark):
    book = chain(spark, leg(100, "C", oi=0), leg(105, "P", oi=0))
    assert positioning.max_pain(book).first().strike == 100


def test_walls_sum_duplicate_strikes_and_skip_empty_ones(spark):
    book = chain(
        spark,
        leg(105, "C", oi=500), leg(105, "C", oi=500), leg(110, "C", oi=800), leg(115, "C", oi=0),
        leg(95, "P", oi=10),
    )
    found = {(r.option_type, r["rank"]): r.strike for r in positioning.walls(book, mode="oi").collect()}
    assert found == {("C", 1): 105, ("C", 2): 110, ("P", 1): 95}


@pytest.mark.parametrize(
    "calls, puts, label", [(8000, 1000, "bullish"), (1000, 8000, "bearish"), (500, 500, "neutral")]
)
def test_regime_follows_the_walls(spark, calls, puts, label):
    book = chain(spark, leg(105, "C", oi=calls), leg(95, "P", oi=puts))
    row = positioning.regime(book).where("weight = 'oi'").first()
    assert row.label == label


def test_pin_probabilities_sum_to_one(spark):
    legs = [
        leg(k, t, iv=0.18, oi=1000 if k == 100 else 200)
        for k in (98, 99, 100, 101, 102) for t in ("C", "P")
    ]
    pins = positioning.pin_probability(chain(spark, *legs, expiration=TODAY), as_of=TODAY)
    rows = pins.orderBy(F.desc("prob")).collect()
    assert sum(r.prob for r in rows) == pytest.approx(1) and rows[0].strike == 100
    later = positioning.pin_probability(chain(spark, *legs), as_of=TODAY)
    assert later.count() == 0


def test_normal_cdf_and_prices(spark):
    points = [-9.0, -3.3, -1.0, 0.0, 0.5, 2.0, 8.0]
    df = spark.createDataFrame([(x,) for x in points], "x double")
    for row in df.select("x", greeks.norm_cdf(F.col("x")).alias("n")).collect():
        assert row.n == pytest.approx(0.5 * math.erfc(-row.x / math.sqrt(2)), abs=1e-14)


@pytest.mark.parametrize(
    "spot, strike, days, sigma, call", [(100, 100, 182, 0.2, True), (100, 110, 365, 0.35, False)]
)
def test_vol_round_trip(spark, spot, strike, days, sigma, call):
    kind = "C" if call else "P"
    quoted = chain(
        spark, leg(strike, kind), expiration=TODAY + dt.timedelta(days=days), underlying_price=float(spot)
    ).withColumns({"tau": F.lit(days / 365.0), "sigma": F.lit(sigma)})
    priced = greeks.with_price(
        quoted, spot="underlying_price", strike="strike", tau="tau", sigma="sigma", r=0.05,
        call=F.lit(call),
    ).withColumn("last_price", F.col("bs_price"))
    assert vol.fill_iv(priced, as_of=TODAY).first().iv == pytest.approx(sigma, abs=1e-6)


def test_vol_is_the_middle_of_a_bracket_halved_thirty_times(spark):
    """Net exposures of deep options show a vol's ninth digit."""
    low, high, tau = 0.01, 5.0, 30 / 365.0
    for _ in range(30):
        middle = (low + high) / 2
        first = (math.log(100 / 104) + (0.05 + middle * middle / 2) * tau) / (middle * math.sqrt(tau))
        upper, lower = (0.5 * math.erfc(-x / math.sqrt(2)) for x in (first, first - middle * math.sqrt(tau)))
        below = 100 * upper - 104 * math.exp(-0.05 * tau) * lower < 3.25
        low, high = (middle, high) if below else (low, middle)
    quoted = chain(spark, leg(104, "C", last_price=3.25), expiration=TODAY + dt.timedelta(days=30), underlying_price=100.0)
    assert vol.fill_iv(quoted, as_of=TODAY).first().iv == pytest.approx((low + high) / 2, abs=1e-13)


def test_vol_fill_keeps_what_it_cannot_solve(spark):
    filled = vol.fill_iv(
        chain(
            spark,
            leg(90, "C", iv=0.25, last_price=11.0),
            leg(95, "C", iv=None, last_price=1.0),  # below intrinsic
            leg(100, "C", iv=7.0, last_price=0.0),  # no price: the odd vol stays and feeds gamma
            leg(105, "C", iv=None, bid=1.0, ask=1.2),
        ),
        as_of=TODAY,
    ).orderBy("strike").collect()
    assert filled[0].iv == 0.25 and filled[0].gamma > 0
    assert filled[1].iv is None and filled[1].gamma is None
    assert filled[2].iv == 7.0 and filled[2].gamma > 0
    assert 0.01 <= filled[3].iv <= 5


def test_iv_summary(spark):
    book = chain(
        spark,
        leg(100, "C", iv=0.20, delta=0.5), leg(100, "P", iv=0.22, delta=-0.5),
        leg(110, "C", iv=0.18, delta=0.25), leg(90, "P", iv=0.35, delta=-0.25),
    )
    assert vol.atm_iv(book).first().atm_iv == pytest.approx(0.21)
    assert vol.iv_skew(book).first().skew == pytest.approx(0.18 - 0.35)
    assert vol.iv_surface(book).count() == 4
    term = vol.term_structure(book, as_of=TODAY).first()
    assert term.days_to_expiry == 30 and term.risk_reversal_25d == pytest.approx(-0.17)


def test_atm_iv_is_null_when_the_first_expiry_has_none(spark):
    book = chain(
        spark, leg(100, "C", expiration=TODAY), leg(100, "C", iv=0.2)
    )
    assert vol.atm_iv(book).first().atm_iv is None


def test_move_tracker(spark):
    book = chain(
        spark, leg(100, "C", last_price=30.0), leg(100, "P", last_price=28.0),
        expiration=TODAY, underlying_price=110.0,
    )
    opens = spark.createDataFrame([("SPXW", 100.0)], "symbol string, open_price double")
    row = vol.move_tracker(book, as_of=TODAY, opens=opens).first()
    assert (row.implied_move, row.realized_move) == (58, 10) and row.ratio == pytest.approx(10 / 58)
    assert vol.move_tracker(book, as_of=TODAY).first().ratio is None


def test_parity_spot(spark):
    quotes = [leg(k, "C", bid=max(100 - k, 0) + 1.9, ask=max(100 - k, 0) + 2.1) for k in (95, 100, 105)]
    quotes += [leg(k, "P", bid=max(k - 100, 0) + 1.9, ask=max(k - 100, 0) + 2.1) for k in (95, 100, 105)]
    found = parity_spot(chain(spark, *quotes), as_of=TODAY).first().parity_spot
    assert found == pytest.approx(100, rel=0.05)
    calls = chain(spark, *quotes[:3])
    assert parity_spot(calls, as_of=TODAY).first().parity_spot is None


def test_spot_is_only_replaced_when_missing(spark):
    legs = [leg(100, "C", last_price=3.0), leg(100, "P", last_price=2.0)]
    kept = resolve_spot(chain(spark, *legs), as_of=TODAY, keys=("symbol",))
    assert {r.underlying_price for r in kept.collect()} == {100.0}
    dark = resolve_spot(chain(spark, *legs, underlying_price=None), as_of=TODAY, keys=("symbol",))
    expected = 100 * math.exp(-0.05 * 30 / 365) + 1
    assert {round(r.underlying_price, 6) for r in dark.collect()} == {round(expected, 6)}


def test_basis_is_carried_to_snapshots_without_parity(spark):
    rows = [
        ("SPXW", 1, 99.0, None), ("SPXW", 2, 110.0, 100.0), ("SPXW", 3, 112.0, None), ("SPXW", 4, None, None),
    ]
    table = spark.createDataFrame(
        rows, "symbol string, snapshot_ts int, futures_price double, parity_spot double"
    )
    found = {r.snapshot_ts: r.resolved_spot for r in basis_carry(table).collect()}
    assert found == {1: 99.0, 2: 100.0, 3: 102.0, 4: None}


def test_open_interest_fill(spark):
    book = chain(
        spark, leg(100, "C", oi=None), leg(105, "c", oi=0), leg(110, "C", oi=7),
    ).unionByName(chain(spark, leg(100, "C", oi=None), symbol="NDXP"))
    eod = spark.createDataFrame(
        [("SPXW", TODAY + dt.timedelta(days=30), 105.0, "C", 50)],
        "symbol string, expiration date, strike double, option_type string, open_interest bigint",
    )
    found = {(r.symbol, r.strike): r.oi for r in fill_open_interest(book, eod).collect()}
    # A symbol with end-of-day rows gets zeros; one without any keeps its nulls.
    assert found == {
        ("SPXW", 100): 0, ("SPXW", 105): 50, ("SPXW", 110): 7, ("NDXP", 100): None,
    }


def test_snapshot_looks_back_two_days(spark):
    stamped = chain(spark, leg(100, "C", oi=1), leg(105, "C", oi=2)).withColumn(
        "ts", F.when(F.col("strike") == 100, "2024-01-01 12:00:00").otherwise("2023-12-30").cast("timestamp")
    )
    found = latest_snapshot(stamped, as_of="2024-01-02 00:00:00").collect()
    assert [r.strike for r in found] == [100]


EXPECTED_TYPES = {
    "GEX_NET_TOTAL", "GEX_LEVEL", "GEX_NET_TOTAL_VOL", "GEX_LEVEL_VOL", "MAX_PAIN", "MAX_PAIN_AGG",
    "CALL_WALL_OI", "PUT_WALL_OI", "CALL_WALL_VOL", "PUT_WALL_VOL", "ATM_IV", "IV_SKEW",
    "IV_SURFACE", "REGIME_OI", "REGIME_VOL", "VANNA_NET_TOTAL", "VANNA_LEVEL", "CHARM_NET_TOTAL",
    "CHARM_LEVEL", "IV_TERM_STRUCTURE", "RISK_REVERSAL_25D", "MOVE_TRACKER", "PIN_PROBABILITY",
}


def test_pipeline_writes_every_metric_type(spark, sf_dir):
    metrics = run_chain_pipeline(
        demo.options_chain(spark, sf_dir), demo.eod_open_interest(spark, sf_dir),
        as_of=demo.AS_OF, lookback=None,
    )
    assert {r.metric_type for r in metrics.select("metric_type").distinct().collect()} == EXPECTED_TYPES


def test_history_gives_the_latest_snapshot_the_same_totals(spark):
    legs = [leg(k, t, oi=10, volume=5, iv=0.2, last_price=5.0) for k in (95, 100, 105) for t in ("C", "P")]
    day = chain(spark, *legs).withColumn("ts", F.lit("2024-01-01 12:00:00").cast("timestamp"))
    earlier = day.withColumns({"ts": F.lit("2023-12-31 12:00:00").cast("timestamp"), "oi": F.lit(3)})
    history = run_history_pipeline(day.unionByName(earlier), None, every="1 day")
    single = run_chain_pipeline(day, None, as_of="2024-01-02")
    def pick(metrics):
        return {
            (r.metric_type, r.strike): round(r.value, 6)
            for r in metrics.where("ts = '2024-01-02' AND value IS NOT NULL").collect()
        }
    assert pick(history) == pick(single) and len(pick(single)) > 20


def test_numbers_at_ingest(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r.n for r in df.select(number("v").alias("n")).collect()] == [1.5, None, None, None]


def test_rule_counts_and_recent_alerts(spark):
    rules = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "id string, enabled boolean")
    assert quality.rule_counts(rules).first().asDict() == {"rules_total": 3, "rules_enabled": 2}
    events = spark.createDataFrame([(f"r{i}", dt.datetime(2024, 1, 1, i)) for i in range(5)], "rule_id string, ts timestamp")
    assert [r.rule_id for r in serving.recent_alerts(events, 2).collect()] == ["r4", "r3"]


def test_what_reads_a_union_of_metrics_does_not_run_its_branches_in_one_task(spark):
    """One task that ran all kinds of metric, one after another, took the memory of all their sorts."""
    spark.conf.unset("spark.sql.unionOutputPartitioning")
    book = chain(spark, leg(100, "C", oi=10, gamma=0.05, iv=0.2))
    metrics.chain_metrics(book, as_of="2024-01-02 16:00:00")
    branch = spark.range(1000).repartition(8, "id")
    plan = branch.union(branch).groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    # A shuffle for each branch and one above them: the sum isn't taken in the tasks of both.
    assert plan.count("Exchange") == 3
