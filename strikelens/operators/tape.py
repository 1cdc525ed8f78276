"""Trade-tape operators: contract lookup, quote at trade, chain state, trade side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from strikelens.functions.columns import CONTRACT, MULTIPLIER
from strikelens.operators.scan import last_known, running_total, with_slices, without_slices

MID_TOLERANCE = 1e-9


def with_contract(records: DataFrame, contracts: DataFrame) -> DataFrame:
    """Attach the contract of each record's instrument; records without one are dropped.

    Contracts hold one row per instrument, so the join never multiplies rows. It carries
    no broadcast hint: the contract table grows with the universe, and adaptive execution
    measures it and splits a hot instrument when the join has to shuffle.
    """
    return records.join(contracts, "instrument_id")


def with_contract_at(
    records: DataFrame,
    versions: DataFrame,
    *,
    columns: Sequence[str] = CONTRACT,
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Attach the definition of each record's instrument that holds at the record's time.

    ``versions`` has ``instrument_id``, ``defined_at`` and ``columns``, one row per instrument and
    time. Both go through one ordered scan; a definition of a record's own time holds already.
    Records before the first definition of their instrument are dropped.
    """
    keys = ("instrument_id",)
    carried = [c for c in records.columns if c not in (*keys, *order)]
    left = records.select(*keys, *order, F.struct(*carried).alias("_record"), F.lit(1).alias("_late"))
    right = versions.select(
        *keys, F.col("defined_at").alias(order[0]), F.lit(0).alias("_late"), F.struct(*columns).alias("_defined")
    )
    timeline = [order[0], "_late", *order[1:]]
    both = with_slices(left.unionByName(right, allowMissingColumns=True), timeline)
    scanned = last_known(both, {"_contract": F.col("_defined")}, keys, timeline)
    found = without_slices(scanned.where((F.col("_late") == 1) & F.col("_contract").isNotNull()))
    return found.select(*keys, *order, "_record.*", "_contract.*")


def unmatched(records: DataFrame, contracts: DataFrame) -> DataFrame:
    """Number of records per kind whose instrument is unknown."""
    return (
        records.join(contracts.select("instrument_id"), "instrument_id", "left_anti")
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("unmatched"))
    )


def matched(records: DataFrame, contracts: DataFrame, seen: Observation, kinds: Sequence[str]) -> DataFrame:
    """:func:`with_contract` that counts what it drops, per kind, in the pass that writes its result.

    ``seen.get`` has the numbers once the result has been written: one of each of ``kinds``.
    """
    known = contracts.withColumn("_known", F.lit(True))
    both = records.join(known, "instrument_id", "left")
    missing = F.col("_known").isNull()
    told = both.observe(seen, *(F.count_if(missing & (F.col("kind") == kind)).alias(kind) for kind in kinds))
    return told.where(~missing).drop("_known")


def quote_side(price: Column, bid: Column, ask: Column) -> Column:
    """+1 above the mid, -1 below, 0 on it; null without a two-sided quote."""
    mid = (bid + ask) / 2.0
    side = F.when(price > mid, 1).when(price < mid, -1).when(price == mid, 0)
    return F.when((bid > 0) & (ask > 0), side).cast("smallint")


def dealer_premium(side: Column, size: Column, price: Column) -> Column:
    """Signed premium of the dealer, who takes the other side; null for unsided trades."""
    return F.when(side != 0, -side * size * price * MULTIPLIER)


def quote_at_trade(
    trades: DataFrame,
    quotes: DataFrame,
    *,
    keys: Sequence[str] = ("instrument_id",),
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Give each trade the last bid and the last ask of its instrument at or before it.

    Both tapes go through one ordered scan, so the as-of match is a shuffle and a sort and
    no inequality join. ``order`` decides between equal timestamps, as in
    :func:`chain_state`; a quote with the trade's own position counts as earlier.
    """
    carried = [c for c in trades.columns if c not in (*keys, *order, "bid", "ask")]
    left = trades.select(*keys, *order, F.struct(*carried).alias("_trade"), F.lit(1).alias("_late"))
    right = quotes.select(*keys, *order, F.lit(0).alias("_late"), "bid", "ask")
    timeline = [*order, "_late"]
    both = with_slices(left.unionByName(right, allowMissingColumns=True), timeline)
    scanned = last_known(both, {"bid": F.col("bid"), "ask": F.col("ask")}, keys, timeline)
    return without_slices(scanned.where(F.col("_late") == 1)).select(
        *keys, *order, "_trade.*", "bid", "ask"
    )


def trade_tape(trades_with_quotes: DataFrame) -> DataFrame:
    """Add the quote-rule side and the dealer's signed premium."""
    sided = trades_with_quotes.withColumn(
        "side", quote_side(F.col("price"), F.col("bid"), F.col("ask"))
    )
    return sided.withColumn(
        "signed_premium", dealer_premium(F.col("side"), F.col("size"), F.col("price"))
    )


def chain_state(
    records: DataFrame,
    *,
    keys: Sequence[str] = ("instrument_id",),
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """One chain row per record with everything known of its instrument so far.

    ``records`` has ``kind`` (trade, quote, open_interest, cumulative_volume) and the
    columns ``price, size, bid, ask, quantity``. Volume is the last cumulative statistic
    plus the sizes traded since; it is null until the first of either.
    """
    trade = F.col("kind") == "trade"
    statistic = (F.col("kind") == "cumulative_volume") & F.col("quantity").isNotNull()
    sized = trade & F.col("size").isNotNull()
    totals = running_total(
        with_slices(records, order),
        {"_traded": F.when(sized, F.col("size").cast("bigint"))},
        keys,
        order,
    )
    seen = last_known(
        totals,
        {
            "oi": F.when(F.col("kind") == "open_interest", F.col("quantity").cast("bigint")),
            "bid": F.col("bid"),
            "ask": F.col("ask"),
            "last_price": F.when(trade | (F.col("kind") == "quote"), F.col("price")),
            "_offset": F.when(statistic, F.col("quantity").cast("bigint") - F.col("_traded")),
            "_sized": F.when(sized, F.lit(True)),
        },
        keys,
        order,
    )
    known = F.col("_sized").isNotNull() | F.col("_offset").isNotNull()
    volume = F.when(known, F.col("_traded") + F.coalesce("_offset", F.lit(0)))
    return without_slices(
        seen.withColumn("volume", volume).drop(
            "_traded", "_offset", "_sized", "price", "size", "quantity"
        )
    )


def lee_ready(
    trades: DataFrame,
    *,
    keys: Sequence[str] = CONTRACT,
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Quote rule with a tick-rule fallback; adds ``mid``, ``side`` and ``signed_qty``.

    A trade at the mid, or without a quote, takes the sign of its change from the previous
    priced trade; an equal price stays unclassified.
    """
    scanned = last_known(
        with_slices(trades.drop("mid", "side", "signed_qty"), order),
        {"_before": F.col("price")},
        keys,
        order,
        include_current=False,
    )
    price, mid = F.col("price"), (F.col("bid") + F.col("ask")) / 2.0
    tick = F.coalesce(F.signum(price - F.col("_before")), F.lit(0.0))
    side = F.when(price > mid + MID_TOLERANCE, 1).when(price < mid - MID_TOLERANCE, -1)
    sided = scanned.withColumns({"mid": mid, "side": side.otherwise(tick).cast("smallint")})
    quantity = F.col("side") * F.coalesce("size", F.lit(0)) if "size" in trades.columns else (
        F.col("side")
    )
    return without_slices(
        sided.withColumn("signed_qty", quantity.cast("double")).drop("_before")
    )
