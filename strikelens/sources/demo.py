"""Domain tables derived from the shared benchmark tables, for queries, tests and benches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SYMBOLS = ("SPXW", "NDXP", "RUTW")
AS_OF = "2002-01-01"
TAPE_EXPIRY = "2024-02-02"
DAY_MICROS = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label(number: Column, labels: tuple[str, ...] = SYMBOLS) -> Column:
    choice = number % len(labels)
    out = F.when(choice == 0, labels[0])
    for i, name in enumerate(labels[1:], start=1):
        out = out.when(choice == i, name)
    return out


def options_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item as one chain row, at a time of its day that its columns determine."""
    line = table(spark, sf_dir, "lineitem")
    call = F.col("l_linestatus") == "O"
    strike = (F.lit(900) + F.col("l_partkey") % 21 * 5).cast("double")
    spot = (F.lit(940) + F.col("l_suppkey") % 3 * 10).cast("double")
    intrinsic = F.greatest(F.lit(0.0), F.when(call, spot - strike).otherwise(strike - spot))
    last = intrinsic + 2.0 + F.col("l_tax") * 100
    expiration = F.date_add(F.lit(AS_OF).cast("date"), (F.col("l_linenumber") - 1) * 7)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    spread = (
        F.col("l_orderkey") * 1_000_003 + F.col("l_partkey") * 10_007 + F.col("l_suppkey") * 101
        + cents * 7_919
    )
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp")) + spread % DAY_MICROS
    return line.select(
        F.timestamp_micros(micros).alias("ts"),
        label(F.col("l_suppkey")).alias("symbol"),
        expiration.alias("expiration"),
        strike.alias("strike"),
        F.when(call, "C").otherwise("P").alias("option_type"),
        F.when(F.col("l_returnflag") != "R", (F.col("l_quantity") * 10).cast("bigint")).alias("oi"),
        F.floor(F.col("l_extendedprice") / 1000).alias("volume"),
        F.when(F.col("l_discount") != 0, F.col("l_discount") + F.col("l_tax") + 0.10).alias("iv"),
        last.alias("last_price"),
        F.when(F.col("l_quantity") > 5, last - 0.5).alias("bid"),
        F.when(F.col("l_quantity") > 5, last + 0.5).alias("ask"),
        spot.alias("underlying_price"),
    )


def eod_open_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A")
    return (
        line.select(
            label(F.col("l_suppkey")).alias("symbol"),
            F.date_add(F.lit(AS_OF).cast("date"), (F.col("l_linenumber") - 1) * 7).alias(
                "expiration"
            ),
            (F.lit(900) + F.col("l_partkey") % 21 * 5).cast("double").alias("strike"),
            F.when(F.col("l_linestatus") == "O", "C").otherwise("P").alias("option_type"),
            "l_quantity",
            "l_shipdate",
        )
        .groupBy("symbol", "expiration", "strike", "option_type")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("open_interest"),
            F.max(F.col("l_shipdate").cast("date")).alias("oi_date"),
        )
    )


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its Parquet files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _events(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    size = F.get_json_object("props", "$.k").cast("bigint")
    source = event_stream(spark, sf_dir) if stream else table(spark, sf_dir, "events")
    return source.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("instrument_id"),
        "event_type",
        "value",
        size.alias("k"),
    )


def contract_columns(instrument: str = "instrument_id") -> dict[str, Column]:
    """A distinct contract per instrument."""
    n = F.col(instrument)
    return {
        "symbol": label(n),
        "expiration": F.lit(TAPE_EXPIRY).cast("date"),
        "strike": (F.lit(900) + F.floor(n / 6) * 5).cast("double"),
        "option_type": F.when(n % 2 == 0, "C").otherwise("P"),
    }


def options_trades(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Every event as a trade with a quote around it."""
    turn = F.col("seq") % 3
    bid = F.col("value") - F.when(turn == 0, 0.10).when(turn == 1, 0.0).otherwise(0.05)
    return (
        _events(spark, sf_dir, stream)
        .withColumns(contract_columns())
        .withColumns(
            {
                "price": F.col("value"),
                "size": F.col("k") + 1,
                "exchange": F.col("event_type"),
                "bid": bid,
                "ask": bid + 0.10,
                "side": F.when(turn == 0, 1).when(turn == 1, -1).otherwise(0).cast("smallint"),
            }
        )
        .drop("event_type", "value", "k")
    )


def market_records(spark: SparkSession, sf_dir: str, stream: bool = False) -> DataFrame:
    """Views as quotes, purchases as trades, sign-ups and errors as statistics."""
    kind = (
        F.when(F.col("event_type") == "view", "quote")
        .when(F.col("event_type") == "purchase", "trade")
        .when(F.col("event_type") == "signup", "cumulative_volume")
        .when(F.col("event_type") == "error", "open_interest")
    )
    quote, trade = F.col("kind") == "quote", F.col("kind") == "trade"
    return (
        _events(spark, sf_dir, stream)
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select(
            "instrument_id",
            "ts",
            "seq",
            "kind",
            F.when(trade, F.col("value")).alias("price"),
            F.when(trade, F.col("k")).alias("size"),
            F.when(quote, F.col("value") - 0.05).alias("bid"),
            F.when(quote, F.col("value") + 0.05).alias("ask"),
            F.when(~quote & ~trade, F.col("k") * 10).alias("quantity"),
        )
    )


def futures_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as futures trades, calendar spreads included."""
    turn = F.col("seq") % 3
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == "click")
        .select(
            "ts",
            label(F.col("instrument_id"), ("ESM6", "NQM6", "ESH7-ESM7")).alias("symbol"),
            "seq",
            (F.col("value") / 4 + 5800).alias("price"),
            F.col("k").alias("size"),
            F.when(turn == 0, 1).when(turn == 1, -1).cast("smallint").alias("aggressor"),
        )
    )


def _nanos(ts: str = "ts") -> Column:
    return F.unix_micros(ts) * 1000 + 7


def _scaled(value: Column) -> Column:
    """A price as the vendor sends it: an integer scaled by 1e9."""
    return F.round(value * 100).cast("bigint") * 10_000_000


def book_records(
    spark: SparkSession, sf_dir: str, depth: int = 3, stream: bool = False
) -> DataFrame:
    """Views as vendor order-book updates; the deepest level lacks its ask on odd sequences."""

    def level(i: int) -> Column:
        ask = _scaled(F.col("value") + 0.05 + 0.25 * i)
        return F.struct(
            _scaled(F.col("value") + 1.0 - 0.25 * i).alias("bid_px"),
            (F.when(F.col("seq") % 2 == 0, ask) if i == depth - 1 else ask).alias("ask_px"),
            (F.col("k") + i).alias("bid_sz"),
            (F.col("k") + 2 * i).alias("ask_sz"),
            F.lit(i + 1).cast("bigint").alias("bid_ct"),
            F.lit(i + 2).cast("bigint").alias("ask_ct"),
        )

    return (
        _events(spark, sf_dir, stream)
        .where(F.col("event_type") == "view")
        .select(
            "instrument_id",
            _nanos().alias("ts_event"),
            (F.col("seq") + 1).alias("sequence"),
            F.array(*(level(i) for i in range(depth))).alias("levels"),
        )
    )


def trade_records(spark: SparkSession, sf_dir: str, event_type: str = "purchase") -> DataFrame:
    """Vendor prints: purchases for options, clicks for futures."""
    turn = F.col("seq") % 3
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type") == event_type)
        .select(
            "instrument_id",
            _nanos().alias("ts_event"),
            (F.col("seq") + 1).alias("sequence"),
            _scaled(F.col("value")).alias("price"),
            F.col("k").alias("size"),
            F.when(turn == 0, "B").when(turn == 1, "2").otherwise("N").alias("aggressor_side"),
            (F.col("seq") % 5).alias("publisher_id"),
        )
    )


def statistic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor statistics: sign-ups as cumulative volume, errors as open interest."""
    return (
        _events(spark, sf_dir)
        .where(F.col("event_type").isin("signup", "error"))
        .select(
            "instrument_id",
            _nanos().alias("ts_event"),
            (F.col("seq") + 1).alias("sequence"),
            F.when(F.col("event_type") == "signup", 10).otherwise(9).alias("stat_type"),
            (F.col("k") * 10).alias("quantity"),
        )
    )


def definition_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor definitions, several per instrument; each event moves the strike."""
    n = F.col("instrument_id")
    root = label(n, ("SPXW", "NDXP", "ES"))
    return _events(spark, sf_dir).select(
        "instrument_id",
        _nanos().alias("ts_event"),
        F.concat(F.lower(root), F.lit("M6")).alias("raw_symbol"),
        (F.unix_micros(F.lit(TAPE_EXPIRY).cast("timestamp")) * 1000).alias("expiration"),
        ((F.lit(900) + F.col("seq") % 21 * 5) * 1_000_000_000).cast("bigint").alias("strike_price"),
        F.when(F.col("seq") % 4 == 0, "call").when(F.col("seq") % 4 == 3, "F").otherwise("P").alias(
            "instrument_class"
        ),
    )


def listing_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as vendor definitions and open-interest statistics with their parent symbol."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.lower(label(F.col("l_suppkey"))).alias("symbol"),
        F.date_add(F.lit(AS_OF).cast("date"), (F.col("l_linenumber") - 1) * 7).alias("expiration"),
        ((F.lit(900) + F.col("l_partkey") % 21 * 5) * 1_000_000_000).alias("strike_price"),
        F.when(flag == "A", "CALL").when(flag == "N", "p").otherwise("X").alias("instrument_class"),
        F.when(F.col("l_linestatus") == "F", 9).otherwise(10).alias("stat_type"),
        (F.col("l_quantity") - 5).alias("quantity"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).alias("ts_event"),
    )


def alert_rules() -> list[dict]:
    """A few rules over the metrics of the demo chain, one disabled."""
    def rule(n, symbol, tree, enabled=True, cooldown=300):
        return {"id": f"rule-{n}", "name": f"rule {n}", "symbol": symbol, "rule": tree,
                "severity": "info", "enabled": enabled, "cooldown_seconds": cooldown,
                "last_fired_at": None}

    leaf = lambda field, op, value: {"field": field, "op": op, "value": value}
    return [
        rule(1, "SPXW", leaf("ATM_IV.value", "gt", 0.15)),
        rule(2, "NDXP", {"all": [leaf("GEX_NET_TOTAL.value", "ne", 0),
                                 leaf("ATM_IV.value", "lt", 5)]}),
        rule(3, "RUTW", {"any": [leaf("GEX_NET_TOTAL.value", "abs_lt", 1),
                                 leaf("MAX_PAIN_AGG.value", "ge", 0)]}),
        rule(4, "SPXW", leaf("ATM_IV.value", "cross_above", 0.17), cooldown=90 * 86400),
        rule(5, "SPXW", leaf("ATM_IV.value", "cross_below", 0.17)),
        rule(6, "NDXP", leaf("NO_SUCH_METRIC.value", "gt", 0)),
        rule(7, "RUTW", leaf("ATM_IV.value", "gt", 0), enabled=False),
    ]
