"""Vendor records to typed rows: definitions, trades, quotes, statistics, books.

Records come as files or streams with the vendor's field names. Timestamps are epoch
nanoseconds, prices may be integers scaled by 1e9, and some fields have two names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType, StringType, StructField, StructType

from strikelens.functions.columns import CONTRACT, fixed_point, from_epoch_ns, instant, option_letter

# The vendor's codes and field names, here and in the selections below.
OPEN_INTEREST = 9
CUMULATIVE_VOLUME = 10
QUOTE_FIELDS = (
    "oi", "volume", "iv", "delta", "gamma", "last_price", "bid", "ask", "underlying_price",
)


def field(records: DataFrame, *names: str) -> Column:
    """The first of several field names that is present and filled."""
    found = [F.col(n) for n in names if n in records.columns]
    return F.coalesce(*found) if found else F.lit(None)


def _expiry(records: DataFrame) -> Column:
    name = next((n for n in ("expiration", "expiration_date") if n in records.columns), None)
    if name and isinstance(records.schema[name].dataType, NumericType):
        return from_epoch_ns(F.col(name)).cast("date")
    return field(records, "expiration", "expiration_date").try_cast("date")


def _sequence(records: DataFrame) -> Column:
    """The exchange sequence, or the event time where it is missing or zero."""
    sequence = field(records, "sequence").cast("bigint")
    return F.coalesce(F.nullif(sequence, F.lit(0)), F.col("ts_event").cast("bigint"), F.lit(0))


def _contract_fields(records: DataFrame) -> dict[str, Column]:
    return {
        "expiration": _expiry(records),
        "strike": fixed_point(field(records, "strike_price")),
        "option_type": option_letter(field(records, "instrument_class", "option_type")),
    }


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def underlying_of(raw_symbol: Column, supported: Sequence[str]) -> Column:
    """The first supported symbol that the raw symbol starts with."""
    raw = F.upper(raw_symbol)
    return F.coalesce(*(F.when(raw.startswith(s.upper()), s.upper()) for s in supported))


def chain_stubs(definitions: DataFrame, *, as_of) -> DataFrame:
    """Chain rows of newly defined contracts, stamped ``as_of``, all quote fields null.

    ``definitions`` carries its parent in ``symbol``.
    """
    typed = definitions.select(
        instant(as_of).alias("ts"),
        F.upper("symbol").alias("symbol"),
        *(c.alias(name) for name, c in _contract_fields(definitions).items()),
    )
    stubs = _complete(typed, "expiration", "strike", "option_type")
    kinds = {name: "bigint" if name in ("oi", "volume") else "double" for name in QUOTE_FIELDS}
    return stubs.withColumns({name: F.lit(None).cast(kind) for name, kind in kinds.items()})


#: Where a line stands that is no record, or not one of the schema.
MALFORMED = "malformed"


def read_vendor_files(spark: SparkSession, path: str, schema: StructType, *, stream: bool = False, **options) -> DataFrame:
    """Vendor records from files of JSON lines, at rest or as they come.

    A line that can't be read as a record of ``schema``, in part or at all, stands in
    :data:`MALFORMED`, which is null for all others; :func:`sound` and :func:`set_aside` part them.
    ``options`` go to the reader, such as ``maxFilesPerTrigger``.
    """
    reader = spark.readStream if stream else spark.read
    whole = StructType([*schema.fields, StructField(MALFORMED, StringType())])
    return reader.schema(whole).options(mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, **options).json(path)


def sound(records: DataFrame) -> DataFrame:
    """The records that could be read."""
    return records.where(F.col(MALFORMED).isNull()).drop(MALFORMED)


def set_aside(records: DataFrame) -> DataFrame:
    """The lines that could not, with the file they are in."""
    return records.where(F.col(MALFORMED).isNotNull()).select(F.input_file_name().alias("file"), MALFORMED)


def _newest_version(typed: DataFrame, contract: Column) -> DataFrame:
    return (
        typed.groupBy("instrument_id")
        .agg(F.max_by(contract, F.struct(F.col("ts_event"), contract)).alias("_c"))
        .select("instrument_id", "_c.*")
    )


def _versions(typed: DataFrame, contract: Column) -> DataFrame:
    """One version per instrument and time, with the time as ``defined_at``."""
    at = F.timestamp_micros(F.floor(F.col("ts_event") / 1000).cast("bigint"))
    return (
        typed.groupBy("instrument_id", at.alias("defined_at"))
        .agg(F.max_by(contract, F.struct(F.col("ts_event"), contract)).alias("_c"))
        .select("instrument_id", "defined_at", "_c.*")
    )


def option_versions(definitions: DataFrame, supported: Sequence[str]) -> DataFrame:
    """Every definition of an option with the time from which it holds (``defined_at``)."""
    return _versions(option_definitions(definitions, supported), F.struct(*CONTRACT))


def futures_versions(definitions: DataFrame) -> DataFrame:
    """Every definition of a future with the time from which it holds (``defined_at``)."""
    return _versions(futures_definitions(definitions), F.struct(*FUTURE))


def option_definitions(definitions: DataFrame, supported: Sequence[str]) -> DataFrame:
    """The usable option definitions of the supported underlyings, typed."""
    raw = field(definitions, "raw_symbol", "symbol")
    typed = definitions.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        F.col("ts_event"),
        underlying_of(raw, supported).alias("symbol"),
        *(c.alias(name) for name, c in _contract_fields(definitions).items()),
    )
    return _complete(typed, "instrument_id", *CONTRACT)


def option_contracts(definitions: DataFrame, supported: Sequence[str]) -> DataFrame:
    """Newest definition per instrument, for the supported underlyings."""
    return _newest_version(option_definitions(definitions, supported), F.struct(*CONTRACT))


FUTURE = ("symbol", "expiration", "parent")


def futures_contracts(definitions: DataFrame) -> DataFrame:
    """Newest definition per future: full name, expiry and its leading letters as parent."""
    return _newest_version(futures_definitions(definitions), F.struct(*FUTURE))


def futures_definitions(definitions: DataFrame) -> DataFrame:
    """The usable definitions of futures, typed."""
    raw = F.upper(field(definitions, "raw_symbol", "symbol"))
    typed = definitions.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        F.col("ts_event"),
        raw.alias("symbol"),
        _expiry(definitions).alias("expiration"),
        F.nullif(F.regexp_extract(raw, r"^(\p{L}+)", 1), F.lit("")).alias("parent"),
    )
    return _complete(typed, "instrument_id", "symbol")


def option_trades(records: DataFrame) -> DataFrame:
    """Typed option prints; prints without price or size are dropped."""
    typed = records.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        from_epoch_ns(F.col("ts_event")).alias("ts"),
        _sequence(records).alias("seq"),
        F.lit("trade").alias("kind"),
        fixed_point(F.col("price")).alias("price"),
        F.col("size").try_cast("bigint").alias("size"),
        field(records, "publisher_id").cast("string").alias("exchange"),
    )
    return _complete(typed, "price", "size")


def option_quotes(records: DataFrame) -> DataFrame:
    """Top of book from the first level, else from the flat fields.

    Only the flat layout carries a last price.
    """
    bid = [fixed_point(F.col("bid_px_00"))] if "bid_px_00" in records.columns else []
    ask = [fixed_point(F.col("ask_px_00"))] if "ask_px_00" in records.columns else []
    last = fixed_point(field(records, "last_price", "price"))
    if "levels" in records.columns:
        top = F.try_element_at("levels", F.lit(1))
        bid.insert(0, fixed_point(top["bid_px"]))
        ask.insert(0, fixed_point(top["ask_px"]))
        last = F.lit(None).cast("double")
    return records.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        from_epoch_ns(F.col("ts_event")).alias("ts"),
        _sequence(records).alias("seq"),
        F.lit("quote").alias("kind"),
        last.alias("price"),
        F.coalesce(*bid).alias("bid"),
        F.coalesce(*ask).alias("ask"),
    )


def statistics(records: DataFrame) -> DataFrame:
    """Open interest and cumulative volume; other statistics keep a null kind."""
    quantity = field(records, "quantity").try_cast("bigint")
    value = field(records, "value").try_cast("bigint")
    kind = F.upper(F.col("stat_type").cast("string"))
    return records.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        from_epoch_ns(F.col("ts_event")).alias("ts"),
        _sequence(records).alias("seq"),
        F.when(kind.isin(str(OPEN_INTEREST), "OPEN_INTEREST"), "open_interest")
        .when(kind.isin(str(CUMULATIVE_VOLUME), "CUMULATIVE_VOLUME", "VOLUME"), "cumulative_volume")
        .alias("kind"),
        F.coalesce(F.nullif(quantity, F.lit(0)), value, quantity).alias("quantity"),
    )


def chain_records(trades: DataFrame, quotes: DataFrame, stats: DataFrame) -> DataFrame:
    """The three record streams as one, ready for :func:`strikelens.operators.tape.chain_state`."""
    return (
        trades.drop("exchange")
        .unionByName(quotes, allowMissingColumns=True)
        .unionByName(stats, allowMissingColumns=True)
    )


def aggressor(raw: Column) -> Column:
    """+1 for 1, B or BUY; -1 for 2, S or SELL; else null."""
    text = F.upper(raw.cast("string"))
    side = F.when(text.isin("1", "B", "BUY"), 1).when(text.isin("2", "S", "SELL"), -1)
    return side.cast("smallint")


def futures_trades(records: DataFrame) -> DataFrame:
    """Typed futures prints; prints without price or size are dropped."""
    typed = records.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        from_epoch_ns(F.col("ts_event")).alias("ts"),
        _sequence(records).alias("seq"),
        fixed_point(F.col("price")).alias("price"),
        F.col("size").try_cast("bigint").alias("size"),
        aggressor(field(records, "aggressor_side")).alias("aggressor"),
        field(records, "publisher_id").cast("string").alias("venue"),
    )
    return _complete(typed, "price", "size")


def books(records: DataFrame) -> DataFrame:
    """Book updates as bid and ask arrays of (price, size, orders), levels without price left out."""

    def half(side: str) -> Column:
        levels = F.transform(
            F.coalesce("levels", F.array().cast(records.schema["levels"].dataType)),
            lambda level: F.struct(
                fixed_point(level[f"{side}_px"]).alias("price"),
                level[f"{side}_sz"].cast("bigint").alias("size"),
                level[f"{side}_ct"].cast("bigint").alias("orders"),
            ),
        )
        return F.filter(levels, lambda level: level["price"].isNotNull())

    halves = records.select(
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        from_epoch_ns(F.col("ts_event")).alias("ts"),
        _sequence(records).alias("seq"),
        half("bid").alias("bids"),
        half("ask").alias("asks"),
    )
    return halves.withColumns(
        {
            "depth_levels": F.greatest(F.size("bids"), F.size("asks")),
            "bid": F.try_element_at("bids", F.lit(1))["price"],
            "ask": F.try_element_at("asks", F.lit(1))["price"],
        }
    )


def eod_open_interest(records: DataFrame, *, as_of) -> DataFrame:
    """Newest valid open-interest statistic per contract.

    ``records`` carries its parent in ``symbol`` and the contract fields.
    """
    stamped = instant(as_of)
    scope = records
    if "stat_type" in records.columns:
        scope = records.where(F.col("stat_type") == OPEN_INTEREST)
    typed = scope.select(
        F.upper("symbol").alias("symbol"),
        *(c.alias(name) for name, c in _contract_fields(records).items()),
        F.floor(F.col("quantity").try_cast("double")).cast("bigint").alias("open_interest"),
        F.col("ts_event"),
    ).where(F.col("open_interest") >= 0)
    return (
        _complete(typed, "expiration", "strike", "option_type")
        .groupBy("symbol", "expiration", "strike", "option_type")
        .agg(
            F.max_by("open_interest", F.struct("ts_event", "open_interest")).alias("open_interest")
        )
        .withColumns({"oi_date": stamped.cast("date"), "updated_at": stamped})
    )
