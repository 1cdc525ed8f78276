"""Small Column helpers shared by the operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

#: Columns that identify one listed option.
CONTRACT = ("symbol", "expiration", "strike", "option_type")

#: Contracts deliver 100 units of the underlying.
MULTIPLIER = 100.0


def number(name: str) -> Column:
    """Unparseable text and NaN become null (the only missing value used here)."""
    value = F.col(name).try_cast("double")
    return F.when(~F.isnan(value), value)


def positive(value: Column) -> Column:
    """The value where it is above zero, null elsewhere, so formulas go null with it."""
    return F.when(value > 0, value)


def day(as_of) -> Column:
    """An explicit valuation date: a Column, a ``date``, or an ISO string."""
    if isinstance(as_of, Column):
        return as_of.cast("date")
    if isinstance(as_of, dt.datetime):
        as_of = as_of.date()
    return F.lit(str(as_of)).cast("date")


def instant(as_of) -> Column:
    """An explicit point in time: a Column, a ``datetime``, or an ISO string."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp")
    return F.lit(str(as_of)).cast("timestamp")


def year_fraction(as_of, expiration: str = "expiration") -> Column:
    """Calendar days over 365, floored at one day."""
    return F.greatest(F.lit(1), F.datediff(F.col(expiration), day(as_of))) / F.lit(365.0)


def side_sign(option_type: str = "option_type") -> Column:
    """+1 for calls; anything else counts as a put."""
    return F.when(F.upper(option_type) == "C", 1.0).otherwise(-1.0)


def is_call(option_type: str = "option_type") -> Column:
    return F.upper(option_type) == "C"


def is_put(option_type: str = "option_type") -> Column:
    return F.upper(option_type) == "P"


def option_letter(raw: Column) -> Column:
    """C/CALL and P/PUT in any case; other classes give null."""
    text = F.upper(raw.cast("string"))
    return F.when(text.isin("C", "CALL"), "C").when(text.isin("P", "PUT"), "P")


def fixed_point(raw: Column) -> Column:
    """Vendor prices: values beyond a million are integers scaled by 1e9."""
    value = raw.try_cast("double")
    return F.when(F.abs(value) > 1e6, value / 1e9).otherwise(value)


def from_epoch_ns(raw: Column) -> Column:
    """Epoch nanoseconds to a timestamp at microsecond resolution."""
    nanos = raw.cast("bigint")
    return F.timestamp_micros(F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000)))


def two_sided_mid(bid: str = "bid", ask: str = "ask") -> Column:
    """Midpoint when both sides are quoted above zero, else null."""
    quoted = (F.col(bid) > 0) & (F.col(ask) > 0)
    return F.when(quoted, (F.col(bid) + F.col(ask)) / 2.0)


def price_last_first() -> Column:
    """Price used for implied vol: the last trade, then the mid, then zero."""
    return F.coalesce(positive(F.col("last_price")), two_sided_mid(), F.lit(0.0))


def price_mid_first() -> Column:
    """Price used for parity: the mid, then the last trade, then null."""
    return F.coalesce(two_sided_mid(), positive(F.col("last_price")))


def coverage_pct(part: Column, total: Column) -> Column:
    """Share of filled rows in percent with one decimal; null for no rows."""
    return F.when(total > 0, F.round(F.lit(100.0) * part / F.nullif(total, F.lit(0)), 1))


def lag_seconds(ts: Column, now) -> Column:
    """Seconds since ``ts``, never negative."""
    gap = (F.unix_micros(instant(now)) - F.unix_micros(ts)) / 1e6
    return F.greatest(F.lit(0.0), gap)


def lag_band(seconds: Column) -> Column:
    """Freshness colour bands: under 2 minutes, under 10 minutes, older."""
    return F.when(seconds < 120, "ok").when(seconds < 600, "warn").when(
        seconds.isNotNull(), "stale"
    )


def coverage_band(pct: Column) -> Column:
    """Coverage bands: at least 95 %, at least 50 %, lower."""
    return F.when(pct >= 95, "ok").when(pct >= 50, "warn").when(pct.isNotNull(), "bad")
