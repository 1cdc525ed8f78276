"""Stored tables: column types at rest, keys, and how long rows are kept.

Operators compute in doubles; :func:`to_storage` turns them into the decimals of the
stored tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

PRICE = "decimal(20,6)"
RATIO = "decimal(20,8)"
LEVELS = f"array<struct<price:{PRICE},size:bigint,orders:bigint>>"


@dataclass(frozen=True)
class Table:
    ddl: str
    key: tuple[str, ...]
    keep_days: int | None = None

    @property
    def schema(self) -> StructType:
        return StructType.fromDDL(self.ddl)


# Columns, types, keys and retention of the stored tables.
TABLES = {
    "options_chain": Table(
        "ts timestamp, symbol string, expiration date, strike decimal(20,6), "
        f"option_type string, oi bigint, volume bigint, iv {RATIO}, delta {RATIO}, "
        f"gamma {RATIO}, last_price {PRICE}, bid {PRICE}, ask {PRICE}, underlying_price {PRICE}",
        ("ts", "symbol", "expiration", "strike", "option_type"),
        keep_days=7,
    ),
    "computed_metrics": Table(
        f"ts timestamp, symbol string, metric_type string, strike {PRICE}, expiration date, "
        "computed_at timestamp, value decimal(30,8), extra string",
        ("ts", "symbol", "metric_type", "strike", "expiration"),
        keep_days=7,
    ),
    "eod_open_interest": Table(
        f"symbol string, expiration date, strike {PRICE}, option_type string, oi_date date, "
        "open_interest bigint, updated_at timestamp",
        ("symbol", "expiration", "strike", "option_type"),
    ),
    "futures_ticks": Table(
        f"ts timestamp, symbol string, seq bigint, price {PRICE}, size bigint, "
        f"aggressor smallint, bid {PRICE}, ask {PRICE}, venue string",
        ("ts", "symbol", "seq"),
        keep_days=14,
    ),
    "options_trades": Table(
        f"ts timestamp, symbol string, expiration date, strike {PRICE}, option_type string, "
        f"seq bigint, price {PRICE}, size bigint, bid {PRICE}, ask {PRICE}, exchange string, "
        "side smallint, signed_premium decimal(30,6)",
        ("ts", "symbol", "expiration", "strike", "option_type", "seq"),
        keep_days=14,
    ),
    "flow_events": Table(
        f"event_id string, ts timestamp, symbol string, expiration date, strike {PRICE}, "
        "option_type string, event_type string, side smallint, size bigint, "
        f"price {PRICE}, legs int, venues array<string>, meta string",
        ("event_id",),
    ),
    "liquidity_snapshots": Table(
        f"ts timestamp, symbol string, bids {LEVELS}, asks {LEVELS}, depth_levels int",
        ("ts", "symbol"),
        keep_days=7,
    ),
    "alert_rules": Table(
        "id string, name string, symbol string, rule string, severity string, enabled boolean, "
        "cooldown_seconds int, last_fired_at timestamp, created_at timestamp",
        ("id",),
    ),
    "alert_events": Table(
        "rule_id string, ts timestamp, symbol string, matched array<string>, payload string",
        ("rule_id", "ts", "symbol"),
    ),
}


def to_storage(df: DataFrame, table: str) -> DataFrame:
    """The columns of a stored table in its order and types; absent columns become null."""
    return df.select(
        *(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[table].schema.fields
        )
    )
