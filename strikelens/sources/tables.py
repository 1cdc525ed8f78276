"""Reading and laying out the stored Parquet tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strikelens.functions.columns import instant
from strikelens.schemas import TABLES, to_storage


def write_table(
    df: DataFrame, path: str, table: str, *, ts: str = "ts", mode: str = "append",
    files: int | None = None,
) -> None:
    """Store rows partitioned by day, sorted by symbol and time within files.

    The rows are cut into ranges of (day, symbol, time): a symbol with most of a day's rows
    spreads over several files, and the sort gives each row group narrow bounds.
    """
    stored = to_storage(df, table).withColumn("dt", F.to_date(ts))
    order = [c for c in ("dt", "symbol", ts) if c in stored.columns]
    ranged = stored.repartitionByRange(files, *order) if files else stored.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode(mode).partitionBy("dt").parquet(path)


def read_table(
    spark: SparkSession,
    path: str,
    table: str,
    *,
    start=None,
    end=None,
    symbols: Sequence[str] | None = None,
    columns: Sequence[str] | None = None,
    ts: str = "ts",
) -> DataFrame:
    """Rows of a time range, both ends included, with decimals as doubles.

    The day is filtered next to the timestamp, as partitions cannot be pruned from the
    timestamp alone. Filters apply to the stored columns, so they reach the scan.
    """
    schema = TABLES[table].schema.add("dt", "date")
    df = spark.read.schema(schema).parquet(path)
    for bound, compare in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            limit = instant(bound)
            df = df.where(compare(F.col("dt"), limit.cast("date")) & compare(F.col(ts), limit))
    if symbols is not None:
        df = df.where(F.col("symbol").isin([s.upper() for s in symbols]))
    wanted = list(columns) if columns else [c for c in df.columns if c != "dt"]
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.select(
        *(F.col(c).cast("double").alias(c) if types[c] == "decimal" else F.col(c) for c in wanted)
    )
