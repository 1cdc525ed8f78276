"""Writing rows that may repeat: merge rules, batch appends, upserts, retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from strikelens.functions.columns import instant
from strikelens.schemas import TABLES, to_storage


def merge_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with the newest non-null value of each column."""
    # One order column keeps the aggregate's buffers at a fixed width, so it hashes.
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        *(
            F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c)
            for c in values
        )
    ).select(*df.columns)


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole newest row per key."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def _overwrite_partitions(df: DataFrame, path: str, partitions: Sequence[str]) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def batch_sink(
    path: str, table: str, *, order: Sequence[str], ts: str = "ts"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that appends a merged micro-batch.

    ``order`` names the columns that say which of two rows of one key came later, such as an
    arrival number; columns of the key cannot tell them apart and are refused. Each batch owns its folder and replaces it when Spark runs the batch again, so a retry
    adds nothing. Rows of one key in several batches are resolved by :func:`read_merged`.
    """
    key = TABLES[table].key
    if not order or set(order) & set(key):
        raise ValueError(f"order {tuple(order)} must be outside the key {tuple(key)}")

    def write(batch: DataFrame, batch_id: int) -> None:
        merged = merge_rows(batch, key, order)
        stamped = to_storage(merged, table).withColumns(
            {"dt": F.to_date(ts), "batch": F.lit(batch_id)}
        )
        _overwrite_partitions(stamped, path, ["dt", "batch"])

    return write


def read_merged(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The table behind :func:`batch_sink`: later batches win, value by value."""
    stored = spark.read.parquet(path)
    merged = merge_rows(stored, TABLES[table].key, ["batch"])
    return merged.select(*TABLES[table].schema.names)


def stored_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None while nothing has been written; other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def append_metrics(metrics: DataFrame, path: str, batch: int) -> None:
    """Store the metric rows of one computation as batch ``batch`` of their days.

    Nothing stored is read or rewritten, so a tick costs what it brings and writers of different
    batches don't meet; a batch that runs again replaces itself. :func:`read_metrics` resolves
    rows of one key.
    """
    stamped = to_storage(metrics, "computed_metrics").withColumns(
        {"dt": F.to_date("ts"), "batch": F.lit(batch)}
    )
    _overwrite_partitions(stamped, path, ["dt", "batch"])


def read_metrics(spark: SparkSession, path: str, *, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """The stored metric rows, of the days from ``first`` to ``last``: the latest batch of each key."""
    stored = spark.read.parquet(path)
    for bound, compare in ((first, "__ge__"), (last, "__le__")):
        if bound is not None:
            stored = stored.where(getattr(F.col("dt"), compare)(bound.cast("date")))
    newest = newest_rows(stored.drop("dt"), TABLES["computed_metrics"].key, ["batch"])
    return newest.select(*TABLES["computed_metrics"].schema.names)


def append_new_events(events: DataFrame, path: str) -> None:
    """Store flow events whose id is not stored yet. Only the days of the batch are read.

    The batch's first and last day go into the read as literals, so the folders of other days
    are not even listed for the scan.
    """
    spark = events.sparkSession
    fresh = to_storage(events, "flow_events").withColumn("dt", F.to_date("ts"))
    fresh = fresh.dropDuplicates(["event_id"]).persist()
    try:
        first, last = fresh.agg(F.min("dt"), F.max("dt")).first()
        old = stored_or_none(spark, path)
        if first is not None and old is not None:
            seen = old.where(F.col("dt").between(F.lit(first), F.lit(last))).select("dt", "event_id")
            fresh.join(seen, ["dt", "event_id"], "left_anti").write.mode("append").partitionBy("dt").parquet(path)
        elif first is not None:
            fresh.write.mode("append").partitionBy("dt").parquet(path)
    finally:
        fresh.unpersist()


def upsert_open_interest(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored open interest with the rows of a new load replacing theirs."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    return newest_rows(both, TABLES["eod_open_interest"].key, ["_new", "updated_at"]).drop("_new")


def retained(df: DataFrame, table: str, *, as_of, ts: str = "ts") -> DataFrame:
    """The rows young enough to keep."""
    days = TABLES[table].keep_days
    if days is None:
        return df
    return df.where(F.col(ts) >= instant(as_of) - F.expr(f"INTERVAL {days} DAYS"))


def _day_folders(spark: SparkSession, path: str):
    """(day, folder) of a table laid out by day, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith("dt="):
            yield files, name.removeprefix("dt="), status.getPath()


def drop_expired(spark: SparkSession, path: str, table: str, *, as_of: dt.date) -> list[str]:
    """Drop the expired days of a table that these sinks write. Only day names are listed."""
    days = TABLES[table].keep_days
    if days is None:
        return []
    oldest = (as_of - dt.timedelta(days=days)).isoformat()
    dropped = []
    for files, day, folder in _day_folders(spark, path):
        if day < oldest and files.delete(folder, True):
            dropped.append(day)
    return sorted(dropped)


def compact(spark: SparkSession, path: str, table: str, *, day: dt.date, batch: int = -1) -> None:
    """Rewrite the batches of one finished day as one, merged as :func:`read_merged` does.

    The merged rows are batch ``batch``; the folders of the others go once they are written, so a
    reader in between sees a value twice, never not at all.
    """
    merged = merge_rows(
        spark.read.parquet(path).where(F.col("dt") == F.lit(day)), TABLES[table].key, ["batch"]
    )
    stamped = merged.select(*TABLES[table].schema.names).withColumns(
        {"dt": F.lit(day), "batch": F.lit(batch)}
    )
    _overwrite_partitions(stamped, path, ["dt", "batch"])
    for files, name, folder in _day_folders(spark, path):
        if name == day.isoformat():
            for status in files.listStatus(folder):
                if status.getPath().getName() not in (f"batch={batch}", "_SUCCESS"):
                    files.delete(status.getPath(), True)
