"""Windows that are told once they close, and told again when a late row corrects them.

Spark drops what comes behind the watermark. Here such rows are kept in a side table, and the
windows that they touch are told again with them. A batch adds its sums by window to a small table
of parts; a window is the sum of its parts, so neither closing nor correcting reads the tape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strikelens.operators import flow
from strikelens.sources.sinks import stored_or_none
from strikelens.streaming.alerts import known_before, remember

SUMS = ("call_premium", "put_premium")


def _replace(df: DataFrame, path: str, *partitions: str) -> None:
    """Overwrite the partitions that ``df`` has rows for."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def _micros(interval: str) -> int:
    amount, unit = interval.split()
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return int(amount) * seconds * 1_000_000


def corrected_premiums(
    path: str, *, bucket: str = "1 minute", late: str = "2 minutes"
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function for signed premiums per bucket, below ``path``.

    ``rows`` has a bucket when its end is ``late`` behind the newest print of the batches so far,
    and again under the later batch's number when a print of it comes after that. Such prints
    are in ``late``. All of a batch's folders carry its number and are replaced when it runs
    again, and its clock stands in a slot of its own, so a retry changes nothing. Buckets may be
    seconds, minutes, hours or one day long. Prints without a time or a side are in no bucket.
    """
    length, wait = _micros(bucket), _micros(late)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        clock = known_before(spark, f"{path}/clock", batch_id)
        last = clock.first() if clock is not None else None
        before = last.newest_us if last is not None else None
        sided = batch.where(F.coalesce("side", F.lit(0)) != 0).where(F.col("ts").isNotNull())
        start = F.unix_micros("ts") - F.pmod(F.unix_micros("ts"), F.lit(length))
        seen = sided.agg(F.max(F.unix_micros("ts"))).first()[0]
        newest = max((x for x in (seen, before) if x is not None), default=None)
        if newest is None:
            return
        told = None if before is None else before - wait
        remember(spark.createDataFrame([(newest,)], "newest_us bigint"), f"{path}/clock", batch_id)
        if seen is None:
            return
        fresh = flow.premium_buckets(sided, bucket=bucket).withColumns(
            {"dt": F.to_date("ts"), "batch": F.lit(batch_id)}
        )
        _replace(fresh, f"{path}/parts", "dt", "batch")
        parts = spark.read.parquet(f"{path}/parts").where(F.col("batch") <= batch_id)
        end = F.unix_micros("ts") + length
        closing = end <= newest - wait
        if told is not None:
            closing = closing & (end > told)
            closing = closing & (F.col("dt") >= F.to_date(F.timestamp_micros(F.lit(told - length))))
        due = parts.where(closing)
        behind = sided.where(start + length <= told) if told is not None else sided.limit(0)
        _replace(behind.withColumn("batch", F.lit(batch_id)), f"{path}/late", "batch")
        if told is not None:
            touched = behind.select("symbol", F.timestamp_micros(start).alias("ts")).distinct()
            low, high = touched.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
            if low is not None:  # the days go into the read as literals
                days = parts.where(F.col("dt").between(F.lit(low), F.lit(high)))
                due = due.unionByName(days.join(touched, ["symbol", "ts"], "left_semi"))
        _replace(_summed(due).withColumn("batch", F.lit(batch_id)), f"{path}/rows", "batch")

    return write


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("symbol", "ts").agg(*(F.sum(c).alias(c) for c in SUMS))


def corrected_rows(spark: SparkSession, path: str, *, bucket: str, late: str, ended: bool = False) -> DataFrame:
    """The newest telling of each bucket, and how often it was told before (``revisions``).

    When the source has ended, the buckets that were still open come with it.
    """
    told = spark.read.parquet(f"{path}/rows")
    newest = told.groupBy("symbol", "ts").agg(
        F.max_by(F.struct(*SUMS), "batch").alias("_sums"), (F.count("*") - 1).alias("revisions")
    ).select("symbol", "ts", "_sums.*", "revisions")
    if not ended:
        return newest
    clock = spark.read.parquet(f"{path}/clock").agg(F.max("newest_us")).first()[0]
    closed = clock - _micros(late) - _micros(bucket)
    parts = spark.read.parquet(f"{path}/parts").where(F.col("dt") >= F.to_date(F.timestamp_micros(F.lit(closed))))
    still = _summed(parts.where(F.unix_micros("ts") > closed)).withColumn("revisions", F.lit(0).cast("bigint"))
    return newest.unionByName(still)


def late_rows(spark: SparkSession, path: str) -> DataFrame | None:
    """The prints that came after their bucket had been told."""
    return stored_or_none(spark, f"{path}/late")
