"""Run a streaming query over what its source holds and read the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from strikelens.session import ensure_checkpoint_dir

#: The state store of operators that keep several named states or take an initial one.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/strikelens-{uuid.uuid4().hex}"


@contextmanager
def state_store(spark: SparkSession, provider: str | None):
    """Start queries on a state store; the session's own choice comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        if provider and before is None:
            spark.conf.unset(name)
        elif provider:
            spark.conf.set(name, before)


class Feed:
    """A folder of files and the stream of what is put there, in any number of files a step."""

    def __init__(self, spark: SparkSession, schema: StructType) -> None:
        self.path = shared_folder(spark)
        spark.createDataFrame([], schema).write.parquet(self.path)
        self.stream = spark.readStream.schema(schema).parquet(self.path)

    def put(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)


def _run(stream: DataFrame, home: str) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{home}/rows")
        .option("checkpointLocation", f"{home}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def drain(
    stream: DataFrame,
    *,
    files_to: str | None = None,
    steps: Iterable[Callable[[], None]] = (lambda: None,),
    store: str | None = None,
) -> DataFrame:
    """Process all available input in append mode and return the rows written.

    After each of ``steps``, such as a :meth:`Feed.put`, the query is started anew from its
    checkpoint and works off what has come.
    """
    spark = stream.sparkSession
    home = files_to or shared_folder(spark)
    with state_store(spark, store):
        for step in steps:
            step()
            _run(stream, home)
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def drain_closed(
    source: DataFrame, build: Callable[[DataFrame], DataFrame], *, hold: str, ts: str = "ts", **values
) -> DataFrame:
    """:func:`drain` of ``build(source)`` to the end of a bounded source: no window stays open.

    Once the source is worked off, one closing marker comes through a second folder. It is a row
    of nulls (or of ``values``, where the operator drops rows that lack them) that lies ``hold``
    after all others. The watermark then passes every window once; only the marker's own stays
    open. ``hold`` has to be longer than the operator's windows and lateness together.
    """
    spark = source.sparkSession
    marks, home = Feed(spark, source.schema), shared_folder(spark)
    stream = build(source.unionByName(marks.stream))
    query = _run(stream, home)
    times = [
        told[name]
        for progress in query.recentProgress
        if (told := progress["eventTime"])
        for name in ("max", "watermark")
        if name in told
    ]
    newest = max((datetime.fromisoformat(t) for t in times), default=None)
    if newest is not None and newest.timestamp() > 0:
        at = F.timestamp_micros(F.lit(round(newest.timestamp() * 1_000_000))) + F.expr(f"INTERVAL {hold}")
        marker = (
            (at if f.name == ts else F.lit(values.get(f.name))).cast(f.dataType).alias(f.name)
            for f in source.schema.fields
        )
        marks.put(spark.range(1).select(*marker))
        _run(stream, home)
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def drain_batches(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    *,
    steps: Iterable[Callable[[], None]] = (lambda: None,),
    progress: str | None = None,
) -> None:
    """Hand all available input to a ``foreachBatch`` function, after each of ``steps``."""
    home = progress or shared_folder(stream.sparkSession)
    for step in steps:
        step()
        query = (
            stream.writeStream.foreachBatch(write)
            .option("checkpointLocation", home)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
