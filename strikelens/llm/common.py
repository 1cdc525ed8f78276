"""What the operators share: words, word hashes, rolling hashes, shared folders, batch mapping."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strikelens.session import ensure_checkpoint_dir, ship_package

#: Odd bases of two polynomial hashes over words.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Words a worker remembers before it starts anew.
REMEMBERED = 1_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as Parquet in the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a job sees at once: whole texts, and what is made of them, are held together.
ROWS = 256
BATCH_BYTES = 8 << 20
#: What a worker keeps from task to task, by the module that keeps it, and how to drop it.
KEPT: dict[str, Callable[[], None]] = {}
_last_owner: list[str] = []


def _only(owner: str) -> None:
    """Drop what other modules than ``owner`` keep in this worker, and give the memory back.

    Freed memory otherwise stays with the worker, beside the executor's heap, for all later jobs.
    """
    if _last_owner == [owner]:
        return
    for module, drop in KEPT.items():
        if module != owner:
            drop()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: there is nothing to ask for
        pass
    _last_owner[:] = [owner]


def map_batches(
    df: DataFrame, job: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with this package on the workers.

    Workers live on between jobs; one that begins a job drops what other modules have kept, so
    that the tables of one operator don't stand beside those of the next. A job gets ``ROWS``
    rows at a time. Arrow's batches are limited to ``BATCH_BYTES`` in the session, where it has
    no lower limit: rows here are texts, and ten thousand of them are no small buffer.
    """
    spark = df.sparkSession
    ship_package(spark)
    for name, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", 4 * ROWS)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, str(most))
    owner = job.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _only(owner)
        yield from job(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))

    return df.mapInArrow(run, schema)


def renamed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` under column names that clash with nothing, and the new name of each old one.

    ``toDF(*df.columns)`` on the new columns, in their order, gives the old names back.
    """
    names = [f"column_{i}_of_input" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) and the named columns, without any others."""
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def words_of(text: str) -> list[bytes]:
    """Maximal runs of anything but space and the control characters 9 to 13, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """XXH64 of words, of which at most ``most`` are remembered."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Rolling:
    """Hashes of all windows of ``n`` items in linear time: a polynomial modulo 2**64, then mixed."""

    def __init__(self, base: int = BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            n = max(n, 2 * len(self.powers))
            steps = np.full(n, self.base, dtype=np.uint64)
            steps[0] = 1
            self.powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = self.inverse
            self.inverses = np.cumprod(steps, dtype=np.uint64)

    def __call__(self, items: np.ndarray, n: int) -> np.ndarray:
        if len(items) < n:
            return np.empty(0, dtype=np.uint64)
        self._grow(len(items) + 1)
        sums = np.zeros(len(items) + 1, dtype=np.uint64)
        np.cumsum(items * self.powers[: len(items)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[n:] - sums[:-n]) * self.inverses[: len(items) - n + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def covered(n_items: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``n_items`` lie in a window of ``length`` that begins at one of ``starts``."""
    change = np.zeros(n_items + length + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:n_items]) > 0
