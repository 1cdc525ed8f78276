"""Centroid clustering over subvector dictionaries.

Vectors become integers, floor(scale * x), and are kept in containers of at most ``CONTAINER``
vectors. A container cuts the dimensions into blocks of ``width`` and holds each distinct
subvector of a block once, in the block's dictionary; a vector is one code a block, and nothing is
lost by that. A round computes the exact squared distance of each dictionary entry to each
centroid's part of the block once, and a vector's distance is the sum of the entries its codes
name. New centroids come from how often a cluster uses each code, so a round never unpacks a
vector either.

Containers are written once and never shuffled. A round sends a row for each task and cluster;
the driver sees the sums of the clusters, which are as many numbers as the centroids have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelens.llm.common import map_batches, written

#: Vectors of a container: their codes and their distances to all centroids are held together.
CONTAINER = 32_768
#: Components from here on could give squared distances that fit no 64-bit integer.
TOO_LARGE = 1 << 27

_CONTAINERS = "ids binary, named binary, widths array<int>, codes array<binary>, entries array<binary>"


def integers(df: DataFrame, dims: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``, floor(scale * x) as longs, of the rows with ``dims`` finite components."""
    good = "size(embedding) = {} and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    kept = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = kept.where(good.format(dims))
    large = f"exists(embedding, x -> abs(x) >= {TOO_LARGE / scale - 1!r}D)"
    fault = F.raise_error(F.lit(f"a component of {TOO_LARGE / scale:.0f} or more has no exact distance"))
    return kept.select("vec_id", F.when(F.expr(large), fault.cast("array<bigint>")).otherwise(F.expr(f"transform(embedding, x -> floor({scale} * x))")).alias("v"))


def _container(ids: np.ndarray, named: np.ndarray, vectors: np.ndarray, width: int) -> list:
    """One row: the ids, and for each block its codes and its distinct subvectors."""
    widths, codes, entries = [], [], []
    for lo in range(0, vectors.shape[1], width):
        distinct, code = np.unique(vectors[:, lo : lo + width], axis=0, return_inverse=True)
        widths.append(distinct.shape[1])
        codes.append(code.reshape(-1).astype(np.uint16).tobytes())
        entries.append(distinct.astype(np.int32).tobytes())
    return [ids.tobytes(), np.packbits(named).tobytes(), widths, codes, entries]


def encoded(vectors: DataFrame, dims: int, width: int) -> DataFrame:
    """The containers of ``vectors``; each task fills its own and the last one of it may be small."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(held: list) -> pa.RecordBatch:
            found = _container(*(np.concatenate([h[i] for h in held]) for i in range(3)), width)
            types = [pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, types, strict=True)], names=["ids", "named", "widths", "codes", "entries"])

        held, n = [], 0
        for batch in batches:
            ids = batch.column("vec_id")
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            if n and n + len(named) > CONTAINER:
                yield row(held)
                held, n = [], 0
            held.append((ids.fill_null(0).to_numpy().astype(np.int64), named, v))
            n += len(named)
        if n:
            yield row(held)

    return map_batches(vectors, job, _CONTAINERS)


class Container:
    """A container as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.ids = np.frombuffer(batch.column("ids")[i].as_buffer(), np.int64)
        self.named = np.unpackbits(np.frombuffer(batch.column("named")[i].as_buffer(), np.uint8), count=len(self.ids)).astype(bool)
        widths = batch.column("widths")[i].as_py()
        self.codes = [np.frombuffer(c.as_buffer(), np.uint16).astype(np.intp) for c in batch.column("codes")[i]]
        self.entries = [
            np.frombuffer(e.as_buffer(), np.int32).astype(np.int64).reshape(-1, w) for e, w in zip(batch.column("entries")[i], widths, strict=True)
        ]

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cluster of each vector and its squared distance; ties go to the smaller number."""
        total = np.zeros((len(self.ids), len(centroids)), np.int64)
        lo = 0
        for codes, entries in zip(self.codes, self.entries, strict=True):
            total += _distances(entries, centroids[:, lo : lo + entries.shape[1]])[codes]
            lo += entries.shape[1]
        best = total.argmin(axis=1)
        return best, total[np.arange(len(best)), best]

    def sums(self, cluster: np.ndarray, k: int) -> np.ndarray:
        """The sum of each cluster's vectors, from how often it uses each code."""
        parts = []
        for codes, entries in zip(self.codes, self.entries, strict=True):
            used = np.bincount(cluster * len(entries) + codes, minlength=k * len(entries)).reshape(k, len(entries))
            parts.append(used @ entries)
        return np.concatenate(parts, axis=1)


def _distances(entries: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of dictionary entries to the centroids' parts of the block."""
    out = np.zeros((len(entries), len(centroids)), np.int64)
    for d in range(entries.shape[1]):
        gap = entries[:, d, None] - centroids[None, :, d]
        out += gap * gap
    return out


def _sums(containers: DataFrame, centroids: np.ndarray) -> list:
    """(cluster, n, inertia, component sums) of the clusters that have vectors: at most a row each."""
    k, dims = centroids.shape

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = np.zeros(k, np.int64), [0] * k, np.zeros((k, dims), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                held = Container(batch, i)
                cluster, distance = held.nearest(centroids)
                n += np.bincount(cluster, minlength=k)
                sums += held.sums(cluster, k)
                # Halves of 32 bits: no sum of a container leaves 64 bits.
                high, low = np.zeros(k, np.int64), np.zeros(k, np.int64)
                np.add.at(high, cluster, distance >> 32)
                np.add.at(low, cluster, distance & 0xFFFFFFFF)
                inertia = [a + (int(h) << 32) + int(b) for a, h, b in zip(inertia, high, low, strict=True)]
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()), pa.array(n[used]),
                pa.array([str(inertia[c]) for c in used]),
                pa.array(sums[used].tolist(), pa.list_(pa.int64())),
            ],
            names=["cluster", "n", "inertia", "sums"],
        )

    told = map_batches(containers, job, "cluster int, n long, inertia string, sums array<long>")
    whole = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    return told.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *whole).collect()


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; equal ids by their
    components, rows without an id last."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    rows = named.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def cluster(df: DataFrame, k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, seed: int = 2, width: int = 2) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors are the rows with exactly ``dims`` components, none null or non-finite, as integers
    floor(scale * x). Centroids start as ``k`` of them (all, if fewer). Each of ``rounds`` rounds
    puts every vector to its nearest centroid (squared Euclidean distance, ties to the smaller
    number) and replaces a centroid that has vectors by floor(sum / count) of their components;
    the others stay. Then vectors are put to centroids once more. Distances and sums are exact.

    Each row is a vector of its own, also where rows repeat; a null ``vec_id`` is a vector
    that starts as a centroid only where named ones are too few. A component of 2**27 or more
    after scaling raises, as its distances would leave 64 bits. No vectors give no rows.
    Other columns are ignored.
    """
    spark = df.sparkSession
    vectors = integers(df, dims, scale)
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], schema)
    containers = written(encoded(vectors, dims, width), "containers")
    for _ in range(rounds):
        for row in _sums(containers, centroids):
            centroids[row.cluster] = [int(row[f"s{d}"]) // row.n for d in range(dims)]
    inertia = {row.cluster: int(row.inertia) for row in _sums(containers, centroids)}
    whole = sum(inertia.values())
    own = np.array([inertia.get(c, 0) for c in range(len(centroids))], np.int64)
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held = Container(batch, i)
                found, distance = held.nearest(centroids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(held.ids, mask=~held.named), pa.array(found.astype(np.int32)), pa.array(distance), pa.array(own[found]),
                        pa.array(np.full(len(found), whole, np.int64)), pa.array(prints).take(pa.array(found)),
                    ],
                    names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
                )

    return map_batches(containers, job, schema)
