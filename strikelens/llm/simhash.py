"""Near duplicates by SimHash fingerprints and covering locality-sensitive hashing.

For radius r, every bit position gets a non-zero vector of r + 1 bits; the table of vector v
keeps the positions whose vector has an odd product with v. Up to r positions span at most r
dimensions, so some v is orthogonal to all of them: every pair within the radius agrees in the
kept bits of some table. No pair can be missed, which banding does not promise.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelens.llm.common import documents, map_batches, renamed, written
from strikelens.llm.components import components

BITS = 64
#: How often each byte value sets each of its bits.
_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)
#: Shingles hashed at once; long texts go piece by piece.
PIECE = 200_000


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text as an unsigned number: a bit is set if over half the hashes set it.

    Only A-Z are lower-cased. Fewer words than a shingle make one shingle; no words make 0.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
    if not words:
        return 0
    shingle = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    starts, ends = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, n, PIECE):
        hi = min(lo + PIECE, n)
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)], "<u8")
        rows = hashes.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[8 * byte : 8 * byte + 8] += np.bincount(rows[:, byte], minlength=256) @ _BITS_OF_BYTE
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def signed_fingerprint(text: str) -> int:
    return _signed(fingerprint(text))


def fingerprints(df: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long), a row for each row."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle, seed)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return map_batches(documents(df), job, "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """2 ** (radius + 1) - 1 bit masks; any ``radius`` positions lie outside at least one of them."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, n + 1)]


def links(fps: DataFrame, radius: int = 2, pairwise: int = 256) -> DataFrame:
    """Links (u, v) between distinct ``fp`` whose closure is that of all pairs within ``radius``.

    No side of a join is broadcast: all of them grow with the corpus. Tables of the covering hash gather candidates. Buckets of at most ``pairwise`` fingerprints
    compare their pairs; a pair counts in the first table that brings it together. In larger ones every fingerprint is hung on each point within half the
    radius of it, and those of one point on their smallest: they lie within the radius of each
    other, and two fingerprints within the radius always share such a point. That is exact, and
    linear in the size of a bucket. ``radius`` must be even.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    rows = fps.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
        ).alias("b"),
    ).select("fp", "b.t", "b.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(sizes.hint("merge"), ["t", "key"])
    few = met.where(F.col("n") <= pairwise).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    listed = f"array({', '.join(f'{_signed(m)}L' for m in masks)})"
    pair = f"""flatten(transform(fps, (x, i) -> transform(
        filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {radius}
            and forall(slice({listed}, 1, t), m -> ((x ^ y) & m) != 0)),
        y -> named_struct('u', x, 'v', y))))"""
    close = few.select(F.explode(F.expr(pair)).alias("p")).select("p.u", "p.v")
    crowd = met.where(F.col("n") > pairwise).select("fp").distinct()
    flips = [0] + [sum(1 << i for i in c) for n in range(1, radius // 2 + 1) for c in combinations(range(BITS), n)]
    points = crowd.select(
        "fp", F.explode(F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), lambda f: F.col("fp").bitwiseXOR(f))).alias("at")
    )
    least = points.groupBy("at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
    starred = points.join(least.hint("merge"), "at").select("u", F.col("fp").alias("v")).where("u != v")
    return close.union(starred).distinct()


def near_duplicates(df: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, a row for each row.

    Fingerprints within ``radius`` differing bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable. Null and empty texts have fingerprint 0, linked like any other.
    Repeated rows are one class. Rows without ``doc_id`` get a component like others but never
    name one; a component of such rows alone has none (null). Copies are never compared: only
    distinct fingerprints are, and components are found on them.
    """
    marked = written(fingerprints(df, shingle, seed), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named.hint("merge"), "root").select("fp", "component_id")
    return marked.join(by_fp.hint("merge"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def first_of_each(df: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``df`` with one document of each component, that of the smallest ``doc_id``; same columns.

    Of rows that share this ``doc_id`` one stays. Rows without ``doc_id`` all stay: there is no
    telling them apart by name.
    """
    found = near_duplicates(df, radius, shingle, seed)
    ids = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = ids.select(F.col("doc_id").alias("kept_id"), "n")
    rows, name = renamed(df)
    named = rows.join(ids, F.col(name["doc_id"]).cast("long") == F.col("kept_id"))
    single = named.where("n = 1").select(rows.columns)
    # Only rows that share an id are compared with each other.
    repeated = named.where("n > 1").dropDuplicates(["kept_id"]).select(rows.columns)
    nameless = rows.where(F.col(name["doc_id"]).isNull())
    return single.union(repeated).union(nameless).toDF(*df.columns)
