"""Near copies by the exact Jaccard similarity of their shingles; fingerprints and MinHash tables find candidates.

Candidates come from SimHash (:mod:`strikelens.llm.simhash`): fingerprints of three-word shingles that
differ in few bits, by its covering tables. Texts can be similar with fingerprints further apart, and
for these there are MinHash tables. What either finds is judged by the full sets.

A text is the set of its shingles. Texts that agree in a whole row of minima of some table are
candidates; a candidate pair is a link only if the similarity of the two full sets is high enough.
With 30 tables of 5 minima a pair at similarity 0.8 shares none of them with a chance of 7 in a
million, and a pair above it with a smaller one.

A crowded table row isn't compared pair by pair: its texts are first compared with two of them,
and only texts that are still in different components afterwards are compared with each other.
Pairs inside a component can't change it, so nothing is lost by that. Of these pairs most are told
apart by the parities of their sets: where these differ in more bits than the limit allows the
sets to differ in shingles, the pair is no link, and no set has to be fetched for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelens.llm import simhash
from strikelens.llm.common import KEPT, Rolling, WordHashes, documents, map_batches, mixed, renamed, written
from strikelens.llm.components import components

SHINGLE, LEAST = 5, Fraction(4, 5)
TABLES, MINIMA = 30, 5
#: Shingles whose minima are taken at once.
PIECE = 256
#: Bits of a set's parities; a shingle flips one of them.
PARITIES = 2048

#: Words a worker remembers: a table for the most frequent ones, which the next stage's workers don't miss.
_hashes = WordHashes(150_000)
KEPT[__name__] = _hashes.clear


def _factors() -> np.ndarray:
    """An odd number for each minimum."""
    return mixed(np.arange(1, TABLES * MINIMA + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(text: str, rolling: Rolling, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; only A-Z are lower-cased.

    Fewer words than a shingle make one shingle; no words make none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(_hashes.of(words), min(shingle, len(words))))


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The table keys of a set: a hash over ``MINIMA`` minima each."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(found), PIECE):
        # The high bits of a product, which decide, depend on all bits of the hash.
        least = np.minimum(least, np.multiply.outer(factors, found[lo : lo + PIECE]).min(axis=1))
    rows = least.reshape(TABLES, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), t) for t, r in enumerate(rows)], np.uint64).view(np.int64)


def parities(found: np.ndarray) -> np.ndarray:
    """Which of ``PARITIES`` cells hold an odd number of shingles: two sets differ in at least as many
    shingles as these differ in bits."""
    cells = np.bincount((mixed(found) >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=PARITIES)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _digest(found: np.ndarray) -> int:
    value = xxhash.xxh64_intdigest(found.tobytes())
    return value - (1 << 64) if value >> 63 else value


def signatures(df: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` (a hash of the whole set), ``size``, ``keys``, ``parities`` and ``mark`` (the SimHash
    fingerprint as a signed long; null without words), a row for each row."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, factors = Rolling(), _factors()
        for batch in batches:
            sets = [shingles(t.as_py(), rolling) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([_digest(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([minima(s, factors).tolist() if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([simhash.signed_fingerprint(t.as_py()) if len(s) else None for t, s in zip(batch.column("text"), sets, strict=True)], pa.int64()),
                ],
                names=["doc_id", "fp", "size", "keys", "parities", "mark"],
            )

    return map_batches(documents(df), job, "doc_id long, fp long, size long, keys array<long>, parities array<long>, mark long")


def marked_alike(marks: DataFrame) -> DataFrame:
    """Candidate pairs a and b (structs of ``fp`` and ``least``) by the fingerprints of ``marks`` (``fp``, ``least``, ``mark``).

    One text stands for a fingerprint; the others of equal fingerprints are compared with it.
    """
    text = F.struct("fp", "least")
    marks = marks.where("mark is not null")
    heads = written(marks.groupBy("mark").agg(F.min(text).alias("head")), "heads")
    same = marks.join(heads.hint("merge"), "mark").select(text.alias("a"), F.col("head").alias("b"))
    near = simhash.links(heads.select(F.col("mark").alias("fp")))
    for side, name in (("u", "a"), ("v", "b")):
        near = near.join(heads.select(F.col("mark").alias(side), F.col("head").alias(name)).hint("merge"), side)
    return same.where("a.fp != b.fp").union(near.select("a", "b").where("a.fp != b.fp"))


def sets_of(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """``fp`` and its ``items`` for the rows (``fp``, ``least``) of ``wanted``, a text's own id."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            sets = [shingles(t.as_py(), rolling) for t in batch.column("text")]
            right = [_digest(s) == fp for s, fp in zip(sets, batch.column("fp").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_digest(s) for s, r in zip(sets, right, strict=True) if r], pa.int64()),
                    pa.array([s.view(np.int64) for s, r in zip(sets, right, strict=True) if r], pa.list_(pa.int64())),
                ],
                names=["fp", "items"],
            )

    texts = documents(df).join(wanted.withColumnRenamed("least", "doc_id").hint("shuffle_hash"), "doc_id").select("fp", "text")
    return map_batches(texts, job, "fp long, items array<long>").dropDuplicates(["fp"])


def verified(pairs: DataFrame, sets: DataFrame, least: Fraction = LEAST) -> DataFrame:
    """The pairs (u, v) whose sets have a similarity of ``least`` or more, counted exactly."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = (s.values.to_numpy() for s in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    held = (
        pairs.join(sets.select(F.col("fp").alias("u"), F.col("items").alias("a")).hint("merge"), "u")
        .join(sets.select(F.col("fp").alias("v"), F.col("items").alias("b")).hint("merge"), "v")
        .select("u", "v", "a", "b")
    )
    return map_batches(held, job, "u long, v long")


def links(df: DataFrame, classes: DataFrame, marks: DataFrame) -> DataFrame:
    """Links (u, v) between the ``fp`` of ``classes`` whose closure is that of all candidate pairs
    at a similarity of ``LEAST`` or more. ``classes`` has ``fp``, ``least``, ``size``, ``keys`` and ``parities``,
    ``marks`` their fingerprints (``fp``, ``least``, ``mark``).

    Shingles that no other candidate has are in no intersection: what two texts can have in common
    is at most the rest of either, and pairs for which that is too little are never compared.
    """
    rows = classes.select("fp", "least", "size", F.posexplode("keys").alias("t", "key"))
    several = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(rows.join(several.hint("merge"), ["t", "key"]).drop("n"), "met")
    alike_marks = written(marked_alike(marks), "marked")
    held = met.select("fp", "least").union(alike_marks.select("a.*")).union(alike_marks.select("b.*"))
    sets = written(sets_of(df, held.distinct()), "sets")
    owners = sets.select("fp", F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"), F.min("fp").alias("fp"))
    lone = owners.where("n = 1").groupBy("fp").agg(F.count("*").alias("lone"))
    met = met.join(lone.hint("merge"), "fp", "left").select("t", "key", "fp", "size", (F.col("size") - F.coalesce("lone", F.lit(0))).alias("common"))
    met = written(met.where(f"{LEAST.denominator} * common >= {LEAST.numerator} * size"), "met")

    def may(a: str, b: str) -> str:
        both = f"least({a}.common, {b}.common)"
        return f"{LEAST.denominator} * {both} >= {LEAST.numerator} * ({a}.size + {b}.size - {both})"

    # Two texts stand for a table row: any one, another in each table, and that with least of its own.
    text = F.struct("fp", "size", "common")
    heads = met.groupBy("t", "key").agg(
        F.array(F.min_by(text, F.xxhash64("fp", "t")), F.min_by(text, F.struct(-F.col("common") / F.col("size"), F.col("fp")))).alias("heads")
    )
    star = met.alias("a").join(heads.hint("merge"), ["t", "key"]).select("a.*", F.explode("heads").alias("b"))
    star = star.select(text.alias("a"), "b").where(F.expr("a.fp != b.fp and " + may("a", "b")))
    star = star.select("a.fp", F.col("b.fp").alias("other")).union(alike_marks.select("a.fp", "b.fp"))
    star = star.select(F.struct("fp").alias("a"), F.struct(F.col("other").alias("fp")).alias("b"))
    near = written(verified(_ordered(star), sets), "near")
    rooted = met.join(components(near).withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "fp")), "rooted")
    apart = rooted.groupBy("t", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    left = rooted.join(apart.hint("merge"), ["t", "key"]).select(*rooted.columns)
    left = left.join(classes.select("fp", "parities").hint("merge"), "fp")
    # Similar sets differ in at most this share of both their sizes; parities are looked at last.
    bits = "aggregate(zip_with(a.parities, b.parities, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    alike = f"{LEAST.denominator + LEAST.numerator} * {bits} <= {LEAST.denominator - LEAST.numerator} * (a.size + b.size)"
    rest = left.alias("a").join(
        left.alias("b").hint("merge"),
        F.expr(f"a.t = b.t and a.key = b.key and a.root != b.root and a.fp < b.fp and {may('a', 'b')} and {alike}"),
    )
    return near.union(verified(_ordered(rest), sets))


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct (u, v), u below v, of pairs a and b."""
    return pairs.select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v")).distinct()


def first_of_each(df: DataFrame) -> DataFrame:
    """``df`` with one document of each group of near copies, that of the smallest ``doc_id``; same columns.

    Groups are the components of links between texts whose sets of five-word shingles have a
    Jaccard similarity of 0.8 or more; texts without words are copies of each other. Of rows that
    share a kept ``doc_id`` one stays. Rows without ``doc_id`` all stay and link nothing: there is
    no telling them apart by name.
    """
    rows, name = renamed(df)
    own = rows.select(F.col(name["doc_id"]).cast("long").alias("doc_id"), F.col(name["text"]).alias("text")).where("doc_id is not null")
    marked = written(signatures(own), "signatures")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("parities").alias("parities"))
    classes = written(classes, "classes")
    marks = marked.select("fp", "mark").distinct().join(classes.select("fp", "least").hint("merge"), "fp")
    roots = components(links(own, classes, marks))
    rooted = classes.select("fp", "least").join(roots.hint("merge"), F.col("fp") == F.col("node"), "left")
    ids = rooted.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("kept_id"))
    # An id may stand for texts of several groups; only rows that share an id are compared.
    shared = marked.groupBy("doc_id").agg(F.count("*").alias("n"))
    ids = ids.select("kept_id").distinct().join(shared.hint("merge"), F.col("kept_id") == F.col("doc_id")).select("kept_id", "n")
    named = rows.join(ids.hint("merge"), F.col(name["doc_id"]).cast("long") == F.col("kept_id"))
    single = named.where("n = 1").select(rows.columns)
    repeated = named.where("n > 1").dropDuplicates(["kept_id"]).select(rows.columns)
    nameless = rows.where(F.col(name["doc_id"]).cast("long").isNull())
    return single.union(repeated).union(nameless).toDF(*df.columns)
