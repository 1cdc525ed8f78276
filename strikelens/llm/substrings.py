"""Repeated passages across documents by fixed-block anchors.

Every document's non-overlapping blocks of ``window // 2`` words are the index; every rolling
window of a block's length, of every document, probes it. A repeat of ``window`` words or more
always holds a whole block of the other document, so it leaves a hit; hits are extended to the
exact repeats of ``window`` words that touch them, and runs of these are the maximal repeats.

The work moves as hashes, not texts. Documents are dealt into chunks once. A chunk sends each
hash once however often it holds it, to the bucket that owns the hash, and gets back which of
its hashes matter; so a passage that a third of all documents share costs one row a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelens.llm.common import OTHER_BASE, Rolling, WordHashes, covered, words_of
from strikelens.session import ship_package

_SEND = "bucket int, chunk int, keys binary, seen binary, docs binary"
_REPLY = "chunk int, keys binary, docs binary"
_LOW = np.uint64(0xFFFFFFFF)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted distinct 32-bit numbers as differences of 3 bytes, or plainly if one is too wide."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    if steps.max() < 1 << 24:
        return b"\x03" + np.ascontiguousarray(steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    return b"\x04" + keys.astype("<u4").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    if raw[0] == 4:
        return np.frombuffer(raw, "<u4", offset=1).astype(np.uint64)
    steps = np.zeros((len(raw) // 3, 4), np.uint8)
    steps[:, :3] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, 3)
    return np.cumsum(steps.view("<u4").ravel(), dtype=np.uint64)


class _Chunk:
    """The documents of a chunk as word hashes; equal texts are kept once."""

    def __init__(self, table: pa.Table, hashes: WordHashes) -> None:
        self.ids = table["doc_id"].to_pylist()
        self.texts = table["text"]
        self.hashes = hashes

    def words(self) -> Iterator[tuple[int | None, list[bytes]]]:
        for doc_id, text in zip(self.ids, self.texts, strict=True):
            yield doc_id, words_of(text.as_py())

    def distinct(self, least: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(smallest id, largest id, word hashes) of each distinct text of at least so many words."""
        found: dict[bytes, list] = {}
        for doc_id, words in self.words():
            if doc_id is None or len(words) < least:
                continue
            items = self.hashes.of(words)
            known = found.setdefault(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), [doc_id, doc_id, items])
            known[0], known[1] = min(known[0], doc_id), max(known[1], doc_id)
        yield from (tuple(x) for x in found.values())


def _keys(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32-bit remainder of a hash as one number."""
    return (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | (h & _LOW)


def _by_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys."""
    return np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))


def _rows(columns: list[list], schema: str) -> pa.Table:
    names = [c.split(" ") for c in schema.split(", ")]
    types = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(columns, names, strict=True)], names=[n for n, _ in names])


_hashes = WordHashes()


def _probe(window: int, buckets: int):
    """A chunk's probes (every rolling block), which of them two documents share, and its index."""
    block = window // 2

    def job(table: pa.Table) -> pa.Table:
        chunk, rolling = table["chunk"][0].as_py(), Rolling()
        probes, shared, index = [], [], []
        for lowest, highest, items in _Chunk(table, _hashes).distinct(window):
            h = _keys(rolling(items, block), buckets)
            index.append(h[::block])
            own = np.unique(h)
            probes.append(own)
            if lowest != highest:
                shared.append(own)
        if not probes:
            return _rows([[]] * 5, _SEND)
        keys, n = np.unique(np.concatenate(probes), return_counts=True)
        twice = np.unique(np.concatenate([keys[n > 1], *shared]))
        blocks = np.unique(np.concatenate(index))
        cuts = [_by_bucket(x, buckets) for x in (keys, twice, blocks)]
        columns: list[list] = [list(range(buckets)), [chunk] * buckets]
        for x, cut in zip((keys, twice, blocks), cuts, strict=True):
            columns.append([_pack(x[a:b] & _LOW) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        return _rows(columns, _SEND)

    return job


def _hits(table: pa.Table) -> pa.Table:
    """Of one bucket: what was probed by two documents and is a block of one, to whom it concerns."""
    bucket = np.uint64(table["bucket"][0].as_py()) << np.uint64(32)
    probes = [_unpack(x.as_py()) for x in table["keys"]]
    twice = [_unpack(x.as_py()) for x in table["seen"]]
    keys, n = np.unique(np.concatenate(probes), return_counts=True)
    several = np.union1d(keys[n > 1], np.concatenate(twice))
    index = np.unique(np.concatenate([_unpack(x.as_py()) for x in table["docs"]]))
    hit = np.intersect1d(several, index, assume_unique=True)
    out: list[list] = [[], [], []]
    for chunk, own in zip(table["chunk"].to_pylist(), probes, strict=True):
        mine = np.intersect1d(own, hit, assume_unique=True)
        if len(mine):
            for column, x in zip(out, (chunk, (mine | bucket).astype("<u8").tobytes(), b""), strict=True):
                column.append(x)
    return _rows(out, _REPLY)


def _is_in(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where each of ``x`` stands in sorted ``found``, -1 if it is not there."""
    if not len(found):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(found, x), len(found) - 1)
    return np.where(found[at] == x, at, -1)


#: A window's identity: 64 + 32 bits; the documents that hold it first and last in a chunk.
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u4")])


def _windows(items: np.ndarray, starts: np.ndarray, window: int, one: Rolling, other: Rolling) -> np.ndarray:
    out = np.empty(len(starts), _WINDOW)
    out["h"] = one(items, window)[starts]
    out["g"] = (other(items, window)[starts] >> np.uint64(32)).astype("<u4")
    return out


def _extend(window: int, buckets: int):
    """A chunk's windows that touch a hit, each once, with the smallest and largest document."""
    block = window // 2

    def job(table: pa.Table, reply: pa.Table) -> pa.Table:
        if not table.num_rows or not reply.num_rows:
            return _rows([[]] * 5, _SEND)
        hits = np.sort(np.concatenate([np.frombuffer(x.as_py(), "<u8") for x in reply["keys"]]))
        one, other, chunk = Rolling(), Rolling(OTHER_BASE), table["chunk"][0].as_py()
        found, lows, highs = [], [], []
        for lowest, highest, items in _Chunk(table, _hashes).distinct(window):
            hit = _is_in(_keys(one(items, block), buckets), hits) >= 0
            count = np.concatenate([[0], np.cumsum(hit)])
            n = len(items) - window + 1
            # A window holds a block's worth of the other document within its first blocks' starts.
            starts = np.flatnonzero(count[block : block + n] - count[:n] > 0)
            if len(starts):
                found.append(_windows(items, starts, window, one, other))
                lows.append(np.full(len(starts), lowest))
                highs.append(np.full(len(starts), highest))
        if not found:
            return _rows([[]] * 5, _SEND)
        keys, low, high = _least(np.concatenate(found), np.concatenate(lows), np.concatenate(highs))
        bucket = (keys["h"] >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        columns: list[list] = [[], [], [], [], []]
        for b, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            e = order[lo:hi]
            if len(e):
                several = low[e] < high[e]
                docs = np.concatenate([low[e], high[e][several]]).astype("<i8").tobytes()
                for column, x in zip(columns, (b, chunk, keys[e].tobytes(), np.packbits(several).tobytes(), docs), strict=True):
                    column.append(x)
        return _rows(columns, _SEND)

    return job


def _least(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows with their smallest and largest document."""
    order = np.lexsort((keys["g"], keys["h"]))
    keys = keys[order]
    new = np.concatenate([[True], (keys["h"][1:] != keys["h"][:-1]) | (keys["g"][1:] != keys["g"][:-1])])
    begin = np.flatnonzero(new)
    return keys[begin], np.minimum.reduceat(low[order], begin), np.maximum.reduceat(high[order], begin)


def _resolve(table: pa.Table) -> pa.Table:
    """Of one bucket: each window's smallest document, to the chunks that hold it in a larger one."""
    parts = []
    for keys, several, docs in zip(table["keys"], table["seen"], table["docs"], strict=True):
        k, d = np.frombuffer(keys.as_py(), _WINDOW), np.frombuffer(docs.as_py(), "<i8")
        low, high = d[: len(k)], d[: len(k)].copy()
        high[np.unpackbits(np.frombuffer(several.as_py(), np.uint8), count=len(k)).astype(bool)] = d[len(k) :]
        parts.append((k, low, high))
    keys, low, _ = _least(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    out: list[list] = [[], [], []]
    for chunk, (k, _, high) in zip(table["chunk"].to_pylist(), parts, strict=True):
        at = _place(k, keys)
        later = np.flatnonzero(low[at] < high)
        if len(later):
            for column, x in zip(out, (chunk, k[later].tobytes(), low[at[later]].astype("<i8").tobytes()), strict=True):
                column.append(x)
    return _rows(out, _REPLY)


def _place(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each window stands in ``known`` (sorted by both hashes), -1 if it is not there."""
    if not len(known) or not len(keys):
        return np.full(len(keys), -1)
    at = np.searchsorted(known["h"], keys["h"])
    at = np.minimum(at, len(known) - 1)
    # Windows of equal first hash stand together; step through the few that share it.
    while True:
        on = (known["h"][at] == keys["h"]) & (known["g"][at] < keys["g"]) & (at + 1 < len(known))
        on[on] &= known["h"][at[on] + 1] == keys["h"][on]
        if not on.any():
            break
        at[on] += 1
    return np.where((known["h"][at] == keys["h"]) & (known["g"][at] == keys["g"]), at, -1)


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _cut(window: int, keep_text: bool):
    """The documents of a chunk without the words of repeated windows."""

    def job(table: pa.Table, reply: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if table.num_rows:
            one, other = Rolling(), Rolling(OTHER_BASE)
            keys, low = np.empty(0, _WINDOW), np.empty(0, np.int64)
            if reply.num_rows:
                keys = np.concatenate([np.frombuffer(x.as_py(), _WINDOW) for x in reply["keys"]])
                low = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in reply["docs"]])
                keys, low, _ = _least(keys, low, low)
            for doc_id, words in _Chunk(table, _hashes).words():
                n, gone = len(words), 0
                if len(keys) and doc_id is not None and n >= window:
                    items = _hashes.of(words)
                    at = _is_in(one(items, window), keys["h"])
                    starts = np.flatnonzero(at >= 0)
                    if len(starts):
                        at = _place(_windows(items, starts, window, one, other), keys)
                        starts = starts[(at >= 0) & (low[at] < doc_id)]
                    if len(starts):
                        off = covered(n, starts, window)
                        gone = int(off.sum())
                        words = [w for w, x in zip(words, off.tolist(), strict=True) if not x]
                kept = b" ".join(words)
                text = kept.decode("utf-8", "surrogatepass") if keep_text else hashlib.sha256(kept).hexdigest()
                for column, x in zip(out, (doc_id, n, gone, text), strict=True):
                    column.append(x)
        return _rows(out, _RESULT)

    return job


def without_repeats(df: DataFrame, window: int = 50, keep_text: bool = True, chunks: int | None = None) -> DataFrame:
    """A row for each row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept``.

    A word goes if it lies in ``window`` consecutive words of its document that also stand in a
    document with a smaller ``doc_id``; windows are judged on the input. ``kept`` holds the other
    words, joined by single spaces, or without ``keep_text`` the SHA-256 of that. Null and empty
    texts have no words. Rows that repeat a ``doc_id`` are one document to each other: they remove
    nothing from one another. Rows without ``doc_id`` neither remove nor lose words.

    ``chunks`` (twice ``spark.sql.shuffle.partitions`` by default) is how many parts the texts are
    dealt into; one part is held in a worker's memory at a time.
    """
    spark = df.sparkSession
    ship_package(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks or 2 * buckets
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    dealt = df.select(
        F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(chunks)).cast("int").alias("chunk"),
        doc_id.alias("doc_id"),
        text.alias("text"),
    )

    def again() -> DataFrame:
        """The chunks under fresh names; Spark shuffles the texts once for all uses."""
        return dealt.select("chunk", "doc_id", "text")

    sent = dealt.groupBy("chunk").applyInArrow(_probe(window, buckets), _SEND)
    hits = sent.groupBy("bucket").applyInArrow(_hits, _REPLY).withColumnRenamed("chunk", "to")
    touched = again().groupBy("chunk").cogroup(hits.groupBy("to")).applyInArrow(_extend(window, buckets), _SEND)
    repeats = touched.groupBy("bucket").applyInArrow(_resolve, _REPLY).withColumnRenamed("chunk", "to")
    return again().groupBy("chunk").cogroup(repeats.groupBy("to")).applyInArrow(_cut(window, keep_text), _RESULT)
