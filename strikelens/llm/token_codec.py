"""Token ids in compressed files: static range asymmetric numeral systems in interleaved blocks.

A stored corpus is a folder with two tables. ``blocks`` holds whole documents in ascending
``doc_id`` order, in blocks of about ``BLOCK_TOKENS`` ids that decode without one another;
``tables`` holds the one frequency table all blocks share. In a block, id p belongs to lane
p % lanes; lanes have states of their own and share one stream of 32-bit words, so a step
decodes one id of every lane at once. Every ``CHECKPOINT_TOKENS`` ids the states, the place in
the stream and a checksum are kept: a reader can begin there, and several can share a block.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikelens.llm.common import KEPT, documents, map_batches, shared_folder

BLOCK_TOKENS = 1 << 17
CHECKPOINT_TOKENS = 1 << 16
LANES = 1024
#: States stay in [2**31, 2**63) and give and take words of 32 bits.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
WORD_MASK = np.uint64((1 << 32) - 1)


# --- text to ids ----------------------------------------------------------------------------


def _byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: its own, or one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordIds:
    """Ids of texts with the tokenizers library; the ids of words met before are remembered.

    A byte-level tokenizer cuts texts at every space between two characters that are no space
    themselves, so the words between such spaces have ids of their own, and it cuts on both sides
    of a line break between two such characters, and between a letter and signs that follow it. Any other text, or one with a special token in it, is encoded as a whole. ``known`` has
    words without the space before them, or with the line break before them; the value is None
    where a word touches other white space. Words of Latin letters are never cut, so they go
    to the library's model without its search for cuts.
    """

    REMEMBERED = 2_000_000
    #: Signs without the apostrophe, which may begin a piece with letters.
    STOPS = ".,!?;:#$%&*+-/<=>@^_`|~\"()[]{}\\"
    #: All letters below this one are Latin.
    BEYOND = "\u0250"
    #: Words encoded in one call, a line break between two.
    TOGETHER = 64

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A line break between two other characters is an id of its own.
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        line = ids("\n")
        lone = len(line) == 1 and all(ids(f"a\n{b}") == [*ids("a"), *line, *ids(b)] for b in ("b", " b"))
        self.line = line[0] if lone else None
        parts = json.loads(self.tokenizer.to_str())
        plain = parts["normalizer"] is None and parts["post_processor"] is None and parts["model"]["type"] == "BPE"
        cuts = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        #: The sign that stands for each byte in the model, if words may go to it.
        self.signs = _byte_signs() if plain and parts["pre_tokenizer"] == cuts else None
        self.known: dict[str, bytes | None] = {}
        self.first: dict[str, bytes] = {}
        self.stops: dict[str, bytes] = {"": b""}

    def _raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, e.ids).tobytes() for e in found]

    def _by_model(self, words: list[str], before: str) -> list[bytes]:
        """The ids of words of Latin letters, each with a space (or nothing) before it."""
        code, signs, ids = self.code, self.signs, self.tokenizer.model.tokenize
        space = before.translate(signs)
        spelled = [space + (w if w.isascii() else w.encode().decode("latin-1").translate(signs)) for w in words]
        return [array(code, [t.id for t in ids(w)]).tobytes() for w in spelled]

    def _ids_of(self, words: list[str], before: str = " ") -> dict[str, bytes]:
        """The ids of words without white space, each with a space (or nothing) before it."""
        latin = [w for w in words if w.isalpha() and (w.isascii() or max(w) < self.BEYOND)] if self.signs else []
        found = dict(zip(latin, self._by_model(latin, before), strict=True))
        rest = [w for w in words if w not in found] if len(latin) < len(words) else []
        found.update(zip(rest, self._raw_words(rest, before), strict=True))
        return found

    def _raw_words(self, words: list[str], before: str) -> list[bytes]:
        if self.line is None:
            return self._raw([before + w for w in words])
        n, out = self.TOGETHER, []
        lines = [before + f"\n{before}".join(words[i : i + n]) + "\n" for i in range(0, len(words), n)]
        width = array(self.code).itemsize
        for raw in self._raw(lines):
            ends = (np.flatnonzero(np.frombuffer(raw, self.kind) == self.line) * width).tolist()
            at = 0
            for end in ends:
                out.append(raw[at:end])
                at = end + width
        return out

    def _learn(self, fresh: set[str]) -> None:
        """Encode words met for the first time, without the signs after a last letter."""
        known, plain = self.known, list(filter(str.isalpha, fresh))
        stopped, behind, odd = [], [], []
        for word in fresh.difference(plain):
            core = word.rstrip(self.STOPS)
            if core.isalpha():
                stopped.append((word, core))
            elif self.line is not None and word[:1] == "\n":
                tail = word[1:]
                if len(tail.split()) == 1 and not (tail[0].isspace() or tail[-1].isspace()):
                    behind.append((word, tail))
                else:
                    known[word] = None
            elif not word or word[0].isspace() or word[-1].isspace():
                known[word] = None
            else:
                (plain if len(word.split()) == 1 else odd).append(word)
        plain += {core for _, core in stopped}.difference(fresh).difference(known)
        known.update(self._ids_of(plain))
        known.update(zip(odd, self._raw([" " + w for w in odd]), strict=True))
        ends = list({word[len(core) :] for word, core in stopped}.difference(self.stops))
        self.stops.update(zip(ends, self._raw(ends), strict=True))
        for word, core in stopped:
            known[word] = known[core] + self.stops[word[len(core) :]]
        tails = list({tail for _, tail in behind}.difference(self.first))
        self.first.update(self._ids_of(tails, ""))
        line = array(self.code, [self.line or 0]).tobytes()
        for word, tail in behind:
            known[word] = line + self.first[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian numbers."""
        if len(self.known) + len(self.first) + len(self.stops) > self.REMEMBERED:
            self.known, self.first, self.stops = {}, {}, {"": b""}
        cut = [(t if self.line is None else t.replace("\n", " \n")).split(" ") for t in texts]
        firsts = [words.pop(0) for words in cut]
        new = list(set(firsts).difference(self.first))
        self.first.update(zip(new, self._raw(new), strict=True))
        fresh = set().union(*cut).difference(self.known)
        if fresh:
            self._learn(fresh)
        get, out = self.known.__getitem__, []
        for text, first, words in zip(texts, firsts, cut, strict=True):
            raw = None
            if not (words and (not first or first[-1].isspace()) or any(s in text for s in self.special)):
                found = list(map(get, words))
                if None not in found:
                    raw = self.first[first] + b"".join(found)
            out.append(self._raw([text])[0] if raw is None else raw)
        return out


@functools.lru_cache(maxsize=1)
def _word_ids(tokenizer_file: str) -> WordIds:
    """A worker keeps its words for its next task."""
    return WordIds(tokenizer_file)


KEPT[__name__] = _word_ids.cache_clear


# --- the coder ------------------------------------------------------------------------------


def quantized(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2**bits; every id that occurs gets at least 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), np.int64)
    size, used = 1 << bits, counts > 0
    if used.sum() > size:
        raise ValueError("more ids than frequencies")
    freq = np.where(used, np.maximum(1, (counts.astype(np.float64) * size / total).astype(np.int64)), 0)
    while (gap := size - int(freq.sum())) != 0:
        order = np.argsort(-freq, kind="stable")
        if gap > 0:
            freq[order[0]] += gap
        else:
            give = order[freq[order] > 1][: -gap]
            freq[give] -= 1
    return freq


class Coder:
    """Encodes and decodes blocks with one shared table of frequencies."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> dict:
        """Words, and checkpoints as (states, place in the words); the first is the start."""
        n = len(ids)
        lanes = max(1, min(lanes, n))
        steps = -(-n // lanes)
        every = max(1, CHECKPOINT_TOKENS // lanes)
        states = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        kept: list[tuple[int, np.ndarray]] = []
        f, c, limit = self.freq[ids], self.start[ids], self.limit[ids]
        for t in range(steps - 1, -1, -1):
            lo, hi = t * lanes, min(n, (t + 1) * lanes)
            x, ft = states[: hi - lo], f[lo:hi]
            over = x >= limit[lo:hi]
            words.append((x[over] & WORD_MASK).astype("<u4"))
            x = np.where(over, x >> WORD, x)
            q = x // ft
            states[: hi - lo] = (q << self.bits) + (x - q * ft) + c[lo:hi]
            if t % every == 0:
                kept.append((t, states.copy()))
        words.reverse()
        kept.reverse()
        sizes = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        cuts = [t * lanes for t, _ in kept] + [n]
        return {
            "lanes": lanes,
            "words": np.concatenate(words).astype("<u4").tobytes() if words else b"",
            "states": [s.astype("<u8").tobytes() for _, s in kept],
            "places": [int(sizes[t]) for t, _ in kept],
            "checksums": [
                zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)
            ],
        }

    def decode_from(self, block: dict, n: int, checkpoint: int) -> np.ndarray:
        """The ids from one checkpoint to the next; a wrong checksum raises ValueError."""
        lanes = block["lanes"]
        span = max(1, CHECKPOINT_TOKENS // lanes) * lanes
        begin, end = checkpoint * span, min(n, (checkpoint + 1) * span)
        words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
        states = np.frombuffer(block["states"][checkpoint], "<u8").copy()
        at, mask = block["places"][checkpoint], np.uint64((1 << int(self.bits)) - 1)
        out = np.empty(end - begin, "<u4")
        for lo in range(begin, end, lanes):
            hi = min(end, lo + lanes)
            x = states[: hi - lo]
            slot = x & mask
            ids = self.symbol[slot]
            x = self.freq[ids] * (x >> self.bits) + slot - self.start[ids]
            need = (x < LOW).nonzero()[0]
            if len(need):
                x[need] = x[need] << WORD | words[at : at + len(need)]
                at += len(need)
            states[: hi - lo] = x
            out[lo - begin : hi - begin] = ids
        if zlib.crc32(out) != block["checksums"][checkpoint]:
            raise ValueError(f"checkpoint {checkpoint} fails its checksum")
        return out

    def decode(self, block: dict, n: int) -> np.ndarray:
        parts = [self.decode_from(block, n, k) for k in range(len(block["states"]))]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")


# --- jobs -----------------------------------------------------------------------------------

_BLOCK = (
    "shard int, block long, doc_ids array<long>, n_tokens array<long>, lanes int, words binary, "
    "states array<binary>, places array<long>, checksums array<long>"
)


def _raw_blocks(df: DataFrame, tokenizer_file: str, end_id: int, vocabulary: int) -> DataFrame:
    """Blocks of plain ids, in order within a shard; shards follow each other by ``doc_id``.

    The last row of a task has no block but ``counts``, how often the task has met each id.
    """
    ordered = documents(df).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    numbered = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _word_ids(tokenizer_file)
        end = np.array([end_id], coder.kind).tobytes()
        width = len(end)
        shard, block, ids, sizes, held, total = 0, 0, [], [], [], 0
        counts = np.zeros(vocabulary, np.int64)

        def row(*values) -> pa.RecordBatch:
            types = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, types, strict=True)],
                names=["shard", "block", "doc_ids", "n_tokens", "ids", "counts"],
            )

        def out() -> pa.RecordBatch:
            nonlocal counts
            raw = b"".join(held)
            counts += np.bincount(np.frombuffer(raw, coder.kind), minlength=vocabulary)
            return row(shard, block, ids, sizes, raw, None)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                shard = part.column("shard")[0].as_py()
                for doc_id, raw in zip(
                    part.column("doc_id").to_pylist(), coder.encode(part.column("text").to_pylist()), strict=True
                ):
                    ids.append(doc_id)
                    held += [raw, end]
                    sizes.append(len(raw) // width + 1)
                    total += sizes[-1]
                    if total >= BLOCK_TOKENS:
                        yield out()
                        block, ids, sizes, held, total = block + 1, [], [], [], 0
        if ids:
            yield out()
        yield row(shard, None, None, None, None, counts.tobytes())

    schema = "shard int, block long, doc_ids array<long>, n_tokens array<long>, ids binary, counts binary"
    return map_batches(numbered, job, schema)


def _counts(raw: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs: the counts of the tasks, summed by Spark."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for counts in batch.column("counts"):
                total += np.frombuffer(counts.as_buffer(), np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["id", "n"])

    told = raw.select("counts").where("counts is not null")
    sums = map_batches(told, job, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for row in sums.collect():  # at most a row for each id of the vocabulary
        counts[row.id] = row.n
    return counts


def write_corpus(df: DataFrame, path: str, tokenizer_file: str, end_id: int) -> None:
    """Encode every text of ``df`` (null: empty), append ``end_id`` and store all ids below ``path``.

    Documents stand in ascending ``doc_id`` order; rows that repeat an id stand together, by
    text, and rows without one come first. Texts may be of any length: one that is larger than a
    block is a block. An empty table is stored as an empty corpus.
    """
    spark = df.sparkSession
    words = WordIds(tokenizer_file)
    vocabulary, kind = max(words.tokenizer.get_vocab_size(), end_id + 1), words.kind
    bits = max(16, int(vocabulary - 1).bit_length() + 4)
    plain = shared_folder(spark, "token-ids")
    _raw_blocks(df, tokenizer_file, end_id, vocabulary).write.option("compression", "zstd").parquet(plain)
    raw = spark.read.parquet(plain)
    freq = quantized(_counts(raw, vocabulary), bits)
    table = [(i, int(f), bits, vocabulary) for i, f in enumerate(freq.tolist()) if f]
    spark.createDataFrame(table, "id long, frequency long, bits int, vocabulary long").coalesce(1).write.parquet(
        f"{path}/tables"
    )

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                found = coder.encode(np.frombuffer(batch.column("ids")[i].as_buffer(), kind).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, 1) for c in ("shard", "block", "doc_ids", "n_tokens")),
                        pa.array([found["lanes"]], pa.int32()), pa.array([found["words"]], pa.binary()),
                        pa.array([found["states"]], pa.list_(pa.binary())),
                        pa.array([found["places"]], pa.list_(pa.int64())),
                        pa.array([found["checksums"]], pa.list_(pa.int64())),
                    ],
                    names=["shard", "block", "doc_ids", "n_tokens", "lanes", "words", "states", "places", "checksums"],
                )

    map_batches(raw.drop("counts").where("block is not null"), job, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_corpus(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The stored documents: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit integers) and, if asked for, ``ids``.

    Every block is decoded on its own, from its checkpoints, against their checksums.
    """
    table = spark.read.parquet(f"{path}/tables").collect()  # bounded by the vocabulary
    bits, vocabulary = (table[0].bits, table[0].vocabulary) if table else (16, 1)
    freq = np.zeros(vocabulary, np.int64)
    for row in table:
        freq[row.id] = row.frequency
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for batch in batches:
            for block in batch.to_pylist():
                sizes = np.array(block["n_tokens"], np.int64)
                ids = coder.decode(block, int(sizes.sum()))
                cuts = np.concatenate([[0], np.cumsum(sizes)])
                parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = len(parts)
                columns = [
                    pa.array([block["shard"]] * n, pa.int32()), pa.array([block["block"]] * n, pa.int64()),
                    pa.array(cuts[:-1]), pa.array(block["doc_ids"], pa.int64()), pa.array(sizes),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["shard", "block", "place", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "shard int, block long, place long, doc_id long, n_tokens long, ids_crc32 long"
    found = map_batches(blocks, job, schema + (", ids array<long>" if with_ids else ""))
    # Sums over shards (as many as there were partitions), then over the blocks of each shard.
    own = blocks.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (s, x) -> s + x)").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = own.groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = own.join(shards, "shard").select(
        "shard", "block", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("begin")
    )
    return found.join(begins, ["shard", "block"]).select(
        "doc_id",
        (F.col("begin") + F.col("place")).cast("long").alias("start"),
        "n_tokens",
        "ids_crc32",
        *(["ids"] if with_ids else []),
    )
