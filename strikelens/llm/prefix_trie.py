"""Prefix trie of conversations as burst tries.

Conversations that begin alike share trie nodes. Each distinct sequence of turns is one weighted
entry (copies collapse before anything else), and an entry waits in the container of a trie head.
A container that holds more turns than ``CONTAINER`` bursts: the turns that all its entries share
become nodes, and what is left of them goes to new containers by the next turn's id. What no
longer bursts is sorted, and a sweep over the sorted entries closes the nodes.

Turns are named by 128 bits of MD5 over role and text, so texts are read once and never shuffled.
An entry is cut into pieces of at most ``PIECE`` turns; a later piece waits under the head that is
named by all before it, so a conversation of any length is no one row. Pieces of one level go
together, the last level first, and hand what they have counted to the entries that they continue.

A burst counts entries, turns and the first and last entry of each container where they lie and
shuffles one row a container and task; the rows of a large container then move by their next turn.
The digest of a node's ends is the SHA-256 of a list that may be as long as the table: ids are
sorted over all tasks, joined to texts of bounded size there, and only these are read in one line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikelens.llm.common import map_batches, written

#: Turns of an entry, and turns that a container holds before it bursts.
PIECE, CONTAINER = 4096, 100_000
#: Conversations of a family, which share turns of the first, and how many turns at most.
FAMILY, SHARED = 20, 4
#: Bytes of a turn in an entry: 16 of its name, 8 of its words.
WIDTH = 24
#: Parts that a bursting container's entries meet their head in.
SALTS = 32
#: Bytes of ids that are joined to one text.
TEXT = 1 << 16

#: Counts of the part of a subtree that an entry's later pieces hold.
_BELOW = ("below_children", "below_leaves", "below_saved")
_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends array<long>"
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(df: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``name`` (16 bytes) and ``words`` of the rows that have a ``conv_id``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # The length of the role keeps role and text apart.
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.expr(r"cast(size(filter(split(coalesce(cast(text as string), ''), '[\\x20\\x09-\\x0D]+'), w -> w != '')) as bigint)")
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"), words.alias("words"))
    return rows.where("conv_id is not null")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``place``, the row's number from 0 within its ``conv_id`` in the given order.

    Rows are sorted over all tasks, so one long conversation lies in several parts. Each part counts
    its own; conversations that lie in several are at most one more than the parts, and only
    their counts are added across parts.
    """
    rows = df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    rows = rows.withColumn("part", F.spark_partition_id()).select("part", *df.columns)
    at = df.columns.index("conv_id") + 1

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            ids = batch.column(at).to_numpy()
            if not len(ids):
                continue
            begins = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            place = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
            if last == ids[0]:
                place[: begins[1] if len(begins) > 1 else len(ids)] += n
            last, n = ids[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", place bigint"
    found = written(map_batches(rows, job, schema), "numbered")
    several = found.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo != hi")
    counts = found.join(F.broadcast(several), "conv_id", "left_semi").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "part", F.sum("n").over(before).alias("before")).where("before is not null")
    return found.join(F.broadcast(counts), ["conv_id", "part"], "left").select(*df.columns, (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"))


def rebuilt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (``conv_id``, ``place``, ``name``, ``words``), and all ``conv_id``.

    A conversation c begins with the first h turns of c - c % ``FAMILY`` and goes on with its own
    after its first h, where h is the unsigned CRC-32 of the decimal c modulo ``SHARED``.
    """
    own = written(numbered(turns_of(df), ["turn", "name", "words"]), "turns")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    convs = own.select("conv_id").distinct()
    first = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED)).select(F.col("conv_id").alias("first_id"), "place", "name", "words")
    named = convs.withColumn("first_id", F.col("conv_id") - F.col("conv_id") % FAMILY)
    taken = named.join(first.hint("merge"), "first_id").where(F.col("place") < h).select("conv_id", "place", "name", "words")
    rest = own.where(F.col("place") >= h).select("conv_id", "place", "name", "words")
    turns = numbered(taken.union(rest).withColumnRenamed("place", "was"), ["was", "name", "words"])
    return written(turns.select("conv_id", "place", "name", "words"), "rebuilt"), convs


def pieces(df: DataFrame, piece: int = PIECE) -> DataFrame:
    """A row for each ``piece`` turns of a rebuilt conversation: ``conv_id``, ``level``, ``steps`` (its
    turns' names and words), ``above`` and ``end`` (what all pieces before it, and with it, are named)
    and ``ends`` (whether it is the last). A conversation without turns has one piece without steps."""
    turns, convs = rebuilt(df)
    step = F.concat(F.col("name"), F.unhex(F.lpad(F.hex("words"), 16, "0")))
    held = turns.groupBy("conv_id", F.floor(F.col("place") / piece).alias("level")).agg(F.sort_array(F.collect_list(F.struct("place", step.alias("s")))).alias("steps"))
    held = held.select("conv_id", "level", F.expr("unhex(array_join(transform(steps, x -> hex(x.s)), ''))").alias("steps"))
    turnless = convs.join(held.select("conv_id").where("level = 0"), "conv_id", "left_anti")
    held = held.union(turnless.select("conv_id", F.lit(0).cast("long"), F.lit(b"")))
    # Order is part of each hash, so the names of a row of pieces can be combined by exclusive or.
    marks = [F.xxhash64(F.lit(m), F.col("level"), F.col("steps")) for m in (1, 2)]
    so_far = Window.partitionBy("conv_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    up_to = [F.bit_xor(m).over(so_far) for m in marks]
    whole = Window.partitionBy("conv_id").orderBy("level")
    held = held.select("conv_id", "level", "steps", *(m.alias(f"m{i}") for i, m in enumerate(marks)), *(u.alias(f"u{i}") for i, u in enumerate(up_to)), F.lead("level").over(whole).isNull().alias("ends"))
    before = [F.col(f"u{i}").bitwiseXOR(F.col(f"m{i}")) for i in range(2)]
    return written(held.select("conv_id", "level", "steps", F.array(*before).alias("above"), F.array("u0", "u1").alias("end"), "ends"), "pieces")


def _prefix(a: bytes, b: bytes) -> int:
    """How many whole steps two entries begin with in common."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    x, y = (np.frombuffer(s, np.uint8, n * WIDTH) for s in (a, b))
    return int(np.argmax(x != y)) // WIDTH


def _words(steps: bytes) -> np.ndarray:
    return np.frombuffer(steps, ">i8").reshape(-1, WIDTH // 8)[:, 2].astype(np.int64)


class _Node:
    __slots__ = ("above", "below", "children", "depth", "ends", "leaves", "least", "n", "saved", "words")

    def __init__(self, above: _Node | None, depth: int, words: int) -> None:
        self.above, self.depth, self.words, self.below = above, depth, words, 0
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.ends = None, None

    def take(self, n: int, least: int) -> None:
        self.n += n
        self.least = least if self.least is None else min(self.least, least)

    def close(self) -> None:
        """Add the finished node to the one above it."""
        self.saved += (self.n - 1) * self.words
        self.leaves = self.leaves or 1
        up = self.above
        up.take(self.n, self.least)
        up.children += 1
        up.leaves += self.leaves
        up.saved += self.saved


class _Sweep:
    """A container's entries in order; the nodes and the container's own counts at the end.

    ``head`` is the node that the container hangs on. Its own row is not among the nodes.
    """

    def __init__(self, key: bytes, parent: bytes | None, depth: int, parent_id: int | None) -> None:
        self.key, self.parent, self.parent_id = key, parent, parent_id
        self.head = _Node(None, depth, 0)
        self.open, self.nodes, self.before = [self.head], [], b""

    def entry(self, steps: bytes, n: int, least: int, end: list[int] | None, below: tuple[int, int, int]) -> None:
        same = _prefix(self.before, steps)
        self._close(same)
        words = _words(steps)
        for i in range(same, len(words)):
            node = _Node(self.open[-1], self.open[-1].depth + 1, int(words[i]))
            self.open.append(node)
            self.nodes.append(node)
        top = self.open[-1]
        top.take(n, least)
        top.ends = end
        top.children += below[0]
        top.leaves += below[1]
        top.saved += below[2]
        self.before = steps

    def _close(self, depth: int) -> None:
        while len(self.open) > depth + 1:
            self.open.pop().close()

    def rows(self) -> Iterator[tuple]:
        self._close(0)
        for node in self.nodes:
            up = node.above
            parent_id = self.parent_id if up is self.head and self.parent_id is not None else up.least
            yield None, None, node.least, node.depth, parent_id, node.n, node.children, node.leaves, node.saved, node.ends
        head = self.head
        yield self.key, self.parent, head.least, head.depth, None, head.n, head.children, head.leaves, head.saved, head.ends


def _swept(entries: DataFrame) -> DataFrame:
    """The nodes of all containers, and a row with ``key`` for each container itself."""
    columns = ["key", "steps", "parent", "depth", "parent_id", "n", "least", "end", *_BELOW]
    rows = entries.select(*columns).repartition("key").sortWithinPartitions("key", "steps")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = None
        for batch in batches:
            out: list[tuple] = []
            for key, steps, parent, depth, parent_id, n, least, end, *below in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sweep is None or sweep.key != key:
                    if sweep:
                        out += sweep.rows()
                    sweep = _Sweep(key, parent, depth, parent_id)
                sweep.entry(steps, n, least, end, tuple(below))
                if len(out) >= 4096:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)
        if sweep:
            yield _rows(list(sweep.rows()))

    return map_batches(rows, job, f"key binary, parent binary, {_NODES}")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.list_(pa.int64())]
    names = ["key", "parent", *(part.split()[0] for part in _NODES.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _path_rows(heads: DataFrame) -> DataFrame:
    """The nodes of the turns that the entries of a burst container share."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words, saved, last = _words(row["path"]), row["saved"], len(row["path"]) // WIDTH
                for i in range(last, 0, -1):
                    saved += (row["n"] - 1) * int(words[i - 1])
                    parent_id = row["parent_id"] if i == 1 and row["parent_id"] is not None else row["least"]
                    children, ends = (row["children"], row["end"]) if i == last else (1, None)
                    out.append((None, None, row["least"], row["depth"] + i, parent_id, row["n"], children, row["leaves"], saved, ends))
                # A container with a path counts for one child of its parent, one without for its own.
                children, end = (1, None) if last else (row["children"], row["end"])
                out.append((row["key"], row["parent"], row["least"], row["depth"], None, row["n"], children, row["leaves"], saved, end))
            if out:
                yield _rows(out)

    return map_batches(heads.select("key", "parent", "path", "depth", "parent_id", "n", "least", "children", "leaves", "saved", "end"), job, f"key binary, parent binary, {_NODES}")


def _bursting(entries: DataFrame, most: int) -> DataFrame:
    """``key``, ``path`` (the steps that all share), and the counts of each container over ``most`` turns."""
    found = entries.groupBy("key").agg(
        F.count("*").alias("entries"), F.sum(F.greatest(F.octet_length("steps") / WIDTH, F.lit(1))).alias("turns"),
        F.sum("n").alias("n"), F.min("least").alias("least"), F.min("steps").alias("lo"), F.max("steps").alias("hi"),
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("parent_id").alias("parent_id"),
    ).where(f"entries > 1 and turns > {most}")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi = batch.column("lo").to_pylist(), batch.column("hi").to_pylist()
            paths = [a[: _prefix(a, b) * WIDTH] for a, b in zip(lo, hi, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(paths, pa.binary())], names=[*kept, "path"])

    kept = ["key", "parent", "depth", "parent_id", "n", "least"]
    return map_batches(found.select(*kept, "lo", "hi"), job, "key binary, parent binary, depth long, parent_id long, n long, least long, path binary")


def _burst(entries: DataFrame, most: int) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """Entries in containers that don't burst, and each round's burst heads with the entries ending there."""
    rounds, still = [], None
    salt = F.pmod(F.xxhash64("steps"), F.lit(SALTS))
    while True:
        heads = written(_bursting(entries, most), "heads")
        if heads.isEmpty():
            return (entries if still is None else still.union(entries)), rounds
        # Where entries share nothing, the node above them stays the one that the container hangs on.
        above = F.when(F.octet_length("path") == 0, F.coalesce("parent_id", "least")).otherwise(F.col("least"))
        met = heads.select("key", F.octet_length("path").alias("cut"), above.alias("head_least"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        joined = entries.withColumn("salt", salt.cast("int")).join(met.hint("merge"), ["key", "salt"], "left").drop("salt")
        joined = written(joined, "burst")
        at_end = joined.where("cut is not null and octet_length(steps) = cut").select("key", "end", *_BELOW)
        rounds.append((heads, at_end))
        calm = joined.where("cut is null").select(entries.columns)
        still = calm if still is None else still.union(calm)
        rest = F.expr("substring(steps, cut + 1, octet_length(steps) - cut)")
        moved = joined.where("octet_length(steps) > cut").select(*(c for c in joined.columns if c != "steps"), "steps", rest.alias("rest"))
        key = F.unhex(F.md5(F.concat("key", F.substring("rest", 1, 16))))
        entries = moved.select(
            key.alias("key"), F.col("rest").alias("steps"), F.col("key").alias("parent"), (F.col("depth") + F.expr(f"cut div {WIDTH}")).alias("depth"),
            F.col("head_least").alias("parent_id"), "n", "least", "end", *_BELOW,
        )


def _level(entries: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of one level's entries, and a row for each container that hangs on no other one."""
    calm, rounds = _burst(entries, most)
    swept = written(_swept(calm), "swept")
    found = [swept]
    for heads, at_end in reversed(rounds):
        known = found[0]
        for more in found[1:]:
            known = known.union(more)
        under = known.where("key is not null and parent is not null").groupBy(F.col("parent").alias("key")).agg(
            F.sum("n_children").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
        )
        whole = heads.join(under.hint("merge"), "key", "left").join(at_end.hint("merge"), "key", "left")

        def both(a: str, b: str) -> Column:
            return F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))

        whole = whole.select(
            *heads.columns, "end", both("c", _BELOW[0]).alias("children"), both("l", _BELOW[1]).alias("leaves"), both("s", _BELOW[2]).alias("saved")
        )
        found.append(written(_path_rows(whole), "paths"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    return rows.where("key is null").drop("key", "parent"), rows.where("key is not null and parent is null").drop("parent")


def _with_parent(same: DataFrame, before: DataFrame) -> DataFrame:
    """Entries with ``parent_id``, the smallest conversation of the node that they go on from; some
    conversations may end there, so it is not to be seen among the entries."""
    heads = before.groupBy(F.col("end").alias("above")).agg(F.min("conv_id").alias("parent_id"))
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("steps"), F.lit(SALTS)).cast("int")
    return same.withColumn("salt", salt).join(heads.hint("merge"), ["above", "salt"], "left").drop("salt")


def ends_digest(ended: DataFrame, text: int = TEXT) -> DataFrame:
    """``end`` and ``ends_sha256`` of the conversations (``conv_id``, ``end``) that end in one place.

    Ids are sorted over all tasks and joined to texts of ``text`` bytes; a digest reads its texts in order."""
    key = ["hi", "lo"]
    ids = ended.select(F.col("end")[0].alias("hi"), F.col("end")[1].alias("lo"), "conv_id")
    ids = ids.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, parts, size = None, 0, [], 0
        for batch in batches:
            out = []
            for hi, lo, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (hi, lo) or size >= text:
                    if parts:
                        out.append((*now, first, ",".join(parts)))
                    now, first, parts, size = (hi, lo), conv, [], 0
                parts.append(str(conv))
                size += len(parts[-1]) + 1
            if out:
                yield made(out)
        if parts:
            yield made([(*now, first, ",".join(parts))])

    def made(out: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["hi", "lo", "first", "ids"])

    texts = map_batches(ids, join, "hi long, lo long, first long, ids string")
    texts = texts.repartition(*key).sortWithinPartitions(*key, "first")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            out = []
            for hi, lo, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now == (hi, lo):
                    running.update(b"," + ids.encode())
                    continue
                if now:
                    out.append((list(now), running.hexdigest()))
                now, running = (hi, lo), hashlib.sha256(ids.encode())
            if out:
                yield told(out)
        if now:
            yield told([(list(now), running.hexdigest())])

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out])], names=["ends", "ends_sha256"])

    return map_batches(texts, digest, "ends array<long>, ends_sha256 string")


def trie(df: DataFrame, piece: int = PIECE, container: int = CONTAINER) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations: ``conv_id``, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    Turns stand in the order of ``turn``, null first; turns of one number by the MD5 of role and
    text (a repeated row is a turn of its own). A null role or text is an empty one. Rows without
    ``conv_id`` belong to no conversation and take no part. An empty table has no nodes, not even
    a root. Texts may be of any length and conversations of any number of turns. Ids may be
    negative; c % 20 then has the sign of c. Other columns are ignored.
    """
    spark = df.sparkSession
    held = pieces(df, piece)
    top = held.agg(F.max("level").alias("level"), F.min("conv_id").alias("least"), F.sum(F.when(F.col("level") == 0, 1)).alias("n")).first()
    empty = spark.createDataFrame([], _NODES)
    if top.level is None:
        return empty.drop("ends").withColumn("ends_sha256", F.lit(""))
    nodes, below = empty, None
    for level in range(top.level, -1, -1):
        same = held.where(F.col("level") == level).groupBy("above", "steps").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("least"), F.min("end").alias("going"), F.max("ends").alias("ended")
        )
        if below is not None:
            same = same.join(below.hint("merge"), F.col("going") == F.col("head"), "left")
        same = same.withColumn("parent_id", F.lit(None).cast("long")) if not level else _with_parent(same, held.where(F.col("level") == level - 1))
        counts = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) if below is not None else F.lit(0).cast("long").alias(c) for c in _BELOW]
        key = F.unhex(F.concat(*(F.lpad(F.hex(F.col("above")[i]), 16, "0") for i in range(2))))
        entries = same.select(
            key.alias("key"), "steps", F.lit(None).cast("binary").alias("parent"), F.lit(level * piece).cast("long").alias("depth"),
            "parent_id", "n", "least", F.when(F.col("ended"), F.col("going")).alias("end"), *counts,
        )
        more, heads = _level(written(entries, "entries"), container)
        nodes = nodes.union(more)
        parts = [F.conv(F.substring(F.hex("key"), at, 16), 16, -10).cast("long") for at in (1, 17)]
        below = heads.select(F.array(*parts).alias("head"), *(F.col(c).alias(b) for c, b in zip(("n_children", "n_leaves", "saved_tokens"), _BELOW, strict=True)))
        root = heads
    first = root.select(
        F.lit(top.least).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(top.n).cast("long").alias("n_convs"),
        "n_children", F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), "saved_tokens", "ends",
    )
    prints = ends_digest(held.where("ends").select("conv_id", "end"))
    return nodes.union(first).join(prints.hint("merge"), "ends", "left").select(
        *nodes.drop("ends").columns, F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256")
    )
