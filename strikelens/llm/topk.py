"""Exact top-k by inner product: the three-phase uniform threshold over groups of dimensions.

A score list belongs to a query and a group of dimensions and holds the partial products of the
query with every candidate; a task makes a tile of one group's lists and knows no other group.
Phase 1 gathers the best k of every list and resolves what they name: the k-th best of these is a
safe lower bound of a query's k-th score. Phase 2 sends it back as a cutoff, bound / groups, and
each list answers with its entries at or over it: a candidate below it in every list cannot
reach the bound. Phase 3 adds up what has come, drops what cannot reach the bound even with the
cutoff in place of each entry that was not sent, and asks the tiles of the other groups for the
missing products of the rest.

Equal vectors are one candidate with its ``k + 1`` smallest ids, so copies are never scored twice.
Tiles bound what a task holds of either side.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikelens.llm.common import written
from strikelens.session import ship_package

#: Queries and candidates of a tile, and queries scored at once within it.
TILE_QUERIES, TILE_CANDIDATES, AT_ONCE = 1024, 8192, 64
#: Below this bound of a score, double arithmetic on integers is exact.
EXACT = float(1 << 53)
SCALE = 1024.0


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """floor(1024 x) of the components, as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).reshape(rows, -1)


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products, exact as doubles or else as 64-bit integers."""
    top = max(np.abs(q).max(initial=0.0), np.abs(c).max(initial=0.0))
    if top * top * max(q.shape[1], 1) >= EXACT:
        q, c = q.astype(np.int64), c.astype(np.int64)
    return q @ c.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id; not in order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    over, tied = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
    return np.concatenate([over, tied[np.argsort(ids[tied], kind="stable")[: k - len(over)]]])


_ENTRY = "query_id long, class_id long, part long"


def _tile(left: pa.Table, right: pa.Table, k: int, groups: int, bounded: bool) -> pa.Table:
    """Entries of a tile's lists: the best k of each, or with bounds those at or over the cutoff."""
    names = pa.schema([("query_id", pa.int64()), ("class_id", pa.int64()), ("part", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return names.empty_table()
    q_ids, c_ids = left["query_id"].to_numpy(), right["class_id"].to_numpy()
    queries, candidates = _matrix(left["q_part"], len(q_ids)), _matrix(right["c_part"], len(c_ids))
    alone = right["alone"].to_numpy(zero_copy_only=False)
    bounds = left["bound"].to_numpy() if bounded else None
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(q_ids), AT_ONCE):
        parts = _products(queries[lo : lo + AT_ONCE], candidates)
        for i, part in enumerate(parts):
            other = (c_ids != q_ids[lo + i]) | ~alone  # a query's own vector, unless others share it
            if bounded:
                bound = bounds[lo + i]  # NaN: fewer than k others, so everything is sent
                keep = np.flatnonzero(other if math.isnan(bound) else other & (part * groups >= bound))
            else:
                own = np.flatnonzero(other)
                keep = own[_best(part[own], c_ids[own], k)]
            out.append((np.full(len(keep), q_ids[lo + i]), c_ids[keep], part[keep].astype(np.int64)))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)]
    return pa.table([pa.array(x, pa.int64()) for x in columns], schema=names)


def _asked(left: pa.Table, right: pa.Table) -> pa.Table:
    """The products of a tile's group for the pairs that ``left`` asks for, beside its queries."""
    names = pa.schema([("query_id", pa.int64()), ("class_id", pa.int64()), ("part", pa.int64())])
    pairs = left.filter(pc.is_valid(left["class_id"]))
    if not pairs.num_rows:
        return names.empty_table()
    own = left.filter(pc.is_null(left["class_id"]))
    q_ids, c_ids = own["query_id"].to_numpy(), right["class_id"].to_numpy()
    queries, candidates = _matrix(own["q_part"], len(q_ids)), _matrix(right["c_part"], len(c_ids))
    q_order, c_order = np.argsort(q_ids), np.argsort(c_ids)
    at_q = q_order[np.searchsorted(q_ids, pairs["query_id"].to_numpy(), sorter=q_order)]
    at_c = c_order[np.searchsorted(c_ids, pairs["class_id"].to_numpy(), sorter=c_order)]
    top = max(np.abs(queries).max(initial=0.0), np.abs(candidates).max(initial=0.0))
    if top * top * max(queries.shape[1], 1) >= EXACT:
        queries, candidates = queries.astype(np.int64), candidates.astype(np.int64)
    parts = [np.einsum("ij,ij->i", queries[at_q[lo : lo + 65536]], candidates[at_c[lo : lo + 65536]]) for lo in range(0, len(at_q), 65536)]
    columns = [pairs["query_id"], pairs["class_id"], pa.array(np.concatenate(parts).astype(np.int64))]
    return pa.table(columns, schema=names)


def _ranked(scores: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The best k ids of each query; a class stands for its smallest ids."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    named = scores.join(classes.select("class_id", "ids").hint("merge"), "class_id").select("query_id", "score", F.explode("ids").alias("vec_id"))
    return named.where("vec_id != query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int = 10, every: int = 100, groups: int = 2) -> DataFrame:
    """The k best candidates of each query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Queries are the rows whose ``vec_id`` is divisible by ``every``; candidates all rows but the
    query's own. A score is the inner product of floor(1024 x) of the components, ties go to the
    smaller ``vec_id``, and a query with fewer than k others gets them all. Rows with a null
    ``vec_id``, a null or empty vector, or a null or non-finite component take no part. Vectors
    of different lengths have no inner product and are never compared. Rows that repeat a
    ``vec_id`` count once, with the smallest of their vectors. An empty table gives no rows.
    Other columns are ignored.
    """
    spark = df.sparkSession
    ship_package(spark)
    usable = (
        df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where("vec_id is not null and size(embedding) > 0")
        .where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
        .groupBy("vec_id")
        .agg(F.min("embedding").alias("embedding"))
    )
    usable = written(usable, "vectors")
    # The rank limit works in each task before the shuffle: a vector with very many copies sends k + 1 a task.
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    few = usable.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = classes.select(F.col("ids")[0].alias("class_id"), "ids", "embedding", F.size("embedding").alias("dims"))
    classes = written(classes, "classes")
    queries = usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.size("embedding").alias("dims"))
    n_queries, n_classes = queries.count(), classes.count()
    q_tiles, c_tiles = max(1, math.ceil(n_queries / TILE_QUERIES)), max(1, math.ceil(n_classes / TILE_CANDIDATES))

    def parts(table: DataFrame, name: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        """A row for each group of dimensions and tile of the other side."""
        cut = lambda i: F.expr(f"int(dims * {i} div {groups})")
        piece = F.array(*[F.struct(F.lit(g).alias("g"), F.slice("embedding", cut(g) + 1, cut(g + 1) - cut(g)).alias(name)) for g in range(groups)])
        spread = F.pmod(F.xxhash64(table.columns[0]), F.lit(n_own)).cast("int").alias(own)
        rows = table.select(*(c for c in table.columns if c != "embedding"), spread, F.explode(piece).alias("piece"))
        return rows.select("*", "piece.*", F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)).drop("piece")

    candidates = parts(classes.withColumn("alone", F.size("ids") == 1).drop("ids"), "c_part", "c_tile", c_tiles, "q_tile", q_tiles)
    tile = ["dims", "g", "q_tile", "c_tile"]

    def lists(asked: DataFrame, bounded: bool) -> DataFrame:
        def job(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            found = _tile(a, b, k, groups, bounded)
            for name, value in zip(("dims", "g"), key, strict=False):
                found = found.append_column(name, pa.array(np.full(found.num_rows, value.as_py(), np.int32)))
            return found

        left = parts(asked, "q_part", "q_tile", q_tiles, "c_tile", c_tiles)
        return left.groupBy(*tile).cogroup(candidates.groupBy(*tile)).applyInArrow(job, f"{_ENTRY}, dims int, g int")

    pair = ["query_id", "class_id", "dims"]
    gather = [F.sum("part").alias("part"), F.collect_list("g").alias("seen")]

    def resolved(pairs: DataFrame) -> DataFrame:
        """The scores of pairs that have come with the products of ``seen`` groups, ``part`` in sum: the
        tiles of the other groups are asked for theirs."""
        missing = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(groups - 1)), "seen")).alias("g")
        spread = [F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(t) for c, n, t in (("query_id", q_tiles, "q_tile"), ("class_id", c_tiles, "c_tile"))]
        wanted = pairs.select(*pair, missing, *spread)
        left = parts(queries, "q_part", "q_tile", q_tiles, "c_tile", c_tiles).unionByName(wanted, allowMissingColumns=True)
        told = left.groupBy(*tile).cogroup(candidates.groupBy(*tile)).applyInArrow(_asked, _ENTRY)
        return pairs.select("query_id", "class_id", "part").union(told).groupBy("query_id", "class_id").agg(F.sum("part").alias("score"))

    # Phase 1: the heads of all lists, and the k-th best of what they name.
    head = Window.partitionBy("query_id", "g").orderBy(F.desc("part"), "class_id")
    heads = lists(queries, bounded=False).withColumn("place", F.row_number().over(head)).where(F.col("place") <= k)
    first = _ranked(resolved(written(heads.groupBy(*pair).agg(*gather), "heads")), classes, k)
    bounds = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bound"))
    asked = written(queries.join(bounds.hint("merge"), "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("nan")))), "bounds")
    # Phase 2: all entries at or over the cutoff.
    sent = lists(asked, bounded=True).groupBy(*pair).agg(*gather)
    # Phase 3: half a unit above rounding, as scores are integers.
    missing = (F.lit(groups) - F.size("seen")) / groups
    reach = F.isnan("bound") | (F.col("part") + missing * F.col("bound") >= F.col("bound") - 0.5)
    left = written(sent.join(asked.select("query_id", "bound").hint("merge"), "query_id").where(reach).drop("bound"), "left")
    found = _ranked(resolved(left), classes, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
