"""Mixing sources by temperature: exponent by bisection, weights as budgeted block permutations.

The share of a source is its part of all tokens; its weight is the share to the power of an
exponent between 0 (all sources alike) and 1 (as they come), normalised. The exponent is bisected
until the mixture has a wanted entropy or no source is repeated more than a limit. A source's
budget is then spent in whole passes over its documents, each pass over its blocks in an order of
its own, and a last pass that stops inside a block when the budget is spent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strikelens.llm.common import renamed, written

#: The exponent is a multiple of 1 / STEPS.
STEPS = 1 << 30
#: Exponents tried in a round of the search: five bits at a time.
FAN = 32
#: Runs of a permutation that are summed before they are put one after another.
SLICES = 256
WORDS = r"[^\x20\x09-\x0D]+"


def _order(*parts: Column | str) -> Column:
    """A number below 2**60 from what the parts say."""
    said = F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts])
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def sizes(df: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``tokens`` (words of the text) of each document, rows with both
    equal taken together. Null texts have no tokens; nulls are a name like any other."""
    return (
        df.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORDS)).cast("long").alias("tokens"),
        )
        .groupBy("doc_id", "source")
        .agg(F.sum("tokens").alias("tokens"))
    )


def find_exponent(shares: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None) -> float:
    """The largest exponent of at least ``entropy`` nats, or the smallest that repeats no source
    more than ``repeat`` times.

    ``shares`` has a row per source with its ``tokens``. Both goals change steadily with the
    exponent; each round counts several exponents in one aggregate over the sources. With
    ``budget`` tokens in all, repeats are its share over the source's tokens; without, every
    source is passed over at least once. If no exponent serves, 1 is taken for repeats (as they
    come) and 0 for entropy (all alike).
    """
    if (entropy is None) == (repeat is None):
        raise ValueError("give an entropy or a repeat limit")
    known = shares.where("tokens > 0")
    whole = known.agg(F.sum("tokens").alias("total"), F.max("tokens").alias("top")).first()
    if whole.total is None:
        return 1.0

    def serves(points: list[int]) -> dict[int, bool]:
        p = F.col("tokens") / F.lit(float(whole.total))
        tried = known.select(p.alias("p"), (F.col("tokens") / float(whole.top)).alias("r"), F.explode(F.array(*[F.lit(x) for x in points])).alias("x"))
        a = F.col("x") / float(STEPS)
        found = tried.groupBy("x").agg(
            F.sum(F.pow("p", a)).alias("z"),
            F.sum(F.pow("p", a) * a * F.log("p")).alias("s"),
            F.max(F.pow("r", a - 1)).alias("cover"),
            F.max(F.pow("p", a - 1)).alias("most"),
        )
        if entropy is not None:
            ok = F.log("z") - F.col("s") / F.col("z") >= entropy
        elif budget is None:
            ok = F.col("cover") <= repeat
        else:
            ok = F.lit(budget / float(whole.total)) * F.col("most") / F.col("z") <= repeat
        return {r.x: r.ok for r in found.select("x", ok.alias("ok")).collect()}  # FAN rows

    # Entropy serves below a point, a repeat limit above one.
    low, high = -1, STEPS + 1
    while high - low > 1:
        points = sorted({low + max(1, (high - low) * k // FAN) for k in range(1, FAN)} - {low, high})
        found = serves(points)
        for x in points:
            below = found[x] if entropy is not None else not found[x]
            if below:
                low = x
            else:
                high = x
                break
    at = max(low, 0) if entropy is not None else min(high, STEPS)
    return at / STEPS


def weights(shares: DataFrame, exponent: float, budget: int | None = None) -> DataFrame:
    """``source``, ``tokens``, ``weight``, and its ``budget`` in tokens.

    Without a budget in all, the largest source is passed over exactly once. Sources without
    tokens have weight 0 and keep one pass, which costs nothing.
    """
    known = shares.where("tokens > 0").agg(F.sum("tokens").alias("total"), F.max("tokens").alias("top")).first()
    total, top = float(known.total or 1), float(known.top or 1)
    power = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / total, F.lit(exponent))).otherwise(0.0)
    z = shares.select(F.sum(power).alias("z")).first().z or 1.0
    weight = power / z
    if budget is None:
        own = F.floor(F.col("tokens") * F.pow(F.col("tokens") / top, F.lit(exponent - 1)) + 1e-6)
    else:
        own = F.floor(weight * budget + 1e-6)
    return shares.select("source", "tokens", weight.alias("weight"), F.when(F.col("tokens") > 0, own).otherwise(0).cast("long").alias("budget"))


def permuted(documents: DataFrame, plan: DataFrame, block_tokens: int = 200_000, seed: int = 0) -> DataFrame:
    """The passes: ``doc_id``, ``source``, ``epoch`` (from 0), ``block`` and ``place``.

    ``documents`` comes from :func:`sizes`, ``plan`` from :func:`weights`. Documents are hashed
    into blocks of about ``block_tokens`` tokens; ``place`` is how many tokens of the source come
    before the block in its epoch, and order within a block is by hash. In the last epoch the
    block that crosses the budget gives its first documents as long as they fit; documents of
    equal hash go in or out together.
    """
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))
    plan = plan.select(
        F.col("source").alias("of"),
        F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(1).alias("whole"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("n_blocks"),
    )
    docs = documents.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "tokens", "whole", "rest", named.alias("name"),
        F.pmod(_order(F.lit(f"{seed}|block"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.col("n_blocks")).alias("block"),
    )
    last = F.when(F.col("rest") > 0, F.col("whole")).otherwise(F.col("whole") - 1)
    blocks = (
        docs.groupBy("name", "block", "whole", "rest")
        .agg(F.sum("tokens").alias("tokens"))
        .where(last >= 0)
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .withColumn("h", _order(F.lit(f"{seed}|epoch"), "name", "epoch", "block"))
        .withColumn("slice", F.expr(f"h div {(1 << 60) // SLICES}"))
    )
    # One block after another: sums of slices first, then within each slice.
    before = Window.partitionBy("name", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        blocks.groupBy("name", "epoch", "slice")
        .agg(F.sum("tokens").alias("run"))
        .withColumn("begin", F.coalesce(F.sum("run").over(before), F.lit(0)))
        .drop("run")
    )
    inside = Window.partitionBy("name", "epoch", "slice").orderBy("h", "block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(runs, ["name", "epoch", "slice"])
    placed = placed.select(
        F.col("name").alias("in_name"), F.col("block").alias("in_block"), "epoch", (F.col("begin") + F.col("within")).alias("place"),
        F.col("tokens").alias("block_size"),
    ).alias("b")
    put = docs.join(placed, (F.col("name") == F.col("in_name")) & (F.col("block") == F.col("in_block")))
    partial = F.col("epoch") == F.col("whole")
    full = put.where(~partial | (F.col("place") + F.col("block_size") <= F.col("rest")))
    cut = put.where(partial & (F.col("place") < F.col("rest")) & (F.col("place") + F.col("block_size") > F.col("rest")))
    by_hash = Window.partitionBy("name", "epoch").orderBy("doc_hash").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    doc_hash = _order(F.lit(f"{seed}|doc"), "name", "epoch", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    fitting = cut.withColumn("doc_hash", doc_hash).withColumn("upto", F.col("place") + F.sum("tokens").over(by_hash)).where("upto <= rest")
    columns = ["doc_id", "source", F.col("epoch").cast("int").alias("epoch"), "block", "place"]
    return full.select(*columns).union(fitting.select(*columns))


def mix(
    df: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None,
    block_tokens: int = 200_000, seed: int = 0,
) -> DataFrame:
    """Which documents to read, how often and in which order, for a mixture of ``df``'s sources.

    See :func:`find_exponent`, :func:`weights` and :func:`permuted`. Rows that repeat both
    ``doc_id`` and ``source`` are one document with the tokens of all. An empty table gives an
    empty mixture.
    """
    documents = written(sizes(df), "sizes")
    shares = written(documents.groupBy("source").agg(F.sum("tokens").alias("tokens")), "shares")
    exponent = find_exponent(shares, entropy, repeat, budget)
    return permuted(documents, weights(shares, exponent, budget), block_tokens, seed)


def mixed_rows(df: DataFrame, **goal) -> DataFrame:
    """``df`` with each row as often as its mixture passes over it; same columns."""
    rows, name = renamed(df)
    passes = mix(df, **goal).groupBy(F.col("doc_id").alias("of_id"), F.col("source").alias("of_source")).agg(F.count("*").alias("passes"))
    met = rows.join(
        passes,
        F.col(name["doc_id"]).cast("long").eqNullSafe(F.col("of_id"))
        & F.col(name["source"]).cast("string").eqNullSafe(F.col("of_source")),
    )
    repeated = met.withColumn("of_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes"))))
    return repeated.select(rows.columns).toDF(*df.columns)
