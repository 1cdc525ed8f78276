"""Futures tape: price-volume profile, value area, last price per root, basis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def futures_root(symbol: str = "symbol") -> Column:
    """The two leading capitals of a contract name; null for other names."""
    root = F.regexp_extract(symbol, r"^([A-Z]{2})", 1)
    return F.when(root != "", root)


def futures_tape(
    ticks: DataFrame,
    *,
    roots: Sequence[str] = ("ES", "NQ"),
    start=None,
    end=None,
    outrights_only: bool = False,
) -> DataFrame:
    """Ticks of the wanted roots in an inclusive time range; adds ``symbol_root`` and ``side``."""
    scope = ticks
    if start is not None:
        scope = scope.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        scope = scope.where(F.col("ts") <= F.lit(end).cast("timestamp"))
    if outrights_only:
        scope = scope.where(~F.contains(F.col("symbol"), F.lit("-")))
    return (
        scope.withColumns(
            {
                "symbol_root": futures_root(),
                "size": F.coalesce(F.col("size").cast("bigint"), F.lit(0)),
                "side": F.col("aggressor"),
            }
        ).where(F.col("symbol_root").isin([r.upper() for r in roots]))
    )


def last_prices(tape: DataFrame, *, order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Newest price per root."""
    return tape.groupBy("symbol_root").agg(
        F.max_by("price", F.struct(*order)).cast("double").alias("last_price")
    )


def volume_bins(
    tape: DataFrame, *, bin_size: float = 0.25, keys: Sequence[str] = ("symbol_root",)
) -> DataFrame:
    """Total, buyer and seller volume per price bin."""
    size = F.col("size").cast("bigint")
    bought = F.when(F.col("side") > 0, size).otherwise(0)
    sold = F.when(F.col("side") < 0, size).otherwise(0)
    return (
        tape.where(F.col("price").isNotNull() & (size > 0))
        .groupBy(*keys, (F.rint(F.col("price") / bin_size) * bin_size).alias("price"))
        .agg(F.sum(size).alias("total"), F.sum(bought).alias("buy"), F.sum(sold).alias("sell"))
    )


def value_area(
    bins: DataFrame, *, share: float = 0.70, keys: Sequence[str] = ("symbol_root",)
) -> DataFrame:
    """Point of control and the value area grown from it, from volume bins.

    Growing takes the larger neighbour each time, the upper one on ties. That order equals
    sorting the bins by the smallest total met on the way from the point of control, so
    windows over the bins replace the walk.
    """
    whole = Window.partitionBy(*keys)
    top = F.max(F.struct(F.col("total"), (-F.col("price")).alias("low_first"))).over(whole)
    placed = bins.withColumns(
        {"poc": -top["low_first"], "total_volume": F.sum("total").over(whole)}
    ).withColumn("_upper", (F.col("price") > F.col("poc")).cast("int"))
    outward = Window.partitionBy(*keys, F.signum(F.col("price") - F.col("poc"))).orderBy(
        F.abs(F.col("price") - F.col("poc"))
    )
    walked = placed.withColumn(
        "_bottleneck",
        F.when(F.col("price") == F.col("poc"), F.lit(None)).otherwise(
            F.min("total").over(outward.rowsBetween(Window.unboundedPreceding, 0))
        ),
    )
    taking = Window.partitionBy(*keys).orderBy(
        F.desc_nulls_first("_bottleneck"),
        F.desc("_upper"),
        F.abs(F.col("price") - F.col("poc")),
    )
    before = F.coalesce(
        F.sum("total").over(taking.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    taken = walked.withColumn("_before", before).where(
        (F.col("price") == F.col("poc")) | (F.col("_before") < F.col("total_volume") * share)
    )
    return taken.groupBy(*keys).agg(
        F.max("poc").alias("poc"),
        F.max("price").alias("vah"),
        F.min("price").alias("val"),
        F.max("total_volume").alias("total_volume"),
    )


def basis(spots: DataFrame, spot: str = "spot", futures: str = "futures") -> DataFrame:
    """Futures less spot, in points and relative to spot, where both are above zero."""
    both = (F.col(spot) > 0) & (F.col(futures) > 0)
    gap = F.col(futures) - F.col(spot)
    return spots.withColumns(
        {
            "basis": F.when(both, gap),
            "basis_pct": F.when(both, gap / F.nullif(F.col(spot), F.lit(0.0))),
        }
    )
