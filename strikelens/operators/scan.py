"""Ordered scans over a tape that stay balanced when one key holds most of the rows.

A tape is always cut into slices of time, so a busy key spreads over as many tasks as it has
slices. The scans work slice by slice; what a slice needs from the ones before it comes from one
summary row per key and slice, carried along each key. Nothing is counted, sampled or collected
while a plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Length of a slice in seconds, unless ``strikelens.sliceSeconds`` says otherwise. A slice of a
#: key should fit a task; the slices of a key, one row each, are put in order in one task.
SLICE_SECONDS = 3600
SLICE = "_slice_no"


def with_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add the number of each row's time slice; ``order`` begins with a timestamp."""
    seconds = float(df.sparkSession.conf.get("strikelens.sliceSeconds", str(SLICE_SECONDS)))
    number = F.floor(F.unix_micros(order[0]) / F.lit(seconds * 1e6))
    # Rows without a time sort first, as they do in a window.
    return df.withColumn(SLICE, F.coalesce(number, F.lit(-(1 << 62))))


def without_slices(df: DataFrame) -> DataFrame:
    return df.drop(SLICE)


def _within(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def _carried(
    df: DataFrame, keys: Sequence[str], ends: dict[str, Column], carry: dict[str, Column]
) -> DataFrame:
    """``df`` with what the slices before a row's own left behind.

    ``ends`` has the summary of a slice, ``carry`` its fold over the earlier slices of the key.
    """
    summary = df.groupBy(*keys, SLICE).agg(*(c.alias(name) for name, c in ends.items()))
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *(F.col(k).alias(f"_s_{k}") for k in (*keys, SLICE)),
        *(c.over(before).alias(name) for name, c in carry.items()),
    )
    condition = F.col(SLICE) == F.col(f"_s_{SLICE}")
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_s_{k}"))
    return df.join(carried, condition, "left").drop(*(f"_s_{k}" for k in (*keys, SLICE)))


def last_known(
    df: DataFrame,
    values: dict[str, Column],
    keys: Sequence[str],
    order: Sequence[str],
    *,
    include_current: bool = True,
) -> DataFrame:
    """For each row the last non-null value so far, per key, in the given total order.

    ``df`` comes from :func:`with_slices`.
    """
    inputs = {name: f"_in_{name}" for name in values}
    df = df.withColumns({inputs[name]: value for name, value in values.items()})
    position = F.struct(*order)
    found = _carried(
        df,
        keys,
        {
            f"_end_{name}": F.max_by(column, F.when(F.col(column).isNotNull(), position))
            for name, column in inputs.items()
        },
        {f"_carry_{name}": F.last(f"_end_{name}", ignorenulls=True) for name in values},
    )
    window = _within(keys, order).rowsBetween(
        Window.unboundedPreceding, 0 if include_current else -1
    )
    return found.withColumns(
        {
            name: F.coalesce(
                F.last(column, ignorenulls=True).over(window), F.col(f"_carry_{name}")
            )
            for name, column in inputs.items()
        }
    ).drop(*inputs.values(), *(f"_carry_{name}" for name in values))


def running_total(
    df: DataFrame,
    values: dict[str, Column],
    keys: Sequence[str],
    order: Sequence[str],
) -> DataFrame:
    """For each row the sum of the values so far, the row included; nulls count as zero.

    ``df`` comes from :func:`with_slices`.
    """
    inputs = {name: f"_in_{name}" for name in values}
    df = df.withColumns(
        {inputs[name]: F.coalesce(value, F.lit(0)) for name, value in values.items()}
    )
    found = _carried(
        df,
        keys,
        {f"_end_{name}": F.sum(column) for name, column in inputs.items()},
        {f"_carry_{name}": F.sum(f"_end_{name}") for name in values},
    )
    window = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return found.withColumns(
        {
            name: F.sum(column).over(window) + F.coalesce(F.col(f"_carry_{name}"), F.lit(0))
            for name, column in inputs.items()
        }
    ).drop(*inputs.values(), *(f"_carry_{name}" for name in values))
