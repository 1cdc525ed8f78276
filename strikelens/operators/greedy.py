"""Greedy choices along an ordered tape, in parallel over slices of its time.

A choice decides where the next one may begin: a sweep uses up its prints, a firing silences its
rule for a while. Per slice the state it is left in is worked out for every state it may be
entered in; these steps are few, because later entries never leave earlier. The steps of a key's
slices are then put one after another, one small row a slice, and each slice is walked again from
the state it is really entered in. No task holds more than a slice of rows. Slices come to a task
one after another in sorted batches, since a call of its own for each costs more than its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strikelens.session import ship_package

#: A slice's steps: entered with a state of at most ``upto`` (the last: any), it is left in
#: ``leaves``; -1 stands for the state it was entered in.
Steps = tuple[np.ndarray, np.ndarray]


def settled(following: np.ndarray, own: int) -> np.ndarray:
    """Where walking from each of the first ``own`` positions ends: the first at or beyond ``own``.

    ``following`` has the position after each position. Doubling steps make it a handful of
    array operations.
    """
    at = following[:own].copy()
    while True:
        inside = at < own
        if not inside.any():
            return at
        at[inside] = at[at[inside]]


def walked(following: np.ndarray, hit: np.ndarray, start: int, own: int) -> tuple[list[int], int]:
    """The hits below ``own`` that a walk from ``start`` stands on, and where it ends.

    Positions without a hit lead to the next one, so the walk takes a step for each hit only.
    """
    n = len(hit)
    next_hit = np.append(np.minimum.accumulate(np.where(hit, np.arange(n), n)[::-1])[::-1], n)
    out = []
    while start < own and (start := int(next_hit[start])) < own:
        out.append(start)
        start = int(following[start])
    return out, max(own, int(following[out[-1]])) if out else max(own, start if start < n else own)


def walked_each(
    following: np.ndarray, hit: np.ndarray, begin: np.ndarray, closed: np.ndarray
) -> tuple[list[int], np.ndarray]:
    """:func:`walked` of runs that lie one after another, each from its ``begin`` below its ``closed``:
    all hits in order, and where each walk ends."""
    n = len(hit)
    next_hit = np.append(np.minimum.accumulate(np.where(hit, np.arange(n), n)[::-1])[::-1], n).astype(np.int64)
    out, ends = [], closed.astype(np.int64)
    for run in np.flatnonzero(next_hit[begin] < closed):
        at, own = int(begin[run]), int(closed[run])
        while at < own and (at := int(next_hit[at])) < own:
            out.append(at)
            at = int(following[at])
            ends[run] = max(own, at)
    return out, ends


#: Results of runs that leave a task as one batch.
TOGETHER = 512


def runs(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of sorted batches as one table for each run of equal ``names``, null being a value."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        new = np.zeros(batch.num_rows, bool)
        for name in names:
            codes = batch[name].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        ends = [[str(batch[name][at].as_py()) for name in names] for at in (0, batch.num_rows - 1)]
        if held and ends[0] != last:
            yield pa.concat_tables(held).combine_chunks()
            held = []
        begin = 0
        for cut in np.flatnonzero(new).tolist():
            yield pa.concat_tables([*held, table.slice(begin, cut - begin)]).combine_chunks()
            held, begin = [], cut
        held.append(table.slice(begin))
        last = ends[1]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def each_run(
    df: DataFrame, names: Sequence[str], order: Sequence, work: Callable[[pa.Table], pa.Table], schema
) -> DataFrame:
    """``work`` of the rows of each value of ``names``, in the given order; many values share a task.

    The number of tasks is fixed: one small row may stand for much work.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.Table] = []
        for table in runs(batches, names):
            done.append(work(table))
            if len(done) == TOGETHER:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return df.repartition(parts, *names).sortWithinPartitions(*names, *order).mapInArrow(job, schema)


def _typed(spark_schema, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], spark_schema).schema)


def choose(
    rows: DataFrame,
    keys: Sequence[str],
    slice_column: str,
    steps: Callable[[pa.Table], Steps],
    chosen: Callable[[pa.Table, int], pa.Table],
    schema,
    *,
    adjacent: bool,
    initial: Callable[[pa.Table], int] = lambda table: 0,
) -> DataFrame:
    """``chosen(slice, state)`` of every slice, entered in the state that the ones before left.

    ``rows`` has ``keys`` and a slice number, and may repeat the first rows of a slice in the
    one before it. With ``adjacent`` a state only concerns the very next slice number. The state
    before a key's first slice is the largest ``initial`` of its slices.
    """
    spark = rows.sparkSession
    ship_package(spark)
    keys = list(keys)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    named = ", ".join(f"`{k}` {types[k]}" for k in keys)
    step_schema = f"{named}, `{slice_column}` bigint, upto array<bigint>, leaves array<bigint>, begin bigint"
    state_schema = f"{named}, `{slice_column}` bigint, state bigint"
    step_arrow, state_arrow, out_arrow = (_typed(s, rows) for s in (step_schema, state_schema, schema))

    def per_slice(table: pa.Table) -> pa.Table:
        upto, leaves = steps(table)
        last = np.flatnonzero(np.append(leaves[1:] != leaves[:-1], True))  # one row per change
        first = table.slice(0, 1)
        return pa.Table.from_arrays(
            [
                *(first[k].cast(step_arrow.field(k).type) for k in keys),
                first[slice_column].cast(pa.int64()),
                pa.array([upto[last].tolist()], pa.list_(pa.int64())),
                pa.array([leaves[last].tolist()], pa.list_(pa.int64())),
                pa.array([initial(table)], pa.int64()),
            ],
            schema=step_arrow,
        )

    def in_order(table: pa.Table) -> pa.Table:
        state, before, states = max(table["begin"].to_pylist()), None, []
        for number, upto, leaves in zip(
            table[slice_column].to_pylist(), table["upto"].to_pylist(), table["leaves"].to_pylist()
        ):
            if adjacent and before is not None and number != before + 1:
                state = 0
            states.append(state)
            place = min(int(np.searchsorted(upto, state)), len(leaves) - 1)
            left = leaves[place]
            state, before = state if left == -1 else left, number
        found = table.select([*keys, slice_column]).append_column("state", pa.array(states, pa.int64()))
        return found.cast(state_arrow)

    def again(table: pa.Table) -> pa.Table:
        """The first row holds nothing but the state."""
        state = table["state"][0].as_py()
        return chosen(table.slice(1).drop_columns("state").combine_chunks(), state).cast(out_arrow)

    places = [*keys, slice_column]
    states = each_run(each_run(rows, places, [], per_slice, step_schema), keys, [slice_column], in_order, state_schema)
    entered = rows.withColumn("state", F.lit(None).cast("bigint")).unionByName(states, allowMissingColumns=True)
    return each_run(entered, places, [F.col("state").asc_nulls_last()], again, schema)
