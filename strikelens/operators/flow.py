"""Flow events on the option tape: blocks, sweeps, unusual volume; signed-premium buckets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strikelens.functions.columns import CONTRACT, is_call
from strikelens.operators import greedy
from strikelens.operators.tape import dealer_premium

#: Sweep windows per slice of a tape; larger slices repeat fewer prints at their ends.
SLICE_WINDOWS = 64

EVENT_COLUMNS = (
    "event_type", "ts", "symbol", "expiration", "strike", "option_type",
    "side", "size", "price", "legs", "venues", "meta",
)
#: What tells an event from others of its type and contract; :func:`with_event_id` uses it up.
EVENT_KEY = "event_key"


def _event(kind: str, meta: Column, **columns: Column) -> list[Column]:
    values = {
        "event_type": F.lit(kind),
        "symbol": F.col("symbol"),
        "expiration": F.col("expiration"),
        "strike": F.col("strike").cast("double"),
        "option_type": F.upper("option_type"),
        "meta": F.to_json(meta),
        **columns,
    }
    return [values[name].alias(name) for name in (*EVENT_COLUMNS, EVENT_KEY)]


def _key(*parts: Column) -> Column:
    """The parts in writing, nulls included."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts))


def _clean(trades: DataFrame) -> DataFrame:
    """Unknown sizes and sides count as zero; rows without a timestamp are dropped."""
    return trades.where(F.col("ts").isNotNull()).withColumns(
        {
            "size": F.coalesce(F.col("size").cast("bigint"), F.lit(0)),
            "side": F.coalesce(F.col("side").cast("int"), F.lit(0)),
        }
    )


def blocks(trades: DataFrame, *, min_size: int = 100) -> DataFrame:
    """One event per print of at least ``min_size`` contracts."""
    venue = F.array_compact(F.array(F.col("exchange")))
    micro_price = F.round(F.col("price").cast("double") * 1_000_000).cast("bigint")
    sequence = F.col("seq") if "seq" in trades.columns else F.lit(None)
    return _clean(trades).where(F.col("size") >= min_size).select(
        *_event(
            "BLOCK",
            F.struct(F.lit(min_size).alias("threshold")),
            ts=F.col("ts"),
            side=F.col("side"),
            size=F.col("size"),
            price=F.col("price").cast("double"),
            legs=F.lit(1),
            venues=venue,
            **{EVENT_KEY: _key(F.unix_micros("ts"), sequence, F.col("exchange"), micro_price, F.col("side"), F.col("size"))},
        )
    )


def unusual_volume(
    trades: DataFrame,
    *,
    daily_average: DataFrame | None = None,
    multiplier: float = 5.0,
    min_volume: int = 5000,
) -> DataFrame:
    """Contracts whose volume is far above their daily average, or above a fixed floor.

    A contract is flagged once for the day of its newest print, however often the growing tape
    is looked at. ``daily_average`` has the contract columns and ``avg_daily_volume``. The tape is reduced
    to one row per contract before anything is joined.
    """
    volumes = _clean(trades).groupBy(*CONTRACT).agg(
        F.sum("size").alias("_volume"), F.max("ts").alias("_ts"), F.count(F.lit(1)).alias("_legs")
    )
    if daily_average is None:
        volumes = volumes.withColumn("_average", F.lit(None).cast("double"))
    else:
        averages = daily_average.select(
            *CONTRACT, F.col("avg_daily_volume").cast("double").alias("_average")
        )
        volumes = volumes.join(averages, list(CONTRACT), "left")
    floor = F.when(F.col("_average") > 0, F.col("_average") * multiplier).otherwise(
        F.lit(float(min_volume))
    )
    flagged = volumes.withColumn("_floor", floor).where(F.col("_volume") >= F.col("_floor"))
    meta = F.struct(
        F.col("_volume").alias("today_volume"),
        F.col("_average").alias("avg_daily_volume"),
        F.col("_floor").alias("threshold"),
        F.lit(multiplier).alias("uoa_volume_multiplier"),
    )
    return flagged.select(
        *_event(
            "UOA",
            meta,
            ts=F.col("_ts"),
            side=F.lit(0),
            size=F.col("_volume"),
            price=F.lit(None).cast("double"),
            legs=F.col("_legs").cast("int"),
            venues=F.array().cast("array<string>"),
            **{EVENT_KEY: _key(F.to_date("_ts"))},
        )
    )


def later_venue(venue: np.ndarray, wanted: int) -> np.ndarray:
    """For each print the place where ``wanted`` different venues have been seen from it on.

    Venues are numbers, -1 for none; beyond the last print where there are not as many.
    """
    n = len(venue)
    kinds = np.unique(venue[venue >= 0])
    if len(kinds) < wanted:
        return np.full(n, n)
    following = np.full((len(kinds), n + 1), n)
    for row, kind in zip(following, kinds):
        row[:n][venue == kind] = np.flatnonzero(venue == kind)
        row[:] = np.minimum.accumulate(row[::-1])[::-1]
    following.partition(wanted - 1, axis=0)
    return following[wanted - 1, :n]


def sweep_reach(
    us: np.ndarray, side: np.ndarray, venue: np.ndarray, window_us: int, min_legs: int, min_venues: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each ordered print one past the last print it reaches, and whether that is a sweep.

    A print reaches what follows on its side without a break and within the window.
    """
    n = len(us)
    place = np.arange(n)
    if not n:
        return place, np.zeros(0, bool)
    turns = np.append(np.flatnonzero(side[1:] != side[:-1]) + 1, n)
    end = np.minimum(turns[np.searchsorted(turns, place, "right")], np.searchsorted(us, us + window_us, "right"))
    enough = later_venue(venue, min_venues) < end if min_venues > 0 else np.ones(n, bool)
    return end, (side != 0) & (end - place >= min_legs) & enough


def greedy_sweeps(us, side, venue, window_us, min_legs, min_venues) -> tuple[np.ndarray, np.ndarray]:
    """Where to look on after each print: past its sweep, or else at the next print; and the
    prints that begin a sweep if looked at."""
    end, hit = sweep_reach(us, side, venue, window_us, min_legs, min_venues)
    return np.where(hit, end, np.arange(len(us)) + 1), hit


def ordered_prints(table: pa.Table, order: Sequence[str] = ("ts", "seq")) -> pa.Table:
    return table.sort_by([("_us", "ascending"), *((c, "ascending") for c in order[1:])])


def print_columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = table["exchange"].combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    venue = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return table["_us"].to_numpy(), table["side"].to_numpy(), venue


def sweep_rows(
    table: pa.Table, starts: Sequence[int], ends: np.ndarray, more: Sequence[str] = ("seq",)
) -> list[tuple]:
    """(microseconds, side, size, price, legs, venues, key) of the sweeps of an ordered table.

    ``more`` are the columns that tell prints of one microsecond apart.
    """
    us, side = table["_us"].to_numpy(), table["side"].to_numpy()
    size = table["size"].to_numpy()
    paid = np.nan_to_num(table["price"].to_numpy(zero_copy_only=False)) * size
    sizes = np.concatenate([[0], np.cumsum(size)])
    out = []
    for a in starts:
        b = int(ends[a])
        total = int(sizes[b] - sizes[a])
        venues = sorted({x for x in table["exchange"].slice(a, b - a).to_pylist() if x is not None})
        value = sum(paid[a:b].tolist()) / total if total else None
        key = "|".join(str(table[c][i].as_py()) for i in (a, b - 1) for c in ("_us", *more))
        out.append((int(us[a]), int(side[a]), total, value, b - a, venues, key))
    return out


def sweeps(
    trades: DataFrame,
    *,
    window_ms: int = 100,
    min_legs: int = 3,
    min_venues: int = 2,
    keys: Sequence[str] = CONTRACT,
    order: Sequence[str] = ("ts", "seq"),
) -> DataFrame:
    """Runs of same-side prints of one contract on several venues within a short window.

    A print reaches the prints of its side that follow without a break within the window;
    enough of them on enough venues are a sweep, and the next sweep begins after it. The tape
    of a contract is cut into slices of ``SLICE_WINDOWS`` windows that also see one window of
    the next slice, and the choice is made by :func:`strikelens.operators.greedy.choose`: work
    and memory are linear in the prints, however many share a window.
    """
    keys, order = list(keys), list(order)
    window_us = max(window_ms * 1000, 1)
    length = F.lit(SLICE_WINDOWS * window_us)
    us = F.unix_micros(order[0])
    own = F.floor(us / length)
    early = us - own * length <= window_us
    prints = (
        _clean(trades)
        .select(
            *keys,
            us.alias("_us"),
            *order[1:],
            "side",
            "size",
            F.col("price").cast("double").alias("price"),
            F.col("exchange").cast("string").alias("exchange"),
            own.alias("_own"),
            F.explode(F.when(early, F.array(own, own - 1)).otherwise(F.array(own))).alias("_slice"),
        )
    )

    def analysed(table: pa.Table):
        table = ordered_prints(table, order)
        following, hit = greedy_sweeps(*print_columns(table), window_us, min_legs, min_venues)
        mine = int((table["_own"].to_numpy() == table["_slice"].to_numpy()).sum())
        return table, following, hit, mine

    def steps(table: pa.Table):
        """States are how many prints of a slice the sweeps before it have used up."""
        table, following, _, mine = analysed(table)
        if not mine:  # the slice holds nothing but the beginning of the next
            return np.array([0]), np.array([0])
        us_ = table["_us"].to_numpy()[:mine]
        entries = int(np.searchsorted(us_, us_[0] - us_[0] % (SLICE_WINDOWS * window_us) + window_us, "right"))
        ends = np.append(greedy.settled(following, mine), mine)[: entries + 1]
        return np.arange(len(ends)), ends - mine

    def chosen(table: pa.Table, state: int) -> pa.Table:
        table, following, hit, mine = analysed(table)
        starts, _ = greedy.walked(following, hit, state, mine)
        found = sweep_rows(table, starts, following, order[1:])
        rows = [*zip(*found)] if found else [[]] * 7
        first = table.slice(0, 1)
        kept = [pa.array(first[k].to_pylist() * len(found), first[k].type) for k in keys]
        types = (
            pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.string()),
            pa.string(),
        )
        return pa.table(
            [*kept, *(pa.array(list(c), t) for c, t in zip(rows, types))],
            names=[*keys, "_us", "side", "size", "price", "legs", "venues", EVENT_KEY],
        )

    types = {f.name: f.dataType.simpleString() for f in prints.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", _us bigint, side int, size bigint, price double, legs int, venues array<string>, "
        f"{EVENT_KEY} string"
    )
    found = greedy.choose(prints, keys, "_slice", steps, chosen, schema, adjacent=True)
    return found.select(
        *_event(
            "SWEEP",
            F.struct(F.lit(window_ms).alias("window_ms")),
            ts=F.timestamp_micros("_us"),
            side=F.col("side"),
            size=F.col("size"),
            price=F.col("price"),
            legs=F.col("legs"),
            venues=F.col("venues"),
            **{EVENT_KEY: F.col(EVENT_KEY)},
        )
    )


def with_event_id(events: DataFrame) -> DataFrame:
    """Deterministic id, so that finding an event again does not store it twice.

    Blocks are told apart by time, sequence, venue, price, side and size, sweeps by their first
    and last print, unusual volume by its day (or window).
    """
    identity = F.concat_ws(
        "|", "event_type", "symbol", "expiration", "strike", "option_type", EVENT_KEY
    )
    return events.withColumn("event_id", F.sha2(identity, 256)).drop(EVENT_KEY)


def flow_events(
    trades: DataFrame,
    *,
    daily_average: DataFrame | None = None,
    sweep: dict | None = None,
    block_min_size: int = 100,
    unusual: dict | None = None,
) -> DataFrame:
    """Sweeps, blocks and unusual volume in one table with ids."""
    found = (
        sweeps(trades, **(sweep or {}))
        .unionByName(blocks(trades, min_size=block_min_size))
        .unionByName(unusual_volume(trades, daily_average=daily_average, **(unusual or {})))
    )
    return with_event_id(found)


def premium_buckets(
    trades: DataFrame, *, bucket: str = "1 minute", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Dealer signed premium per time bucket, calls and puts apart, sided trades only."""
    premium = dealer_premium(
        F.col("side"),
        F.coalesce("size", F.lit(0)),
        F.coalesce(F.col("price").cast("double"), F.lit(0.0)),
    )
    return (
        trades.where(F.coalesce("side", F.lit(0)) != 0)
        .where(F.col("ts").isNotNull())
        .withColumn("_premium", premium)
        .groupBy(*keys, F.window("ts", bucket).alias("_bucket"))
        .agg(
            F.sum(F.when(is_call(), F.col("_premium")).otherwise(0.0)).alias("call_premium"),
            F.sum(F.when(is_call(), 0.0).otherwise(F.col("_premium"))).alias("put_premium"),
        )
        .select(*keys, F.col("_bucket.start").alias("ts"), "call_premium", "put_premium")
    )


def hiro(
    trades: DataFrame, *, bucket: str = "1 minute", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Running signed premium over gap-free buckets from the first trade to the last.

    The tape is reduced to buckets first; gap fill and running sum work on the buckets.
    """
    return accumulate_buckets(premium_buckets(trades, bucket=bucket, keys=keys), bucket=bucket, keys=keys)


def accumulate_buckets(
    buckets: DataFrame, *, bucket: str = "1 minute", keys: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Fill the gaps and accumulate: each bucket stands for itself and the gap after it."""
    keys = list(keys)
    step = F.expr(f"INTERVAL {bucket}")
    along = Window.partitionBy(*keys).orderBy("ts")
    last = F.lead("ts").over(along)
    times = F.when(F.col("_next").isNull(), F.array("ts")).otherwise(
        F.sequence(F.col("ts"), F.col("_next") - step, step)
    )
    filled = buckets.withColumn("_next", last).withColumn("_at", F.explode(times))
    own = F.col("_at") == F.col("ts")
    filled = filled.select(
        *keys,
        F.col("_at").alias("ts"),
        *(F.when(own, F.col(c)).otherwise(0.0).alias(c) for c in ("call_premium", "put_premium")),
    )
    return filled.withColumn(
        "net_premium", F.col("call_premium") + F.col("put_premium")
    ).withColumn(
        "cumulative", F.sum("net_premium").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
