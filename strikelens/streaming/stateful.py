"""Streaming operators with state for instruments or contracts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strikelens.functions.columns import CONTRACT
from strikelens.operators import greedy
from strikelens.operators.flow import greedy_sweeps, print_columns, sweep_rows
from strikelens.operators.tape import trade_tape
from strikelens.session import ship_package

CARRIED = ("bid", "ask", "last_price", "oi")
KNOWN = (*CARRIED, "volume")
STATE = "instrument_id array<bigint>, " + ", ".join(f"{name} array<double>" for name in KNOWN)
CHAIN_ROW = (
    "instrument_id bigint, ts timestamp, seq bigint, kind string, price double, size double, "
    + ", ".join(f"{name} double" for name in KNOWN)
)

#: Keys share a state by hash: a call works on a part of them with arrays, since a call of its own for each
#: costs more than its rows. A checkpoint belongs to one number of parts.
PARTS = 1024
#: The part of a null key.
NAMELESS = -1


def _part(*keys: str) -> Column:
    spread = F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int")
    if len(keys) > 1:
        return spread.alias("_part")
    return F.when(F.col(keys[0]).isNull(), NAMELESS).otherwise(spread).alias("_part")


def _groups(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted ids: where each begins, the number of each row's, and where each row's begins."""
    new = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    begin, number = np.flatnonzero(new), np.cumsum(new) - 1
    return begin, number, begin[number]


def _advance(rows: pd.DataFrame, ids: np.ndarray, known: dict[str, np.ndarray]) -> pd.DataFrame:
    """Carry the known values, one for each of the sorted instruments, through their ordered records."""
    begin, number, first = _groups(ids)
    place = np.arange(len(rows))
    kind = rows["kind"].to_numpy()

    def last(values: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = np.maximum.accumulate(np.where(np.isnan(values), -1, place))
        return np.where(at >= first, values[at], before[number])

    def column(name: str, *kinds: str) -> np.ndarray:
        values = rows[name].to_numpy(np.float64, na_value=np.nan)
        return np.where(np.isin(kind, kinds), values, np.nan) if kinds else values

    out = rows[["instrument_id", "ts", "seq", "kind", "price", "size"]].copy()
    seen = {
        "bid": column("bid"),
        "ask": column("ask"),
        "last_price": column("price", "trade", "quote"),
        "oi": column("quantity", "open_interest"),
    }
    for name, values in seen.items():
        out[name] = last(values, known[name])
    traded, reset = column("size", "trade"), column("quantity", "cumulative_volume")
    total = np.cumsum(np.nan_to_num(traded))
    total -= (total - np.nan_to_num(traded))[first]
    offset = last(reset - total, np.nan_to_num(known["volume"]))
    told = last(np.where(np.isnan(traded) & np.isnan(reset), np.nan, 1.0), known["volume"])
    out["volume"] = np.where(np.isnan(told), np.nan, total + offset)
    return out


def _built(batches: Iterator[pd.DataFrame], part: int, known: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """The chain rows of a part and what is known of its instruments afterwards."""
    rows = pd.concat(list(batches)).sort_values(["instrument_id", "ts", "seq"], kind="stable", ignore_index=True)
    ids = np.zeros(len(rows), np.int64) if part == NAMELESS else rows["instrument_id"].to_numpy(np.int64)
    begin, _, _ = _groups(ids)
    mine, before = _looked_up(known, ids[begin])
    built = _advance(rows, ids, before)
    ends = built.iloc[np.append(begin[1:], len(ids)) - 1]
    return built, _told(mine, ids[begin], {name: ends[name].to_numpy(np.float64) for name in KNOWN})


def _stored(known: tuple | None) -> dict[str, np.ndarray]:
    """A part's state as arrays in the order of its ids; what is not known is not a number."""
    kept = known if known is not None else [[] for _ in range(1 + len(KNOWN))]
    types = (np.int64, *[np.float64] * len(KNOWN))
    return {name: np.array(list(v), t) for name, v, t in zip(("instrument_id", *KNOWN), kept, types, strict=True)}


def _looked_up(known: tuple | None, ids: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    mine = _stored(known)
    at = np.searchsorted(mine["instrument_id"], ids)
    found = at < len(mine["instrument_id"])
    found[found] = mine["instrument_id"][at[found]] == ids[found]
    before = {name: np.full(len(ids), np.nan) for name in KNOWN}
    for name in KNOWN:
        before[name][found] = mine[name][at[found]]
    return mine, before


def _told(mine: dict[str, np.ndarray], ids: np.ndarray, values: dict[str, np.ndarray]) -> tuple:
    """The state with the instruments ``ids`` (sorted) told anew."""
    others = ~np.isin(mine["instrument_id"], ids)
    every = np.concatenate([mine["instrument_id"][others], ids])
    order = np.argsort(every, kind="stable")
    return (every[order].tolist(), *(np.concatenate([mine[n][others], values[n]])[order].tolist() for n in KNOWN))


def _begun(known: tuple | None, initial: pd.DataFrame, part: int) -> tuple:
    """The state with what a stored chain knows of the part's instruments."""
    initial = initial.sort_values("instrument_id", kind="stable")
    ids = np.zeros(len(initial), np.int64) if part == NAMELESS else initial["instrument_id"].to_numpy(np.int64)
    return _told(_stored(known), ids, {name: initial[name].to_numpy(np.float64, na_value=np.nan) for name in KNOWN})


def _build_chain(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    built, known = _built(batches, key[0], state.get if state.exists else None)
    state.update(known)
    yield built


def _chain_memory() -> StatefulProcessor:
    """The five numbers of each instrument of a part, begun with what a stored chain knows of it.

    The class is made here so that it travels by value: Spark asks a Python process beside the
    driver for its states, and that process does not have this package.
    """
    schema = STATE

    class ChainMemory(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("known", schema)

        def handleInitialState(self, key, initialState, timerValues) -> None:
            from strikelens.streaming import stateful

            known = self.known.get() if self.known.exists() else None
            self.known.update(stateful._begun(known, initialState, key[0]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            from strikelens.streaming import stateful

            built, known = stateful._built(rows, key[0], self.known.get() if self.known.exists() else None)
            self.known.update(known)
            yield built

        def close(self) -> None:
            pass

    return ChainMemory()


def known_state(chain: DataFrame) -> DataFrame:
    """What chain rows know of each instrument at their end, to start another stream with."""
    newest = F.max_by(F.struct(*KNOWN), F.struct("ts", "seq")).alias("_known")
    return chain.groupBy("instrument_id").agg(newest).select("instrument_id", "_known.*")


def chain_rows(
    records: DataFrame, *, late: str = "10 minutes", initial: DataFrame | None = None
) -> DataFrame:
    """One chain row per record with everything known of its instrument so far.

    The state per instrument is five numbers and is never dropped: a weekend, or a month
    without a record, changes nothing. A call sees the records of one of :data:`PARTS` parts of the
    instruments in one micro-batch, which the source's rate limits
    (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``) keep small.

    A stream without a checkpoint starts blind, or with ``initial``, the :func:`known_state` of a
    stored chain; it needs :data:`strikelens.streaming.runner.ROCKSDB` then.
    """
    ship_package(records.sparkSession)
    wanted = records.withWatermark("ts", late).select(
        _part("instrument_id"),
        F.col("instrument_id").cast("bigint").alias("instrument_id"),
        "ts",
        F.col("seq").cast("bigint").alias("seq"),
        "kind",
        *(F.col(c).cast("double").alias(c) for c in ("price", "size", "bid", "ask", "quantity")),
    )
    if initial is not None:
        begin = initial.select(_part("instrument_id"), F.col("instrument_id").cast("bigint").alias("instrument_id"), *KNOWN)
        return wanted.groupBy("_part").transformWithStateInPandas(
            _chain_memory(),
            outputStructType=CHAIN_ROW,
            outputMode="Append",
            timeMode="None",
            initialState=begin.groupBy("_part"),
        )
    return wanted.groupBy("_part").applyInPandasWithState(
        _build_chain,
        CHAIN_ROW,
        STATE,
        "append",
        GroupStateTimeout.NoTimeout,
    )


def option_trades(records: DataFrame, *, initial: DataFrame | None = None) -> DataFrame:
    """The trades among the records with the quote at trade, its side and the premium."""
    trades = chain_rows(records, initial=initial).where((F.col("kind") == "trade") & F.col("price").isNotNull())
    return trade_tape(trades.select("instrument_id", "ts", "seq", "price", "size", "bid", "ask"))


MATCHED = (
    "instrument_id bigint, ts timestamp, seq bigint, kind string, symbol string, expiration date, "
    "strike double, option_type string"
)
DEFINED = "instrument_id array<bigint>, _us array<bigint>, symbol array<string>, expiration array<string>, strike array<double>, option_type array<string>"
DEFINITION = "definition"


def _match_contracts(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    names = ["instrument_id", "_us", *CONTRACT]
    rows = pd.concat(list(batches))
    if key[0] == NAMELESS:
        rows["instrument_id"] = 0
    told = rows.loc[rows["kind"] == DEFINITION, names]
    if state.exists:
        told = pd.concat([pd.DataFrame(dict(zip(names, map(list, state.get), strict=True))), told])
    versions = told.sort_values(names, kind="stable").drop_duplicates(names[:2], keep="last")
    records = rows.loc[rows["kind"] != DEFINITION, ["instrument_id", "ts", "_us", "seq", "kind"]]
    records = records.sort_values(["instrument_id", "_us", "seq"], kind="stable")
    # Both in one order, a version before the records of its time: each record's is the last one before it.
    ids = np.concatenate([versions["instrument_id"].to_numpy(np.int64), records["instrument_id"].to_numpy(np.int64)])
    us = np.concatenate([versions["_us"].to_numpy(np.int64), records["_us"].to_numpy(np.int64)])
    order = np.lexsort((np.arange(len(ids)) >= len(versions), us, ids))
    _, _, first = _groups(ids[order])
    at = np.maximum.accumulate(np.where(order < len(versions), np.arange(len(order)), -1))
    place = np.empty(len(order), np.int64)
    place[order] = np.where(at >= first, order[at], -1)
    place = place[len(versions) :]
    records, place = records[place >= 0], place[place >= 0]
    found = versions.iloc[place][list(CONTRACT)].reset_index(drop=True)
    out = pd.concat([records.reset_index(drop=True).drop(columns="_us"), found], axis=1)
    if key[0] == NAMELESS:
        out["instrument_id"] = None
    days = {text: dt.date.fromisoformat(text) for text in out["expiration"].dropna().unique()}
    out["expiration"] = out["expiration"].map(days).astype(object)
    # A record behind the watermark meets the version that stood there, and none before it.
    ids, us = ids[: len(versions)], us[: len(versions)]
    replaced = np.append((ids[1:] == ids[:-1]) & (us[1:] <= state.getCurrentWatermarkMs() * 1000), False)[: len(ids)]
    versions = versions[~replaced]
    if len(versions):
        state.update(tuple(versions[n].tolist() for n in names))
    yield out


def matched_contracts(records: DataFrame, versions: DataFrame, *, late: str = "10 minutes") -> DataFrame:
    """:func:`strikelens.operators.tape.with_contract_at` on streams of records and of definitions.

    Instruments share :data:`PARTS` states. The state of an instrument holds the versions that a record may still meet: those since the
    watermark and the one before. A record that comes before its first definition is dropped, so
    definitions have to come with or before the records that they are for.
    """
    ship_package(records.sparkSession)
    empty = {"seq": F.lit(None).cast("bigint"), "kind": F.lit(DEFINITION)}
    told = versions.select(
        "instrument_id", F.col("defined_at").alias("ts"), *(c.alias(n) for n, c in empty.items()),
        "symbol", F.col("expiration").cast("string").alias("expiration"), F.col("strike").cast("double").alias("strike"), "option_type",
    )
    seen = records.select("instrument_id", "ts", F.col("seq").cast("bigint").alias("seq"), "kind")
    both = seen.unionByName(told, allowMissingColumns=True).withColumn("_us", F.unix_micros("ts")).withWatermark("ts", late)
    return both.withColumn("_part", _part("instrument_id")).groupBy("_part").applyInPandasWithState(
        _match_contracts, MATCHED, DEFINED, "append", GroupStateTimeout.NoTimeout
    )


SWEEP_ROW = (
    "symbol string, expiration date, strike double, option_type string, ts timestamp, "
    "side int, size bigint, price double, legs int, venues array<string>, event_key string"
)
#: Prints that wait for the end of their window, with their contracts.
WAITING = pa.schema(
    [
        ("symbol", pa.string()), ("expiration", pa.date32()), ("strike", pa.float64()), ("option_type", pa.string()),
        ("_us", pa.int64()), ("seq", pa.int64()), ("side", pa.int32()), ("size", pa.int64()),
        ("price", pa.float64()), ("exchange", pa.string()),
    ]
)
PENDING = (
    "symbol array<string>, expiration array<date>, strike array<double>, option_type array<string>, "
    "_us array<bigint>, seq array<bigint>, side array<int>, size array<bigint>, "
    "price array<double>, exchange array<string>"
)


def _contract_numbers(table: pa.Table) -> np.ndarray:
    """Equal numbers for prints of equal contracts; null is a value like any other."""
    number = np.zeros(table.num_rows, np.int64)
    for name in CONTRACT:
        codes = table[name].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return number


def _sweep_finder(window_ms: int, min_legs: int, min_venues: int):
    window_us = max(window_ms * 1000, 1)

    def find(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState):
        parts = []
        if state.exists:
            parts.append(pa.table([pa.array(list(v), t) for v, t in zip(state.get, WAITING.types, strict=True)], schema=WAITING))
        if not state.hasTimedOut:
            parts += [pa.Table.from_pandas(b[WAITING.names], WAITING, preserve_index=False) for b in batches]
        prints = pa.concat_tables(parts) if parts else WAITING.empty_table()
        prints = prints.append_column("_contract", pa.array(_contract_numbers(prints)))
        prints = prints.sort_by([("_contract", "ascending"), ("_us", "ascending"), ("seq", "ascending")]).combine_chunks()
        us, (begin, number, _) = prints["_us"].to_numpy(), _groups(prints["_contract"].to_numpy())
        # One line of time for all contracts, each more than a window behind the one before.
        stop = np.append(begin[1:], len(us))[: len(begin)]
        moved = np.append(0, np.cumsum(us[stop - 1] - us[begin] + window_us + 1))[: len(begin)] - us[begin]
        _, side, venue = print_columns(prints)
        following, hit = greedy_sweeps(us + moved[number], side, venue, window_us, min_legs, min_venues)
        # No later print can join what begins this early.
        late = us < state.getCurrentWatermarkMs() * 1000 - window_us
        closed = begin + np.bincount(number[late], minlength=len(begin))
        starts, at = greedy.walked_each(following, hit, begin, closed)
        left = prints.filter(pa.array(np.arange(len(us)) >= at[number])) if len(us) else prints
        if left.num_rows:
            state.update(tuple(left[n].to_pylist() for n in WAITING.names))
            due = (int(us[at[at < stop]].min()) + window_us) // 1000 + 1
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        contracts = zip(*(prints[n].take(pa.array(starts, pa.int64())).to_pylist() for n in CONTRACT), strict=True)
        rows = [
            (*contract, pd.Timestamp(at_us, unit="us"), *rest)
            for contract, (at_us, *rest) in zip(contracts, sweep_rows(prints, starts, following), strict=True)
        ]
        names = [*CONTRACT, "ts", "side", "size", "price", "legs", "venues", "event_key"]
        yield pd.DataFrame(rows, columns=names)

    return find


def sweeps(
    trades: DataFrame,
    *,
    window_ms: int = 100,
    min_legs: int = 3,
    min_venues: int = 2,
    late: str = "2 seconds",
) -> DataFrame:
    """Sweeps as soon as the watermark shows that no further print can join them.

    The choice is that of :func:`strikelens.operators.flow.sweeps`. The state
    holds the prints of the contracts' open windows only.
    """
    ship_package(trades.sparkSession)
    kinds = dict(zip(CONTRACT, ("string", "date", "double", "string"), strict=True))
    prints = trades.withWatermark("ts", late).select(
        _part(*CONTRACT),
        *(F.col(c).cast(kinds[c]).alias(c) for c in CONTRACT),
        "ts",
        F.unix_micros("ts").alias("_us"),
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(F.col("side").cast("int"), F.lit(0)).alias("side"),
        F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"),
        F.col("price").cast("double").alias("price"),
        F.col("exchange").cast("string").alias("exchange"),
    )
    return prints.groupBy("_part").applyInPandasWithState(
        _sweep_finder(window_ms, min_legs, min_venues),
        SWEEP_ROW,
        PENDING,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
