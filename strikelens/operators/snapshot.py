"""Chain snapshots: newest row per contract, open-interest fill, spot resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from strikelens.functions.columns import (
    day,
    instant,
    is_call,
    is_put,
    price_mid_first,
    year_fraction,
)
from strikelens.operators.scan import last_known, with_slices, without_slices

LEG = ("expiration", "strike", "option_type")
LOOKBACK = "2 days"
FUTURES_WINDOW = "15 minutes"

# Futures root that prices each cash symbol.
FUTURES_ROOT = {"SPXW": "ES", "SPX": "ES", "NDXP": "NQ", "NDX": "NQ"}


def _newest(chain: DataFrame, group: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Newest row per group; of rows with one timestamp that of the largest row hash.

    Time and hash are one number, so the buffers have a fixed width and the aggregate hashes and
    never sorts the raw rows; all columns still come from one row. With a tie-break whole rows
    are compared in its order, which sorts them.
    """
    rest = [c for c in chain.columns if c not in group]
    if tiebreak:
        newest = F.max_by(F.struct(*rest), F.struct("ts", *tiebreak)).alias("_row")
        return chain.groupBy(*group).agg(newest).select(*group, "_row.*")
    number = "decimal(38,0)"
    position = F.unix_micros("ts").cast(number) * F.lit(1 << 62).cast("decimal(20,0)") + F.shiftrightunsigned(
        F.xxhash64(*sorted(rest)), 2
    ).cast("decimal(20,0)")
    placed = chain.withColumn("_position", position.cast(number))
    columns = [F.max_by(c, "_position").alias(c) for c in rest]
    return placed.groupBy(*group).agg(*columns)


def latest_snapshot(
    chain: DataFrame,
    *,
    as_of,
    lookback: str | None = LOOKBACK,
    keys: Sequence[str] = ("symbol",),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Newest row per contract in ``(as_of - lookback, as_of]``.

    An aggregate, not a window: each task keeps one row per contract before the shuffle,
    so a contract with a third of all rows costs no more than the others.
    """
    now = instant(as_of)
    scope = chain.where(F.col("ts") <= now)
    if lookback:
        scope = scope.where(F.col("ts") > now - F.expr(f"INTERVAL {lookback}"))
    return _newest(scope, [*keys, *LEG], tiebreak)


def snapshot_series(
    chain: DataFrame,
    *,
    every: str,
    lookback: str = LOOKBACK,
    keys: Sequence[str] = ("symbol",),
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """At each grid time what :func:`latest_snapshot` gives for it as ``as_of``.

    ``snapshot_ts`` runs over the multiples of ``every``, for each of ``keys`` up to the first
    one not before its last row. Only the newest row of a contract between two grid times can
    be seen, so the tape is reduced to these first; each then stands at every grid time until
    the contract's next one, at most ``lookback`` old.
    """
    step, age = F.expr(f"INTERVAL {every}"), F.expr(f"INTERVAL {lookback}")

    def grid(ts: Column) -> Column:
        """The first grid time at or after ``ts``."""
        return F.window(ts - F.expr("INTERVAL 1 MICROSECOND"), every)["end"]

    contract = [*keys, *LEG]
    seen = _newest(
        chain.where(F.col("ts").isNotNull()).withColumn("_from", grid(F.col("ts"))),
        ["_from", *contract],
        tiebreak,
    )
    last = chain.groupBy(*(F.col(k).alias(f"_of_{k}") for k in keys)).agg(F.max("ts").alias("_last"))
    last = last.where(F.col("_last").isNotNull()).withColumn("_last", grid(F.col("_last")))
    along = Window.partitionBy(*contract).orderBy("_from")
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    bounded = (
        seen.withColumn("_next", F.lead("_from").over(along))
        .withColumn("_stale", grid(F.col("ts") + age))
        .join(last, condition)
        .withColumn("_stop", F.least("_next", "_stale", F.col("_last") + step))
        .where(F.col("_stop") > F.col("_from"))
    )
    times = F.explode(F.sequence(F.col("_from"), F.col("_stop") - step, step)).alias("snapshot_ts")
    return bounded.select(times, *chain.columns)


def fill_open_interest(chain: DataFrame, eod: DataFrame) -> DataFrame:
    """Take end-of-day open interest where the live value is null or zero.

    A contract without an end-of-day row gets 0; a symbol without any end-of-day row
    keeps what it has.
    """
    # Letters of either case name one contract; the newest load of it counts.
    load = F.struct("oi_date", "open_interest") if "oi_date" in eod.columns else F.struct("open_interest")
    book = eod.groupBy(
        "symbol",
        "expiration",
        F.col("strike").cast("double").alias("strike"),
        F.upper("option_type").alias("option_type"),
    ).agg(F.max(load)["open_interest"].alias("_eod"))
    covered = eod.select("symbol").distinct().withColumn("_covered", F.lit(True))
    live = F.col("oi")
    needs = (live.isNull() | (live == 0)) & F.col("_covered").isNotNull()
    return (
        chain.withColumn("option_type", F.upper("option_type"))
        .join(book, ["symbol", *LEG], "left")
        .join(covered, "symbol", "left")
        .withColumn("oi", F.when(needs, F.coalesce("_eod", F.lit(0))).otherwise(live))
        .select(*chain.columns)
    )


def with_spot(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Add ``spot``: the last non-null underlying price in contract order.

    The window hash-partitions the snapshot by ``keys``. Every operator that groups by
    ``keys`` plus a strike or an expiry reuses that layout, so it adds no shuffle.
    """
    if "spot" in chain.columns:
        return chain
    priced = F.when(
        F.col("underlying_price").isNotNull(),
        F.struct("expiration", "strike", "option_type", "underlying_price"),
    )
    newest = F.max(priced).over(Window.partitionBy(*keys))
    return chain.withColumn("spot", newest["underlying_price"])


def chain_spot(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """One row per key with the last non-null underlying price, null when there is none."""
    return chain.groupBy(*keys).agg(
        F.max_by(
            "underlying_price",
            F.when(F.col("underlying_price").isNotNull(), F.struct(*LEG)),
        ).alias("spot")
    )


def parity_spot(
    chain: DataFrame,
    *,
    as_of,
    rate: float = 0.05,
    max_expiries: int = 3,
    keys: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Spot implied by put-call parity: median over the first expiries with prices.

    Expects one row per contract. Call and put of a strike meet in one aggregate row,
    so no join of the chain with itself is needed.
    """
    legs = (
        chain.withColumn("_price", price_mid_first())
        .where(F.col("_price").isNotNull())
        .groupBy(*keys, *LEG[:2])
        .agg(
            F.max(F.when(is_call(), F.col("_price"))).alias("_call"),
            F.max(F.when(is_put(), F.col("_price"))).alias("_put"),
        )
        .withColumn("_gap", F.col("_call") - F.col("_put"))
    )
    pivot = F.min_by(
        F.struct("strike", "_gap"),
        F.when(F.col("_gap").isNotNull(), F.struct(F.abs("_gap"), F.col("strike"))),
    )
    order = Window.partitionBy(*keys).orderBy("expiration")
    discount = F.exp(year_fraction(as_of) * -rate)
    per_expiry = (
        legs.groupBy(*keys, "expiration")
        .agg(pivot.alias("_atm"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= max_expiries)
        .withColumn("_spot", F.col("_atm.strike") * discount + F.col("_atm._gap"))
    )
    sane = (F.col("_spot") > 1.0) & (F.col("_spot") < 1e6)
    return per_expiry.groupBy(*keys).agg(
        F.median(F.when(sane, F.col("_spot"))).alias("parity_spot")
    )


def futures_root_of(symbol: str = "symbol") -> Column:
    """Futures root behind a cash symbol, null for symbols without one."""
    pairs = [F.lit(x) for pair in FUTURES_ROOT.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.upper(symbol))


def futures_at(
    snapshots: DataFrame,
    ticks: DataFrame,
    *,
    window: str = FUTURES_WINDOW,
    order: Sequence[str] = ("seq",),
) -> DataFrame:
    """Latest futures price of each symbol's root at each snapshot, at most ``window`` old.

    ``snapshots`` has ``snapshot_ts`` and ``symbol``. Ticks and snapshots share one ordered
    scan per root; ticks of equal time count as seen.
    """
    wanted = snapshots.select(
        F.col("snapshot_ts").alias("ts"),
        futures_root_of().alias("root"),
        "symbol",
        F.lit(1).alias("_late"),
        *(F.lit(None).cast(ticks.schema[c].dataType).alias(c) for c in order),
        F.lit(None).cast("double").alias("price"),
    ).where(F.col("root").isNotNull())
    roots = [F.when(F.col("symbol").startswith(r), r) for r in sorted(set(FUTURES_ROOT.values()))]
    seen = ticks.select(
        "ts",
        F.coalesce(*roots).alias("root"),
        F.lit(None).cast("string").alias("symbol"),
        F.lit(0).alias("_late"),
        *order,
        F.col("price").cast("double").alias("price"),
    ).where(F.col("root").isNotNull())
    timeline = ["ts", "_late", *order]
    scanned = last_known(
        with_slices(wanted.unionByName(seen), timeline),
        {"_tick": F.when(F.col("_late") == 0, F.struct("ts", "price"))},
        ["root"],
        timeline,
    )
    fresh = F.col("_tick.ts") > F.col("ts") - F.expr(f"INTERVAL {window}")
    usable = fresh & (F.col("_tick.price") > 0)
    return without_slices(scanned.where(F.col("_late") == 1)).select(
        F.col("ts").alias("snapshot_ts"),
        "symbol",
        F.when(usable, F.col("_tick.price")).alias("futures_price"),
    )


def basis_carry(
    spots: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "snapshot_ts"
) -> DataFrame:
    """Spot per snapshot: parity, else the futures price less the last known basis.

    ``spots`` has ``parity_spot`` and ``futures_price`` per snapshot; the basis is futures
    minus parity, remembered from the snapshots where both were known, 0 before the first.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    known = F.col("futures_price") - F.col("parity_spot")
    carried = F.coalesce(
        F.last(known, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)),
        F.lit(0.0),
    )
    return spots.withColumn("basis", carried).withColumn(
        "resolved_spot",
        F.coalesce(F.col("parity_spot"), F.col("futures_price") - F.col("basis")),
    )


def last_basis(
    spots: DataFrame, keys: Sequence[str] = ("symbol",), order: str = "snapshot_ts"
) -> DataFrame:
    """The newest known basis per key, to be stored for the next live snapshot."""
    known = spots.withColumn("basis", F.col("futures_price") - F.col("parity_spot")).where(
        F.col("basis").isNotNull()
    )
    return known.groupBy(*keys).agg(
        F.max_by("basis", F.struct(order, "basis")).alias("basis"), F.max(order).alias(order)
    )


def resolve_spot(
    chain: DataFrame,
    *,
    as_of,
    futures: DataFrame | None = None,
    basis: DataFrame | None = None,
    rate: float = 0.05,
    keys: Sequence[str] = ("snapshot_ts", "symbol"),
) -> DataFrame:
    """Replace the underlying price of snapshots whose feed has none.

    A snapshot keeps its prices when its last non-null underlying is above zero. Others
    take one resolved spot for all rows, or stay as they are when none can be found.
    ``futures`` holds ``futures_price`` per ``keys`` (see :func:`futures_at`). A history
    remembers the basis by itself; a live snapshot takes the last known one from ``basis``
    (``symbol`` and ``basis``, see :func:`last_basis`), 0 where there is none.
    """
    own = chain_spot(chain, keys)
    needing = own.where(F.coalesce(F.col("spot"), F.lit(0.0)) <= 0).select(*keys)
    implied = parity_spot(
        chain.join(needing, list(keys), "left_semi"), as_of=as_of, rate=rate, keys=keys
    )
    table = needing.join(implied, list(keys), "left")
    if futures is None:
        table = table.withColumn("futures_price", F.lit(None).cast("double"))
    else:
        table = table.join(futures.select(*keys, "futures_price"), list(keys), "left")
    if "snapshot_ts" in keys:
        resolved = basis_carry(table, [k for k in keys if k != "snapshot_ts"])
    else:
        if basis is None:
            known = table.withColumn("basis", F.lit(0.0))
        else:
            known = table.join(basis.select("symbol", "basis"), "symbol", "left").na.fill(0.0, ["basis"])
        resolved = known.withColumn(
            "resolved_spot",
            F.coalesce(F.col("parity_spot"), F.col("futures_price") - F.col("basis")),
        )
    return (
        chain.join(resolved.select(*keys, "resolved_spot"), list(keys), "left")
        .withColumn("underlying_price", F.coalesce("resolved_spot", "underlying_price"))
        .drop("resolved_spot")
    )


def latest_underlying(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Newest non-null underlying price per key over the whole chain table.

    Of the rows of the newest time the last in contract order counts, as in :func:`chain_spot`.
    """
    return (
        chain.where(F.col("underlying_price").isNotNull())
        .groupBy(*keys)
        .agg(
            F.max_by("underlying_price", F.struct("ts", *LEG, "underlying_price")).alias("underlying_price"),
            F.max("ts").alias("ts"),
        )
    )


#: The columns whose coverage is watched.
WATCHED = ("bid", "ask", "last_price", "underlying_price", "iv", "gamma")


def watched(chain: DataFrame, seen: Observation) -> DataFrame:
    """``chain`` as it is; whoever writes it also counts its rows and filled values, into ``seen.get``."""
    return chain.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"have_{c}") for c in WATCHED))


def snapshot_health(chain: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Rows and non-null counts before the metrics run, with the two warning flags."""
    counts = chain.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"have_{c}") for c in WATCHED)
    )
    no_spot = F.col("have_underlying_price") == 0
    thin = ~no_spot & ((F.col("have_iv") == 0) | (F.col("have_gamma") == 0))
    return counts.withColumns({"no_underlying": no_spot, "low_greek_coverage": thin})


def dte(as_of, expiration: str = "expiration") -> Column:
    """Days to expiry; negative when past."""
    return F.datediff(F.col(expiration), day(as_of))
