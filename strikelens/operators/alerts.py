"""Alert rules: predicate trees over the metric payload of a symbol, with cooldown.

A payload is one JSON text per symbol and snapshot, ``{metric_type: {value, ts, ...}}``.
Rules are rows of a table; their trees are flattened into leaves that are joined with payloads.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from strikelens.functions.columns import instant
from strikelens.operators import greedy
from strikelens.session import ship_package

PAYLOAD_SECONDS = 600
LONGEST_LIST = 10

# The names of the tests.
COMPARE = {
    "gt": lambda now, limit: now > limit,
    "lt": lambda now, limit: now < limit,
    "ge": lambda now, limit: now >= limit,
    "le": lambda now, limit: now <= limit,
    "eq": lambda now, limit: now == limit,
    "ne": lambda now, limit: now != limit,
    "abs_gt": lambda now, limit: F.abs(now) > limit,
    "abs_lt": lambda now, limit: F.abs(now) < limit,
}
CROSSINGS = {
    "cross_above": lambda before, now, limit: (before <= limit) & (now > limit),
    "cross_below": lambda before, now, limit: (before >= limit) & (now < limit),
}
RULE = "id string, symbol string, rule string, cooldown_seconds int, last_fired_at timestamp"


def compared(op: Column, now: Column, limit: Column) -> Column:
    """The outcome of a test that needs no earlier number; false for any other."""
    test = F.lit(False)
    for name, compare in COMPARE.items():
        test = F.when(op == name, compare(now, limit)).otherwise(test)
    return test


def load_rules(rules: DataFrame) -> DataFrame:
    """The enabled rules of the stored table."""
    return rules.where("enabled").select("id", "symbol", "rule", "cooldown_seconds", "last_fired_at")


def rule_table(spark: SparkSession, rules: Iterable[dict]) -> DataFrame:
    """Rules given as dictionaries, as a table like the stored one."""
    rows = [
        (str(r["id"]), r["symbol"], json.dumps(r["rule"]), int(r.get("cooldown_seconds") or 0), r.get("last_fired_at"))
        for r in rules
    ]
    return spark.createDataFrame(rows, RULE)


def with_last_fired(rules: DataFrame, fired: DataFrame, *, order: str = "snapshot_ts") -> DataFrame:
    """The rules with the time of their newest kept firing, to be stored again."""
    newest = fired.groupBy(F.col("rule_id").alias("_of")).agg(F.max(order).alias("_last"))
    return (
        rules.join(newest, F.col("id") == F.col("_of"), "left")
        .withColumn("last_fired_at", F.greatest("last_fired_at", "_last"))
        .select(rules.columns)
    )


def payload_number(payload: Column, field: Column) -> Column:
    """Number at a dotted path, steps being object keys or list positions; null if absent."""
    steps = F.split(field, "\\.")
    by_key = F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.concat(F.lit("['"), s, F.lit("']"))), ""))
    by_place = F.concat(
        F.lit("$"),
        F.array_join(
            F.transform(
                steps,
                lambda s: F.when(s.rlike("^[0-9]+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(
                    F.concat(F.lit("['"), s, F.lit("']"))
                ),
            ),
            "",
        ),
    )
    found = F.call_function("get_json_object", payload, by_key)
    found = F.coalesce(found, F.call_function("get_json_object", payload, by_place))
    flag = F.when(found == "true", 1.0).when(found == "false", 0.0)
    return F.coalesce(flag, found.try_cast("double"))


def constant(value) -> float | None:
    """The number that a test compares with, if its value is one."""
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _branch(node) -> tuple[list, bool] | None:
    """The children of a branch, and which outcome of a child decides it."""
    for name, stops_at in (("all", False), ("any", True)):
        if isinstance(node.get(name), list):
            return node[name], stops_at
    return None


def tree_leaves(node) -> list[dict]:
    """The tests of a rule's tree in the order they are written."""
    if not isinstance(node, dict):
        return []
    if branch := _branch(node):
        return [leaf for child in branch[0] for leaf in tree_leaves(child)]
    return [node] if isinstance(node.get("field"), str) and isinstance(node.get("op"), str) else []


def tree_verdict(node, outcomes: Iterator[bool]) -> tuple[bool, list[str]]:
    """The verdict of a tree, given the outcomes of its leaves in order, and the matched texts.

    A branch stops at the first child that decides it; later children are not looked at.
    """
    if not isinstance(node, dict):
        return False, []
    if branch := _branch(node):
        children, stops_at = branch
        verdict, texts, is_open = not stops_at, [], True
        for child in children:
            outcome, found = tree_verdict(child, outcomes)  # uses up its outcomes in any case
            if is_open:
                texts += found
                if outcome == stops_at:
                    verdict, is_open = stops_at, False
        return verdict, texts
    if not tree_leaves(node):
        return False, []
    hit = next(outcomes)
    return hit, [f"{node['field']} {node['op']} {node.get('value')}"] if hit else []


def leaf_rows(rules: DataFrame) -> DataFrame:
    """One row per leaf: rule, symbol, number of the leaf, field, operation and limit.

    A rule without any leaf has one row without a field, so that it is judged as well.
    """

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for rule_id, symbol, text in zip(batch["id"], batch["symbol"], batch["rule"]):
                for k, leaf in enumerate(tree_leaves(json.loads(text)) or [{}]):
                    rows.append((rule_id, symbol, k, leaf.get("field"), leaf.get("op"), constant(leaf.get("value"))))
            yield pd.DataFrame(rows, columns=["rule_id", "symbol", "leaf", "field", "op", "limit"])

    schema = "rule_id string, symbol string, leaf int, field string, op string, limit double"
    return rules.select("id", "symbol", "rule").mapInPandas(job, schema)


def evaluate_rules(
    payloads: DataFrame, rules: DataFrame | Sequence[dict], *, order: str = "snapshot_ts"
) -> DataFrame:
    """Every rule that fires, per snapshot: rule, matched clauses and the trimmed payload.

    Rules are rows, so ten thousand of them plan like ten. Their leaves are met by the numbers
    of the payload, taken out of its text once per field; the outcomes are put together per rule
    and snapshot, and only what fires gets its payload back. Crossings compare with the previous
    payload of the symbol; the first one has none. Anything missing or not a number is false.
    """
    spark = payloads.sparkSession
    ship_package(spark)
    if not isinstance(rules, DataFrame):
        rules = rule_table(spark, rules)
    at = F.col(order).alias("_at")
    leaves = leaf_rows(rules)
    fields = leaves.groupBy(F.col("symbol").alias("_of")).agg(
        F.collect_set(F.coalesce("field", F.lit(""))).alias("_fields")
    )
    numbers = (
        payloads.join(fields, F.col("symbol") == F.col("_of"))
        .select("symbol", at, "payload", F.explode("_fields").alias("field"))
        .select("symbol", "_at", "field", payload_number(F.col("payload"), F.col("field")).alias("now"))
    )
    before = Window.partitionBy("symbol", "field").orderBy("_at")
    numbers = numbers.withColumn("before", F.lag("now").over(before)).select(
        F.col("symbol").alias("_symbol"), "_at", F.col("field").alias("_field"), "now", "before"
    )
    now, limit = F.col("now"), F.col("limit")
    test = compared(F.col("op"), now, limit)
    for name, crosses in CROSSINGS.items():
        test = F.when(F.col("op") == name, crosses(F.col("before"), now, limit)).otherwise(test)
    met = leaves.join(
        numbers,
        (F.col("symbol") == F.col("_symbol")) & (F.coalesce("field", F.lit("")) == F.col("_field")),
    )
    outcomes = met.groupBy("rule_id", "symbol", "_at").agg(
        F.array_sort(F.collect_list(F.struct("leaf", F.coalesce(test, F.lit(False)).alias("hit")))).alias("_hits")
    )
    trees = rules.select(F.col("id").alias("_id"), "rule", "cooldown_seconds", "last_fired_at")
    judged = outcomes.join(trees, F.col("rule_id") == F.col("_id")).select(
        "rule_id", "symbol", "_at", "cooldown_seconds", "last_fired_at", "rule", F.col("_hits.hit").alias("hits")
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            kept, matched = [], []
            for i, (text, hits) in enumerate(zip(batch["rule"].to_pylist(), batch["hits"].to_pylist())):
                if text not in parsed:
                    parsed[text] = json.loads(text)
                fires, texts = tree_verdict(parsed[text], iter(hits))
                if fires:
                    kept.append(i)
                    matched.append(texts)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:5], pa.array(matched, pa.list_(pa.string()))],
                names=["rule_id", "symbol", "_at", "cooldown_seconds", "last_fired_at", "matched"],
            )

    schema = (
        "rule_id string, symbol string, _at timestamp, cooldown_seconds int, last_fired_at timestamp, "
        "matched array<string>"
    )
    fired = judged.mapInArrow(judge, schema)
    texts = payloads.select(F.col("symbol").alias("_symbol"), F.col(order), "payload")
    return fired.join(texts, (F.col("symbol") == F.col("_symbol")) & (F.col("_at") == F.col(order))).select(
        order,
        "symbol",
        "rule_id",
        "matched",
        F.coalesce("cooldown_seconds", F.lit(0)).alias("cooldown_seconds"),
        "last_fired_at",
        shrink_payload(F.col("payload")).alias("payload"),
    )


def shrink_payload(payload: Column) -> Column:
    """Drop the list fields of each metric that have more than ten entries."""
    parsed = F.from_json(payload, F.lit("map<string,map<string,variant>>"))

    def short(_, value: Column) -> Column:
        return F.coalesce(F.json_array_length(F.to_json(value)), F.lit(0)) <= LONGEST_LIST

    return F.to_json(
        F.transform_values(parsed, lambda _, fields: F.map_filter(fields, short))
    )


#: Cooldowns in a slice of firings.
SLICE_PAUSES = 64
NEVER = -(1 << 62)


def apply_cooldown(fired: DataFrame, *, order: str = "snapshot_ts") -> DataFrame:
    """Keep a firing only when the rule's cooldown has passed since the last one kept.

    The firings of a rule and symbol are cut into slices of ``SLICE_PAUSES`` cooldowns, and
    :func:`strikelens.operators.greedy.choose` puts them together: the state between slices is
    the time from which the rule may fire again. A burst of any length spreads over its slices.
    """
    pause = F.greatest(F.col("cooldown_seconds").cast("bigint") * 1_000_000, F.lit(0))
    at = F.unix_micros(order)
    length = F.greatest(pause, F.lit(60_000_000)) * SLICE_PAUSES
    names = fired.columns
    rows = fired.withColumns({"_at": at, "_pause": pause, "_slice": F.floor(at / length)})

    def ordered(table: pa.Table):
        table = table.sort_by("_at")
        times, waits = table["_at"].to_numpy(), table["_pause"].to_numpy()
        following = np.maximum(np.searchsorted(times, times + waits), np.arange(len(times)) + 1)
        return table, times, waits, following

    def steps(table: pa.Table) -> greedy.Steps:
        _, times, waits, following = ordered(table)
        n = len(times)
        last = np.where(following < n, following, np.arange(n))
        while True:  # doubling: the last firing kept if this one is
            further = last[last]
            if (further == last).all():
                break
            last = further
        return np.append(times, np.iinfo(np.int64).max), np.append(times[last] + waits[last], -1)

    def chosen(table: pa.Table, free_from: int) -> pa.Table:
        table, times, _, following = ordered(table)
        start = int(np.searchsorted(times, free_from))
        kept, _ = greedy.walked(following, np.ones(len(times), bool), start, len(times))
        return table.take(pa.array(kept, pa.int64())).select(names)

    def begin(table: pa.Table) -> int:
        latest = max((x for x in table["last_fired_at"].cast(pa.int64()).to_pylist() if x is not None), default=None)
        return NEVER if latest is None else latest + table["_pause"][0].as_py()

    return greedy.choose(
        rows, ("rule_id", "symbol"), "_slice", steps, chosen, fired.schema, adjacent=False, initial=begin
    )


def payload_at(
    metrics: DataFrame, *, as_of, window_seconds: int = PAYLOAD_SECONDS
) -> DataFrame:
    """One payload per symbol from the newest row of each metric type before ``as_of``."""
    now = instant(as_of)
    oldest = now - F.make_dt_interval(secs=F.lit(window_seconds))
    recent = metrics.where((F.col("ts") >= oldest) & (F.col("ts") <= now))
    newest = newest_metric(recent, ["symbol", "metric_type"])
    listed = newest.groupBy("symbol").agg(_entries().alias("_rows"))
    return listed.select("symbol", now.alias("snapshot_ts"), _nested("_rows").alias("payload"))


def payload_history(
    metrics: DataFrame, *, window_seconds: int = PAYLOAD_SECONDS
) -> DataFrame:
    """One payload per symbol and metric timestamp, each type at most ``window_seconds`` old.

    The window over a symbol holds one row per snapshot, and its frame only the recent ones.
    """
    newest = newest_metric(metrics, ["symbol", "ts", "metric_type"])
    moments = newest.groupBy("symbol", "ts").agg(_entries().alias("_rows"))
    recent = Window.partitionBy("symbol").orderBy(F.unix_micros("ts")).rangeBetween(
        -window_seconds * 1_000_000, 0
    )
    seen = moments.withColumn("_seen", F.flatten(F.collect_list("_rows").over(recent)))
    kinds = F.array_distinct(F.transform("_seen", lambda r: r["metric_type"]))
    latest = F.transform(
        kinds,
        lambda kind: F.array_max(F.filter("_seen", lambda r: r["metric_type"] == kind)),
    )
    return seen.withColumn("_rows", latest).select(
        "symbol", F.col("ts").alias("snapshot_ts"), _nested("_rows").alias("payload")
    )


def _entries() -> Column:
    """The rows of a group as (type, time, JSON of value, time and the extra fields)."""
    fields = F.lit("map<string,variant>")
    base = F.from_json(
        F.to_json(
            F.struct("value", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("ts")),
            {"ignoreNullFields": "false"},
        ),
        fields,
    )
    extra = F.coalesce(F.from_json("extra", fields), F.from_json(F.lit("{}"), fields))
    entry = F.map_concat(
        F.map_filter(base, lambda name, _: ~F.map_contains_key(extra, name)), extra
    )
    return F.collect_list(F.struct("metric_type", "ts", F.to_json(entry).alias("entry")))


def _nested(rows: str) -> Column:
    pairs = F.transform(rows, lambda r: F.struct(r["metric_type"], F.parse_json(r["entry"])))
    return F.to_json(F.map_from_entries(pairs))


def newest_metric(metrics: DataFrame, group: Sequence[str]) -> DataFrame:
    """Newest row per group; of the rows of one time, the lowest strike and expiry."""
    row = F.struct("value", "extra", *(["ts"] if "ts" not in group else []))
    first = F.struct(-F.unix_micros("ts"), F.col("strike"), F.col("expiration"))
    return metrics.groupBy(*group).agg(F.min_by(row, first).alias("_row")).select(*group, "_row.*")
