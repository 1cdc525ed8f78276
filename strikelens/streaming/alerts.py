"""Alert evaluation on streams: of payloads with keyed state, of metric rows batch by batch."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strikelens.operators import alerts
from strikelens.session import ship_package
from strikelens.sources.sinks import read_metrics, stored_or_none

FIRED = "rule_id string, symbol string, snapshot_ts timestamp, matched array<string>, payload string, kept boolean"


def _rule_memory() -> StatefulProcessor:
    """What a rule remembers of a symbol: the numbers it last saw, and when it last fired.

    The class is made here so that it travels by value: Spark asks a Python process beside the
    driver for its states, and that process does not have this package.
    """

    class RuleMemory(StatefulProcessor):

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.seen = handle.getValueState("seen", "at bigint, numbers array<double>")
            self.fired = handle.getValueState("fired", "at bigint")
            self.trees: dict[str, tuple[dict, list[dict]]] = {}

        def _tree(self, text: str) -> tuple[dict, list[dict]]:
            from strikelens.operators import alerts

            if text not in self.trees:
                tree = json.loads(text)
                self.trees[text] = tree, alerts.tree_leaves(tree)
            return self.trees[text]

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            from strikelens.operators import alerts

            at, before = self.seen.get() if self.seen.exists() else (None, None)
            last = self.fired.get()[0] if self.fired.exists() else None
            known, quiet = at, last
            out = []
            held = pd.concat(list(rows)).sort_values("at", kind="stable")
            for row in held.itertuples(index=False):
                tree, leaves = self._tree(row.rule)
                numbers = [None if x is None or math.isnan(x) else float(x) for x in row.numbers]
                is_new = at is None or row.at > at
                hits = []
                for k, leaf in enumerate(leaves):
                    crosses = alerts.CROSSINGS.get(leaf["op"])
                    if crosses is None:
                        hits.append(bool(row.hits[k]))
                        continue
                    was = before[k] if is_new and before is not None else None
                    limit = alerts.constant(leaf.get("value"))
                    hits.append(None not in (was, numbers[k], limit) and bool(crosses(was, numbers[k], limit)))
                if is_new:
                    at, before = row.at, numbers
                fires, matched = alerts.tree_verdict(tree, iter(hits))
                if fires:
                    since = max((x for x in (last, row.last_fired) if x is not None and not pd.isna(x)), default=None)
                    kept = since is None or row.at >= since + row.pause
                    last = int(row.at) if kept else last
                    out.append((key[1], key[0], pd.Timestamp(row.at, unit="us"), matched, row.payload, kept))
            if at != known:
                self.seen.update((int(at), before))
            if last != quiet:
                self.fired.update((last,))
            yield pd.DataFrame(out, columns=["rule_id", "symbol", "snapshot_ts", "matched", "payload", "kept"])

        def close(self) -> None:
            pass

    return RuleMemory()


def alert_stream(payloads: DataFrame, rules: DataFrame | Sequence[dict]) -> DataFrame:
    """Every firing on a stream of payloads (``symbol``, ``snapshot_ts``, ``payload``); ``kept`` tells
    whether the rule's cooldown lets it through.

    State is kept per symbol and rule, however long nothing comes: the numbers of the newest
    payload, for crossings, and the last kept firing. Numbers are taken out of the payload and
    tested in the JVM; its text only goes along where some test may hold. A payload that is not
    newer than what a rule has seen is judged without its crossings and remembered nowhere.
    Needs a state store with several states (:data:`strikelens.streaming.runner.ROCKSDB`).
    """
    spark = payloads.sparkSession
    ship_package(spark)
    if not isinstance(rules, DataFrame):
        rules = alerts.rule_table(spark, rules)
    leaves = alerts.leaf_rows(rules).groupBy("rule_id").agg(
        F.array_sort(F.collect_list(F.struct("leaf", "field", "op", "limit"))).alias("leaves")
    )
    known = rules.join(leaves, F.col("id") == F.col("rule_id")).select(
        F.col("symbol").alias("of"), "rule_id", "rule", "leaves",
        (F.coalesce("cooldown_seconds", F.lit(0)).cast("bigint") * 1_000_000).alias("pause"),
        F.unix_micros("last_fired_at").alias("last_fired"),
    )
    met = payloads.join(known, F.col("symbol") == F.col("of")).withColumn(
        "numbers", F.transform("leaves", lambda leaf: alerts.payload_number(F.col("payload"), F.coalesce(leaf["field"], F.lit(""))))
    )
    pairs = F.zip_with("leaves", "numbers", lambda leaf, now: F.struct(leaf["op"].alias("op"), leaf["limit"].alias("limit"), now.alias("now")))
    hits = F.transform(pairs, lambda p: F.coalesce(alerts.compared(p["op"], p["now"], p["limit"]), F.lit(False)))
    may = F.exists("hits", lambda hit: hit) | F.exists("leaves", lambda leaf: leaf["op"].isin(*alerts.CROSSINGS))
    rows = met.withColumn("hits", hits).select(
        "symbol", "rule_id", F.unix_micros("snapshot_ts").alias("at"), "rule", "numbers", "hits", "pause", "last_fired",
        F.when(may, alerts.shrink_payload(F.col("payload"))).alias("payload"),
    )
    return rows.groupBy("symbol", "rule_id").transformWithStateInPandas(
        _rule_memory(), outputStructType=FIRED, outputMode="Append", timeMode="None"
    )


def known_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What the batch before left; its slot is never the one this batch writes."""
    stored = stored_or_none(spark, path) if batch_id > 0 else None
    if stored is None:
        return None
    return stored.where((F.col("slot") == (batch_id - 1) % 2) & (F.col("batch") < batch_id)).drop(
        "slot", "batch"
    )


def remember(df: DataFrame, path: str, batch_id: int) -> None:
    (
        df.withColumns({"batch": F.lit(batch_id), "slot": F.lit(batch_id % 2)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("slot")
        .parquet(path)
    )


def alert_sink(
    metrics_path: str, events_path: str, rules: DataFrame | Sequence[dict]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that evaluates the rules at the batch's metric times.

    Two small tables beside the events carry what a batch needs of the past, however long ago
    it was: the last payload of each symbol, so that a crossing over a weekend is seen, and the
    last firing of each rule. Batches take turns in two slots of them, so a batch that runs
    again still finds what the one before it left, and replaces its own events. Of the stored
    metrics only the days that a payload of the batch can reach are read.
    """
    payload_path, fired_path = f"{events_path}-payloads", f"{events_path}-last-fired"

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = known_before(spark, payload_path, batch_id)
        last_fired = known_before(spark, fired_path, batch_id)
        moments = batch.select("symbol", F.col("ts").alias("snapshot_ts")).distinct()
        first, last = moments.agg(F.min("snapshot_ts"), F.max("snapshot_ts")).first()
        if first is None:  # nothing new: hand on what is known
            for df, path in ((before, payload_path), (last_fired, fired_path)):
                if df is not None:
                    remember(df, path, batch_id)
            return
        since = F.lit(first) - F.make_dt_interval(secs=F.lit(alerts.PAYLOAD_SECONDS))
        stored = read_metrics(spark, metrics_path, first=since, last=F.lit(last)).where(
            F.col("ts").between(since, F.lit(last))
        )
        fresh = alerts.payload_history(stored).join(moments, ["symbol", "snapshot_ts"], "left_semi")
        payloads = (fresh if before is None else fresh.unionByName(before)).persist()
        fired = alerts.evaluate_rules(payloads, rules).join(
            moments, ["symbol", "snapshot_ts"], "left_semi"
        )
        if last_fired is not None:
            fired = fired.join(last_fired, ["rule_id", "symbol"], "left").withColumn(
                "last_fired_at", F.greatest("last_fired_at", "last")
            ).drop("last")
        kept = alerts.apply_cooldown(fired).persist()
        (
            kept.select(
                "rule_id", F.col("snapshot_ts").alias("ts"), "symbol", "matched", "payload",
                F.lit(batch_id).alias("batch"),
            )
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(events_path)
        )
        newest = payloads.groupBy("symbol").agg(
            F.max_by("payload", F.struct("snapshot_ts", "payload")).alias("payload"),
            F.max("snapshot_ts").alias("snapshot_ts"),
        )
        remember(newest, payload_path, batch_id)
        firings = kept.select("rule_id", "symbol", F.col("snapshot_ts").alias("last"))
        if last_fired is not None:
            firings = firings.unionByName(last_fired)
        remember(firings.groupBy("rule_id", "symbol").agg(F.max("last").alias("last")), fired_path, batch_id)
        kept.unpersist()
        payloads.unpersist()

    return evaluate
