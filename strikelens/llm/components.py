"""Connected components by alternating large-star and small-star rounds, each stored and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikelens.llm.common import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest of them and itself.

    The large star moves larger neighbours, the small star the smaller ones and the node.
    Minima are combined before the shuffle, so a node with many neighbours costs one row a task.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.where("v < u" if small else "true")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least.hint("merge"), "u")  # both sides grow with the links
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node in ``links`` (columns ``u`` and ``v``); the root is the smallest
    node reachable. Links may repeat, have either order, or join a node with itself."""
    nodes = links.select(F.col("u").alias("node")).union(links.select(F.col("v").alias("node"))).distinct()
    edges = written(
        links.where("u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        edges = written(_star(_star(edges, small=False), small=True), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).hint("merge"), "node", "left").select(
        "node", F.coalesce("root", "node").alias("root")
    )
