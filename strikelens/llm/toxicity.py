"""Toxicity by a classifier chain: linear models of categories, each fed with the earlier ones.

A document is the set of its word forms and their beginnings. Which of these count is chosen by
Spark over the training rows; the models are fitted on the driver over a bounded sample and see
at most ``max_features`` of them. Later links learn from out-of-fold probabilities of earlier
links, so they meet the same kind of error in training and in use.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strikelens.llm.common import map_batches, written

#: Lengths of the beginnings that stand for a family of word forms.
BEGINNINGS = (4, 5, 6)
LONGEST_WORD = 24
EDGES = ".,;:!?\"'()[]{}<>*#%&$|=-_"
FOLDS = 5


def word_features(text: str | None) -> set[str]:
    """Distinct lower-case word forms without punctuation at their edges, and their beginnings."""
    found = set()
    for word in set((text or "").lower().split()):
        word = word.strip(EDGES)
        if 2 < len(word) <= LONGEST_WORD:
            found.add(word)
            found.update(word[:n] + "~" for n in BEGINNINGS if len(word) > n)
    return found


@dataclass
class Chain:
    """Per category: weights over the features and over the earlier categories, and a bias."""

    categories: list[str]
    features: list[str]
    weights: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)
    biases: list[float] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.place = {f: i for i, f in enumerate(self.features)}

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """One row per document, one column per category in chain order."""
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        flat = np.array([i for r in rows for i in r], dtype=np.int64)
        owner = np.repeat(np.arange(len(rows)), sizes)
        out = np.zeros((len(rows), len(self.categories)))
        for k in range(len(self.categories)):
            score = np.bincount(owner, weights=self.weights[k][flat], minlength=len(rows)) + self.biases[k]
            out[:, k] = sigmoid(score + out[:, :k] @ self.links[k])
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _fit_link(owner, flat, earlier, target, n_features, rounds=60, l2=2e-5, memory=8):
    """Logistic regression by limited-memory quasi-Newton steps, classes weighted to equal mass."""
    n, positive = len(target), max(target.sum(), 1)
    weight = np.where(target == 1, 0.5 / positive, 0.5 / max(n - target.sum(), 1))
    sign = np.where(target == 1, 1.0, -1.0)

    def loss(theta):
        w, link, bias = theta[:n_features], theta[n_features:-1], theta[-1]
        margin = sign * (np.bincount(owner, weights=w[flat], minlength=n) + earlier @ link + bias)
        value = weight @ np.logaddexp(0, -margin) + l2 / 2 * (theta[:-1] @ theta[:-1])
        gap = -weight * sign * sigmoid(-margin)
        slope = np.concatenate(
            [np.bincount(flat, weights=gap[owner], minlength=n_features), earlier.T @ gap, [gap.sum()]]
        )
        slope[:-1] += l2 * theta[:-1]
        return value, slope

    theta = np.zeros(n_features + earlier.shape[1] + 1)
    value, slope = loss(theta)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, parts = -slope, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            parts.append(a)
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(parts), strict=True):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        rate, down = 1.0 if steps else 1.0 / max(np.abs(slope).sum(), 1e-12), slope @ direction
        while True:
            then = theta + rate * direction
            value_then, slope_then = loss(then)
            if value_then <= value + 1e-4 * rate * down or rate < 1e-10:
                break
            rate /= 2
        s, y = then - theta, slope_then - slope
        theta, value, slope = then, value_then, slope_then
        if s @ y <= 1e-14 or np.abs(slope).max() < 1e-7:
            break
        steps = [*steps[-memory + 1 :], (s, y)]
    return theta[:n_features], theta[n_features:-1], float(theta[-1])


def fit_chain(rows, targets: np.ndarray, folds: np.ndarray, categories, features) -> Chain:
    """Fit every link; ``targets`` has a column per category, ``folds`` the fold of each row."""
    chain = Chain(list(categories), list(features))
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.array([i for r in rows for i in r], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    held_out = np.zeros(targets.shape)
    for k in range(len(categories)):
        target = targets[:, k].astype(float)
        for fold in range(FOLDS) if k + 1 < len(categories) else ():
            train = folds != fold
            place = np.cumsum(train) - 1
            kept = train[owner]
            w, link, bias = _fit_link(
                place[owner[kept]], flat[kept], held_out[train, :k], target[train], len(features)
            )
            score = np.bincount(owner, weights=w[flat], minlength=len(rows)) + held_out[:, :k] @ link + bias
            held_out[~train, k] = sigmoid(score[~train])
        w, link, bias = _fit_link(owner, flat, held_out[:, :k], target, len(features))
        chain.weights.append(w)
        chain.links.append(link)
        chain.biases.append(bias)
    return chain


def _chosen(labels: DataFrame, sample_docs: int) -> DataFrame:
    """At most ``sample_docs`` labels, those of the smallest hashes: ``_label_id``, ``order_hash``
    and the label columns."""
    label_columns = [c for c in labels.columns if c not in ("doc_id", "text")]
    return (
        labels.where("doc_id is not null")
        .dropDuplicates(["doc_id"])
        .withColumn("order_hash", F.xxhash64("doc_id"))
        .orderBy("order_hash", "doc_id")
        .limit(sample_docs)
        .select(F.col("doc_id").alias("_label_id"), "order_hash", *label_columns)
    )


def word_groups(
    docs: DataFrame,
    labels: DataFrame,
    groups: int = 4,
    sample_docs: int = 12_000,
    min_docs: int = 8,
    min_lift: float = 3.0,
    max_words: int = 400,
) -> list[list[str]]:
    """``groups`` lists of words that mark toxic documents, found in the labels alone.

    A word is a marker if its share of toxic rows is far over that of its language; at most
    ``max_words`` with the largest gains count. Markers that meet in toxic rows more often than
    their numbers let expect are one group. The groups go by the toxic rows of their words, most
    first; the last list has all further groups. Lists may be empty.
    """
    chosen = _chosen(labels, sample_docs).select("_label_id", F.coalesce(F.col("toxic").cast("int"), F.lit(0)).alias("_bad"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_row_id"), "text", F.col("lang").cast("string").alias("_lang"))
    sample = texts.join(F.broadcast(chosen), F.expr("_row_id = _label_id")).select("_row_id", "_lang", "_bad", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(w for w in word_features(t) if w[-1] != "~") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_row_id", "_lang", "_bad")), pa.array(found, pa.list_(pa.string()))],
                names=["_row_id", "_lang", "_bad", "words"],
            )

    rows = written(map_batches(sample, extract, "_row_id long, _lang string, _bad int, words array<string>"), "toxicity-words")
    rows = rows.dropDuplicates(["_row_id"])
    shares = rows.groupBy(F.col("_lang").alias("of")).agg(F.avg("_bad").alias("share"))
    counts = rows.select("_lang", "_bad", F.explode("words").alias("word")).groupBy("_lang", "word")
    counts = counts.agg(F.count("*").alias("n"), F.sum("_bad").alias("bad")).join(F.broadcast(shares), F.expr("_lang <=> of"))
    words = counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.expr("n * share")).alias("expected"))
    words = words.withColumn("gain", F.expr("(bad - expected) / sqrt(expected + 1)"))
    words = words.where((F.col("n") >= min_docs) & (F.col("bad") >= min_lift * F.col("expected")) & (F.col("gain") > 5))
    markers = {r.word: r.bad for r in words.orderBy(F.desc("gain"), "word").limit(max_words).collect()}
    total = rows.where("_bad = 1").count()
    kept = F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in markers], "word string"))
    held = rows.where("_bad = 1").select("_row_id", F.explode("words").alias("word")).join(kept, "word")
    held = held.groupBy("_row_id").agg(F.sort_array(F.collect_list("word")).alias("words"))
    pair = "flatten(transform(words, (x, i) -> transform(slice(words, i + 2, size(words)), y -> struct(x as a, y as b))))"
    met = held.select(F.explode(F.expr(pair)).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect()
    root = {w: w for w in markers}

    def find(w: str) -> str:
        while root[w] != w:
            w = root[w]
        return w

    for r in met:
        if r.n >= 2 and r.n * total > markers[r.a] * markers[r.b]:
            a, b = sorted((find(r.a), find(r.b)))
            root[b] = a
    found: dict[str, list[str]] = {}
    for w in sorted(markers):
        found.setdefault(find(w), []).append(w)
    order = sorted(found.values(), key=lambda g: (-sum(markers[w] for w in g), g))
    return [order[k] if k < len(order) else [] for k in range(groups - 1)] + [sorted(w for g in order[groups - 1 :] for w in g)]


def holds_any(words: Sequence[str]) -> Column:
    """Whether ``text`` has one of the words, as :func:`word_features` reads them."""
    if not words:
        return F.lit(False)
    edges = "[" + "".join("\\" + c for c in EDGES) + "]*"
    own = F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.regexp_replace(w, f"^{edges}|{edges}$", ""))
    return F.arrays_overlap(own, F.array(*[F.lit(w) for w in words]))


def fit_on(
    docs: DataFrame,
    labels: DataFrame,
    categories: Sequence[tuple[str, Column]],
    sample_docs: int = 12_000,
    max_features: int = 3000,
    min_docs: int = 8,
    min_lift: float = 3.0,
    chosen_by: Sequence[str] | None = None,
) -> Chain:
    """Fit on at most ``sample_docs`` labelled documents.

    ``categories`` names the chain in order; each Column is computed over the label columns and
    ``text`` and says whether a row belongs to it (null: no). The sample is the smallest hashes
    of ``doc_id``. Labels without a document and rows without ``doc_id`` take no part. With no
    labelled document at all the chain says 0.5 of everything, which rejects nothing. Features are
    chosen by the categories ``chosen_by`` (all): a category of one language would choose its words.
    """
    chosen = _chosen(labels, sample_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("_row_id"), "text")
    sample = texts.join(F.broadcast(chosen), F.expr("_row_id = _label_id")).select(
        "_row_id",
        "text",
        F.pmod("order_hash", F.lit(FOLDS)).cast("int").alias("fold"),
        F.array(*[F.coalesce(rule.cast("int"), F.lit(0)) for _, rule in categories]).alias("targets"),
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(word_features(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_row_id", "fold", "targets")), pa.array(found, pa.list_(pa.string()))],
                names=["_row_id", "fold", "targets", "features"],
            )

    rows = written(
        map_batches(sample, extract, "_row_id long, fold int, targets array<int>, features array<string>"),
        "toxicity-sample",
    ).dropDuplicates(["_row_id"])
    names = [name for name, _ in categories]
    sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(F.col("targets")[k]), F.lit(0)) for k in range(len(names))]).first()
    total, positives = sums[0], sums[1:]
    counts = rows.select("targets", F.explode("features").alias("feature")).groupBy("feature").agg(
        F.count("*").alias("n"), *[F.sum(F.col("targets")[k]).alias(f"n{k}") for k in range(len(names))]
    )
    # How far a category is over-represented among the rows with a feature: in deviations, where
    # its share there is several times its share overall; anything less is the topic or language.
    gains = []
    for k, p in enumerate(positives):
        if chosen_by is not None and names[k] not in chosen_by:
            continue
        expected = F.col("n") * max(p / max(total, 1), 1e-9)
        gains.append(F.when(F.col(f"n{k}") >= min_lift * expected, (F.col(f"n{k}") - expected) / F.sqrt(expected + 1)).otherwise(0.0))
    found = (
        counts.where(F.col("n") >= min_docs)
        .withColumn("gain", F.greatest(*gains, F.lit(0.0), F.lit(0.0)))
        .where("gain > 5")
        .orderBy(F.desc("gain"), "feature")
        .limit(max_features)
        .select("feature")
        .collect()
    )
    features = sorted(r.feature for r in found)
    place = {f: i for i, f in enumerate(features)}
    kept = F.broadcast(docs.sparkSession.createDataFrame([(f,) for f in features], "feature string"))
    sparse = (
        rows.select("_row_id", F.explode("features").alias("feature"))
        .join(kept, "feature")
        .groupBy("_row_id")
        .agg(F.sort_array(F.collect_list("feature")).alias("found"))
    )
    cases = rows.select("_row_id", "fold", "targets").join(sparse, "_row_id", "left").orderBy("_row_id").collect()
    if not cases:
        zero = np.zeros(len(features))
        return Chain(names, features, [zero] * len(names), [np.zeros(k) for k in range(len(names))], [0.0] * len(names))
    return fit_chain(
        [[place[f] for f in r.found or ()] for r in cases],
        np.array([list(r.targets) for r in cases]),
        np.array([r.fold for r in cases]),
        names,
        features,
    )


def _verdicts(texts: list[str | None], chain: Chain, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities, and whether the last one is over the threshold in a text with a known word."""
    rows = [[chain.place[f] for f in word_features(t) if f in chain.place] for t in texts]
    found = chain.probabilities(rows)
    return found, (found[:, -1] > threshold) & np.array([bool(r) for r in rows], dtype=bool)


def score(df: DataFrame, chain: Chain, threshold: float = 0.75, prefix: str = "p_") -> DataFrame:
    """``df`` with a probability per category and ``toxic``: whether the last one is over ``threshold``.

    Whole texts count, whatever their length. Null and empty texts hold no word and get the
    probabilities of the bare biases; they are never rejected. Repeated rows get repeated
    results. Columns of ``df`` that carry a name added here are replaced.
    """
    added = [f"{prefix}{c}" for c in chain.categories]
    df = df.drop(*added, "toxic")
    columns, at = df.columns, df.columns.index("text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, verdict = _verdicts(batch.column(at).to_pylist(), chain, threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(found[:, k]) for k in range(len(added))), pa.array(verdict)],
                names=[*columns, *added, "toxic"],
            )

    schema = StructType(list(df.schema.fields))
    for name in added:
        schema = schema.add(name, "double")
    return map_batches(df, job, schema.add("toxic", "boolean"))


def without_toxic(df: DataFrame, chain: Chain, threshold: float = 0.75) -> DataFrame:
    """The rows of ``df`` that :func:`score` doesn't call toxic; same columns, whatever their names."""
    at = df.columns.index("text")

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, verdict = _verdicts(batch.column(at).to_pylist(), chain, threshold)
            yield batch.filter(pa.array(~verdict))

    return map_batches(df, job, df.schema)
