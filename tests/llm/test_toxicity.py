import numpy as np
from pyspark.sql import functions as F

from strikelens.llm import queries, toxicity

def rules():
    return (("insult", F.col("insult") == 1), ("toxic", F.col("toxic") == 1))


def _corpus(frame, spark, n=600, seed=8):
    rng = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(rng.choice(plain, 40))
        insult, threat = rng.random() < 0.2, rng.random() < 0.15
        if insult:
            words += ["nitwit", "Dunce!"]
        if threat:
            words += [f"smite{rng.integers(50)}ing"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(insult), int(insult or threat), "x"))
    return frame(rows), spark.createDataFrame(labels, "doc_id long, insult int, toxic int, text string")


def test_held_out_accuracy(spark, frame):
    docs, labels = _corpus(frame, spark)
    chain = toxicity.fit_on(docs, labels, rules())
    later, truth = _corpus(frame, spark, seed=9)
    found = {r.doc_id: r.toxic for r in toxicity.score(later, chain).collect()}
    want = {r.doc_id: bool(r.toxic) for r in truth.collect()}
    assert sum(found[i] == want[i] for i in want) >= 0.98 * len(want)
    kept = toxicity.without_toxic(later, chain)
    assert kept.columns == later.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, bad in found.items() if not bad}


def test_the_chain_feeds_earlier_probabilities(spark, frame):
    """A last link without words of its own leans on the first one."""
    docs, labels = _corpus(frame, spark)
    chain = toxicity.fit_on(docs, labels, rules())
    rows = [[chain.place["nitwit"]], []]
    before = chain.probabilities(rows)
    chain.links[1] = np.zeros(1)
    assert before[0, 1] != chain.probabilities(rows)[0, 1]
    assert before.shape == (2, 2)


def test_links_equal_plain_gradient_descent():
    rng = np.random.default_rng(1)
    n, m = 200, 5
    x = (rng.random((n, m)) < 0.4).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ [2, -1, 0, 1, 0] - 1)))).astype(float)
    rows = [np.flatnonzero(r).tolist() for r in x]
    flat = np.array([i for r in rows for i in r])
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    w, _, b = toxicity._fit_link(owner, flat, np.zeros((n, 0)), y, m, rounds=200, l2=1e-3)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    theta = np.zeros(m + 1)
    for _ in range(60_000):
        gap = weight * (1 / (1 + np.exp(-(x @ theta[:m] + theta[m]))) - y)
        theta -= 1.0 * np.append(x.T @ gap + 1e-3 * theta[:m], gap.sum())
    assert np.allclose(np.append(w, b), theta, atol=1e-3)


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (1, 0, 0), (None, 1, 1), (2, 1, 1), (99, 1, None)], "doc_id long, insult int, toxic int")
    chain = toxicity.fit_on(odd, labels, rules())
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == 10 and not any(r.toxic for r in rows)  # nothing was learnt from two rows
    assert toxicity.score(empty, chain).count() == 0
    nothing = toxicity.fit_on(empty, labels.limit(0), rules())
    assert not any(r.toxic for r in toxicity.score(odd, nothing).collect())
    assert toxicity.without_toxic(odd, nothing).count() == 10


def test_kinds_come_from_the_labels_in_any_language(spark, frame):
    """Words that no list names, in two languages, become kinds that the registered chain learns."""
    rng = np.random.default_rng(12)
    rows, labels = [], []
    lists = {"xx": ["grumio", "blorfo", "snartë", "vexuli"], "yy": ["дрянок", "мерзун", "гнусар", "пакост"]}
    for i in range(800):
        lang = "xx" if i % 2 == 0 else "yy"
        words, bad = [f"{lang}{k}" for k in rng.integers(0, 200, 30)], rng.random() < 0.15
        if bad:
            words += [w.upper() + "!" for w in rng.choice(lists[lang], 2, replace=False)]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = frame(rows, lang=lambda i: "xx" if (i or 0) % 2 == 0 else "yy")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(sorted, filter(None, toxicity.word_groups(docs, given)))) == sorted(map(sorted, lists.values()))
    chain = queries.toxicity_chain(docs, given)
    found = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    kinds = [c for c in chain.categories if c.startswith("kind_")]
    assert all((max(found[i][f"p_{k}"] for k in kinds) > 0.5) == bool(bad) == found[i].toxic for i, _, bad in labels)


def _newton(x, earlier, y, l2=2e-5):
    """The link by Newton's method on dense matrices; the bias is not held back."""
    z = np.hstack([x, earlier, np.ones((len(y), 1))])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    hold = np.append(np.full(z.shape[1] - 1, l2), 0.0)
    loss = lambda t: weight @ np.logaddexp(0, -np.where(y == 1, 1, -1) * (z @ t)) + hold @ t**2 / 2
    theta = np.zeros(z.shape[1])
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -40, 40)))
        slope = z.T @ (weight * (p - y)) + hold * theta
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(hold + 1e-12), slope)
        rate = 1.0
        while rate > 1e-9 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
    return theta


def test_the_whole_chain_equals_a_plain_one(spark, frame):
    """Features, folds, held-out feeding, links and verdicts, recomputed on dense matrices."""
    docs, labels = _corpus(frame, spark, n=400)
    chain = toxicity.fit_on(docs, labels, rules())
    texts = {r.doc_id: toxicity.word_features(r.text) for r in docs.collect()}
    told = {r.doc_id: (r.insult, r.toxic) for r in labels.collect()}
    fold = {r.doc_id: r.f for r in labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    ids = sorted(told)
    y = np.array([told[i] for i in ids], float)
    gains = {}
    for word in set().union(*texts.values()):
        has = np.array([word in texts[i] for i in ids])
        n = has.sum()
        if n >= 8:
            for k in range(2):
                expected = n * y[:, k].mean()
                if y[has, k].sum() >= 3.0 * expected:
                    gains[word] = max(gains.get(word, 0), (y[has, k].sum() - expected) / np.sqrt(expected + 1))
    features = sorted(w for w, g in gains.items() if g > 5)
    assert chain.features == features and len(features) > 3
    matrix = lambda sets: np.array([[f in s for f in features] for s in sets], float)
    x, folds, held, links = matrix([texts[i] for i in ids]), np.array([fold[i] for i in ids]), np.zeros((len(ids), 2)), []
    for k in range(2):
        for f in range(toxicity.FOLDS) if k == 0 else ():
            t = folds != f
            theta = _newton(x[t], held[t, :k], y[t, k])
            held[~t, k] = 1 / (1 + np.exp(-np.hstack([x, held[:, :k], np.ones((len(ids), 1))])[~t] @ theta))
        links.append(_newton(x, held[:, :k], y[:, k]))
    later, _ = _corpus(frame, spark, n=300, seed=10)
    rows = later.collect()
    z, want = matrix([toxicity.word_features(r.text) for r in rows]), np.zeros((len(rows), 2))
    for k in range(2):
        want[:, k] = 1 / (1 + np.exp(-np.hstack([z, want[:, :k], np.ones((len(rows), 1))]) @ links[k]))
    found = {r.doc_id: r for r in toxicity.score(later, chain).collect()}
    got = np.array([[found[r.doc_id].p_insult, found[r.doc_id].p_toxic] for r in rows])
    assert np.abs(got - want).max() < 0.03
    assert [found[r.doc_id].toxic for r in rows] == [bool(p > 0.75 and s.any()) for p, s in zip(want[:, 1], z, strict=True)]
