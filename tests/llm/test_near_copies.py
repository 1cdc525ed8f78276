import random
from itertools import combinations

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from strikelens.llm import near_copies


def plain(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def _groups(texts):
    """Smallest id of each component of all pairs, compared one by one."""
    sets = {i: plain(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {find(i) for i in texts}


def test_fingerprints_find_candidates_too(spark, frame):
    """Without any table row in common, texts of near or equal fingerprints are still compared, and judged by their sets."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(3000)]
    lines = [words, [*words[:1500], "changed", *words[1501:]], [*words, words[-1]], words[::-1]]
    df = frame([(i, " ".join(x)) for i, x in enumerate(lines, 1)] + [(9, None), (10, " ")])
    marked = near_copies.signatures(df).withColumn("keys", F.array().cast("array<long>")).withColumnRenamed("doc_id", "least").cache()
    linked = {frozenset(r) for r in near_copies.links(df, marked, marked.select("fp", "least", "mark")).collect()}
    ids = {r.fp: r.least for r in marked.collect()}
    nearby = {frozenset((1, 2)), frozenset((1, 3)), frozenset((2, 3))}
    assert linked and {frozenset(ids[fp] for fp in pair) for pair in linked} <= nearby


def test_every_copy_at_four_fifths_goes_and_no_other(spark, frame):
    """Around a few texts, copies on both sides of the limit; many of them meet in one table row."""
    rng = random.Random(11)
    texts = {}
    for _ in range(6):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(25):
            copy = list(words)
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy)
    for i in range(4):
        texts[1000 + i] = ["", " ", "too few words", "Too  few words"][i]
    want = _groups(texts)
    assert 10 < len(want) < len(texts) - 50
    kept = corpus_pipeline.near_duplicates(spark, frame(list(texts.items())), "")
    assert {r.doc_id for r in kept.collect()} == want


def test_parities_never_tell_similar_sets_apart():
    """The bits that differ are at most the shingles that differ, and with few shingles mostly as many."""
    rng = np.random.default_rng(8)
    close = 0
    for n in (0, 1, 30, 500, 20_000):
        for share in (0.0, 0.05, 0.3):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            new = rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)
            b = np.unique(np.concatenate([a[len(new) :], new]))
            bits = sum(int(x ^ y).bit_count() for x, y in zip(*(near_copies.parities(s).view(np.uint64).tolist() for s in (a, b)), strict=True))
            assert bits <= len(np.setxor1d(a, b))
            close += n <= 500 and bits >= 0.8 * len(np.setxor1d(a, b))
    assert close >= 11


def test_first_of_each(odd, empty):
    kept = near_copies.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (False, 0), (True, 1), (True, 2), (True, 6), (True, 7),
    ]
    assert near_copies.first_of_each(empty).count() == 0
