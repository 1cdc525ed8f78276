"""Clusters against a plain version, and odd inputs."""

import hashlib
import math
import random

import numpy as np
import pytest
from strikelens.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance string, v string, named string"


def _plain(rows, k, dims, scale, rounds, seed):
    """(vec_id, cluster, distance, own inertia, whole inertia, hash) of each kept row, by Python integers."""
    good = lambda e: e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)
    kept = [(i, [math.floor(scale * x) for x in e]) for i, e in rows if good(e)]
    named = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    heart = [v for _, v in sorted(kept, key=named)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(heart))  # noqa: E731, B905
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for c in set(own):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            heart[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    last = [near(v) for _, v in kept]
    inertia = [sum(d for d, o in last if o == c) for c in range(len(heart))]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in heart]
    return sorted(repr((i, c, d, inertia[c], sum(inertia), prints[c])) for (i, _), (d, c) in zip(kept, last, strict=True))


def _found(df):
    return sorted(repr(tuple(r)) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


@pytest.mark.parametrize("width", [1, 2, 3, 5])
def test_equals_plain_version(spark, width, monkeypatch):
    monkeypatch.setattr(centroids, "CONTAINER", 50)
    rng = random.Random(width)
    rows = [(i, [rng.choice((rng.gauss(0, 1), 0.25)) for _ in range(5)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a third of all rows are copies
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(7)
    found = centroids.cluster(df, k=9, dims=5, scale=16, rounds=4, seed=2, width=width)
    assert _found(found) == _plain(rows, 9, 5, 16, 4, 2)


def test_odd_rows(spark):
    rows = [
        (1, [0.1, -0.1]), (1, [0.1, -0.1]), (2, [0.1, -0.2]), (None, [5.0, 5.0]), (None, [5.0, 5.0]), (3, None), (4, []), (5, [0.1]),
        (6, [0.1, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (-3, [1e3, -1e3]),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    for k in (1, 2, 40):
        found = centroids.cluster(df, k=k, dims=2, rounds=3)
        assert _found(found) == _plain(rows, k, 2, 256, 3, 2)


def test_empty_clusters_stay(spark):
    # Two equal first centroids: all vectors go to the smaller number, and the other one keeps its place.
    rows = [(i, [1.0, 2.0]) for i in range(6)] + [(99, [8.0, 8.0])]
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    assert _found(centroids.cluster(df, k=4, dims=2, rounds=3)) == _plain(rows, 4, 2, 256, 3, 2)


def test_empty_table_and_large_components(spark):
    assert centroids.cluster(spark.createDataFrame([], SCHEMA), dims=2).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, "", "", "", "")], SCHEMA), dims=2).collect() == []
    far = 500_000.0  # just inside what 64 bits take
    rows = [(1, [far, -far]), (2, [-far, far])]
    df = spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)
    assert _found(centroids.cluster(df, k=1, dims=2, rounds=0)) == _plain(rows, 1, 2, 256, 0, 2)
    with pytest.raises(Exception, match="no exact distance"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0], "", "", "", "")], SCHEMA), dims=2).collect()


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 40, (200, 7))
    _, _, widths, codes, entries = centroids._container(np.arange(200), np.ones(200, bool), vectors, 3)
    back = [
        np.frombuffer(e, np.int32).reshape(-1, w)[np.frombuffer(c, np.uint16)] for w, c, e in zip(widths, codes, entries, strict=True)
    ]
    assert widths == [3, 3, 1]
    assert (np.concatenate(back, axis=1) == vectors).all()
