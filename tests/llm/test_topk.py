import numpy as np

from strikelens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, dims string"


def plain(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        usable[i] = min(usable.get(i, v), v)
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in usable.items()}
    out = set()
    for q in (i for i in ints if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x") for i, v in rows], SCHEMA)


def _found(df, *args):
    return {tuple(r) for r in topk.top_k(df, *args).collect()}


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE_QUERIES", 7)
    monkeypatch.setattr(topk, "TILE_CANDIDATES", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=12).round(1).tolist()) for i in range(300)]  # rounding makes ties
    rows += [(1000 + i, [-1.0] * 12) for i in range(30)]
    assert _found(_frame(spark, rows), 10, 10) == plain(rows, 10, 10)
    few = rows[:5]
    assert _found(_frame(spark, few), 10, 2) == plain(few, 10, 2)


def test_negative_scores_only(spark):
    rows = [(i, [1.0 + i / 50, 0.5] if i % 2 else [-1.0 - i / 40, -0.5]) for i in range(40)]
    assert _found(_frame(spark, rows), 30, 4) == plain(rows, 30, 4)


def test_large_components_stay_exact(spark):
    rows = [(i, [3.0e5 + i, -2.0e5, 1.0]) for i in range(20)]
    assert _found(_frame(spark, rows), 3, 5) == plain(rows, 3, 5)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (None, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [1.0, 1.0]), (6, [0.5, 1.0]), (7, [1.0, 2.0, 3.0]), (100, [2.0, 2.0])]
    assert _found(_frame(spark, rows), 10, 100) == plain(rows, 10, 100)
    assert topk.top_k(_frame(spark, [])).count() == 0
