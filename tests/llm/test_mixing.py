import hashlib
import math
from collections import Counter

import pytest

from strikelens.llm import mixing


def _shares(spark, tokens):
    return spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(tokens)], "source string, tokens long")


def _entropy(tokens, a):
    p = [t / sum(tokens) for t in tokens if t]
    z = sum(x**a for x in p)
    return -sum(x**a / z * math.log(x**a / z) for x in p)


def test_exponent_meets_the_goal(spark):
    tokens = [1000, 400, 100, 20, 3, 0]
    shares = _shares(spark, tokens)
    whole, flat = _entropy(tokens, 1), math.log(5)
    goal = (whole + flat) / 2
    a = mixing.find_exponent(shares, entropy=goal)
    assert _entropy(tokens, a) >= goal > _entropy(tokens, a + 2 / mixing.STEPS)
    assert mixing.find_exponent(shares, entropy=flat + 1) == 0
    assert mixing.find_exponent(shares, entropy=0.0) == 1
    a = mixing.find_exponent(shares, repeat=4.0)
    assert (3 / 1000) ** (a - 1) <= 4.0 < (3 / 1000) ** (a - 2 / mixing.STEPS - 1)
    total, budget = sum(tokens), 3000
    a = mixing.find_exponent(shares, repeat=5.0, budget=budget)

    def most(x):
        p = [t / total for t in tokens if t]
        return budget / total * max(q ** (x - 1) for q in p) / sum(q**x for q in p)

    assert most(a) <= 5.0 < most(a - 2 / mixing.STEPS)
    assert mixing.find_exponent(shares, repeat=0.5, budget=budget) == 1  # nothing serves
    assert mixing.find_exponent(_shares(spark, []), repeat=2.0) == 1


def _h(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def plain(docs, plan, block_tokens, seed=0):
    """Passes of (doc_id, source, tokens) under {source: budget}, one list at a time."""
    out = Counter()
    for source, budget in plan.items():
        own = [(i, t) for i, s, t in docs if s == source]
        total = sum(t for _, t in own)
        whole, rest = divmod(budget, total) if total else (1, 0)
        n_blocks = max(1, math.ceil(total / block_tokens))
        name = "null" if source is None else f"s{source}"
        blocks = {}
        for i, t in own:
            blocks.setdefault(_h(f"{seed}|block", "null" if i is None else i) % n_blocks, []).append((i, t))
        for epoch in range(whole + (rest > 0)):
            place = 0
            for b in sorted(blocks, key=lambda b: (_h(f"{seed}|epoch", name, epoch, b), b)):
                size = sum(t for _, t in blocks[b])
                if epoch < whole or place + size <= rest:
                    out.update((i, source, epoch, b, place) for i, _ in blocks[b])
                elif place < rest:
                    upto = place
                    for i, t in sorted(blocks[b], key=lambda x: _h(f"{seed}|doc", name, epoch, "null" if x[0] is None else x[0])):
                        upto += t
                        if upto <= rest:
                            out[i, source, epoch, b, place] += 1
                place += size
    return out


@pytest.mark.parametrize("block_tokens", [30, 100_000])
def test_passes_equal_lists(spark, block_tokens):
    docs = [(i, ("big", "mid", None)[min(i % 7, 2) if i % 7 < 3 else 0], 3 + i % 11) for i in range(200)]
    tokens = Counter()
    for _, s, t in docs:
        tokens[s] += t
    plan = {"big": tokens["big"], "mid": 2 * tokens["mid"] + 17, None: tokens[None] // 3}
    rows = spark.createDataFrame([(s, tokens[s], 0.1, b) for s, b in plan.items()], "source string, tokens long, weight double, budget long")
    found = mixing.permuted(spark.createDataFrame(docs, "doc_id long, source string, tokens long"), rows, block_tokens)
    assert Counter(map(tuple, found.collect())) == plain(docs, plan, block_tokens)


def test_budgets_are_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = {(r.doc_id, r.source): r.tokens for r in mixing.sizes(docs).collect()}
    spent = Counter()
    copies = Counter()
    for r in mixing.mix(docs, repeat=3.0, block_tokens=2000).collect():
        spent[r.source] += sizes[r.doc_id, r.source]
        copies[r.doc_id] += 1
    total = Counter()
    for (_, s), t in sizes.items():
        total[s] += t
    assert set(copies) == {i for i, _ in sizes}  # every document at least once
    assert all(spent[s] <= 3.0 * t + 1e-6 for s, t in total.items())
    largest = max(total, key=total.get)
    assert spent[largest] == total[largest]


def test_odd_rows(frame, odd, empty):
    assert mixing.mix(empty, repeat=2.0).count() == 0
    strange = frame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")], source=lambda i: None if i in (1, None) else "z")
    found = Counter((r.doc_id, r.source, r.epoch) for r in mixing.mix(strange, repeat=2.0).collect())
    assert found == Counter({(1, None, 0): 1, (None, None, 0): 1, (2, "z", 0): 1, (3, "z", 0): 1})
    rows = mixing.mixed_rows(odd, repeat=2.0)
    assert rows.columns == odd.columns and rows.count() >= 10
    assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in odd.collect()}
    with pytest.raises(ValueError):
        mixing.mix(odd)
