import hashlib
import random

import pytest

from strikelens.llm.substrings import _pack, _unpack, without_repeats

import numpy as np


def plain(rows, window):
    docs = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(docs):
        for p in range(len(docs[i]) - window + 1):
            first.setdefault(tuple(docs[i][p : p + window]), i)
    out = {}
    for i, words in docs.items():
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[i] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def _found(df, window, **more):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in without_repeats(df, window, keep_text=False, **more).collect()}


@pytest.mark.parametrize("window", [10, 7, 2])
def test_random_passages(frame, window):
    rng = random.Random(window)
    passages = [[f"p{k}_{j}" for j in range(rng.randrange(5, 30))] for k in range(10)]
    rows = []
    for i in rng.sample(range(500), 200):
        words = []
        for _ in range(rng.randrange(8)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(3)}" for _ in range(rng.randrange(6))]
        rows.append((i, " ".join(words)))
    assert _found(frame(rows), window, chunks=5) == plain(rows, window)


def test_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _found(docs, 50) == plain(rows, 50)


def test_odd_rows(odd, empty):
    rows = without_repeats(odd, 5).collect()
    assert len(rows) == 10
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by_id[2].n_words, by_id[3].n_words, by_id[4].kept) == (0, 0, "")
    assert by_id[1].n_removed == 0  # its own repeated row removes nothing
    assert by_id[5].n_removed == 12 and by_id[5].kept == ""
    assert by_id[6].n_removed == 0  # repeats within one document stay
    assert without_repeats(empty, 5).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 100_000):
        keys = np.unique(rng.integers(0, 1 << 32, n, dtype=np.uint64))
        assert (_unpack(_pack(keys)) == keys).all()
