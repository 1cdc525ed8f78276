import random
from itertools import combinations

import xxhash

from strikelens.llm import simhash
from strikelens.llm.components import components



def plain(text, k=3):
    """The contract, bit by bit."""
    import re

    text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint(spark):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 4, 50):
        text = "".join(rng.choice([" ", "\n", "A", "É", "b c", "字\x0b"]) for _ in range(3 * n))
        assert simhash.fingerprint(text) == plain(text)
    [row] = spark.sql("select xxhash64('the quick fox') as h").collect()
    assert simhash.fingerprint("The Quick fox") == row.h % (1 << 64)


def test_every_pair_within_the_radius_shares_a_table():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        for bits in combinations(range(0, 64, 3), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def _classes(fps, radius):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in fps}


def test_links_close_like_all_pairs(spark):
    """Around a few centres, with small buckets compared by pairs and large ones by points."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:8]:
        for _ in range(25):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    want = _classes(sorted(fps), 2)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    groups = {}
    for x, r in want.items():
        groups.setdefault(r, set()).add(simhash._signed(x))
    for pairwise in (3, 1000):
        found = {r.node: r.root for r in components(simhash.links(df, 2, pairwise)).collect()}
        got = {}
        for x in map(simhash._signed, fps):
            got.setdefault(found.get(x, x), set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (3, 2)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[100 + i] == 100 for i in range(50))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    classes = _classes(sorted(set(prints.values())), 2)
    least = {}
    for i in sorted(prints, reverse=True):
        least[classes[prints[i]]] = i
    rows = simhash.near_duplicates(docs).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {
        (i, f"{p:016x}", least[classes[p]]) for i, p in prints.items()
    }
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd).collect()]
    assert len(found) == 10
    by_id = {i: (f, c) for i, f, c in found if i is not None}
    assert by_id[2] == by_id[3] == by_id[4] == ("0" * 16, 2) and by_id[5][1] == 1
    assert sorted(c is None for i, _, c in found if i is None) == [False, True]  # one is empty like 2
    assert simhash.near_duplicates(empty).count() == 0


def test_first_of_each(odd, empty):
    kept = simhash.first_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [
        (False, 0), (False, 0), (True, 1), (True, 2), (True, 6), (True, 7),
    ]
    assert simhash.first_of_each(empty).count() == 0
