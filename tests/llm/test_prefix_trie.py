"""Nodes against a plain trie, with pieces and containers of every size."""

import hashlib
import random
import re
import zlib

import pytest
from strikelens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, end string, place string, n string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def _plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), name, (role, text)))
    convs = {c: [t[2] for t in sorted(held)] for c, held in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole[c] = tuple(convs.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        inner = {q[:-1] for q in nodes if q}
        ends = ",".join(map(str, sorted(c for c in members if whole[c] == p)))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), sum(q[:-1] == p for q in nodes if q),
            sum(q not in inner for q in under), sum((len(nodes[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(map(repr, out))


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _found(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


def _random(seed, n, turns, texts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), f"{rng.randrange(texts)} word " * rng.randrange(3)) for c in range(n) for t in range(rng.randrange(turns))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("piece", "container"), [(4096, 60), (3, 100_000), (1, 1)])
def test_equals_plain_trie(spark, piece, container):
    rows = _random(piece, 90, 7, 2)
    rows += [(200 + i, t, "user", f"copied turn {t}") for i in range(60) for t in range(6)]  # copies, and one first turn
    assert _found(prefix_trie.trie(_table(spark, rows), piece, container)) == _plain(rows)


ODD = [
    (1, None, "u", "null first"), (1, 0, "u", "x"), (1, None, None, None), (2, 0, "u", "x"), (2, 0, "u", "x"), (2, 0, "u", "a"), (None, 0, "u", "x"),
    (20, 0, None, ""), (21, 5, "", None), (22, -1, "ab", "c"), (23, -1, "a", "bc"), (40, 0, "u", " \t\n"), (41, 0, "u", "long " * 30_000 + "\x00 漢字"),
    (-3, 0, "u", "x"), (-20, 1, "u", "y"), (-25, 1, "u", "y"), (45, 1, "only", "own"), (46, 1, "only", "own"), (47, 1, "only", "own"), (48, 1, "only", "own"),
]


def test_odd_rows(spark):
    assert _found(prefix_trie.trie(_table(spark, ODD))) == _plain(ODD)


def test_empty_tables(spark):
    assert prefix_trie.trie(_table(spark, [])).collect() == []
    nameless = prefix_trie.trie(_table(spark, [(None, 0, "u", "x")]))
    assert nameless.collect() == [] and nameless.columns == COLUMNS
    # A conversation whose only turns are taken by a family without a first one has no turns left.
    rows = [(c, 0, "u", "x") for c in range(101, 120)]
    assert _found(prefix_trie.trie(_table(spark, rows))) == _plain(rows)


def test_a_long_conversation_lies_in_several_pieces(spark):
    rows = [(c, t, "u", f"turn {t}" if t < 170 else f"turn {t} of {c}") for c in (7, 8, 29) for t in range(180)]
    table = _table(spark, rows)
    assert prefix_trie.pieces(table, 50).groupBy("conv_id").count().where("count = 4").count() == 3
    assert _found(prefix_trie.trie(table, 50, 20)) == _plain(rows)


def test_numbers_go_on_across_parts(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, 5L, id % 40) as conv_id", "id as turn")
    got = prefix_trie.numbered(rows, ["turn"]).collect()
    held = {}
    for r in sorted(got, key=lambda r: r.turn):
        assert r.place == held.get(r.conv_id, 0)
        held[r.conv_id] = r.place + 1
    assert held[5] > 6000


def test_digest_of_many_ends(spark):
    ended = spark.range(5000).selectExpr("id * 7 - 9000 as conv_id", "array(id % 3 div 2, 4L) as end")
    got = {tuple(r.ends): r.ends_sha256 for r in prefix_trie.ends_digest(ended, text=100).collect()}
    want = {k: ",".join(str(i * 7 - 9000) for i in range(5000) if i % 3 // 2 == k) for k in (0, 1)}
    assert got == {(k, 4): hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
