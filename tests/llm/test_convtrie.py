"""The conversation trie against a plain dictionary of prefixes, for any size of the shards."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from newsgrid.llm import convtrie
from newsgrid.llm.queries import QUERIES

CONVERSATIONS = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(paths):
    """paths: {conv_id: list of (role, text)}."""
    nodes = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: sum(1 for q in nodes if len(q) == len(p) + 1 and q[:-1] == p) for p in nodes}
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(p))))
        out.append((
            min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), kids[p], sum(kids[q] == 0 for q in below),
            sum((len(nodes[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def plain_rebuilt(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(own, key=lambda x: x[0])] for c, own in turns.items()}
    return {c: [*turns.get(c - c % 20, [])[:(h := zlib.crc32(str(c).encode()) % 4)], *own[h:]] for c, own in turns.items()}


def shown(df):
    assert df.columns == COLUMNS
    return sorted(str(tuple(r)) for r in df.collect())


def some_rows(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 400), n):
        c = abs(c) if c < 0 and rng.random() < 0.5 else c
        text = rng.choice(["hot", "x"])
        for turn in range(rng.choice([1, 2, 3, 5, 9])):
            rows.append((c, turn, ("user", "assistant")[turn % 2], f"{text} {'y ' * turn}{rng.choice('aaab')}"))
    return [*{(r[0], r[1]): r for r in rows}.values()]


def test_find_close():
    rng = np.random.default_rng(2)
    for n in (1, 3, 70, 4000, 60_000):
        bits, depth = [1], 1
        while depth:
            up = len(bits) < n and rng.random() < (0.5 if depth > 1 else 0.9)
            bits.append(1 if up else -1)
            depth += bits[-1]
        bits = np.array(bits)
        opens = np.flatnonzero(bits > 0)
        stack, close = [], {}
        for i, b in enumerate(bits.tolist()):
            stack.append(i) if b > 0 else close.__setitem__(stack.pop(), i)
        assert convtrie.find_close(np.cumsum(bits), opens).tolist() == [close[i] for i in opens.tolist()]


@pytest.mark.parametrize("seed,shard,least,last", [(1, 20_000, 8, 200_000), (2, 5, 2, 60), (3, 1, 4, 20)])
def test_trie_equals_plain(spark, seed, shard, least, last):
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    got = convtrie.prefix_trie(convtrie.rebuilt_paths(df), shard, least, last)
    assert shown(got) == plain_trie(plain_rebuilt(rows))


def test_copies_and_deep_conversations_over_many_shards(spark):
    """A third of all conversations is one sequence, and others share a long spine."""
    rows = [(c, t, "user", f"same {t}") for c in range(60) for t in range(4)]
    rows += [(c, t, "user", f"deep {t}" if t < c - 60 else f"own {c} {t}") for c in range(100, 130) for t in range(80)]
    rows += [(c, 0, "user", f"own {c}") for c in range(200, 260)]
    paths = {}
    for c, _, role, text in rows:
        paths.setdefault(c, []).append((role, text))
    for shard in (30, 900):
        got = convtrie.prefix_trie(convtrie.turn_paths(spark.createDataFrame(rows, CONVERSATIONS)), shard, 4, 300)
        assert shown(got) == plain_trie(paths)


def test_query_equals_plain(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert shown(QUERIES["op13_conversation_trie"](spark, small)) == plain_trie(plain_rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 3, "user", "b"), (1, 0, "user", "a  a\n\t"), (2, 5, "user", "alone"), (3, None, "", ""), (20, 0, "r", "lent one"), (21, 0, "r", "x"), (25, 1, "r", "y"),
        (25, 1, "r", "y"), (40, 0, "user", "word " * 50_000), (None, 0, "user", "nobody"), (-3, 0, "ä", "ü ö"), (41, 9, "12:", "x"), (42, 9, "1", "2:x"),
    ]
    df = spark.createDataFrame(rows, CONVERSATIONS).selectExpr("*", "1 AS path", "2 AS words", "3 AS key", "4 AS lender", "5 AS h", "6 AS t")
    by_hand = plain_rebuilt([r for r in rows if r[0] != -3])
    got = [s for s in shown(convtrie.prefix_trie(convtrie.rebuilt_paths(df.filter("conv_id IS NULL OR conv_id <> -3")), 3, 2, 10))]
    assert got == plain_trie(by_hand)
    assert any(not p for p in by_hand.values())  # one of them is without turns
    assert convtrie.prefix_trie(convtrie.rebuilt_paths(df)).count() > 0
    assert convtrie.prefix_trie(convtrie.rebuilt_paths(df.limit(0))).collect() == []
