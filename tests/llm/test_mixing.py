"""Targets against a plain water filling, and what the splitting tree promises."""

import math
import re

import numpy as np
import pytest

from newsgrid.llm import mixing


def plain_targets(sizes):
    """Shares by weight, over and over, with full sources taken out."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total >= 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def check(docs, rows):
    texts = {r.doc_id: r for r in docs.collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in texts.items()}
    totals, taken = {}, {}
    for r in rows:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"]
        s = texts[r.doc_id].source
        totals[s] = totals.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    goal = plain_targets(totals)
    for r in rows:
        s = texts[r.doc_id].source
        assert r.source_size == totals[s] and r.target == pytest.approx(goal[s], abs=1e-6)
        assert taken[s] == pytest.approx(goal[s], abs=1.001)


def test_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix(docs).collect()
    check(docs, rows)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(rows) == sorted(again)


@pytest.mark.parametrize("seed", [1, 2])
def test_uneven_sources(spark, documents, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, " ".join("w" * int(n)) if n else "", "en", s) for i, (n, s) in enumerate(zip(rng.geometric(0.002, 150) % 4000, rng.choice(["a", "B", "é", "hot", "hot", "hot", None], 150).tolist()))]
    docs = documents(rows)
    check(docs, mixing.mix(docs, block_words=16, shard_blocks=8).collect())


def test_odd_rows(spark, documents, mixed_rows):
    rows = mixing.mix(documents(mixed_rows)).collect()
    assert len(rows) == len(mixed_rows)
    assert all(r.taken == 0 and r["size"] == 0 for r in rows if r.doc_id in (100, 101, 104, 106))
    assert sorted(r.target for r in rows if r.doc_id == 0) and len({r.taken for r in rows if r.doc_id == 0}) <= 2
    assert mixing.mix(documents([])).collect() == []
    assert [r.taken for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [0, 0]


def test_shards_take_exact_disjoint_runs(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 37), (2, 1), (3, 512)], "source_no int, draws long")
    plan = mixing.plan_shards(quotas, 1550, shard_blocks=5).collect()
    per_shard, runs = {}, {}
    for r in plan:
        per_shard[r.shard] = per_shard.get(r.shard, 0) + r.n
        runs.setdefault(r.source_no, []).append((r.start, r.start + r.n))
    assert len(per_shard) == 310 and set(per_shard.values()) == {5}
    for source, n in [(0, 1000), (1, 37), (2, 1), (3, 512)]:
        ordered = sorted(runs[source])
        assert ordered[0][0] == 0 and ordered[-1][1] == n and all(a[1] == b[0] for a, b in zip(ordered, ordered[1:]))


def test_splits_are_hypergeometric():
    quota, left = np.array([600, 300, 100]), 250
    draws = np.array([mixing.split_quota(quota, left, (i,)) for i in range(400)])
    assert (draws.sum(axis=1) == left).all() and (draws <= quota).all()
    assert np.allclose(draws.mean(axis=0), left * quota / 1000, atol=1.5)
    share = quota / 1000
    assert np.allclose(draws.var(axis=0), left * share * (1 - share) * 750 / 999, rtol=0.3)
    huge = mixing.split_quota(quota * 10**7, left * 10**7, (1,))
    assert huge.sum() == left * 10**7 and (huge <= quota * 10**7).all()


@pytest.mark.parametrize("good, bad, draws", [(300, 700, 250), (5, 995, 500), (900, 3, 200), (40, 60, 99)])
def test_listed_chances_are_the_exact_ones(monkeypatch, good, bad, draws):
    """With the generator switched off, small draws have the chances of exact whole-number arithmetic."""
    monkeypatch.setattr(mixing, "GENERATOR_BELOW", 0)
    rng = np.random.default_rng(3)
    n = 4000
    seen = np.bincount([mixing.hypergeometric(rng, good, bad, draws) for _ in range(n)], minlength=good + 1)
    chance = np.array([math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws) if k <= draws else 0 for k in range(good + 1)])
    assert seen[chance == 0].sum() == 0
    assert np.abs(np.cumsum(seen) / n - np.cumsum(chance)).max() < 1.95 / np.sqrt(n)  # Kolmogorov's limit at one in a thousand


def test_huge_splits_keep_mean_and_spread():
    good, bad, draws = 3 * 10**11, 7 * 10**11, 4 * 10**11
    got = np.array([mixing.hypergeometric(np.random.default_rng(i), good, bad, draws) for i in range(60)], float)
    total = good + bad
    mean, deviation = draws * good / total, np.sqrt(draws * 0.3 * 0.7 * (total - draws) / (total - 1))
    assert abs(got.mean() - mean) < 4 * deviation / np.sqrt(60) and 0.6 < got.std() / deviation < 1.4


def test_shards_of_documents_follow_the_tree(spark, documents):
    """The lowest and highest shard of each document against a plain walk down the tree."""
    rng = np.random.default_rng(5)
    docs = documents([(i, " ".join("w" * int(n)), "en", s) for i, (n, s) in enumerate(zip(rng.integers(1, 400, 60), rng.choice(["a", "b", "c"], 60).tolist()))])
    sized = mixing.sizes(docs)
    goal = mixing.targets(sized)
    rows = sized.join(goal.select("source", "source_no"), "source").selectExpr("doc_id", "source_no", "size", "1 AS copy")
    drawn = mixing.draw(rows, goal, 16).collect()
    quota = np.bincount([r.source_no for r in drawn]).astype(np.int64)
    shards = -(-int(quota.sum()) // 8)
    where = {}

    def walk(low, high, quota, start):
        if high - low == 1:
            where.update({(s, p): low for s, (a, n) in enumerate(zip(start, quota)) for p in range(a, a + n)})
            return
        middle = (low + high) // 2
        left = mixing.split_quota(quota, int(quota.sum()) * (middle - low) // (high - low), (low, high))
        walk(low, middle, left, start)
        walk(middle, high, quota - left, start + left)

    walk(0, shards, quota, np.zeros(len(quota), np.int64))
    plain = {}
    for r in drawn:
        plain.setdefault(r.doc_id, []).append(where[r.source_no, r.position])
    got = {r.doc_id: (r.first_shard, r.last_shard) for r in mixing.mix(docs, block_words=16, shard_blocks=8).collect() if r.taken}
    assert got == {i: (min(p), max(p)) for i, p in plain.items()} and shards > 50
