"""Fuzzy and exact duplicates against the plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import dedup

SCHEMA = "batch_seq long, title string"


def grams(s):
    s = s.lower()
    return {s[i:i + 3] for i in range(len(s) - 2)}


def loop(rows, threshold=0.7):
    kept = []
    for i, title in sorted(rows):
        g = grams(title or "")
        if not any(len(g & k) / len(g | k) > threshold for _, k in kept if g | k):
            kept.append((i, g))
    return {i for i, _ in kept}


def near_copies(seed, n, bases):
    """Titles in groups of near copies, some equal apart from case, some very short."""
    rng = random.Random(seed)
    words = ["river", "bridge", "market", "council", "report", "growth", "harbour", "school", "energy", "winter"]
    stems = [" ".join(rng.choices(words, k=7)) for _ in range(bases)]
    rows = []
    for i in range(n):
        t = list(rng.choice(stems))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("abcdefghij ")
        rows.append((i * 3, "".join(t).upper() if i % 9 == 0 else "".join(t)))
    return [*rows, (10**6, "ab"), (10**6 + 1, "ab"), (10**6 + 2, None), (10**6 + 3, "")]


@pytest.mark.parametrize("seed,split_rows", [(1, 2000), (2, 20), (3, 5)])
def test_fuzzy_equals_loop(spark, seed, split_rows):
    rows = near_copies(seed, 250, 6)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r[0] for r in dedup.fuzzy_survivors(df, split_rows=split_rows).collect()]
    assert len(got) == len(set(got))
    assert set(got) == loop(rows)


def test_fuzzy_does_not_depend_on_layout(spark):
    rows = near_copies(4, 150, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r[0] for r in dedup.fuzzy_survivors(df.repartition(1)).collect()}
    many = {r[0] for r in dedup.fuzzy_survivors(df.repartition(32, F.rand(7)), split_rows=10).collect()}
    assert one == many


def test_one_hot_group_keeps_one(spark):
    rows = [(i, f"Government announces a plan to build the new harbour bridge {i % 90}") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[0] for r in dedup.fuzzy_survivors(df, split_rows=40).collect()] == [0]


def test_empty_batch(spark):
    assert dedup.fuzzy_survivors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_layers(spark):
    from newsgrid.plans.views import as_of

    cols = "batch_seq long, title string, url string, source_domain string, api_duplicate_flag boolean"
    batch = dedup.article_hashes(spark.createDataFrame([
        (1, "The council votes on the harbour bridge", "https://a.com/1/", "a.com", None),
        (2, "Something flagged by its own source", "https://a.com/2", "a.com", True),
        (3, "The same page again under another title", "https://www.a.com/1?x=1", "a.com", False),
        (4, "A story that was stored a few days ago", "https://b.com/9", "b.com", False),
        (5, "The council votes on the harbour bridges", "https://c.com/7", "c.com", False),
        (6, "Farmers expect a poor harvest this year", "https://c.com/8", "c.com", False),
    ], cols))
    stored = dedup.article_hashes(spark.createDataFrame(
        [("A story that was stored, a few days ago!", "https://z.com/1", "z.com", "2024-01-12 00:00:00"),
         ("Farmers expect a poor harvest this year", "https://z.com/2", "z.com", "2023-12-12 00:00:00")],
        "title string, url string, source_domain string, t string")).withColumn("published_at", F.col("t").cast("timestamp"))
    got = {r.batch_seq: r.rule for r in dedup.deduplicate(batch, stored, as_of()).collect()}
    assert got == {1: None, 2: "dedup_newsdata_flag", 3: "dedup_batch_url", 4: "dedup_exact", 5: "dedup_fuzzy", 6: None}


def similar_pairs(rows, threshold=0.7):
    sets = [(i, grams(t)) for i, t in rows if t and len(t) >= 3]
    return {(a, b) for k, (a, g) in enumerate(sets) for b, h in sets[k + 1:] if len(g & h) / len(g | h) > threshold}


def gram_rows(spark, rows):
    from newsgrid.functions import scalars as S

    return spark.createDataFrame(rows, "rid long, title string").filter("length(title) >= 3").select("rid", S.packed_trigrams(F.col("title")).alias("grams"))


@pytest.mark.parametrize("depth,limit", [(1, 64), (2, 3), (3, 1), (3, 8)])
def test_similar_titles_share_a_key(spark, depth, limit):
    rows = [*[r for r in near_copies(5, 120, 5) if r[1]], (2_000_000, "abc"), (2_000_001, "abcd"), (2_000_002, "abc"), (2_000_003, "aaaa"), (2_000_004, "aaaaa")]
    keys = {}
    for r in dedup.signatures(gram_rows(spark, rows), 0.7, depth, limit).collect():
        keys.setdefault(r.rid, set()).add(r.token)
    pairs = similar_pairs([(i, t.lower()) for i, t in rows])
    lower = {r.rid for r in gram_rows(spark, rows).collect()}
    plain = {(a, b) for a, b in similar_pairs([(i, t) for i, t in rows if t == t.lower()]) if a in lower and b in lower}
    assert plain and plain <= pairs and all(keys[a] & keys[b] for a, b in plain)


def test_candidates_do_not_grow_with_unrelated_titles(spark):
    """Twice as many unrelated titles over the same small alphabet: pairs per title stay about the same."""
    rng = random.Random(9)

    def candidates(n):
        rows = gram_rows(spark, [(i, " ".join("".join(rng.choices("etaoin", k=5)) for _ in range(8))) for i in range(n)])
        keys = dedup.signatures(rows, 0.7, limit=16)
        sizes = keys.groupBy("token").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        return dedup._pairs(keys, keys, sizes, 0.7, False).count() / n

    one, two = candidates(1500), candidates(3000)
    assert two < 1.5 * one, (one, two)


def test_what_looks_small_on_disk_is_not_broadcast(spark, monkeypatch):
    """Copies to all salts, sets of frequent trigrams and edges of a hub take many times their file size in the driver."""
    from newsgrid.session import cut

    plans = []

    def planned(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(dedup, "cut", lambda df: cut(planned(df)))
    rows = cut(gram_rows(spark, [r for r in near_copies(5, 120, 5) if r[1]]))
    planned(dedup.signatures(rows, 0.7, limit=3))
    edges = cut(rows.filter("rid > 0").select(F.lit(0).cast("long").alias("lo"), F.col("rid").alias("hi")))
    planned(dedup._verify(edges, rows, 0.7))
    states = {r.rid: r.state for r in dedup.settle(rows.select("rid", F.lit(True).alias("complete")), edges).collect()}
    assert states.pop(0) == "kept" and set(states.values()) == {"dropped"}
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin) \[(\w+)#", "\n".join(plans))
    assert {"token", "lo", "hi"} <= {key for _, key in joins}
    assert not [key for kind, key in joins if kind == "BroadcastHashJoin" and key != "rid"]
