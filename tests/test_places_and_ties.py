"""Keywords beyond the hundredth of a title and articles of the same minute."""

import random

from pyspark.sql import functions as F

from newsgrid.operators import numbering, stories, timeline


def keyword_loop(rows, limit=20):
    """rows: (story, id, importance, keywords)"""
    out = {}
    for story in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == story), key=lambda r: (r[2] is None, -(r[2] or 0.0), r[1]))
        if len(mine) <= 2:
            out[story] = min(mine, key=lambda r: (-(r[2] or 0.0), r[2] is None, r[1]))[3][:limit]
            continue
        first, count = {}, {}
        for rank, r in enumerate(mine, 1):
            for pos, w in enumerate(r[3], 1):
                first[w] = min(first.get(w, (10**9, 0)), (rank * 100 + pos, rank))
                count[w] = count.get(w, 0) + 1
        if len(mine) <= 5:
            out[story] = sorted(first, key=first.get)[:limit]
        else:
            out[story] = sorted((w for w in first if count[w] >= 2), key=lambda w: (-count[w], first[w]))[:limit]
    return out


def test_keywords_of_long_titles(spark):
    rng = random.Random(3)
    rows = []
    for story, n in enumerate([1, 2, 3, 5, 6, 40]):
        for i in range(n):
            words = [f"w{story}x{rng.randrange(4000)}" for _ in range(rng.choice([3, 8, 230, 400]))]
            rows.append((story, story * 1000 + i, rng.choice([None, 0.0, 0.2, 0.9]), words))
    df = spark.createDataFrame(rows, "story_id long, id long, importance_score double, api_keywords array<string>")
    got = {r.story_id: r.keyword_set for r in stories.story_keywords(df.repartition(5)).collect()}
    assert got == keyword_loop(rows)


def test_numbers_of_a_key_that_fills_many_ranges(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), F.hash("id").alias("x"))
    got = {(r.k, r.id): r.no for r in numbering.ordered_number(df, [F.col("x"), F.col("id")], "no", ["k"]).collect()}
    rows, want = df.collect(), {}
    for k in {r.k for r in rows}:
        for no, r in enumerate(sorted((r for r in rows if r.k == k), key=lambda r: (r.x, r.id)), 1):
            want[k, r.id] = no
    assert got == want


def test_current_article_of_equal_times_is_the_smallest_id(spark):
    rows = [(1, 7, "2024-01-14 10:00:00"), (1, 49372, "2024-01-14 10:00:00"), (2, 49373, "2024-01-14 10:00:00"), (2, 8, "2024-01-14 10:00:00"),
            (2, 5, "2024-01-14 09:59:00"), (3, 4, None), (None, 1, "2024-01-14 10:00:00")]
    df = spark.createDataFrame(rows, "story_id long, id long, t string").withColumn("published_at", F.col("t").cast("timestamp"))
    for parts in (1, 4):
        assert {tuple(r) for r in timeline.current_articles(df.repartition(parts)).collect()} == {(1, 7), (2, 8), (3, None)}
