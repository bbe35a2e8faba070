"""Brief and timeline selection against the plain loops."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.operators import brief, timeline


def brief_loop(rows, slots=14, cats=4, regions=8):
    ranked = sorted(rows, key=lambda r: (-r[2], r[0]))
    chosen, stories, c, g = [], set(), {}, {}
    for rid, story, _, cat, reg in ranked:
        if len(chosen) >= slots:
            break
        if (story is not None and story in stories) or c.get(cat or "none", 0) >= cats or g.get(reg or "global", 0) >= regions:
            continue
        chosen.append(rid)
        if story is not None:
            stories.add(story)
        c[cat or "none"] = c.get(cat or "none", 0) + 1
        g[reg or "global"] = g.get(reg or "global", 0) + 1
    for rid, story, *_ in ranked:
        if len(chosen) >= slots:
            break
        if rid in chosen or (story is not None and story in stories):
            continue
        chosen.append(rid)
        if story is not None:
            stories.add(story)
    return chosen


@pytest.mark.parametrize("seed,stories,cats", [(1, 200, 6), (2, 8, 6), (3, 60, 2), (4, 3, 1)])
def test_brief_equals_loop(spark, seed, stories, cats):
    rng = random.Random(seed)
    names = ["economics", "policy", "science", "accountability", "business", None][:cats]
    rows = [(i, rng.choice([None, rng.randrange(stories)]) if seed != 4 else rng.randrange(stories), round(rng.random(), 2),
             rng.choice(names), rng.choice(["india", "global", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, story_id long, score double, llm_category string, main_genre string")
    got = [r.id for r in brief.select_brief(df).orderBy("pos").collect()]
    assert got == brief_loop(rows)


def test_empty_brief(spark):
    df = spark.createDataFrame([], "id long, story_id long, score double, llm_category string, main_genre string")
    assert brief.select_brief(df).count() == 0


def timeline_loop(rows, pin):
    u = lambda v: np.array(v) / np.linalg.norm(v)
    order = sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))
    kept, units, days = [], [], {}
    for r in [x for x in order if x[0] == pin]:
        kept.append(r)
        units += [u(r[2])] if r[2] else []
        days[r[1].date()] = 1
    for r in order:
        if r[0] == pin or days.get(r[1].date(), 0) >= 2:
            continue
        if r[2] and any(u(r[2]) @ x >= 0.85 for x in units):
            continue
        units += [u(r[2])] if r[2] else []
        days[r[1].date()] = days.get(r[1].date(), 0) + 1
        kept.append(r)
    return [r[0] for r in sorted(kept, key=lambda r: -r[1].timestamp())]


@pytest.mark.parametrize("pin", [None, 5, 999])
def test_timeline_equals_loop(spark, pin):
    rng = np.random.default_rng(5)
    start = datetime.datetime(2024, 1, 14, 12)
    base = rng.normal(size=(4, 8))
    rows = [(i, start - datetime.timedelta(hours=7 * i), None if i % 6 == 0 else [float(x) for x in base[i % 4] + 0.3 * rng.normal(size=8)])
            for i in range(40)]
    df = spark.createDataFrame([(1, *r) for r in rows], "story_id long, id long, published_at timestamp, embedding array<double>").withColumn("day", F.to_date("published_at"))
    pins = None if pin is None else spark.createDataFrame([(1, pin)], "story_id long, pinned_id long")
    got = [r.id for r in timeline.select_timeline(df, pins).orderBy("pos").collect()]
    assert got == timeline_loop(rows, pin)


@pytest.mark.parametrize("parts", [1, 7])
def test_ordered_number_equals_a_global_sort(spark, parts):
    """Composite order with ties on the first key; no window over all rows."""
    from newsgrid.operators import numbering

    rows = [(i * 10**8, (i * 7919) % 13) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t long").repartition(parts)
    got = numbering.ordered_number(df, [F.col("t").desc(), F.col("id")], "no")
    want = {r[0]: k + 1 for k, r in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.id: r.no for r in got.collect()} == want
    assert numbering.ordered_number(df.limit(0), [F.col("id")], "no").collect() == []


def test_source_sketches_merge_over_days(spark):
    """Sketches of days merged give about the exact count, also where days share sources and where there are many."""
    from newsgrid.operators import stories

    df = spark.range(60_000).selectExpr("id % 3 AS story_id", "date_add(DATE '2024-01-01', CAST(id % 5 AS INT)) AS day", "IF(id % 3 = 2, NULL, concat('s', IF(id % 3 = 0, id % 21, id))) AS source_name")
    got = {r.story_id: r.source_estimate for r in stories.source_estimates(stories.source_sketches(df)).collect()}
    assert got[0] == 7 and abs(got[1] - 20_000) <= stories.SKETCH_ERROR * 20_000 and got[2] == 0
