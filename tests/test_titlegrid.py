"""Titles over a small vocabulary meet in a grid of blocks."""

import random

import pytest
from pyspark.sql import functions as F

from newsgrid.functions import scalars as S
from newsgrid.operators import dedup, titlegrid

from test_dedup import grams, loop


def dense_titles(seed, n):
    """Titles of few syllables, every third a near copy of an earlier one."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and i % 3 == 0:
            t = list(rng.choice(rows)[1])
            for _ in range(rng.randint(1, 5)):
                t[rng.randrange(len(t))] = rng.choice("aent")
            title = "".join(t)
        else:
            title = " ".join("".join(rng.choices(["an", "the", "re", "ti"], k=rng.randint(2, 4))) for _ in range(rng.randint(3, 12)))
        rows.append((i * 5, title))
    return rows


@pytest.mark.parametrize("block,tile", [(10_000, (64, 4096)), (60, (3, 7))])
def test_grid_equals_loop(spark, monkeypatch, block, tile):
    monkeypatch.setattr(titlegrid, "SMALL_BLOCK", block)
    monkeypatch.setattr(titlegrid, "TILE", tile)
    rows = {t: i for i, t in reversed(dense_titles(block, 300))}
    rows = sorted((i, t) for t, i in rows.items())
    df = spark.createDataFrame(rows, "rid long, title string").select("rid", S.packed_trigrams(F.col("title")).alias("grams"))
    got = [r.rid for r in titlegrid.survivors(df, 0.7).collect()]
    assert len(got) == len(set(got)) and set(got) == loop(rows) and len(got) < len(rows)
    assert all(grams(t) for _, t in rows)


def test_dense_titles_make_no_keys(spark, monkeypatch):
    """Keys of up to three crowded trigrams multiply: 1,330 for a prefix of 21."""
    monkeypatch.setattr(dedup, "signatures", lambda *a, **k: pytest.fail("keys were made"))
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("etaoin", k=70))) for i in range(200)]
    rows += [(1000 + i, t[:-2] + "xy") for i, t in rows[::4]]
    got = dedup.fuzzy_survivors(spark.createDataFrame(rows, "batch_seq long, title string"), split_rows=4)
    assert {r[0] for r in got.collect()} == loop(rows)
