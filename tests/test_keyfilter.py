"""Filters of stored keys: no stored key is missed, few others are suspected, and merging equals building at once."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsgrid.operators import dedup, keyfilter

DAY = datetime.date(2024, 1, 10)


def keys(spark, numbers, day=DAY):
    return spark.createDataFrame([(day, 1, f"k{n}") for n in numbers], "day date, kind int, hash string")


def merged(old, new):
    return new.unionByName(old.join(new.select("day").distinct(), "day", "left_anti"))


def test_filters_miss_nothing_and_grow(spark):
    filters = spark.createDataFrame([], keyfilter.SCHEMA)
    for start in range(0, 6000, 1500):
        filters = merged(filters, keyfilter.added(filters, keys(spark, range(start, start + 1500)), ["kind", "hash"], least_words=256)).cache()
    filters = merged(filters, keyfilter.added(filters, keys(spark, range(90_000, 90_010), DAY + datetime.timedelta(1)), ["kind", "hash"], least_words=256)).cache()
    sizes = filters.groupBy("day", "gen", "words").agg(F.sum("keys").alias("keys")).orderBy("day", "gen").collect()
    assert sum(r["keys"] for r in sizes) == 6010 and all(r["keys"] <= r.words * keyfilter.KEYS_PER_WORD for r in sizes)
    assert len([r for r in sizes if r.day == DAY]) >= 2 and filters.count() <= sum(r.words for r in sizes)
    asked = keys(spark, [*range(6000), *range(90_000, 90_010), *range(200_000, 220_000)])
    found = {int(r.hash[1:]) for r in keyfilter.suspects(asked, filters, ["kind", "hash"]).collect()}
    assert {*range(6000), *range(90_000, 90_010)} <= found
    assert len([n for n in found if n >= 200_000]) < 20_000 * 0.1
    later = filters.filter(F.col("day") > F.lit(DAY))
    assert {int(r.hash[1:]) for r in keyfilter.suspects(asked, later, ["kind", "hash"]).collect()} >= set(range(90_000, 90_010))


def test_empty_filters_and_keys(spark):
    none = spark.createDataFrame([], keyfilter.SCHEMA)
    assert keyfilter.suspects(keys(spark, [1]), none, ["kind", "hash"]).collect() == []
    assert keyfilter.added(none, keys(spark, []), ["kind", "hash"]).collect() == []
    assert keyfilter.added(none, keys(spark, [1], None), ["kind", "hash"]).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_stored_matches_are_the_same_through_filters(spark, seed):
    rng = np.random.default_rng(seed)
    as_of = F.lit("2024-01-15").cast("timestamp")

    def rows(n, first):
        out = []
        for i in range(n):
            a, b, c = (int(x) for x in rng.integers(0, 4000, 3))
            when = None if i % 50 == 0 else datetime.datetime(2024, 1, 15) - datetime.timedelta(hours=int(rng.integers(-5, 300)))
            out.append((first + i, f"u{a}", f"d{b}", f"t{c}" if i % 7 else None, when))
        return spark.createDataFrame(out, "id long, normalized_url_hash string, domain_title_hash string, title_hash string, published_at timestamp")

    stored, batch = rows(3000, 0), rows(300, 10_000)
    filters = spark.createDataFrame([], keyfilter.SCHEMA)
    for part in range(3):
        new = dedup.hash_filters(filters, stored.filter(F.col("id") % 3 == part)).cache()
        filters = merged(filters, new).cache()
    plain = {r.id for r in dedup.stored_matches(batch, stored, as_of, "id").collect()}
    got = {r.id for r in dedup.stored_matches(batch, stored, as_of, "id", filters=filters).collect()}
    assert got == plain and 0 < len(plain) < 300
    # What is left of the history: the stored hashes that a suspect of the batch equals, not all of them.
    pairs = keyfilter.suspects(dedup.hash_pairs(batch, "id"), filters, dedup.HASH_KEY)
    assert dedup.stored_suspects(stored, pairs).count() <= pairs.select(*dedup.HASH_KEY).distinct().count() < dedup.hash_pairs(stored).distinct().count() / 3
