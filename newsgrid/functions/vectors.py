"""Vector functions on ``array<double>`` columns and vector aggregates."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero for a zero vector, an error for different lengths."""
    na, nb = dot(a, a), dot(b, b)
    value = F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        F.try_divide(dot(a, b), F.sqrt(na) * F.sqrt(nb))
    )
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(a.isNotNull() & b.isNotNull() & same.isNull(), value)


def max_similarity(v: Column, recent: Column, window: int = config.RECENT_VECTORS) -> Column:
    """Best cosine against the last ``window`` vectors of a list; zero for an empty list."""
    start = F.greatest(F.lit(1), F.size(recent) - (window - 1))
    return F.coalesce(
        F.array_max(F.transform(F.slice(recent, start, F.lit(window)), lambda r: cosine(v, r))),
        F.lit(0.0),
    )


def keyword_score(article_kws: Column, story_kws: Column) -> Column:
    """Share of four reached by the first eight keywords; repeats count each time."""
    hits = F.size(F.filter(F.slice(article_kws, 1, config.MATCH_KEYWORDS), lambda k: F.array_contains(story_kws, k)))
    return F.least(hits / F.lit(4.0), F.lit(1.0))


def match_score(embedding_sim: Column, article_kws: Column, story_kws: Column) -> Column:
    none = (F.coalesce(F.size(article_kws), F.lit(0)) <= 0) | (F.coalesce(F.size(story_kws), F.lit(0)) <= 0)
    mixed = (
        embedding_sim * config.MATCH_EMBEDDING_WEIGHT
        + keyword_score(article_kws, story_kws) * config.MATCH_KEYWORD_WEIGHT
    )
    return F.when(none, embedding_sim).otherwise(mixed)


def vector_mean(v: Column) -> Column:
    """Aggregate: element-wise mean. Partial results are merged map-side, so one huge
    group costs one vector per task in the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def vector_sum(v: Column) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(v)))


def weighted_centroid(old: Column, old_count: Column, added: Column, added_count: Column) -> Column:
    """(old x n + sum of added) / (n + k); the old centroid when nothing was added."""
    merged = F.zip_with(old, added, lambda o, a: (o * old_count + a) / (old_count + added_count))
    return F.when(added.isNull() | (F.coalesce(added_count, F.lit(0)) == 0), old).otherwise(
        F.coalesce(merged, F.transform(added, lambda a: a / added_count))
    )
