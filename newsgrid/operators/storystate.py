"""Story aggregates as mergeable state: a run reads its new articles and one compact table, not the history.

A state has one row for each (story_id, kind, value, at) with three numbers and an order, so every part of it merges by one grouping:

==========  ====================  ============================================================================
kind        value, at             what the row holds
==========  ====================  ============================================================================
source      source_name           n: articles, for the distinct sources
domain      source_domain         n: articles, for the distinct domains
genre       main_genre            n: articles, for the majority
category    llm_category          n: accepted articles, for the majority
total       -                     n: articles, chars: description, full: scraped in full, low: best priority
old         -                     best: representative among the articles older than every age step
young       -, article            best: score without the age; it may still change its place with time
newest      -                     best: newest embedded article
==========  ====================  ============================================================================

Only *young* rows depend on the clock. They are as many as the articles of the last ``YOUNG_HOURS``; :func:`aged` folds those that have
passed the last step into *old*. The clock must not go back. A state of parts in any order and cut equals the state of all articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import numbering, stories

col = F.col
#: From this age on an article's score no longer changes, and it is not recent: the last step of the age score and the window of momentum.
YOUNG_HOURS = 16
RECENT_HOURS = 6
SCHEMA = ("story_id long, kind string, value string, at timestamp, id long, n long, chars long, full long, low long, "
          "quality double, depth double, best struct<score:double, at:timestamp, neg:long>")
KEY = ["story_id", "kind", "value", "at", "id"]


def _age(as_of: Column, published: Column) -> Column:
    return S.hours_between(as_of, published)


def _score(quality: Column, depth: Column, age: Column) -> Column:
    """The score of a representative, summed in the order of :func:`stories.representative_score`."""
    return quality * 0.5 + S.age_step(age) * 0.3 + depth * 0.2


def parts(articles: DataFrame, as_of: Column) -> DataFrame:
    """The state of these articles alone. One pass: every article gives its rows, which are grouped map-side, so a story that
    holds a third of all articles is a handful of rows for each task."""
    priority = F.coalesce(col("api_source_priority"), F.lit(1))
    age = _age(as_of, col("published_at"))
    young = F.coalesce(age < YOUNG_HOURS, F.lit(False))
    quality = S.source_quality(priority, 0)
    depth = F.least(S.chars(col("full_text")), F.lit(3000)) / F.lit(3000.0)
    neg = -col("id")
    types = {f.split()[0]: f.split()[1] for f in SCHEMA.split(", best")[0].split(", ")} | {"best": "struct<score:double,at:timestamp,neg:long>"}

    def row(kind: str, keep: Column = F.lit(True), **values: Column) -> Column:
        given = {"kind": F.lit(kind), "n": F.lit(1), **values}
        fields = [given.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items() if n != "story_id"]
        return F.when(keep, F.struct(*fields))

    def best(score: Column, at: Column) -> Column:
        return F.struct(score.cast("double").alias("score"), at.cast("timestamp").alias("at"), neg.alias("neg"))

    rows = F.array(
        row("source", col("source_name").isNotNull(), value=col("source_name")),
        row("domain", value=F.coalesce("source_domain", F.lit(""))),
        row("genre", col("main_genre").isNotNull(), value=col("main_genre")),
        row("category", col("llm_category").isNotNull() & (col("filter_status") == "accepted"), value=col("llm_category")),
        row("total", chars=S.chars(col("description")), full=F.coalesce(col("scrape_status") == "full", F.lit(False)).cast("long"),
            low=F.when(priority > 0, priority)),
        row("young", young, at=col("published_at"), id=col("id"), quality=quality, depth=depth),
        row("old", ~young, best=best(_score(quality, depth, age), F.lit(None))),
        row("newest", col("embedding").isNotNull(), best=best(F.lit(None), col("published_at"))),
    )
    flat = articles.filter(col("story_id").isNotNull()).select("story_id", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r"))
    return _grouped(flat.select("story_id", "r.*"))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("full").alias("full"), F.min("low").alias("low"),
        F.max("quality").alias("quality"), F.max("depth").alias("depth"), F.max("best").alias("best"))


def merge(one: DataFrame, other: DataFrame) -> DataFrame:
    """The state of the articles of both; they must not share an article."""
    return _grouped(one.unionByName(other))


def aged(state: DataFrame, as_of: Column) -> DataFrame:
    """The state with young rows that have passed the last step folded into the best old one of their story."""
    age = _age(as_of, col("at"))
    gone = (col("kind") == "young") & (age >= YOUNG_HOURS)
    folded = F.struct(_score(col("quality"), col("depth"), age).alias("score"), F.lit(None).cast("timestamp").alias("at"), (-col("id")).alias("neg"))
    kept = {"kind": F.when(gone, F.lit("old")).otherwise(col("kind")), "best": F.when(gone, folded).otherwise(col("best"))}
    kept |= {n: F.when(~gone, col(n)) for n in ("at", "id", "quality", "depth")}
    return _grouped(state.withColumns(kept))


def signals(state: DataFrame, as_of: Column) -> DataFrame:
    """What :func:`stories.article_signals` finds in all articles, from their state."""
    kind, age = col("kind"), _age(as_of, col("at"))
    young, total = kind == "young", kind == "total"
    now = F.struct(_score(col("quality"), col("depth"), age).alias("s"), (-col("id")).alias("neg"))
    rep = F.when(young, now).when(kind == "old", F.struct(col("best.score").alias("s"), col("best.neg").alias("neg")))
    n = F.sum(F.when(total, col("n")))
    return state.groupBy("story_id").agg(
        F.min("low").alias("best_priority"), F.count_if(kind == "domain").alias("domains"),
        F.count_if(young & (age < RECENT_HOURS)).alias("recent"),
        (F.sum(F.when(total, col("chars"))) / n).alias("avg_desc"), (F.sum(F.when(total, col("full"))) / n).alias("scrape_rate"),
        F.max(rep).alias("rep"))


def source_counts(state: DataFrame) -> DataFrame:
    """(story_id, source_count), as :func:`stories.source_counts`: stories without a named source count zero."""
    return state.groupBy("story_id").agg(F.count_if(col("kind") == "source").alias("source_count"))


def majority(state: DataFrame, kind: str, out: str) -> DataFrame:
    """(story_id, out), as :func:`stories.majority`."""
    counts = state.filter(col("kind") == kind).select("story_id", col("value").alias(out), "n")
    return numbering.top_per_key(counts, ["story_id"], [col("n").desc(), col(out)], 1).select("story_id", out)


def newest(state: DataFrame) -> DataFrame:
    """(story_id, representative_article_id): the newest embedded article. Its vector is looked up by that id."""
    return state.filter(col("kind") == "newest").select("story_id", (-col("best.neg")).alias("representative_article_id"))


def score_stories(rows: DataFrame, state: DataFrame, as_of: Column) -> DataFrame:
    """As :func:`stories.score_stories`, from the state."""
    return stories.scored(rows, signals(state, as_of), as_of)
