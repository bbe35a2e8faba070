"""Feed: one recent article per story, ranked; bullets and relative time for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from . import numbering
from .filters import category_filter, since

col = F.col


def story_key() -> Column:
    """Story id, or the article itself. The prefix keeps both id spaces apart."""
    return F.coalesce(F.concat(F.lit("s:"), col("story_id")), F.concat(F.lit("a:"), col("id")))


def recent_accepted(articles: DataFrame, as_of: Column, hours: int = config.FEED_HOURS) -> DataFrame:
    return articles.filter((col("filter_status") == "accepted") & since(col("published_at"), as_of, f"{hours} HOURS"))


def one_per_story(articles: DataFrame) -> DataFrame:
    order = [
        col("llm_tier").asc_nulls_last(), col("api_source_priority").asc_nulls_last(),
        col("published_at").desc(), col("id"),
    ]
    return numbering.top_per_key(articles.withColumn("story_key", story_key()), ["story_key"], order, 1).drop("rank")


def ranking() -> list[Column]:
    return [
        F.coalesce("llm_tier", F.lit("Z")), col("api_source_priority").asc_nulls_last(),
        col("published_at").desc(), col("id"),
    ]


def feed(articles: DataFrame, as_of: Column, category: str | None = None, limit: int = config.FEED_LIMIT) -> DataFrame:
    """Ranked feed rows, ready for display."""
    rows = one_per_story(category_filter(recent_accepted(articles, as_of), category))
    top = rows.orderBy(*ranking()).limit(min(limit, config.FEED_LIMIT_MAX))
    return top.select(*display_columns(as_of), "llm_tier", "api_source_priority", "published_at")


def display_columns(as_of: Column) -> list[Column]:
    return [
        col("id"), F.coalesce("title", F.lit("Untitled")).alias("title"),
        S.parse_bullets(col("summary")).alias("bullets"), col("story_id"),
        F.coalesce("source_name", F.lit("Unknown")).alias("source_name"),
        F.coalesce("llm_category", F.lit("News")).alias("category"),
        S.time_ago(col("published_at"), as_of).alias("time_ago"),
    ]


def summary_picks(articles: DataFrame, as_of: Column, limit: int = config.FEED_LIMIT) -> DataFrame:
    """(pos, id): best unsummarised articles, one per story, by tier then source priority."""
    rows = one_per_story(recent_accepted(articles, as_of).filter(col("summary").isNull()))
    top = rows.orderBy(F.coalesce("llm_tier", F.lit("Z")), col("api_source_priority").asc_nulls_last(), "story_key").limit(limit)
    listed = top.agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("llm_tier", F.lit("Z")).alias("t"), col("api_source_priority").isNull().alias("u"),
        col("api_source_priority").alias("p"), "story_key", "id"))).alias("l"))
    return listed.select(F.posexplode("l.id").alias("pos", "id")).select(col("pos").cast("long").alias("pos"), "id")


def brief_articles(briefs: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Articles of each brief in stored order, defaults where an article is missing."""
    listed = briefs.select("brief_date", F.posexplode("article_ids").alias("pos", "id"))
    return listed.join(articles, "id", "left").select("brief_date", col("pos").cast("long").alias("pos"), *display_columns(as_of))


def latest_brief(briefs: DataFrame, day: Column) -> DataFrame:
    """The brief of the day, else of the day before."""
    shared = briefs.filter(col("user_id").isNull() & col("brief_date").isin(day, F.date_sub(day, 1)))
    return shared.orderBy(col("brief_date").desc()).limit(1)


def card_role() -> Column:
    return F.when(col("pos") == 0, "featured").when(col("pos") == 1, "secondary").otherwise("tertiary")
