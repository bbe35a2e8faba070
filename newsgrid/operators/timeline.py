"""Story timelines: daily candidates, near-duplicate removal, follow feeds, chat context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config, rules
from ..functions import scalars as S
from . import numbering
from .filters import since

col = F.col


def daily_candidates(articles: DataFrame, as_of: Column, days: int = config.TIMELINE_DAYS,
                     per_day: int = config.TIMELINE_CANDIDATES_PER_DAY) -> DataFrame:
    """The best ``per_day`` articles per story and UTC day inside the window."""
    rows = articles.filter(col("story_id").isNotNull() & since(col("published_at"), as_of, f"{days} DAYS"))
    return numbering.top_per_key(
        rows.withColumn("day", F.to_date("published_at")), ["story_id", "day"],
        [col("importance_score").desc_nulls_last(), col("published_at").desc(), col("id")], per_day, "day_rank",
    )


def select_timeline(candidates: DataFrame, pins: DataFrame | None = None, per_day: int = config.TIMELINE_PER_DAY,
                    duplicate: float = config.TIMELINE_DUP_SIMILARITY) -> DataFrame:
    """(story_id, id, pos): newest first, at most ``per_day`` per day, without articles close
    to one already kept. ``pins`` (story_id, pinned_id) are taken first when they are among the
    candidates. A group is one story's candidates: days x candidates per day rows at most."""
    rows = candidates.select("story_id", "id", "published_at", "day", "embedding")
    if pins is not None:
        rows = rows.join(pins, "story_id", "left")
    else:
        rows = rows.withColumn("pinned_id", F.lit(None).cast("long"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(pin=(pdf["id"] == pdf["pinned_id"]).fillna(False))
        walk = pdf.sort_values(["pin", "published_at", "id"], ascending=[False, False, True])
        per: dict = {}
        kept, units = [], []
        for row in walk.itertuples():
            unit = None
            if row.embedding is not None:
                v = np.asarray(row.embedding, dtype=float)
                norm = np.sqrt((v * v).sum())
                unit = v / norm if norm > 0 else v
            if not row.pin:
                if per.get(row.day, 0) >= per_day:
                    continue
                if unit is not None and any(float(unit @ u) >= duplicate for u in units):
                    continue
            per[row.day] = per.get(row.day, 0) + 1
            if unit is not None:
                units.append(unit)
            kept.append((row.story_id, row.id, row.published_at))
        out = pd.DataFrame(kept, columns=["story_id", "id", "published_at"])
        out = out.sort_values("published_at", ascending=False, kind="stable", ignore_index=True)
        return pd.DataFrame({"story_id": out["story_id"], "id": out["id"], "pos": out.index})

    return rows.groupBy("story_id").applyInPandas(choose, "story_id long, id long, pos long")


def story_timelines(articles: DataFrame, as_of: Column, pins: DataFrame | None = None, **options) -> DataFrame:
    """Timelines of all stories in one job."""
    chosen = select_timeline(daily_candidates(articles, as_of), pins, **options)
    shown = articles.select("id", "title", "url", "published_at", "source_name", "summary", "llm_category")
    return chosen.join(shown, "id")


def followed_stories(follows: DataFrame, stories: DataFrame) -> DataFrame:
    side = stories.select(
        col("id").alias("story_id"), col("title").alias("story_title"), "article_count", "last_updated_at", "llm_category")
    return follows.filter(col("user_id").isNull()).join(side, "story_id")


def is_new(last_seen: Column, published: Column) -> Column:
    return last_seen.isNull() | (published > last_seen)


def follow_updates(follows: DataFrame, stories: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """One row per followed story with its timeline (at most two rows per day) as an array,
    the number of unseen entries, and the newest title where the story has none."""
    followed = followed_stories(follows, stories)
    mine = articles.join(followed.select("story_id"), "story_id", "left_semi")
    line = story_timelines(mine, as_of)
    entry = F.struct("pos", "id", "title", "url", "published_at", "source_name", "summary", "llm_category")
    lists = line.join(followed.select("story_id", "last_seen_at"), "story_id").groupBy("story_id").agg(
        F.sort_array(F.collect_list(entry)).alias("articles"),
        F.count_if(is_new(col("last_seen_at"), col("published_at"))).alias("new_since_last_seen"),
    )
    return followed.join(lists, "story_id", "left").select(
        "story_id",
        F.coalesce(S.blank_to_null(S.trim_ws(col("story_title"))), F.get(col("articles.title"), F.lit(0)), F.lit("Untitled Story")).alias("story_title"),
        F.coalesce("llm_category", F.lit("news")).alias("story_category"), "followed_at",
        F.coalesce("article_count", F.lit(0)).alias("article_count"), "last_updated_at",
        F.coalesce("new_since_last_seen", F.lit(0)).alias("new_since_last_seen"), "articles",
    )


def day_groups(timeline: DataFrame) -> DataFrame:
    """Consecutive entries of a timeline under one day label, in timeline order."""
    labelled = timeline.withColumn("label", S.day_label(col("published_at")))
    order = W.partitionBy("story_id").orderBy("pos")
    starts = labelled.withColumn("start", (F.lag("label").over(order).eqNullSafe(col("label")) == F.lit(False)).cast("int"))
    grouped = starts.withColumn("group_no", F.sum("start").over(order) - 1)
    return grouped.groupBy("story_id", "group_no", "label").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("items"))


# ---- chat -------------------------------------------------------------------------------

def context_text() -> Column:
    return F.coalesce(*[S.blank_to_null(col(c)) for c in ("full_text", "content", "description")], F.lit(""))


def _titled(text: Column) -> Column:
    """Title, date and text of an article in the context."""
    before, after = map(F.lit, rules.CONTEXT_DATE)
    return F.concat(col("title"), before, S.short_date(col("published_at")), after, text)


def current_articles(articles: DataFrame) -> DataFrame:
    """(story_id, article_id): the newest article of every story, of several of that time the smallest id."""
    newest = F.when(col("published_at").isNotNull(), F.struct("published_at", -col("id")))
    return articles.filter(col("story_id").isNotNull()).groupBy("story_id").agg(F.max_by("id", newest).alias("article_id"))


def chat_context(timeline: DataFrame, current: DataFrame, articles: DataFrame,
                 current_chars: int = config.CHAT_CURRENT_CHARS, shared_chars: int = config.CHAT_SHARED_CHARS) -> DataFrame:
    """(story_id, article_id, context): text of the current article, then the other timeline
    entries, numbered from two, sharing a fixed number of characters evenly."""
    texts = articles.select("id", "title", "published_at", context_text().alias("text"))
    heads = current.select("story_id", "article_id").join(texts.withColumnRenamed("id", "article_id"), "article_id").select(
        "story_id", "article_id",
        F.concat(F.lit(rules.CONTEXT_CURRENT), _titled(F.substring("text", 1, current_chars))).alias("head"),
    )
    others = timeline.select("story_id", "id", "pos").join(current.select("story_id", "article_id"), "story_id").filter(
        col("id") != col("article_id"))
    story = W.partitionBy("story_id", "article_id")
    others = others.withColumns({
        "share": F.floor(F.lit(shared_chars) / F.count(F.lit(1)).over(story)).cast("int"),
        "no": F.row_number().over(story.orderBy("pos")) + 1,
    }).join(texts, "id")
    before, after = map(F.lit, rules.CONTEXT_OTHER)
    snippet = F.concat(before, col("no").cast("string"), after, _titled(F.substring(col("text"), F.lit(1), col("share"))))
    tails = others.select("story_id", "article_id", "no", snippet.alias("snippet")).groupBy("story_id", "article_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "snippet"))), lambda x: x["snippet"]), "\n\n").alias("tail"))
    return heads.join(tails, ["story_id", "article_id"], "left").select(
        "story_id", "article_id", F.concat_ws("\n\n", "head", "tail").alias("context"))


def chat_history(messages: DataFrame, keep: int = config.CHAT_HISTORY) -> DataFrame:
    """The last user and assistant messages per conversation, oldest first."""
    valid = messages.filter(col("role").isin("user", "assistant") & col("text").isNotNull())
    last = numbering.top_per_key(valid, ["conv_id"], [col("turn").desc()], keep, "back")
    order = W.partitionBy("conv_id").orderBy("turn")
    return last.withColumn("pos", F.row_number().over(order) - 1).drop("back")


def followed_flags(stories: DataFrame, follows: DataFrame) -> DataFrame:
    """(id, followed) of every story: is it followed without a user?"""
    mine = follows.filter("user_id IS NULL").select(col("story_id").alias("id"), F.lit(True).alias("followed")).distinct()
    return stories.select("id").join(mine, "id", "left").select("id", F.coalesce("followed", F.lit(False)).alias("followed"))
