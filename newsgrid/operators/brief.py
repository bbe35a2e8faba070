"""Daily brief: candidates, score, constrained selection."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from . import numbering

col = F.col


def candidates(articles: DataFrame, stories: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Accepted articles (of the given ids) with the importance and size of their story."""
    rows = articles.filter(col("filter_status") == "accepted")
    if ids is not None:
        rows = rows.join(ids.select("id"), "id", "left_semi")
    side = stories.select(
        col("id").alias("story_id"), col("importance_score").alias("story_importance"),
        col("article_count").alias("story_article_count"),
    )
    return rows.select(
        "id", "title", "published_at", "source_name", "source_domain", "llm_category", "llm_tier",
        "main_genre", "api_source_priority", "description", "scrape_status", "story_id",
    ).join(side, "story_id", "left")


def candidate_score() -> Column:
    quality = S.source_quality(F.coalesce("api_source_priority", F.lit(1)), 1, clamp=True)
    depth = F.when(col("scrape_status") == "full", 0.2).otherwise(0.0)
    content = F.least(F.least(S.chars(col("description")) / F.lit(400.0), F.lit(1.0)) + depth, F.lit(1.0))
    bonus = F.coalesce(
        F.try_element_at(S.literal_map(config.TIER_BONUS), F.coalesce("llm_tier", F.lit("B"))), F.lit(0.0))
    return (
        0.30 * quality + 0.20 * S.category_weight(col("llm_category")) + 0.15 * content
        + 0.25 * F.coalesce("story_importance", F.lit(0.0)) + bonus
    )


def reduce_candidates(scored: DataFrame, slots: int = config.BRIEF_SLOTS) -> DataFrame:
    """Rows the selection can depend on: the best of each story per (category, region), then
    the best ``slots`` per (category, region). Both cuts are applied map-side, so the rest of
    the selection runs on slots x categories x regions rows whatever the input size."""
    keyed = scored.select(
        "id", "story_id", "score",
        F.coalesce("llm_category", F.lit("none")).alias("category"),
        F.coalesce("main_genre", F.lit("global")).alias("region"),
        F.coalesce(F.concat(F.lit("s:"), col("story_id")), F.concat(F.lit("a:"), col("id"))).alias("skey"),
    )
    order = [col("score").desc(), col("id")]
    best = numbering.top_per_key(keyed, ["skey", "category", "region"], order, 1).drop("rank")
    return numbering.top_per_key(best, ["category", "region"], order, slots).drop("rank")


def select_brief(scored: DataFrame, slots: int = config.BRIEF_SLOTS, per_category: int = config.BRIEF_PER_CATEGORY,
                 per_region: int = config.BRIEF_PER_REGION) -> DataFrame:
    """(pos, id, story_id, score): pass one in score order with one article per story and caps
    per category and region, pass two fills the remaining slots without the caps."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        ranked = pdf.sort_values(["score", "id"], ascending=[False, True]).to_dict("records")
        chosen, taken = [], set()
        used: dict[tuple[str, str], int] = {}
        for capped in (True, False):
            for row in ranked:
                if len(chosen) == slots:
                    break
                if row["skey"] in taken:
                    continue
                cat, reg = ("c", row["category"]), ("r", row["region"])
                if capped and (used.get(cat, 0) >= per_category or used.get(reg, 0) >= per_region):
                    continue
                taken.add(row["skey"])
                used[cat], used[reg] = used.get(cat, 0) + 1, used.get(reg, 0) + 1
                chosen.append(row)
        out = pd.DataFrame(chosen, columns=["id", "story_id", "score"])
        out["story_id"] = out["story_id"].astype("Int64")
        out.insert(0, "pos", range(len(out)))
        return out

    reduced = reduce_candidates(scored, slots)
    return reduced.withColumn("brief", F.lit(0)).groupBy("brief").applyInPandas(choose, "pos long, id long, story_id long, score double")


def brief_row(selection: DataFrame, brief_date: Column) -> DataFrame:
    """One brief row: article ids in selection order and their distinct stories."""
    rows = selection.agg(F.sort_array(F.collect_list(F.struct("pos", "id", "story_id"))).alias("l"))
    stories = F.array_sort(F.array_distinct(F.filter(col("l.story_id"), lambda s: s.isNotNull())))
    return rows.select(brief_date.alias("brief_date"), col("l.id").alias("article_ids"), stories.alias("story_ids"),
                       F.lit(None).cast("long").alias("user_id"))


def brief_stories(articles: DataFrame, picks: DataFrame) -> DataFrame:
    """Distinct stories of the picked articles."""
    return articles.join(picks.select("id"), "id", "left_semi").filter(col("story_id").isNotNull()).select("story_id").distinct()


def ordered_union(first: DataFrame, second: DataFrame, order: str = "pos") -> DataFrame:
    """Distinct ids, those of ``first`` before those of ``second``, each in its own order."""
    both = first.select("id", F.lit(0).alias("part"), col(order).alias("pos")).unionByName(
        second.select("id", F.lit(1).alias("part"), col(order).alias("pos")))
    return both.groupBy("id").agg(F.min(F.struct("part", "pos")).alias("m")).select("id", "m.part", "m.pos")
