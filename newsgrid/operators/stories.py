"""Story-level aggregates: majority values, keywords, centroids, importance, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..functions import vectors as V
from . import numbering

col = F.col
#: Registers of a sketch of distinct values as a power of two, and three times its relative standard error, 1.04 / sqrt(registers).
SKETCH_BITS = 12
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)
#: Places of keywords from one article of a story to the next.
PLACES = 100


def source_counts(articles: DataFrame) -> DataFrame:
    return articles.filter(col("story_id").isNotNull()).groupBy("story_id").agg(
        F.countDistinct("source_name").alias("source_count")
    )


def source_sketches(articles: DataFrame, *keys: str, bits: int = SKETCH_BITS) -> DataFrame:
    """(story_id, day, keys..., sources): one sketch of the distinct sources for each story and day. Sketches are small whatever the number of
    articles, can be stored, and days that are known need not be read again."""
    return articles.filter(col("story_id").isNotNull()).groupBy("story_id", "day", *keys).agg(F.hll_sketch_agg("source_name", bits).alias("sources"))


def source_estimates(sketches: DataFrame) -> DataFrame:
    """(story_id, source_estimate): the sketches of all days merged. The relative standard error is SKETCH_ERROR / 3; a story whose sources are
    all null has none."""
    return sketches.groupBy("story_id").agg(F.hll_sketch_estimate(F.hll_union_agg("sources")).alias("source_estimate"))


def majority(articles: DataFrame, value: str, where: Column | None = None) -> DataFrame:
    """Most frequent non-null value per story, ties to the smaller value. Counts are reduced
    map-side, so only (story, value) pairs meet."""
    kept = articles.filter(col("story_id").isNotNull() & col(value).isNotNull())
    if where is not None:
        kept = kept.filter(where)
    counts = kept.groupBy("story_id", value).agg(F.count(F.lit(1)).alias("n"))
    return (
        numbering.top_per_key(counts, ["story_id"], [col("n").desc(), col(value)], 1)
        .select("story_id", value)
    )


def story_keywords(articles: DataFrame, limit: int = 20) -> DataFrame:
    """(story_id, keyword_set). Up to two articles: the keywords of the most important one.
    Three to five: the union in order of importance. From six on: keywords that occur at
    least twice, most frequent first.

    The place of a keyword is the number of its article times PLACES plus its position there, so what stands beyond the first PLACES keywords of an
    article comes among those of the next ones; at equal places the earlier article goes first. Articles are numbered in ranges of their order. The six
    most important ones per story tell the size class and serve the small stories; lists never hold more. Larger stories are counted per (story, keyword)."""
    none = F.array().cast("array<string>")
    low = -F.coalesce("importance_score", F.lit(0.0))
    rows = articles.filter(col("story_id").isNotNull()).select(
        "story_id", "id", F.coalesce("api_keywords", none).alias("kws"), low.alias("low"),
        col("importance_score").isNull().alias("missing"))
    rows = numbering.ordered_number(rows, [col("missing"), col("low"), col("id")], "rank", ["story_id"])
    first = rows.filter(col("rank") <= 6)
    lists = first.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "kws"))).alias("l"))
    best = F.array_min(F.transform("l", lambda x: F.struct(x["low"], x["rank"], x["kws"])))
    n = F.size("l")
    placed = F.sort_array(F.flatten(F.transform("l", lambda x: F.transform(x["kws"], lambda kw, pos: F.struct(
        _place(x["rank"], pos).alias("place"), x["rank"].alias("rank"), kw.alias("kw"))))))
    small = F.when(n <= 2, best["kws"]).otherwise(F.array_distinct(F.transform(placed, lambda x: x["kw"])))
    lists = lists.select("story_id", (n > 5).alias("large"), F.when(n <= 5, F.slice(small, 1, limit)).alias("small"))

    counts = (
        rows.select("story_id", "rank", F.posexplode("kws").alias("pos", "kw"))
        .groupBy("story_id", "kw").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(_place(col("rank"), col("pos")).alias("place"), "rank")).alias("first"))
        .filter(col("c") >= 2)
    )
    top = numbering.top_per_key(counts, ["story_id"], [col("c").desc(), col("first")], limit)
    many = top.groupBy("story_id").agg(F.sort_array(F.collect_list(F.struct("rank", "kw"))).alias("l")).select(
        "story_id", col("l.kw").alias("frequent"))
    return lists.join(many, "story_id", "left").select(
        "story_id", F.when(col("large"), F.coalesce("frequent", none)).otherwise(col("small")).alias("keyword_set"))


def _place(rank: Column, pos: Column) -> Column:
    return rank * PLACES + pos + 1


def group_centroids(articles: DataFrame, key: str = "story_id") -> DataFrame:
    """Mean vector and number of vectors per group."""
    rows = articles.filter(col(key).isNotNull() & col("embedding").isNotNull())
    return rows.groupBy(key).agg(V.vector_mean(col("embedding")).alias("centroid"), F.count(F.lit(1)).alias("n"))


def merge_centroids(stories: DataFrame, added: DataFrame) -> DataFrame:
    """Stories (id, centroid, article_count) after new articles (story_id, embedding) joined
    them. One weighted mean equals the chain of single updates."""
    sums = added.filter(col("embedding").isNotNull()).groupBy(col("story_id").alias("id")).agg(
        V.vector_sum(col("embedding")).alias("_sum"), F.count(F.lit(1)).alias("_k")
    )
    k = F.coalesce("_k", F.lit(0))
    return stories.join(sums, "id", "left").withColumns({
        "centroid": V.weighted_centroid(col("centroid"), col("article_count"), col("_sum"), col("_k")),
        "article_count": col("article_count") + k,
    }).drop("_sum", "_k")


def latest_embedded(articles: DataFrame) -> DataFrame:
    """(story_id, representative_article_id, canonical_embedding) of the newest embedded article."""
    rows = articles.filter(col("story_id").isNotNull() & col("embedding").isNotNull())
    newest = numbering.top_per_key(rows, ["story_id"], [col("published_at").desc(), col("id")], 1)
    return newest.select("story_id", col("id").alias("representative_article_id"), col("embedding").alias("canonical_embedding"))


def recounted(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """Article counts of embedded members, changed only where at least one remains."""
    n = articles.filter(col("story_id").isNotNull() & col("embedding").isNotNull()).groupBy(
        col("story_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    return stories.join(n, "id", "left").withColumn("article_count", F.coalesce("_n", "article_count")).drop("_n")


# ---- importance -------------------------------------------------------------------------

def representative_score(as_of: Column) -> Column:
    priority = F.coalesce(col("api_source_priority"), F.lit(1))
    age = S.hours_between(as_of, col("published_at"))
    depth = F.least(S.chars(col("full_text")), F.lit(3000)) / F.lit(3000.0)
    return S.source_quality(priority, 0) * 0.5 + S.age_step(age) * 0.3 + depth * 0.2


def article_signals(articles: DataFrame, as_of: Column) -> DataFrame:
    """Everything the story score needs, in one aggregation over all stories."""
    priority = F.coalesce(col("api_source_priority"), F.lit(1))
    n = F.count(F.lit(1))
    return articles.filter(col("story_id").isNotNull()).groupBy("story_id").agg(
        F.min(F.when(priority > 0, priority)).alias("best_priority"),
        F.countDistinct(F.coalesce(col("source_domain"), F.lit(""))).alias("domains"),
        F.count_if(S.hours_between(as_of, col("published_at")) < 6).alias("recent"),
        (F.sum(S.chars(col("description"))) / n).alias("avg_desc"),
        (F.count_if(col("scrape_status") == "full") / n).alias("scrape_rate"),
        F.max(F.struct(representative_score(as_of).alias("s"), (-col("id")).alias("neg"))).alias("rep"),
    )


def importance(as_of: Column) -> Column:
    """Weighted story score over the columns of :func:`article_signals` and the story row;
    null for a story without articles."""
    quality = S.source_quality(F.coalesce("best_priority", F.lit(1)), 1) * S.corroboration_bonus(col("domains"))
    content = (
        F.least(col("avg_desc") / 400, F.lit(1.0)) * 0.5 + col("scrape_rate") * 0.3
        + F.when(col("avg_desc") > 100, 0.2).otherwise(0.0)
    )
    return (
        0.24 * S.coverage_score(F.coalesce("source_count", F.lit(0)))
        + 0.18 * quality
        + 0.10 * S.momentum_score(col("recent"))
        + 0.08 * S.freshness_score(S.hours_between(as_of, col("last_updated_at")))
        + 0.08 * S.category_weight(col("llm_category"))
        + 0.15
        + 0.17 * content
    )


def score_stories(stories: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """Active stories with ``importance_score`` and ``representative_article_id``."""
    return scored(stories, article_signals(articles, as_of), as_of)


def scored(stories: DataFrame, signals: DataFrame, as_of: Column) -> DataFrame:
    """Active stories with the scores that follow from the signals of their articles."""
    active = stories.filter(col("status") == "active").drop("importance_score", "representative_article_id")
    return active.join(signals.withColumnRenamed("story_id", "id"), "id", "left").withColumns({
        "importance_score": importance(as_of),
        "representative_article_id": -col("rep.neg"),
    }).drop("best_priority", "domains", "recent", "avg_desc", "scrape_rate", "rep")


def refresh_metadata(stories: DataFrame, articles: DataFrame, affected: DataFrame, as_of: Column) -> DataFrame:
    """Keywords, source count, majority region and category, newest vector of the affected
    stories (id); the other stories stay as they are."""
    mine = articles.join(affected.select(col("id").alias("story_id")), "story_id", "left_semi")
    new = affected.select("id").distinct()
    for frame, names in (
        (story_keywords(mine), ["keyword_set"]),
        (source_counts(mine), ["source_count"]),
        (majority(mine, "main_genre"), ["main_genre"]),
        (majority(mine, "llm_category", col("filter_status") == "accepted"), ["llm_category"]),
        (latest_embedded(mine), ["representative_article_id", "canonical_embedding"]),
    ):
        part = frame.select(col("story_id").alias("id"), *[col(n).alias(f"_{n}") for n in names])
        new = new.join(part, "id", "left")
    joined = stories.join(new.withColumn("_hit", F.lit(True)), "id", "left")
    hit = F.coalesce(col("_hit"), F.lit(False))
    keep_old = {"representative_article_id", "canonical_embedding", "keyword_set"}
    changes = {}
    for n in ("keyword_set", "source_count", "main_genre", "llm_category", "representative_article_id", "canonical_embedding"):
        fresh = F.coalesce(col(f"_{n}"), col(n)) if n in keep_old else col(f"_{n}")
        if n == "source_count":
            fresh = F.coalesce(col("_source_count"), F.lit(0))
        changes[n] = F.when(hit, fresh).otherwise(col(n))
    changes["last_updated_at"] = F.when(hit, as_of).otherwise(col("last_updated_at"))
    return joined.withColumns(changes).select(*stories.columns)


def story_pages(stories: DataFrame, articles: DataFrame) -> DataFrame:
    """(story_id, article_count, id, title, pos): the articles of every story, newest first. Positions come from
    counts of days and numbers inside a day, so no story is sorted in one task."""
    rows = articles.filter("story_id IS NOT NULL").select(
        "id", "title", "story_id", (F.lit(4102444800) - F.unix_timestamp("published_at")).alias("age"))
    rows = rows.withColumn("day", F.floor(col("age") / 86400))
    sizes = rows.groupBy("story_id", "day").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("story_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = W.partitionBy("story_id", "day").orderBy("age", "id")
    numbered = rows.join(offsets, ["story_id", "day"]).withColumn("pos", F.row_number().over(within) + col("before"))
    return numbered.join(stories.select(col("id").alias("story_id"), "article_count"), "story_id").select(
        "story_id", "article_count", "id", "title", "pos")


def unmatched(articles: DataFrame, stories: DataFrame) -> DataFrame:
    """(id) of articles that no active story holds."""
    active = stories.filter("status = 'active'").select(col("id").alias("story_id"))
    matched = articles.join(active, "story_id", "left_semi").select("id")
    return articles.select("id").join(matched, "id", "left_anti")


def affected(matched: DataFrame, new: DataFrame) -> DataFrame:
    """(story_id): stories that a run has matched or made, each once."""
    return matched.select("story_id").filter("story_id IS NOT NULL").unionByName(new.select("story_id")).distinct()
