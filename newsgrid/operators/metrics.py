"""Daily metrics over articles, rejections and runs; all days in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config

col = F.col

ARTICLE_METRICS = [
    "total_accepted", "total_rejected_llm", "tier_a_count", "tier_b_count", "tier_c_count", "tier_d_count",
    "economics_count", "policy_count", "science_count", "accountability_count", "business_count",
]
_RULE_METRICS = {
    "filtered_language": "language",
    "filtered_stale": "staleness",
    "filtered_content_min": "content_min",
    "filtered_domain": "domain_blocklist",
    "filtered_url_path": "url_path",
    "filtered_title_pat": "title_pattern",
    "filtered_template": "template",
}
REJECTION_METRICS = [*_RULE_METRICS, "filtered_dedup", "total_filtered"]
RUN_METRICS = ["total_fetched", "total_to_llm", "llm_requests_used", "llm_errors"]


def _by_day(df: DataFrame, ts: str, day: Column | None):
    """Rows of a day end at 23:59:59 sharp. One given day becomes a plain time range."""
    if day is not None:
        start = day.cast("timestamp")
        df = df.filter((col(ts) >= start) & (col(ts) <= start + F.expr("INTERVAL 86399 SECONDS")))
    date = F.to_date(ts)
    return df.filter(col(ts) <= date.cast("timestamp") + F.expr("INTERVAL 86399 SECONDS")).groupBy(date.alias("date"))


def article_stats(articles: DataFrame, day: Column | None = None) -> DataFrame:
    status, tier, cat = col("filter_status"), col("llm_tier"), col("llm_category")
    return _by_day(articles.filter(status.isin("accepted", "rejected")), "created_at", day).agg(
        F.count_if(status == "accepted").alias("total_accepted"),
        F.count_if(status == "rejected").alias("total_rejected_llm"),
        *[F.count_if(tier == t).alias(f"tier_{t.lower()}_count") for t in config.TIERS],
        *[F.count_if((status == "accepted") & (cat == c)).alias(f"{c}_count") for c in config.FEED_CATEGORIES],
    )


def rejection_stats(log: DataFrame, day: Column | None = None) -> DataFrame:
    rule = col("rejection_rule")
    return _by_day(log, "created_at", day).agg(
        *[F.count_if(rule == value).alias(name) for name, value in _RULE_METRICS.items()],
        F.count_if(rule.startswith("dedup")).alias("filtered_dedup"),
        F.count(F.lit(1)).alias("total_filtered"),
    )


def run_stats(runs: DataFrame, day: Column | None = None) -> DataFrame:
    return _by_day(runs, "started_at", day).agg(
        F.coalesce(F.sum("articles_fetched"), F.lit(0)).alias("total_fetched"),
        F.coalesce(F.sum("articles_classified"), F.lit(0)).alias("total_to_llm"),
        F.coalesce(F.sum(F.when(col("status") == "success", col("articles_classified"))), F.lit(0)).alias("llm_requests_used"),
        F.count_if(col("status") == "failed").alias("llm_errors"),
    )


def daily_metrics(articles: DataFrame, log: DataFrame, runs: DataFrame, day: Column | None = None) -> DataFrame:
    """One row per date with rows in any of the three tables."""
    parts = article_stats(articles, day).join(rejection_stats(log, day), "date", "full").join(run_stats(runs, day), "date", "full")
    names = [*ARTICLE_METRICS, *REJECTION_METRICS, *RUN_METRICS]
    return parts.select("date", *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
                        F.coalesce("filtered_dedup", F.lit(0)).alias("total_deduplicated"))


def failing_domains(articles: DataFrame, as_of: Column, hours: int = config.COOLDOWN_HOURS,
                    failures: int = config.COOLDOWN_FAILURES) -> DataFrame:
    recent = articles.filter((col("scrape_status") == "failed") & (col("fetched_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS")))
    return recent.groupBy("source_domain").agg(F.count(F.lit(1)).alias("failures")).filter(col("failures") >= failures)


def without_cooldown(articles: DataFrame, failing: DataFrame) -> DataFrame:
    """Articles whose domain is not cooling down; null domains stay."""
    return articles.join(failing.filter(col("source_domain") != "").select("source_domain"), "source_domain", "left_anti")


def status_counts(articles: DataFrame) -> DataFrame:
    return articles.groupBy("scrape_status").agg(F.count(F.lit(1)).alias("n"))


def run_counters(ruled: DataFrame, first_of_url: DataFrame) -> DataFrame:
    """One row of counters of a run: fetched, filtered, deduped, classified, stored. ``ruled`` has (id, rule, llm_tier), ``first_of_url``
    (id, first_of_url) for the rows that passed the rules and the source's own flag."""
    rows = ruled.join(first_of_url.select("id", "first_of_url"), "id", "left")
    survived = F.coalesce("first_of_url", F.lit(False))
    return rows.agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if(F.col("rule").isNotNull()).alias("filtered"), F.count_if(F.col("rule").isNull() & ~survived).alias("deduped"),
        F.count_if(survived).alias("classified"), F.count_if(survived & F.col("llm_tier").isin("A", "B")).alias("stored"))
