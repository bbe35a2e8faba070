"""Quality rules F1..F9 and other row predicates, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config, rules
from ..functions import scalars as S

col = F.col


def non_latin_class() -> str:
    return "[" + "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in rules.NON_LATIN_RANGES) + "]"


def foreign_language(lang: Column) -> Column:
    return F.coalesce(~F.lower(lang).isin("en", "english"), F.lit(False))


def letter_counts(title: Column, description: Column) -> tuple[Column, Column]:
    """Meaningful characters of title and description, and how many are non-Latin."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    letters = F.regexp_replace(text, r"[\s\d\p{P}\p{S}]", "")
    return F.length(letters), F.length(letters) - F.length(F.regexp_replace(letters, non_latin_class(), ""))


def foreign_script(title: Column, description: Column) -> Column:
    total, foreign = letter_counts(title, description)
    share = F.try_divide(foreign.cast("double"), total.cast("double"))
    return (total >= config.NON_LATIN_MIN_CHARS) & F.coalesce(share > config.NON_LATIN_SHARE, F.lit(False))


def stale(published_at: Column, as_of: Column, hours: int = config.STALENESS_HOURS) -> Column:
    return F.coalesce(published_at < as_of - F.expr(f"INTERVAL {hours} HOURS"), F.lit(False))


def title_too_short(title: Column, minimum: int = config.TITLE_MIN_CHARS) -> Column:
    return title.isNull() | (F.length(title) < minimum)


def uppercase_share(title: Column) -> Column:
    letters = F.length(F.regexp_replace(title, r"[^a-zA-Z]", ""))
    upper = F.length(F.regexp_replace(title, r"[^A-Z]", ""))
    return F.try_divide(upper.cast("double"), letters.cast("double"))


def shouting_title(title: Column) -> Column:
    return F.coalesce(uppercase_share(title) > config.UPPERCASE_SHARE, F.lit(False))


def text_too_short(source_api: Column, content: Column, description: Column,
                   minimum: dict[str, int] = config.TEXT_MIN_BY_SOURCE) -> Column:
    floor = F.coalesce(F.try_element_at(S.literal_map(minimum), source_api), F.lit(0))
    return F.coalesce(F.length(F.coalesce(content, description)) < floor, F.lit(False))


def blocked_domain(domain: Column, domains: list[str] | None = None) -> Column:
    """Membership in the fixed list: an in-set test inside the scan stage, no join needed."""
    return F.coalesce(domain.isin(domains or rules.blocked_domains()), F.lit(False))


def rejected_path(url: Column, patterns: list[str] = rules.URL_PATH_PATTERNS) -> Column:
    return F.coalesce(url.rlike(rules.any_of(patterns)), F.lit(False))


def rejected_title(title: Column, patterns: list[tuple] = rules.TITLE_PATTERNS) -> Column:
    plain = [p for p, also, unless in patterns if also is None and unless is None]
    tests = [title.rlike(rules.any_of(plain))] if plain else []
    for p, also, unless in patterns:
        if also is not None:
            tests.append(title.rlike(f"(?i){p}") & title.rlike(f"(?i){also}"))
        elif unless is not None:
            tests.append(title.rlike(f"(?i){p}") & ~title.rlike(f"(?i){unless}"))
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def templated_text(content: Column, description: Column, patterns: list[str] = rules.TEMPLATE_PATTERNS) -> Column:
    return F.coalesce(F.coalesce(content, description).rlike(rules.any_of(patterns)), F.lit(False))


def rejection_rule(as_of: Column) -> Column:
    """First rule an article breaks, cheap rules in the reference order; null when it passes."""
    return (
        F.when(foreign_language(col("api_language")), "language")
        .when(foreign_script(col("title"), col("description")), "language")
        .when(stale(col("published_at"), as_of), "staleness")
        .when(title_too_short(col("title")) | shouting_title(col("title"))
              | text_too_short(col("source_api"), col("content"), col("description")), "content_min")
        .when(blocked_domain(col("source_domain")), "domain_blocklist")
        .when(rejected_path(col("url")), "url_path")
        .when(rejected_title(col("title")), "title_pattern")
        .when(templated_text(col("content"), col("description")), "template")
    )


def with_rule(articles: DataFrame, as_of: Column) -> DataFrame:
    return articles.withColumn("rule", rejection_rule(as_of))


def split_by_rule(ruled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passed rows, and rejections in the shape of the rejection log."""
    return ruled.filter(col("rule").isNull()).drop("rule"), rejections(ruled.filter(col("rule").isNotNull()))


def rejections(ruled: DataFrame, stage: str = "filter", *keep: str) -> DataFrame:
    return ruled.select(
        *keep, "url", "title", "source_api", "source_domain", F.lit(stage).alias("rejection_stage"),
        col("rule").alias("rejection_rule"),
        S.context_len(col("description"), col("content")).alias("context_len"),
    )


def low_relevance(score: Column, minimum: float = config.RELEVANCE_MIN) -> Column:
    return F.coalesce(score < minimum, F.lit(False))


def low_authority(priority: Column, maximum: int = config.SOURCE_PRIORITY_MAX) -> Column:
    return F.coalesce(priority > maximum, F.lit(False))


def newsdata_guard(published_at: Column, content: Column, as_of: Column) -> Column:
    """Keep: recent, and either no content or at least the floor."""
    short = (content != "") & (F.length(content) < config.NEWSDATA_TEXT_FLOOR)
    return ~stale(published_at, as_of) & ~F.coalesce(short, F.lit(False))


def has_required(url: Column, title: Column) -> Column:
    return (F.coalesce(url, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != "")


def filter_status(tier: Column) -> Column:
    return F.when(tier.isin(*config.ACCEPTED_TIERS), "accepted").otherwise("rejected")


def since(ts: Column, as_of: Column, interval: str) -> Column:
    """``ts`` at or after ``as_of`` minus an interval such as ``14 DAYS``; a plain range
    predicate, so it reaches the scan and prunes day partitions."""
    return ts >= as_of - F.expr(f"INTERVAL {interval}")


def category_filter(df: DataFrame, category: str | None) -> DataFrame:
    """An unknown category means no filter."""
    return df.filter(col("llm_category") == category) if category in config.FEED_CATEGORIES else df
