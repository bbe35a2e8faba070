"""Column functions on strings, dates, numbers and arrays. All stay in the JVM."""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config, rules

#: Zone names that are accepted; the others in the zone files name no place, or the JVM does not know them.
KNOWN_ZONES = sorted(available_timezones() - {"Factory", "localtime", "posixrules", "ROC", "GMT+0", "GMT-0"})


def trim_ws(c: Column) -> Column:
    """Trim all ASCII white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def chars(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0)).cast("long")


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


# ---- urls -------------------------------------------------------------------------------

def host(url: Column) -> Column:
    """Lower-case host without ``www.``; null when the url cannot be parsed."""
    return F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")


def extract_domain(url: Column) -> Column:
    return F.coalesce(host(url), F.lit(""))


def normalize_url(url: Column) -> Column:
    path = F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), r"/+$", "")
    return F.coalesce(F.concat(F.lit("https://"), host(url), F.coalesce(path, F.lit(""))), F.lower(url))


def url_hash(url: Column) -> Column:
    return F.sha2(normalize_url(url), 256)


# ---- titles -----------------------------------------------------------------------------

def normalize_title(title: Column) -> Column:
    collapsed = F.regexp_replace(trim_ws(F.lower(title)), r"\s+", " ")
    return F.regexp_replace(collapsed, r"[^a-z0-9\s]", "")


def title_hash(title: Column) -> Column:
    return F.sha2(normalize_title(title), 256)


def domain_title_hash(domain: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lower(domain), F.substring(normalize_title(title), 1, 50)), 256)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trigrams(title: Column) -> Column:
    """Distinct character trigrams of the lower-cased text; empty below three characters."""

    def grams(low: Column) -> Column:
        n = F.length(low)
        parts = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(low, i, F.lit(3)))
        return F.when(n >= 3, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))

    return let(F.lower(title), grams)


def packed_trigrams(title: Column) -> Column:
    """The same trigrams as longs: three code points of 21 bits each, so equality is exact
    and comparisons stay on primitive values."""

    def pack(points: Column, i: Column) -> Column:
        a, b, c = (F.element_at(points, i + k) for k in range(3))
        return F.shiftleft(a, 42).bitwiseOR(F.shiftleft(b, 21)).bitwiseOR(c)

    def grams(points: Column) -> Column:
        n = F.size(points)
        parts = F.transform(F.sequence(F.lit(1), n - 2), lambda i: pack(points, i))
        return F.when(n >= 3, F.array_distinct(parts)).otherwise(F.array().cast("array<bigint>"))

    letters = F.regexp_extract_all(F.lower(title), F.lit("(?s)."), 0)  # by code point: pairs of code units stay together
    return let(F.transform(letters, lambda ch: F.ascii(ch).cast("long")), grams)


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; null when both are empty."""
    return let(
        F.size(F.array_intersect(a, b)),
        lambda common: F.try_divide(common.cast("double"), (F.size(a) + F.size(b) - common).cast("double")),
    )


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(packed_trigrams(a), packed_trigrams(b))


# ---- text -------------------------------------------------------------------------------

def strip_null_chars(c: Column, dtype: T.DataType | None = None) -> Column:
    """Remove U+0000 from a string, or from every string inside an array or struct."""
    if dtype is None or isinstance(dtype, T.StringType):
        return F.replace(c, F.lit("\u0000"), F.lit(""))
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: strip_null_chars(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        parts = [strip_null_chars(c[f.name], f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    return c


def strip_boilerplate(text: Column, patterns: list[str] = rules.BOILERPLATE_PATTERNS) -> Column:
    """Drop boilerplate lines, keep blank ones, at most one blank line in a row."""
    pattern = rules.any_of(patterns)

    def keep(line: Column) -> Column:
        bare = trim_ws(line)
        return (bare == "") | ~bare.rlike(pattern)

    kept = F.array_join(F.filter(F.split(text, "\n"), keep), "\n")
    return trim_ws(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def strip_tags(text: Column) -> Column:
    return trim_ws(F.regexp_replace(text, r"<[^>]+>", ""))


def repair_text(text: Column) -> Column:
    """Collapse white space and separate words that were glued together by removed markup."""
    flat = trim_ws(F.regexp_replace(text, r"\s+", " "))
    split_words = F.regexp_replace(flat, r"([a-z])([A-Z][a-z])", "$1 $2")
    return F.regexp_replace(split_words, r"([a-zA-Z])([,;])([A-Z])", "$1$2 $3")


def parse_bullets(summary: Column) -> Column:
    lines = F.filter(F.transform(F.split(summary, "\n"), trim_ws), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^[•\-*]\s*", ""))
    return F.coalesce(F.filter(bare, lambda x: x != ""), F.array().cast("array<string>"))


def split_keywords(raw: Column) -> Column:
    parts = F.filter(F.transform(F.split(raw, ","), trim_ws), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def is_gated(c: Column) -> Column:
    return F.coalesce(F.contains(c, F.lit(rules.GATED_MARKER)), F.lit(False))


def gated_to_null(c: Column) -> Column:
    return F.when(~is_gated(c), c)


def clean_keywords(kws: Column) -> Column:
    keep = F.filter(
        kws,
        lambda k: k.isNotNull() & (k != "") & ~is_gated(k) & ~k.rlike(rules.KEYWORD_NOISE)
        & (F.length(k) <= rules.KEYWORD_MAX_CHARS),
    )
    return F.coalesce(keep, F.array().cast("array<string>"))


def sentiment_value(word: Column) -> Column:
    low = F.lower(word)
    return (
        F.when(low == "positive", F.lit(0.5))
        .when(low == "negative", F.lit(-0.5))
        .when(low == "neutral", F.lit(0.0))
    )


def flatten_entities(entities: Column) -> Column:
    flat = F.transform(
        entities,
        lambda e: F.struct(
            F.coalesce(e["name"], F.lit("")).alias("name"),
            F.coalesce(e["type"], F.lit("")).alias("type"),
            sentiment_value(e["sentiment"]).alias("sentiment"),
        ),
    )
    named = F.filter(flat, lambda e: e["name"] != "")
    return F.coalesce(named, F.array().cast("array<struct<name:string,type:string,sentiment:double>>"))


def json_to_strings(c: Column) -> Column:
    """JSON array of strings to an array, null stays null."""
    return F.from_json(c, T.ArrayType(T.StringType()))


def strings_to_json(c: Column) -> Column:
    return F.to_json(c)


def context_len(description: Column, content: Column) -> Column:
    return chars(description) + chars(content)


def best_text(*candidates: Column, minimum: int = 50) -> Column:
    """First candidate with at least ``minimum`` characters."""
    return F.coalesce(*[F.when(F.length(c) >= minimum, c) for c in candidates])


def embedding_input(title: Column, full_text: Column, content: Column, description: Column,
                    limit: int = config.EMBED_CHARS) -> Column:
    body = (
        F.when(F.length(full_text) >= 300, F.substring(full_text, 1, limit))
        .when(F.length(content) >= 80, F.substring(content, 1, limit))
        .otherwise(F.coalesce(description, F.lit("")))
    )
    return F.concat(title, F.lit("\n"), body)


def scrape_class(text: Column) -> Column:
    n = F.length(text)
    return (
        F.when(n.isNull() | (n < 50), F.lit("failed"))
        .when(n < 300, F.lit("thin"))
        .otherwise(F.lit("full"))
    )


# ---- dates ------------------------------------------------------------------------------

_RFC_FORMATS = ["d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm xx"]


def parse_utc(raw: Column, as_of: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` read as UTC; unreadable text gives ``as_of``."""
    text = trim_ws(raw)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text), as_of
    )


def parse_zoned(raw: Column, zone: Column, as_of: Column) -> Column:
    """Local time text plus a zone name; a missing or unknown zone is read as UTC."""
    local = F.try_to_timestamp(trim_ws(raw), F.lit("yyyy-MM-dd HH:mm:ss"))
    known = F.coalesce(zone.isin(*KNOWN_ZONES), F.lit(False))
    moved = F.when(known, F.to_utc_timestamp(local, F.when(known, zone).otherwise("UTC"))).otherwise(local)
    return F.coalesce(moved, as_of)


def parse_iso(raw: Column, as_of: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(raw), as_of)


def parse_feed_date(raw: Column) -> Column:
    """Feed dates: ISO 8601 or the mail format, with or without the day name."""
    text = F.regexp_replace(trim_ws(raw), r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in _RFC_FORMATS]
    )


def time_ago(ts: Column, as_of: Column) -> Column:
    minutes = F.floor((F.unix_micros(as_of) - F.unix_micros(ts)) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    return (
        F.when(ts.isNull(), F.lit(""))
        .when(minutes < 1, F.lit("Just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit("d ago")))
    )


def day_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "EEE, d MMMM yyyy"), F.lit("Unknown Date"))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM d, yyyy")


def clock_label(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "HH:mm"), F.lit(""))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


# ---- scores -----------------------------------------------------------------------------

def source_quality(priority: Column, floor_at: int, clamp: bool = False) -> Column:
    """One at or below ``floor_at``, then falling with the logarithm of the priority."""
    falling = 1 - F.log10(priority.cast("double")) / F.log10(F.lit(float(config.PRIORITY_SCALE)))
    if clamp:
        falling = F.greatest(F.lit(0.0), falling)
    return F.when(priority <= floor_at, F.lit(1.0)).otherwise(falling)


def category_weight(category: Column, weights: dict = config.CATEGORY_WEIGHT,
                    default: float = config.CATEGORY_WEIGHT_DEFAULT) -> Column:
    found = F.try_element_at(literal_map(weights), F.coalesce(category, F.lit("none")))
    return F.coalesce(found, F.lit(default))


def coverage_score(sources: Column) -> Column:
    return (
        F.when(sources <= 1, F.lit(0.2)).when(sources == 2, F.lit(0.55))
        .when(sources == 3, F.lit(0.8)).otherwise(F.lit(1.0))
    )


def corroboration_bonus(domains: Column) -> Column:
    return F.when(domains >= 3, F.lit(1.15)).when(domains >= 2, F.lit(1.05)).otherwise(F.lit(1.0))


def momentum_score(recent: Column) -> Column:
    return F.least(recent / F.lit(4.0), F.lit(1.0))


def freshness_score(hours: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - hours / 24)


def age_step(hours: Column) -> Column:
    return (
        F.when(hours < 2, F.lit(0.5)).when(hours < 8, F.lit(1.0))
        .when(hours < 16, F.lit(0.8)).otherwise(F.lit(0.5))
    )


def is_india(country: Column, domain: Column, case_insensitive: bool = False) -> Column:
    names = [c.lower() for c in rules.INDIA_COUNTRIES] if case_insensitive else rules.INDIA_COUNTRIES
    key = F.lower(country) if case_insensitive else country
    hit = F.coalesce(key.isin(names), F.lit(False))
    for d in rules.INDIA_DOMAINS:
        hit = hit | F.coalesce(F.contains(domain, F.lit(d)), F.lit(False))
    return hit


def region(country: Column, domain: Column, case_insensitive: bool = False) -> Column:
    return F.when(is_india(country, domain, case_insensitive), F.lit("india")).otherwise(F.lit("global"))
