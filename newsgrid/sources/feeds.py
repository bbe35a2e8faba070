"""Feeds (RSS and Atom) and the history backfill source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..operators import numbering

col = F.col
FEED_HOURS = 30
# Limits of the studied feed reader, for callers that want them.
FEED_LIMITS = {"items_per_feed": 30, "total": 60, "title_chars": 500, "url_chars": 1000, "body_chars": 5000}

_TEXT = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_href", T.StringType())])
_BODIES = ("description", "summary", "content", "content:encoded", "dc:description")
_DATES = ("pubDate", "published", "updated")
_ITEM = T.StructType(
    [T.StructField("title", _TEXT), T.StructField("link", T.ArrayType(_TEXT))]
    + [T.StructField(n, T.StringType()) for n in (*_DATES, *_BODIES)]
)
_FEED = T.StructType([
    T.StructField("channel", T.StructType([T.StructField("item", T.ArrayType(_ITEM))])),
    T.StructField("entry", T.ArrayType(_ITEM)),
])


def feed_items(feeds: DataFrame, as_of: Column, items_per_feed: int | None = None) -> DataFrame:
    """(feed_seq, item_seq, title, url, body, published_at) of all items, or of the first
    ``items_per_feed`` of each feed.

    ``feeds`` is (feed_seq, xml); the document is an RSS channel or an Atom feed."""
    parsed = feeds.select("feed_seq", F.from_xml("xml", _FEED).alias("x"))
    items = F.coalesce(col("x.channel.item"), col("x.entry"))
    items = items if items_per_feed is None else F.slice(items, 1, items_per_feed)
    rows = parsed.select("feed_seq", F.posexplode(items).alias("item_seq", "i"))
    link = F.get(col("i.link"), F.lit(0))
    body = F.coalesce(*[col("i")[n] for n in _BODIES], F.lit(""))
    dates = [S.parse_feed_date(col("i")[n]) for n in _DATES]
    return rows.select(
        "feed_seq", col("item_seq").cast("long").alias("item_seq"), F.coalesce("i.title._VALUE", F.lit("")).alias("title"),
        F.coalesce(S.blank_to_null(S.trim_ws(link["_VALUE"])), link["_href"], F.lit("")).alias("url"),
        S.strip_tags(body).alias("body"), F.coalesce(*dates, as_of).alias("published_at"),
    )


def _first_chars(name: str, n: int | None) -> Column:
    return (col(name) if n is None else F.substring(name, 1, n)).alias(name)


def merged_feeds(items: DataFrame, as_of: Column, hours: int = FEED_HOURS, total: int | None = None,
                 title_chars: int | None = None, url_chars: int | None = None, body_chars: int | None = None) -> DataFrame:
    """Recent items, first per url in feed order. Nothing is cut unless a limit is given."""
    recent = items.filter(col("published_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))
    first = numbering.top_per_key(recent, ["url"], [col("feed_seq"), col("item_seq")], 1).drop("rank")
    first = first if total is None else first.orderBy("feed_seq", "item_seq").limit(total)
    return first.select(
        "feed_seq", "item_seq", _first_chars("title", title_chars), _first_chars("url", url_chars),
        _first_chars("body", body_chars), "published_at",
    )


# ---- history backfill -------------------------------------------------------------------

def backfill_record(df: DataFrame, title_chars: int | None = None, url_chars: int | None = None, body_chars: int | None = None) -> DataFrame:
    """Records with url, title and a readable date; description and content become the body."""
    published = F.try_to_timestamp("publishedAt")
    full = df.filter((F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & published.isNotNull())
    body = F.concat_ws(" ", S.blank_to_null(S.trim_ws(col("description"))), S.blank_to_null(S.trim_ws(col("content"))))
    full = full.withColumns({"body": body, "published_at": published})
    return full.withColumns({
        "title": _first_chars("title", title_chars), "url": _first_chars("url", url_chars), "body": _first_chars("body", body_chars),
    }).drop("publishedAt", "description", "content")


def day_ranges(df: DataFrame, as_of: Column, lookback: Column) -> DataFrame:
    """One row per previous UTC day: [from_ts, to_ts)."""
    today = F.to_date(as_of)
    n = F.greatest(F.lit(1), lookback.cast("int"))
    days = F.sequence(F.date_sub(today, n), F.date_sub(today, 1))
    return df.select("*", F.explode(days).alias("day")).withColumns({
        "from_ts": col("day").cast("timestamp"), "to_ts": F.date_add("day", 1).cast("timestamp"),
    })


def domain_batches(sources: DataFrame, size: int = 5) -> DataFrame:
    """(batch_id, domains): distinct domains in order of first source, ``size`` per batch."""
    domains = sources.filter(col("domain") != "").groupBy("domain").agg(F.min("source_id").alias("source_id"))
    batched = numbering.batch_number(domains, "source_id", size)
    return batched.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("pos", "domain"))).alias("l")).select(
        "batch_id", col("l.domain").alias("domains"))


def source_domain(value: Column) -> Column:
    """Host of a url or of a bare host name."""
    return S.host(F.when(value.rlike("^https?://"), value).otherwise(F.concat(F.lit("https://"), value)))


def resolve_sources(records: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``source_id``: by domain (lowest id wins), else by lower-cased name (highest id
    wins); null when unmatched. ``sources`` is (source_id, name, base_url)."""
    by_domain = sources.withColumn("d", source_domain(col("base_url"))).filter(col("d").isNotNull()).groupBy("d").agg(
        F.min("source_id").alias("id_by_domain"))
    by_name = sources.withColumn("n", F.lower(S.trim_ws(col("name")))).groupBy("n").agg(F.max("source_id").alias("id_by_name"))
    keyed = records.withColumns({"d": source_domain(col("url")), "n": F.lower(S.trim_ws(col("source_name")))})
    return keyed.join(by_domain, "d", "left").join(by_name, "n", "left").withColumn(
        "source_id", F.coalesce("id_by_domain", "id_by_name")).drop("d", "n", "id_by_domain", "id_by_name")
