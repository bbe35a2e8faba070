"""Queries of scans, sources and sinks (SRC, SNK)."""

import uuid

from pyspark.sql import functions as F

from .. import config, schemas
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import dedup, filters, metrics, modelio, numbering, similarity
from ..session import scratch_dir
from ..sources import feeds, landed, tables
from . import check_sql as C
from .registry import query
from .views import Views, as_of, union_all, with_views

col = F.col
ART = with_views("articles")
PAGE = 100


# ---- landed pages made from the documents table --------------------------------------------

def _pages(rows, field: str, *columns):
    """JSON pages of records, in the layout of the landed files."""
    record = F.struct(col("doc_id").alias("order_no"), *columns)
    return rows.groupBy(F.floor(col("doc_id") / PAGE).alias("page_id")).agg(
        F.to_json(F.struct(F.sort_array(F.collect_list(record)).alias(field))).alias("raw"))


def _text(c) -> F.Column:
    return c.cast("string")


def _line() -> F.Column:
    """The first line of a text."""
    return F.split_part("text", F.lit("\n"), F.lit(1))


def _sentence() -> F.Column:
    """The first sentence of a text, as a title."""
    return F.split_part(_line(), F.lit("."), F.lit(1))


def worldnews_pages(v: Views, rows=None):
    i = col("doc_id")
    body = F.when(i % 12 == 4, F.concat(F.lit("Subscribe now"), F.lit("\n"), F.lit("ok"))).when(i % 12 == 8, F.lit(None)).otherwise(
        F.concat(F.lit("Also read this\n"), "text", F.lit("\n © 2024\n\n\n\ntail line")))
    when = F.date_format(as_of() - F.make_dt_interval(mins=(i * 7 % 43200).cast("int")), "yyyy-MM-dd HH:mm:ss")
    return _pages(
        v.documents if rows is None else rows, "news",
        _text(i).alias("id"), F.when(i % 40 == 0, F.lit("")).otherwise(F.concat(F.lit("https://www.Site"), _text(i % 7), F.lit(".example.com/news/"), _text(F.floor(i / 8) * 8), F.lit("/?x=1"))).alias("url"),
        _sentence().alias("title"), body.alias("text"), F.when(i % 8 == 0, _line()).alias("summary"),
        F.when(i % 8 == 0, when).alias("publishDate"), F.when(i % 16 == 4, when).when(i % 16 == 12, F.lit("bad date")).alias("publish_date"),
        ((i % 21 - 10) / 10.0).alias("sentiment"), F.when(i % 3 == 0, F.array(F.concat(F.lit("Author "), _text(i)), F.lit("Second"))).otherwise(F.array()).alias("authors"),
        F.when(i % 16 == 0, F.lit("IN")).alias("sourceCountry"), F.lit("US").alias("source_country"), F.lit("politics").alias("category"),
        F.when(i % 5 != 0, col("lang")).alias("language"))


def thenewsapi_pages(v: Views, rows=None):
    i = col("doc_id")
    when = F.date_format(as_of() - F.make_dt_interval(mins=(i * 7 % 43200).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'.000000Z'")
    return _pages(
        v.documents if rows is None else rows, "data",
        F.concat(F.lit("u-"), _text(i)).alias("uuid"), F.concat(F.lit("https://www.news"), _text(i % 5), F.lit(".example.com/a/"), _text(i)).alias("url"),
        _sentence().alias("title"), F.when(i % 12 == 3, F.lit("   ")).otherwise(F.concat(F.lit("  "), "text", F.lit(" "))).alias("description"),
        F.lit("snippet").alias("snippet"), F.when(i % 8 == 3, F.lit("")).otherwise(F.concat(F.lit("feed"), _text(i % 3), F.lit(".example.com"))).alias("source"),
        when.alias("published_at"), F.when(i % 16 == 15, F.array()).otherwise(F.array(F.lit("general"), F.lit("business"))).alias("categories"),
        F.concat(F.lit(" k1 ,, key "), _text(i % 9), F.lit(",")).alias("keywords"), F.when(i % 5 != 0, (i % 50) + 0.5).alias("relevance_score"),
        F.lit("US").alias("locale"), col("lang").alias("language"))


def newsdata_pages(v: Views, rows=None):
    i = col("doc_id")
    when = F.date_format(as_of() - F.make_dt_interval(mins=(i * 7 % 2400).cast("int")), "yyyy-MM-dd HH:mm:ss")
    text = F.when(i % 20 == 1, F.lit("ONLY AVAILABLE IN PAID PLANS")).when(i % 20 == 5, _sentence()).otherwise(col("text"))
    return _pages(
        v.documents if rows is None else rows, "results",
        F.concat(F.lit("n"), _text(i)).alias("article_id"), F.concat(F.lit("https://www.daily"), _text(i % 6), F.lit(".example.com/x/"), _text(i), F.lit("#top")).alias("link"),
        _sentence().alias("title"), text.alias("description"), when.alias("pubDate"), F.when(i % 8 == 1, F.lit("UTC")).alias("pubDateTZ"),
        F.when(i % 3 == 0, F.lit("https://www.origin.example.com")).when(i % 3 == 1, F.lit("not a url")).alias("source_url"),
        F.when(i % 12 != 1, F.lit("Daily Origin")).alias("source_name"), ((i * 7919) % 15000).alias("source_priority"),
        F.array(F.lit("Jane Doe")).alias("creator"), F.array(F.lit("India"), F.lit("US")).alias("country"), F.array(F.lit("top"), F.lit("world")).alias("category"),
        F.array(F.lit("usn:1"), F.concat(F.lit("kw"), _text(i % 10)), F.lit("")).alias("keywords"), (i % 29 == 0).alias("duplicate"), col("lang").alias("language"))


def webzio_pages(v: Views, rows=None):
    i = col("doc_id")
    when = F.date_format(as_of() - F.make_dt_interval(mins=(i * 7 % 43200).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'.000+00:00'")
    thread = F.struct(
        F.when(i % 8 == 2, F.concat(F.lit("site"), _text(i % 4), F.lit(".example.com"))).alias("site"), F.concat(F.lit("https://full.example.com/"), _text(i)).alias("site_full"),
        F.lit("IN").alias("country"), (i % 1000).alias("domain_rank"), ((i % 10) / 10.0).alias("performance_score"),
        F.struct(F.struct(i.alias("likes")).alias("facebook")).alias("social"))
    return _pages(
        v.documents if rows is None else rows, "posts",
        F.when(i % 12 != 2, F.concat(F.lit("https://www.post.example.com/p/"), _text(i))).alias("url"), _sentence().alias("title"),
        F.when(i % 20 == 2, F.lit("")).otherwise(col("text")).alias("text"), when.alias("published"), F.lit("Desk").alias("author"),
        F.when(i % 3 == 0, F.lit("positive")).when(i % 3 == 1, F.lit("Negative")).alias("sentiment"), F.array(F.lit("Politics"), F.lit("Economy")).alias("categories"),
        F.array(F.struct(F.concat(F.lit("Entity "), _text(i % 6)).alias("name"), F.lit("org").alias("type"), F.lit("neutral").alias("sentiment")),
                F.struct(F.lit("").alias("name"), F.lit("x").alias("type"), F.lit("neutral").alias("sentiment"))).alias("entities"),
        thread.alias("thread"), F.lit("english").alias("language"))


PAGES = {"worldnews": worldnews_pages, "webzio": webzio_pages, "thenewsapi": thenewsapi_pages, "newsdata": newsdata_pages}
_SHOWN = [
    "seq", "external_id", "source_api", "url", "title", "description", "content", "author", "source_name", "source_domain",
    "published_at", "api_category", "api_iptc_category", "api_sentiment", "api_language", "api_country", "api_keywords",
    "api_source_priority", "api_relevance_score", "api_domain_rank", "api_performance", "api_duplicate_flag", "normalized_url_hash",
]

# The position of a record inside its page, and the sequence number made of both.
_SEQ = "(doc_id // 100) * 1000000 + row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS seq"
_T43200 = f"{C.AS_OF} - (doc_id * 7 % 43200) * INTERVAL '1' MINUTE"

CHECK_WORLDNEWS = f"""
SELECT * REPLACE (CASE WHEN length(content) >= 20 THEN content END AS content), {C.url_hash('url')} AS normalized_url_hash FROM (SELECT {_SEQ}, doc_id::VARCHAR AS external_id, 'worldnews' AS source_api,
 CASE WHEN doc_id % 40 = 0 THEN '' ELSE 'https://www.Site' || (doc_id % 7) || '.example.com/news/' || (doc_id // 8 * 8) || '/?x=1' END AS url,
 split_part(split_part(text, chr(10), 1), '.', 1) AS title, CASE WHEN doc_id % 8 = 0 THEN split_part(text, chr(10), 1) END AS description,
 CASE WHEN doc_id % 12 IN (4, 8) THEN NULL ELSE {C.boilerplate("'Also read this' || chr(10) || text || chr(10) || ' © 2024' || chr(10) || chr(10) || chr(10) || chr(10) || 'tail line'")} END AS content,
 CASE WHEN doc_id % 3 = 0 THEN 'Author ' || doc_id END AS author, 'site' || (doc_id % 7) || '.example.com' AS source_name,
 'site' || (doc_id % 7) || '.example.com' AS source_domain,
 {C.ts(f"CASE WHEN doc_id % 8 = 0 OR doc_id % 16 = 4 THEN {_T43200} ELSE {C.AS_OF} END")} AS published_at,
 'politics' AS api_category, NULL::VARCHAR AS api_iptc_category, (doc_id % 21 - 10) / 10.0::DOUBLE AS api_sentiment,
 CASE WHEN doc_id % 5 <> 0 THEN lang ELSE 'en' END AS api_language, CASE WHEN doc_id % 16 = 0 THEN 'in' ELSE 'us' END AS api_country,
 '' AS api_keywords, NULL::BIGINT AS api_source_priority, NULL::DOUBLE AS api_relevance_score, NULL::BIGINT AS api_domain_rank,
 NULL::DOUBLE AS api_performance, NULL::BOOLEAN AS api_duplicate_flag
 FROM documents /*part*/) q WHERE url <> ''"""

CHECK_THENEWSAPI = f"""
SELECT *, {C.url_hash('url')} AS normalized_url_hash FROM (SELECT {_SEQ}, 'u-' || doc_id AS external_id, 'thenewsapi' AS source_api,
 'https://www.news' || (doc_id % 5) || '.example.com/a/' || doc_id AS url, split_part(split_part(text, chr(10), 1), '.', 1) AS title, NULL::VARCHAR AS description,
 CASE WHEN doc_id % 12 <> 3 THEN {C.trim('text')} END AS content, NULL::VARCHAR AS author,
 CASE WHEN doc_id % 8 = 3 THEN 'news' || (doc_id % 5) || '.example.com' ELSE 'feed' || (doc_id % 3) || '.example.com' END AS source_name,
 CASE WHEN doc_id % 8 = 3 THEN 'news' || (doc_id % 5) || '.example.com' ELSE 'feed' || (doc_id % 3) || '.example.com' END AS source_domain,
 {C.ts(_T43200)} AS published_at, CASE WHEN doc_id % 16 <> 15 THEN 'general, business' END AS api_category,
 CASE WHEN doc_id % 16 <> 15 THEN 'general, business' END AS api_iptc_category, NULL::DOUBLE AS api_sentiment, lang AS api_language, 'us' AS api_country,
 'k1|key ' || (doc_id % 9) AS api_keywords, NULL::BIGINT AS api_source_priority,
 CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 50) + 0.5::DOUBLE END AS api_relevance_score, NULL::BIGINT AS api_domain_rank, NULL::DOUBLE AS api_performance,
 NULL::BOOLEAN AS api_duplicate_flag FROM documents /*part*/) q WHERE NOT coalesce(api_relevance_score < 25, false)"""

CHECK_NEWSDATA = f"""
SELECT * EXCLUDE (t), {C.url_hash('url')} AS normalized_url_hash FROM (SELECT {_SEQ}, 'n' || doc_id AS external_id, 'newsdata' AS source_api,
 'https://www.daily' || (doc_id % 6) || '.example.com/x/' || doc_id || '#top' AS url, split_part(split_part(text, chr(10), 1), '.', 1) AS title, NULL::VARCHAR AS description,
 CASE WHEN doc_id % 20 = 1 THEN NULL WHEN doc_id % 20 = 5 THEN split_part(split_part(text, chr(10), 1), '.', 1) ELSE text END AS content, 'Jane Doe' AS author,
 CASE WHEN doc_id % 12 <> 1 THEN 'Daily Origin' WHEN doc_id % 3 = 0 THEN 'origin.example.com' ELSE 'daily' || (doc_id % 6) || '.example.com' END AS source_name,
 CASE WHEN doc_id % 3 = 0 THEN 'origin.example.com' ELSE 'daily' || (doc_id % 6) || '.example.com' END AS source_domain,
 {C.AS_OF} - (doc_id * 7 % 2400) * INTERVAL '1' MINUTE AS t, {C.ts(f"{C.AS_OF} - (doc_id * 7 % 2400) * INTERVAL '1' MINUTE")} AS published_at,
 'top, world' AS api_category, NULL::VARCHAR AS api_iptc_category, NULL::DOUBLE AS api_sentiment, lang AS api_language, 'india,us' AS api_country,
 'kw' || (doc_id % 10) AS api_keywords, (doc_id * 7919) % 15000 AS api_source_priority, NULL::DOUBLE AS api_relevance_score, NULL::BIGINT AS api_domain_rank,
 NULL::DOUBLE AS api_performance, doc_id % 29 = 0 AS api_duplicate_flag FROM documents /*part*/) q
WHERE api_source_priority <= 10000 AND t >= {C.AS_OF} - INTERVAL 30 HOUR AND NOT coalesce(content <> '' AND length(content) < 200, false)"""

CHECK_WEBZIO = f"""
SELECT *, {C.url_hash('url')} AS normalized_url_hash FROM (SELECT {_SEQ}, NULL::VARCHAR AS external_id, 'webzio' AS source_api,
 CASE WHEN doc_id % 12 <> 2 THEN 'https://www.post.example.com/p/' || doc_id ELSE 'https://full.example.com/' || doc_id END AS url, split_part(split_part(text, chr(10), 1), '.', 1) AS title,
 CASE WHEN doc_id % 20 <> 2 THEN text END AS description, NULL::VARCHAR AS content, 'Desk' AS author,
 CASE WHEN doc_id % 8 = 2 THEN 'site' || (doc_id % 4) || '.example.com' WHEN doc_id % 12 <> 2 THEN 'post.example.com' ELSE 'full.example.com' END AS source_name,
 CASE WHEN doc_id % 8 = 2 THEN 'site' || (doc_id % 4) || '.example.com' WHEN doc_id % 12 <> 2 THEN 'post.example.com' ELSE 'full.example.com' END AS source_domain,
 {C.ts(_T43200)} AS published_at, 'Politics, Economy' AS api_category, 'Politics, Economy' AS api_iptc_category,
 CASE doc_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE END AS api_sentiment, 'english' AS api_language, 'IN' AS api_country, 'Politics|Economy' AS api_keywords,
 NULL::BIGINT AS api_source_priority, NULL::DOUBLE AS api_relevance_score, doc_id % 1000 AS api_domain_rank, (doc_id % 10) / 10.0::DOUBLE AS api_performance,
 NULL::BOOLEAN AS api_duplicate_flag, 'Entity ' || (doc_id % 6) || ':org:0' AS entities, '{{"facebook":{{"likes":' || doc_id || '}}}}' AS api_social
 FROM documents /*part*/) q"""


@query("src_01_worldnews", CHECK_WORLDNEWS)
def _(v: Views):
    return landed.worldnews(worldnews_pages(v), as_of()).select(*_SHOWN)


@query("src_02_thenewsapi", CHECK_THENEWSAPI)
def _(v: Views):
    return landed.thenewsapi(thenewsapi_pages(v), as_of()).select(*_SHOWN)


@query("src_03_newsdata", CHECK_NEWSDATA)
def _(v: Views):
    return landed.newsdata(newsdata_pages(v), as_of()).select(*_SHOWN)


@query("src_04_webzio", CHECK_WEBZIO)
def _(v: Views):
    entities = F.transform("api_entities", lambda e: F.concat_ws(":", e["name"], e["type"], e["sentiment"].cast("int").cast("string")))
    return landed.webzio(webzio_pages(v), as_of()).select(*_SHOWN, F.array_join(entities, "|").alias("entities"), "api_social")


def _feed_xml(v: Views):
    """One feed per source and group of documents, RSS and Atom in turn."""
    i = col("doc_id")
    plain = lambda c: F.regexp_replace(c, "[^A-Za-z .]", " ")
    title, whole = plain(_sentence()), plain(col("text"))
    when = as_of() - F.make_dt_interval(mins=(i * 7 % 5000).cast("int"))
    feed = F.floor(i / 40)
    rss = F.concat(
        F.lit("<item><title>"), title, F.lit("</title><link>https://rss.example.com/"), _text(F.floor(i / 3)), F.lit("</link><description>&lt;p&gt;"), whole,
        F.lit("&lt;/p&gt;</description><pubDate>"), F.when(i % 9 == 0, F.lit("unknown")).otherwise(F.date_format(when, "EEE, dd MMM yyyy HH:mm:ss '+0000'")), F.lit("</pubDate></item>"))
    atom = F.concat(
        F.lit('<entry><title type="html">'), title, F.lit('</title><link href="https://atom.example.com/'), _text(i), F.lit('"/><summary>'), whole,
        F.lit("</summary><updated>"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated></entry>"))
    rows = v.documents.select(feed.alias("feed_seq"), "doc_id", F.when(feed % 2 == 0, rss).otherwise(atom).alias("item"))
    body = rows.groupBy("feed_seq").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "item"))), lambda x: x["item"]), "").alias("b"))
    return body.select("feed_seq", F.when(col("feed_seq") % 2 == 0, F.concat(F.lit("<rss><channel><title>t</title>"), "b", F.lit("</channel></rss>"))).otherwise(
        F.concat(F.lit("<feed><title>t</title>"), "b", F.lit("</feed>"))).alias("xml"))


_FEED_ITEMS = f"""feed_items AS (SELECT * FROM (SELECT doc_id // 40 AS feed_seq, row_number() OVER (PARTITION BY doc_id // 40 ORDER BY doc_id) - 1 AS item_seq, doc_id, text,
 {C.AS_OF} - (doc_id * 7 % 5000) * INTERVAL '1' MINUTE AS t FROM documents) q),
items AS (SELECT feed_seq, item_seq, trim(regexp_replace(split_part(split_part(text, chr(10), 1), '.', 1), '[^A-Za-z .]', ' ', 'g')) AS title,
 CASE WHEN feed_seq % 2 = 0 THEN 'https://rss.example.com/' || (doc_id // 3) ELSE 'https://atom.example.com/' || doc_id END AS url,
 trim(regexp_replace(text, '[^A-Za-z .]', ' ', 'g')) AS body,
 CASE WHEN feed_seq % 2 = 0 AND doc_id % 9 = 0 THEN {C.AS_OF} ELSE t END AS published_at FROM feed_items)"""


@query("src_05_feed_items", f"WITH {_FEED_ITEMS} SELECT feed_seq, item_seq, title, url, body, {C.ts('published_at')} AS published_at FROM items")
def _(v: Views):
    return feeds.feed_items(_feed_xml(v), as_of()).withColumns({"title": F.trim("title"), "body": F.trim("body")})


@query("src_06_feed_union", f"""WITH {_FEED_ITEMS}
SELECT feed_seq, item_seq, title, url, body, {C.ts('published_at')} AS published_at FROM (
 SELECT *, row_number() OVER (PARTITION BY url ORDER BY feed_seq, item_seq) AS rn FROM items WHERE published_at >= {C.AS_OF} - INTERVAL 30 HOUR) q
WHERE rn = 1""")
def _(v: Views):
    return feeds.merged_feeds(feeds.feed_items(_feed_xml(v), as_of()), as_of()).withColumns({"title": F.trim("title"), "body": F.trim("body")})


_BACKFILL = """SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN 'https://www.src' || CAST(user_id % 12 AS VARCHAR(9)) || '.example.com/' || CAST(event_id AS VARCHAR(20)) END AS url,
 CASE WHEN event_id % 21 <> 0 THEN event_type || ' number ' || CAST(event_id AS VARCHAR(20)) ELSE '' END AS title,
 CASE WHEN event_id % 3 <> 0 THEN '  ' || props || ' ' END AS description, CASE WHEN event_id % 4 = 0 THEN '   ' ELSE event_type END AS content,
 'Source ' || CAST(user_id % 30 AS VARCHAR(9)) AS source_name"""


def _backfill(v: Views):
    when = F.when(col("event_id") % 22 == 0, F.lit("soon")).otherwise(F.date_format(F.date_trunc("second", col("ts").cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = v.spark.sql(_BACKFILL + ", ts FROM {events}", events=v.events)
    return rows.withColumn("publishedAt", when).drop("ts")


@query("src_07_backfill_record", f"""
SELECT event_id, url, title, source_name, concat_ws(' ', nullif({C.trim('description')}, ''), nullif({C.trim('content')}, '')) AS body,
 {C.ts("date_trunc('second', ts)")} AS published_at FROM ({_BACKFILL}, ts FROM events) q WHERE event_id % 22 <> 0 AND url IS NOT NULL AND title <> ''""")
def _(v: Views):
    return feeds.backfill_record(_backfill(v))


@query("src_08_day_ranges", """
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%Y-%m-%d %H:%M:%S') AS from_ts, strftime(d + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS to_ts FROM (
 SELECT user_id, unnest(generate_series(date_trunc('day', last) - INTERVAL 1 DAY * n, date_trunc('day', last) - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d
 FROM (SELECT user_id, max(ts) AS last, greatest(1, user_id % 15) AS n FROM events GROUP BY user_id) u) q""")
def _(v: Views):
    users = v.events.groupBy("user_id").agg(F.max(col("ts").cast("timestamp")).alias("last"))
    return feeds.day_ranges(users, col("last"), col("user_id") % 15).select("user_id", "day", "from_ts", "to_ts")


_SOURCES = """SELECT doc_id AS source_id, 'Source ' || CAST(doc_id % 40 AS VARCHAR(9)) AS name, CASE WHEN doc_id % 3 = 0 THEN 'www.src' ELSE 'https://WWW.src' END || CAST(doc_id % 11 AS VARCHAR(9)) || '.example.com' AS base_url FROM"""


@query("src_09_domain_batches", f"""
WITH s AS ({_SOURCES} documents), d AS (SELECT regexp_replace(lower(regexp_replace(base_url, '^https://', '')), '^www\\.', '') AS domain, min(source_id) AS source_id FROM s GROUP BY 1),
n AS (SELECT domain, (row_number() OVER (ORDER BY source_id) - 1) // 5 AS batch_id, source_id FROM d), b AS (SELECT batch_id, string_agg(domain, '|' ORDER BY source_id) AS domains FROM n GROUP BY batch_id),
days AS (SELECT unnest(generate_series({C.AS_OF} - INTERVAL 14 DAY, {C.AS_OF} - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d)
SELECT batch_id, domains, strftime(d, '%Y-%m-%d') AS day FROM b, days""")
def _(v: Views):
    sources = v.spark.sql(_SOURCES + " {documents}", documents=v.documents).withColumn("domain", feeds.source_domain(col("base_url")))
    return feeds.day_ranges(feeds.domain_batches(sources), as_of(), F.lit(14)).select("batch_id", "domains", "day")


def source_pages(v: Views) -> dict:
    """Page tables that share the documents out between the sources, as the article view does."""
    rows = v.articles.select(col("id").alias("doc_id"), col("body").alias("text"), col("api_language").alias("lang"), "source_api")
    return {name: pages(v, rows.filter(col("source_api") == name)) for name, pages in PAGES.items()}


def _unified(v: Views):
    return {name: landed.NORMALISERS[name](pages, as_of()) for name, pages in source_pages(v).items()}


def _part(sql: str, rest: int) -> str:
    """The checking SQL of a source over its share of the documents."""
    return sql.replace("/*part*/", f"WHERE doc_id % 4 = {rest}")


_SHARES = [_part(CHECK_WORLDNEWS, 0), _part(CHECK_WEBZIO, 2), _part(CHECK_THENEWSAPI, 3), _part(CHECK_NEWSDATA, 1)]


def _all_sources(parts: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT {rank} AS source_rank, seq, source_api, url, title, normalized_url_hash FROM ({sql}) s{rank}" for rank, sql in enumerate(parts))


_ALL_SOURCES = _all_sources(_SHARES)
_WHOLE_SOURCES = _all_sources([CHECK_WORLDNEWS, CHECK_WEBZIO, CHECK_THENEWSAPI, CHECK_NEWSDATA])


@query("src_10_source_concat", f"WITH u AS ({_ALL_SOURCES}) SELECT row_number() OVER (ORDER BY source_rank, seq) AS batch_seq, source_rank::BIGINT AS source_rank, seq, url FROM u")
def _(v: Views):
    return landed.concat_sources(_unified(v)).select("batch_seq", "source_rank", "seq", "url")


@query("src_11_failed_source", f"SELECT source_api, count(*) AS n FROM ({_ALL_SOURCES}) u WHERE source_api <> 'webzio' GROUP BY source_api")
def _(v: Views):
    made = _unified(v)
    schema = made["worldnews"].schema

    def missing():
        return v.spark.read.schema(schemas.WEBZIO_PAGE).json(f"{v.folder}/no_such_source")

    loaders = {name: (missing if name == "webzio" else (lambda f=frame: f)) for name, frame in made.items()}
    every = union_all(list(landed.tolerant(v.spark, loaders, schema).values()))
    return every.groupBy("source_api").agg(F.count(F.lit(1)).alias("n"))


@query("src_11_read_failure", f"""SELECT source_api, count(*) AS n, 'rows' AS kind FROM ({_ALL_SOURCES}) u WHERE source_api <> 'newsdata' GROUP BY source_api
UNION ALL SELECT 'newsdata', 1, 'error'""")
def _(v: Views):
    made = _unified(v)

    def failing(rows):
        """Plans without a fault and breaks in a task, after other rows have been read."""
        return rows.withColumn("url", F.when(col("seq") < 0, col("url")).otherwise(F.raise_error(F.lit("page lost")).cast("string")))

    loaders = {name: (lambda f=frame, n=name: failing(f) if n == "newsdata" else f) for name, frame in made.items()}
    rows, errors = landed.isolated(v.spark, loaders, made["worldnews"].schema)
    counted = union_all(list(rows.values())).groupBy("source_api").agg(F.count(F.lit(1)).alias("n"), F.lit("rows").alias("kind"))
    return counted.unionByName(errors.groupBy("source_api").agg(F.count(F.lit(1)).alias("n"), F.lit("error").alias("kind")))


@query("src_01_landed_files", f"SELECT source_api, url, title FROM ({_ALL_SOURCES}) u")
def _(v: Views):
    """Pages of all sources written as files, one for each page, and read back."""
    parts = []
    for name, pages in source_pages(v).items():
        folder = f"{scratch_dir(v.spark)}/newsgrid-pages-{uuid.uuid4().hex}/{name}"
        pages.select("raw").write.option("maxRecordsPerFile", 1).text(folder)
        found, _ = landed.read_tolerant(v.spark, name, folder)
        parts.append(landed.NORMALISERS[name](found, as_of()).select("source_api", "url", "title"))
    return union_all(parts)


@query("src_12_by_id_and_story", f"""{ART}, ids AS (SELECT doc_id AS id FROM labels WHERE quality = 1)
SELECT 'ids' AS asked, id, title FROM articles WHERE id IN (SELECT id FROM ids) UNION ALL SELECT 'story' AS asked, id, title FROM articles WHERE story_id = 7""")
def _(v: Views):
    ids = v.labels.filter("quality = 1").select(col("doc_id").alias("id"))
    by_id = tables.by_ids(v.articles, ids).select(F.lit("ids").alias("asked"), "id", "title")
    return by_id.unionByName(tables.of_story(v.articles, 7).select(F.lit("story").alias("asked"), "id", "title"))


# ---- SNK --------------------------------------------------------------------------------

@query("snk_01_insert_articles", f"""{with_views('incoming', 'stored')},
f AS (SELECT regexp_replace(url, '[?].*', '') AS url, min(id) AS seq FROM incoming GROUP BY 1), s AS (SELECT regexp_replace(url, '[?].*', '') AS url, id FROM stored)
SELECT (SELECT coalesce(max(id), 0) FROM s) + row_number() OVER (ORDER BY seq) AS id, seq AS batch_seq, url FROM f WHERE url NOT IN (SELECT url FROM s)""")
def _(v: Views):
    short = F.regexp_replace("url", "[?].*", "")
    accepted = v.incoming.select(col("id").alias("batch_seq"), short.alias("url"))
    return tables.new_articles(accepted, v.stored.select("id", short.alias("url"))).select("id", "batch_seq", "url")


@query("snk_02_rejection_rows", f"""{with_views('raw_articles')}, ruled AS (SELECT url, title, source_api, source_domain, {C.rule()} AS rejection_rule, {C.context_len()} AS context_len FROM raw_articles)
SELECT url, title, source_api, source_domain, 'filter' AS rejection_stage, rejection_rule, context_len FROM ruled WHERE rejection_rule IS NOT NULL""")
def _(v: Views):
    rejected = filters.rejections(filters.with_rule(v.raw_articles, as_of()).filter("rule IS NOT NULL"), "filter", "id")
    names = ["url", "title", "source_api", "source_domain", "rejection_stage", "rejection_rule", "context_len"]
    # batches of parallel arrays, as the log writer receives them
    packed = rejected.groupBy(F.floor(col("id") / 500)).agg(F.collect_list(F.struct(*names)).alias("l")).select(*[col(f"l.{n}").alias(n) for n in names])
    return tables.from_parallel_arrays(packed, **{n: n for n in names})


@query("snk_03_tier_rejections", f"""{ART}
SELECT url, title, source_api, source_domain, 'llm' AS rejection_stage, 'tier_' || lower(llm_tier) AS rejection_rule, llm_tier, llm_category,
 'reason ' || id AS llm_reason, {C.context_len()} AS context_len FROM articles WHERE llm_tier IN ('C', 'D')""")
def _(v: Views):
    return tables.tier_rejections(v.articles.withColumn("llm_reason", F.concat(F.lit("reason "), _text(col("id")))))


@query("snk_04_brief_upsert", f"""{with_views('briefs')}, fresh AS (SELECT brief_date, [max(brief_date - DATE '2000-01-01')]::BIGINT[] AS article_ids FROM briefs WHERE day(brief_date) % 3 = 0 GROUP BY brief_date)
SELECT strftime(brief_date, '%Y-%m-%d') AS brief_date, array_to_string(article_ids, '|') AS article_ids FROM (
 SELECT brief_date, article_ids FROM briefs WHERE brief_date NOT IN (SELECT brief_date FROM fresh) UNION ALL SELECT brief_date, article_ids FROM fresh) q""")
def _(v: Views):
    fresh = v.briefs.filter(F.day("brief_date") % 3 == 0).select(
        "brief_date", F.array(F.datediff("brief_date", F.lit("2000-01-01")).cast("long")).alias("article_ids"), "user_id")
    return numbering.keyed_replace(v.briefs, fresh, ["brief_date", "user_id"]).select("brief_date", "article_ids")


@query("snk_05_metrics_upsert", f"""{with_views('rejection_log')},
d AS (SELECT created_at::DATE AS date, count(*) AS total_filtered FROM rejection_log GROUP BY 1), old AS (SELECT date, 0::BIGINT AS total_filtered FROM d WHERE day(date) % 2 = 0)
SELECT strftime(date, '%Y-%m-%d') AS date, total_filtered FROM (SELECT * FROM old WHERE date NOT IN (SELECT date FROM d WHERE day(date) % 4 <> 0) UNION ALL SELECT * FROM d WHERE day(date) % 4 <> 0) q""")
def _(v: Views):
    fresh = v.rejection_log.groupBy(F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("total_filtered"))
    old = fresh.filter(F.day("date") % 2 == 0).withColumn("total_filtered", F.lit(0).cast("long"))
    return numbering.keyed_replace(old, fresh.filter(F.day("date") % 4 != 0), ["date"])


@query("snk_06_simplification_cache", f"""{with_views('simplifications')}
SELECT a.id AS article_id, coalesce(c.text, CASE WHEN a.llm_category <> 'none' THEN 'made ' || a.id END) AS text, c.text IS NOT NULL AS from_cache
FROM articles a LEFT JOIN simplifications c ON c.article_id = a.id AND c.level = 'simple'""")
def _(v: Views):
    wanted = v.articles.select(col("id").alias("article_id"), F.lit("simple").alias("level"))
    made = v.articles.filter("llm_category <> 'none'")
    produced = made.select(col("id").alias("article_id"), F.lit("simple").alias("level"), F.concat(F.lit("made "), _text(col("id"))).alias("text"))
    return tables.fill_cache(v.simplifications, wanted, produced)[0].drop("level")


@query("snk_07_embedding_update", f"""{with_views('articles', 'vectors')}
SELECT a.id, {C.r("CASE WHEN a.llm_tier = 'A' THEN v.embedding[2] ELSE v.embedding[1] END")} AS first_value FROM articles a LEFT JOIN vectors v ON v.id = a.id""")
def _(v: Views):
    updates = v.embedded().filter("llm_tier = 'A' AND embedding IS NOT NULL").select("id", F.reverse(F.slice("embedding", 1, 2)).alias("embedding"))
    done = tables.update_columns(v.embedded(), updates, "id", ["embedding"])
    return done.select("id", F.get("embedding", F.lit(0)).alias("first_value"))


@query("snk_08_enrichment_update", f"""{ART}
SELECT id, CASE WHEN scrape_status = 'failed' THEN 'new ' || id ELSE full_text END AS full_text, CASE WHEN scrape_status = 'failed' THEN 'full' ELSE scrape_status END AS scrape_status FROM articles""")
def _(v: Views):
    updates = v.articles.filter("scrape_status = 'failed'").select("id", F.concat(F.lit("new "), _text(col("id"))).alias("full_text"), F.lit("full").alias("scrape_status"))
    return tables.update_columns(v.articles, updates, "id", ["full_text", "scrape_status"]).select("id", "full_text", "scrape_status")


@query("snk_09_retention", f"""{with_views('rejection_log')}
SELECT rejection_rule, count(*) FILTER (WHERE created_at < TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY) AS deleted,
 count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-02-15 00:00:00' - INTERVAL 30 DAY) AS kept FROM rejection_log GROUP BY rejection_rule""")
def _(v: Views):
    now = F.lit("2024-02-15 00:00:00").cast("timestamp")
    gone = tables.expired(now)
    return v.rejection_log.groupBy("rejection_rule").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))


@query("snk_10_follow_insert", f"""{with_views('follows')}
SELECT story_id, user_id FROM follows UNION ALL SELECT s.id AS story_id, NULL::BIGINT AS user_id FROM stories s WHERE s.id % 2 = 0
 AND NOT EXISTS (SELECT 1 FROM follows f WHERE f.story_id = s.id AND f.user_id IS NULL)""")
def _(v: Views):
    wanted = v.stories.filter(col("id") % 2 == 0).select(col("id").alias("story_id"), F.lit(None).cast("long").alias("user_id"))
    return tables.add_follows(v.follows, wanted, as_of()).select("story_id", "user_id")


@query("snk_11_delete_by_key", f"""{with_views('follows')}
SELECT story_id, user_id FROM follows WHERE NOT (story_id % 6 = 0 AND user_id IS NULL)""")
def _(v: Views):
    keys = v.stories.filter(col("id") % 6 == 0).select(col("id").alias("story_id"), F.lit(None).cast("long").alias("user_id"))
    return tables.delete_keys(v.follows, keys, ["story_id", "user_id"]).select("story_id", "user_id")


@query("snk_12_mark_seen", f"""{with_views('follows')}
SELECT story_id, user_id, {C.ts(f"CASE WHEN story_id % 2 = 1 AND user_id IS NULL THEN {C.AS_OF} ELSE last_seen_at END")} AS last_seen_at FROM follows""")
def _(v: Views):
    return tables.mark_seen(v.follows, v.stories.filter(col("id") % 2 == 1), as_of()).select("story_id", "user_id", "last_seen_at")


@query("snk_13_run_log", f"""{with_views('raw_articles')}
SELECT 1::BIGINT AS id, 'success' AS status, count(*) AS articles_fetched, count(*) FILTER (WHERE {C.rule()} IS NOT NULL) AS articles_filtered,
 count(*) FILTER (WHERE {C.rule()} IS NULL) AS articles_classified, NULL::VARCHAR AS error_message FROM raw_articles
UNION ALL SELECT 2::BIGINT, 'failed', NULL, NULL, NULL, 'source (' || count(*) || ') failed' FROM raw_articles""")
def _(v: Views):
    ruled = filters.with_rule(v.raw_articles, as_of())
    counts = ruled.agg(F.count(F.lit(1)).alias("n"), F.count_if(col("rule").isNotNull()).alias("bad")).first()
    ok = tables.run_row(1, as_of(), as_of(), {"articles_fetched": counts.n, "articles_filtered": counts.bad, "articles_classified": counts.n - counts.bad})
    failed = tables.run_row(2, as_of(), as_of(), {}, f"source (\u0000{counts.n}) failed")
    one = v.spark.range(1)
    return one.select(*ok).unionByName(one.select(*failed)).select("id", "status", "articles_fetched", "articles_filtered", "articles_classified", "error_message")


@query("snk_14_new_stories", f"""{with_views('articles', 'vectors')},
c AS (SELECT a.id, a.id // 20 * 20 AS seed_id FROM articles a JOIN vectors v ON v.id = a.id WHERE a.story_id IS NOT NULL),
n AS (SELECT seed_id, (SELECT max(story_id) FROM articles) + row_number() OVER (ORDER BY seed_id) AS id FROM (SELECT DISTINCT seed_id FROM c) d)
SELECT n.id, n.seed_id, count(*) AS article_count, {C.r('avg(v.embedding[5])')} AS centroid_5 FROM c JOIN n USING (seed_id) JOIN vectors v ON v.id = c.id GROUP BY n.id, n.seed_id""")
def _(v: Views):
    members = v.embedded().filter(col("embedding").isNotNull() & col("story_id").isNotNull())
    clusters = members.select("id", (F.floor(col("id") / 20) * 20).alias("seed_id"))
    old = v.articles.agg(F.max("story_id").alias("id"))
    rows, _assigned = tables.new_stories(clusters, members, old, as_of())
    return rows.select("id", "seed_id", "article_count", F.get("centroid", F.lit(4)).alias("centroid_5"))


# ---- the unified batch, for the model queries ----------------------------------------------

def unified_articles(v: Views):
    return landed.concat_sources(_unified(v))


_COMMON = "url, title, description, content, source_domain, published_at, api_category, api_iptc_category, api_sentiment, api_country, api_keywords, api_source_priority, api_relevance_score"
_CHECK_FIELDS = "WITH u AS (" + " UNION ALL ".join(
    f"SELECT {rank} AS source_rank, seq, {_COMMON}, {entities} AS entities FROM ({sql}) s{rank}"
    for rank, (sql, entities) in enumerate([
        (_SHARES[0], "''"), (_SHARES[1], "replace(entities, ':org:0', ' (org)')"), (_SHARES[2], "''"), (_SHARES[3], "''")])
) + """), fields AS (SELECT *, row_number() OVER (ORDER BY source_rank, seq) AS n, replace(api_keywords, '|', ', ') AS keywords,
 (coalesce(length(description), 0) + coalesce(length(content), 0)) AS ctx FROM u)"""
