"""Tables in the shape the operators work on, derived from the given parquet tables.

Each view is one SQL text for Spark and for the checking engine, or a pair where the dialects
differ. ``{name}`` refers to a given table or to another view.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_OF_SQL = "TIMESTAMP '2024-01-15 00:00:00'"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def as_of() -> Column:
    return F.lit("2024-01-15 00:00:00").cast("timestamp")


_ARTICLES = """
SELECT d.doc_id AS id,
 CASE d.doc_id % 4 WHEN 0 THEN 'worldnews' WHEN 1 THEN 'newsdata' WHEN 2 THEN 'webzio' ELSE 'thenewsapi' END AS source_api,
 'HTTPS://www.site' || CAST(CAST(floor(d.doc_id/10) AS BIGINT) % 7 AS VARCHAR(9)) || '.example.com/'
   || CASE d.doc_id % 25 WHEN 0 THEN 'sports/' WHEN 1 THEN 'travel/' ELSE 'news/' END
   || CAST(d.doc_id - CASE WHEN d.doc_id % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR(20)) || '/?utm=' || CAST(d.doc_id AS VARCHAR(20)) AS url,
 'site' || CAST(CAST(floor(d.doc_id/10) AS BIGINT) % 7 AS VARCHAR(9)) || '.example.com' AS source_domain,
 d.source AS source_name,
 split_part(split_part(d.text, chr(10), 1), '.', 1) AS title,
 CASE WHEN d.doc_id % 3 = 0 THEN split_part(d.text, chr(10), 1) END AS description,
 CASE WHEN d.doc_id % 3 <> 2 THEN d.text END AS content,
 CASE WHEN d.doc_id % 5 = 0 THEN d.text END AS full_text,
 CASE d.doc_id % 5 WHEN 0 THEN 'full' WHEN 1 THEN 'thin' WHEN 2 THEN 'failed' WHEN 3 THEN 'lookup' ELSE 'pending' END AS scrape_status,
 d.lang AS api_language,
 TIMESTAMP '2024-01-15 00:00:00' - (d.doc_id * 7 % 43200) * INTERVAL '1' MINUTE AS published_at,
 TIMESTAMP '2024-01-15 00:00:00' - (d.doc_id * 7 % 43200) * INTERVAL '1' MINUTE + INTERVAL '1' HOUR AS fetched_at,
 TIMESTAMP '2024-01-15 00:00:00' - (d.doc_id * 7 % 43200) * INTERVAL '1' MINUTE + INTERVAL '1' HOUR AS created_at,
 CASE WHEN l.doc_id IS NULL THEN 'B' WHEN l.quality=1 AND l.toxic=0 THEN 'A' WHEN l.quality=1 THEN 'B' WHEN l.toxic=0 THEN 'C' ELSE 'D' END AS llm_tier,
 CASE d.doc_id % 6 WHEN 0 THEN 'economics' WHEN 1 THEN 'policy' WHEN 2 THEN 'science' WHEN 3 THEN 'accountability' WHEN 4 THEN 'business' ELSE 'none' END AS llm_category,
 CASE WHEN l.doc_id IS NOT NULL AND l.quality=0 THEN 'rejected' ELSE 'accepted' END AS filter_status,
 CASE WHEN d.doc_id % 3 = 0 THEN 'india' ELSE 'global' END AS main_genre,
 CASE WHEN d.doc_id % 11 <> 0 THEN (d.doc_id*7919) % 15000 END AS api_source_priority,
 CASE WHEN d.doc_id % 13 <> 0 THEN (d.doc_id*37 % 100)/100.0E0 END AS importance_score,
 CASE WHEN d.doc_id % 17 <> 0 THEN d.doc_id % 20 END AS story_id,
 (d.doc_id % 29 = 0) AS api_duplicate_flag,
 CASE d.doc_id % 7 WHEN 0 THEN 'IN' WHEN 1 THEN 'in' WHEN 2 THEN 'india' WHEN 3 THEN 'us' END AS api_country,
 CASE WHEN d.doc_id % 3 <> 0 THEN (d.doc_id % 50) + 0.5E0 END AS api_relevance_score,
 CASE WHEN d.doc_id % 4 <> 0 THEN chr(10) || '• ' || split_part(d.text, chr(10), 1) || chr(10) || '-  ' || split_part(d.text, chr(10), 2)
   || chr(10) || '   ' || chr(10) || '*' || chr(10) || 'plain ' || split_part(d.text, chr(10), 3) END AS summary,
 d.text AS body
FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id
"""

# Variants of the article rows that touch every quality rule.
_RAW = """
SELECT id, source_api, url, description, published_at, llm_tier, api_source_priority, api_relevance_score, api_duplicate_flag, api_country,
 CASE id % 23
  WHEN 1 THEN 'India ' || CAST(id AS VARCHAR(20)) || '-1 win over rivals at home'
  WHEN 2 THEN 'Report ' || CAST(id AS VARCHAR(20)) || '-7 on the state of the economy'
  WHEN 3 THEN 'State vs Smith court ruling number ' || CAST(id AS VARCHAR(20))
  WHEN 4 THEN 'Mumbai vs Chennai tonight number ' || CAST(id AS VARCHAR(20))
  WHEN 5 THEN CAST(id AS VARCHAR(20)) || ' best things to know this year'
  WHEN 6 THEN 'Founder passed away after ' || CAST(id AS VARCHAR(20)) || ' days'
  WHEN 7 THEN 'Singer passed away after ' || CAST(id AS VARCHAR(20)) || ' days'
  WHEN 8 THEN 'BREAKING NEWS TODAY ' || CAST(id AS VARCHAR(20))
  WHEN 9 THEN substr(title, 1, 9)
  WHEN 10 THEN NULL
  WHEN 11 THEN 'Wordle ' || CAST(id AS VARCHAR(20)) || ' and the answer for today'
  WHEN 12 THEN 'Россия и мир ' || CAST(id AS VARCHAR(20)) || ' новости сегодня'
  WHEN 13 THEN CAST(id AS VARCHAR(20)) || ' killed in accident near the coast'
  ELSE title END AS title,
 CASE id % 19
  WHEN 1 THEN 'Global widgets and parts market size report ' || COALESCE(content, '') || body
  WHEN 2 THEN 'Press release: ' || body
  WHEN 3 THEN body || ' at a CAGR of 4.5% by 2030'
  WHEN 4 THEN body || ' Acme announces innovative gadget for all'
  WHEN 5 THEN ''
  WHEN 6 THEN title
  ELSE content END AS content,
 CASE id % 31 WHEN 1 THEN 'espn.com' WHEN 2 THEN 'tmz.com' WHEN 3 THEN 'prmedianow.com' WHEN 4 THEN 'www.ndtv.com'
  WHEN 5 THEN 'thehindu.com' WHEN 6 THEN NULL ELSE source_domain END AS source_domain,
 CASE id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'EN' WHEN 2 THEN 'English' WHEN 3 THEN api_language ELSE 'en' END AS api_language
FROM {articles}
"""

_STORIES = """
SELECT g.id, g.status, g.title, g.article_count, g.source_count, g.main_genre, g.llm_category, g.last_updated_at,
 g.importance_score FROM (
 SELECT story_id AS id, CASE WHEN story_id % 10 = 9 THEN 'frozen' ELSE 'active' END AS status,
  CASE WHEN story_id % 4 = 1 THEN '   ' WHEN story_id % 4 <> 0 THEN ' Story ' || CAST(story_id AS VARCHAR(9)) END AS title,
  count(*) AS article_count, count(DISTINCT source_name) AS source_count, max(main_genre) AS main_genre,
  max(llm_category) AS llm_category, max(published_at) AS last_updated_at,
  CASE WHEN story_id % 7 <> 0 THEN (story_id * 13 % 100) / 100.0E0 END AS importance_score
 FROM {articles} WHERE story_id IS NOT NULL GROUP BY story_id
 UNION ALL
 SELECT max(id) + 1000000 AS id, 'active' AS status, CAST(NULL AS VARCHAR(9)) AS title, CAST(0 AS BIGINT) AS article_count, CAST(0 AS BIGINT) AS source_count,
  CAST(NULL AS VARCHAR(9)) AS main_genre, CAST(NULL AS VARCHAR(9)) AS llm_category, max(published_at) AS last_updated_at, CAST(NULL AS DOUBLE) AS importance_score
 FROM {articles}) g
"""

_REJECTIONS = """
SELECT 'https://x.example.com/' || CAST(event_id AS VARCHAR(20)) AS url,
 CASE CAST(event_id % 13 AS INT) WHEN 0 THEN 'language' WHEN 1 THEN 'staleness' WHEN 2 THEN 'content_min' WHEN 3 THEN 'domain_blocklist'
  WHEN 4 THEN 'url_path' WHEN 5 THEN 'title_pattern' WHEN 6 THEN 'template' WHEN 7 THEN 'dedup_newsdata_flag' WHEN 8 THEN 'dedup_batch_url'
  WHEN 9 THEN 'dedup_exact' WHEN 10 THEN 'dedup_fuzzy' WHEN 11 THEN 'tier_c' ELSE 'tier_d' END AS rejection_rule,
 CASE WHEN event_id % 13 > 10 THEN 'llm' ELSE 'filter' END AS rejection_stage,
 event_id * 7 % 900 AS context_len, CAST(ts AS TIMESTAMP) AS created_at, event_id, user_id, event_type
FROM {events}
"""

_RUNS = """
SELECT min(CAST(ts AS TIMESTAMP)) AS started_at, CASE WHEN CAST(day(ts) AS INT) % 7 = 0 THEN 'failed' ELSE 'success' END AS status,
 count(*) AS articles_fetched, count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS articles_classified
FROM {events} GROUP BY CAST(ts AS DATE), day(ts)
"""

_FOLLOWS = """
SELECT id AS story_id, CAST(NULL AS BIGINT) AS user_id,
 CASE WHEN id % 2 = 0 THEN last_updated_at - INTERVAL '30' HOUR END AS last_seen_at, last_updated_at - INTERVAL '3' DAY AS followed_at
FROM {stories} WHERE id % 3 = 0
UNION ALL
SELECT id AS story_id, id + 500 AS user_id, CAST(NULL AS TIMESTAMP) AS last_seen_at, last_updated_at - INTERVAL '2' DAY AS followed_at
FROM {stories} WHERE id % 5 = 0
"""

_CACHE = """
SELECT id AS article_id, 'simple' AS level, 'cached ' || title AS text FROM {articles} WHERE id % 9 = 0
"""

_CANDIDATES = """
SELECT a.id AS article_id, CAST(0 AS BIGINT) AS pos, c.title AS title, c.body AS text
FROM {articles} a JOIN {articles} c ON c.id = a.id - a.id % 10 AND c.id <> a.id
UNION ALL
SELECT id AS article_id, CAST(1 AS BIGINT) AS pos, title || ' x' AS title, CASE WHEN id % 6 = 1 THEN title ELSE body END AS text
FROM {articles} WHERE id % 3 <> 0
UNION ALL
SELECT id AS article_id, CAST(2 AS BIGINT) AS pos, title || ' yz' AS title, body AS text FROM {articles} WHERE id % 2 = 0
"""

_MESSAGES = "SELECT conv_id, turn, role, text FROM {conversations}"

_RESPONSES = """
SELECT batch_id, n, CASE CAST(batch_id % 7 AS INT)
  WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
  WHEN 2 THEN substr(body, 1, length(body) - 1) || ',{{"tier":"A","category":"none","reason":"extra"}}]'
  WHEN 3 THEN 'I cannot answer: ' || body
  ELSE body END AS response
FROM (
 SELECT CAST(floor(doc_id / 5) AS BIGINT) AS batch_id, count(*) AS n, '[' || {JOIN} || ']' AS body
 FROM (
  SELECT doc_id, '{{"tier":"' || CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN 'X' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' ELSE 'A' END
   || '","category":"' || CASE CAST(doc_id % 9 AS INT) WHEN 0 THEN 'sports' WHEN 1 THEN 'policy' WHEN 2 THEN 'science' ELSE 'economics' END
   || CASE WHEN doc_id % 10 = 4 THEN '"' ELSE '","reason":"' || CASE WHEN doc_id % 8 = 0 THEN repeat('long reason ', 30) ELSE 'reason ' END || CAST(doc_id AS VARCHAR(20)) || '"' END
   || '}}' AS item FROM {documents}) q
 GROUP BY CAST(floor(doc_id / 5) AS BIGINT)) r
"""

SHARED = {
    "articles": _ARTICLES,
    "raw_articles": _RAW,
    "stories": _STORIES,
    "rejection_log": _REJECTIONS,
    "runs": _RUNS,
    "follows": _FOLLOWS,
    "simplifications": _CACHE,
    "lookup_candidates": _CANDIDATES,
    "messages": _MESSAGES,
    "keywords": "SELECT id, CASE WHEN id % 7 <> 0 THEN {KEYWORDS} END AS api_keywords FROM {articles}",
    "responses": _RESPONSES,
    "incoming": "SELECT * FROM {articles} WHERE published_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '1' DAY",
    "stored": "SELECT * FROM {articles} WHERE published_at < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL '1' DAY",
    "briefs": """
SELECT CAST(published_at AS DATE) AS brief_date, {ID_LIST} AS article_ids, CAST(NULL AS BIGINT) AS user_id
FROM (SELECT id, published_at, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY id * 37 % 101, id) AS rn FROM {articles}) q
WHERE rn <= 14 GROUP BY CAST(published_at AS DATE)
""",
}

# Expressions that the dialects spell differently.
_SPARK_WORDS = {
    "KEYWORDS": "filter(split(lower(title), '[^a-z]+'), w -> length(w) > 3)",
    "JOIN": "array_join(transform(sort_array(collect_list(struct(doc_id, item))), x -> x.item), ',')",
    "ID_LIST": "concat(transform(sort_array(collect_list(struct(rn, id))), x -> x.id), array(1000000 + max(id)))",
}
_CHECK_WORDS = {
    "KEYWORDS": "list_filter(regexp_split_to_array(lower(title), '[^a-z]+'), lambda w: length(w) > 3)",
    "JOIN": "string_agg(item, ',' ORDER BY doc_id)",
    "ID_LIST": "list_concat(list(id ORDER BY rn), [1000000 + max(id)])",
}

_SPARK_VECTORS = """
SELECT a.vec_id AS id, zip_with(zip_with(t.embedding, m.embedding, (x,y) -> CAST(x AS DOUBLE) + 0.5D*CAST(y AS DOUBLE)), a.embedding, (x,y) -> x + 0.5D*CAST(y AS DOUBLE)) AS embedding
FROM {embeddings} a JOIN {embeddings} t ON t.vec_id = a.vec_id % 20 JOIN {embeddings} m ON m.vec_id = 100 + (a.vec_id*7) % 60
"""
_CHECK_VECTORS = """
SELECT a.vec_id AS id, list_transform(range(1, 65), lambda i: CAST(t.embedding[i] AS DOUBLE) + 0.5E0*CAST(m.embedding[i] AS DOUBLE) + 0.5E0*CAST(a.embedding[i] AS DOUBLE)) AS embedding
FROM embeddings a JOIN embeddings t ON t.vec_id = a.vec_id % 20 JOIN embeddings m ON m.vec_id = 100 + (a.vec_id*7) % 60
"""
_CHECK_CENTROIDS = """
SELECT story_id, list(m ORDER BY i) AS centroid, max(n) AS n FROM (
 SELECT a.story_id, u.i, avg(v.embedding[u.i]) AS m, count(*) AS n
 FROM articles a JOIN vectors v ON v.id = a.id, (SELECT unnest(range(1, 65)) AS i) u
 WHERE a.story_id IS NOT NULL GROUP BY a.story_id, u.i) q GROUP BY story_id
"""
CHECK_ONLY = {"vectors": _CHECK_VECTORS, "centroids": _CHECK_CENTROIDS}


class Views:
    """The views of one scale folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name == "vectors":
            return self.spark.sql(_SPARK_VECTORS, embeddings=self.embeddings)
        text = SHARED[name]
        for word, sql in _SPARK_WORDS.items():
            text = text.replace("{" + word + "}", sql)
        return self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})

    def embedded(self, name: str = "articles") -> DataFrame:
        return getattr(self, name).join(self.vectors, "id", "left")


def _names(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{([a-z_]+)\}", text)))


def _check_text(name: str) -> str:
    text = SHARED.get(name) or CHECK_ONLY[name]
    for word, sql in _CHECK_WORDS.items():
        text = text.replace("{" + word + "}", sql)
    return text


def _needs(name: str) -> list[str]:
    return [n for n in _names(_check_text(name)) if n not in TABLES] if name in SHARED else (
        ["articles", "vectors"] if name == "centroids" else [])


def with_views(*names: str, recursive: bool = False) -> str:
    """A WITH clause that defines the views and what they rest on."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _needs(name):
            visit(n)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        text = _check_text(n)
        if n in SHARED:
            text = text.format(**{t: t for t in _names(text)})
        parts.append(f"{n} AS ({text.strip()})")
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)


# ---- results ----------------------------------------------------------------------------

def _tidy(name: str, dtype: T.DataType) -> Column:
    c = F.col(name)
    if isinstance(dtype, (T.IntegerType, T.ShortType, T.ByteType)):
        c = c.cast("long")
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        c = F.round(c.cast("double"), 9) + F.lit(0.0)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif isinstance(dtype, T.DateType):
        c = c.cast("string")
    elif isinstance(dtype, T.ArrayType):
        c = F.array_join(F.transform(c, lambda x: x.cast("string")), "|")
    return c.alias(name)


def tidy(df: DataFrame) -> DataFrame:
    """Comparable result columns: long integers, rounded doubles, times and lists as text."""
    return df.select(*[_tidy(f.name, f.dataType) for f in df.schema.fields])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
