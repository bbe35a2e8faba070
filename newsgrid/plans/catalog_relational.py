"""Queries of joins, aggregations, windows, sorts and set operations (JOI, AGG, WIN, TOP, SET)."""

from pyspark.sql import functions as F

from .. import config
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import brief, dedup, feed, filters, keyfilter, metrics, modelio, numbering, similarity, stories, storystate, textjobs, timeline
from ..session import cut
from ..sources import feeds, landed, tables
from . import check_sql as C
from .catalog_scans import PAGE, PAGES, _SOURCES, _backfill, _BACKFILL, _ALL_SOURCES, _WHOLE_SOURCES, source_pages
from .registry import query
from .views import Views, as_of, union_all, with_views

col = F.col
ART = with_views("articles")
VEC = with_views("articles", "vectors")


# ---- shared pieces ------------------------------------------------------------------------

def _story_states(v: Views):
    """Stories with centroid and keywords."""
    cent = stories.group_centroids(v.embedded()).select(col("story_id").alias("id"), "centroid")
    kws = v.articles.filter("story_id IS NOT NULL").groupBy(col("story_id").alias("id")).agg(F.min("id").alias("first_id"))
    kws = kws.join(v.keywords.select(col("id").alias("first_id"), col("api_keywords").alias("keyword_set")), "first_id").drop("first_id")
    return v.stories.join(cent, "id", "left").join(kws, "id", "left")


_STATES = f"""story_kw AS (SELECT f.id, k.api_keywords AS keyword_set FROM (SELECT story_id AS id, min(id) AS first_id FROM articles WHERE story_id IS NOT NULL GROUP BY 1) f JOIN keywords k ON k.id = f.first_id),
story_recent AS (SELECT story_id, rn, embedding FROM (SELECT a.story_id, v.embedding, row_number() OVER (PARTITION BY a.story_id ORDER BY a.published_at DESC, a.id) AS rn
 FROM stored a JOIN vectors v ON v.id = a.id WHERE a.story_id IS NOT NULL) q WHERE rn <= 10),
story_vec AS (SELECT s.id AS story_id, r.embedding FROM stories s JOIN centroids c ON c.story_id = s.id JOIN story_recent r ON r.story_id = s.id WHERE s.status = 'active' AND s.last_updated_at >= {C.AS_OF} - INTERVAL 14 DAY
 UNION ALL SELECT s.id AS story_id, c.centroid AS embedding FROM stories s JOIN centroids c ON c.story_id = s.id WHERE s.status = 'active' AND s.last_updated_at >= {C.AS_OF} - INTERVAL 14 DAY
 AND (SELECT count(*) FROM story_recent r WHERE r.story_id = s.id) < 10)"""


# ---- JOI --------------------------------------------------------------------------------

@query("joi_01_brief_candidates", f"""{with_views('stories')}
SELECT a.id, a.title, a.story_id, a.llm_tier, {C.r('s.importance_score')} AS story_importance, s.article_count AS story_article_count
FROM articles a LEFT JOIN stories s ON s.id = a.story_id WHERE a.filter_status = 'accepted' AND a.id IN (SELECT doc_id FROM labels)""")
def _(v: Views):
    ids = v.labels.select(col("doc_id").alias("id"))
    return brief.candidates(v.articles, v.stories, ids).select("id", "title", "story_id", "llm_tier", "story_importance", "story_article_count")


@query("joi_02_followed_stories", f"""{with_views('follows')}
SELECT f.story_id, s.title AS story_title, s.article_count, s.llm_category, {C.ts('s.last_updated_at')} AS last_updated_at,
 {C.ts('f.last_seen_at')} AS last_seen_at FROM follows f JOIN stories s ON s.id = f.story_id WHERE f.user_id IS NULL""")
def _(v: Views):
    rows = timeline.followed_stories(v.follows, v.stories).orderBy(col("last_updated_at").desc(), "story_id")
    return rows.select("story_id", "story_title", "article_count", "llm_category", "last_updated_at", "last_seen_at")


@query("joi_03_is_followed", f"""{with_views('follows')}
SELECT s.id, EXISTS (SELECT 1 FROM follows f WHERE f.story_id = s.id AND f.user_id IS NULL) AS followed FROM stories s""")
def _(v: Views):
    return timeline.followed_flags(v.stories, v.follows)


_SCHEMA_HASHED = f"inc AS (SELECT *, {C.hashes()} FROM incoming), sto AS (SELECT *, {C.hashes()} FROM stored)"
_EXACT = f"""inc_live.normalized_url_hash IN (SELECT normalized_url_hash FROM sto_recent) OR inc_live.domain_title_hash IN (SELECT domain_title_hash FROM sto_recent)
 OR inc_live.title_hash IN (SELECT title_hash FROM sto_recent)"""


@query("joi_04_exact_stored_match", f"""{with_views('incoming', 'stored')}, {_SCHEMA_HASHED}, inc_live AS (SELECT * FROM inc),
sto_recent AS (SELECT * FROM sto WHERE published_at > {C.AS_OF} - INTERVAL 7 DAY) SELECT id FROM inc_live WHERE {_EXACT}""")
def _(v: Views):
    return dedup.stored_matches(dedup.article_hashes(v.incoming), dedup.article_hashes(v.stored), as_of(), "id")


# The same rows by way of stored filters, of which the second half of the articles was added later.
@query("joi_04_exact_stored_match_filtered", f"""{with_views('incoming', 'stored')}, {_SCHEMA_HASHED}, inc_live AS (SELECT * FROM inc),
sto_recent AS (SELECT * FROM sto WHERE published_at > {C.AS_OF} - INTERVAL 7 DAY) SELECT id FROM inc_live WHERE {_EXACT}""")
def _(v: Views):
    stored = cut(dedup.article_hashes(v.stored))
    none = v.spark.createDataFrame([], keyfilter.SCHEMA)
    first = cut(dedup.hash_filters(none, stored.filter("id % 2 = 0")))
    later = dedup.hash_filters(first, stored.filter("id % 2 <> 0"))
    kept = cut(later.unionByName(first.join(later.select("day").distinct(), "day", "left_anti")))
    return dedup.stored_matches(dedup.article_hashes(v.incoming), stored, as_of(), "id", filters=kept)


def _greedy_check(rows: str) -> str:
    """Recursive greedy over ``rows`` (id, title): the list of surviving ids."""
    return f"""
tg AS (SELECT row_number() OVER (ORDER BY id) AS k, id, {C.grams('title')} AS g FROM {rows}),
tok AS (SELECT k, unnest(g) AS t, len(g) AS n FROM tg),
hit AS (SELECT a.k AS lo, b.k AS hi FROM tok a JOIN tok b ON a.t = b.t AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING count(*)::DOUBLE / (a.n + b.n - count(*)) > 0.7),
low AS (SELECT tg.k, tg.id, coalesce(h.l, []::BIGINT[]) AS l FROM tg LEFT JOIN (SELECT hi, list(lo) AS l FROM hit GROUP BY hi) h ON h.hi = tg.k),
walk(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
 SELECT low.k, CASE WHEN list_has_any(walk.kept, low.l) THEN walk.kept ELSE list_append(walk.kept, low.k) END FROM walk JOIN low ON low.k = walk.k + 1),
fin AS (SELECT unnest(kept) AS k FROM walk WHERE k = (SELECT max(k) FROM tg))"""


@query("joi_05_fuzzy_titles", f"""{with_views('articles', recursive=True)}, {_greedy_check('articles')}
SELECT low.id FROM fin JOIN low USING (k)""")
def _(v: Views):
    return dedup.fuzzy_survivors(v.articles, "id")


# Every group of more than four rows goes the way of the hot ones.
@query("joi_05_fuzzy_titles_hot", f"""{with_views('articles', recursive=True)}, {_greedy_check('articles')}
SELECT low.id FROM fin JOIN low USING (k)""")
def _(v: Views):
    return dedup.fuzzy_survivors(v.articles, "id", split_rows=4)


def _match_input(v: Views):
    windows = similarity.story_windows(_story_states(v), v.embedded("stored"), as_of())
    articles = v.embedded("incoming").join(v.keywords, "id").select("id", "embedding", F.coalesce("api_keywords", F.array().cast("array<string>")).alias("keywords"))
    return articles, windows


@query("joi_06_story_match_snapshot", f"""{with_views('incoming', 'stored', 'stories', 'centroids', 'keywords')}, {_STATES},
sims AS (SELECT a.id, s.story_id, max({C.cos('v.embedding', 's.embedding')}) AS sim FROM incoming a JOIN vectors v ON v.id = a.id, story_vec s GROUP BY a.id, s.story_id),
scored AS (SELECT q.id, q.story_id, CASE WHEN coalesce(len(k.api_keywords), 0) = 0 OR coalesce(len(sk.keyword_set), 0) = 0 THEN q.sim
 ELSE q.sim * 0.65 + least(len(list_filter(k.api_keywords[1:8], lambda w: list_contains(sk.keyword_set, w))) / 4.0, 1.0) * 0.35 END AS score
 FROM sims q LEFT JOIN keywords k ON k.id = q.id LEFT JOIN story_kw sk ON sk.id = q.story_id)
SELECT id, story_id, {C.r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, story_id) AS rn FROM scored) z WHERE rn = 1 AND score >= 0.75""")
def _(v: Views):
    return similarity.match_snapshot(*_match_input(v))


# The walk keeps, per story in id order, the numbers of the vectors in its window: below zero those it starts with, above the articles it took.
@query("joi_06_story_match", f"""{with_views('incoming', 'stored', 'stories', 'centroids', 'keywords', recursive=True)}, {_STATES},
live AS (SELECT s.id AS story_id, c.centroid, (SELECT count(*) FROM story_recent r WHERE r.story_id = s.id) AS n FROM stories s JOIN centroids c ON c.story_id = s.id
 WHERE s.status = 'active' AND s.last_updated_at >= {C.AS_OF} - INTERVAL 14 DAY),
refs AS (SELECT story_id, pos, embedding, -row_number() OVER (ORDER BY story_id, pos) AS ref FROM (SELECT l.story_id, r.rn AS pos, r.embedding FROM live l JOIN story_recent r ON r.story_id = l.story_id
 UNION ALL SELECT story_id, 0, centroid FROM live WHERE n < 10) q),
n AS (SELECT row_number() OVER (ORDER BY a.id) AS k, a.id, v.embedding, w.api_keywords[1:8] AS words FROM incoming a JOIN vectors v ON v.id = a.id JOIN keywords w ON w.id = a.id WHERE v.embedding IS NOT NULL),
points AS (SELECT ref, embedding FROM refs UNION ALL SELECT k, embedding FROM n),
sims AS (SELECT n.k, map(list(p.ref ORDER BY p.ref), list({C.cos('n.embedding', 'p.embedding')} ORDER BY p.ref)) AS m FROM n JOIN points p ON p.ref < n.k GROUP BY n.k),
shared AS (SELECT n.k, map(list(l.story_id ORDER BY l.story_id), list(CASE WHEN coalesce(len(n.words), 0) = 0 OR coalesce(len(w.keyword_set), 0) = 0 THEN -1.0
 ELSE least(len(list_filter(n.words, lambda x: list_contains(w.keyword_set, x))) / 4.0, 1.0) END::DOUBLE ORDER BY l.story_id)) AS part FROM n CROSS JOIN live l LEFT JOIN story_kw w ON w.id = l.story_id GROUP BY n.k),
walk(k, st, story, score) AS (SELECT 0::BIGINT, (SELECT list({{'s': story_id, 'r': r}} ORDER BY story_id) FROM (SELECT story_id, list(ref ORDER BY pos) AS r FROM refs GROUP BY story_id) q), NULL::BIGINT, NULL::DOUBLE UNION ALL
 SELECT k, CASE WHEN best.score >= 0.75 THEN list_transform(st, lambda x: CASE WHEN x.s = -best.neg THEN {{'s': x.s, 'r': list_append(x.r, k)[greatest(1, len(x.r) - 8):]}} ELSE x END) ELSE st END,
  CASE WHEN best.score >= 0.75 THEN -best.neg END, best.score FROM (
  SELECT n.k, w.st, list_max(list_transform(w.st, lambda x: {{'score': CASE WHEN h.part[x.s] < 0 THEN list_max(list_transform(x.r, lambda y: s.m[y]))
    ELSE list_max(list_transform(x.r, lambda y: s.m[y])) * 0.65 + h.part[x.s] * 0.35 END, 'neg': -x.s}})) AS best
  FROM walk w JOIN n ON n.k = w.k + 1 JOIN sims s ON s.k = n.k JOIN shared h ON h.k = n.k) z)
SELECT n.id, walk.story AS story_id, {C.r('walk.score')} AS score FROM walk JOIN n ON n.k = walk.k WHERE walk.story IS NOT NULL""")
def _(v: Views):
    return similarity.match_sequential(*_match_input(v))


# The list walk keeps, per cluster in creation order, its first member and its last ten.
@query("joi_07_cluster_articles", f"""{with_views('vectors', recursive=True)},
n AS (SELECT row_number() OVER (ORDER BY id) AS k, id, embedding FROM vectors),
sim AS (SELECT a.k AS hi, b.k AS lo, {C.cos('a.embedding', 'b.embedding')} AS s FROM n a JOIN n b ON b.k < a.k),
near AS (SELECT hi, map(list(lo ORDER BY lo), list(s ORDER BY lo)) AS m FROM sim WHERE s >= 0.70 GROUP BY hi),
walk(k, cs) AS (SELECT 0::BIGINT, []::BIGINT[][] UNION ALL
 SELECT k, CASE WHEN best IS NULL THEN list_append(cs, [k]) ELSE list_transform(cs, lambda c: CASE WHEN c[1] = best THEN list_append(c, k) ELSE c END) END FROM (
  SELECT n.k, w.cs, list_reduce(list_prepend(NULL::DOUBLE[], list_transform(list_filter(w.cs, lambda c: list_contains(map_keys(nr.m), c[1])), lambda c:
     [c[1]::DOUBLE, coalesce(list_max(list_transform(list_filter(c[greatest(1, len(c) - 9):], lambda x: nr.m[x] >= 0.80), lambda x: nr.m[x])), -1)])),
    lambda acc, e: CASE WHEN e[2] >= 0.80 AND (acc IS NULL OR e[2] > acc[2]) THEN e ELSE acc END)[1]::BIGINT AS best
  FROM walk w JOIN n ON n.k = w.k + 1 LEFT JOIN near nr ON nr.hi = n.k) z),
fin AS (SELECT c[1] AS seed, unnest(c) AS k FROM (SELECT unnest(cs) AS c FROM walk WHERE k = (SELECT max(k) FROM n)) y)
SELECT n.id, s.id AS seed_id FROM fin JOIN n ON n.k = fin.k JOIN n s ON s.k = fin.seed""")
def _(v: Views):
    return similarity.cluster_articles(v.vectors)


@query("joi_08_title_lookup", f"""{with_views('lookup_candidates')},
p AS (SELECT a.id, c.pos, c.text, {C.grams('c.title')} AS g1, {C.grams('a.title')} AS g2 FROM lookup_candidates c JOIN articles a ON a.id = c.article_id WHERE a.source_api <> 'worldnews' AND length(c.text) >= 200)
SELECT id, arg_min(text, pos) AS lookup_text FROM p WHERE {C.jaccard('g1', 'g2')} > 0.75 GROUP BY id""")
def _(v: Views):
    return textjobs.lookup_text(v.articles, v.lookup_candidates)


_COOL = f"cool AS (SELECT source_domain, count(*) AS failures FROM arts WHERE scrape_status = 'failed' AND fetched_at >= {C.AS_OF} - INTERVAL 48 HOUR GROUP BY source_domain HAVING count(*) >= 5)"
_ARTS = "arts AS (SELECT * REPLACE (CASE WHEN id % 30 = 0 THEN NULL WHEN id % 30 = 1 THEN '' ELSE 'd' || (id % 97) || '.example.com' END AS source_domain) FROM articles)"


def _many_domains(v: Views):
    return v.articles.withColumn("source_domain", F.when(col("id") % 30 == 1, F.lit("")).when(
        col("id") % 30 != 0, F.concat(F.lit("d"), (col("id") % 97).cast("string"), F.lit(".example.com"))))


@query("joi_09_cooldown", f"""{ART}, {_ARTS}, cool AS (SELECT source_domain FROM arts WHERE scrape_status = 'failed' AND fetched_at >= {C.AS_OF} - INTERVAL 480 HOUR GROUP BY source_domain HAVING count(*) >= 3)
SELECT id FROM arts WHERE source_domain IS NULL OR source_domain = '' OR source_domain NOT IN (SELECT source_domain FROM cool WHERE source_domain IS NOT NULL)""")
def _(v: Views):
    rows = _many_domains(v)
    return metrics.without_cooldown(rows, metrics.failing_domains(rows, as_of(), hours=480, failures=3)).select("id")


@query("joi_10_source_resolution", f"""WITH s AS ({_SOURCES} documents), b AS (SELECT event_id, url, title, source_name FROM ({_BACKFILL}, ts FROM events) q),
bd AS (SELECT {C.host("CASE WHEN regexp_matches(base_url, '^https?://') THEN base_url ELSE 'https://' || base_url END")} AS d, min(source_id) AS id FROM s GROUP BY 1),
bn AS (SELECT lower(name) AS n, max(source_id) AS id FROM s GROUP BY 1)
SELECT b.event_id, coalesce(bd.id, bn.id) AS source_id FROM b LEFT JOIN bd ON bd.d = {C.host('b.url')} LEFT JOIN bn ON bn.n = lower(b.source_name)""")
def _(v: Views):
    sources = v.spark.sql(_SOURCES + " {documents}", documents=v.documents)
    return feeds.resolve_sources(_backfill(v), sources).select("event_id", "source_id")


@query("joi_11_ordered_lookup", f"""{with_views('briefs')},
b AS (SELECT brief_date, unnest(article_ids) AS id, generate_subscripts(article_ids, 1) - 1 AS pos FROM briefs)
SELECT strftime(b.brief_date, '%Y-%m-%d') AS brief_date, b.pos::BIGINT AS pos, b.id, coalesce(a.title, 'Untitled') AS title, {C.bullets('a.summary')} AS bullets, a.story_id,
 coalesce(a.source_name, 'Unknown') AS source_name, coalesce(a.llm_category, 'News') AS category, {C.time_ago('a.published_at')} AS time_ago FROM b LEFT JOIN articles a ON a.id = b.id""")
def _(v: Views):
    return feed.brief_articles(v.briefs, v.articles, as_of())


@query("joi_12_story_page", f"""{with_views('stories')}
SELECT s.id AS story_id, s.article_count, a.id, a.title, row_number() OVER (PARTITION BY s.id ORDER BY a.published_at DESC, a.id) AS pos FROM stories s JOIN articles a ON a.story_id = s.id""")
def _(v: Views):
    return stories.story_pages(v.stories, v.articles)


_PARSED = f"""resp AS (SELECT batch_id, n, regexp_replace(regexp_replace(response, '^```(?:json)?\\n?', ''), '\\n?```$', '') AS t FROM responses),
judged AS (SELECT *, CASE WHEN NOT coalesce(json_valid(t), false) THEN 'llm_parse_error' WHEN json_array_length(t::JSON) <> n THEN 'llm_count_mismatch' END AS failure FROM resp),
slots AS (SELECT *, unnest(generate_series(0, n - 1)) AS pos FROM judged),
picked AS (SELECT batch_id, pos, failure, CASE WHEN failure IS NULL THEN json_extract(t::JSON, '$[' || pos || ']') END AS r FROM slots),
parsed AS (SELECT batch_id, pos::BIGINT AS pos, CASE WHEN r->>'tier' IN ('A', 'B', 'C', 'D') THEN r->>'tier' ELSE 'C' END AS llm_tier,
 CASE WHEN r->>'category' IN ('economics', 'policy', 'science', 'accountability', 'business', 'none') THEN r->>'category' ELSE 'none' END AS llm_category,
 coalesce(failure, substr(r->>'reason', 1, 200), 'no_reason') AS llm_reason FROM picked)"""


@query("joi_13_result_merge", f"""{with_views('responses', 'articles')}, {_PARSED}
SELECT a.id, p.llm_tier, p.llm_category FROM articles a JOIN parsed p ON p.batch_id = a.id // 5 AND p.pos = a.id % 5""")
def _(v: Views):
    batched = numbering.batch_number(v.articles.select("id"), "id", config.CLASSIFY_BATCH)
    return modelio.merge_results(batched, modelio.parse_classification(v.responses)).select("id", "llm_tier", "llm_category")


@query("joi_14_brief_stories", f"""{with_views('briefs')}
SELECT DISTINCT a.story_id FROM articles a WHERE a.story_id IS NOT NULL AND a.id IN (SELECT unnest(article_ids) FROM briefs)""")
def _(v: Views):
    picks = v.briefs.select(F.explode("article_ids").alias("id"))
    return brief.brief_stories(v.articles, picks)


# ---- AGG --------------------------------------------------------------------------------

_ARTICLE_STATS = ", ".join(
    ["count(*) FILTER (WHERE filter_status = 'accepted') AS total_accepted", "count(*) FILTER (WHERE filter_status = 'rejected') AS total_rejected_llm"]
    + [f"count(*) FILTER (WHERE llm_tier = '{t}') AS tier_{t.lower()}_count" for t in config.TIERS]
    + [f"count(*) FILTER (WHERE filter_status = 'accepted' AND llm_category = '{c}') AS {c}_count" for c in config.FEED_CATEGORIES])
_REJ_STATS = ", ".join(
    [f"count(*) FILTER (WHERE rejection_rule = '{rule}') AS {name}" for name, rule in metrics._RULE_METRICS.items()]
    + ["count(*) FILTER (WHERE rejection_rule LIKE 'dedup%') AS filtered_dedup", "count(*) AS total_filtered"])
_RUN_STATS = """coalesce(sum(articles_fetched), 0)::BIGINT AS total_fetched, coalesce(sum(articles_classified), 0)::BIGINT AS total_to_llm,
 coalesce(sum(articles_classified) FILTER (WHERE status = 'success'), 0)::BIGINT AS llm_requests_used, count(*) FILTER (WHERE status = 'failed') AS llm_errors"""


def _daily(stats: str, table: str, ts: str) -> str:
    return f"SELECT {ts}::DATE AS d, {stats} FROM {table} WHERE {ts} <= date_trunc('day', {ts}) + INTERVAL 86399 SECOND GROUP BY 1"


@query("agg_01_article_stats", f"{ART}, q AS ({_daily(_ARTICLE_STATS, 'articles', 'created_at')}) SELECT strftime(d, '%Y-%m-%d') AS date, * EXCLUDE (d) FROM q")
def _(v: Views):
    return metrics.article_stats(v.articles)


@query("agg_02_rejection_stats", f"{with_views('rejection_log')}, q AS ({_daily(_REJ_STATS, 'rejection_log', 'created_at')}) SELECT strftime(d, '%Y-%m-%d') AS date, * EXCLUDE (d) FROM q")
def _(v: Views):
    return metrics.rejection_stats(v.rejection_log)


@query("agg_03_run_stats", f"{with_views('runs')}, q AS ({_daily(_RUN_STATS, 'runs', 'started_at')}) SELECT strftime(d, '%Y-%m-%d') AS date, * EXCLUDE (d) FROM q")
def _(v: Views):
    return metrics.run_stats(v.runs)


_METRIC_NAMES = [*metrics.ARTICLE_METRICS, *metrics.REJECTION_METRICS, *metrics.RUN_METRICS]


@query("agg_04_daily_metrics", f"""{with_views('articles', 'rejection_log', 'runs')}, a AS ({_daily(_ARTICLE_STATS, 'articles', 'created_at')}),
r AS ({_daily(_REJ_STATS, 'rejection_log', 'created_at')}), p AS ({_daily(_RUN_STATS, 'runs', 'started_at')})
SELECT strftime(d, '%Y-%m-%d') AS date, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _METRIC_NAMES)}, coalesce(filtered_dedup, 0) AS total_deduplicated
FROM a FULL JOIN r USING (d) FULL JOIN p USING (d)""")
def _(v: Views):
    return metrics.daily_metrics(v.articles, v.rejection_log, v.runs)


@query("agg_05_source_count", f"{ART} SELECT story_id, count(DISTINCT source_name) AS source_count FROM articles WHERE story_id IS NOT NULL GROUP BY story_id")
def _(v: Views):
    return stories.source_counts(v.articles)


@query("agg_05_source_estimate", f"""{ART} SELECT story_id, count(DISTINCT source_name) AS source_count, true AS within_bound FROM articles WHERE story_id IS NOT NULL GROUP BY story_id""")
def _(v: Views):
    days = stories.source_sketches(v.articles.withColumn("day", F.to_date("published_at")))
    near = stories.source_estimates(days).join(stories.source_counts(v.articles), "story_id")
    error = F.abs(col("source_estimate") - col("source_count"))
    return near.select("story_id", "source_count", (error <= F.greatest(F.lit(1.0), stories.SKETCH_ERROR * col("source_count"))).alias("within_bound"))


@query("agg_06_majority", f"""{ART}, g AS (SELECT story_id, main_genre, count(*) AS n FROM articles WHERE story_id IS NOT NULL AND main_genre IS NOT NULL GROUP BY 1, 2),
c AS (SELECT story_id, llm_category, count(*) AS n FROM articles WHERE story_id IS NOT NULL AND filter_status = 'accepted' GROUP BY 1, 2)
SELECT story_id, g.main_genre, c.llm_category FROM (SELECT story_id, main_genre, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, main_genre) AS rn FROM g) g
JOIN (SELECT story_id, llm_category, row_number() OVER (PARTITION BY story_id ORDER BY n DESC, llm_category) AS rn FROM c) c USING (story_id) WHERE g.rn = 1 AND c.rn = 1""")
def _(v: Views):
    genre = stories.majority(v.articles, "main_genre")
    return genre.join(stories.majority(v.articles, "llm_category", col("filter_status") == "accepted"), "story_id")


@query("agg_07_failing_domains", f"""{ART}, {_ARTS}
SELECT source_domain, count(*) AS failures FROM arts WHERE scrape_status = 'failed' AND fetched_at >= {C.AS_OF} - INTERVAL 96 HOUR GROUP BY source_domain HAVING count(*) >= 2""")
def _(v: Views):
    return metrics.failing_domains(_many_domains(v), as_of(), hours=96, failures=2)


@query("agg_08_vector_mean", f"""{VEC}
SELECT a.story_id, u.i - 1 AS pos, {C.r('avg(v.embedding[u.i])')} AS value FROM articles a JOIN vectors v ON v.id = a.id, (SELECT unnest(range(1, 65)) AS i) u
WHERE a.story_id IS NOT NULL GROUP BY a.story_id, u.i""")
def _(v: Views):
    return stories.group_centroids(v.embedded()).select("story_id", F.posexplode("centroid").alias("pos", "value"))


@query("agg_09_weighted_centroid", f"""{with_views('incoming', 'stored', 'vectors')},
o AS (SELECT a.story_id, u.i, avg(v.embedding[u.i]) AS m, count(*) AS n FROM stored a JOIN vectors v ON v.id = a.id, (SELECT unnest(range(1, 65)) AS i) u WHERE a.story_id IS NOT NULL GROUP BY 1, 2),
w AS (SELECT a.story_id, u.i, sum(v.embedding[u.i]) AS s, count(*) AS k FROM incoming a JOIN vectors v ON v.id = a.id, (SELECT unnest(range(1, 65)) AS i) u WHERE a.story_id IS NOT NULL GROUP BY 1, 2)
SELECT o.story_id AS id, o.i - 1 AS pos, {C.r('CASE WHEN w.s IS NULL THEN o.m ELSE (o.m * o.n + w.s) / (o.n + w.k) END')} AS value, o.n + coalesce(w.k, 0) AS article_count FROM o LEFT JOIN w USING (story_id, i)""")
def _(v: Views):
    old = stories.group_centroids(v.embedded("stored")).select(col("story_id").alias("id"), "centroid", col("n").alias("article_count"))
    added = v.embedded("incoming").filter("story_id IS NOT NULL")
    return stories.merge_centroids(old, added).select("id", F.posexplode("centroid").alias("pos", "value"), "article_count")


# Stories of every size class: most articles share large stories, some form small ones.
def _sized(v: Views):
    story = F.when(col("id") % 4 == 0, 1_000_000 + F.floor(col("id") / 8)).when(col("id") % 4 == 1, 2_000_000 + F.floor(col("id") / 16)).otherwise(col("story_id"))
    return v.articles.withColumn("story_id", story).join(v.keywords, "id", "left")


_SIZED = "sized AS (SELECT a.* REPLACE (CASE WHEN a.id % 4 = 0 THEN 1000000 + a.id // 8 WHEN a.id % 4 = 1 THEN 2000000 + a.id // 16 ELSE a.story_id END AS story_id), k.api_keywords FROM articles a LEFT JOIN keywords k ON k.id = a.id)"


@query("agg_10_story_keywords", f"""{with_views('articles', 'keywords')}, {_SIZED},
n AS (SELECT story_id, count(*) AS n FROM sized WHERE story_id IS NOT NULL GROUP BY 1),
o AS (SELECT s.*, n.n, row_number() OVER (PARTITION BY s.story_id ORDER BY s.importance_score DESC NULLS LAST, s.id) AS ord,
 row_number() OVER (PARTITION BY s.story_id ORDER BY coalesce(s.importance_score, 0) DESC, s.importance_score DESC NULLS LAST, s.id) AS rep FROM sized s JOIN n USING (story_id)),
w AS (SELECT story_id, n, ord, unnest(api_keywords) AS kw, generate_subscripts(api_keywords, 1) AS pos FROM o),
few AS (SELECT story_id, kw, row_number() OVER (PARTITION BY story_id ORDER BY f) AS rn FROM (SELECT story_id, kw, min(ord * 100 + pos) AS f FROM w WHERE n BETWEEN 3 AND 5 GROUP BY 1, 2) z),
many AS (SELECT story_id, kw, row_number() OVER (PARTITION BY story_id ORDER BY c DESC, f) AS rn FROM (SELECT story_id, kw, count(*) AS c, min(ord * 100 + pos) AS f FROM w WHERE n > 5 GROUP BY 1, 2 HAVING count(*) >= 2) z)
SELECT story_id, array_to_string(coalesce(api_keywords, []::VARCHAR[])[1:20], '|') AS keyword_set FROM o WHERE n <= 2 AND rep = 1
UNION ALL SELECT n.story_id, coalesce(string_agg(kw, '|' ORDER BY rn), '') FROM n LEFT JOIN few ON few.story_id = n.story_id AND rn <= 20 WHERE n.n BETWEEN 3 AND 5 GROUP BY 1
UNION ALL SELECT n.story_id, coalesce(string_agg(kw, '|' ORDER BY rn), '') FROM n LEFT JOIN many ON many.story_id = n.story_id AND rn <= 20 WHERE n.n > 5 GROUP BY 1""")
def _(v: Views):
    return stories.story_keywords(_sized(v))


def _importance_sql(rows: str = "articles") -> str:
    age = C.hours(C.AS_OF, "published_at")
    return f"""sig AS (SELECT story_id, min(CASE WHEN coalesce(api_source_priority, 1) > 0 THEN coalesce(api_source_priority, 1) END) AS bp, count(DISTINCT coalesce(source_domain, '')) AS doms,
 count(*) FILTER (WHERE {age} < 6) AS recent, sum(coalesce(length(description), 0))::DOUBLE / count(*) AS ad, count(*) FILTER (WHERE scrape_status = 'full')::DOUBLE / count(*) AS sr FROM {rows} WHERE story_id IS NOT NULL GROUP BY story_id),
sc AS (SELECT s.id, 0.24::DOUBLE * (CASE WHEN coalesce(s.source_count, 0) <= 1 THEN 0.2 WHEN s.source_count = 2 THEN 0.55 WHEN s.source_count = 3 THEN 0.8 ELSE 1.0 END)
 + 0.18::DOUBLE * ({C.source_quality('coalesce(g.bp, 1)', 1)}) * (CASE WHEN g.doms >= 3 THEN 1.15 WHEN g.doms >= 2 THEN 1.05 ELSE 1.0 END)
 + 0.10::DOUBLE * least(g.recent / 4.0, 1.0) + 0.08::DOUBLE * greatest(0.0, 1 - {C.hours(C.AS_OF, 's.last_updated_at')} / 24) + 0.08::DOUBLE * ({C.category_weight('s.llm_category')}) + 0.15::DOUBLE
 + 0.17::DOUBLE * (least(g.ad / 400, 1.0) * 0.5 + g.sr * 0.3 + CASE WHEN g.ad > 100 THEN 0.2 ELSE 0 END) AS importance_score FROM stories s LEFT JOIN sig g ON g.story_id = s.id WHERE s.status = 'active'),
rep AS (SELECT story_id, id, (CASE WHEN coalesce(api_source_priority, 1) <= 0 THEN 1.0::DOUBLE ELSE 1 - log10(coalesce(api_source_priority, 1)) / log10(15000) END) * 0.5
 + ({C.hours_step(age)}) * 0.3 + least(coalesce(length(full_text), 0), 3000) / 3000.0::DOUBLE * 0.2 AS rs FROM {rows} WHERE story_id IS NOT NULL)"""


@query("agg_11_story_importance", f"""{with_views('stories')}, {_importance_sql()}
SELECT id, {C.r('importance_score')} AS importance_score FROM sc WHERE id IN (SELECT story_id FROM sig)""")
def _(v: Views):
    signals = stories.article_signals(v.articles, as_of()).withColumnRenamed("story_id", "id")
    return v.stories.filter("status = 'active'").drop("importance_score").join(signals, "id").select("id", stories.importance(as_of()).alias("importance_score"))


_SCORED = f"""{with_views('stories')}, {_importance_sql()}
SELECT sc.id, {C.r('sc.importance_score')} AS importance_score, r.id AS representative_article_id FROM (SELECT id, CASE WHEN id IN (SELECT story_id FROM sig) THEN importance_score END AS importance_score FROM sc) sc
LEFT JOIN (SELECT story_id, id, row_number() OVER (PARTITION BY story_id ORDER BY rs DESC, id) AS rn FROM rep) r ON r.story_id = sc.id AND r.rn = 1"""


@query("agg_12_score_from_state", _SCORED)
def _(v: Views):
    """Three runs at three times, each with its share of the articles and the state of the runs before."""
    known = v.spark.createDataFrame([], storystate.SCHEMA)
    articles = v.articles.withColumn("embedding", F.lit(None).cast("array<double>"))
    for part, hours in enumerate((12, 5, 0)):
        clock = as_of() - F.expr(f"INTERVAL {hours} HOURS")
        known = cut(storystate.merge(storystate.aged(known, clock), storystate.parts(articles.filter(col("id") % 3 == part), clock)))
    return storystate.score_stories(v.stories, known, as_of()).select("id", "importance_score", "representative_article_id")


@query("agg_12_score_active_stories", _SCORED)
def _(v: Views):
    return stories.score_stories(v.stories, v.articles, as_of()).select("id", "importance_score", "representative_article_id")


@query("agg_13_article_counts", f"""{with_views('stories', 'vectors')}, gone AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY story_id, source_name ORDER BY coalesce(importance_score, 0) DESC, id) > 1 AS a,
 row_number() OVER (PARTITION BY story_id, {C.url_hash('url')} ORDER BY coalesce(importance_score, 0) DESC, id) > 1 AS b FROM articles WHERE story_id IS NOT NULL) q WHERE a OR b)
SELECT s.id, coalesce(n.n, s.article_count) AS article_count FROM stories s LEFT JOIN (
 SELECT a.story_id, count(*) AS n FROM articles a JOIN vectors v ON v.id = a.id WHERE a.story_id IS NOT NULL AND a.id NOT IN (SELECT id FROM gone) GROUP BY 1) n ON n.story_id = s.id""")
def _(v: Views):
    gone = dedup.evictions(v.articles.withColumn("normalized_url_hash", S.url_hash(col("url"))))
    left = v.embedded().join(gone.select("id"), "id", "left_anti")
    return stories.recounted(v.stories, left).select("id", "article_count")


@query("agg_14_run_counters", f"""{with_views('raw_articles')}, ruled AS (SELECT *, {C.rule()} AS rule, {C.url_hash('url')} AS h FROM raw_articles),
p AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY id) AS rn FROM ruled WHERE rule IS NULL AND NOT api_duplicate_flag)
SELECT (SELECT count(*) FROM ruled) AS fetched, (SELECT count(*) FROM ruled WHERE rule IS NOT NULL) AS filtered,
 (SELECT count(*) FROM ruled WHERE rule IS NULL AND api_duplicate_flag) + (SELECT count(*) FROM p WHERE rn > 1) AS deduped,
 (SELECT count(*) FROM p WHERE rn = 1) AS classified, (SELECT count(*) FROM p WHERE rn = 1 AND llm_tier IN ('A', 'B')) AS stored""")
def _(v: Views):
    ruled = filters.with_rule(v.raw_articles, as_of()).withColumn("normalized_url_hash", S.url_hash(col("url")))
    passed = ruled.filter("rule IS NULL AND NOT api_duplicate_flag").select("id", "normalized_url_hash")
    return metrics.run_counters(ruled, dedup.mark_batch_url(passed, "id"))


_CANDS = f"""cand AS (SELECT * FROM (SELECT a.*, a.published_at::DATE AS d, row_number() OVER (PARTITION BY a.story_id, a.published_at::DATE ORDER BY a.importance_score DESC NULLS LAST, a.published_at DESC, a.id) AS day_rank
 FROM articles a WHERE a.story_id IS NOT NULL AND a.published_at >= {C.AS_OF} - INTERVAL 14 DAY) q WHERE day_rank <= 4)"""


def _line_check(pin: str) -> str:
    """Recursive walk over the candidates of every story; ``pin`` is the id taken first."""
    return f"""{_CANDS},
ordc AS (SELECT c.story_id, c.id, c.d, c.published_at, v.embedding, c.id = {pin} AS pin, row_number() OVER (PARTITION BY c.story_id ORDER BY (c.id = {pin}) DESC, c.published_at DESC, c.id) AS k FROM cand c LEFT JOIN vectors v ON v.id = c.id),
dup AS (SELECT a.story_id, a.k, list(b.k) AS l FROM ordc a JOIN ordc b ON b.story_id = a.story_id AND b.k < a.k AND {C.cos('a.embedding', 'b.embedding')} >= 0.85 GROUP BY 1, 2),
steps AS (SELECT o.*, coalesce(dup.l, []::BIGINT[]) AS l FROM ordc o LEFT JOIN dup USING (story_id, k)),
walk(story_id, k, kept, days) AS (SELECT DISTINCT story_id, 0::BIGINT, []::BIGINT[], []::DATE[] FROM cand UNION ALL
 SELECT s.story_id, s.k, CASE WHEN ok THEN list_append(kept, s.k) ELSE kept END, CASE WHEN ok THEN list_append(days, s.d) ELSE days END FROM (
  SELECT s.story_id, s.k, s.d, w.kept, w.days, s.pin OR (len(list_filter(w.days, lambda x: x = s.d)) < 2 AND NOT list_has_any(w.kept, s.l)) AS ok FROM walk w JOIN steps s ON s.story_id = w.story_id AND s.k = w.k + 1) s),
line AS (SELECT story_id, id, published_at, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC, k) - 1 AS pos FROM (
 SELECT s.* FROM (SELECT story_id, unnest(kept) AS k FROM (SELECT story_id, arg_max(kept, k) AS kept FROM walk GROUP BY story_id) z) x JOIN steps s USING (story_id, k)) y)"""


_UNPINNED = f"{with_views('stories', 'vectors', 'follows', recursive=True)}, {_line_check('-1')}"


@query("agg_15_new_since_seen", f"""{_UNPINNED}
SELECT f.story_id, count(*) FILTER (WHERE f.last_seen_at IS NULL OR l.published_at > f.last_seen_at) AS new_since_last_seen FROM follows f JOIN line l ON l.story_id = f.story_id WHERE f.user_id IS NULL GROUP BY 1""")
def _(v: Views):
    followed = timeline.followed_stories(v.follows, v.stories)
    line = timeline.story_timelines(v.embedded().join(followed.select("story_id"), "story_id", "left_semi"), as_of())
    return line.join(followed.select("story_id", "last_seen_at"), "story_id").groupBy("story_id").agg(
        F.count_if(timeline.is_new(col("last_seen_at"), col("published_at"))).alias("new_since_last_seen"))


@query("agg_16_fetch_stats", f"""WITH u AS (SELECT source_api, seq, normalized_url_hash, row_number() OVER (PARTITION BY source_api, normalized_url_hash ORDER BY seq) AS rn FROM ({_WHOLE_SOURCES}) z),
raw AS (SELECT s.source_api, count(*) AS raw_count, count(*) FILTER (WHERE (s.source_api = 'newsdata' AND (doc_id * 7919) % 15000 > 10000)
 OR (s.source_api = 'thenewsapi' AND doc_id % 5 <> 0 AND (doc_id % 50) + 0.5 < 25)) AS rejected_count FROM documents, (SELECT unnest(['worldnews', 'webzio', 'thenewsapi', 'newsdata']) AS source_api) s GROUP BY 1)
SELECT raw.source_api, raw_count, count(*) FILTER (WHERE rn = 1) AS normalized_count, count(*) FILTER (WHERE rn > 1) AS duplicate_urls, rejected_count,
 (SELECT count(DISTINCT doc_id // 100) FROM documents WHERE doc_id // 100 % 2 = 0) AS corrupt_pages FROM raw LEFT JOIN u ON u.source_api = raw.source_api GROUP BY ALL""")
def _(v: Views):
    """Every other page comes a second time, broken off before its end. Documents are dealt out by page once for all sources, and a page serves both its rows."""
    def with_broken(p):
        twice = p.select("page_id", "raw", F.explode(F.when(col("page_id") % 2 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("broken"))
        return twice.select(F.expr("IF(broken, page_id + 1000000, page_id)").alias("page_id"), F.expr("IF(broken, substr(raw, 1, length(raw) - 1), raw)").alias("raw"))

    dealt = v.documents.repartition(F.floor(col("doc_id") / PAGE))
    return landed.fetch_stats({name: with_broken(pages(v, dealt)) for name, pages in PAGES.items()}, as_of())


@query("agg_17_status_counts", f"{ART} SELECT scrape_status, count(*) AS n FROM articles GROUP BY 1")
def _(v: Views):
    return metrics.status_counts(v.articles)


# ---- WIN --------------------------------------------------------------------------------

@query("win_01_timeline_candidates", f"{ART}, {_CANDS} SELECT story_id, id, strftime(d, '%Y-%m-%d') AS day, day_rank FROM cand")
def _(v: Views):
    return timeline.daily_candidates(v.articles, as_of()).select("story_id", "id", "day", "day_rank")


_KEY = "coalesce('s:' || story_id, 'a:' || id)"
_ONE = f"one AS (SELECT * FROM (SELECT *, {_KEY} AS story_key, row_number() OVER (PARTITION BY {_KEY} ORDER BY llm_tier NULLS LAST, api_source_priority NULLS LAST, published_at DESC, id) AS rn FROM src) q WHERE rn = 1)"
_RECENT = f"src AS (SELECT * FROM articles WHERE filter_status = 'accepted' AND published_at >= {C.AS_OF} - INTERVAL 48 HOUR)"


@query("win_02_one_per_story", f"{ART}, src AS (SELECT * FROM articles WHERE filter_status = 'accepted'), {_ONE} SELECT story_key, id FROM one")
def _(v: Views):
    return feed.one_per_story(v.articles.filter("filter_status = 'accepted'")).select("story_key", "id")


@query("win_03_recent_vectors", f"""{VEC} SELECT story_id, rn AS rank, id, {C.r('e')} AS first_value FROM (
 SELECT a.story_id, a.id, v.embedding[1] AS e, row_number() OVER (PARTITION BY a.story_id ORDER BY a.published_at DESC, a.id) AS rn FROM articles a JOIN vectors v ON v.id = a.id WHERE a.story_id IS NOT NULL) q WHERE rn <= 10""")
def _(v: Views):
    return similarity.recent_vectors(v.embedded()).select("story_id", "rank", "id", F.get("embedding", F.lit(0)).alias("first_value"))


@query("win_04_latest_embedded", f"""{VEC} SELECT story_id, id AS representative_article_id, {C.r('e')} AS canonical_1 FROM (
 SELECT a.story_id, a.id, v.embedding[1] AS e, row_number() OVER (PARTITION BY a.story_id ORDER BY a.published_at DESC, a.id) AS rn FROM articles a JOIN vectors v ON v.id = a.id WHERE a.story_id IS NOT NULL) q WHERE rn = 1""")
def _(v: Views):
    return stories.latest_embedded(v.embedded()).select("story_id", "representative_article_id", F.get("canonical_embedding", F.lit(0)).alias("canonical_1"))


@query("win_05_representative", f"""{with_views('stories')}, {_importance_sql()}
SELECT story_id, id, {C.r('rs')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY rs DESC, id) AS rn FROM rep) q WHERE rn = 1""")
def _(v: Views):
    rows = v.articles.filter("story_id IS NOT NULL").select("story_id", "id", stories.representative_score(as_of()).alias("score"))
    return numbering.top_per_key(rows, ["story_id"], [col("score").desc(), col("id")], 1).drop("rank")


_EVICT = f"""h AS (SELECT id, story_id, source_name, coalesce(importance_score, 0) AS sc, {C.url_hash('url')} AS uh FROM articles WHERE story_id IS NOT NULL),
e AS (SELECT id, story_id, row_number() OVER (PARTITION BY story_id, source_name ORDER BY sc DESC, id) > 1 AS by_source, row_number() OVER (PARTITION BY story_id, uh ORDER BY sc DESC, id) > 1 AS by_url FROM h)"""


# Small stories, so that equal urls share one.
_CLOSE = "close AS (SELECT * REPLACE (id // 10 AS story_id, 'src' || (id % 7) AS source_name) FROM articles)"


def _close(v: Views):
    rows = v.articles.withColumns({"story_id": F.floor(col("id") / 10), "source_name": F.concat(F.lit("src"), (col("id") % 7).cast("string"))})
    return rows.withColumn("normalized_url_hash", S.url_hash(col("url")))


@query("win_06_evict_by_source", f"{ART}, {_CLOSE}, {_EVICT.replace('FROM articles', 'FROM close')} SELECT id, story_id FROM e WHERE by_source")
def _(v: Views):
    return dedup.evictions(_close(v)).filter("by_source").select("id", "story_id")


@query("win_07_evict_by_url", f"{ART}, {_CLOSE}, {_EVICT.replace('FROM articles', 'FROM close')} SELECT id, story_id, by_source, by_url FROM e WHERE by_source OR by_url")
def _(v: Views):
    return dedup.evictions(_close(v))


@query("win_08_batch_url", f"{ART} SELECT id, row_number() OVER (PARTITION BY {C.url_hash('url')} ORDER BY id) = 1 AS first_of_url FROM articles")
def _(v: Views):
    rows = v.articles.select("id", S.url_hash(col("url")).alias("normalized_url_hash"))
    return dedup.mark_batch_url(rows, "id").select("id", "first_of_url")


@query("win_09_source_url", f"""WITH u AS ({_ALL_SOURCES}) SELECT source_api, seq, row_number() OVER (PARTITION BY source_api, normalized_url_hash ORDER BY seq) = 1 AS first_of_url FROM u""")
def _(v: Views):
    every = union_all([landed.NORMALISERS[n](p, as_of()) for n, p in source_pages(v).items()])
    return landed.first_per_url(every).select("source_api", "seq", "first_of_url")


@query("win_10_day_groups", f"""{_UNPINNED}
SELECT story_id, dense_rank() OVER (PARTITION BY story_id ORDER BY d DESC) - 1 AS group_no, strftime(d, '%a, %-d %B %Y') AS label, items FROM (
 SELECT story_id, published_at::DATE AS d, string_agg(id::VARCHAR, '|' ORDER BY pos) AS items FROM line GROUP BY 1, 2) q""")
def _(v: Views):
    groups = timeline.day_groups(timeline.story_timelines(v.embedded(), as_of()))
    return groups.select("story_id", "group_no", "label", col("items.id").alias("items"))


@query("win_11_batch_numbers", f"""{ART} SELECT id, (n - 1) // 5 AS classify_batch, (n - 1) % 5 AS pos, (n - 1) // 100 AS embed_batch FROM (SELECT id, row_number() OVER (ORDER BY id) AS n FROM articles WHERE filter_status = 'accepted') q""")
def _(v: Views):
    rows = v.articles.filter("filter_status = 'accepted'").select("id")
    five = numbering.batch_number(rows, "id", config.CLASSIFY_BATCH, "classify_batch")
    hundred = numbering.batch_number(rows, "id", config.EMBED_BATCH, "embed_batch").drop("pos")
    return five.join(hundred, "id")


# ---- TOP --------------------------------------------------------------------------------

_FEED_ORDER = "coalesce(llm_tier, 'Z'), api_source_priority NULLS LAST, published_at DESC, id"


@query("top_01_feed", f"""{ART}, {_RECENT}, {_ONE}
SELECT id, coalesce(title, 'Untitled') AS title, {C.bullets('summary')} AS bullets, story_id, coalesce(source_name, 'Unknown') AS source_name, coalesce(llm_category, 'News') AS category,
 {C.time_ago('published_at')} AS time_ago, llm_tier, api_source_priority, {C.ts('published_at')} AS published_at FROM one ORDER BY {_FEED_ORDER} LIMIT 30""")
def _(v: Views):
    return feed.feed(v.articles, as_of())


@query("top_02_summary_picks", f"""{ART}, src AS (SELECT * FROM articles WHERE filter_status = 'accepted' AND published_at >= {C.AS_OF} - INTERVAL 48 HOUR AND summary IS NULL), {_ONE}
SELECT row_number() OVER (ORDER BY coalesce(llm_tier, 'Z'), api_source_priority NULLS LAST, story_key) - 1 AS pos, id FROM one ORDER BY pos LIMIT 30""")
def _(v: Views):
    return feed.summary_picks(v.articles, as_of())


_SCORE = f"""0.30::DOUBLE * ({C.source_quality('coalesce(api_source_priority, 1)', 1, True)}) + 0.20::DOUBLE * ({C.category_weight('llm_category')})
 + 0.15::DOUBLE * least(least(coalesce(length(description), 0) / 400.0::DOUBLE, 1.0) + CASE WHEN scrape_status = 'full' THEN 0.2::DOUBLE ELSE 0 END, 1.0)
 + 0.25::DOUBLE * coalesce(s_importance, 0) + CASE coalesce(llm_tier, 'B') WHEN 'A' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"""
_SCORED = f"cands AS (SELECT a.*, s.importance_score AS s_importance FROM articles a LEFT JOIN stories s ON s.id = a.story_id WHERE a.filter_status = 'accepted'), scored AS (SELECT *, {_SCORE} AS score FROM cands)"


def _scored(v: Views):
    return brief.candidates(v.articles, v.stories).withColumn("score", brief.candidate_score())


@query("top_03_candidate_score", f"{with_views('stories')}, {_SCORED} SELECT id, {C.r('score')} AS score FROM scored")
def _(v: Views):
    return _scored(v).select("id", "score")


_BRIEF = """o AS (SELECT id, story_id, score, coalesce(llm_category, 'none') AS c, coalesce(main_genre, 'global') AS g, coalesce('s:' || story_id, 'a:' || id) AS sk, row_number() OVER (ORDER BY score DESC, id) AS k FROM scored),
p1(k, ids, sks, cs, gs) AS (SELECT 0::BIGINT, []::BIGINT[], []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] UNION ALL
 SELECT k, CASE WHEN ok THEN list_append(ids, id) ELSE ids END, CASE WHEN ok THEN list_append(sks, sk) ELSE sks END, CASE WHEN ok THEN list_append(cs, c) ELSE cs END, CASE WHEN ok THEN list_append(gs, g) ELSE gs END FROM (
  SELECT o.k, o.id, o.sk, o.c, o.g, p.ids, p.sks, p.cs, p.gs, len(p.ids) < 14 AND NOT list_contains(p.sks, o.sk) AND len(list_filter(p.cs, lambda x: x = o.c)) < 4 AND len(list_filter(p.gs, lambda x: x = o.g)) < 8 AS ok
  FROM p1 p JOIN o ON o.k = p.k + 1) z),
mid AS (SELECT ids, sks FROM p1 WHERE k = (SELECT max(k) FROM o)),
p2(k, ids, sks) AS (SELECT 0::BIGINT, ids, sks FROM mid UNION ALL
 SELECT o.k, CASE WHEN len(ids) < 14 AND NOT list_contains(sks, o.sk) THEN list_append(ids, o.id) ELSE ids END, CASE WHEN len(ids) < 14 AND NOT list_contains(sks, o.sk) THEN list_append(sks, o.sk) ELSE sks END FROM p2 JOIN o ON o.k = p2.k + 1),
picked AS (SELECT unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM p2 WHERE k = (SELECT max(k) FROM o))"""


@query("top_04_brief_selection", f"""{with_views('stories', recursive=True)}, {_SCORED}, {_BRIEF}
SELECT p.pos::BIGINT AS pos, p.id, o.story_id, {C.r('o.score')} AS score FROM picked p JOIN o ON o.id = p.id""")
def _(v: Views):
    return brief.select_brief(_scored(v))


# The oldest recent article of every story is pinned.
@query("top_05_story_timeline", f"""{with_views('articles', 'vectors', recursive=True)}, pins AS (SELECT story_id, max(id) AS pin FROM articles WHERE story_id IS NOT NULL AND published_at >= {C.AS_OF} - INTERVAL 4 DAY GROUP BY 1),
{_line_check('coalesce((SELECT pin FROM pins WHERE pins.story_id = c.story_id), -1)')} SELECT story_id, id, pos FROM line""")
def _(v: Views):
    pins = v.articles.filter(col("story_id").isNotNull() & filters.since(col("published_at"), as_of(), "4 DAYS")).groupBy("story_id").agg(F.max("id").alias("pinned_id"))
    return timeline.select_timeline(timeline.daily_candidates(v.embedded(), as_of()), pins)


@query("top_06_follow_updates", f"""{_UNPINNED},
n AS (SELECT f.story_id, count(*) FILTER (WHERE f.last_seen_at IS NULL OR l.published_at > f.last_seen_at) AS n, string_agg(l.id::VARCHAR, '|' ORDER BY l.pos) AS ids, arg_min(a.title, l.pos) AS first_title
 FROM follows f JOIN line l ON l.story_id = f.story_id JOIN articles a ON a.id = l.id WHERE f.user_id IS NULL GROUP BY 1)
SELECT f.story_id, coalesce(nullif({C.trim('s.title')}, ''), n.first_title, 'Untitled Story') AS story_title, coalesce(s.llm_category, 'news') AS story_category, {C.ts('f.followed_at')} AS followed_at,
 coalesce(s.article_count, 0) AS article_count, {C.ts('s.last_updated_at')} AS last_updated_at, coalesce(n.n, 0) AS new_since_last_seen, n.ids AS articles
FROM follows f JOIN stories s ON s.id = f.story_id LEFT JOIN n ON n.story_id = f.story_id WHERE f.user_id IS NULL""")
def _(v: Views):
    updates = timeline.follow_updates(v.follows, v.stories, v.embedded(), as_of())
    return updates.withColumn("articles", col("articles.id"))


@query("top_07_title_context", f"""{ART},
t AS (SELECT story_id, title, description, row_number() OVER (PARTITION BY story_id ORDER BY importance_score DESC NULLS LAST, published_at DESC, id) AS rn FROM articles WHERE story_id IS NOT NULL AND filter_status = 'accepted')
SELECT story_id, string_agg(rn || '. ' || title || coalesce(' — ' || {C.trim("substr(nullif(description, ''), 1, 150)")}, ''), chr(10) ORDER BY rn) AS context FROM t WHERE rn <= 10 GROUP BY 1""")
def _(v: Views):
    return modelio.title_context(v.articles)


@query("top_08_run_cap", f"WITH u AS ({_ALL_SOURCES}) SELECT source_api, seq FROM u ORDER BY source_rank, seq LIMIT 150")
def _(v: Views):
    every = landed.concat_sources({n: landed.NORMALISERS[n](p, as_of()) for n, p in source_pages(v).items()})
    return every.orderBy("batch_seq").limit(150).select("source_api", "seq")


@query("top_09_cards", f"""{with_views('briefs')},
b AS (SELECT brief_date, unnest(article_ids) AS id, generate_subscripts(article_ids, 1) - 1 AS pos FROM briefs)
SELECT strftime(brief_date, '%Y-%m-%d') AS brief_date, pos::BIGINT AS pos, CASE pos WHEN 0 THEN 'featured' WHEN 1 THEN 'secondary' ELSE 'tertiary' END AS role,
 array_to_string(({C.bullet_list('a.summary')})[1:2], '|') AS bullets FROM b LEFT JOIN articles a ON a.id = b.id""")
def _(v: Views):
    rows = feed.brief_articles(v.briefs, v.articles, as_of())
    return rows.select("brief_date", "pos", feed.card_role().alias("role"), F.slice("bullets", 1, 2).alias("bullets"))


@query("top_10_latest_brief", f"""{with_views('briefs')}
SELECT strftime(brief_date, '%Y-%m-%d') AS brief_date, array_to_string(article_ids, '|') AS article_ids FROM briefs
WHERE user_id IS NULL AND brief_date IN (DATE '2024-01-16', DATE '2024-01-15') ORDER BY brief_date DESC LIMIT 1""")
def _(v: Views):
    return feed.latest_brief(v.briefs, F.lit("2024-01-16").cast("date")).select("brief_date", "article_ids")


# ---- SET --------------------------------------------------------------------------------

@query("set_01_ordered_union", f"""{ART},
a AS (SELECT id, 0 AS part, row_number() OVER (ORDER BY published_at DESC, id) - 1 AS pos FROM articles WHERE llm_tier = 'A'),
b AS (SELECT id, 1 AS part, row_number() OVER (ORDER BY id DESC) - 1 AS pos FROM articles WHERE llm_category = 'policy'),
u AS (SELECT id, arg_min(part, part * 1000000000 + pos) AS part, arg_min(pos, part * 1000000000 + pos) AS pos FROM (SELECT * FROM a UNION ALL SELECT * FROM b) q GROUP BY id)
SELECT id, part::BIGINT AS part, pos FROM u""")
def _(v: Views):
    newest = [col("published_at").desc(), col("id")]
    first = numbering.ordered_number(v.articles.filter("llm_tier = 'A'").select("id", "published_at"), newest, "no").select("id", (col("no") - 1).alias("pos"))
    back = v.articles.filter("llm_category = 'policy'").select("id", (-col("id")).alias("neg"))
    second = numbering.dense_number(back, "neg", "no").select("id", (col("no") - 1).alias("pos"))
    return brief.ordered_union(first, second)


@query("set_02_unmatched", f"""{with_views('incoming', 'stories')} SELECT id FROM incoming WHERE id NOT IN (SELECT a.id FROM incoming a JOIN stories s ON s.id = a.story_id WHERE s.status = 'active')""")
def _(v: Views):
    return stories.unmatched(v.incoming, v.stories)


@query("set_03_affected_stories", f"""{ART} SELECT story_id FROM articles WHERE llm_tier = 'A' AND story_id IS NOT NULL UNION SELECT 1000000 + id // 50 FROM articles WHERE llm_tier = 'B'""")
def _(v: Views):
    matched = v.articles.filter("llm_tier = 'A'")
    return stories.affected(matched, v.articles.filter("llm_tier = 'B'").select((1000000 + F.floor(col("id") / 50)).alias("story_id")))


_CHAIN = f"""inc AS (SELECT *, {C.hashes()} FROM incoming), sto_recent AS (SELECT {C.hashes()} FROM stored WHERE published_at > {C.AS_OF} - INTERVAL 7 DAY),
l5 AS (SELECT * FROM inc WHERE NOT api_duplicate_flag), l6 AS (SELECT *, row_number() OVER (PARTITION BY normalized_url_hash ORDER BY id) AS rn FROM l5),
inc_live AS (SELECT * FROM l6 WHERE rn = 1), exact AS (SELECT id FROM inc_live WHERE {_EXACT}), rest AS (SELECT id, title FROM inc_live WHERE id NOT IN (SELECT id FROM exact))"""


@query("set_04_dedup_chain", f"""{with_views('incoming', 'stored', recursive=True)}, {_CHAIN}, {_greedy_check('rest')}, alive AS (SELECT low.id FROM fin JOIN low USING (k))
SELECT id, CASE WHEN api_duplicate_flag THEN 'dedup_newsdata_flag' WHEN id IN (SELECT id FROM l6 WHERE rn > 1) THEN 'dedup_batch_url' WHEN id IN (SELECT id FROM exact) THEN 'dedup_exact'
 WHEN id NOT IN (SELECT id FROM alive) THEN 'dedup_fuzzy' END AS rule FROM inc""")
def _(v: Views):
    batch = dedup.article_hashes(v.incoming).withColumn("batch_seq", col("id"))
    stored = dedup.article_hashes(v.stored)
    return dedup.deduplicate(batch, stored, as_of()).select("id", "rule")


@query("set_05_source_flag", f"{ART} SELECT id, title FROM articles WHERE api_duplicate_flag")
def _(v: Views):
    return v.articles.filter("api_duplicate_flag").select("id", "title")
