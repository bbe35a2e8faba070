"""Queries of the quality rules (FLT) and scalar functions (SCA)."""

from pyspark.sql import functions as F

from .. import config, rules
from ..functions import scalars as S
from ..functions import vectors as V
from ..operators import dedup, feed, filters
from . import check_sql as C
from .registry import query
from .views import Views, as_of, with_views

col = F.col
RAW = with_views("raw_articles")
ART = with_views("articles")


# ---- FLT --------------------------------------------------------------------------------

def _flagged(name: str, column, check: str) -> None:
    """A rule as a query: every article with the verdict of one rule."""
    query(name, f"{RAW} SELECT id, {check} AS rejected FROM raw_articles")(
        lambda v: v.raw_articles.select("id", column().alias("rejected")))


_flagged("flt_01_declared_language", lambda: filters.foreign_language(col("api_language")), C.foreign_language())
_flagged("flt_02_script_ratio", lambda: filters.foreign_script(col("title"), col("description")), C.foreign_script())
_flagged("flt_03_staleness", lambda: filters.stale(col("published_at"), as_of()), C.stale())
_flagged("flt_04_title_length", lambda: filters.title_too_short(col("title")), "(title IS NULL OR length(title) < 15)")
_flagged(
    "flt_05_uppercase_title", lambda: filters.shouting_title(col("title")),
    "coalesce(length(regexp_replace(title, '[^A-Z]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(title, '[^a-zA-Z]', '', 'g')), 0) > 0.85, false)",
)
_flagged(
    "flt_06_text_length", lambda: filters.text_too_short(col("source_api"), col("content"), col("description")),
    "coalesce(length(coalesce(content, description)) < CASE source_api WHEN 'worldnews' THEN 80 WHEN 'newsdata' THEN 200 WHEN 'webzio' THEN 60 WHEN 'thenewsapi' THEN 50 ELSE 0 END, false)",
)
_flagged("flt_07_domain_blocklist", lambda: filters.blocked_domain(col("source_domain")), C.blocked())
_flagged("flt_08_url_path", lambda: filters.rejected_path(col("url")), C.bad_path())
_flagged("flt_09_title_pattern", lambda: filters.rejected_title(col("title")), C.bad_title())
_flagged("flt_10_template_text", lambda: filters.templated_text(col("content"), col("description")), C.templated())


@query("flt_11_rule_chain", f"""{RAW}
SELECT id, {C.rule()} AS rule, CASE WHEN {C.rule()} IS NOT NULL THEN {C.context_len()} END AS context_len FROM raw_articles""")
def _(v: Views):
    ruled = filters.with_rule(v.raw_articles, as_of())
    return ruled.select("id", "rule", F.when(col("rule").isNotNull(), S.context_len(col("description"), col("content"))).alias("context_len"))


@query("flt_12_relevance", f"""{RAW}
SELECT source_api, count(*) FILTER (WHERE api_relevance_score < 25) AS rejected,
 count(*) FILTER (WHERE NOT coalesce(api_relevance_score < 25, false)) AS kept FROM raw_articles GROUP BY source_api""")
def _(v: Views):
    low = filters.low_relevance(col("api_relevance_score"))
    return v.raw_articles.groupBy("source_api").agg(F.count_if(low).alias("rejected"), F.count_if(~low).alias("kept"))


@query("flt_13_source_authority", f"""{RAW}
SELECT source_api, count(*) FILTER (WHERE api_source_priority > 10000) AS rejected,
 count(*) FILTER (WHERE NOT coalesce(api_source_priority > 10000, false)) AS kept FROM raw_articles GROUP BY source_api""")
def _(v: Views):
    low = filters.low_authority(col("api_source_priority"))
    return v.raw_articles.groupBy("source_api").agg(F.count_if(low).alias("rejected"), F.count_if(~low).alias("kept"))


@query("flt_14_newsdata_guard", f"""{RAW}
SELECT id FROM raw_articles WHERE NOT {C.stale()} AND NOT coalesce(content <> '' AND length(content) < 200, false)""")
def _(v: Views):
    return v.raw_articles.filter(filters.newsdata_guard(col("published_at"), col("content"), as_of())).select("id")


@query("flt_15_required_fields", f"""{RAW}
SELECT id FROM raw_articles WHERE coalesce(url, '') <> '' AND coalesce(title, '') <> ''""")
def _(v: Views):
    return v.raw_articles.filter(filters.has_required(col("url"), col("title"))).select("id")


@query("flt_16_region", f"""{RAW}
SELECT id, CASE WHEN {C.india('api_country', 'source_domain')} THEN 'india' ELSE 'global' END AS region FROM raw_articles""")
def _(v: Views):
    return v.raw_articles.select("id", S.region(col("api_country"), col("source_domain")).alias("region"))


@query("flt_17_tier_split", f"""{ART}
SELECT id, llm_tier, CASE WHEN llm_tier IN ('A', 'B') THEN 'accepted' ELSE 'rejected' END AS filter_status FROM articles""")
def _(v: Views):
    return v.articles.select("id", "llm_tier", filters.filter_status(col("llm_tier")).alias("filter_status"))


@query("flt_18_recency_windows", f"""{ART}
SELECT id, published_at >= {C.AS_OF} - INTERVAL 14 DAY AS in_timeline, published_at >= {C.AS_OF} - INTERVAL 48 HOUR AS in_feed,
 published_at >= {C.AS_OF} - INTERVAL 7 DAY AS in_dedup, published_at >= {C.AS_OF} - INTERVAL 6 HOUR AS in_momentum FROM articles
WHERE published_at >= {C.AS_OF} - INTERVAL 20 DAY""")
def _(v: Views):
    p = col("published_at")
    return v.articles.filter(filters.since(p, as_of(), "20 DAYS")).select(
        "id", filters.since(p, as_of(), "14 DAYS").alias("in_timeline"), filters.since(p, as_of(), "48 HOURS").alias("in_feed"),
        filters.since(p, as_of(), "7 DAYS").alias("in_dedup"), filters.since(p, as_of(), "6 HOURS").alias("in_momentum"))


@query("flt_19_category_filter", f"""{ART}
SELECT 'science' AS asked, id FROM articles WHERE llm_category = 'science' UNION ALL SELECT 'sports' AS asked, id FROM articles""")
def _(v: Views):
    one = filters.category_filter(v.articles, "science").select(F.lit("science").alias("asked"), "id")
    return one.unionByName(filters.category_filter(v.articles, "sports").select(F.lit("sports").alias("asked"), "id"))


@query("flt_20_scrape_class", f"""{ART}
SELECT id, CASE WHEN t IS NULL OR length(t) < 50 THEN 'failed' WHEN length(t) < 300 THEN 'thin' ELSE 'full' END AS status
FROM (SELECT id, CASE WHEN id % 10 = 3 THEN title WHEN id % 2 = 0 THEN full_text ELSE body END AS t FROM articles) q""")
def _(v: Views):
    text = F.when(col("id") % 10 == 3, col("title")).when(col("id") % 2 == 0, col("full_text")).otherwise(col("body"))
    return v.articles.select("id", S.scrape_class(text).alias("status"))


@query("flt_21_not_embedded", f"""{with_views('articles', 'vectors')}
SELECT a.id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.id = a.id)""")
def _(v: Views):
    return v.embedded().filter(col("embedding").isNull()).select("id")


@query("flt_22_text_choice", f"""{ART}
SELECT id, coalesce(CASE WHEN length(full_text) >= 50 THEN full_text END, CASE WHEN length(content) >= 50 THEN content END,
 CASE WHEN length(description) >= 50 THEN description END) AS text FROM articles""")
def _(v: Views):
    return v.articles.select("id", S.best_text(col("full_text"), col("content"), col("description")).alias("text"))


# ---- SCA --------------------------------------------------------------------------------

URLS = "CASE WHEN id % 6 = 0 THEN 'not a url ' || id WHEN id % 6 = 1 THEN 'http://WWW.Example.org:8080///' ELSE url END"


def _urls(v: Views):
    return v.articles.select("id", F.expr(URLS.replace("|| id", "|| CAST(id AS STRING)")).alias("url"), "title", "source_domain")


@query("sca_01_normalize_url", f"{ART} SELECT id, {C.norm_url('url')} AS url FROM (SELECT id, {URLS} AS url FROM articles) q")
def _(v: Views):
    return _urls(v).select("id", S.normalize_url(col("url")).alias("url"))


@query("sca_02_normalize_title", f"{ART} SELECT id, {C.norm_title('title')} AS title FROM articles")
def _(v: Views):
    return v.articles.select("id", S.normalize_title(col("title")).alias("title"))


@query("sca_03_title_hash", f"{ART} SELECT id, {C.title_hash('title')} AS title_hash FROM articles")
def _(v: Views):
    return v.articles.select("id", S.title_hash(col("title")).alias("title_hash"))


@query("sca_04_url_hash", f"{ART} SELECT id, {C.url_hash('url')} AS url_hash FROM (SELECT id, {URLS} AS url FROM articles) q")
def _(v: Views):
    return _urls(v).select("id", S.url_hash(col("url")).alias("url_hash"))


@query("sca_05_domain_title_hash", f"{ART} SELECT id, {C.domain_title_hash('source_domain', 'title')} AS domain_title_hash FROM articles")
def _(v: Views):
    return v.articles.select("id", S.domain_title_hash(col("source_domain"), col("title")).alias("domain_title_hash"))


PAIRED = "SELECT a.id, a.title AS t1, CASE WHEN a.id % 5 = 0 THEN substr(a.title, 1, 2) WHEN a.id % 5 = 1 THEN substr(a.title, 4, 60) ELSE b.title END AS t2 FROM articles a JOIN articles b ON b.id = a.id - a.id % 10"


@query("sca_06_trigram_similarity", f"""{ART}, pairs AS ({PAIRED}), g AS (SELECT id, {C.grams('t1')} AS g1, {C.grams('t2')} AS g2 FROM pairs)
SELECT id, {C.r(C.jaccard('g1', 'g2'))} AS similarity FROM g""")
def _(v: Views):
    pairs = v.spark.sql(PAIRED.replace("FROM articles", "FROM {articles}").replace("JOIN articles", "JOIN {articles}"), articles=v.articles)
    return pairs.select("id", S.trigram_similarity(col("t1"), col("t2")).alias("similarity"))


@query("sca_07_cosine", f"""{with_views('vectors')}
SELECT a.id, {C.r(C.cos('a.embedding', 'b.embedding'))} AS similarity FROM vectors a JOIN vectors b ON b.id = a.id // 20 * 20""")
def _(v: Views):
    other = v.vectors.select(col("id").alias("other"), col("embedding").alias("e2"))
    return v.vectors.join(other, col("other") == F.floor(col("id") / 20) * 20).select("id", V.cosine(col("embedding"), col("e2")).alias("similarity"))


@query("sca_08_max_similarity", f"""{with_views('articles', 'vectors')},
recent AS (SELECT story_id, embedding FROM (SELECT a.story_id, v.embedding, row_number() OVER (PARTITION BY a.story_id ORDER BY a.published_at DESC, a.id) AS rn
 FROM articles a JOIN vectors v ON v.id = a.id WHERE a.story_id IS NOT NULL) q WHERE rn <= 10)
SELECT a.id, {C.r("coalesce(max(" + C.cos('v.embedding', 'r.embedding') + "), 0)")} AS similarity
FROM articles a JOIN vectors v ON v.id = a.id LEFT JOIN recent r ON r.story_id = a.story_id GROUP BY a.id""")
def _(v: Views):
    from ..operators import similarity

    emb = v.embedded().filter(col("embedding").isNotNull())
    lists = similarity.recent_vectors(emb).groupBy("story_id").agg(F.collect_list("embedding").alias("recent"))
    none = F.array().cast("array<array<double>>")
    return emb.join(lists, "story_id", "left").select("id", V.max_similarity(col("embedding"), F.coalesce("recent", none)).alias("similarity"))


@query("sca_09_match_score", f"""{with_views('articles', 'vectors', 'keywords')},
pairs AS (SELECT a.id, {C.cos('va.embedding', 'vs.embedding')} AS sim, ka.api_keywords AS kw, CASE WHEN s.id % 3 <> 0 THEN list_concat(ks.api_keywords, ka.api_keywords[1:2]) END AS story_kw
 FROM articles a JOIN articles s ON s.id = a.id % 20 JOIN vectors va ON va.id = a.id JOIN vectors vs ON vs.id = s.id
 JOIN keywords ka ON ka.id = a.id JOIN keywords ks ON ks.id = s.id)
SELECT id, {C.r("CASE WHEN coalesce(len(kw), 0) = 0 OR coalesce(len(story_kw), 0) = 0 THEN sim ELSE sim * 0.65 + least(len(list_filter(kw[1:8], lambda k: list_contains(story_kw, k))) / 4.0, 1.0) * 0.35 END")} AS score FROM pairs""")
def _(v: Views):
    full = v.vectors.join(v.keywords, "id").join(v.articles.select("id"), "id")
    story = full.select(col("id").alias("sid"), col("embedding").alias("e2"), col("api_keywords").alias("k2"))
    pairs = full.join(story, col("sid") == col("id") % 20)
    # the checking engine treats a null list as empty when it concatenates
    none = F.array().cast("array<string>")
    story_kw = F.when(col("sid") % 3 != 0, F.concat(F.coalesce("k2", none), F.coalesce(F.slice("api_keywords", 1, 2), none)))
    return pairs.select("id", V.match_score(V.cosine(col("embedding"), col("e2")), col("api_keywords"), story_kw).alias("score"))


@query("sca_10_null_chars", f"{with_views('keywords')} SELECT a.id, a.title AS title, array_to_string(k.api_keywords, '|') AS keywords FROM articles a JOIN keywords k ON k.id = a.id")
def _(v: Views):
    from ..sources.tables import clean_strings

    dirty = v.articles.join(v.keywords, "id").select(
        "id", F.concat(F.lit("\u0000"), "title").alias("title"),
        F.transform("api_keywords", lambda k: F.concat(k, F.lit("\u0000"))).alias("keywords"))
    return clean_strings(dirty)


@query("sca_11_extract_domain", f"{ART} SELECT id, CASE WHEN {C.is_url('url')} THEN {C.host('url')} ELSE '' END AS domain FROM (SELECT id, {URLS} AS url FROM articles) q")
def _(v: Views):
    return _urls(v).select("id", S.extract_domain(col("url")).alias("domain"))


NOISY = "'Also read: more' || chr(10) || body || chr(10) || '   © 2024 desk' || chr(10) || chr(10) || chr(10) || chr(10) || 'Alsoran text' || chr(10) || 'RELATED ARTICLES' || chr(10) || body"


@query("sca_12_strip_boilerplate", f"{ART} SELECT id, {C.boilerplate('t')} AS text FROM (SELECT id, {NOISY} AS t FROM articles) q")
def _(v: Views):
    return v.articles.select("id", S.strip_boilerplate(F.expr(NOISY)).alias("text"))


@query("sca_13_split_keywords", f"""{ART}
SELECT id, array_to_string(list_filter(list_transform(string_split(t, ','), lambda k: {C.trim('k')}), lambda k: k <> ''), '|') AS keywords
FROM (SELECT id, CASE WHEN id % 9 = 0 THEN '' ELSE regexp_replace(title, ' ', ' , ', 'g') || ',, ' END AS t FROM articles) q""")
def _(v: Views):
    text = F.when(col("id") % 9 == 0, F.lit("")).otherwise(F.concat(F.regexp_replace("title", " ", " , "), F.lit(",, ")))
    return v.articles.select("id", S.split_keywords(text).alias("keywords"))


@query("sca_14_clean_keywords", f"""{with_views('keywords')}
SELECT id, array_to_string(list_filter(list_concat(coalesce(api_keywords, []::VARCHAR[]), ['usn:' || id, 'I/x', '', repeat('k', 50 + (id % 20)::INT), 'ONLY AVAILABLE IN PAID PLANS']),
 lambda k: k <> '' AND NOT contains(k, 'ONLY AVAILABLE IN') AND NOT regexp_matches(k, {C.q(rules.KEYWORD_NOISE)}) AND length(k) <= 60), '|') AS keywords FROM keywords""")
def _(v: Views):
    extra = F.array(F.concat(F.lit("usn:"), col("id").cast("string")), F.lit("I/x"), F.lit(""),
                    F.repeat(F.lit("k"), (50 + col("id") % 20).cast("int")), F.lit("ONLY AVAILABLE IN PAID PLANS"), F.lit(None).cast("string"))
    return v.keywords.select("id", S.clean_keywords(F.concat(F.coalesce("api_keywords", F.array().cast("array<string>")), extra)).alias("keywords"))


@query("sca_15_gated_value", f"""{ART}
SELECT id, CASE WHEN contains(t, 'ONLY AVAILABLE IN') THEN NULL ELSE t END AS value
FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'ONLY AVAILABLE IN PAID PLANS' WHEN id % 3 = 1 THEN description ELSE title END AS t FROM articles) q""")
def _(v: Views):
    t = F.when(col("id") % 3 == 0, F.lit("ONLY AVAILABLE IN PAID PLANS")).when(col("id") % 3 == 1, col("description")).otherwise(col("title"))
    return v.articles.select("id", S.gated_to_null(t).alias("value"))


@query("sca_16_sentiment_word", """
SELECT event_id, CASE lower(w) WHEN 'positive' THEN 0.5::DOUBLE WHEN 'negative' THEN -0.5::DOUBLE WHEN 'neutral' THEN 0.0::DOUBLE END AS sentiment
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'NEUTRAL' WHEN 3 THEN event_type END AS w FROM events) q""")
def _(v: Views):
    word = F.expr("CASE event_id % 5 WHEN 0 THEN 'Positive' WHEN 1 THEN 'negative' WHEN 2 THEN 'NEUTRAL' WHEN 3 THEN event_type END")
    return v.events.select("event_id", S.sentiment_value(word).alias("sentiment"))


@query("sca_17_flatten_entities", f"""{with_views('keywords')}
SELECT id, k AS name, CASE WHEN length(k) % 2 = 0 THEN 'org' ELSE '' END AS type,
 CASE length(k) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE END AS sentiment
FROM (SELECT id, unnest(api_keywords) AS k FROM keywords) q""")
def _(v: Views):
    n = lambda k: F.length(k)
    raw = F.concat(
        F.transform("api_keywords", lambda k: F.struct(
            k.alias("name"), F.when(n(k) % 2 == 0, F.lit("org")).alias("type"),
            F.when(n(k) % 3 == 0, F.lit("Positive")).when(n(k) % 3 == 1, F.lit("negative")).alias("sentiment"))),
        F.array(F.struct(F.lit("").alias("name"), F.lit("x").alias("type"), F.lit(None).cast("string").alias("sentiment"))))
    return v.keywords.select("id", F.inline(S.flatten_entities(raw)))


@query("sca_18_dates", f"""
SELECT event_id, {C.ts("date_trunc('second', ts)")} AS utc_time,
 CASE WHEN event_id % 4 = 0 THEN {C.ts("date_trunc('second', ts) - INTERVAL 330 MINUTE")} WHEN event_id % 4 = 3 THEN {C.ts("date_trunc('second', ts) + INTERVAL 180 MINUTE")}
 WHEN event_id % 8 = 5 THEN {C.ts("date_trunc('second', ts) + INTERVAL 300 MINUTE")} ELSE {C.ts("date_trunc('second', ts)")} END AS zoned_time,
 CASE WHEN event_id % 10 = 0 THEN {C.ts(C.AS_OF)} ELSE {C.ts("date_trunc('second', ts)")} END AS iso_time,
 CASE WHEN event_id % 10 <> 1 THEN {C.ts("date_trunc('second', ts)")} END AS feed_time FROM events""")
def _(v: Views):
    t = F.date_trunc("second", col("ts").cast("timestamp"))
    text = F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    local = F.when(col("event_id") % 4 == 0, "Asia/Kolkata").when(col("event_id") % 8 == 1, "UTC").when(col("event_id") % 16 == 5, "EST").when(
        col("event_id") % 8 == 5, "Etc/GMT+5").when(col("event_id") % 4 == 3, "America/Argentina/Buenos_Aires").when(col("event_id") % 8 == 2, "Foo/Bar")
    iso = F.when(col("event_id") % 10 == 0, F.lit("soon")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    mail = F.when(col("event_id") % 10 == 1, F.lit("yesterday")).when(col("event_id") % 2 == 0, F.date_format(t, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise(
        F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss '+0000'"))
    return v.events.select(
        "event_id", S.parse_utc(F.concat(F.lit(" "), text), as_of()).alias("utc_time"), S.parse_zoned(text, local, as_of()).alias("zoned_time"),
        S.parse_iso(iso, as_of()).alias("iso_time"), S.parse_feed_date(mail).alias("feed_time"))


@query("sca_19_bullets", f"{ART} SELECT id, {C.bullets('summary')} AS bullets FROM articles")
def _(v: Views):
    return v.articles.select("id", S.parse_bullets(col("summary")).alias("bullets"))


@query("sca_20_time_ago", f"SELECT event_id, {C.time_ago('t')} AS time_ago FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS t FROM events) q")
def _(v: Views):
    t = F.when(col("event_id") % 50 != 0, col("ts").cast("timestamp"))
    return v.events.select("event_id", S.time_ago(t, as_of()).alias("time_ago"))


@query("sca_21_context_length", f"{ART} SELECT id, {C.context_len()} AS context_len FROM articles")
def _(v: Views):
    return v.articles.select("id", S.context_len(col("description"), col("content")).alias("context_len"))


@query("sca_22_date_labels", """
SELECT event_id, coalesce(strftime(t, '%a, %-d %B %Y'), 'Unknown Date') AS day_label, strftime(t, '%b %-d, %Y') AS short_date, coalesce(strftime(t, '%H:%M'), '') AS clock
FROM (SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN ts END AS t FROM events) q""")
def _(v: Views):
    t = F.when(col("event_id") % 50 != 0, col("ts").cast("timestamp"))
    return v.events.select("event_id", S.day_label(t).alias("day_label"), S.short_date(t).alias("short_date"), S.clock_label(t).alias("clock"))


@query("sca_23_strip_tags", f"SELECT page_id, {C.trim(chr(34) + 'regexp_replace' + chr(34) + '(html, ' + C.q('<[^>]+>') + ', ' + C.q('') + ', ' + C.q('g') + ')')} AS text FROM pages")
def _(v: Views):
    return v.pages.select("page_id", S.strip_tags(col("html")).alias("text"))


FLAT = C.trim(r"regexp_replace(t, '\s+', ' ', 'g')")


@query("sca_24_repair_text", rf"""{ART}
SELECT id, regexp_replace(regexp_replace({FLAT}, '([a-z])([A-Z][a-z])', '\1 \2', 'g'), '([a-zA-Z])([,;])([A-Z])', '\1\2 \3', 'g') AS text
FROM (SELECT id, regexp_replace(body, '[.] ', '', 'g') || '   agoRachel Murphy,BBC;News' AS t FROM articles) q""")
def _(v: Views):
    t = F.concat(F.regexp_replace("body", "[.] ", ""), F.lit("   agoRachel Murphy,BBC;News"))
    return v.articles.select("id", S.repair_text(t).alias("text"))


@query("sca_25_json_arrays", f"{with_views('keywords')} SELECT id, array_to_string(api_keywords, '|') AS keywords FROM keywords")
def _(v: Views):
    return v.keywords.select("id", S.json_to_strings(S.strings_to_json(col("api_keywords"))).alias("keywords"))


@query("sca_26_source_quality", f"""{ART}
SELECT id, {C.r(C.source_quality('p', 1))} AS quality, {C.r(C.source_quality('p', 1, True))} AS clamped, {C.r(C.source_quality('p', 0))} AS by_zero
FROM (SELECT id, coalesce(api_source_priority * (CASE WHEN id % 3 = 0 THEN 5 ELSE 1 END), 1) AS p FROM articles) q WHERE p > 0""")
def _(v: Views):
    p = F.coalesce(col("api_source_priority") * F.when(col("id") % 3 == 0, 5).otherwise(1), F.lit(1))
    rows = v.articles.select("id", p.alias("p")).filter("p > 0")
    return rows.select("id", S.source_quality(col("p"), 1).alias("quality"), S.source_quality(col("p"), 1, clamp=True).alias("clamped"), S.source_quality(col("p"), 0).alias("by_zero"))


@query("sca_27_category_weight", f"""{ART}
SELECT id, {C.category_weight("c")} AS weight FROM (SELECT id, CASE id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'sports' ELSE llm_category END AS c FROM articles) q""")
def _(v: Views):
    c = F.when(col("id") % 10 == 1, F.lit("sports")).when(col("id") % 10 != 0, col("llm_category"))
    return v.articles.select("id", S.category_weight(c).alias("weight"))


@query("sca_28_step_scores", f"""{ART}, h AS (SELECT id, {C.hours(C.AS_OF, 'published_at')} AS h FROM articles)
SELECT id, CASE WHEN id % 6 <= 1 THEN 0.2::DOUBLE WHEN id % 6 = 2 THEN 0.55::DOUBLE WHEN id % 6 = 3 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS coverage,
 CASE WHEN id % 5 >= 3 THEN 1.15::DOUBLE WHEN id % 5 = 2 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS corroboration,
 least((id % 9) / 4.0::DOUBLE, 1.0) AS momentum, {C.r('greatest(0.0, 1 - h / 24)')} AS freshness,
 {C.hours_step('h')} AS age_step FROM h""")
def _(v: Views):
    h = S.hours_between(as_of(), col("published_at"))
    return v.articles.select(
        "id", S.coverage_score(col("id") % 6).alias("coverage"), S.corroboration_bonus(col("id") % 5).alias("corroboration"),
        S.momentum_score(col("id") % 9).alias("momentum"), S.freshness_score(h).alias("freshness"), S.age_step(h).alias("age_step"))
