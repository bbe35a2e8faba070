"""Queries of text jobs (TXT) and model input and output (MOD)."""

from pyspark.sql import functions as F

from .. import config, rules
from ..functions import scalars as S
from ..operators import feed, modelio, textjobs, timeline
from . import check_sql as C
from .catalog_relational import _PARSED, _line_check
from .catalog_scans import _CHECK_FIELDS, unified_articles
from .registry import query
from .views import Views, as_of, with_views

col = F.col
ART = with_views("articles")


# ---- TXT --------------------------------------------------------------------------------

_PAGE_PARTS = r"""parts AS (SELECT page_id, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '<p>')[2:] AS l FROM pages),
plain AS (SELECT page_id, list_transform(l, lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS l FROM parts),
decoded AS (SELECT page_id, list_transform(l, lambda x: regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g')) AS l FROM plain),
flat AS (SELECT page_id, list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '') AS l FROM decoded),
repaired AS (SELECT page_id, array_to_string(list_transform(l, lambda x: regexp_replace(regexp_replace(x, '([a-z])([A-Z][a-z])', '\1 \2', 'g'), '([a-zA-Z])([,;])([A-Z])', '\1\2 \3', 'g')), chr(10) || chr(10)) AS t FROM flat)"""


@query("txt_01_page_blocks", f"""WITH {_PAGE_PARTS}
SELECT page_id, '' AS byline, CASE WHEN length(t) >= 50 THEN t END AS text, CASE WHEN length(t) < 50 THEN 'failed' WHEN length(t) < 300 THEN 'thin' ELSE 'full' END AS status FROM repaired""")
def _(v: Views):
    return textjobs.page_texts(v.pages)


_BYLINED = """SELECT doc_id, 'Jane Reporter ' || (doc_id % 5) AS nm, 'Jane Reporter ' || (doc_id % 5) || chr(10) || chr(10) || 'By Jane Reporter ' || (doc_id % 5) || ', News Desk' || chr(10) || chr(10)
 || CASE WHEN doc_id % 3 = 0 THEN 'Published 3 hours ago' || chr(10) || chr(10) ELSE '' END || text AS t FROM documents"""


@query("txt_02_strip_bylines", f"""
WITH RECURSIVE src AS ({_BYLINED}), b AS (SELECT doc_id, lower(nm) AS nm, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS k, b FROM (
 SELECT doc_id, nm, unnest(string_split(t, chr(10) || chr(10))) AS b, unnest(generate_series(1, len(string_split(t, chr(10) || chr(10))))) AS p FROM src) q WHERE {C.trim('b')} <> ''),
f AS (SELECT *, {C.trim('b')} AS x, lower({C.trim('b')}) AS low FROM b),
g AS (SELECT *, CASE WHEN contains(low, nm) THEN length(nm)::DOUBLE / length(x) > 0.5 OR length(x) < length(nm) + 40 ELSE length(x) < length(nm) AND contains(nm, low) END AS by_name,
 length(x) < 80 AND NOT ends_with(x, '.') AND regexp_matches(x, {C.q('(?i)' + rules.BYLINE_META)}) AS meta FROM f),
walk(doc_id, k, n, keep) AS (SELECT DISTINCT doc_id, 0::BIGINT, 0, []::BIGINT[] FROM src UNION ALL
 SELECT g.doc_id, g.k, CASE WHEN d THEN n + 1 ELSE n END, CASE WHEN d THEN keep ELSE list_append(keep, g.k) END FROM (
  SELECT g.doc_id, g.k, w.n, w.keep, w.n < 3 AND (g.by_name OR (w.n > 0 AND g.meta)) AS d FROM walk w JOIN g ON g.doc_id = w.doc_id AND g.k = w.k + 1) g),
kept AS (SELECT doc_id, unnest(keep) AS k FROM (SELECT doc_id, arg_max(keep, k) AS keep FROM walk GROUP BY doc_id) z),
res AS (SELECT src.doc_id, any_value(src.t) AS t, coalesce(string_agg(b.b, chr(10) || chr(10) ORDER BY b.k), '') AS out FROM src LEFT JOIN kept USING (doc_id) LEFT JOIN b USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CASE WHEN length(out) < length(t) * 0.4 THEN t ELSE out END AS text FROM res""")
def _(v: Views):
    """Documents with a byline, its repetition and a time line in front."""
    name = F.concat(F.lit("Jane Reporter "), (col("doc_id") % 5).cast("string"))
    text = F.concat_ws("\n\n", name, F.concat(F.lit("By "), name, F.lit(", News Desk")), F.when(col("doc_id") % 3 == 0, F.lit("Published 3 hours ago")), "text")
    rows = v.documents.select("doc_id", name.alias("byline"), text.alias("text"))
    return textjobs.strip_bylines(rows, "text", "byline").select("doc_id", "text")


# An article text in blocks, with byline-like blocks and a heading.
_BLOCKS = """'By Jane Doe' || chr(10) || chr(10) || 'Senior Correspondent, source desk' || chr(10) || chr(10) || '   ' || chr(10) || chr(10) || source_name || ' report' || chr(10) || chr(10) || chr(10)
 || '###HEADING:### Part ' || CAST(id AS VARCHAR(20)) || chr(10) || chr(10) || replace(body, chr(10), ' ') || chr(10) || chr(10) || '2 hours ago' || chr(10) || chr(10) || 'by someone' || chr(10) || chr(10) || 'end ' || replace(body, chr(10), ' ')"""
_BYLINE = f"""(length({C.trim('b')}) <= 150 AND {C.trim('b')} <> '' AND ({C.any_match(C.trim('b'), rules.BYLINE_BLOCKS)} OR coalesce(source_name <> '' AND contains(lower({C.trim('b')}), lower(source_name)), false)))"""
_DISPLAY = f"""t AS (SELECT id, source_name, regexp_split_to_array({_BLOCKS}, '\\n\\n+') AS l FROM articles),
b AS (SELECT id, source_name, unnest(l) AS b, generate_subscripts(l, 1) AS p FROM t),
f AS (SELECT *, {_BYLINE} AS hit FROM b WHERE {C.trim('b')} <> ''), s AS (SELECT *, sum(hit::INT) OVER (PARTITION BY id ORDER BY p) AS seen FROM f),
k AS (SELECT id, b, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS pos FROM s WHERE NOT hit OR seen > 4)"""
_KIND = f"CASE WHEN starts_with({C.trim('b')}, '###HEADING:###') THEN 'heading' ELSE 'paragraph' END"
_BODY = f"CASE WHEN starts_with({C.trim('b')}, '###HEADING:###') THEN {C.trim(f'substr({C.trim(chr(98))}, 15)')} ELSE {C.trim('b')} END"


def _display(v: Views):
    rows = v.articles.select("id", "source_name", F.expr(_BLOCKS.replace("VARCHAR(20)", "STRING")).alias("text"))
    return textjobs.display_blocks(rows, "id", "text", "source_name")


@query("txt_03_display_blocks", f"{ART}, {_DISPLAY} SELECT id, pos, {_BODY} AS block FROM k")
def _(v: Views):
    return _display(v).drop("kind")


@query("txt_04_block_kinds", f"{ART}, {_DISPLAY} SELECT id, pos, {_KIND} AS kind FROM k")
def _(v: Views):
    return _display(v).drop("block")


_SCRAPED = "SELECT id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN title ELSE body END AS scraped_text FROM"
_LOOKUPS = f"""p AS (SELECT a.id, c.pos, c.text, {C.grams('c.title')} AS g1, {C.grams('a.title')} AS g2 FROM lookup_candidates c JOIN articles a ON a.id = c.article_id WHERE a.source_api <> 'worldnews' AND length(c.text) >= 200),
lk AS (SELECT id, arg_min(text, pos) AS lookup_text FROM p WHERE {C.jaccard('g1', 'g2')} > 0.75 GROUP BY id)"""


@query("txt_05_enrichment", f"""{with_views('lookup_candidates')}, {_LOOKUPS}, sc AS (SELECT *, CASE WHEN coalesce(length(scraped_text), 0) < 50 THEN 'failed' WHEN length(scraped_text) < 300 THEN 'thin' ELSE 'full' END AS st
 FROM ({_SCRAPED} articles WHERE id % 10 <> 9) q),
j AS (SELECT a.id, a.source_api, a.content, a.full_text, sc.scraped_text, coalesce(sc.st, 'failed') AS st, lk.lookup_text FROM articles a LEFT JOIN sc ON sc.id = a.id LEFT JOIN lk ON lk.id = a.id),
d AS (SELECT *, coalesce(source_api = 'worldnews' AND length(content) >= 200, false) AS own, st IN ('failed', 'thin') AND coalesce(length(lookup_text) >= 200, false) AS looked FROM j)
SELECT id, CASE WHEN own THEN content WHEN looked THEN lookup_text WHEN st IN ('full', 'thin') THEN scraped_text ELSE full_text END AS full_text, CASE WHEN own OR looked THEN 'lookup' ELSE st END AS scrape_status FROM d""")
def _(v: Views):
    scraped = v.spark.sql(_SCRAPED + " {articles} WHERE id % 10 <> 9", articles=v.articles)
    scraped = scraped.withColumn("scraped_status", S.scrape_class(col("scraped_text")))
    lookups = textjobs.lookup_text(v.articles, v.lookup_candidates)
    return textjobs.enrich(v.articles, scraped, lookups).select("id", "full_text", "scrape_status")


# ---- MOD --------------------------------------------------------------------------------

_NUM = "regexp_replace({x}::VARCHAR, '\\.0$', '')"
_SIGNALS = """concat_ws(' | ', 'IPTC Category: ' || nullif(api_iptc_category, ''), CASE WHEN entities <> '' THEN 'Entities: ' || entities END,
 'Sentiment: ' || regexp_replace(api_sentiment::VARCHAR, '[.]0$', ''), 'API Relevance Score: ' || regexp_replace(api_relevance_score::VARCHAR, '[.]0$', ''),
 'Source Authority Rank: ' || api_source_priority, CASE WHEN keywords <> '' THEN 'Keywords: ' || keywords END,
 CASE WHEN nullif(api_iptc_category, '') IS NULL THEN 'API Category: ' || nullif(api_category, '') END, 'Country: ' || nullif(api_country, ''),
 CASE WHEN ctx < 200 THEN 'Short API snippet only (' || ctx || ' chars) — apply Rule 13 before assigning Tier A' END)"""


@query("mod_01_classify_requests", f"""{_CHECK_FIELDS},
s AS (SELECT *, {_SIGNALS} AS sig FROM fields),
b AS (SELECT (n - 1) // 5 AS batch_id, (n - 1) % 5 AS pos, concat_ws(chr(10), '[' || ((n - 1) % 5 + 1) || ']', 'Title: ' || title, 'Description: ' || nullif(substr(description, 1, 500), ''),
 'Content (excerpt): ' || nullif(substr(content, 1, 1000), ''), 'Source: ' || coalesce(nullif(source_domain, ''), 'unknown'), 'Published: ' || coalesce(replace(published_at, ' ', 'T') || '.000Z', 'unknown'),
 CASE WHEN sig <> '' THEN 'API Signals: {{ ' || sig || ' }}' END) AS block FROM s)
SELECT batch_id, count(*) AS n, 'Classify these ' || count(*) || ' articles:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY pos) AS request FROM b GROUP BY 1""")
def _(v: Views):
    return modelio.classify_requests(unified_articles(v), "batch_seq")


@query("mod_02_signal_line", f"{_CHECK_FIELDS}, s AS (SELECT n, {_SIGNALS} AS sig FROM fields) SELECT n AS batch_seq, CASE WHEN sig <> '' THEN 'API Signals: {{ ' || sig || ' }}' ELSE '' END AS signals FROM s")
def _(v: Views):
    return unified_articles(v).select("batch_seq", modelio.signal_line().alias("signals"))


@query("mod_03_parse_responses", f"""{with_views('responses')}, {_PARSED}
SELECT batch_id, pos, llm_tier, llm_category, llm_reason, CASE WHEN llm_tier IN ('A', 'B') THEN 'accepted' ELSE 'rejected' END AS filter_status FROM parsed""")
def _(v: Views):
    return modelio.parse_classification(v.responses)


def word_counts(texts: list[str]) -> list[str]:
    """A stand-in model for queries and tests: the number of words."""
    return [str(len((t or "").split())) for t in texts]


@query("mod_04_batch_scoring", f"""{ART} SELECT id, len(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> ''))::VARCHAR AS output FROM articles""")
def _(v: Views):
    return modelio.score_batches(v.articles, word_counts, "title", "id", "string")


@query("mod_05_embedding_input", f"""{ART}
SELECT id, title || chr(10) || CASE WHEN length(full_text) >= 300 THEN substr(full_text, 1, 2000) WHEN length(content) >= 80 THEN substr(content, 1, 2000) ELSE coalesce(description, '') END AS text FROM articles""")
def _(v: Views):
    return v.articles.select("id", S.embedding_input(col("title"), col("full_text"), col("content"), col("description")).alias("text"))


_TEXT = "coalesce(nullif(a.full_text, ''), nullif(a.content, ''), nullif(a.description, ''), '')"


@query("mod_06_chat_context", f"""{with_views('articles', 'vectors', recursive=True)}, cur AS (SELECT story_id, arg_max(id, published_at) AS article_id FROM articles WHERE story_id IS NOT NULL GROUP BY 1),
{_line_check('coalesce((SELECT article_id FROM cur WHERE cur.story_id = c.story_id), -1)')},
oth AS (SELECT l.story_id, cur.article_id, l.id, row_number() OVER (PARTITION BY l.story_id ORDER BY l.pos) + 1 AS no, 3500 // count(*) OVER (PARTITION BY l.story_id) AS share FROM line l JOIN cur ON cur.story_id = l.story_id WHERE l.id <> cur.article_id),
tails AS (SELECT o.story_id, string_agg('CONTEXT — Timeline Article ' || o.no || ': "' || a.title || '" (' || strftime(a.published_at, '%b %-d, %Y') || ')' || chr(10) || substr({_TEXT}, 1, o.share), chr(10) || chr(10) ORDER BY o.no) AS tail
 FROM oth o JOIN articles a ON a.id = o.id GROUP BY 1)
SELECT cur.story_id, cur.article_id, concat_ws(chr(10) || chr(10), 'CONTEXT — Current Article (what the user is reading): "' || a.title || '" (' || strftime(a.published_at, '%b %-d, %Y') || ')' || chr(10) || substr({_TEXT}, 1, 2500), t.tail) AS context
FROM cur JOIN articles a ON a.id = cur.article_id LEFT JOIN tails t ON t.story_id = cur.story_id""")
def _(v: Views):
    current = timeline.current_articles(v.articles)
    pins = current.select("story_id", col("article_id").alias("pinned_id"))
    line = timeline.select_timeline(timeline.daily_candidates(v.embedded(), as_of()), pins)
    return timeline.chat_context(line, current, v.articles)


@query("mod_07_chat_history", """
WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL)
SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM h WHERE back <= 10""")
def _(v: Views):
    return timeline.chat_history(v.messages)


@query("mod_08_story_title", f"""{with_views('stories')}, p AS (SELECT id, CASE WHEN id % 3 = 0 THEN '  "Made title ' || id || '"  ' WHEN id % 3 = 1 THEN '""' END AS title FROM stories WHERE id % 5 <> 0)
SELECT s.id, coalesce(nullif({C.trim('s.title')}, ''), nullif({C.trim(f"regexp_replace({C.trim('p.title')}, '^[{chr(34)}“”‘’{chr(39)}{chr(39)}]+|[{chr(34)}“”‘’{chr(39)}{chr(39)}]+$', '', 'g')")}, '')) AS title FROM stories s LEFT JOIN p ON p.id = s.id""")
def _(v: Views):
    made = F.when(col("id") % 3 == 0, F.concat(F.lit('  "Made title '), col("id").cast("string"), F.lit('"  '))).when(col("id") % 3 == 1, F.lit('""'))
    produced = v.stories.filter(col("id") % 5 != 0).select("id", made.alias("title"))
    return modelio.story_titles(v.stories, produced)


@query("mod_09_summary_title", f"""{ART} SELECT id, substr(regexp_replace(string_split(s, chr(10))[1], '^[•\\-*]\\s*', ''), 1, 500) AS title FROM (SELECT id, substr(summary, 2) AS s FROM articles WHERE summary IS NOT NULL) q""")
def _(v: Views):
    rows = v.articles.filter("summary IS NOT NULL")
    return rows.select("id", modelio.title_from_summary(F.expr("substr(summary, 2)")).alias("title"))


def first_words(texts: list[str]) -> list[str]:
    """A stand-in summariser for queries and tests: the first five words as a bullet."""
    return ["• " + " ".join((t or "").split()[:5]) for t in texts]


_FIVE = "'• ' || array_to_string(list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')[1:5], ' ')"


@query("mod_10_two_level_summary", f"""{ART},
one AS (SELECT id, id // 3 AS story_id, {_FIVE.format(x='title')} AS s FROM articles), st AS (SELECT story_id, count(*) AS n, string_agg(s, chr(10) || chr(10) ORDER BY id) AS t FROM one GROUP BY 1),
two AS (SELECT story_id, CASE WHEN n = 1 THEN t ELSE {_FIVE.format(x='t')} END AS summary FROM st)
SELECT story_id, summary, substr(regexp_replace(string_split(summary, chr(10))[1], '^[•\\-*]\\s*', ''), 1, 500) AS title FROM two""")
def _(v: Views):
    rows = v.articles.select("id", F.floor(col("id") / 3).alias("story_id"), "title").withColumnRenamed("title", "text")
    return modelio.two_level_summary(rows, first_words)


@query("mod_11_summary_requests", f"""{with_views('briefs')},
t AS (SELECT id, title, coalesce(CASE WHEN length(full_text) >= 50 THEN full_text END, CASE WHEN length(content) >= 50 THEN content END, CASE WHEN length(description) >= 50 THEN description END) AS text FROM articles WHERE id IN (SELECT unnest(article_ids) FROM briefs))
SELECT id, 'Title: ' || title || chr(10) || chr(10) || text AS request FROM t WHERE text IS NOT NULL""")
def _(v: Views):
    return modelio.summary_requests(v.articles, v.briefs.select(F.explode("article_ids").alias("id")))
