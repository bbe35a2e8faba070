"""The corpus queries by name, each over its whole table, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convtrie, decontaminate, hamming, htmltext, langid, linededup, mixing, packing, periodic, secrets, simhash, tokencount, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check.strip()
        return run

    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_copies(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(found.fp).alias("fingerprint"), "component_id")


@query("op4_line_dedup", """
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM split),
held AS (SELECT DISTINCT doc_id, unnest(keys) AS key FROM keyed),
many AS (SELECT key, max(doc_id) AS keeper FROM held WHERE length(key) >= 40 GROUP BY key HAVING count(*) >= 5),
gone AS (SELECT held.doc_id, list(held.key) AS gone FROM held JOIN many ON held.key = many.key WHERE held.doc_id <> keeper GROUP BY held.doc_id),
kept AS (SELECT keyed.doc_id, len(lines) AS n_lines,
  list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), keys[i])) AS kept
  FROM keyed LEFT JOIN gone ON keyed.doc_id = gone.doc_id)
SELECT doc_id, n_lines, n_lines - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM kept
""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_decontaminate", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT item_id, len(w[i:i + 12]) AS n, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
met AS (SELECT doc_id, i, item_id, n FROM (SELECT doc_id, i, n AS m, array_to_string(w[i:i + n - 1], ' ') AS said FROM starts JOIN sizes ON i + n - 1 <= len(w))
  JOIN windows ON said = phrase AND m = n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT words.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits ON words.doc_id = hits.doc_id LEFT JOIN named ON words.doc_id = named.doc_id
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(decontaminate.search(table(spark, folder, "documents"), table(spark, folder, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op9_mix_sources")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(found.doc_id).alias("held_out"), "lang_pred", "score")


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return found.select("doc_id", toxicity.held_out(found.doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_KINDS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, source, row_no, {i} AS k, '{name}' AS kind, {least} AS least, regexp_split_to_array(text, $${pattern}$$) AS pieces, "
    f"regexp_extract_all(text, $${pattern}$$) AS whole, regexp_extract_all(text, $${pattern}$$, {group}) AS vals FROM docs"
    for i, (name, pattern, group, least) in enumerate((n, p.split(")", 1)[1] if p.startswith("(?=") else p, g, least) for n, p, g, least in secrets.KINDS))


@query("op2_secret_scan", f"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
kinds AS ({_KINDS_SQL}),
hits AS (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM kinds WHERE len(whole) > 0),
found AS (SELECT doc_id, source, row_no, k, kind, whole[i] AS hit, vals[i] AS val,
  CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM hits WHERE length(vals[i]) >= least),
owned AS (SELECT val, count(DISTINCT source) AS owners, count(DISTINCT doc_id) AS repositories FROM found GROUP BY val),
judged AS (SELECT found.*, kind || ':' || s || ':' || (s + length(hit)) AS span, owners >= {secrets.COPIED_OWNERS} OR repositories >= {secrets.COPIED_REPOSITORIES} OR regexp_matches(found.val, '{secrets.PLACEHOLDER}') AS copied,
  len(list_distinct(string_split(found.val, ''))) >= {secrets.RANDOM_CHARS} AS random FROM found JOIN owned ON found.val = owned.val),
counted AS (SELECT row_no, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(span, ',' ORDER BY s, k) FILTER (k < {secrets.BASE}), '') AS base, string_agg(span, ',' ORDER BY s, k) AS spans,
  count(*) FILTER (NOT copied AND random) AS n_live, count(*) FILTER (copied) AS n_copied FROM judged GROUP BY row_no)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN counted ON docs.row_no = counted.row_no
""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.counted(secrets.scan(table(spark, folder, "documents")))


@query("op5_main_text", r"""
WITH articles AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|$)', 1, 's'), '</?(?:p|h1)>') AS parts FROM pages),
plain AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g')) AS parts FROM articles),
decoded AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;?', '&', 'g')) AS parts FROM plain),
cleaned AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM cleaned
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = htmltext.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op3_token_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, folder, "documents"))


@query("op7_exact_top_k", """
WITH codes AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings),
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id,
  CAST(list_sum(list_transform(list_zip(q.bits, e.bits), lambda p: CAST(p[1] <> p[2] AS INTEGER))) AS INTEGER) AS distance
  FROM codes q JOIN codes e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, neighbour_id, distance, rank FROM ranked WHERE rank <= 10
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return hamming.search(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


@query("op11_best_fit_packing")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def _crc32_sql(digits: str) -> str:
    """CRC-32 of a string of ASCII characters, bit by bit."""
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(length({digits})),
  lambda k: [CAST(ascii({digits}[k + 1]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295)"""


@query("op12_periodic_runs", rf"""
WITH words AS (SELECT doc_id, row_number() OVER () AS row_no, CAST(doc_id AS VARCHAR) AS d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
hashed AS (SELECT doc_id, row_no, w, len(w) AS n, CAST({_crc32_sql('d')} AS BIGINT) AS h FROM words),
planned AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM hashed),
turned AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planned),
said AS (SELECT doc_id, row_no, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM turned),
one AS (SELECT row_no, n, unnest(range(n)) AS i, unnest(w) AS word FROM said),
met AS (SELECT x.row_no, y.i - x.i AS q, x.i FROM one x JOIN one y ON x.row_no = y.row_no AND x.word = y.word AND x.i < y.i AND 2 * (y.i - x.i) <= x.n),
grouped AS (SELECT row_no, q, i, i - row_number() OVER (PARTITION BY row_no, q ORDER BY i) AS part FROM met),
stretches AS (SELECT row_no, q, min(i) AS start, count(*) + q AS length FROM grouped GROUP BY row_no, q, part),
runs AS (SELECT row_no, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY row_no, start, length),
gone AS (SELECT DISTINCT row_no, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT row_no, string_agg(word, ' ' ORDER BY i) AS kept FROM one ANTI JOIN gone USING (row_no, i) GROUP BY row_no),
summed AS (SELECT row_no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
  first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best FROM runs GROUP BY row_no)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM said LEFT JOIN summed USING (row_no) LEFT JOIN rest USING (row_no)
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.with_repeats(table(spark, folder, "documents"))))


@query("op13_conversation_trie", rf"""
WITH ordered AS (SELECT CAST(conv_id AS BIGINT) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, CAST(c AS VARCHAR) AS d FROM (SELECT DISTINCT c FROM ordered)),
lent AS (SELECT c, CAST({_crc32_sql('d')} AS BIGINT) % 4 AS h FROM convs),
rebuilt AS (SELECT lent.c, no, role, text FROM lent JOIN ordered o ON o.c = lent.c - lent.c % 20 AND no <= h
  UNION ALL SELECT lent.c, no, role, text FROM lent JOIN ordered o ON o.c = lent.c AND no > h),
turns AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY no) AS depth, sha256(length(role) || ':' || role || text) AS turn,
  len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt),
paths AS (SELECT c, 0 AS depth, '' AS node, 0 AS words FROM lent
  UNION ALL SELECT c, depth, sha256(string_agg(turn, '') OVER (PARTITION BY c ORDER BY depth)) AS node, words FROM turns),
sizes AS (SELECT c, max(depth) AS d FROM paths GROUP BY c),
nodes AS (SELECT depth, node, min(c) AS conv_id, count(*) AS n_convs, min(words) AS words FROM paths GROUP BY depth, node),
linked AS (SELECT n.*, up.depth AS up_depth, up.node AS up_node FROM nodes n LEFT JOIN paths up ON up.c = n.conv_id AND up.depth = n.depth - 1),
kids AS (SELECT up_depth AS depth, up_node AS node, count(*) AS n_children FROM linked WHERE up_depth IS NOT NULL GROUP BY up_depth, up_node),
below AS (SELECT a.depth, a.node, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.node IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node JOIN paths a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.node),
ends AS (SELECT p.depth, p.node, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM paths p JOIN sizes s ON s.c = p.c AND s.d = p.depth GROUP BY p.depth, p.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM linked n LEFT JOIN nodes up ON up.depth = n.up_depth AND up.node = n.up_node LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node
JOIN below b ON b.depth = n.depth AND b.node = n.node LEFT JOIN ends e ON e.depth = n.depth AND e.node = n.node
""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return convtrie.prefix_trie(convtrie.rebuilt_paths(table(spark, folder, "conversations")))
