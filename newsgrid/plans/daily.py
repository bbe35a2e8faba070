"""One daily run: landed pages to articles, stories, brief and metrics.

Each stage is a DataFrame step over the state tables below ``root``. Results of the expensive stages are
written once (:func:`newsgrid.session.cut`), so later stages never recompute them and lost
executors only repeat the running stage. State tables change together, in one snapshot at the end of a run
(:mod:`newsgrid.sources.snapshots`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config, schemas
from ..functions import scalars as S
from ..operators import brief, dedup, feed, filters, keyfilter, metrics, modelio, numbering, similarity, stories, storystate, textjobs
from ..session import cut, cut_counted
from ..sources import landed, tables
from ..sources.snapshots import Commit, Store

col = F.col
Model = Callable[[list[str]], list]

STORED_ARTICLE = T.StructType(
    [T.StructField("id", T.LongType())]
    + schemas.ARTICLE.fields
    + [T.StructField(n, t) for n, t in (
        ("full_text", T.StringType()), ("scrape_status", T.StringType()), ("summary", T.StringType()),
        ("embedding", T.ArrayType(T.DoubleType())), ("story_id", T.LongType()), ("importance_score", T.DoubleType()),
        ("main_genre", T.StringType()), ("homepage_eligible", T.BooleanType()), ("llm_tier", T.StringType()),
        ("llm_category", T.StringType()), ("llm_reason", T.StringType()), ("llm_scored_at", T.TimestampType()),
        ("filter_status", T.StringType()), ("created_at", T.TimestampType()), ("day", T.DateType()))]
)
STORY = T.StructType([T.StructField(n, t) for n, t in (
    ("id", T.LongType()), ("title", T.StringType()), ("centroid", T.ArrayType(T.DoubleType())), ("status", T.StringType()),
    ("article_count", T.LongType()), ("first_seen_at", T.TimestampType()), ("last_updated_at", T.TimestampType()),
    ("keyword_set", T.ArrayType(T.StringType())), ("canonical_embedding", T.ArrayType(T.DoubleType())),
    ("main_genre", T.StringType()), ("llm_category", T.StringType()), ("importance_score", T.DoubleType()),
    ("source_count", T.LongType()), ("representative_article_id", T.LongType()), ("day", T.DateType()))])
BRIEF = T.StructType([T.StructField(n, t) for n, t in (
    ("article_ids", T.ArrayType(T.LongType())), ("story_ids", T.ArrayType(T.LongType())), ("user_id", T.LongType()), ("brief_date", T.DateType()))])
STATE_BUCKETS = 64  # folders of the story state, by story
SOURCE_ERRORS = "source_api string, place string, error string, created_at timestamp, run string"
REJECTION_LOG = T.StructType([*schemas.REJECTION.fields, T.StructField("day", T.DateType())])


@dataclass
class Models:
    """User functions on lists of texts. ``classify`` gets one request per batch of five and
    returns response texts; ``embed`` returns vectors; ``summarise`` returns texts."""

    classify: Model
    embed: Model
    summarise: Model


@dataclass
class Run:
    """Counters, the brief, and what of the sources could not be read (source_api, place, error)."""

    counters: dict[str, int] = field(default_factory=dict)
    brief: DataFrame | None = None
    source_errors: DataFrame | None = None


def _table(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    """A state table as of the newest snapshot."""
    return Store(spark, root).read(name, schema)


def _next_run_id(state: Commit) -> int:
    runs = state.read("runs", T.StructType([T.StructField("id", T.LongType())]))
    return (runs.agg(F.max("id")).first()[0] or 0) + 1


def run_day(spark: SparkSession, pages: dict[str, DataFrame | str], root: str, as_of: Column, models: Models,
            scraped: DataFrame | None = None, lookups: DataFrame | None = None, max_articles: int | None = None) -> Run:
    """Run one day and log it; a failure is logged and raised again.

    ``pages`` maps a source to its landed page table or to the folder of its landed files. A source that cannot be read gives no rows, a
    file that cannot be read gives none of its own; both are logged in ``source_errors`` and the run goes on. ``scraped`` is (url, html) of fetched web
    pages, ``lookups`` is (url, pos, title, text) of title lookups. All tables of the state change together, in one snapshot at
    the end; a run that fails or is killed changes none of them (a failure adds its row to the log of runs)."""
    state = Store(spark, root).begin()
    run_id = _next_run_id(state)
    try:
        run = _run(spark, pages, state, as_of, models, scraped, lookups, max_articles)
        state.append(_run_log(spark, run_id, as_of, as_of, run.counters, None), "runs")
        row = metrics.daily_metrics(state.read("articles", STORED_ARTICLE), state.read("rejection_log", REJECTION_LOG), state.read("runs", run_log_schema(spark)), F.to_date(as_of))
        state.upsert(row, "daily_metrics", ["date"], "date")
        state.finish()
    except Exception as error:
        failed = Store(spark, root).begin()
        failed.append(_run_log(spark, run_id, as_of, as_of, {}, str(error)), "runs")
        failed.finish()
        raise
    return run


def _run_log(spark: SparkSession, run_id: int, started: Column, ended: Column, counters: dict, error: str | None) -> DataFrame:
    return spark.range(1).select(*tables.run_row(run_id, started, ended, counters, error))


def run_log_schema(spark: SparkSession) -> T.StructType:
    now = F.lit(None).cast("timestamp")
    return _run_log(spark, 0, now, now, {}, None).schema


def _log_rejections(parts: list[DataFrame], state: Commit, as_of: Column) -> None:
    """All rejections of a run as one partition of the log, named by the time of the run: a run that is repeated replaces its own."""
    shaped = []
    for rows in parts:
        full = rows.withColumns({"created_at": as_of, "day": F.to_date(as_of)})
        missing = [f for f in REJECTION_LOG.fields if f.name not in full.columns]
        full = full.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else full
        shaped.append(tables.clean_strings(full.select(*[col(f.name).cast(f.dataType) for f in REJECTION_LOG.fields])))
    log = reduce(DataFrame.unionByName, shaped).withColumn("run", F.date_format(as_of, "yyyyMMddHHmmss"))
    state.replace(log, "rejection_log", "run")


def _ingest(spark: SparkSession, pages: dict[str, DataFrame | str], as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(batch, errors): the records of all sources that can be read, and the faults of the others."""
    faults, tables_ = [], {}
    for name, given in pages.items():
        if isinstance(given, str):
            given, errors = landed.read_tolerant(spark, name, given)
            faults.append(errors)
        tables_[name] = given
    loaders = {name: (lambda n=name, p=frame: _first_urls(landed.NORMALISERS[n](p, as_of))) for name, frame in tables_.items()}
    rows, errors = landed.isolated(spark, loaders, _normal_schema())
    return landed.concat_sources(rows, store=False), reduce(DataFrame.unionByName, faults, errors)


def _run(spark, pages, state: Commit, as_of, models, scraped, lookups, max_articles) -> Run:
    run = Run()
    count = run.counters

    # -- ingest, rules, duplicates
    batch, errors = _ingest(spark, pages, as_of)
    run.source_errors = cut(errors)
    state.replace(run.source_errors.withColumns({"created_at": as_of, "run": F.date_format(as_of, "yyyyMMddHHmmss")}), "source_errors", "run")
    if max_articles is not None:
        batch = batch.filter(col("batch_seq") <= max_articles)
    ruled, seen = cut_counted(
        filters.with_rule(batch, as_of), articles_fetched=F.count(F.lit(1)), articles_filtered=F.count_if(col("rule").isNotNull()))
    count.update(seen)
    passed = ruled.filter("rule IS NULL").drop("rule")
    stored = state.read("articles", STORED_ARTICLE)
    known_hashes = _known_hashes(state, stored)
    judged, seen = cut_counted(dedup.deduplicate(passed, stored, as_of, filters=known_hashes), articles_deduped=F.count_if(col("rule").isNotNull()))
    count.update(seen)
    unique = judged.filter("rule IS NULL").drop("rule")

    # -- classification
    batched = cut(numbering.batch_number(unique, "batch_seq", config.CLASSIFY_BATCH))
    requests = cut(modelio.classify_requests(unique, "batch_seq"))
    answers = modelio.score_batches(
        requests, models.classify, "request", "batch_id", "string", fallback=modelio.SERVER_ERROR, readable=modelio.is_json)
    responses = cut(requests.select("batch_id", "n").join(answers.withColumnRenamed("output", "response"), "batch_id"))
    classified, seen = cut_counted(
        modelio.merge_results(batched, modelio.parse_classification(responses)).drop("batch_id", "pos"), articles_classified=F.count(F.lit(1)))
    count.update(seen)

    # -- new articles
    accepted = tables.clean_strings(classified.filter("filter_status = 'accepted'"))
    fresh = tables.new_articles(accepted, stored)
    fresh, seen = cut_counted(fresh.withColumns({
        "main_genre": S.region(col("api_country"), col("source_domain")), "homepage_eligible": F.lit(True),
        "llm_scored_at": as_of, "created_at": as_of, "day": F.to_date(as_of), "full_text": F.lit(None).cast("string"),
        "scrape_status": F.lit("pending"), "summary": F.lit(None).cast("string"), "importance_score": F.lit(None).cast("double"),
    }), articles_stored=F.count(F.lit(1)))
    count.update(seen)

    # -- texts and vectors
    fresh = cut(_enriched(fresh, stored, as_of, scraped, lookups))
    todo = fresh.withColumn("embedding", F.lit(None).cast("array<double>"))
    vectors = cut(modelio.embed_missing(todo, models.embed))
    fresh = cut(fresh.join(vectors, "id", "left"))

    # -- stories
    old = state.read("stories", STORY)
    windows = similarity.story_windows(old, stored, as_of)
    keyed = fresh.select("id", "embedding", col("api_keywords").alias("keywords"))
    matched = cut(similarity.match_sequential(keyed, windows).select("id", "story_id"))
    clusters = cut(similarity.cluster_articles(fresh.join(matched, "id", "left_anti").select("id", "embedding")))
    born, assigned = tables.new_stories(clusters, fresh, old, as_of)
    born, seen = cut_counted(born, stories_created=F.count(F.lit(1)))
    count.update(seen)
    assigned = clusters.join(born.select("seed_id", col("id").alias("story_id")), "seed_id").select("id", "story_id")
    members = cut(matched.unionByName(assigned))
    fresh = fresh.join(members, "id", "left")
    evicted = cut(dedup.evictions(fresh))
    fresh = cut(fresh.join(evicted.select("id", F.lit(True).alias("_out")), "id", "left").withColumn(
        "story_id", F.when(col("_out").isNull(), col("story_id"))).drop("_out"))
    joined, seen = cut_counted(matched.select(col("story_id").alias("id")).distinct(), stories_matched=F.count(F.lit(1)))
    count.update(seen)

    everything = stored.select(*[c for c in STORED_ARTICLE.names]).unionByName(_stored_shape(fresh))
    grown = _grow_stories(old, born, fresh, matched, evicted, everything, as_of)
    affected = joined.unionByName(born.select("id"))
    grown = cut(stories.refresh_metadata(grown, everything, affected, as_of))
    known = cut(storystate.merge(storystate.aged(_story_state(state, stored, as_of), as_of), storystate.parts(fresh, as_of)))
    scores = storystate.score_stories(grown, known, as_of).select("id", "importance_score", "representative_article_id")
    ranked = cut(tables.update_columns(grown, scores, "id", ["importance_score", "representative_article_id"]).select(*STORY.names))

    # -- brief and summaries
    chosen = cut(brief.select_brief(
        brief.candidates(fresh, ranked, fresh.select("id")).withColumn("score", brief.candidate_score())))
    picks = feed.summary_picks(everything, as_of)
    wanted = brief.ordered_union(chosen, picks)
    texts = modelio.summary_requests(everything, wanted)
    summaries, seen = cut_counted(
        modelio.score_batches(texts, models.summarise, "request", "id", "string", size=config.CLASSIFY_BATCH)
        .filter(F.coalesce("output", F.lit("")) != "").select("id", S.strip_null_chars(col("output")).alias("summary")), articles_summarized=F.count(F.lit(1)))
    count.update(seen)

    # -- state
    _log_rejections([
        filters.rejections(ruled.filter("rule IS NOT NULL")), filters.rejections(judged.filter("rule IS NOT NULL")), tables.tier_rejections(classified),
    ], state, as_of)
    late = cut(tables.update_columns(stored.join(summaries, "id", "left_semi"), summaries, "id", ["summary"]).select(*STORED_ARTICLE.names))
    state.append(_stored_shape(tables.update_columns(fresh, summaries, "id", ["summary"])), "articles", "day")
    if not late.isEmpty():
        state.upsert(late, "articles", ["id"], "day")
    if "hash_filters" in state.tables:
        state.replace(dedup.hash_filters(known_hashes, fresh), "hash_filters", "day")
    else:
        state.replace(dedup.hash_filters(known_hashes.sparkSession.createDataFrame([], keyfilter.SCHEMA), _stored_shape(fresh).unionByName(stored)), "hash_filters", "day")
    state.replace(known.withColumn("bucket", F.pmod("story_id", F.lit(STATE_BUCKETS))), "story_state", "bucket")
    if not ranked.isEmpty():
        state.upsert(ranked, "stories", ["id"], "day")
    if count["articles_stored"]:
        run.brief = cut(brief.brief_row(chosen, F.to_date(as_of)).select(*BRIEF.names))
        state.upsert(run.brief, "briefs", ["brief_date", "user_id"], "brief_date")
        count["brief_id"] = int(run.brief.select(F.date_format("brief_date", "yyyyMMdd")).first()[0])
    return run


def _story_state(state: Commit, stored: DataFrame, as_of: Column) -> DataFrame:
    """What earlier runs know of their stories; from the articles themselves where no run has kept it yet."""
    if "story_state" in state.tables:
        return state.read("story_state", storystate.SCHEMA)
    return storystate.parts(stored, as_of)


def _known_hashes(state: Commit, stored: DataFrame) -> DataFrame:
    """The filters of stored hashes; from the articles themselves where no run has kept them yet."""
    none = stored.sparkSession.createDataFrame([], keyfilter.SCHEMA)
    if "hash_filters" in state.tables:
        return state.read("hash_filters", none.schema)
    return cut(dedup.hash_filters(none, stored))


def _normal_schema() -> T.StructType:
    return T.StructType([T.StructField("seq", T.LongType()), *schemas.ARTICLE.fields])


def _first_urls(articles: DataFrame) -> DataFrame:
    return numbering.top_per_key(articles, ["source_api", "normalized_url_hash"], [col("seq")], 1).drop("rank")


def _stored_shape(fresh: DataFrame) -> DataFrame:
    return fresh.select(*[col(f.name).cast(f.dataType) for f in STORED_ARTICLE.fields])


def _enriched(fresh: DataFrame, stored: DataFrame, as_of: Column, scraped: DataFrame | None, lookups: DataFrame | None) -> DataFrame:
    """Full texts for articles whose domain is not cooling down."""
    spark = fresh.sparkSession
    if scraped is None:
        texts = spark.createDataFrame([], "id long, scraped_text string, scraped_status string")
    else:
        html = fresh.select("id", "url").join(scraped.select("url", "html"), "url").select("id", "html")
        texts = textjobs.page_texts(html, "id").select("id", col("text").alias("scraped_text"), col("status").alias("scraped_status"))
    if lookups is None:
        found = spark.createDataFrame([], "id long, lookup_text string")
    else:
        offered = fresh.select(col("id").alias("article_id"), "url").join(lookups, "url").drop("url")
        found = textjobs.lookup_text(fresh, offered)
    failing = metrics.failing_domains(stored, as_of)
    open_domains = metrics.without_cooldown(fresh, failing).select("id")
    done = textjobs.enrich(fresh.join(open_domains, "id", "left_semi"), texts, found)
    return done.select(*fresh.columns).unionByName(fresh.join(open_domains, "id", "left_anti"))


def _grow_stories(old: DataFrame, born: DataFrame, fresh: DataFrame, matched: DataFrame, evicted: DataFrame,
                  everything: DataFrame, as_of: Column) -> DataFrame:
    """Old and new stories with centroids and counts after matching and evictions."""
    added = matched.join(fresh.select("id", "embedding"), "id")
    touched = matched.select(col("story_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    merged = stories.merge_centroids(old, added).join(touched, "id", "left").withColumn(
        "last_updated_at", F.when(col("_hit"), as_of).otherwise(col("last_updated_at"))).drop("_hit")
    new_rows = born.drop("seed_id").withColumn("day", F.to_date(as_of))
    for f in STORY.fields:
        if f.name not in new_rows.columns:
            new_rows = new_rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    rows = merged.select(*STORY.names).unionByName(new_rows.select(*STORY.names))
    # stories that lost articles are averaged again over what remains
    lost = evicted.select("story_id").distinct()
    rest = stories.group_centroids(everything.join(lost, "story_id", "left_semi")).select(
        col("story_id").alias("id"), col("centroid").alias("_centroid"), col("n").alias("_n"))
    return rows.join(rest, "id", "left").withColumns({
        "centroid": F.coalesce("_centroid", "centroid"), "article_count": F.coalesce("_n", "article_count"),
        "last_updated_at": F.when(col("_n").isNotNull(), as_of).otherwise(col("last_updated_at")),
    }).drop("_centroid", "_n")
