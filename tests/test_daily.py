"""Two daily runs over derived landed pages: counters reconcile, state stays unique."""

import hashlib
import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from newsgrid.operators import dedup, keyfilter, stories, storystate
from newsgrid.plans import catalog_scans, daily
from newsgrid.sources.snapshots import Store


cloudpickle.register_pickle_by_value(sys.modules[__name__])


def classify(requests):
    sizes = [int(re.match(r"Classify these (\d+)", r).group(1)) for r in requests]
    return [json.dumps([{"tier": "ABAC"[i % 4], "category": "policy", "reason": "r"} for i in range(n)]) for n in sizes]


def embed(texts):
    return [[float(b) - 100 for b in hashlib.md5(t[:12].encode()).digest()] for t in texts]


MODELS = daily.Models(classify, embed, lambda ts: ["• " + t[:20] for t in ts])


@pytest.fixture(scope="module")
def runs(spark, views, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("state"))
    pages = catalog_scans.source_pages(views)
    first = daily.run_day(spark, pages, root, F.lit("2024-01-15").cast("timestamp"), MODELS)
    later = {n: p.filter("page_id % 2 = 0") for n, p in pages.items()}
    second = daily.run_day(spark, later, root, F.lit("2024-01-15 12:00:00").cast("timestamp"), MODELS)
    return root, first, second


def test_counters_reconcile(spark, runs):
    root, first, second = runs
    for run in (first, second):
        c = run.counters
        assert c["articles_fetched"] == c["articles_filtered"] + c["articles_deduped"] + c["articles_classified"]
        assert c["articles_stored"] <= c["articles_classified"]
    log = Store(spark, root).read("rejection_log")
    rejected = sum(r.counters["articles_filtered"] + r.counters["articles_deduped"] for r in (first, second))
    assert log.filter("rejection_stage = 'filter'").count() == rejected


def test_faults_of_sources_are_logged_and_the_run_goes_on(spark, views, tmp_path):
    """One source comes from files of which one is no page, one fails while it is read, one has no folder; the others are as without them."""
    pages = catalog_scans.source_pages(views)
    folder, as_of = tmp_path / "worldnews", F.lit("2024-01-15").cast("timestamp")
    folder.mkdir()
    for r in pages["worldnews"].collect():
        (folder / f"page-{r.page_id}.json").write_text(r.raw)
    (folder / "page-999.json").write_text("no json")
    lost = pages["newsdata"].withColumn("raw", F.when(F.col("page_id") < 0, F.col("raw")).otherwise(F.raise_error(F.lit("lost")).cast("string")))
    given = {"worldnews": str(folder), "newsdata": lost, "webzio": str(tmp_path / "none"), "thenewsapi": pages["thenewsapi"]}
    root, clean = str(tmp_path / "state"), str(tmp_path / "clean")
    run = daily.run_day(spark, given, root, as_of, MODELS)
    whole = daily.run_day(spark, {n: pages[n] for n in ("worldnews", "thenewsapi")}, clean, as_of, MODELS)
    assert run.counters == whole.counters and run.counters["articles_stored"] > 0
    logged = Store(spark, root).read("source_errors").collect()
    assert sorted((r.source_api, (r.place or "").rsplit("/", 1)[-1]) for r in logged) == [("newsdata", ""), ("webzio", "none"), ("worldnews", "page-999.json")]
    assert Store(spark, clean).read("source_errors", daily.SOURCE_ERRORS).count() == 0


def test_story_state_equals_all_articles(spark, runs):
    root, as_of = runs[0], F.lit("2024-01-15 12:00:00").cast("timestamp")
    articles, known = Store(spark, root).read("articles"), Store(spark, root).read("story_state").drop("bucket")
    found = storystate.signals(known, as_of)
    expected = stories.article_signals(articles, as_of).select(found.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect())) and expected.count()


def test_filters_hold_all_stored_hashes(spark, runs):
    store = Store(spark, runs[0])
    pairs = dedup.hash_pairs(store.read("articles").filter("published_at IS NOT NULL"), "id")
    missed = pairs.join(keyfilter.suspects(pairs, store.read("hash_filters"), dedup.HASH_KEY), ["id", *dedup.HASH_KEY], "left_anti")
    assert missed.count() == 0 and pairs.count() > 0
    assert store.read("hash_filters").agg(F.sum("keys")).first()[0] == pairs.count()


def test_state_is_unique(spark, runs):
    root, first, second = runs
    articles = Store(spark, root).read("articles")
    n = articles.count()
    assert n == first.counters["articles_stored"] + second.counters["articles_stored"]
    assert articles.select("id").distinct().count() == articles.select("url").distinct().count() == n
    stories = Store(spark, root).read("stories")
    assert stories.select("id").distinct().count() == stories.count() == first.counters["stories_created"] + second.counters["stories_created"]
    orphans = articles.filter("story_id IS NOT NULL").join(stories.select(F.col("id").alias("story_id")), "story_id", "left_anti")
    assert orphans.count() == 0


def test_one_brief_and_one_metrics_row_per_day(spark, runs):
    root, _, second = runs
    briefs = Store(spark, root).read("briefs").collect()
    assert len(briefs) == 1 and 0 < len(briefs[0].article_ids) <= 14
    row = Store(spark, root).read("daily_metrics").collect()
    assert len(row) == 1 and row[0].total_fetched > second.counters["articles_fetched"]


def test_failure_is_logged(spark, tmp_path):
    root = str(tmp_path / "state")
    with pytest.raises(Exception):
        daily.run_day(spark, {}, root, F.lit("2024-01-15").cast("timestamp"), MODELS)
    row = Store(spark, root).read("runs").first()
    assert (row.id, row.status) == (1, "failed") and row.error_message


def test_a_repeated_run_replaces_its_rejections(spark, tmp_path):
    rows = spark.createDataFrame([(f"https://a.com/{i}", "t", "language", "filter") for i in range(5)], "url string, title string, rejection_rule string, rejection_stage string")
    first, second = F.lit("2024-01-15").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp")
    for as_of in (first, first, second):
        commit = Store(spark, str(tmp_path)).begin()
        daily._log_rejections([rows, rows.limit(2)], commit, as_of)
        commit.finish()
    log = daily._table(spark, str(tmp_path), "rejection_log", daily.REJECTION_LOG)
    assert log.count() == 14 and log.select("created_at").distinct().count() == 2


def test_a_run_that_dies_between_two_writes_changes_nothing(spark, views, tmp_path, monkeypatch):
    """The brief fails after articles and stories are written; the repeated run leaves what a run without the failure leaves."""
    root, clean = str(tmp_path / "state"), str(tmp_path / "clean")
    pages = {n: p.filter("page_id % 4 = 1") for n, p in catalog_scans.source_pages(views).items()}
    as_of = F.lit("2024-01-15").cast("timestamp")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(daily.brief, "brief_row", broken)
        with pytest.raises(RuntimeError, match="lost"):
            daily.run_day(spark, pages, root, as_of, MODELS)
    assert set(Store(spark, root).current()[1]) == {"runs"}
    assert daily._table(spark, root, "articles", daily.STORED_ARTICLE).count() == 0
    assert [r.status for r in Store(spark, root).read("runs").collect()] == ["failed"]
    daily.run_day(spark, pages, root, as_of, MODELS)
    daily.run_day(spark, pages, clean, as_of, MODELS)
    for name in ("articles", "stories", "briefs", "rejection_log", "daily_metrics"):
        # The metrics of a day also count its failed runs.
        one, two = (sorted(map(str, Store(spark, r).read(name).drop("llm_errors").collect())) for r in (root, clean))
        assert one == two and one, name
    assert sorted(r.status for r in Store(spark, root).read("runs").collect()) == ["failed", "success"]
