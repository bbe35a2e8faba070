"""Story state merged over runs against the aggregates over all articles."""

import pytest
from pyspark.sql import functions as F

from newsgrid.operators import stories, storystate
from newsgrid.plans.views import as_of

col = F.col


def _articles(views):
    """Articles with and without stories, dates, sources, domains and vectors; one story holds a third."""
    story = F.when(col("id") % 3 == 0, 1).when(col("id") % 11 == 0, F.lit(None)).otherwise(col("id") % 9 + 2).cast("long")
    return views.articles.withColumns({
        "story_id": story, "published_at": F.when(col("id") % 13 != 0, as_of() - F.make_dt_interval(mins=(col("id") * 37 % 3000).cast("int"))),
        "source_name": F.when(col("id") % 5 != 0, col("source_name")), "source_domain": F.when(col("id") % 7 != 0, col("source_domain")),
        "embedding": F.when(col("id") % 4 != 0, F.array(F.lit(1.0))), "full_text": F.when(col("id") % 6 != 0, col("description")),
        "api_source_priority": F.when(col("id") % 10 != 0, (col("id") * 31 % 900) - 1)})


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("runs", [1, 3])
def test_merged_runs_equal_all_articles(spark, views, runs):
    articles = _articles(views)
    clocks = [as_of() - F.make_dt_interval(hours=F.lit(7 * (runs - 1 - i))) for i in range(runs)]
    state = spark.createDataFrame([], storystate.SCHEMA)
    for i, clock in enumerate(clocks):
        state = storystate.merge(storystate.aged(state, clock), storystate.parts(articles.filter(col("id") % runs == i), clock))
        seen = articles.filter(col("id") % runs <= i)
        assert _rows(storystate.signals(state, clock)) == _rows(stories.article_signals(seen, clock))
    assert _rows(storystate.source_counts(state).filter("source_count > 0")) == _rows(stories.source_counts(articles).filter("source_count > 0"))
    assert _rows(storystate.majority(state, "genre", "main_genre")) == _rows(stories.majority(articles, "main_genre"))
    assert _rows(storystate.majority(state, "category", "llm_category")) == _rows(
        stories.majority(articles, "llm_category", col("filter_status") == "accepted"))
    assert _rows(storystate.newest(state)) == _rows(stories.latest_embedded(articles).drop("canonical_embedding"))
    young = state.filter("kind = 'young'").count()
    assert young == articles.filter(col("story_id").isNotNull() & (col("published_at") > as_of() - F.expr("INTERVAL 16 HOURS"))).count()


def test_no_articles(spark, views):
    none = storystate.parts(_articles(views).filter("id < 0"), as_of())
    assert storystate.signals(storystate.aged(none, as_of()), as_of()).count() == 0
