"""Fetch statistics without stored rows, pages with long texts, pages in slices."""

import json

import pyarrow as pa
import pytest

from newsgrid.operators import numbering, textjobs
from newsgrid.plans.catalog import QUERIES
from newsgrid.plans.views import as_of
from newsgrid.sources import landed


def test_fetch_stats_store_no_rows(spark, monkeypatch):
    monkeypatch.setattr(numbering, "cut", lambda df: pytest.fail("rows were stored"))
    news = [{"url": f"https://a.com/{i % 3}", "title": "T", "text": "x" * 100} for i in range(5)]
    pages = spark.createDataFrame([(0, json.dumps({"news": news})), (1, "{broken"), (2, json.dumps({"news": [{"title": "no url"}]}))], "page_id long, raw string")
    got = landed.fetch_stats({"worldnews": pages}, as_of()).collect()
    assert [tuple(r) for r in got] == [("worldnews", 6, 3, 2, 0, 1)]


def test_documents_of_fetch_stats_are_dealt_out_before_pages_are_made(spark, small):
    plan = QUERIES["agg_16_fetch_stats"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "Exchange hashpartitioning(_groupingexpression" not in plan


def test_a_source_of_empty_pages_has_no_statistics(spark):
    pages = spark.createDataFrame([(0, '{"news":[]}')], "page_id long, raw string")
    assert landed.fetch_stats({"worldnews": pages}, as_of()).isEmpty()


def test_a_page_with_a_text_over_20_million_characters_is_whole(spark):
    body = """concat('{"news":[{"url":"https://a.com/1","title":"T","text":"', repeat('x', cast(21000000 + id as int)), '"},{"url":"https://a.com/2","title":"U"}]}')"""
    pages = spark.range(1).selectExpr("id AS page_id", f"{body} AS raw")
    assert [tuple(r) for r in landed.fetch_stats({"worldnews": pages}, as_of()).collect()] == [("worldnews", 2, 2, 0, 0, 0)]
    assert landed.worldnews(pages, as_of()).select("url").count() == 2 and landed.corrupt_pages(pages, "worldnews").isEmpty()


def test_pages_come_in_slices(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"html": ["a" * 6, None, "b" * 6, "c" * 30, "", "d"]})
    parts = [p.column("html").to_pylist() for p in textjobs._slices(batch, 10)]
    assert sum(parts, []) == batch.column("html").to_pylist()
    assert len(parts) > 2 and all(len(p) == 1 or sum(len(x or "") for x in p[:-1]) <= 10 for p in parts)
