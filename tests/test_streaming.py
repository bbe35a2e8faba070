"""Streaming results equal the batch results on the same rows."""

import json

from pyspark.sql import functions as F

from newsgrid.operators import filters
from newsgrid.plans.views import as_of
from newsgrid.sources import landed
from newsgrid.streaming import ingest


def _files(folder):
    for page in range(3):
        news = [{"url": f"https://a.com/{page}/{i % 4}", "title": f"Title number {page} {i} of the day", "publishDate": "2024-01-14 20:00:00",
                 "language": "en" if i % 3 else "fr"} for i in range(6)]
        (folder / f"page-{page}.json").write_text(json.dumps({"news": news}))


def test_rejections_equal_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _files(src)
    ruled = ingest.article_stream(ingest.landed_stream(spark, str(src), 1), "worldnews", as_of())
    ingest.write_rejections(ruled, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination(120)
    got = sorted(r.url for r in spark.read.parquet(str(tmp_path / "log")).collect())
    batch = filters.with_rule(landed.worldnews(landed.read_landed(spark, str(src)), as_of()), as_of())
    assert got == sorted(r.url for r in batch.filter("rule IS NOT NULL").collect()) and len(got) == 6


def test_rolling_dedup_equals_distinct(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    _files(src)
    rows = landed.worldnews(ingest.landed_stream(spark, str(src)), as_of())
    query = (ingest.rolling_exact_dedup(rows).writeStream.format("memory").queryName("rolling").option("checkpointLocation", str(tmp_path / "cp"))
             .trigger(availableNow=True).start())
    query.awaitTermination(120)
    got = spark.table("rolling").select("normalized_url_hash")
    assert got.count() == got.distinct().count() == 12


def test_metrics_are_merged(spark, views, tmp_path):
    log = views.rejection_log.select("rejection_rule", "created_at")
    log.repartition(4).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    ingest.keep_metrics(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(200)
    got = {(r.date, r.rejection_rule): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = log.groupBy(F.to_date("created_at").alias("d"), "rejection_rule").count().collect()
    assert got == {(r.d, r.rejection_rule): r["count"] for r in want}
