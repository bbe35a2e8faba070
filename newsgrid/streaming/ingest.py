"""Incremental ingest with Structured Streaming: the batch stages over arriving page files.

The daily run stays the reference; these jobs keep its first tables up to date between
runs. They read landed pages as they arrive and use the same column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config
from ..operators import filters
from ..sources import landed, tables

col = F.col


def landed_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Page table (page_id, raw) over a folder that receives one JSON file per page. The page number is a hash of the
    whole path: it tells files apart, but has no order."""
    files = (
        spark.readStream.format("text").option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_trigger).schema("value string").load(folder)
    )
    page = F.pmod(F.xxhash64(col("_metadata.file_path")), F.lit(landed.STREAM_PAGES))
    return files.select(page.alias("page_id"), col("value").alias("raw"))


def article_stream(pages: DataFrame, source: str, fetched_at: Column) -> DataFrame:
    """Normalised articles with the first broken rule; age is judged at the fetch time."""
    articles = landed.NORMALISERS[source](pages, fetched_at)
    return articles.withColumn("rule", filters.rejection_rule(col("fetched_at")))


def rolling_exact_dedup(articles: DataFrame, days: int = config.DEDUP_LOOKBACK_DAYS) -> DataFrame:
    """One row per normalised url within the lookback; the state expires with the watermark."""
    return articles.withWatermark("published_at", f"{days} days").dropDuplicatesWithinWatermark(["normalized_url_hash"])


def hourly_momentum(articles: DataFrame, hours: int = 6) -> DataFrame:
    """Articles per story in sliding windows."""
    window = F.window("published_at", f"{hours} hours", "1 hour")
    return articles.withWatermark("published_at", f"{hours} hours").groupBy(window, "story_id").agg(F.count(F.lit(1)).alias("articles"))


def write_rejections(ruled: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append rejected rows to the rejection log, by day; each micro-batch is one day-partitioned
    append, replaced as a whole when it is replayed."""

    def save(batch: DataFrame, batch_id: int) -> None:
        rows = filters.rejections(batch.filter(col("rule").isNotNull()), "filter", "fetched_at")
        rows = rows.withColumns({"day": F.to_date("fetched_at"), "batch": F.lit(batch_id)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)

    return ruled.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_metrics(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Daily rejection counts of the arriving log, merged into the stored counts by keyed replace."""

    def save(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.groupBy(F.to_date("created_at").alias("date"), "rejection_rule").agg(F.count(F.lit(1)).alias("n"))
        schema = "rejection_rule string, n long, last_batch long, date date"
        old = tables.read_table(batch.sparkSession, path, schema)
        seen = old.withColumnRenamed("n", "old_n")
        merged = fresh.join(seen, ["date", "rejection_rule"], "left").select(
            "rejection_rule",
            # a replayed batch finds its own number and is not added twice
            F.when(col("last_batch") == batch_id, col("old_n")).otherwise(col("n") + F.coalesce("old_n", F.lit(0))).alias("n"),
            F.lit(batch_id).cast("long").alias("last_batch"), "date")
        tables.upsert(merged, path, ["date", "rejection_rule"], "date")

    return log.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
