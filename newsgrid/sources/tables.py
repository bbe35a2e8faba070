"""State tables: inserts, upserts, deletes as DataFrame steps, and their parquet storage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config, rules
from ..functions import scalars as S
from ..operators import filters, numbering
from ..session import cut

col = F.col


# ---- storage ----------------------------------------------------------------------------

def append(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions present in ``df``. The rows are written aside first, so
    the plan may read the same table."""
    aside = cut(df)
    aside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert(new: DataFrame, path: str, key: list[str], partition: str) -> None:
    """Keyed replace inside the partitions that ``new`` touches; other partitions are not read."""
    spark = new.sparkSession
    old = read_table(spark, path, new.schema)
    touched = new.select(partition).distinct()
    merged = numbering.keyed_replace(old.join(touched, partition, "left_semi"), new, key)
    replace_partitions(merged.select(*new.columns), path, partition)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table, or no rows when it has not been written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


# ---- articles ---------------------------------------------------------------------------

def clean_strings(df: DataFrame) -> DataFrame:
    """Null characters removed from every string, also inside arrays and structs."""
    return df.select(*[S.strip_null_chars(col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def new_articles(accepted: DataFrame, stored: DataFrame, seq: str = "batch_seq") -> DataFrame:
    """Accepted rows whose url is new, the first of each url in batch order, with ids that
    continue after the stored ones."""
    first = cut(numbering.mark_first(accepted, ["url"], [], seq, "_first", store=True).filter("_first").drop("_first"))
    # The history meets the urls of the batch, so only the rows that equal one of them are shuffled if Spark can broadcast those.
    known = stored.select("url").join(first.select("url"), "url", "left_semi").distinct()
    fresh = first.join(known, "url", "left_anti")
    numbered = numbering.dense_number(fresh, seq, "_no", store=True)
    return numbered.withColumn("id", last_id(stored) + col("_no")).drop("_no")


def last_id(table: DataFrame) -> Column:
    """Highest id of a table as a scalar subquery; zero for an empty table."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()


def tier_rejections(classified: DataFrame) -> DataFrame:
    """Rejection rows of the classifier stage."""
    tier = col("llm_tier")
    return classified.filter(filters.filter_status(tier) == "rejected").select(
        "url", "title", "source_api", "source_domain", F.lit("llm").alias("rejection_stage"),
        F.concat(F.lit("tier_"), F.lower(tier)).alias("rejection_rule"),
        F.when(tier.isin("C", "D"), tier).alias("llm_tier"), "llm_category", "llm_reason",
        S.context_len(col("description"), col("content")).alias("context_len"),
    )


def from_parallel_arrays(df: DataFrame, **arrays: str) -> DataFrame:
    """Rows from equally long array columns."""
    zipped = F.arrays_zip(*[col(c).alias(n) for n, c in arrays.items()])
    return df.select(F.inline(zipped)).toDF(*arrays)


def update_columns(table: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``updates`` where present, the old values elsewhere."""
    fresh = updates.select(key, *[col(c).alias(f"_{c}") for c in columns])
    return table.join(fresh, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def new_stories(clusters: DataFrame, articles: DataFrame, stories: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """New story rows (id, centroid, status, article_count, times) in order of their first
    article, and the assignment (id, story_id) of the clustered articles."""
    from ..operators.stories import group_centroids

    members = clusters.join(articles.select("id", "embedding"), "id")
    agg = group_centroids(members.withColumnRenamed("seed_id", "key"), "key").withColumnRenamed("key", "seed_id")
    numbered = numbering.dense_number(agg, "seed_id", "_no")
    rows = numbered.select(
        (last_id(stories) + col("_no")).alias("id"), "seed_id", "centroid", F.lit("active").alias("status"),
        col("n").alias("article_count"), as_of.alias("first_seen_at"), as_of.alias("last_updated_at"))
    assigned = clusters.join(rows.select("seed_id", col("id").alias("story_id")), "seed_id").select("id", "story_id")
    return rows, assigned


# ---- other tables -----------------------------------------------------------------------

def retained(log: DataFrame, as_of: Column, days: int = config.RETENTION_DAYS) -> DataFrame:
    return log.filter(~expired(as_of, days))


def expired(as_of: Column, days: int = config.RETENTION_DAYS) -> Column:
    return F.coalesce(col("created_at") < as_of - F.expr(f"INTERVAL {days} DAYS"), F.lit(False))


def add_follows(follows: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """Insert (story_id, user_id) where absent; a null user equals a null user."""
    fresh = numbering.anti_join(wanted.select("story_id", "user_id").distinct(), follows, ["story_id", "user_id"])
    added = fresh.select("story_id", "user_id", F.lit(None).cast("timestamp").alias("last_seen_at"), as_of.alias("followed_at"))
    return follows.unionByName(added)


def delete_keys(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return numbering.anti_join(table, keys, key)


def mark_seen(follows: DataFrame, stories: DataFrame, as_of: Column) -> DataFrame:
    seen = stories.select(col("id").alias("story_id"), F.lit(True).alias("_seen")).distinct()
    hit = F.coalesce("_seen", F.lit(False)) & col("user_id").isNull()
    return follows.join(seen, "story_id", "left").withColumn("last_seen_at", F.when(hit, as_of).otherwise(col("last_seen_at"))).drop("_seen")


def fill_cache(cache: DataFrame, wanted: DataFrame, produced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers for ``wanted`` (article_id, level): cached text, else produced text; and the
    cache with the misses added."""
    hits = wanted.join(cache.select("article_id", "level", col("text").alias("cached")), ["article_id", "level"], "left")
    answers = hits.join(produced.select("article_id", "level", col("text").alias("made")), ["article_id", "level"], "left").select(
        "article_id", "level", F.coalesce("cached", "made").alias("text"), col("cached").isNotNull().alias("from_cache"))
    misses = answers.filter(~col("from_cache") & col("text").isNotNull()).drop("from_cache")
    return answers, numbering.keyed_replace(cache, misses, ["article_id", "level"])


def run_row(run_id: int, started: Column, completed: Column, counters: dict[str, int | None], error: str | None = None) -> list[Column]:
    """Columns of one run log row: success with counters, or failed with the message."""
    return [
        F.lit(run_id).cast("long").alias("id"), started.alias("started_at"), completed.alias("completed_at"),
        *[F.lit(counters.get(n)).cast("long").alias(n) for n in rules.RUN_COUNTERS],
        F.lit("failed" if error is not None else "success").alias("status"),
        S.strip_null_chars(F.lit(error).cast("string")).alias("error_message"),
    ]


def by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles whose id is in the table of ids."""
    return articles.join(ids.select("id"), "id", "left_semi")


def of_story(articles: DataFrame, story_id: int) -> DataFrame:
    """Articles of one story."""
    return articles.filter(F.col("story_id") == story_id)
