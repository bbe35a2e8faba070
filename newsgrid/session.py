"""Session builder and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Folders of local sessions without a shared one, by application: the setting itself cannot be changed in a running session.
_own_folders: dict[str, str] = {}


def build_session(app_name: str = "newsgrid", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, Arrow)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to its own folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folders[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back: cuts the lineage, survives lost executors and
    gives the optimizer real sizes to choose broadcast joins by."""
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = os.path.join(scratch_dir(spark), f"newsgrid-{app}", uuid.uuid4().hex)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_counted(df: DataFrame, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """:func:`cut`, and aggregates over the rows taken while they are written, so counting them needs no pass of its own.

    The aggregates stand right below the write, where Spark adds up each task once, also when tasks are repeated."""
    seen = Observation()
    stored = cut(df.observe(seen, *[c.alias(n) for n, c in counters.items()]))
    return stored, {n: int(v or 0) for n, v in seen.get.items()}


def drop_cut(df: DataFrame | None) -> None:
    """Delete the table behind a frame returned by :func:`cut`, when it is no longer read."""
    if df is None:
        return
    spark = df.sparkSession
    mark = f"newsgrid-{spark.sparkContext.applicationId}/"
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles() if mark in f}
    hadoop_conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(hadoop_conf).delete(path, True)
