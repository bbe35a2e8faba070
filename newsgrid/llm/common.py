"""Helpers shared by the corpus operators: byte views of text columns, keys, edges to components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgrid.session import cut, drop_cut

#: Texts are handled in slices of about this many bytes, so a task's memory follows its longest text, not its batch.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch: whole texts stand in it, on both sides of the way to Python.
BATCH_ROWS = 2000
#: Stands for a missing document id inside an operator: sorts below every real id.
NO_ID = -(1 << 63)

__all__ = ["NO_ID", "SLICE_BYTES", "components", "cut", "drop_cut", "slices", "small_batches", "table", "text_bytes", "text_list"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after setting the session's Arrow batches to BATCH_ROWS rows, or fewer if they are set so."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64, len(column) + 1 + column.offset)[column.offset:]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_list(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes; a null is an empty text."""
    flat, at = text_bytes(column)
    whole = flat.tobytes()
    bounds = at.tolist()
    return [whole[a:b] for a, b in zip(bounds, bounds[1:])]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each slice holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(size) - size) // limit
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, label), where the label is the
    smallest node that can be reached. Only nodes with an edge are returned.

    Each round takes the least label among the neighbours and then follows the label's own label, so
    long chains halve with every round. Rounds are written to the shared folder. A node with very many
    edges is pre-aggregated in the minimum and split by the join, never gathered.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        hop = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        fresh = cut(hop.join(jump, "via", "left").select("node", F.least("via", "far").alias("label"), (F.least("via", "far") != F.col("old")).alias("moved")))
        changed = not fresh.filter("moved").isEmpty()
        drop_cut(labels)
        labels = fresh.drop("moved")
        if not changed:
            drop_cut(both)
            return labels
