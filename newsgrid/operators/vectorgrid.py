"""Pairs of vectors within an angle, without comparing all blocks with all others.

Rows go to the nearest of a bounded number of pivots; the rows of a pivot are cut into chunks of bounded size. By the triangle inequality
of angles a row can only have a partner in a pivot's rows if its angle to that pivot is at most the angle asked for plus the
largest angle inside. A row is copied to the chunks it can reach and to no other, and two chunks meet in one task. Nothing is lost: what is
left out is proven too far. Where vectors spread evenly in many dimensions little can be proven, and the copies are at most the chunks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, drop_cut

#: Pivots are vectors of the rows; so many at most are sent to the tasks. A pivot stands for a quarter of a chunk until then.
MOST_PIVOTS = 1024
PIVOTS_PER_CHUNK = 4
#: Angles are computed with rounding; so much is added to what is asked for.
SLACK = 1e-6


def unit_rows(vectors) -> np.ndarray:
    """The vectors scaled to length one; a zero vector stays zero."""
    m = np.array([np.asarray(v, dtype=float) for v in vectors], dtype=float)
    if m.size == 0:
        return m.reshape(len(m), 0)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _angles(batch: pa.RecordBatch, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit_rows(batch.column("embedding").to_pylist()) @ pivots.T, -1.0, 1.0))


def chunk_pairs(rows: DataFrame, cosine: float, chunk_rows: int, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """``rows`` (any columns, among them ``embedding``) copied to the pairs of chunks where they can meet a partner of at least ``cosine``:
    with (chunk, p, q), where p <= q and chunk is one of the two.

    Every two rows whose cosine reaches ``cosine`` meet in exactly one (p, q). Rows with a null or zero vector have no partner and are left out.
    ``cosine`` must be above zero. Pivots are the rows with the least hashes, so reruns agree.
    """
    if cosine <= 0:
        raise ValueError("angles of 90 degrees and more cannot be pruned")
    names = rows.columns
    reach = math.acos(min(cosine, 1.0)) + SLACK
    live = cut(rows.filter(F.exists("embedding", lambda x: x != 0)).withColumn("_h", F.xxhash64("embedding", F.monotonically_increasing_id())))
    chunks = math.ceil(live.count() / chunk_rows)
    if chunks <= 1:
        return live.drop("_h").withColumns({"chunk": F.lit(0), "p": F.lit(0), "q": F.lit(0)})
    wanted = min(most_pivots, PIVOTS_PER_CHUNK * chunks)
    chosen = live.select("_h", "embedding").orderBy("_h").limit(wanted).collect()  # at most MOST_PIVOTS vectors
    pivots = unit_rows([r.embedding for r in chosen])
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                angle = _angles(batch, shared.value)
                cell = angle.argmin(axis=1)
                columns = [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_cell", "_angle"])

    near = cut(live.mapInArrow(nearest, T.StructType([*live.schema.fields]).add("_cell", T.IntegerType()).add("_angle", T.DoubleType())))
    drop_cut(live)
    cells = near.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_angle").alias("radius")).collect()  # one row for each pivot
    parts, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in cells:
        parts[r["_cell"]], radius[r["_cell"]] = -(-r["n"] // chunk_rows), r["radius"]
    base = np.cumsum(parts) - parts
    plan = rows.sparkSession.sparkContext.broadcast((parts, reach + radius, base))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, most, base = plan.value
        for batch in batches:
            if batch.num_rows:
                cell = batch.column("_cell").to_numpy()
                own = base[cell] + batch.column("_h").to_numpy() % parts[cell]
                row, other = np.nonzero(_angles(batch, shared.value) <= most)
                met = parts[other]
                first = np.cumsum(met) - met
                chunk = np.repeat(base[other] - first, met) + np.arange(met.sum())  # the chunks of each pivot in reach
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=met, minlength=len(cell)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(chunk.astype(np.int32)))
                columns = [batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(own.astype(np.int32)), lists], [*names, "chunk", "_others"])

    out = T.StructType([*rows.schema.fields]).add("chunk", T.IntegerType()).add("_others", T.ArrayType(T.IntegerType()))
    spread = near.mapInArrow(reached, out).withColumn("_other", F.explode("_others"))
    return spread.withColumns({"p": F.least("chunk", "_other"), "q": F.greatest("chunk", "_other")}).drop("_others", "_other")
