"""Dense numbering, keyed picks and keyed replace without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

RANGE_WIDTH = 100_000
RANGES_TOGETHER = 4096


def _offsets(ranged: DataFrame, major: list[str]) -> DataFrame:
    """(major..., _range, _before): rows before each range. Ranges are summed in groups, so only the table of
    groups, which is thousands of times smaller, is summed in one place."""
    counts = ranged.groupBy(*major, "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_group", F.floor(F.col("_range") / RANGES_TOGETHER))
    groups = counts.groupBy(*major, "_group").agg(F.sum("_n").alias("_n"))
    ahead = W.orderBy(*major, "_group").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select(*major, "_group", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    inside = W.partitionBy(*major, "_group").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    own = counts.select(*major, "_group", "_range", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_inside"))
    return own.join(groups, [*major, "_group"]).select(*major, "_range", (F.col("_ahead") + F.col("_inside")).alias("_before"))


def dense_number(df: DataFrame, id_col: str, out: str, major: list[str] | None = None,
                 width: int = RANGE_WIDTH, store: bool = False) -> DataFrame:
    """Number rows 1..n in the order (major..., id). ``id_col`` is a unique long; the
    ``major`` columns are not null and have few values.

    A global ``row_number`` would sort everything in one task. Here ids are cut into fixed
    ranges: only counts of ranges are summed, the rows are numbered range by range, each
    range holding at most ``width`` ids. The input is read twice; ``store`` writes it first, which
    pays when it is costly to make.
    """
    major = major or []
    df = cut(df) if store else df
    ranged = df.withColumn("_range", F.floor(F.col(id_col) / width))
    keys = [*major, "_range"]
    offsets = _offsets(ranged, major)
    within = W.partitionBy(*keys).orderBy(id_col)
    return (
        ranged.join(offsets, keys)
        .withColumn(out, (F.col("_before") + F.row_number().over(within)).cast("long"))
        .drop("_range", "_before")
    )


def ordered_number(df: DataFrame, order: list[Column], out: str, key: list[str] | None = None) -> DataFrame:
    """Number rows 1..n by any composite ``order``, which must tell all rows apart; within each ``key`` (not null), if one is given.

    Rows are dealt out in ranges of that order and written with the number of their range; only the table of ranges is summed in one
    place, and rows are numbered range by range, also those of a key that fills many ranges. ``df`` should be narrow: it is written once."""
    key = key or []
    dealt = cut(df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy(*key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*key, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    within = W.partitionBy(*key, "_part").orderBy(*order)
    return dealt.join(before, [*key, "_part"]).withColumn(out, (F.col("_before") + F.row_number().over(within)).cast("long")).drop("_part", "_before")


def batch_number(df: DataFrame, id_col: str, size: int, out: str = "batch_id",
                 major: list[str] | None = None, store: bool = False) -> DataFrame:
    """Batches of ``size`` rows in order, plus the position inside the batch (both from 0)."""
    numbered = dense_number(df, id_col, "_no", major, store=store)
    return (
        numbered.withColumn(out, F.floor((F.col("_no") - 1) / size))
        .withColumn("pos", F.pmod(F.col("_no") - 1, F.lit(size)).cast("long"))
        .drop("_no")
    )


def mark_first(df: DataFrame, key: list[str], order: list[str], row_id: str, out: str, store: bool = False) -> DataFrame:
    """Boolean ``out``: is this the first row of its key in the given order?

    The first row per key comes from a partial aggregate and is joined back on the unique
    row id, so a key that holds a third of all rows never meets in one task. The input is read twice;
    ``store`` writes it first."""
    df = cut(df) if store else df
    firsts = (
        df.groupBy(*key).agg(F.min(F.struct(*order, row_id)).alias("_first"))
        .select(F.col(f"_first.{row_id}").alias(row_id), F.lit(True).alias(out))
    )
    return df.join(firsts, row_id, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per key. Spark cuts each map task to ``k`` rows per key before
    the shuffle (window group limit), so hot keys stay small."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col(out) <= k)


def keyed_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: rows of ``new`` replace the rows of ``old`` with the same key (null equals null)."""
    return anti_join(old, new, key).unionByName(new)


def anti_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner, null keys compared as values."""
    probe = right.select(*[F.col(c).alias(f"_r_{c}") for c in key]).distinct()
    cond = F.lit(True)
    for c in key:
        cond = cond & left[c].eqNullSafe(probe[f"_r_{c}"])
    return left.join(probe, cond, "left_anti")
