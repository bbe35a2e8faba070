"""Filters of keys by day, kept as a table: which keys of a batch may be among the stored ones, without reading those.

A filter is rows of 64-bit words; a key belongs to one word and sets a few of its bits. A day starts small and opens a generation of at least
twice the size when its last one is full, so the share of false alarms stays and the table grows with the keys. Rows of
the same word are merged by OR, so a run adds its own keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

col = F.col
SCHEMA = "day date, gen int, words long, word long, bits long, keys long"
#: Keys for each word of a full generation (16 bits a key), bits that a key sets, and words of the smallest generation.
KEYS_PER_WORD = 4
KEY_BITS = 5
LEAST_WORDS = 1 << 10


def _mask(key: list[Column]) -> Column:
    h = F.xxhash64(F.lit(1), *key)
    mask = F.lit(0).cast("long")
    for i in range(KEY_BITS):
        place = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return mask


def _word(key: list[Column], words: Column) -> Column:
    return F.pmod(F.xxhash64(*key), words)


def added(filters: DataFrame, keys: DataFrame, key: list[str], least_words: int = LEAST_WORDS) -> DataFrame:
    """The filters of all days that ``keys`` (day and the ``key`` columns) has, with these keys in them. Rows without a day are left out; a key that
    comes twice counts twice against the room of its generation."""
    keys = keys.filter(col("day").isNotNull()).select("day", *key)
    counts = cut(keys.groupBy("day").agg(F.count(F.lit(1)).alias("more")))
    touched = filters.join(counts.select("day"), "day", "left_semi")
    newest = touched.groupBy("day", "gen", "words").agg(F.sum("keys").alias("keys")).groupBy("day").agg(
        F.max_by(F.struct("gen", "words", "keys"), "gen").alias("at"))
    fits = col("at.keys") + col("more") <= col("at.words") * KEYS_PER_WORD
    # The smallest power of two that has room for the new keys.
    room = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(col("more") / KEYS_PER_WORD, F.lit(1.0))))).cast("long")
    targets = cut(counts.join(newest, "day", "left").select(
        "day", F.when(fits, col("at.gen")).otherwise(F.coalesce(col("at.gen") + 1, F.lit(0))).cast("int").alias("gen"),
        F.when(fits, col("at.words")).otherwise(F.greatest(room, F.coalesce(col("at.words") * 2, F.lit(least_words)))).cast("long").alias("words")))
    columns = [col(k) for k in key]
    fresh = keys.join(targets, "day").select(
        "day", "gen", "words", _word(columns, col("words")).alias("word"), _mask(columns).alias("bits"), F.lit(1).cast("long").alias("keys"))
    return touched.unionByName(fresh).groupBy("day", "gen", "words", "word").agg(F.bit_or("bits").alias("bits"), F.sum("keys").alias("keys"))


def suspects(rows: DataFrame, filters: DataFrame, key: list[str]) -> DataFrame:
    """The rows of which some filter says that their key may be stored; no row whose key is stored is missing.

    The sizes of the generations are powers of two, so they are few, and a row is looked up once in each size."""
    sizes = sorted(r.words for r in filters.select("words").distinct().collect())
    if not sizes:
        return rows.limit(0)
    columns = [col(k) for k in key]
    asked = rows.select(*key).distinct().select(*key, _mask(columns).alias("_mask"), F.explode(F.array(*[F.lit(s).cast("long") for s in sizes])).alias("words"))
    asked = asked.withColumn("word", _word(columns, col("words")))
    found = asked.join(filters.select("words", "word", "bits"), ["words", "word"]).filter(col("bits").bitwiseAND(col("_mask")) == col("_mask"))
    return rows.join(found.select(*key).distinct(), key, "left_semi")
