"""Mixing sources to target weights through a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words. Each source's blocks are put in a random order, once for each pass, and its quota is
the first blocks of that order up to its target. A binary tree over the output shards splits the quotas of all sources exactly:
a node draws from its quotas, without replacement, what goes left; the rest goes right. A shard then takes disjoint runs of
each source's order and shuffles them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NO_ID, cut, drop_cut, slices, small_batches, text_bytes

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 256
#: Block draws of one output shard, and nodes that are split before the tree is dealt out to tasks.
SHARD_BLOCKS = 8192
HEAD_LEVELS = 8
#: Blocks that one task orders: a source is ordered in ranges of its random keys.
RANGE_BLOCKS = 4096
SEED = 20240115
#: The random generator's own draws end at this total; above it :func:`hypergeometric` lists the chances. Both follow the same law.
GENERATOR_BELOW = 10**9
#: Deviations on each side of the mode that are listed. What lies beyond has less chance than a double can tell from zero.
LISTED_DEVIATIONS = 12

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_counts(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of words (runs without ASCII white space) of each text in a byte buffer."""
    if len(flat) == 0:
        return np.zeros(len(at) - 1, np.int64)
    word = ~_SPACE[flat]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = at[:-1][at[:-1] < at[1:]]
    first[heads] = word[heads]
    total = np.concatenate([[0], np.cumsum(first, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): the number of words of every text; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size = word_counts(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size)], ["doc_id", "source", "size"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").mapInArrow(
        run, "doc_id long, source string, size long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, source_no): one row for each source.

    Sources by code point, null last, have the weights in turn and share ``share`` times all words. No target exceeds ``most``
    times its source; what is over goes to the others by weight. The level is found from running sums over the
    sources in the order in which they fill up. This table has one row for each source, ordered in one task.
    """
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        one.withColumn("place", place).withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size")).withColumn("fills_at", F.col("cap") / F.col("weight"))
    )
    before = W.orderBy("fills_at", "place").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The first source that does not fill up sets the level; sources before it are full.
    level = ranked.withColumn("level", left / open_weight).withColumn("full", F.col("fills_at") <= F.col("level"))
    set_by = F.min(F.when(~F.col("full"), F.struct("fills_at", "place", "level"))).over(everything)
    return (
        level.withColumn("set_by", set_by)
        .withColumn("target", F.coalesce(F.least("cap", F.col("weight") * F.col("set_by.level")), F.col("cap")))
        .select("source", "source_size", "target", F.col("place").alias("source_no"))
    )


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good`` and ``bad`` are good, for totals of any size.

    The chances around the mode follow from the ratios of neighbours, so nothing of the size of the total is computed, and one
    uniform number picks among them. The list grows with the square root of the total: 6 million numbers at 10^12."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    if total < GENERATOR_BELOW:
        return int(rng.hypergeometric(good, bad, draws))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = int(LISTED_DEVIATIONS * np.sqrt(draws * share * (1 - share) * (total - draws) / (total - 1))) + 50
    first, last = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(first, last, dtype=np.int64)
    step = np.log((good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1)))  # from k to k + 1
    logs = np.concatenate([[0.0], np.cumsum(step)])
    chances = np.cumsum(np.exp(logs - logs[mode - first]))
    return first + int(np.searchsorted(chances, rng.random() * chances[-1], side="right"))


def split_quota(quota: np.ndarray, left: int, key: tuple[int, ...]) -> np.ndarray:
    """How many of each source's draws go left, when ``left`` of all do: a multivariate-hypergeometric
    draw that depends on ``key`` alone."""
    total = int(quota.sum())
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([SEED, *key])))
    if left in (0, total):
        return quota * (left == total)
    if total < GENERATOR_BELOW:
        return rng.multivariate_hypergeometric(quota, left, method="marginals")
    out = np.zeros(len(quota), np.int64)
    rest, need = total, left
    for i, q in enumerate(quota.tolist()):  # one source after the other, from what is left
        if need == 0:
            break
        out[i] = hypergeometric(rng, q, rest - q, need)
        rest, need = rest - q, need - int(out[i])
    return out


def _grow(low: int, high: int, quota: np.ndarray, start: np.ndarray, deepest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits the node of shards [low, high) until it is one shard or ``deepest`` levels down."""
    if high - low == 1 or deepest == 0:
        yield low, high, quota, start
        return
    middle = (low + high) // 2
    total = int(quota.sum())
    left = split_quota(quota, total * (middle - low) // (high - low), (low, high))
    yield from _grow(low, middle, left, start, deepest - 1)
    yield from _grow(middle, high, quota - left, start + left, deepest - 1)


def plan_shards(quotas: DataFrame, draws: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, source_no, start, n): which run of each source's order a shard takes. ``quotas`` has (source_no, draws).

    The top of the tree is split in one task, as one row of numbers for each node; its leaves are then split on by
    as many tasks as there are leaves. Every draw depends on the node alone, so reruns agree.
    """
    shards = max(1, -(-draws // shard_blocks))
    fields = "low long, high long, sources array<long>, quota array<long>, start array<long>"
    root = quotas.filter("draws > 0").agg(F.sort_array(F.collect_list(F.struct("source_no", "draws"))).alias("q")).select(
        F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.col("q.source_no").cast("array<long>").alias("sources"),
        F.col("q.draws").cast("array<long>").alias("quota"), F.transform("q", lambda x: F.lit(0).cast("long")).alias("start"))

    def grower(levels: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    sources = np.array(row["sources"], np.int64)
                    if not len(sources):
                        continue
                    for low, high, quota, start in _grow(row["low"], row["high"], np.array(row["quota"], np.int64), np.array(row["start"], np.int64), levels):
                        on = quota > 0
                        yield pa.RecordBatch.from_pylist([{
                            "low": low, "high": high, "sources": sources[on].tolist(), "quota": quota[on].tolist(), "start": start[on].tolist()}], batch.schema)
        return run

    tree = root.mapInArrow(grower(HEAD_LEVELS), fields)
    if shards > 1 << HEAD_LEVELS:
        tree = cut(tree).repartition(1 << HEAD_LEVELS, "low").mapInArrow(grower(64), fields)
    return tree.select(F.col("low").alias("shard"), F.explode(F.arrays_zip("sources", "start", "quota")).alias("x")).select(
        "shard", F.col("x.sources").cast("int").alias("source_no"), F.col("x.start").alias("start"), F.col("x.quota").alias("n"))


#: What names a row: repeats of one document are numbered, and are equal in all that counts here.
KEY = ["doc_id", "source_no", "size", "copy"]


def draw(rows: DataFrame, goal: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST) -> DataFrame:
    """(source_no, position, doc_id, size, copy, block, words): the drawn blocks of every source in its random order.

    A source's order is random over its blocks, and again for the second pass. The running number and the running words of a block
    come from sums over ranges of the random keys plus a running number inside the range, so a source with a third of all rows
    is ordered by many tasks. The last block is taken in part, so that a source gives its target rounded down.
    """
    passes = F.least(F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))), F.ceil(F.lit(most))).cast("int")
    ranges = (F.col("source_size") / (block_words * RANGE_BLOCKS) + 1).cast("long")
    spread = goal.filter("target >= 1").select("source_no", "target", passes.alias("passes"), ranges.alias("ranges"))
    blocks = rows.filter("size > 0").join(spread, "source_no").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block_words) - 1)))
    drawn = (
        blocks.withColumn("words", F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
        .withColumn("key", F.xxhash64("doc_id", "size", "copy", "block", "pass", F.lit(SEED)))
        .withColumn("range", F.pmod(F.shiftright("key", 20), F.col("ranges")))
        .select(*KEY, "target", "pass", "range", "key", "block", "words")
    )
    per_range = drawn.groupBy("source_no", "pass", "range").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    before = W.partitionBy("source_no").orderBy("pass", "range").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_range.select(
        "source_no", "pass", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"))
    inside = W.partitionBy("source_no", "pass", "range").orderBy("key", "doc_id", "size", "copy", "block")
    placed = (
        drawn.withColumn("no", F.row_number().over(inside) - 1)
        .withColumn("so_far", F.coalesce(F.sum("words").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .join(offsets, ["source_no", "pass", "range"])
        .withColumn("room", F.floor("target") - F.col("w_before") - F.col("so_far"))
    )
    return placed.filter("room > 0").select(
        *KEY, (F.col("n_before") + F.col("no")).alias("position"), "block", F.least("words", "room").alias("words"))


def mix_blocks(rows: DataFrame, goal: DataFrame, block_words: int = BLOCK_WORDS, most: float = MOST, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(shard, slot, doc_id, source_no, size, copy, block, words): every draw of the mix with its output shard and its place there.
    A block that is drawn in both passes comes twice. ``slot`` is a random order inside the shard."""
    drawn = cut(draw(rows, goal, block_words, most))
    quotas = cut(drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("draws")))
    total = quotas.agg(F.sum("draws")).first()[0] or 0
    plan = plan_shards(quotas, total, shard_blocks)
    seats = plan.select("shard", "source_no", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("position"))
    slot = F.xxhash64("shard", "source_no", "position", F.lit(SEED + 1))
    # The size of the seats is not known before they are listed, so they are never broadcast.
    return drawn.join(seats.hint("merge"), ["source_no", "position"]).select("shard", slot.alias("slot"), *KEY, "block", "words")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_shard, last_shard) for every row of ``docs`` (doc_id, text, source; other columns are not read).

    ``taken`` counts the words of the row's blocks in the mix, repeats included; it never exceeds ``most`` times the size, as each
    pass takes a block once. The shards are the lowest and the highest output shard that hold a block of the row, null where none
    does. Null and empty texts have size and taken 0. The null source is a source of its own, ordered last. Repeated
    rows and missing ids take part like others. An empty table gives no rows.
    """
    sized = cut(sizes(docs))
    goal = cut(targets(sized, weights, share, most))
    named = sized.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(
        goal.select(F.col("source").alias("_source"), "source_no"), F.col("source").eqNullSafe(F.col("_source")))
    copies = W.partitionBy("doc_id", "source_no", "size").orderBy("source_no")
    rows = cut(named.select("doc_id", "source_no", "size", F.row_number().over(copies).alias("copy")))
    drop_cut(sized)
    taken = mix_blocks(rows, goal, block_words, most, shard_blocks).groupBy(*KEY).agg(
        F.sum("words").alias("taken"), F.min("shard").alias("first_shard"), F.max("shard").alias("last_shard"))
    return rows.join(taken, KEY, "left").join(goal, "source_no").select(
        F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard", "last_shard")
