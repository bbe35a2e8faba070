"""Greedy survivors over trigram sets that have no rare trigrams: a grid of blocks instead of keys.

Over a small vocabulary every key is shared by many unrelated rows and the keys of a row multiply. Here blocks of rows in id order meet, each
with itself and with the earlier ones. A set folds into bits by the parity of its trigrams, so two sets differ in at least as many trigrams as their
bits do; of the pairs of fitting sizes nearly all differ in too many bits, and only the rest are compared exactly. A task tells which of its rows have a similar earlier
one, never with how many, so large groups of near copies make no lists of pairs. Time grows with the square of the rows, at some nanoseconds a pair;
memory is that of two blocks in a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

col = F.col
#: Rows of a block at most, and blocks that share smaller tables.
BLOCK_ROWS = 150_000
FEW_BLOCKS = 8
SMALL_BLOCK = 4000
WORDS = 16
FOLDED = 4
TILE = (64, 4096)


def survivors(rows: DataFrame, threshold: float) -> DataFrame:
    """(rid) of the rows (rid, grams) without a similar earlier survivor. A row is kept when no row before it that is still
    open is similar; rows similar to an earlier kept one are dropped; the others go through the next round."""
    n = rows.count()
    blocks = max(min(FEW_BLOCKS, -(-n // SMALL_BLOCK)), -(-n // BLOCK_ROWS), 1)
    bounds = rows.approxQuantile("rid", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    waiting = cut(rows.withColumn("block", sum((col("rid").cast("double") > b).cast("int") for b in bounds) if bounds else F.lit(0)))
    kept = None
    while True:
        blocked = cut(similar_below(waiting, waiting, blocks, threshold))
        free = cut(waiting.join(blocked, "rid", "left_anti"))
        kept = free.select("rid") if kept is None else kept.unionByName(free.select("rid"))
        later = cut(waiting.join(blocked, "rid", "left_semi"))
        dropped = cut(similar_below(later, free, blocks, threshold))
        waiting = cut(later.join(dropped, "rid", "left_anti"))
        if waiting.isEmpty():
            return kept


def similar_below(upper: DataFrame, lower: DataFrame, blocks: int, threshold: float) -> DataFrame:
    """(rid) of the rows of ``upper`` to which a row of ``lower`` with a smaller rid is similar. Both are (rid, grams, block), blocks in the order of rid."""
    above = upper.select("rid", "grams", "block", F.explode(F.sequence(F.lit(0), col("block"))).alias("other"))
    above = above.select("rid", "grams", (col("block") * blocks + col("other")).alias("tile"))
    below = lower.select("rid", "grams", "block", F.explode(F.sequence(col("block"), F.lit(blocks - 1))).alias("other"))
    below = below.select("rid", "grams", (col("other") * blocks + col("block")).alias("tile"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _below(_Sets(left), _Sets(right), threshold) if left.num_rows and right.num_rows else np.array([], dtype=np.int64)
        return pa.table({"rid": pa.array(found, pa.int64())})

    return above.groupBy("tile").cogroup(below.groupBy("tile")).applyInArrow(run, "rid long").distinct()


class _Sets:
    """Sets of a block in order of size, with their parity bits."""

    def __init__(self, table: pa.Table) -> None:
        lists = table["grams"].combine_chunks()
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        start = lists.offsets.to_numpy().astype(np.int64)
        self.values, start = lists.flatten().to_numpy(), start - start[0]
        size = np.diff(start)
        mixed = self.values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        word, bit = (mixed >> np.uint64(60)).astype(np.int8), np.uint64(1) << ((mixed >> np.uint64(54)) & np.uint64(63))
        bits = np.stack([np.bitwise_xor.reduceat(np.where(word == w, bit, np.uint64(0)), start[:-1]) for w in range(WORDS)])
        order = np.argsort(size, kind="stable")
        self.rid, self.size, self.start = table["rid"].to_numpy()[order], size[order], start[:-1][order]
        self.bits = np.ascontiguousarray(bits[:, order])
        self.folded = np.bitwise_xor.reduce(self.bits.reshape(WORDS // FOLDED, FOLDED, -1), axis=0)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.start[i]:self.start[i] + self.size[i]]


def _below(left: _Sets, right: _Sets, threshold: float) -> np.ndarray:
    """rids of ``left`` with a similar set of smaller rid in ``right``."""
    share = (1 - threshold) / (1 + threshold)  # similar sets differ in less than this share of both sizes
    hit = np.zeros(len(left.rid), dtype=bool)
    for at in range(0, len(left.rid), TILE[0]):
        mine = np.arange(at, min(at + TILE[0], len(left.rid)))
        first = np.searchsorted(right.size, np.floor(left.size[mine[0]] * threshold), "left")
        end = np.searchsorted(right.size, np.ceil(left.size[mine[-1]] / threshold), "right")
        for begin in range(first, end, TILE[1]):
            mine = mine[~hit[mine]]
            if not len(mine):
                break
            stop = min(begin + TILE[1], end)
            most = min(255, int(share * (left.size[mine[-1]] + right.size[stop - 1]) + 1e-9))
            apart = np.zeros((len(mine), stop - begin), dtype=np.uint8)  # may run over at 256, which only adds a pair to compare
            for w in range(FOLDED):
                apart += np.bitwise_count(left.folded[w, mine][:, None] ^ right.folded[w, begin:stop][None, :])
            p, q = np.nonzero(apart <= most)
            _confirm(left, right, mine[p], q + begin, share, threshold, hit)
    return left.rid[hit]


def _confirm(left: _Sets, right: _Sets, p: np.ndarray, q: np.ndarray, share: float, threshold: float, hit: np.ndarray) -> None:
    """Marks in ``hit`` the sets of ``left`` that one of the pairs (p, q) shows to be similar; a marked set is not compared again."""
    earlier = right.rid[q] < left.rid[p]
    p, q = p[earlier], q[earlier]
    apart = np.zeros(len(p), dtype=np.int64)
    for w in range(WORDS):
        apart += np.bitwise_count(left.bits[w, p] ^ right.bits[w, q])
    near = apart <= share * (left.size[p] + right.size[q]) + 1e-9
    p, q = p[near], q[near]
    while len(p):
        turn = np.unique(p, return_index=True)[1]
        for i, j in zip(p[turn], q[turn]):
            common = len(np.intersect1d(left.of(i), right.of(j), assume_unique=True))
            hit[i] = common / (left.size[i] + right.size[j] - common) > threshold
        rest = ~hit[p]
        rest[turn] = False
        p, q = p[rest], q[rest]
