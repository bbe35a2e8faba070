"""Near copies by SimHash fingerprints, linked through the anchors of a covering code.

A 64-bit fingerprint is split into parts. Two fingerprints that differ in at most ``distance`` bits
differ in at most ``distance // parts`` bits of some part. Inside a part, the code words of a covering
code (a product of perfect Hamming codes and free bits) are the anchors. Every fingerprint lies at its
nearest anchor, and is copied to all anchors within the covering radius plus the part's threshold;
fingerprints that meet at an anchor are compared. No link can be missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, drop_cut, slices, small_batches, text_list

SEED = 42
WIDTH = 4
DISTANCE = 4
#: Rows that one comparison group may hold; a larger group is split into a grid of cells.
GROUP_ROWS = 1_000_000
#: Rows that are compared together at least, and candidate pairs held at once while a group is compared.
COMPARED_TOGETHER = 1 << 15
PAIRS_AT_ONCE = 1 << 21

#: Codes to choose from, as bit widths of the blocks of each part: 15 and 7 are perfect Hamming codes, 1 is a free bit.
CODES: tuple[tuple[tuple[int, ...], ...], ...] = (
    ((7, 7, 7), (7, 7, 7), (7, 7, 7, 1)),
    ((15, *[1] * 6), (15, *[1] * 6), (15, *[1] * 7)),
    ((1,) * 21, (1,) * 21, (1,) * 22),
    ((15, 15, 1, 1), (15, 15, 1, 1)),
    ((15, *[1] * 17), (15, *[1] * 17)),
    ((1,) * 32, (1,) * 32),
)
#: Cost of one copy of a fingerprint against one comparison, both in comparisons.
COPY_COST = 1500


# ------------------------------------------------------------------ fingerprints


def fingerprint_list(texts: list[bytes]) -> np.ndarray:
    """Fingerprints (unsigned) of texts: A-Z lower-cased, words between ASCII white space, shingles of
    four words (all words if fewer), bit set if set in over half of the shingles' hashes; no word: 0."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        if len(words) <= WIDTH:
            counts.append(1 if words else 0)
            if words:
                hashes.append(digest(b" ".join(words), SEED))
            continue
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        line = b" ".join(words)
        hashes.extend([digest(line[a:b], SEED) for a, b in zip((ends - size)[: 1 - WIDTH].tolist(), ends[WIDTH - 1:].tolist())])
        counts.append(len(words) - WIDTH + 1)
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not hashes:
        return out
    values = np.array(hashes, np.uint64)
    # Runs of at most 255 hashes of one text: the eight bytes of a word count eight bits at once without overflow.
    rows = np.flatnonzero(n)
    runs = (n[rows] + 254) // 255
    first = np.cumsum(n[rows]) - n[rows]
    run_of = np.repeat(np.arange(len(rows)), runs)
    run_at = first[run_of] + 255 * (np.arange(len(run_of)) - np.repeat(np.cumsum(runs) - runs, runs))
    heads = np.cumsum(runs) - runs
    ones = np.uint64(0x0101010101010101)
    found = np.zeros(len(rows), np.uint64)
    for bit in range(8):
        sums = np.add.reduceat((values >> np.uint64(bit)) & ones, run_at)
        each = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), heads, axis=0)
        high = (2 * each > n[rows][:, None]).astype(np.uint64)
        for byte in range(8):
            found |= high[:, byte] << np.uint64(8 * byte + bit)
    out[rows] = found
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprint_list(text_list(batch.column("text"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def as_hex(fp: Column) -> Column:
    """A fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------ anchors


def _syndromes(width: int) -> np.ndarray:
    """Syndrome of every value of a Hamming block: the exclusive or of the numbers (from 1) of its set bits."""
    values = np.arange(1 << width)
    out = np.zeros(1 << width, np.int64)
    for bit in range(width):
        out ^= np.where(values >> bit & 1, bit + 1, 0)
    return out


def _masks(width: int, excess: int) -> dict[tuple[int, int], list[int]]:
    """Flips that lead a block to a code word, by (syndrome, excess over the covering radius)."""
    out: dict[tuple[int, int], list[int]] = {}
    radius = 0 if width == 1 else 1
    for size in range(min(width, radius + excess) + 1):
        for bits in combinations(range(width), size):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1
            out.setdefault((0 if width == 1 else syndrome, max(0, size - radius)), []).append(sum(1 << b for b in bits))
    return out


class Part:
    """One part of the fingerprint with its covering code."""

    def __init__(self, number: int, shift: int, blocks: tuple[int, ...], excess: int):
        self.number, self.shift, self.bits, self.excess = number, shift, sum(blocks), excess
        self.mask = np.uint64((1 << self.bits) - 1)
        hamming = [b for b in blocks if b > 1]
        self.free = self.bits - sum(hamming)
        self.widths = hamming
        #: For each combination of syndromes: flips to all anchors in reach, the nearest one first.
        self.flips: dict[int, np.ndarray] = {}
        tables = [_masks(b, excess) for b in hamming]
        base = sum(hamming)
        free = [[sum(1 << (base + b) for b in bits) for bits in combinations(range(self.free), e)] for e in range(excess + 1)]
        for combo in product(*[range(b + 1) for b in hamming]):
            found: list[list[int]] = [[0]] + [[] for _ in range(excess)]
            at = 0
            for syndrome, width, masks in zip(combo, hamming, tables):
                step: list[list[int]] = [[] for _ in range(excess + 1)]
                for e in range(excess + 1):
                    for more in range(excess + 1 - e):
                        step[e + more] += [x | m << at for x in found[e] for m in masks.get((syndrome, more), [])]
                found, at = step, at + width
            step = [[] for _ in range(excess + 1)]
            for e in range(excess + 1):
                for more in range(excess + 1 - e):
                    step[e + more] += [x | m for x in found[e] for m in free[more]]
            key = 0
            for syndrome, width in zip(combo, hamming):
                key = key * (width + 1) + syndrome
            self.flips[key] = np.array([m for ring in step for m in ring], np.uint64)
        self.tables = [_syndromes(b) for b in hamming]

    def classes(self, values: np.ndarray) -> np.ndarray:
        key = np.zeros(len(values), np.int64)
        at = 0
        for width, syndromes in zip(self.widths, self.tables):
            key = key * (width + 1) + syndromes[(values >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)]
            at += width
        return key

    def reach(self) -> float:
        """Mean number of anchors that a fingerprint is copied to."""
        weight = 1.0
        for w in self.widths:
            weight /= w + 1
        mean = weight * sum(len(f) for f in self.flips.values())
        return 1 + (mean - 1) / 2 if self.excess == 1 else mean

    def anchors(self) -> float:
        return 2.0 ** (self.bits - sum(int(math.log2(w + 1)) for w in self.widths))

    def visits(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, fingerprint) pairs. With a threshold of one bit, only values of odd parity travel:
        of two values that differ in one bit, exactly one is odd and comes to the other's home."""
        value = fp >> np.uint64(self.shift) & self.mask
        key, odd = self.classes(value), np.bitwise_count(value) & 1
        anchors, members = [], []
        for k in np.unique(key).tolist():
            here = key == k
            flips = self.flips[k]
            if self.excess == 1:
                stay = here & (odd == 0)
                anchors.append(value[stay] ^ flips[0])
                members.append(fp[stay])
                here &= odd == 1
            anchors.append((value[here][:, None] ^ flips[None, :]).ravel())
            members.append(np.repeat(fp[here], len(flips)))
        tag = np.uint64(self.number << 32)
        return np.concatenate(anchors) | tag, np.concatenate(members)

    def homes(self, fp: np.ndarray) -> np.ndarray:
        value = fp >> np.uint64(self.shift) & self.mask
        first = np.zeros(max(self.flips) + 1, np.uint64)
        for k, flips in self.flips.items():
            first[k] = flips[0]
        return (value ^ first[self.classes(value)]) | np.uint64(self.number << 32)


def make_parts(code: tuple[tuple[int, ...], ...], distance: int) -> list[Part]:
    parts, shift = [], 0
    for number, blocks in enumerate(code):
        parts.append(Part(number, shift, blocks, distance // len(code)))
        shift += sum(blocks)
    assert shift == 64
    return parts


def choose_code(rows: int, distance: int = DISTANCE) -> tuple[tuple[int, ...], ...]:
    """The code with the least work for ``rows`` distinct fingerprints: copies against comparisons. Every
    code finds every link; finer codes copy more and compare less. Three parts allow one bit for each, two allow two."""

    def cost(code: tuple[tuple[int, ...], ...]) -> float:
        total = 0.0
        for part in make_parts(code, distance):
            total += part.reach() * (COPY_COST + rows / part.anchors())
        return total

    return min(CODES, key=cost)


# ------------------------------------------------------------------ comparison


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        fresh = label.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        fresh = fresh[fresh]
        if np.array_equal(fresh, label):
            break
        label = fresh
    return label


def _walk(fp: np.ndarray, distance: int) -> np.ndarray:
    """Labels of one large group: every member is compared with the members not yet reached, so a dense
    group of near copies costs little more than its size."""
    label = np.full(len(fp), -1, np.int64)
    rest = np.arange(len(fp))
    while len(rest):
        head = rest[0]
        label[head] = head
        rest, todo = rest[1:], [head]
        while todo and len(rest):
            near = np.bitwise_count(fp[rest] ^ fp[todo.pop()]) <= distance
            if near.any():
                label[rest[near]] = head
                todo.extend(rest[near].tolist())
                rest = rest[~near]
    return label


def _compare(keys: np.ndarray, fp: np.ndarray, parts: list[Part], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least linked fingerprint index) inside the complete groups of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    size = np.diff(np.append(starts, len(keys)))
    anchor = keys[:, 0].view(np.uint64)
    home = np.zeros(len(fp), bool)
    for part in parts:
        mine = np.flatnonzero(anchor >> np.uint64(32) == part.number)
        home[mine] = part.homes(fp[mine]) == anchor[mine]
    homes = np.add.reduceat(home.astype(np.int64), starts)
    work = homes * size
    out_a, out_b = [], []
    for g in np.flatnonzero((work > PAIRS_AT_ONCE) & (size > 1)).tolist():
        own = np.sort(fp[starts[g]:starts[g] + size[g]])
        label = _walk(own, distance)
        moved = label != np.arange(len(own))
        out_a.append(own[moved])
        out_b.append(own[label[moved]])
    small = np.flatnonzero((homes > 0) & (size > 1) & (work <= PAIRS_AT_ONCE))
    if len(small):
        for chunk in np.split(small, np.flatnonzero(np.diff(np.cumsum(work[small]) // PAIRS_AT_ONCE)) + 1):
            rows = np.repeat(starts[chunk], size[chunk]) + np.arange(size[chunk].sum()) - np.repeat(np.cumsum(size[chunk]) - size[chunk], size[chunk])
            width = np.repeat(size[chunk], size[chunk])
            first = np.repeat(starts[chunk], size[chunk])
            left = rows[home[rows]]
            width, first = width[home[rows]], first[home[rows]]
            a = np.repeat(left, width)
            b = np.repeat(first, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            a, b = a[near], b[near]
            a, b = a[a != b], b[a != b]
            if len(a):
                ids, at = np.unique(np.concatenate([fp[a], fp[b]]), return_inverse=True)
                label = _labels(len(ids), at[: len(a)], at[len(a):])
                moved = label != np.arange(len(ids))
                out_a.append(ids[moved])
                out_b.append(ids[label[moved]])
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def links(distinct: DataFrame, code: tuple[tuple[int, ...], ...], distance: int = DISTANCE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links of at most
    ``distance`` bits. ``distinct`` has one column fp."""
    parts = make_parts(code, distance)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(whole), 4096):
                for part in parts:
                    anchor, fp = part.visits(whole[at:at + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp.view(np.int64))], ["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _compare(keys, fp, parts, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "cell")], axis=1).astype(np.int64)
            waiting.append((keys, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if sum(len(w[1]) for w in waiting) < COMPARED_TOGETHER or (waiting[0][0][0] == keys[-1]).all():
                continue  # too few rows yet, or still inside one group
            keys, fp = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
            last = np.flatnonzero((keys != keys[-1]).any(axis=1))[-1] + 1
            yield out(keys[:last], fp[:last])
            waiting = [(keys[last:], fp[last:])]
        held = [w for w in waiting if len(w[1])]
        if held:
            yield out(np.concatenate([w[0] for w in held]), np.concatenate([w[1] for w in held]))

    copies = distinct.select("fp").mapInArrow(spread, "anchor long, fp long")
    hot = cut(copies.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_rows))
    if hot.isEmpty():
        celled = copies.withColumn("cell", F.lit(0).cast("long"))
    else:
        # A group over the limit becomes a grid of cells: every two chunks of it meet in one cell.
        side = F.coalesce(F.ceil(2 * F.col("n") / group_rows), F.lit(1)).cast("long")
        celled = (
            copies.join(hot, "anchor", "left").withColumn("side", side)
            .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("side")))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("side") - 1)))
            .select("anchor", "fp", (F.least("chunk", "other") * F.col("side") + F.greatest("chunk", "other")).alias("cell"))
        )
    met = celled.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(compare, "a long, b long")
    return met.distinct()


def near_copies(docs: DataFrame, distance: int = DISTANCE, code: tuple[tuple[int, ...], ...] | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id that links of at most ``distance`` bits reach. Null and empty texts
    have fingerprint zero and are linked like any other. Repeated rows are returned as often as they came.
    A missing doc_id is never the smallest unless a component has no other. An empty table gives no rows.
    """
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = cut(links(distinct, code or choose_code(distinct.count(), distance), distance, group_rows))
    labels = components(edges)
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    groups = named.select("fp", "label").join(least, "label").select("fp", "component_id")
    drop_cut(edges)
    return prints.join(groups, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest doc_id. Rows that repeat a
    doc_id are one document and stay or go together; rows without a doc_id cannot be named and stay."""
    found = near_copies(docs, **options)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(cut(gone), "doc_id", "left_anti").select(*docs.columns)
