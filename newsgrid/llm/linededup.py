"""Lines that many documents share, found with two Bloom filters.

Every task keeps two bit sets over the keys of its lines: met once, met twice. The sets are merged with
OR and AND over the tasks, so that a bit of the second set tells that two lines may share a key. Only lines whose
bits are all set there, the suspects, are shuffled; they are confirmed exactly by document counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NO_ID, cut, drop_cut, slices, small_batches, text_list

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of a filter for each document, rounded to a power of two, and the largest filter in bits (32 MB):
#: beyond it more lines become suspects, and the result stays the same.
BITS_PER_DOC = 256
MAX_BITS = 1 << 28
PROBES = 3
#: Shared keys that are sent to every task, at most (24 bytes each).
BROADCAST_KEYS = 2_000_000
#: Bits of a filter that travel in one row.
BLOCK_BITS = 1 << 19


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


#: Bytes that continue a character; without them, bytes count code points.
_DROP_TAIL = bytes(range(0x80, 0xC0))


def _eligible(text: bytes, least: int) -> set[bytes]:
    """The distinct keys of a text that have at least ``least`` code points."""
    keys = {line_key(line) for line in text.split(b"\n") if len(line) >= least}
    return {k for k in keys if len(k) >= least and (len(k) >= 4 * least or len(k.translate(None, _DROP_TAIL)) >= least)}


def digest(key: bytes) -> bytes:
    """128 bits that stand for the key where keys are counted and joined."""
    return hashlib.blake2b(key, digest_size=16).digest()


def _positions(keys: list[bytes], bits: int) -> np.ndarray:
    """Filter positions of keys, one row for each key."""
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = h >> np.uint64(32) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def filter_bits(rows: int) -> int:
    """Filter size for a number of documents."""
    wanted = max(1 << 16, rows * BITS_PER_DOC)
    return min(MAX_BITS, 1 << (wanted - 1).bit_length())


def repeat_filter(docs: DataFrame, bits: int, min_chars: int = MIN_CHARS) -> np.ndarray:
    """The merged filter of keys met twice, as bytes of ``bits`` bits. A key that two documents, or two rows,
    hold is always in it. One task for each core builds its pair of filters; blocks of bits are merged
    by block, and what reaches the driver has the size of one filter."""
    spark = docs.sparkSession
    block = min(bits, BLOCK_BITS)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in slices(batches):
            keys = [k for text in text_list(batch.column("text")) for k in _eligible(text, min_chars)]
            if not keys:
                continue
            at = _positions(keys, bits)
            # Within the slice: the second and later holders of the same positions.
            order = np.lexsort(at.T)
            again = np.zeros(len(keys), bool)
            again[order[1:]] = (at[order[1:]] == at[order[:-1]]).all(axis=1)
            bit = (1 << (at & 7)).astype(np.uint8)
            again |= ((once[at >> 3] & bit) != 0).all(axis=1)
            np.bitwise_or.at(twice, (at[again] >> 3).ravel(), bit[again].ravel())
            np.bitwise_or.at(once, (at >> 3).ravel(), bit.ravel())
        if once.any():
            for n, start in enumerate(range(0, bits >> 3, block >> 3)):
                a, b = once[start:start + (block >> 3)], twice[start:start + (block >> 3)]
                if a.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n], pa.int32()), pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["block", "once", "twice"])

    def merge(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(block >> 3, np.uint8), np.zeros(block >> 3, np.uint8)
        for batch in rows:
            for a, b in zip(batch.column("once"), batch.column("twice")):
                a, b = np.frombuffer(a.as_py(), np.uint8), np.frombuffer(b.as_py(), np.uint8)
                twice |= b | once & a
                once |= a
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["block", "twice"])

    tasks = spark.sparkContext.defaultParallelism
    parts = docs.select("text").coalesce(tasks).mapInArrow(build, "block int, once binary, twice binary")
    blocks = parts.groupBy("block").applyInArrow(merge, "block int, twice binary")
    out = np.zeros(bits >> 3, np.uint8)
    for row in blocks.collect():
        out[row.block * (block >> 3):][: block >> 3] = np.frombuffer(row.twice, np.uint8)
    return out


def suspects(docs: DataFrame, twice: np.ndarray, bits: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, key): digests of the lines that may repeat, each once for a row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(twice.tobytes())  # at most MAX_BITS / 8 bytes

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(shared.value, np.uint8)
        for batch in slices(batches):
            keys, owner = [], []
            for i, text in enumerate(text_list(batch.column("text"))):
                own = _eligible(text, min_chars)
                keys.extend(own)
                owner.extend([i] * len(own))
            if not keys:
                continue
            at = _positions(keys, bits)
            hit = np.flatnonzero((known[at >> 3] >> (at & 7) & 1).all(axis=1))
            ids = batch.column("doc_id").take(pa.array(np.array(owner, np.int64)[hit]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([digest(keys[j]) for j in hit.tolist()], pa.binary())], ["doc_id", "key"])

    return docs.select("doc_id", "text").mapInArrow(probe, "doc_id long, key binary")


def shared_keys(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(key, keeper): keys that ``min_docs`` documents hold, and the largest doc_id of them. ``found`` has (doc_id, key)."""
    return (
        found.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .filter(F.col("n") >= min_docs).select("key", "keeper")
    )


def drops(found: DataFrame, many: DataFrame) -> DataFrame:
    """(doc_id, keys): for each document, the keys that lose their lines there."""
    return (
        found.distinct().join(many, "key").filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    )


class KeyTable:
    """Shared keys in sorted arrays, to be looked up by many digests at once."""

    def __init__(self, keys: bytes, keepers: np.ndarray):
        halves = np.frombuffer(keys, ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        self.high, self.low, self.keeper = halves[order, 0], halves[order, 1], keepers[order]

    def lost(self, digests: list[bytes], doc_ids: np.ndarray) -> np.ndarray:
        """Is the digest shared, and kept in another document?"""
        if not len(self.high) or not digests:
            return np.zeros(len(digests), bool)
        halves = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).reshape(-1, 2)
        at = np.minimum(np.searchsorted(self.high, halves[:, 0]), len(self.high) - 1)
        # Equal high halves of different keys are as good as impossible, but are stepped over all the same.
        while (step := (self.high[at] == halves[:, 0]) & (self.low[at] < halves[:, 1]) & (np.append(self.high, 0)[at + 1] == halves[:, 0]) & (at + 1 < len(self.high))).any():
            at = at + step
        return (self.high[at] == halves[:, 0]) & (self.low[at] == halves[:, 1]) & (self.keeper[at] != doc_ids)


def _filter_lines(text: bytes, keys: set[bytes]) -> tuple[bytes, int]:
    """The text without the lines whose key digests are in ``keys``, and how many went."""
    lines = text.split(b"\n")
    kept = [line for line in lines if digest(line_key(line)) not in keys]
    return b"\n".join(kept), len(lines) - len(kept)


def _rewrite(docs: DataFrame, min_chars: int, min_docs: int, bits: int | None, broadcast_keys: int, counts: bool) -> DataFrame:
    """``docs`` with the text rewritten, and with n_lines and n_dropped if ``counts``.

    The shared keys are looked up in place if they are few enough to be sent to every task; otherwise each document gets the
    keys it loses by a join on its id. Both ways give the same rows.
    """
    names = small_batches(docs).columns
    row_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    extra = next(n for n in (f"_lost{i}" for i in range(len(names) + 1)) if n not in names)
    narrow = docs.select(row_id.alias("doc_id"), "text")
    bits = bits or filter_bits(narrow.count())
    found = cut(suspects(narrow, repeat_filter(narrow, bits, min_chars), bits, min_chars))
    many = cut(shared_keys(found, min_docs))
    if many.count() <= broadcast_keys:
        rows = many.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast((b"".join(rows.column("key").to_pylist()), rows.column("keeper").to_numpy()))
        marked = docs.withColumn(extra, row_id)
    else:
        shared = None
        gone = cut(drops(found, many).select(F.col("doc_id").alias(extra), F.col("keys").alias(extra + "k")))
        marked = docs.withColumn(extra, row_id).join(gone, extra, "left").drop(extra).withColumnRenamed(extra + "k", extra)
    drop_cut(found)

    def lost_keys(batch: pa.RecordBatch, texts: list[bytes], known: KeyTable | None) -> list[set[bytes]]:
        if known is None:
            return [set(k or ()) for k in batch.column(extra).to_pylist()]
        out: list[set[bytes]] = [set() for _ in texts]
        owner, keys = [], []
        for i, text in enumerate(texts):
            own = [digest(k) for k in _eligible(text, min_chars)]
            owner += [i] * len(own)
            keys += own
        ids = batch.column(extra).to_numpy(zero_copy_only=False)[np.array(owner, np.int64)]
        for j in np.flatnonzero(known.lost(keys, ids)).tolist():
            out[owner[j]].add(keys[j])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = KeyTable(*shared.value) if shared else None
        for batch in slices(batches):
            texts = text_list(batch.column("text"))
            lost = lost_keys(batch, texts, known)
            kept, dropped = batch.column("text"), np.zeros(len(texts), np.int64)
            if any(lost):
                new = kept.to_pylist()
                for i, keys in enumerate(lost):
                    if keys:
                        text, dropped[i] = _filter_lines(texts[i], keys)
                        new[i] = text.decode("utf-8", "replace")
                kept = pa.array(new, pa.string())
            out = [kept if n == "text" else batch.column(n) for n in names]
            if counts:
                out += [pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array(dropped)]
            yield pa.RecordBatch.from_arrays(out, [*names, "n_lines", "n_dropped"] if counts else names)

    schema = T.StructType(list(docs.schema.fields))
    return marked.mapInArrow(run, schema.add("n_lines", "long").add("n_dropped", "long") if counts else schema)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) for every row: the text without the lines that repeat over documents.

    A line's key is the line without surrounding white space, in lower case (A-Z). Keys of at least ``min_chars`` code points
    held by at least ``min_docs`` doc_ids lose their lines except in the largest doc_id that holds them. A null or empty text
    is one line and stays as it is. Repeated rows are treated alike; rows without doc_id count as one document below all
    others; an empty table gives no rows.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _rewrite(narrow, min_chars, min_docs, bits, broadcast_keys, True)


def dedup_column(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, bits: int | None = None, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """``docs`` with its text column rewritten as in :func:`dedup_lines`, all other columns kept."""
    return _rewrite(docs, min_chars, min_docs, bits, broadcast_keys, False)
