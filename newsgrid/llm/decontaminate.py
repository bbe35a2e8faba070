"""Benchmark passages in documents, through a positional inverted index.

The index is kept by document shard: each slice of documents stores, for the terms of the test set, the list of their positions.
A window of a test item is searched from its rarest term: that list, moved back by the term's offset, holds the only
possible starts; the other lists, moved by their own offsets, are intersected with it in the order of rarity. Nothing is shuffled,
and a passage that many documents hold is spread like the documents. The test set is sent to the tasks in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, small_batches, text_list

WINDOW = 13
#: A document is contaminated if at least one word in so many is hit.
ONE_IN = 20
#: Words of test items that are sent to the tasks at once.
BLOCK_WORDS = 2_000_000

SPANS = T.ArrayType(T.StructType().add("start", "long").add("end", "long"))

#: Bytes of words (digits, letters, all that is not ASCII) stay, A-Z in lower case; all others become a space.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class Windows:
    """The windows of a block of test items as numbers of terms. Equal windows are kept once, with all their items."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int = WINDOW):
        at: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for name, words in items:
            terms = [at.setdefault(w, len(at)) for w in words]
            for i in range(max(1, len(terms) - width + 1) if terms else 0):
                found.setdefault(tuple(terms[i:i + width]), set()).add(name)
        self.terms = pa.array(list(at), pa.large_binary())
        self.names = [sorted(x) for x in found.values()]
        self.size = np.array([len(w) for w in found], np.int64)
        self.width = width
        self.words = np.full((len(found), width), -1, np.int64)
        for i, w in enumerate(found):
            self.words[i, : len(w)] = w


class Postings:
    """Positions of the test terms in a slice of documents. Documents are apart by a gap, so that no window crosses."""

    def __init__(self, texts: list[bytes], windows: Windows):
        words, counts = [], []
        for text in texts:
            own = split_words(text)
            words += own
            counts.append(len(own))
        self.counts = np.array(counts, np.int64)
        self.first = np.cumsum(self.counts) - self.counts + np.arange(len(texts)) * windows.width
        self.length = int(self.counts.sum()) + len(texts) * windows.width
        if not words or not len(windows.terms):
            term = np.zeros(0, np.int64)
            where = np.zeros(0, np.int64)
        else:
            number = pc.fill_null(pc.index_in(pa.array(words, pa.large_binary()), value_set=windows.terms), -1).to_numpy(zero_copy_only=False)
            place = np.flatnonzero(number >= 0)
            term = number[place].astype(np.int64)
            gap = np.repeat(np.arange(len(texts)) * windows.width, self.counts)
            where = place + gap[place]
        # Sorted keys: the list of a term is one run of them.
        self.keys = np.sort(term * self.length + where)
        self.starts = np.searchsorted(self.keys, np.arange(len(windows.terms) + 1) * self.length)

    def lists(self) -> np.ndarray:
        """Length of each term's list."""
        return np.diff(self.starts)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Is the position in the term's list?"""
        ok = (position >= 0) & (position < self.length)
        key = term * self.length + position
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return ok & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)


def phrases(index: Postings, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of every exact occurrence, rarest terms first."""
    if not len(windows.size) or not len(index.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = index.lists()
    inside = windows.words >= 0
    rarity = np.where(inside, length[np.where(inside, windows.words, 0)], np.iinfo(np.int64).max)
    alive = np.flatnonzero((np.where(inside, rarity, 1) > 0).all(axis=1))
    order = np.argsort(rarity[alive], axis=1, kind="stable")
    term = windows.words[alive, order[:, 0]]
    n = length[term]
    window = np.repeat(np.arange(len(alive)), n)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    start = index.keys[index.starts[np.repeat(term, n)] + rank] - np.repeat(term, n) * index.length - np.repeat(order[:, 0], n)
    for j in range(1, windows.width):
        if not len(window):
            break
        offset = order[window, j]
        word = windows.words[alive[window], offset]
        keep = (word < 0) | index.has(np.where(word < 0, 0, word), start + offset)
        window, start = window[keep], start[keep]
    ok = start >= 0
    return alive[window[ok]], start[ok]


def near(index: Postings, windows: Windows, terms: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, position) where the ``terms`` rarest words of a window all lie within ``span`` words after, or before,
    a place of the rarest one, in any order."""
    if not len(windows.size) or not len(index.keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    length = index.lists()
    inside = windows.words >= 0
    rarity = np.where(inside, length[np.where(inside, windows.words, 0)], np.iinfo(np.int64).max)
    order = np.argsort(rarity, axis=1, kind="stable")
    first = windows.words[np.arange(len(order)), order[:, 0]]
    n = length[first]
    window = np.repeat(np.arange(len(order)), n)
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    place = index.keys[index.starts[first[window]] + rank] - first[window] * index.length
    for j in range(1, min(terms, windows.width)):
        word = windows.words[window, order[window, j]]
        low = np.searchsorted(index.keys, np.where(word < 0, 0, word) * index.length + np.maximum(place - span, 0))
        at = np.minimum(low, len(index.keys) - 1)
        gap = index.keys[at] - word * index.length - place
        keep = (word < 0) | ((low < len(index.keys)) & (gap <= span) & (gap >= -span))
        window, place = window[keep], place[keep]
    return window, place


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test items, read one after the other, in blocks of at most about ``block_words`` words."""
    block, words = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        own = split_words((row.text or "").encode())
        block.append((row.item_id if row.item_id is not None else "", own))
        words += len(own)
        if words >= block_words:
            yield block
            block, words = [], 0
    if block:
        yield block


def _pass(docs: DataFrame, block: list[tuple[str, list[bytes]]], width: int, keep: list[str], out: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and what was found, as columns named ``out``: number of words, merged hit spans, items
    with occurring windows. If ``docs`` has these columns already, from an earlier block, they are added to."""
    shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about BLOCK_WORDS words
    again = out[0] in docs.columns
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(shared.value, width)
        for batch in slices(batches):
            index = Postings(text_list(batch.column("text")), windows)
            window, start = phrases(index, windows)
            delta = np.zeros(index.length + 1, np.int64)
            np.add.at(delta, start, 1)
            np.add.at(delta, start + windows.size[window], -1)
            edge = np.flatnonzero(np.diff((np.cumsum(delta[:-1]) > 0).astype(np.int8), prepend=0, append=0))
            begins, ends = edge[::2], edge[1::2]
            spans = batch.column(out[1]).to_pylist() if again else [[] for _ in range(batch.num_rows)]
            names = [set(x) for x in batch.column(out[2]).to_pylist()] if again else [set() for _ in range(batch.num_rows)]
            for o, b, e in zip((np.searchsorted(index.first, begins, side="right") - 1).tolist(), begins.tolist(), ends.tolist()):
                base = int(index.first[o])
                spans[o].append({"start": b - base, "end": e - base})
            for o, w in set(zip((np.searchsorted(index.first, start, side="right") - 1).tolist(), window.tolist())):
                names[o].update(windows.names[w])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], pa.array(index.counts), pa.array(spans, span_type), pa.array([sorted(x) for x in names], pa.list_(pa.string()))],
                [*keep, *out])

    schema = T.StructType([docs.schema[k] for k in keep]).add(out[0], "long").add(out[1], SPANS).add(out[2], T.ArrayType(T.StringType()))
    return small_batches(docs).mapInArrow(run, schema)


def _all_passes(docs: DataFrame, items: DataFrame, width: int, keep: list[str], out: list[str], block_words: int) -> DataFrame:
    """One pass over the documents for each block of items, without a shuffle; an empty test set makes one pass."""
    blocks = item_blocks(items, block_words)
    now, following = next(blocks, []), next(blocks, None)
    while following is not None:
        docs = _pass(docs, now, width, list(dict.fromkeys([*keep, "text"])), out)
        now, following = following, next(blocks, None)
    return _pass(docs, now, width, keep, out)


def covered(spans: str) -> Column:
    """Words under the union of spans; they may overlap when they come from several blocks of items."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        F.array_sort(F.col(spans)), F.struct(zero.alias("n"), zero.alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(zero, x["end"] - F.greatest(x["start"], a["to"]))).alias("n"), F.greatest(a["to"], x["end"]).alias("to")),
        lambda a: a["n"])


def is_contaminated(n_hit: Column, n_words: Column, one_in: int = ONE_IN) -> Column:
    return (n_hit > 0) & (one_in * n_hit >= n_words)


def search(docs: DataFrame, items: DataFrame, width: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs`` (doc_id, text): the spans of words [start, end) inside occurrences of
    windows of ``width`` words of the items (item_id, text), and the ids of these items, sorted as strings.

    An item of fewer words is one window; one without words has none. Null texts have no words. An item without an id is named by the
    empty string; items that repeat an id are one. Repeated documents are returned as often as they came. Empty tables give
    no rows, or no hits.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _all_passes(docs, items, width, ["doc_id"], ["n_words", "spans", "items"], block_words)


def report(found: DataFrame, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items, contaminated) from the result of :func:`search`."""
    counted = found.select("doc_id", "n_words", covered("spans").alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items")
    return counted.withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words"), one_in))


def clean(docs: DataFrame, items: DataFrame, width: int = WINDOW, one_in: int = ONE_IN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with all its columns, without the contaminated rows: those with hits on at least one word in ``one_in``."""
    out = [f"_found{i}" for i in range(len(docs.columns) + 3) if f"_found{i}" not in docs.columns][:3]
    found = _all_passes(docs, items, width, docs.columns, out, block_words)
    return found.filter(~is_contaminated(covered(out[1]), F.col(out[0]), one_in)).select(*docs.columns)


def proximity(docs: DataFrame, items: DataFrame, terms: int = 5, span: int = 30, width: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, word): places where the ``terms`` rarest words of a window of an item, in any order, lie within ``span`` words
    of the rarest one. Looser than a phrase: finds reworded and reordered passages. One row for each document, item and place."""
    result = None
    for block in item_blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            windows = Windows(shared.value, width)
            for batch in slices(batches):
                index = Postings(text_list(batch.column("text")), windows)
                window, place = near(index, windows, terms, span)
                owner = np.searchsorted(index.first, place, side="right") - 1
                rows = sorted({(o, name, p) for o, w, p in zip(owner.tolist(), window.tolist(), (place - index.first[owner]).tolist()) for name in windows.names[w]})
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "item_id", "word"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id string, word long")
        result = part if result is None else result.union(part).distinct()
    return result if result is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id string, word long")
