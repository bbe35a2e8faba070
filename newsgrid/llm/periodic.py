"""Maximal periodic runs of words by recompression.

The words of each document are compressed by turns: equal neighbours become one symbol (a block with its length), then, for a split of
the symbols into left and right ones, every left-right pair becomes one symbol. Whether two neighbours merge depends on the two alone, so
equal stretches are compressed alike, and two positions are compared by climbing their symbols together and coming down where they differ:
one step on each level. Candidates (place, period) lie on a harmonic grid: for each period every run has a grid place where a
word equals the word one period later. The grammar's comparisons give the exact extent to both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_list

#: A run has at least this many words and at least this many periods.
LEAST_WORDS = 12
LEAST_PERIODS = 2
#: Periods up to this are swept over all documents of a slice at once, longer ones document by document.
SHORT_PERIODS = 512
#: Candidates that are compared together.
TOGETHER = 1 << 20
#: Levels of a grammar; what is left above is compared symbol by symbol.
MOST_LEVELS = 120

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for equal keys, and how many there are."""
    coded = pa.array(keys).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


@dataclass
class _Step:
    """From one level to the next: the symbols below, and for each its parent and its place in it."""

    sym: np.ndarray  # with a last entry -1 that equals no symbol and is also met to the left of the first
    block: bool
    parent: np.ndarray  # -1: the document goes no higher
    head: np.ndarray  # is it the first child?
    tail: np.ndarray  # is it the last child?
    first: np.ndarray  # of a parent: first child, one past the last child
    after: np.ndarray


class Grammar:
    """Run-length grammars of several documents, level by level. ``words`` are numbers that no two documents share, documents one after another."""

    def __init__(self, words: np.ndarray, doc: np.ndarray, n_docs: int):
        self.steps: list[_Step] = []
        sym, doc = words.astype(np.int64), doc.astype(np.int64)
        fresh = int(sym.max()) + 1 if len(sym) else 0
        for level in range(MOST_LEVELS):
            # A document whose symbols all differ has nothing left to find on higher levels.
            again = np.bincount(sym, minlength=fresh)[sym] > 1 if len(sym) else np.zeros(0, bool)
            alive = np.bincount(doc[again], minlength=n_docs) > 0
            live = alive[doc]
            if not live.any():
                break
            joined = np.zeros(len(sym), bool)  # with the symbol before
            block = level % 2 == 0
            if block:
                joined[1:] = (sym[1:] == sym[:-1]) & live[1:]
            else:
                right = ((sym.astype(np.uint64) + np.uint64(level)) * _MIX >> np.uint64(40) & np.uint64(1)).astype(bool)
                both = live[1:] & (doc[1:] == doc[:-1])
                up, down = both & right[1:] & ~right[:-1], both & ~right[1:] & right[:-1]
                joined[1:] = up if np.count_nonzero(up) >= np.count_nonzero(down) else down
            if not joined.any():
                if block:
                    continue
            head = ~joined
            tail = np.ones(len(sym), bool)
            tail[:-1] = head[1:]
            starts = np.flatnonzero(head & live)
            ends = np.flatnonzero(tail & live) + 1
            parent = np.where(live, np.cumsum(head & live) - 1, -1)
            above = sym[starts].copy()
            long = np.flatnonzero(ends - starts > 1)
            if len(long):
                second = (ends - starts)[long] if block else sym[starts[long] + 1]
                named, n = _names(above[long] << 32 | second)
                above[long] = fresh + named
                fresh += n
            self.steps.append(_Step(np.append(sym, -1), block, np.append(parent, -1), np.append(head, True), np.append(tail, True), np.append(starts, len(sym)), np.append(ends, 0)))
            sym, doc = above, doc[starts]
        self.top = np.append(sym, -1)

    def _climb(self, a: np.ndarray, b: np.ndarray, way: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """How far pairs (a, b) of places agree on each level: for each level the pairs that end there and where they stand.
        Places are gaps before a symbol; ``way`` is 1 to the right and -1 to the left."""
        stops = []
        who = np.arange(len(a))
        shift = 0 if way > 0 else -1  # from a gap to the symbol that is read
        for step in self.steps:
            equal = step.sym[a + shift] == step.sym[b + shift]
            stopped = ~equal
            inner = step.head if way > 0 else step.tail
            off = np.flatnonzero(equal & ~(inner[a + shift] & inner[b + shift]))
            if len(off):
                x, y = a[off], b[off]
                if step.block:
                    left, right = self._rest(step, x, way), self._rest(step, y, way)
                    go = np.minimum(left, right)
                    stopped[off[left != right]] = True
                else:
                    go = 1
                a[off] = x + way * go
                b[off] = y + way * go
            ended = np.flatnonzero(stopped)
            stops.append((who[ended], a[ended], b[ended]))
            on = np.flatnonzero(~stopped)
            if way > 0:
                a, b, who = step.parent[a[on]], step.parent[b[on]], who[on]
                # Past the end of a document, where the next one goes no higher, stands the entry that equals nothing.
                last = len(step.first) - 1
                a, b = np.where(a < 0, last, a), np.where(b < 0, last, b)
            else:
                a, b, who = step.parent[a[on] - 1] + 1, step.parent[b[on] - 1] + 1, who[on]
        live = np.flatnonzero(self.top[a + shift] == self.top[b + shift])
        while len(live):
            a[live] += way
            b[live] += way
            live = live[self.top[a[live] + shift] == self.top[b[live] + shift]]
        stops.append((who, a, b))
        return stops

    @staticmethod
    def _rest(step: _Step, at: np.ndarray, way: int) -> np.ndarray:
        """Symbols from a gap to the end of the block it stands in or before."""
        if way > 0:
            return step.after[step.parent[at]] - at
        return at - step.first[step.parent[at - 1]]

    def extent(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """Words for which the stretches from i and from j > i on agree, to the right (way 1) or to the left (way -1); i and j are gaps of one
        document and are not both at an end."""
        stops = self._climb(i.copy(), j.copy(), way)
        shift = 0 if way > 0 else -1
        who, a, b = stops[-1]
        for step, stop in zip(reversed(self.steps), reversed(stops[:-1])):
            if len(who):
                a, b = (step.first[a], step.first[b]) if way > 0 else (step.after[a - 1], step.after[b - 1])
                same = np.flatnonzero(step.sym[a + shift] == step.sym[b + shift])
                if len(same):
                    go = np.minimum(self._rest(step, a[same], way), self._rest(step, b[same], way)) if step.block else 1
                    a[same] += way * go
                    b[same] += way * go
            who, a, b = np.concatenate([stop[0], who]), np.concatenate([stop[1], a]), np.concatenate([stop[2], b])
        out = np.zeros(len(i), np.int64)
        # The left one of the two never leaves its document to the right, nor the right one to the left.
        out[who] = a - i[who] if way > 0 else j[who] - b
        return out


def _candidates(words: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the harmonic grid whose word equals the word one period later, with three more equal ones on one side.

    ``at`` are the bounds of the documents, longest first. A run of period q has max(q, LEAST_WORDS - q), so at least six, places in a row whose word equals
    the word q later; the grid of that spacing meets one, and four in a row on one side of it are equal."""
    size = np.diff(at)
    pad = np.concatenate([words, np.full(3, -1, np.int64)])
    end = len(words)

    def near(i: np.ndarray, q) -> np.ndarray:
        def same(d: int) -> np.ndarray:
            return (i + d >= 0) & (pad[np.maximum(i + d, 0)] == pad[np.minimum(i + d + q, end)])

        return (same(1) & same(2) & same(3)) | (same(-1) & same(-2) & same(-3))

    longest = int(size[0]) if len(size) else 0
    for q in range(1, min(SHORT_PERIODS, longest // LEAST_PERIODS) + 1):
        total = int(at[np.count_nonzero(size >= max(LEAST_WORDS, LEAST_PERIODS * q))])
        grid = max(q, LEAST_WORDS - q)
        i = np.flatnonzero(words[:max(0, total - q):grid] == words[q:total:grid]) * grid
        if len(i):
            i = i[near(i, q)]
            if len(i):
                yield i, np.full(len(i), q, np.int64)
    for d in np.flatnonzero(size // LEAST_PERIODS > SHORT_PERIODS).tolist():
        own, n = words[at[d]:at[d + 1]], int(size[d])
        k = 0
        while (k + 1) * (SHORT_PERIODS + 1) < n:  # place k*q for all long periods q at once
            q = np.arange(SHORT_PERIODS + 1, min(n // LEAST_PERIODS, (n - 1) // (k + 1)) + 1)
            q = q[own[k * q] == own[(k + 1) * q]]
            if len(q):
                i = at[d] + k * q
                good = near(i, q)
                if good.any():
                    yield i[good], q[good]
            k += 1


def find_runs(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all maximal runs, sorted; places count over all documents. ``words`` are numbers that no two documents
    share; the documents between the bounds ``at`` go from the longest to the shortest."""
    empty = np.zeros((0, 3), np.int64)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, grammar = empty, None
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> np.ndarray:
        nonlocal grammar
        if grammar is None:
            grammar = Grammar(words, doc, len(at) - 1)
        i, q = np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting])
        right, left = grammar.extent(i, i + q, 1), grammar.extent(i, i + q, -1)
        rows = np.stack([i - left, i + right + q, q], axis=1)
        size = rows[:, 1] - rows[:, 0]
        rows = np.concatenate([found, rows[(size >= LEAST_WORDS) & (size >= LEAST_PERIODS * q)]])
        # One stretch has one smallest period; the others met on it are multiples of it.
        rows = rows[np.lexsort(rows.T[::-1])]
        return rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else empty

    for i, q in _candidates(words, at):
        waiting.append((i, q))
        if sum(len(w[0]) for w in waiting) >= TOGETHER:
            found, waiting = settle(), []
    return settle() if waiting else found


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row of ``docs``; other columns are not read.

    Words are stretches without ASCII white space. ``runs`` lists every run (start, length, period) by start, then period: a stretch of
    consecutive words with smallest period q and at least max(12, 2q) words that neither neighbour extends. ``collapsed`` has the words that no
    run contains after its first q ones, joined by one space. A null or empty text has no words, no runs and collapses to the empty text. Repeated
    rows come back as often as they came, a missing id stays null, an empty table gives no rows. A slice of texts is worked on together, so a
    task's memory follows its longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            split = [t.split() for t in text_list(batch.column("text"))]
            n = np.array([len(w) for w in split], np.int64)
            order = np.flatnonzero(n >= LEAST_WORDS)
            order = order[np.argsort(-n[order], kind="stable")]
            at = np.concatenate([[0], np.cumsum(n[order])]).astype(np.int64)
            flat = [w for d in order.tolist() for w in split[d]]
            runs = np.zeros((0, 3), np.int64)
            if flat:
                coded, many = _names_of_words(flat)
                doc = np.repeat(np.arange(len(order)), n[order])
                runs = find_runs(_names(doc * many + coded)[0], at)
            of = np.searchsorted(at, runs[:, 0], "right") - 1
            cover = np.zeros(len(flat) + 1, np.int64)
            np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
            np.add.at(cover, runs[:, 1], -1)
            kept = np.cumsum(cover[:-1]) == 0
            found = [0] * len(split)
            texts = [None] * len(split)
            bounds = np.searchsorted(of, np.arange(len(order) + 1))
            for k, d in enumerate(order.tolist()):
                found[d] = int(bounds[k + 1] - bounds[k])
                if found[d]:
                    texts[d] = b" ".join([w for w, keep in zip(split[d], kept[at[k]:at[k + 1]].tolist()) if keep])
            # The runs of each row, in the order of the rows.
            count = np.array(found, np.int64)
            rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in np.argsort(order).tolist()]) if len(order) else np.zeros(0, np.int64)
            own = runs[rows]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.StructArray.from_arrays(
                [pa.array(own[:, 0] - at[of[rows]]), pa.array(own[:, 1] - own[:, 0]), pa.array(own[:, 2])], ["start", "length", "period"]))
            whole = pa.array([b" ".join(w) if t is None else t for w, t in zip(split, texts)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), lists, whole], ["doc_id", "n_words", "runs", "collapsed"])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def _names_of_words(words: list[bytes]) -> tuple[np.ndarray, int]:
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where every tenth document by h = crc32(id as text) is made periodic: with g = floor(h / 10), n words, a = g % n and
    p = 1 + floor((n - a) / (3 + g % 8)), each word i >= a becomes word a + (i - a) % p, and the words are joined by one space. Other documents, and
    those without an id or words, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    chosen = docs.withColumn("_g", F.when(h % 10 == 0, F.floor(h / 10)))
    chosen = chosen.withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"), 0)))
    n = F.size("_w")
    chosen = chosen.withColumn("_a", F.when(n > 0, F.pmod(F.col("_g"), n)))
    chosen = chosen.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.pmod(F.col("_g"), F.lit(8)))))

    def words(start: Column, length: Column) -> Column:
        return F.slice("_w", start.cast("int"), length.cast("int"))

    rest = n - F.col("_a")
    turns = F.flatten(F.array_repeat(words(F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    made = F.concat(words(F.lit(1), F.col("_a")), F.slice(turns, F.lit(1), rest.cast("int")))
    return chosen.withColumn(text_col, F.when(n > 0, F.array_join(made, " ")).otherwise(F.col(text_col))).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of the rows of ``periodic_runs``: the
    longest run (ties: least start, then least period; nulls if there is none) and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("a"), (-r["period"]).alias("b"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.a")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.b")).alias("period"),
        F.floor(1000 * F.col("_b.length") / -F.col("_b.b")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
