"""Best-fit packing of token sequences, in bulk-synchronous rounds over equal lengths.

Documents and gaps are kept sorted by size. Lengths are whole numbers up to the capacity, so the sorted documents are at most ``capacity``
runs of equal length, and sequences with the same history are runs of equal gap. A round takes the longest documents that are left, sweeps
the gaps for the successor of their length, gives the gaps of that run to the documents by rank, and updates the gaps; the next round goes on
with what is left. Rounds touch runs only, never rows. The rows are numbered by (length, row) on the executors and find their sequence
by their rank.
"""

from __future__ import annotations

import base64
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, small_batches, text_list

CAPACITY = 2048
#: Files of the public tokenizer: the same vocabulary in the formats of two libraries.
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Special tokens of that vocabulary by text, and the id that ends a document.
SPECIAL = {"<|endoftext|>": 50256}
END_ID = 0


class Encoder:
    """Token ids of texts. The faster library reads the ranks of the vocabulary; a text whose pattern match it gives up (millions of blanks
    in a row) goes through the vocabulary's own library. Both give the same ids."""

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
        with open(ranks or public_tokenizers.path(RANKS), "rb") as lines:
            known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=SPECIAL)
        self.own = None

    def __call__(self, text: str) -> list[int]:
        try:
            return self.fast.encode(text, allowed_special="all")
        except ValueError:
            if self.own is None:
                from tokenizers import Tokenizer

                self.own = Tokenizer.from_file(self.vocabulary)
            return self.own.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every row of ``docs`` (doc_id, text), END_ID after them, as little-endian
    unsigned 32-bit numbers. Longer documents are cut into pieces of ``capacity`` ids, the first of which may be shorter.

    A null text is empty and gives one piece of END_ID alone. A missing doc_id stays null; repeated rows are documents of their own; an empty
    table gives no rows. Other columns are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(vocabulary, ranks)
        for batch in slices(batches):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_list(batch.column("text"))):
                ids = array("I", encode(text.decode("utf-8", "replace")))
                ids.append(END_ID)
                whole, n = np.frombuffer(ids, np.uint32).astype("<u4", copy=False).tobytes(), len(ids)
                first = n % capacity or capacity
                bounds = [0, *range(min(first, n), n + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    for column, value in zip(rows, (doc, i, a, b - a, whole[4 * a:4 * b])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64()),
                pa.array(rows[4], pa.binary())], names)

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the documents of each length go: runs of consecutive ranks, as arrays (length, rank, seq, each, offset).

    The document of rank ``rank + k`` of its length stands in sequence ``seq + k // each`` at ``offset + (k % each) * length``. Rounds go
    from the longest length down; the smallest gap that is large enough takes as many documents as it holds, equal gaps in order. Only
    where no gap is left new sequences are opened.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, number of sequences)
    sizes: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    fresh = 0

    def keep(gap: int, seq: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in runs:
                insort(sizes, gap)
                runs[gap] = []
            runs[gap].append((seq, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"no sequence of {capacity} holds a length of {length}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                seq, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], sizes[at]
            else:
                gap, seq, n = capacity, fresh, -(-left // (capacity // length))
                fresh += n
            each = gap // length
            filled = min(n, left // each)
            if filled:
                out.append((length, rank, seq, each, capacity - gap))
                keep(gap - each * length, seq, filled)
                rank, left = rank + filled * each, left - filled * each
            if filled < n:
                if left:  # fewer than a gap holds
                    out.append((length, rank, seq + filled, left, capacity - gap))
                    keep(gap - left * length, seq + filled, 1)
                    filled, left = filled + 1, 0
                keep(gap, seq + filled, n - filled)
    return dict(zip(("length", "rank", "seq", "each", "offset"), np.array(out, np.int64).reshape(-1, 5).T))


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` with (sequence_id, offset): rows with a column ``length`` from 1 to ``capacity``, packed into sequences of at most ``capacity``.

    Sequences are filled without holes from 0. Equal lengths are told apart by a row number that is stored with the rows, so a lost executor
    changes nothing. Only the number of rows of each length, at most ``capacity`` of them, and the runs made of them reach the driver and the tasks.
    A length that a third of all rows have is ranked by tasks, never in one place. No rows give no rows; a length beyond the capacity is an error.
    """
    columns = items.columns
    rows = cut(items.withColumn("_row", F.monotonically_increasing_id())).withColumn("_task", F.expr("shiftright(_row, 33)"))
    each = rows.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r["length"]): r["n"] for r in each.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = best_fit(counts, capacity)
    place = np.argsort(plan["length"] * (1 << 40) + plan["rank"])
    sizes = np.array(sorted(counts), np.int64)
    base = np.concatenate([[0], np.cumsum([counts[int(s)] for s in sizes])])[:len(sizes)].astype(np.int64)
    table = {k: v[place] for k, v in plan.items()}
    table["start"] = base[np.searchsorted(sizes, table["length"])] + table["rank"] if len(sizes) else np.zeros(0, np.int64)
    shared = items.sparkSession.sparkContext.broadcast((sizes, base, table))  # runs of lengths, not rows

    ahead = W.partitionBy("length").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    before = each.select("length", "_task", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("length", "_task").orderBy("_row"))
    ranked = rows.withColumn("_inside", inside).join(before, ["length", "_task"]).withColumn("_rank", F.col("_before") + F.col("_inside") - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, base, table = shared.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            number = base[np.searchsorted(sizes, length)] + batch.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["start"], number, "right") - 1
            k = number - table["start"][at]
            seq = table["seq"][at] + k // table["each"][at]
            offset = table["offset"][at] + k % table["each"][at] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(seq), pa.array(offset)], [*columns, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructType

    schema = StructType([*items.schema.fields]).add("sequence_id", LongType()).add("offset", LongType())
    return ranked.select(*columns, "_rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, with_ids: bool = False, **files: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every document; the ids themselves with ``with_ids``.
    Without them only the numbers of the pieces are stored and shuffled."""
    cut_up = pieces(docs, capacity, **files).withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut_up if with_ids else cut_up.drop("ids"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_ids, ids): the packed sequences as token ids, from pieces with ids. A sequence holds at most the capacity."""
    listed = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("l"))
    return listed.select("sequence_id", F.expr("aggregate(l.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids")).select(
        "sequence_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), "ids")
