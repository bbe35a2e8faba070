"""Prefix trie of conversations in balanced parentheses, shard by shard.

Conversations are sorted by their sequence of turns, so those with a common prefix stand together, and dealt out in ranges. A shard writes
its part of the trie as balanced parentheses: a node opens, its children follow, it closes. A tree of blocks with the least and the greatest
excess finds where a node closes; that delimits its subtree, and ranks and running sums between the two places give members, leaf pairs and
savings. Only nodes on the first and the last path of a shard can stand in other shards, too. These spines, with what hangs below them
already summed, are the input of the next round, until one shard holds all that is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, small_batches

#: The first conversation of each group of so many lends its first turns to the others.
GROUP = 20
MOST_LENT = 3
#: A shard is closed at so many turns, if it has at least so many paths, so that spines shrink in each round.
SHARD_TURNS = 20_000
LEAST_PATHS = 8
#: Spines of at most so many turns are merged by one task; more take another round.
LAST_TURNS = 200_000
BLOCK = 64
KEY_BYTES = 16
NOBODY = (1 << 63) - 1
NO_ENDS = hashlib.sha256(b"").hexdigest()

_SUMS = ("members", "leaves", "saved", "kids")
_ITEM = "path binary, words array<long>, members array<long>, leaves array<long>, saved array<long>, kids array<long>, least array<long>"
_NODE = "depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
_OUT = f"kind string, shard long, key binary, parent_key binary, {_NODE}, {_ITEM}"


# ------------------------------------------------------------------ turns


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation as it is: the 128-bit digests of its turns one after another, and the words of each turn.

    Turns go by ``turn``, null first; equal ones by their digests. A null role or text is empty. Rows without a conv_id take no part."""
    keyed = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("t"))
    return keyed.select("conv_id", _joined("t.key").alias("path"), F.col("t.words").alias("words"))


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of the rebuilt conversations: the first h turns of conversation c - c % GROUP (all if it has fewer, none if it is absent),
    then c's own turns after its first h, with h = crc32(c as text) % (MOST_LENT + 1). A rebuilt conversation may have no turns.

    Conversations of one group share a partition from the start, so the turns are shuffled once."""
    turns = _turns(conversations).withColumn("lender", F.col("conv_id") - F.col("conv_id") % GROUP).repartition("lender")
    own = turns.groupBy("lender", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("t"))
    lent = own.filter(F.col("conv_id") == F.col("lender")).select("lender", F.slice("t", 1, MOST_LENT).alias("first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_LENT + 1)).cast("int")
    both = own.join(lent, "lender", "left").withColumn("h", h)
    none = F.slice("t", F.lit(1), F.lit(0))
    made = F.concat(F.slice(F.coalesce("first", none), F.lit(1), F.col("h")), F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0))))
    return both.select("conv_id", made.alias("t")).select("conv_id", _joined("t.key").alias("path"), F.col("t.words").alias("words"))


def _turns(conversations: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(framed, 256), 1, 2 * KEY_BYTES)).alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))


def _joined(keys: str):
    """The keys of an array one after another, in time that is linear in their number."""
    return F.unhex(F.array_join(F.transform(F.col(keys), F.hex), ""))


# ------------------------------------------------------------------ balanced parentheses


def find_close(excess: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For opening parentheses at the places ``at`` the places where they close: the first later place whose excess is one less."""
    target = excess[at] - 1
    blocks = -(-len(excess) // BLOCK)
    padded = np.full(blocks * BLOCK, -2, np.int64)  # an excess that nobody looks for
    padded[:len(excess)] = excess
    rows = padded.reshape(blocks, BLOCK)
    low, high = [rows.min(axis=1)], [rows.max(axis=1)]
    while len(low[-1]) > 1:
        for side, none, best in ((low, NOBODY, np.minimum), (high, -NOBODY, np.maximum)):
            last = np.append(side[-1], none) if len(side[-1]) % 2 else side[-1]
            side[-1] = last
            side.append(best(last[::2], last[1::2]))

    def scan(block: np.ndarray, after: np.ndarray, want: np.ndarray) -> np.ndarray:
        """First place in the block, after the given one, with the wanted excess; -1 if none."""
        out = np.empty(len(block), np.int64)
        for a in range(0, len(block), 1 << 14):
            part = slice(a, a + (1 << 14))
            hit = (rows[block[part]] == want[part, None]) & (np.arange(BLOCK) > after[part, None])
            out[part] = np.where(hit.any(axis=1), block[part] * BLOCK + hit.argmax(axis=1), -1)
        return out

    found = scan(at // BLOCK, at % BLOCK, target)
    left = np.flatnonzero(found < 0)
    node, want = at[left] // BLOCK, target[left]
    start: list[np.ndarray] = []  # queries of each height whose answer lies below the right neighbour there
    where: list[np.ndarray] = []
    for lo, hi in zip(low, high):
        beside = np.minimum(node + 1, len(lo) - 1)
        inside = (node % 2 == 0) & (node + 1 < len(lo)) & (lo[beside] <= want) & (want <= hi[beside])
        start.append(left[inside])
        where.append(beside[inside])
        left, node, want = left[~inside], node[~inside] // 2, want[~inside]
    down, block = start.pop(), where.pop()
    for height in range(len(low) - 2, -1, -1):
        child = 2 * block
        goal = target[down]
        block = np.where((low[height][child] <= goal) & (goal <= high[height][child]), child, child + 1)
        down, block = np.concatenate([down, start[height]]), np.concatenate([block, where[height]])
    if len(down):
        found[down] = scan(block, np.full(len(down), -1), target[down])
    return found


@dataclass
class Items:
    """Paths of one shard, sorted, with what is known of the nodes on them. ``values`` has, for each item, k + 1 numbers in a row (root first)."""

    k: np.ndarray
    keys: np.ndarray  # one row of two numbers for each turn
    words: np.ndarray
    values: dict[str, np.ndarray]
    conv_id: np.ndarray | None = None  # in the first round only


class Shard:
    """The trie over the items of a shard. ``spine`` marks the nodes that other shards may have, too."""

    def __init__(self, items: Items, last: bool):
        k, n = items.k, len(items.k)
        self.items = items
        self.off = np.concatenate([[0], np.cumsum(k)])
        self.at = np.concatenate([[0], np.cumsum(k + 1)])  # of the values of an item
        common = self._common()
        opened = k - common
        opened[0] = k[0] + 1
        steps = np.zeros(2 * n + 1, np.int64)
        steps[2:-1:2] = k[:-1] - common[1:]
        steps[1::2] = opened
        steps[-1] = k[-1] + 1
        bits = np.repeat(np.where(np.arange(2 * n + 1) % 2, 1, -1), steps)
        excess = np.cumsum(bits)
        open_at = np.flatnonzero(bits > 0)
        self.m = len(open_at)
        self.depth = excess[open_at] - 1
        self.item = np.repeat(np.arange(n), opened)  # that opened the node
        close = find_close(excess, open_at)
        #: Opening parentheses up to the place where a node closes: its subtree is the nodes from its own number to this one.
        self.end = np.cumsum(bits > 0)[close]
        # The node of every place (item, depth): the one opened last at this depth.
        depth_of = np.arange(self.at[-1]) - np.repeat(self.at[:-1], k + 1)
        item_of = np.repeat(np.arange(n), k + 1)
        first_new = np.cumsum(opened) - opened
        lowest = common + 1
        lowest[0] = 0
        fresh = depth_of >= lowest[item_of]
        by_depth = np.argsort(depth_of, kind="stable")
        number = (first_new[item_of] + depth_of - lowest[item_of])[by_depth]
        self.node = np.empty(len(depth_of), np.int64)
        self.node[by_depth] = number[np.maximum.accumulate(np.where(fresh[by_depth], np.arange(len(by_depth)), 0))]
        self.parent = np.where(self.depth > 0, self.node[np.maximum(self.at[self.item] + self.depth - 1, 0)], -1)
        self.words = np.where(self.depth > 0, items.words[np.maximum(self.off[self.item] + self.depth - 1, 0)] if len(items.words) else 0, 0)
        self.spine = np.zeros(self.m, bool)
        if not last:
            self.spine[self.path(0)] = True
            self.spine[self.path(n - 1)] = True
        own = {}
        for name in _SUMS:
            own[name] = np.zeros(self.m, np.int64)
            np.add.at(own[name], self.node, items.values[name])
        self.least = np.full(self.m, NOBODY)
        np.minimum.at(self.least, self.node, items.values["least"])
        for same in reversed(np.split(np.argsort(self.depth, kind="stable"), np.cumsum(np.bincount(self.depth))[:-1])[1:]):
            np.minimum.at(self.least, self.parent[same], self.least[same])
        inner = ~self.spine
        self.kids = own["kids"] + np.bincount(self.parent[1:], minlength=self.m)
        self.n_convs = self._below(own["members"])
        leaf = (bits[open_at + 1] < 0) & (own["kids"] == 0)
        self.n_leaves = self._below(own["leaves"] + (leaf & inner))
        self.saved = self._below(own["saved"] + np.where(inner, (self.n_convs - 1) * self.words, 0))
        #: Children that stand in this shard alone, with those known from earlier rounds.
        self.inner_kids = own["kids"] + np.bincount(self.parent[1:][inner[1:]], minlength=self.m)

    def _common(self) -> np.ndarray:
        """Turns that each item shares with the one before; 0 for the first."""
        k, keys = self.items.k, self.items.keys
        least = np.minimum(k, np.concatenate([[0], k[:-1]]))
        item = np.repeat(np.arange(len(k)), least)
        d = np.arange(len(item)) - np.repeat(np.cumsum(least) - least, least)
        other = (keys[self.off[item] + d] != keys[self.off[np.maximum(item - 1, 0)] + d]).any(axis=1)
        first = np.flatnonzero(other)[::-1]
        least[item[first]] = d[first]  # the first difference is written last
        return least

    def _below(self, values: np.ndarray) -> np.ndarray:
        """Sums over the subtrees."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.end] - total[:-1]

    def path(self, i: int) -> np.ndarray:
        return self.node[self.at[i]:self.at[i + 1]]

    def turn_keys(self, i: int) -> np.ndarray:
        return self.items.keys[self.off[i]:self.off[i + 1]]

    def name_path(self, i: int) -> list[bytes]:
        """Names of the nodes on a path, root first: the same in every shard."""
        names = [bytes(KEY_BYTES)]
        for turn in self.turn_keys(i):
            names.append(hashlib.blake2b(names[-1] + turn.tobytes(), digest_size=KEY_BYTES).digest())
        return names

    def own_sums(self, nodes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """``values`` of subtrees without those of children on a spine."""
        rest = values.copy()
        lower = np.flatnonzero(self.spine & (self.parent >= 0))
        np.subtract.at(rest, self.parent[lower], values[lower])
        return rest[nodes]

    def spines(self) -> list[dict]:
        """One or two items of the next round. What hangs at a node on both paths goes with the first."""
        out, done = [], np.zeros(self.m, bool)
        for i in dict.fromkeys((0, len(self.items.k) - 1)):
            nodes = self.path(i)
            if done[nodes].all():
                continue
            fresh = ~done[nodes]
            sums = {"members": self.own_sums(nodes, self.n_convs), "leaves": self.own_sums(nodes, self.n_leaves), "saved": self.own_sums(nodes, self.saved), "kids": self.inner_kids[nodes]}
            out.append({"path": self.turn_keys(i).tobytes(), "words": self.items.words[self.off[i]:self.off[i + 1]].tolist(), "least": np.where(fresh, self.least[nodes], NOBODY).tolist(),
                        **{name: np.where(fresh, v, 0).tolist() for name, v in sums.items()}})
            done[nodes] = True
        return out

    def ends(self) -> Iterator[tuple[int, int, int]]:
        """(node, a, b): items a to b have no turn below the node."""
        last = self.node[self.at[1:] - 1]
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        yield from zip(last[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(last)])


# ------------------------------------------------------------------ rounds


def _batches(columns: dict, n: int) -> pa.RecordBatch:
    nothing = {"kind": pa.string(), "shard": pa.int64(), "key": pa.binary(), "parent_key": pa.binary(), "depth": pa.int64(), "conv_id": pa.int64(), "parent_conv_id": pa.int64(),
               "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends": pa.string(), "path": pa.binary(),
               **{c: pa.list_(pa.int64()) for c in ("words", *_SUMS, "least")}}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in nothing.items()], list(nothing))


def _shard_rows(shard: Shard, number: int, first_round: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """What a shard tells: its finished nodes, its spines, the names on them and, in the first round, the conversations that end there."""
    items = shard.items
    inner = np.flatnonzero(~shard.spine)
    names: dict[int, bytes] = {}
    for i in dict.fromkeys((0, len(items.k) - 1)):
        names.update(zip(shard.path(i).tolist(), shard.name_path(i)))
    if not first_round:  # few nodes: each has its name
        for v in range(shard.m):
            if v not in names:
                turn = items.keys[shard.off[shard.item[v]] + shard.depth[v] - 1]
                names[v] = hashlib.blake2b(names[int(shard.parent[v])] + turn.tobytes(), digest_size=KEY_BYTES).digest()
    spine = set(np.flatnonzero(shard.spine).tolist())
    ends: dict[int, str] = {}
    if first_round:
        for v, a, b in shard.ends():
            said = ",".join(map(str, items.conv_id[a:b].tolist()))
            if v in spine:
                yield _batches({"kind": ["ends"], "key": [names[v]], "conv_id": [int(items.conv_id[a])], "ends": [said]}, 1)
            else:
                ends[v] = hashlib.sha256(said.encode()).hexdigest()
    for a in range(0, len(inner), 4096):
        own = inner[a:a + 4096]
        parent = shard.parent[own].tolist()
        told = {
            "kind": ["node"] * len(own), "shard": [number] * len(own), "depth": shard.depth[own], "conv_id": shard.least[own],
            "parent_key": [names[p] if p in spine else None for p in parent], "parent_conv_id": [None if p < 0 or p in spine else int(shard.least[p]) for p in parent],
            "n_convs": shard.n_convs[own], "n_children": shard.kids[own], "n_leaves": shard.n_leaves[own], "saved_tokens": shard.saved[own]}
        more = {"ends": [ends.get(v, NO_ENDS) for v in own.tolist()]} if first_round else {"key": [names[v] for v in own.tolist()]}
        yield _batches(told | more, len(own))
    if last:
        return
    for item in shard.spines():
        yield _batches({"kind": ["item"], **{c: [v] for c, v in item.items()}}, 1)
    yield _batches({"kind": ["spine"] * len(spine), "shard": [number] * len(spine), "key": [names[v] for v in spine]}, len(spine))


def _round(sorted_rows: DataFrame, first_round: bool, last: bool, shard_turns: int, least_paths: int) -> DataFrame:
    columns = ["conv_id", "path", "words"] if first_round else ["path", "words", *_SUMS, "least"]

    def gathered(parts: list[pa.RecordBatch]) -> Items:
        whole = pa.Table.from_batches(parts).combine_chunks()

        def flat(name: str) -> np.ndarray:
            return whole.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)

        joined = b"".join(whole.column("path").to_pylist())
        k = np.array([len(p) for p in whole.column("path").to_pylist()], np.int64) // KEY_BYTES
        keys = np.frombuffer(joined, np.uint64).reshape(-1, 2)
        if not first_round:
            return Items(k, keys, flat("words"), {c: flat(c) for c in (*_SUMS, "least")})
        conv, ends = whole.column("conv_id").to_numpy(), np.cumsum(k + 1) - 1
        values = {c: np.zeros(int((k + 1).sum()), np.int64) for c in _SUMS}
        values["members"][ends] = 1
        values["least"] = np.full(len(values["members"]), NOBODY)
        values["least"][ends] = conv
        return Items(k, keys, flat("words"), values, conv)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        waiting: list[pa.RecordBatch] = []
        turns = paths = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            size = np.array([len(p) // KEY_BYTES for p in batch.column("path").to_pylist()], np.int64)
            a = 0
            for b in range(1, batch.num_rows + 1):
                turns += int(size[b - 1])
                paths += 1
                if not last and turns >= shard_turns and paths >= least_paths:
                    yield from _shard_rows(Shard(gathered([*waiting, batch.slice(a, b - a)]), last), number, first_round, last)
                    number, waiting, turns, paths, a = number + 1, [], 0, 0, b
            if a < batch.num_rows:
                waiting.append(batch.slice(a))
        if waiting:
            yield from _shard_rows(Shard(gathered(waiting), last), number, first_round, last)

    return sorted_rows.select(*columns).mapInArrow(run, _OUT)


def _digest_pieces(pieces: DataFrame) -> DataFrame:
    """(key, ends): the digest of all ids that end at a node, whose pieces come in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: tuple[list, list] = ([], [])
        for batch in batches:
            for own, said in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if own != key:
                    if key is not None:
                        done[0].append(key)
                        done[1].append(state.hexdigest())
                    key, state = own, hashlib.sha256(said.encode())
                else:
                    state.update(b"," + said.encode())
        if key is not None:
            done[0].append(key)
            done[1].append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "ends"])

    return pieces.select("key", "conv_id", "ends").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(run, "key binary, ends string")


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS, least_paths: int = LEAST_PATHS, last_turns: int = LAST_TURNS) -> DataFrame:
    """One row for each node of the trie over ``paths`` (conv_id, path, words), the root included:
    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the smallest member; a node's savings are the words of its last turn times its members but one. Each conversation stands
    once. No conversations give no rows. A conversation without turns is a member of the root alone. A sequence or prefix that a third of
    all conversations share is spread over shards, since equal sequences are split by conv_id; what one task holds is a shard, which
    follows the longest ``least_paths`` conversations.
    """
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    shown = [*columns, F.col("ends").alias("ends_sha256")]
    rows, rounds, order = cut(paths), [], ["path", "conv_id"]
    while True:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("turns")).first()
        limit = last_turns if rounds else shard_turns
        last = size.turns + size.n <= limit
        if last:
            dealt = rows.coalesce(1)
        elif rounds:
            # So few ranges that each has the paths of several shards; a shard then has ever more paths, so the spines get fewer in each round.
            least_paths *= 2
            dealt = rows.repartitionByRange(max(1, min(-(-size.turns // shard_turns), size.n // (4 * least_paths))), *order)
        else:
            dealt = rows.repartitionByRange(*order)
        out = cut(_round(small_batches(dealt.sortWithinPartitions(*order)), not rounds, last, shard_turns, least_paths))
        rounds.append(out)
        if last:
            break
        rows = cut(out.filter("kind = 'item'").select("path", "words", *_SUMS, "least"))
        order = ["path"]
    nodes = [r.filter("kind = 'node'") for r in rounds]
    if len(rounds) == 1:
        return nodes[0].select(*shown)
    upper = cut(reduce(DataFrame.unionByName, [n.select("key", "parent_key", *columns) for n in nodes[1:]]))
    known = upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    with_parent = upper.join(known, "parent_key", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up"))
    ended = _digest_pieces(rounds[0].filter("kind = 'ends'"))
    merged = with_parent.join(ended, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(NO_ENDS))).select(*shown)
    # A shard's nodes look up their spine by shard and name, so the children of a hot prefix do not meet in one task.
    spine = rounds[0].filter("kind = 'spine'").select("shard", F.col("key").alias("parent_key")).join(known, "parent_key")
    below = nodes[0].filter(F.col("parent_key").isNotNull()).join(cut(spine), ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("up")).select(*shown)
    rest = nodes[0].filter(F.col("parent_key").isNull()).select(*shown)
    drop_cut(rows)
    return rest.unionByName(below).unionByName(merged)
