"""Token counts of a unigram model by dynamic programming over a trie.

The distinct pre-tokens of a slice of texts are put in a trie. The best score of a prefix depends on the prefix alone, so it is computed
once for each node, level by level for all nodes together; the node where a pre-token ends holds its token count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, text_list

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Stands before a pre-token, as in the vocabulary.
MARK = "▁"
#: Pre-tokens above this length are scored one by one; those below share the trie.
TRIE_CHARS = 40
#: Pre-tokens whose counts a task remembers.
REMEMBERED = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    """Pieces with log probabilities. Pieces of the file carry merge ranks only, so a piece's probability follows Zipf's law in its rank."""

    pieces: dict[str, float]
    unknown: float

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        weight = 1.0 / (np.arange(len(texts)) + 2.7)
        score = np.log(weight / weight.sum())
        return cls(dict(zip(texts, score.tolist())), float(score.min() - 10.0))


def best_count(word: str, vocabulary: Vocabulary, longest: int) -> int:
    """Tokens of one pre-token: the pieces of its best segmentation; a character in no piece costs one token for each UTF-8
    byte. Equal scores: fewer tokens."""
    best = [(0.0, 0)] + [(-np.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode("utf-8", "replace"))
        found = (best[end - 1][0] + vocabulary.unknown * width, best[end - 1][1] + width)
        for start in range(max(0, end - longest), end):
            score = vocabulary.pieces.get(word[start:end])
            if score is not None:
                mine = (best[start][0] + score, best[start][1] + 1)
                if mine[0] > found[0] or mine[0] == found[0] and mine[1] < found[1]:
                    found = mine
        best[end] = found
    return best[-1][1]


class Trie:
    """Scores many pre-tokens at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary.pieces), default=1)
        self.powers = np.ones(TRIE_CHARS + 1, np.uint64)
        self.powers[1:] = np.cumprod(np.full(TRIE_CHARS, _BASE, np.uint64))  # modulo 2**64
        #: For each length, sorted hashes of the pieces and their scores.
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_length: dict[int, list[str]] = {}
        for p in vocabulary.pieces:
            by_length.setdefault(len(p), []).append(p)
        for length, own in by_length.items():
            if length <= TRIE_CHARS:
                points = np.array([[ord(c) for c in p] for p in own], np.uint64)
                h = np.zeros(len(own), np.uint64)
                for i in range(length):
                    h = h * _BASE + points[:, i] + np.uint64(1)
                order = np.argsort(h)
                self.tables[length] = h[order], np.array([vocabulary.pieces[p] for p in own])[order]

    def counts(self, words: list[str]) -> np.ndarray:
        """Token count of each of the distinct pre-tokens ``words``."""
        out = np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words], np.int64)
        for i in np.flatnonzero(size > TRIE_CHARS).tolist():
            out[i] = best_count(words[i], self.vocabulary, self.longest)
        short = np.flatnonzero((size <= TRIE_CHARS) & (size > 0))
        if not len(short):
            return out
        own = sorted((words[i], i) for i in short.tolist())
        place = np.array([i for _, i in own])
        n, size = len(own), size[place]
        depth = int(size.max())
        points = np.array([w for w, _ in own], f"U{depth}").view(np.uint32).reshape(n, depth).astype(np.uint64)
        # A word that ends in NUL characters would lose them in the fixed-width form; its length is known apart.
        same = (points[1:] == points[:-1]).cumprod(axis=1).sum(axis=1) if n > 1 else np.zeros(0, np.int64)
        shared = np.concatenate([[0], np.minimum(same, np.minimum(size[1:], size[:-1]))])
        # node[d][row]: the number, on level d, of the row's prefix of d characters; heads[d]: the first row of each node.
        hashes = [np.zeros(n, np.uint64)]
        node, best, tokens = [np.zeros(n, np.int64)], [np.zeros(1)], [np.zeros(1, np.int64)]
        for d in range(1, depth + 1):
            hashes.append(hashes[-1] * _BASE + points[:, d - 1] + np.uint64(1))
            alive = size >= d
            # A node begins where the prefix changes; rows too short for this level stand before their longer followers.
            fresh = alive & ((shared < d) | np.concatenate([[True], ~alive[:-1]]))
            number = np.cumsum(fresh) - 1
            node.append(np.where(alive, number, 0))
            head = np.flatnonzero(fresh)
            last = points[head, d - 1]
            width = 1 + (last >= 0x80).astype(np.int64) + (last >= 0x800) + (last >= 0x10000)
            before = node[d - 1][head]
            score = best[d - 1][before] + self.vocabulary.unknown * width
            count = tokens[d - 1][before] + width
            for length, (keys, values) in sorted(self.tables.items(), reverse=True):
                if length > d:
                    continue
                h = hashes[d][head] - hashes[d - length][head] * self.powers[length]
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ok = np.flatnonzero(keys[at] == h)
                if not len(ok):
                    continue
                start = node[d - length][head[ok]]
                mine, number_of = best[d - length][start] + values[at[ok]], tokens[d - length][start] + 1
                better = (mine > score[ok]) | (mine == score[ok]) & (number_of < count[ok])
                score[ok[better]], count[ok[better]] = mine[better], number_of[better]
            best.append(score)
            tokens.append(count)
        result = np.zeros(n, np.int64)
        for d in range(1, depth + 1):
            ends = size == d
            result[ends] = tokens[d][node[d][ends]]
        out[place] = result
        return out


def count_tokens(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of ``docs`` (doc_id, text): pre-tokens are the runs without ASCII white space. A null or
    empty text has none. Repeated rows come back as often as they came; an empty table gives no rows."""
    known = vocabulary or Vocabulary.load()
    shared = docs.sparkSession.sparkContext.broadcast((known.pieces, known.unknown))  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(Vocabulary(*shared.value))
        memory: dict[bytes, int] = {}
        for batch in slices(batches):
            words, counts = [], []
            for text in text_list(batch.column("text")):
                own = text.split()
                words += own
                counts.append(len(own))
            n = np.array(counts, np.int64)
            if words:
                coded = pa.array(words, pa.large_binary()).dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                fresh = [w for w in distinct if w not in memory]
                if len(memory) + len(fresh) > REMEMBERED:
                    memory.clear()
                    fresh = distinct
                memory.update(zip(fresh, trie.counts([MARK + w.decode("utf-8", "replace") for w in fresh]).tolist()))
                each = np.fromiter((memory[w] for w in distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
                sums = np.concatenate([[0], np.cumsum(each)])
                ends = np.cumsum(n)
                total = sums[ends] - sums[ends - n]
            else:
                total = np.zeros(len(n), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(total)], ["doc_id", "n_words", "n_tokens"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
