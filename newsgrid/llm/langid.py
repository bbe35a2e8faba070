"""Language identification by interpolated Kneser-Ney character models.

Texts become symbols: a-z, other letters folded to a few classes, and one separator between words. Every language has a model of
three orders, stored as sorted arrays of n-gram hashes with log probabilities; the language with the lowest cross-entropy for each
symbol is chosen. A text that fits its best language far worse than the calibration texts did is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches, text_bytes

UNKNOWN = "und"
#: Symbols: 0 separates words, 1-26 are a-z, other letters share the rest by their code point. A trigram hash has 24 bits, so
#: no language's model can exceed 2**24 entries, however large the corpus.
SYMBOLS = 256
DISCOUNT = 0.75
#: Symbols of a text, at most, that its weight in the calibration grows with.
WEIGHT = 200
#: Rows of the mean noise of all languages that join each language's own, so a language of few rows keeps its slack.
PRIOR_ROWS = 10
#: A text is rejected if its cross-entropy in its best language lies beyond this share of the way from that language's own texts to
#: texts of other languages. A text half in another language lies at 0.5 at most, and stays.
REACH = 0.65
#: Slopes of the score that are tried.
SLOPES = np.geomspace(0.1, 50.0, 60)

def symbol_table() -> np.ndarray:
    """Symbol of every code point: that of its lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if chr(point).isalpha():
            low = ord(chr(point).lower()[0])
            out[point] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return out


def _points(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and the offsets of the texts among them."""
    whole = flat.tobytes()
    try:
        points = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no UTF-8 are replaced, text by text
        each = [np.frombuffer(whole[a:b].decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])
    return points, np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80, dtype=np.int64)])[at]


def _word_symbols(points: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbol of each code point. Words that hold a digit (keys, hashes, part numbers) say nothing about a language and count as
    separators, except in a text that has no other word."""
    sym = table[points]
    digit = (points >= 0x30) & (points <= 0x39)
    if not digit.any():
        return sym
    part = (sym > 0) | digit
    first = part.copy()
    first[1:] &= ~part[:-1]
    heads = starts[:-1][starts[:-1] < len(points)]
    first[heads] = part[heads]
    run = np.cumsum(first) - 1
    coded = np.zeros(run[-1] + 1, bool)
    coded[run[digit]] = True
    drop = (sym > 0) & coded[run]
    left = np.concatenate([[0], np.cumsum((sym > 0) & ~drop, dtype=np.int64)])
    none_left = np.repeat(left[starts[1:]] == left[starts[:-1]], np.diff(starts))
    return np.where(drop & ~none_left, np.uint8(0), sym)


def trigram_codes(column: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram hashes of all texts in a row, and how many each text has: one for each letter and one for the end of each word.
    Runs of other characters are one separator; two separators stand before a text. A text without a letter has none."""
    points, starts = _points(*text_bytes(column))
    n = len(starts) - 1
    # A separator before each text and one after the last; of a run of separators only the first is kept.
    sym = np.zeros(len(points) + n + 1, np.uint8)
    sym[np.arange(len(points)) + np.repeat(np.arange(n), np.diff(starts)) + 1] = _word_symbols(points, starts, table)
    bounds = starts + np.arange(n + 1)
    keep = sym > 0
    keep[1:] |= sym[:-1] > 0
    keep[bounds] = True
    at = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])[bounds]
    s = sym[keep].astype(np.int32)
    first = np.zeros(len(s), bool)
    first[at] = True
    two, three = np.zeros_like(s), np.zeros_like(s)
    two[1:], three[2:] = s[:-1], s[:-2]
    three[1:][first[:-1]] = 0  # nothing of the text before
    use = (s > 0) | (two > 0)
    # The separator that ends a text is the one before the next text; its trigram belongs to the text that it ends.
    place = np.concatenate([[0], np.cumsum(use, dtype=np.int64)])[at] + use[at]
    return (three << 16 | two << 8 | s)[use], np.diff(place)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, code, n): trigram counts over all texts of each language."""
    table = docs.sparkSession.sparkContext.broadcast(symbol_table())  # one byte for each code point

    def merged(seen: list[np.ndarray], n: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        keys, at = np.unique(np.concatenate(seen), return_inverse=True)
        return [keys], [np.bincount(at, np.concatenate(n)).astype(np.int64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        seen, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in slices(batches):
            code, size = trigram_codes(batch.column("text"), table.value)
            lang = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
            keys, counts = np.unique(np.repeat(lang, size) << 24 | code, return_counts=True)
            seen.append(keys)
            n.append(counts.astype(np.int64))
            if len(seen) > 32:
                seen, n = merged(seen, n)
        seen, n = merged(seen, n)
        label = pa.array(list(names), pa.string()).take(pa.array(seen[0] >> 24))
        yield pa.RecordBatch.from_arrays([label, pa.array((seen[0] & 0xFFFFFF).astype(np.int32)), pa.array(n[0])], ["lang", "code", "n"])

    return small_batches(docs).filter(F.col("lang").isNotNull()).select("text", "lang").mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class KneserNey:
    """One language's model: for each order sorted hashes with what the formula needs."""

    tri: np.ndarray
    tri_share: np.ndarray
    tri_context: np.ndarray
    tri_rest: np.ndarray
    bi: np.ndarray
    bi_share: np.ndarray
    bi_context: np.ndarray
    bi_rest: np.ndarray
    uni: np.ndarray

    @classmethod
    def fit(cls, code: np.ndarray, n: np.ndarray, discount: float = DISCOUNT) -> KneserNey:
        """From sorted distinct trigram hashes and their counts. Lower orders count the distinct contexts of a symbol."""
        context, at = np.unique(code >> 8, return_inverse=True)
        total = np.bincount(at, n)
        share, rest = np.maximum(n - discount, 0) / total[at], discount * np.bincount(at) / total
        bi, before = np.unique(code & 0xFFFF, return_counts=True)
        bi_context, bi_at = np.unique(bi >> 8, return_inverse=True)
        bi_total = np.bincount(bi_at, before)
        bi_share, bi_rest = np.maximum(before - discount, 0) / bi_total[bi_at], discount * np.bincount(bi_at) / bi_total
        kinds = np.bincount(bi & 0xFF, minlength=SYMBOLS)
        uni = np.maximum(kinds - discount, 0) / len(bi) + discount * np.count_nonzero(kinds) / len(bi) / SYMBOLS
        return cls(code, share, context, rest, bi, bi_share, bi_context, bi_rest, uni)

    def log_prob(self, code: np.ndarray) -> np.ndarray:
        low = _find(self.bi, self.bi_share, code & 0xFFFF, 0.0) + _find(self.bi_context, self.bi_rest, code >> 8 & 0xFF, 1.0) * self.uni[code & 0xFF]
        return np.log(_find(self.tri, self.tri_share, code, 0.0) + _find(self.tri_context, self.tri_rest, code >> 8, 1.0) * low)


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


@dataclass
class Model:
    names: list[str]
    languages: list[KneserNey]
    #: Calibration: slope of the score; for each language the mean cross-entropy of its own texts and of all others, and
    #: the variance of a single symbol.
    slope: float
    own: np.ndarray
    foreign: np.ndarray
    noise: np.ndarray
    symbols: np.ndarray

    def pack(self) -> dict:
        """Plain arrays, which tasks can read without this module; :meth:`unpack` is the inverse."""
        return vars(self) | {"languages": [vars(x) for x in self.languages]}

    @classmethod
    def unpack(cls, packed: dict) -> Model:
        return cls(**packed | {"languages": [KneserNey(**x) for x in packed["languages"]]})

    def place(self) -> np.ndarray:
        """Scratch table from trigram hash to row, made once in each task."""
        if "_place" not in self.__dict__:
            self.__dict__["_place"] = np.zeros(1 << 24, np.int32)
        return self.__dict__["_place"]

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text (rows) in each language (columns), and the number of symbols."""
        code, size = trigram_codes(column, self.symbols)
        out = np.zeros((len(size), len(self.names)))
        some = size > 0
        if not some.any():
            return out, size
        kinds = np.unique(code)
        place = self.place()
        place[kinds] = np.arange(len(kinds))
        index, starts = place[code], (np.cumsum(size) - size)[some]
        for i, language in enumerate(self.languages):
            out[some, i] = -np.add.reduceat(language.log_prob(kinds)[index], starts) / size[some]
        return out, size

    def excess(self, entropy: np.ndarray, size: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Where the cross-entropy lies on the way from the language's own texts (0) to the limit (1); short texts vary more."""
        return (entropy - self.own[best] - 3 * np.sqrt(self.noise[best] / np.maximum(size, 1))) / (REACH * (self.foreign[best] - self.own[best]))

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text. Equal cross-entropies: the first language by name."""
        entropy, size = self.entropies(column)
        rows = np.arange(len(size))
        if not self.names:
            return [UNKNOWN] * len(size), np.zeros(len(size)), np.ones(len(size), bool)
        best = entropy.argmin(axis=1)
        least = entropy[rows, best]
        others = np.where(np.arange(len(self.names)) == best[:, None], np.inf, entropy)
        gap = np.minimum(others.min(axis=1) - least, 50.0) * np.sqrt(size)
        ratio = self.excess(least, size, best)
        fit = 1 / (1 + np.exp(np.clip(8 * (ratio - 1), -500, 500)))
        score = np.where(size > 0, fit / (1 + np.exp(-np.clip(self.slope * gap, 0, 500))), 0.0)
        return [self.names[b] if s else UNKNOWN for b, s in zip(best.tolist(), size.tolist())], score, (size == 0) | (ratio > 1)


def _remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def held_out(doc_id: Column) -> Column:
    """Rows that the models never learn from: crc32 of the id modulo 3 is 1."""
    return _remainder(doc_id, 3) == 1


def train(docs: DataFrame, discount: float = DISCOUNT) -> Model:
    """Models from all rows of ``docs`` (doc_id, text, lang) with a lang that are not held out. Counts and
    calibration cover every one of these texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(
        F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    grams = cut(counts(rows)).toPandas()  # at most 2**24 short rows for each language
    names = sorted(grams["lang"].unique().tolist(), key=lambda x: x.encode())
    languages = []
    for name in names:
        own = grams[grams["lang"] == name].sort_values("code")
        languages.append(KneserNey.fit(own["code"].to_numpy(np.int64), own["n"].to_numpy(np.float64), discount))
    k = len(names)
    model = Model(names, languages, 1.0, np.zeros(k), np.full(k, np.inf), np.ones(k), symbol_table())
    if not names:
        return model
    shared = spark.sparkContext.broadcast(model.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.unpack(shared.value)
        place = {name: i for i, name in enumerate(model.names)}
        sums = np.zeros((k, 3 + k + len(SLOPES)))
        for batch in slices(batches):
            entropy, size = model.entropies(batch.column("text"))
            some = size > 0  # a text with a symbol has a model of its language
            true = np.array([place.get(x, 0) for x in batch.column("lang").to_pylist()], np.int64)
            sums += calibration_sums(true[some], size[some].astype(np.float64), entropy[some])
        lang, part = np.divmod(np.arange(sums.size), sums.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(part), pa.array(sums.ravel())], ["lang", "part", "value"])

    parts = small_batches(rows).select("text", "lang").mapInArrow(run, "lang long, part long, value double").groupBy("lang", "part").agg(F.sum("value").alias("value")).toPandas()
    sums = np.zeros((k, 3 + k + len(SLOPES)))
    sums[parts["lang"], parts["part"]] = parts["value"]
    return calibrate(model, sums)


def calibration_sums(true: np.ndarray, size: np.ndarray, entropy: np.ndarray) -> np.ndarray:
    """What the calibration needs of some texts, summed for each true language (rows): the texts, their weights, the weighted squares of their
    cross-entropy in their own language, the weighted cross-entropies in every language, and the loss of each slope."""
    rows, k = np.arange(len(true)), entropy.shape[1]
    own, weight = entropy[rows, true], np.minimum(size, WEIGHT)
    loss = np.zeros((len(true), len(SLOPES)))
    if k > 1:
        others = np.where(np.arange(k) == true[:, None], np.inf, entropy).min(axis=1)
        loss = np.logaddexp(0, -np.outer((others - own) * np.sqrt(size), SLOPES))
    out = np.zeros((k, 3 + k + len(SLOPES)))
    np.add.at(out, true, np.column_stack([np.ones(len(true)), weight, weight * own**2, entropy * weight[:, None], loss]))
    return out


def calibrate(model: Model, sums: np.ndarray) -> Model:
    """Sets the slope of the score, by maximum likelihood of the true languages, and the limits of the rejection, from the sums of
    :func:`calibration_sums` over all texts. They are rounded, as the order of the sums is not fixed."""
    k = len(model.names)
    count, weight, squares, first = sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 3:3 + k]
    if k > 1:
        model.slope = float(SLOPES[np.argmin(sums[:, 3 + k:].sum(axis=0))])
    own = np.diag(first) / weight
    spread = np.maximum(squares - weight * own**2, 0)
    model.own = own.round(9)
    model.noise = ((spread + PRIOR_ROWS * spread.sum() / count.sum()) / (count + PRIOR_ROWS)).round(9)
    others = ~np.eye(k, dtype=bool)
    foreign = (first * others).sum(axis=0) / (others @ weight) if k > 1 else np.full(k, np.log(SYMBOLS))
    model.foreign = np.maximum(foreign, own + 0.1).round(9)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text).

    ``lang_pred`` is the learned language with the lowest cross-entropy, or ``und`` for a null text or one without a letter, whose score is
    0. ``rejected`` marks these and texts that fit no language. Repeated rows come back as often as they came; with no model all is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.unpack(shared.value)
        for batch in slices(batches):
            names, score, rejected = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all its columns, without the rejected rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model.pack())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.unpack(shared.value)
        for batch in slices(batches):
            _, _, rejected = model.predict(batch.column("text"))
            yield batch.filter(pa.array(~rejected))

    return small_batches(docs).mapInArrow(run, docs.schema)
