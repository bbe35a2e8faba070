"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text are rates: words of a fixed and of a learned lexicon, second-person words near them, capitals,
punctuation, and disguised spellings. Trees are fitted on one part of the labelled rows, the isotonic curve on another.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches, text_bytes, text_list

# Insults and second-person words of the four languages of the corpus, lower case.
INSULTS = """
idiot idiots stupid moron morons loser losers scum trash worthless pathetic disgusting clown dumb dumbass fool filthy garbage ugly
vermin bastard bitch bullshit crap asshole jerk creep freak imbecile retard shit fuck fucking hate kill die shut
dumm dummkopf arschloch scheisse scheiße blöd blödmann trottel abschaum müll wertlos erbärmlich ekelhaft widerlich hässlich verpiss
imbécile crétin connard salaud merde stupide débile ordure déchet minable dégoûtant pathétique nul idiote
estúpido idiota imbécil basura mierda inútil patético asqueroso payaso tonto cabrón escoria perdedor
""".split()
SECOND_PERSON = """
you your yours yourself u ur youre du dich dir dein deine euch ihr bist tu toi te ton ta vous votre es usted ustedes tú ti eres
""".split()

#: Labelled rows, at most, for the learned lexicon and for the trees and the curve; those with the smallest hash of their id.
LABEL_ROWS = 50_000
#: Words of the learned lexicon, at most; each stands in this many toxic texts and is this many times likelier there.
LEXICON_WORDS = 1000
LEAST_TEXTS = 10
LEAST_ODDS = 8.0
NEAR = 5
TREES, DEPTH, STEP = 20, 3, 0.3

NAMES = ["lexicon", "lexicon_count", "learned", "learned_count", "disguised", "near_second_person", "second_person", "capitals", "shouting", "exclamation", "punctuation", "digits", "obfuscation", "length"]

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Letters that digits and signs stand for.
_LEET = bytes.maketrans(b"013457@$!|+", b"oieastasilt")
_MIXED = re.compile(rb"[A-Za-z][0-9@$!|+*_-]+[A-Za-z]")
_SPACED = re.compile(rb"\b(?:[A-Za-z][ .*_-]){3,}[A-Za-z]\b")
_SHOUT = re.compile(rb"\b[A-Z]{3,}\b")
_LETTERS = re.compile(rb"[^a-z\x80-\xff]+")
_BLANK = b" \t\n\x0b\x0c\r"
_BLANKS = re.compile(rb"[ \t\n\x0b\x0c\r]")
_APART = re.compile(rb"[^0-9A-Za-z\x80-\xff@$!|+*_-]+")


def _lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()


def split_words(text: bytes) -> list[bytes]:
    """The words of a text in lower case, of any script."""
    return _lower(text).translate(_WORDS).split()


def _plain(piece: bytes) -> bytes:
    """A disguised word as letters only."""
    return _LETTERS.sub(b"", _lower(piece).translate(_LEET))


def _disguised(text: bytes, lexicon: frozenset[bytes]) -> tuple[int, int]:
    """Disguised spellings in a text, and how many of them are words of the lexicon."""
    def hit(piece: bytes) -> bool:
        return _plain(piece) in lexicon or _LETTERS.sub(b"", _lower(piece)) in lexicon

    pieces, last = [], 0  # whole runs without white space; last is the end of the run seen before
    for m in _MIXED.finditer(text):
        if m.start() >= last:
            low = m.start()
            while low > last and text[low - 1] not in _BLANK:
                low -= 1
            blank = _BLANKS.search(text, m.end())
            last = blank.start() if blank else len(text)
            pieces.append(text[low:last])
    spaced = [m[0] for m in _SPACED.finditer(text)]
    # In a run, disguised words may also stand apart by signs that stand for no letter.
    parted = [sum(hit(w) for w in _APART.split(p) if _MIXED.search(w)) for p in pieces]
    return len(pieces) + len(spaced), sum(n or hit(p) for n, p in zip(parted, pieces)) + sum(map(hit, spaced))


def feature_rows(column: pa.Array, learned: frozenset[bytes]) -> np.ndarray:
    """The features of each text, in the order of NAMES. A null or empty text has zeros."""
    flat, at = text_bytes(column)
    texts = text_list(column)
    insults, second = frozenset(w.encode() for w in INSULTS), frozenset(w.encode() for w in SECOND_PERSON)

    def total(mark: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    upper = (flat >= 0x41) & (flat <= 0x5A)
    letters = upper | (flat >= 0x61) & (flat <= 0x7A) | (flat >= 0xC0)
    digit = (flat >= 0x30) & (flat <= 0x39)
    sign = (flat > 0x20) & (flat < 0x7F) & ~letters & ~digit
    out = np.zeros((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        words = split_words(text)
        if not words:
            continue
        n = len(words)
        hits = [k for k, w in enumerate(words) if w in insults]
        taught = sum(w in learned for w in words)
        near = sum(any(w in second for w in words[max(0, k - NEAR):k + NEAR + 1]) for k in hits)
        odd, hidden = _disguised(text, insults | learned)
        out[i] = (len(hits) / n, math.log1p(len(hits)), taught / n, math.log1p(taught), hidden / n, near / n, sum(w in second for w in words) / n,
                  0, len(_SHOUT.findall(text)) / n, 0, 0, 0, odd / n, math.log1p(n))
    size = np.maximum(1, at[1:] - at[:-1])
    out[:, NAMES.index("capitals")] = total(upper) / np.maximum(1, total(letters))
    out[:, NAMES.index("exclamation")] = total(flat == 0x21) / size
    out[:, NAMES.index("punctuation")] = total(sign) / size
    out[:, NAMES.index("digits")] = total(digit) / size
    return out


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id modulo 5 is 0."""
    return _fold(doc_id) == 0


def sample_labels(labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """(doc_id, toxic): at most ``rows`` labelled ids that are not held out. A repeated id is toxic if any of its labels is."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    return cut(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))


def learn_lexicon(docs: DataFrame, sample: DataFrame) -> frozenset[bytes]:
    """Words that mark toxic texts: counted over distinct labelled texts, so that copies of one text count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts: dict[tuple[bytes, int], int] = {}
            for text, toxic in zip(text_list(batch.column("text")), batch.column("toxic").to_pylist()):
                for w in set(split_words(text)):
                    counts[w, toxic] = counts.get((w, toxic), 0) + 1
            words, toxic = zip(*counts) if counts else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(toxic, pa.int32()), pa.array(list(counts.values()), pa.int64())], ["word", "toxic", "n"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # at most LABEL_ROWS ids
    texts = texts.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    words = texts.select("text", "toxic").mapInArrow(run, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    size = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    odds = ((F.col("bad") - F.sqrt("bad") + 0.5) / ((size.bad or 0) + 1)) / ((F.col("good") + F.sqrt("good") + 0.5) / ((size.good or 0) + 1))
    best = words.filter(F.col("bad") >= LEAST_TEXTS).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "word").limit(LEXICON_WORDS)
    return frozenset(r.word.encode() for r in best.collect())


def features(docs: DataFrame, learned: frozenset[bytes]) -> DataFrame:
    """(doc_id, features) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = feature_rows(batch.column("text"), learned)
            flat = pa.array(rows.ravel())
            offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "features"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, features array<double>")


def score(docs: DataFrame, labels: DataFrame, label_rows: int = LABEL_ROWS, trees: int = TREES) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text), learnt from ``labels`` (doc_id, toxic) of rows that are not held out.

    The score is the calibrated probability of label 1. Null and empty texts have features of zero and are scored by them. If the labels
    have one class only, every score is its value; without labels it is 0. Repeated rows come back as often as they came.
    """
    sample = sample_labels(labels, label_rows)
    classes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(classes) < 2:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(float(max(classes, default=0))).alias("score"))
    # The rows of the curve must not teach the lexicon, or their chances come out too sure.
    taught = sample.filter(_fold(F.col("doc_id")) < 4)
    table = cut(features(docs, learn_lexicon(docs, taught)))
    known = cut(table.join(F.broadcast(sample), "doc_id").withColumn("fold", _fold(F.col("doc_id"))))
    rows = known.select(array_to_vector("features").alias("features"), F.col("toxic").cast("double").alias("label"), "fold")
    fitting, holding = rows.filter("fold < 4"), rows.filter("fold = 4")
    if fitting.select("label").distinct().count() < 2:
        fitting = holding = rows
    model = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=STEP, seed=7, cacheNodeIds=False).fit(fitting.coalesce(4))

    def chance(frame: DataFrame) -> DataFrame:
        return model.transform(frame).withColumn("chance", F.element_at(vector_to_array("probability"), 2))

    # The curve is fitted on the mean label of at most 1001 steps of the chance, so its size is bounded.
    steps = chance(holding).groupBy(F.round("chance", 3).alias("chance")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    if not steps.isEmpty():
        curve = IsotonicRegression(featuresCol="chance", weightCol="weight", predictionCol="level").fit(steps)
        scored = curve.transform(chance(table.select("doc_id", array_to_vector("features").alias("features"))).drop("prediction"))
    else:
        scored = chance(table.select("doc_id", array_to_vector("features").alias("features"))).withColumn("level", F.col("chance"))
    # Levels are flat in places; a little of the chance keeps the order of the trees there.
    blend = 0.98 * F.col("level") + 0.02 * F.col("chance")
    return scored.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend)).alias("score"))
