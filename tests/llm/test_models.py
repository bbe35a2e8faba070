"""Language identification and toxicity: formulas, held-out accuracy, odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsgrid.llm import langid, toxicity
from newsgrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def plain_codes(text):
    table = langid.symbol_table()
    coded = re.sub("[^0-9]+", lambda m: "".join(c if table[ord(c)] else " " for c in m[0]), text or "")
    kept = re.sub(r"\S*[0-9]\S*", lambda m: " " * len(m[0]), coded)
    sym = [int(table[ord(c)]) for c in (kept if kept.strip() else coded)]
    runs = [s for s, before in zip(sym, [0, *sym]) if s or before]
    if runs and runs[-1]:
        runs.append(0)
    padded = [0, 0, *runs]
    return [a << 16 | b << 8 | c for a, b, c in zip(padded, padded[1:], padded[2:])]


def test_trigrams_equal_plain_loop():
    texts = ["", "Ab c", None, "  ¡Hola, señor!  ", "x", "12 34", "a\nb\nc", "Ünï 👍 çödé", "end", "Ⅷ ß ı", "key AKIA7R7H72 of", "a1b2", "x9 y", "it-5 is", "9", "ab", "7z"]
    code, size = langid.trigram_codes(pa.array(texts), langid.symbol_table())
    assert size.tolist() == [len(plain_codes(t)) for t in texts]
    assert code.tolist() == [c for t in texts for c in plain_codes(t)]


def test_model_is_interpolated_kneser_ney():
    grams = Counter(c for t in ["the cat sat on the mat", "a cat and a hat", "that"] for c in plain_codes(t))
    keys = np.array(sorted(grams))
    model = langid.KneserNey.fit(keys, np.array([grams[k] for k in keys.tolist()], float))
    d = langid.DISCOUNT
    pairs = {k & 0xFFFF for k in grams}

    def p1(w):
        kinds = Counter(b & 0xFF for b in pairs)
        return max(kinds[w] - d, 0) / len(pairs) + d * len(kinds) / len(pairs) / langid.SYMBOLS

    def p2(v, w):
        before = Counter(k & 0xFFFF for k in grams)
        own = {b: n for b, n in before.items() if b >> 8 == v}
        if not own:
            return p1(w)
        total = sum(own.values())
        return max(own.get(v << 8 | w, 0) - d, 0) / total + d * len(own) / total * p1(w)

    def p3(u, v, w):
        own = {k: n for k, n in grams.items() if k >> 8 == u << 8 | v}
        if not own:
            return p2(v, w)
        total = sum(own.values())
        return max(own.get(u << 16 | v << 8 | w, 0) - d, 0) / total + d * len(own) / total * p2(v, w)

    asked = [*grams, 5 << 16 | 6 << 8 | 7, 20 << 8 | 1, 3 << 16 | 1 << 8 | 20, 255 << 16 | 20 << 8 | 255]
    assert np.exp(model.log_prob(np.array(asked))) == pytest.approx([p3(k >> 16, k >> 8 & 255, k & 255) for k in asked])
    assert sum(p3(20, 8, w) for w in range(256)) == pytest.approx(1)


@pytest.fixture(scope="module")
def trained(spark):
    return langid.train(spark.read.parquet(f"{SF}/documents.parquet"))


def test_counts_cover_all_training_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = Counter((r.lang, c) for r in docs.collect() for c in plain_codes(r.text))
    assert {(r.lang, r.code): r.n for r in langid.counts(docs).collect()} == dict(want)


def test_held_out_languages(spark):
    rows = QUERIES["op8_language_id"](spark, SF).collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(true) and {r.doc_id for r in held} == {i for i in true if crc(i) % 3 == 1}
    assert np.mean([r.lang_pred == true[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts_and_rejection(spark, trained, documents, mixed_rows):
    rows = langid.identify(documents(mixed_rows), trained).collect()
    assert len(rows) == len(mixed_rows)
    assert {(r.lang_pred, r.score, r.rejected) for r in rows if r.doc_id in (100, 101, 104, 106)} == {("und", 0.0, True)}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.accepted(docs, trained).count() == docs.count()
    noise = documents([(1, "xqzj wvkk zzqx pqjx wkvz xxqz jjqk qzxv " * 4), (2, docs.first().text), (3, "12 % 34")])
    assert [r.doc_id for r in langid.accepted(noise, trained).collect()] == [2]
    assert langid.accepted(documents([]), trained).columns == docs.columns


def test_calibration_covers_all_rows_of_all_languages(spark, documents):
    rng = np.random.default_rng(5)
    words = {"aa": "alpha beta gamma delta omega".split(), "bb": "uno dos tres cuatro cinco".split(), "rare": "kwik kwak zworg plix".split(), "one": "yttrium ypsilon mylonyx".split()}
    langs = ["rare"] * 4 + ["one"] + ["aa", "bb"] * 3500
    rows = [(i, " ".join(rng.choice(words[x], int(rng.integers(2, 12)))), x) for i, x in zip((i for i in range(20_000) if crc(i) % 3 != 1), langs)]
    model = langid.train(documents(rows))
    entropy, size = langid.Model.unpack(model.pack()).entropies(pa.array([t for _, t, _ in rows]))
    true, weight = np.array([model.names.index(x) for *_, x in rows]), np.minimum(size, 200)
    noise = []
    for i in range(4):
        mine = true == i
        assert model.own[i] == pytest.approx(np.average(entropy[mine, i], weights=weight[mine]))
        assert model.foreign[i] == pytest.approx(np.average(entropy[~mine, i], weights=weight[~mine]))
        noise.append((weight[mine] * (entropy[mine, i] - model.own[i]) ** 2).sum())
    assert model.noise == pytest.approx([(x + langid.PRIOR_ROWS * sum(noise) / len(rows)) / (sum(true == i) + langid.PRIOR_ROWS) for i, x in enumerate(noise)])
    assert model.noise.min() > 0
    kept = langid.accepted(documents([(1, "kwik plix"), (2, "ypsilon mylonyx"), (3, "uno"), (4, "qqq hhh jjj vvv " * 4)]), model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_no_labels(spark, documents):
    empty = langid.train(documents([(1, "some text"), (2, None)]))
    assert {r.lang_pred for r in langid.identify(documents([(1, "some text")]), empty).collect()} == {"und"}
    assert langid.train(documents([])).names == []
    one = langid.train(documents([(i, "some text here", "xx") for i in range(9)]))
    assert {r.lang_pred for r in langid.identify(documents([(1, "some text")]), one).collect()} == {"xx"}


def test_held_out_toxicity(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_toxicity"](spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (crc(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in rows.items())
    held = [(rows[i].score, rows[i].predicted, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    assert np.mean([p == y for _, p, y in held]) > 0.92
    good, bad = [s for s, _, y in held if y == 0], [s for s, _, y in held if y == 1]
    assert np.mean([a < b for a in good for b in bad]) > 0.8


def test_features():
    texts = [None, "", "You are an idiot and a moron, you IDIOT!!", "st*pid 1d10t i d i o t", "A calm and plain sentence.", "\x00 ñandú"]
    rows = toxicity.feature_rows(pa.array(texts), frozenset([b"calm"]))
    at = toxicity.NAMES.index
    assert not rows[0].any() and not rows[1].any() and np.isfinite(rows).all()
    assert rows[2, at("lexicon")] == 3 / 9 and rows[2, at("near_second_person")] == 3 / 9 and rows[2, at("second_person")] == 2 / 9
    assert rows[2, at("exclamation")] == 2 / len(texts[2])
    assert rows[3, at("disguised")] > 0 and rows[3, at("obfuscation")] > 0
    assert rows[4, at("learned_count")] == math.log1p(1) and rows[4, at("lexicon")] == 0


def test_disguised_words_side_by_side_and_accented_capitals():
    lexicon = frozenset(w.encode() for w in toxicity.INSULTS)
    for text, pieces, hidden in [("well-known id1ot", 2, 1), ("you id1ot m0ron", 2, 2), ("id1ot, m0ron l0ser cl0wn.", 4, 4), ("IMB\u00c9C1LE", 1, 1), ("a1b2c3d4", 1, 0),
                                 ("you/id1ot", 1, 1), ("id1ot,m0ron", 1, 2), ("x" * 200 + "/id1ot." + "y-z" * 100, 1, 1), ("well-known/idiot", 1, 0)]:
        assert toxicity._disguised(text.encode(), lexicon) == (pieces, hidden), text
    at = toxicity.NAMES.index
    rows = toxicity.feature_rows(pa.array(["BL\u00d6DMANN", "IMB\u00c9CILE", "ESTÚPIDO \u00c9l", "TÚ idiota", "I\u0130 idiot"]), frozenset())
    assert rows[:, at("lexicon_count")].tolist() == [math.log1p(1)] * 5 and rows[3, at("near_second_person")] == 0.5
    assert toxicity.split_words(b"\xff ID\xc3\x89") and toxicity.split_words("ÉA b".encode()) == ["éa".encode(), b"b"]


def test_toxicity_of_odd_tables(spark, documents, mixed_rows):
    docs = documents(mixed_rows)
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, labels([])).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, labels([(1, 1, 1), (2, None, None)])).collect()} <= {0.0, 1.0}
    ids = [i for i in range(40) if crc(i) % 5]
    taught = documents([(i, "plain words of a text" if i % 2 else "you stupid idiot, you moron") for i in range(40)])
    rows = toxicity.score(taught.union(docs), labels([(i, 1, 1 - i % 2) for i in ids] + [(ids[0], 1, 0), (None, 1, 1)]), trees=3).collect()
    assert len(rows) == 40 + len(mixed_rows)
    scores = {r.doc_id: r.score for r in rows[:40]}
    assert all(0 <= r.score <= 1 for r in rows)
    assert min(s for i, s in scores.items() if i % 2 == 0 and i >= 10) > max(s for i, s in scores.items() if i % 2 and i >= 10)
    assert toxicity.score(documents([]), labels([(1, 1, 1)])).withColumn("x", F.lit(1)).collect() == []
