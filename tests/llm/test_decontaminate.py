"""Phrase hits against a plain loop over all windows."""

import re

import pytest
from pyspark.sql import functions as F

from newsgrid.llm import decontaminate


def words(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(docs, items, width=13):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item_id, passage in items:
            p = words(passage)
            for i in range(max(1, len(p) - width + 1) if p else 0):
                window = p[i:i + width]
                for s in range(len(w) - len(window) + 1):
                    if w[s:s + len(window)] == window:
                        hit |= set(range(s, s + len(window)))
                        names.add("" if item_id is None else str(item_id))
        out.append((str(doc_id), len(w), len(hit), sorted(names), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.fixture(scope="module")
def case(spark):
    passage = " ".join(f"term{i % 7} rare{i}" for i in range(15))
    items = [(1, passage), (2, "the the the"), (3, ""), (None, "no-id words, here"), (10, None), (1, "Second text of the same id"), (4, "a b c d e f g h i j k l m n o p")]
    docs = [
        (1, f"before {passage.upper()}; after"), (2, "The, the. The! the"), (3, None), (4, ""), (5, "nothing of it"), (None, "x no id WORDS here y"), (6, passage[:60]),
        (7, "a b c d e f g h i j k l m " * 3 + "n o p " + "z " * 500), (8, "second text of the same id " + "q " * 200), (1, f"before {passage.upper()}; after"), (9, "d e f g h i j k l m n o p"),
    ]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 5])
@pytest.mark.parametrize("width", [13, 4])
def test_equals_plain_loop(spark, case, block_words, width):
    docs, items, d, b = case
    found = decontaminate.report(decontaminate.search(d, b, width, block_words)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found) == plain(docs, items, width)


def test_clean_keeps_columns_and_clean_rows(spark, case):
    docs, items, d, b = case
    d = d.withColumn("n_words", F.lit("mine")).withColumn("_found0", F.lit(2))
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in plain(docs, items) if not r[4])
    assert decontaminate.clean(d, b.limit(0)).count() == len(docs)
    assert decontaminate.clean(d.limit(0), b).count() == 0


def test_proximity_finds_reordered_passages(spark):
    rare = [f"rare{i}" for i in range(13)]
    items = spark.createDataFrame([(7, " ".join(rare))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 30 + " ".join(rare[::-1])), (2, rare[0] + " x" * 200 + " " + rare[1])], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.proximity(docs, items).collect()} == {(1, "7")}
    assert decontaminate.search(docs, items).filter("size(items) > 0").count() == 0
