"""Line dedup against a plain loop, with filters of any size and both ways of applying the keys."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from newsgrid.llm import linededup


def plain(rows, min_chars=40, min_docs=5):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    low = lambda i: -(1 << 63) if i is None else i
    held = defaultdict(set)
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(low(doc_id))
    gone = {k: max(ids) for k, ids in held.items() if len(k) >= min_chars and len(ids) >= min_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if gone.get(key(line), low(doc_id)) == low(doc_id)]
        out.append((str(doc_id), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 64, 1 << 12])
@pytest.mark.parametrize("broadcast_keys", [linededup.BROADCAST_KEYS, 0])
def test_equals_plain_loop(spark, documents, mixed_rows, bits, broadcast_keys):
    border = "é" * 39 + "\n" + "É" * 40 + "\n"
    rows = mixed_rows + [(200 + i, border + f"{i}\n" + "ab" * 20 + "\r\n\t" + "AB" * 20) for i in range(6)]
    found = linededup.dedup_lines(documents(rows).repartition(5), bits=bits, broadcast_keys=broadcast_keys).collect()
    assert sorted((str(r.doc_id), r.text or "", r.n_lines, r.n_dropped) for r in found) == plain(rows)


def test_columns_stay(spark, documents, mixed_rows):
    docs = documents(mixed_rows).withColumn("_lost0", F.lit(1)).withColumn("n_lines", F.lit("mine"))
    found = linededup.dedup_column(docs)
    assert found.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in found.collect()) == sorted(r[:2] for r in plain(mixed_rows))
    assert linededup.dedup_column(documents([])).collect() == []


def test_a_slice_alone_finds_its_repeats(spark, documents):
    line = "x" * 50
    docs = documents([(i, f"{line}\n{line}\n{i}") for i in range(5)]).coalesce(1)
    assert sorted(r.n_dropped for r in linededup.dedup_lines(docs).collect()) == [0, 2, 2, 2, 2]
