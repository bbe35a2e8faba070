"""Packing: token ids against the tokenizer's own library, the plan against a plain best-fit loop, and exact properties of the result."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsgrid.llm import packing
from newsgrid.llm.queries import QUERIES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def plain_best_fit(lengths, capacity):
    """Document by document, longest first: the smallest gap that is large enough, else a new sequence."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps[gaps.index(min(fits))] -= length
        else:
            gaps.append(capacity - length)
    return gaps


def check_placed(rows, capacity):
    """rows: (sequence, offset, length). Sequences are gapless from 0 and not over-full."""
    by_seq = {}
    for seq, offset, length in rows:
        by_seq.setdefault(seq, []).append((offset, length))
    for own in by_seq.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_seq)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_plan_equals_plain_best_fit(lengths, capacity):
    counts = {v: lengths.count(v) for v in set(lengths)}
    plan = packing.best_fit(counts, capacity)
    rows = []
    for length, n in counts.items():
        own = sorted((int(r), i) for i, r in enumerate(plan["rank"]) if plan["length"][i] == length)
        for (rank, i), nxt in zip(own, [*[r for r, _ in own[1:]], n]):
            rows += [(int(plan["seq"][i]) + k // int(plan["each"][i]), int(plan["offset"][i]) + k % int(plan["each"][i]) * length, length) for k in range(nxt - rank)]
    assert len(rows) == len(lengths)
    gaps = plain_best_fit(lengths, capacity)
    assert check_placed(rows, capacity) == len(gaps)
    ends = {}
    for seq, _, length in rows:
        ends[seq] = ends.get(seq, 0) + length
    assert sorted(capacity - e for e in ends.values()) == sorted(gaps)


def test_too_long_is_an_error():
    with pytest.raises(ValueError):
        packing.best_fit({9: 1}, 8)


def test_encoder_equals_the_library():
    encode = packing.Encoder()
    texts = ["", "a b", "it's  odd\n\n\t x ", "<|endoftext|> mid <|endoftext|>", "é" * 40, "漢字かな交じり文 🙂🙂", "   x​́", " " * 3_000_000 + "a"]
    for t in texts:
        assert [*encode(t), 0] == ids_of(t)


def check_result(rows, texts, capacity, column="ids_crc32"):
    """Every document's pieces are its ids in order; returns (sequences, tokens)."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids = ids_of(texts[doc])
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for i, r in enumerate(own):
            assert r.start == at and 0 < r.length <= capacity and (i == 0 or r.length == capacity)
            assert r[column] == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        if len(ids) <= capacity:
            assert len(own) == 1
    return check_placed([(r.sequence_id, r.offset, r.length) for r in rows], capacity), sum(r.length for r in rows)


def test_query_on_the_whole_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    df = QUERIES["op11_best_fit_packing"](spark, small)
    assert dict(df.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = df.collect()
    n, tokens = check_result(rows, texts, 2048)
    assert n == len(plain_best_fit([r.length for r in rows], 2048)) and n <= 1.02 * -(-tokens // 2048) + 1


def test_odd_rows(spark, documents, mixed_rows):
    rows = [r for r in mixed_rows if r[0] is not None]
    rows = [*{r[0]: r for r in rows}.values()]
    docs = documents(rows).withColumnRenamed("n_chars", "length").selectExpr("*", "1 AS piece", "2 AS offset", "3 AS sequence_id", "4 AS _row", "5 AS ids")
    got = packing.pack_documents(docs, 64).collect()
    check_result(got, {r[0]: r[1] for r in rows}, 64)
    assert packing.pack_documents(documents([])).collect() == []
    same = packing.pack_documents(documents([(None, "a b"), (7, "a b"), (7, "a b")])).collect()
    assert len(same) == 3 and check_placed([(r.sequence_id, r.offset, r.length) for r in same], 2048) == 1


def test_sequences_hold_the_ids(spark, documents):
    texts = {i: f"text number {i} " * (i % 9) for i in range(60)}
    packed = packing.pack_documents(documents(list(texts.items())), 32, with_ids=True)
    rows = packed.collect()
    whole = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(spark.createDataFrame(rows, packed.schema)).collect()}
    for r in rows:
        assert whole[r.sequence_id][r.offset:r.offset + r.length] == ids_of(texts[r.doc_id])[r.start:r.start + r.length]
    assert sum(map(len, whole.values())) == sum(r.length for r in rows)


def test_one_length_over_many_tasks(spark):
    items = spark.range(0, 3000, 1, 40).selectExpr("id", "CAST(IF(id % 3 = 0, 7, 1 + id % 11) AS BIGINT) AS length")
    rows = packing.pack(items, 16).collect()
    assert len({r.id for r in rows}) == 3000
    n = check_placed([(r.sequence_id, r.offset, r.length) for r in rows], 16)
    assert n == len(plain_best_fit([r.length for r in rows], 16))
