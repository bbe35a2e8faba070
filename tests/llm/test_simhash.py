"""Fingerprints and groups against a plain reading of the rule."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from newsgrid.llm import simhash
from newsgrid.llm.queries import QUERIES


def plain_print(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance):
    """Smallest id of each group by a walk over all links of distinct values."""
    values = sorted(set(prints.values()))
    least = {v: min(i for i, p in prints.items() if p == v) for v in values}
    out, todo = {}, set(values)
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            v = edge.pop()
            group.add(v)
            near = {w for w in todo if (w ^ v).bit_count() <= distance}
            todo -= near
            edge += near
        out |= {v: min(least[w] for w in group) for w in [0] for v in group}
    return {i: out[p] for i, p in prints.items()}


def test_query_equals_plain_loops(spark, small):
    rows = QUERIES["op1_simhash_near_dedup"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    groups = plain_groups(prints, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{p:016x}", groups[i]) for i, p in prints.items()}


@pytest.mark.parametrize("code", simhash.CODES[:5])
@pytest.mark.parametrize("group_rows", [simhash.GROUP_ROWS, 40])
def test_every_code_finds_every_link(spark, code, group_rows):
    rng = np.random.default_rng(len(code) * 7 + len(code[0]))
    centres = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    values = list(rng.integers(0, 1 << 64, 60, dtype=np.uint64))
    for c in centres:  # chains and dense clouds of near values
        v = c
        for _ in range(12):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                v ^= np.uint64(1) << np.uint64(b)
            values.append(v)
    prints = {i: int(v) for i, v in enumerate(dict.fromkeys(int(v) for v in values))}
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in prints.values()], "fp long")
    edges = simhash.links(frame, code, 4, group_rows)
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    expected = plain_groups(prints, 4)
    mine = {}
    for i, v in prints.items():
        signed = v - (1 << 64) if v >> 63 else v
        mine.setdefault(labels.get(signed, signed), []).append(i)
    assert sorted(map(min, mine.values())) == sorted(set(expected.values()))
    assert all(len({expected[i] for i in g}) == 1 for g in mine.values())


def test_large_group_walk_equals_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 4, dtype=np.uint64)
    fp = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 90).astype(np.uint64)) for b in base]))
    label = simhash._walk(fp, 4)
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert np.array_equal(np.unique(label, return_inverse=True)[1], np.unique(simhash._labels(len(fp), a, b), return_inverse=True)[1])


def test_odd_rows(spark, documents, mixed_rows):
    rows = simhash.near_copies(documents(mixed_rows)).collect()
    assert len(rows) == len(mixed_rows)
    empty = {r.doc_id: r for r in rows if r.doc_id in (100, 101, 104, 106)}
    assert {r.fp for r in empty.values()} == {0} and {r.component_id for r in empty.values()} == {100}
    assert simhash.near_copies(documents([])).collect() == []
    assert [r.component_id for r in simhash.near_copies(documents([(None, "a b c")])).collect()] == [None]


def test_one_of_each_group_stays(spark, documents):
    text = " ".join(f"w{i}" for i in range(200))
    docs = documents([(5, text), (3, text), (9, text + " x"), (1, "other words entirely"), (None, text), (7, text)]).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {1, 3, None} <= ids and not {5, 7} & ids
