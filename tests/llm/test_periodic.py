"""Periodic runs against a plain loop over all periods."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from newsgrid.llm import periodic
from newsgrid.llm.queries import QUERIES


def plain_runs(w):
    """(start, length, period) of every run, by trying each period."""
    n, out = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def plain_row(doc, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc, len(runs), *(best and (best[0], best[1], best[2], 1000 * best[1] // best[2]) or (None,) * 4),
        hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest(),
    )


@st.composite
def word_lists(draw):
    letters = draw(st.integers(1, 4))
    base = draw(st.lists(st.integers(0, letters), min_size=1, max_size=9))
    parts = draw(st.lists(st.tuples(st.sampled_from([base, base[:3], [7, *base]]), st.integers(1, 9)), max_size=4))
    return [x for part, k in parts for x in part * k]


@settings(max_examples=200, deadline=None)
@given(st.lists(word_lists(), min_size=1, max_size=4), st.sampled_from([2, 5, 512]), st.sampled_from([3, 1 << 20]))
def test_runs_equal_plain_loop(docs, short, together):
    docs = sorted((d for d in docs if len(d) >= 12), key=len, reverse=True)
    at = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    flat = np.array([i * 100 + x for i, d in enumerate(docs) for x in d], np.int64)
    before = periodic.SHORT_PERIODS, periodic.TOGETHER
    periodic.SHORT_PERIODS, periodic.TOGETHER = short, together
    try:
        got = periodic.find_runs(periodic._names(flat)[0] if len(flat) else flat, at).tolist()
    finally:
        periodic.SHORT_PERIODS, periodic.TOGETHER = before
    assert got == [[s + at[i], s + at[i] + k, q] for i, d in enumerate(docs) for s, k, q in plain_runs(d)]


def test_grammar_extents_equal_a_loop():
    rng = np.random.default_rng(4)
    for letters in (1, 2, 3, 40):
        w = np.concatenate([rng.integers(0, letters, 300), np.tile(rng.integers(0, letters, 7), 40)])
        g = periodic.Grammar(w, np.zeros(len(w), int), 1)
        i = rng.integers(0, len(w) - 1, 300)
        j = i + 1 + rng.integers(0, len(w), 300) % (len(w) - 1 - i).clip(1)
        right, left = g.extent(i, j, 1), g.extent(i, j, -1)
        for a, b, r, k in zip(i.tolist(), j.tolist(), right.tolist(), left.tolist()):
            n = 0
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            m = 0
            while a - m > 0 and w[a - m - 1] == w[b - m - 1]:
                m += 1
            assert (n, m) == (r, k)


def test_query_equals_plain_loop(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = QUERIES["op12_periodic_runs"](spark, small).collect()
    assert got[0].__fields__ == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(tuple(r) for r in got) == sorted(plain_row(r.doc_id, r.text) for r in docs)
    assert sum(r.n_runs > 0 for r in got) > 5


def test_odd_rows(spark, documents, mixed_rows):
    rows = [r for r in mixed_rows if r[0] is not None]
    rows += [(300 + i, "tick " * 40 + "a b c " * i) for i in range(12)] + [(400, "\t\n same " * 5000)]
    docs = documents(rows).selectExpr("*", "1 AS runs", "2 AS _w", "3 AS n_words", "4 AS _g", "5 AS period")
    got = periodic.digests(periodic.periodic_runs(periodic.with_repeats(docs))).collect()
    plain = [r for r in rows if len(r[1] or "") < 20_000]  # the loop is too slow for the others
    assert sorted(str(tuple(r)) for r in got if r.doc_id not in (102, 400)) == sorted(str(plain_row(r[0], r[1])) for r in plain)
    long = next(r for r in got if r.doc_id == 400)
    assert zlib.crc32(b"400") % 10 and (long.start, long.length, long.period, long.n_runs) == (0, 5000, 1, 1)
    assert long.collapsed_sha256 == hashlib.sha256(b"same").hexdigest()
    nobody = periodic.digests(periodic.periodic_runs(periodic.with_repeats(documents([(None, "a " * 30), (None, None)])))).collect()
    assert sorted((r.doc_id, r.n_runs) for r in nobody) == [(None, 0), (None, 1)]
    assert periodic.periodic_runs(documents([])).collect() == []
