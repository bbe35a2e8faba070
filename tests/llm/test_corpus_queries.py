"""Registered corpus queries against their checking SQL, and the pipeline against its stages."""

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from newsgrid.llm.queries import CHECKS, QUERIES

NUMBERED = 13
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, small, name):
    engine = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "conversations"):
        engine.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    result = engine.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    assert sorted(tuple(r[c] for c in order) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in order) for r in result.fetchall())


def test_secrets_sql_knows_repositories(spark, documents, tmp_path):
    """A value in many documents of one source, and one of a missing source, is a copied example for the query and its SQL."""
    rows = [(i, f"note {i} token = 'qW9eR8tY7uI6oP5a'", "en", "one" if i % 2 else None) for i in range(12)]
    rows += [(20 + i, "secret: 'mN3bV4cX5zL6kJ7h'", "en", "two") for i in range(3)] + [(None, "api_key=hG5fD4sA3pO2iU1y", "en", None)]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = engine.execute(CHECKS["op2_secret_scan"])
    names = [d[0] for d in result.description]
    theirs = sorted((str(tuple(r[names.index(c)] for c in sorted(names))) for r in result.fetchall()))
    rows = QUERIES["op2_secret_scan"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r[c] for c in sorted(names))) for r in rows) == theirs
    assert {r.doc_id: (r.n_live, r.n_copied) for r in rows if r.doc_id in (3, 21)} == {3: (0, 1), 21: (1, 0)}


def test_all_queries_and_the_pipeline_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(int(n.split("_")[0][2:]) for n in names if n != "pipeline") == list(range(1, 1 + NUMBERED)) and "pipeline" in names


def test_pipeline(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    rows = dict(before)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == COLUMNS, name
        kept = {r.doc_id: r for r in out.collect()}
        assert set(kept) <= set(rows) and all(kept[i][c] == rows[i][c] for i in kept for c in COLUMNS if c != "text")
        docs, rows = spark.createDataFrame(list(kept.values()), docs.schema), kept
    assert 0 < len(rows) < len(before)
    final = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id for r in final} == set(rows)
    assert all(r["size"] == len((rows[r.doc_id].text or "").encode().split()) for r in final)


def test_stages_take_odd_tables(spark, small, documents, mixed_rows):
    docs = documents(mixed_rows)
    empty = documents([])
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, small).collect()
        assert stage(spark, empty, small).collect() == []
