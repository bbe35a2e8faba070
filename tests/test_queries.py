"""Every registered query against its checking SQL on the smallest tables."""

import math

import duckdb
import pytest

from newsgrid.plans.catalog import CHECKS, QUERIES
from newsgrid.plans.views import TABLES

ROWS_ONLY: set[str] = set()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def engine(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def _plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, engine, small, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name in ROWS_ONLY:
        assert rows
        return
    result = engine.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    assert sorted(names) == sorted(df.columns)
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    order = sorted(names)
    ours = sorted((tuple(_plain(r[c]) for c in order) for r in rows), key=repr)
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert ours == theirs


def test_every_survey_id_is_registered():
    ids = {
        **{"src": 12, "snk": 14, "flt": 22, "joi": 14, "agg": 17, "win": 11, "top": 10, "set": 5, "sca": 28, "txt": 5, "mod": 11}
    }
    have = {"_".join(n.split("_")[:2]) for n in QUERIES}
    assert have == {f"{k}_{i:02d}" for k, n in ids.items() for i in range(1, n + 1)}
