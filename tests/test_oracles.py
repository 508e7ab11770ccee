"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import math

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


def _canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, (int, float)):
        f = float(v)
        return (1, "nan" if math.isnan(f) else f"{f:.9g}")
    return (3, str(v))


def _rows(cols, rows, order):
    idx = [cols.index(c) for c in order]
    return sorted(tuple(_canon(r[i]) for i in idx) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert len(srows) == len(orows)
    order = sorted(scols)
    assert _rows(scols, srows, order) == _rows(ocols, orows, order)


def test_every_query_runs(spark):
    for name, fn in QUERIES.items():
        if name in ORACLES:
            continue
        df = fn(spark, SF_SMALL)
        assert df.count() >= 0, name


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "rank_per_100k_all" in df.columns
