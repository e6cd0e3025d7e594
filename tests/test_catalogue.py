"""Every query of the catalogue on the smallest tables; where there is SQL, its rows must be the same."""

import decimal
import glob
import os

import duckdb
import pytest

from tracewell.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, decimal.Decimal) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("model_logreg", "model_mlp")])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in ORACLE_SQL:
        result = duck.execute(ORACLE_SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        assert plain(rows) == plain([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    else:
        assert rows
