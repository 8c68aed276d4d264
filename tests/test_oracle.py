"""Each registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from sequor import catalog
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    a = catalog.QUERIES[name](spark, SF).toPandas()
    b = duck.execute(catalog.ORACLE[name]).fetchdf()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    rows = [sorted(x[cols].astype(str).itertuples(index=False, name=None)) for x in (a, b)]
    assert rows[0] == rows[1]


def test_plans_have_no_pair_loops(spark):
    for name in ("j1_overlap", "j2_anti", "j3_get_sequences", "j5_nearest_gc"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
