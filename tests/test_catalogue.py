import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from paperloom.plans.catalogue import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE_SQL:
        assert len(got)
        return
    want = con.sql(ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    cols = sorted(got)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)
    kinds = lambda d: {c: str(d[c].dtype) for c in cols}
    assert kinds(got) == kinds(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= len(QUERIES)
