import glob
import os

import duckdb
import pytest

from reviewlake import catalog_code as catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cells(df):
    cols = sorted(df.columns)
    fix = lambda v: "null" if v is None or v != v else str(v) if isinstance(v, (bool, str)) or not isinstance(v, (int, float)) else f"{v:.6f}"
    return cols, sorted(tuple(fix(v) for v in row) for row in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    assert cells(catalog.QUERIES[name](spark, SF).toPandas()) == cells(con.execute(catalog.ORACLE_SQL[name]).df())
