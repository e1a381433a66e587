import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from valora.runtime import get_spark  # noqa: E402

DATA = os.environ.get("VALORA_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def oracle(data):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(data):
        at = os.path.join(data, f)
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con
