import math
from collections import Counter

import duckdb
import pytest

from heddle.session import get_session

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = get_session(master="local[4]", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return str([shown(v) for v in value])
    return str(value)


@pytest.fixture
def same_rows(spark, duck):
    """Asserts that a query and its SQL have the same columns and rows."""

    def check(query, sql):
        frame = query(spark, DATA)
        columns = sorted(frame.columns)
        theirs = duck.sql(sql)
        assert sorted(theirs.columns) == columns
        at = [theirs.columns.index(c) for c in columns]
        got = Counter(tuple(shown(r[c]) for c in columns) for r in frame.collect())
        want = Counter(tuple(shown(r[i]) for i in at) for r in theirs.fetchall())
        assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])

    return check
