"""Every query outside ``llm`` that has SQL, against DuckDB on the smallest given tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from docketry.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return tuple(map(plain, x)) if isinstance(x, list | tuple) else x


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    found, want = registry.queries()[name](spark, FOLDER), duck.sql(registry.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    a = Counter(plain(tuple(r)) for r in found.select(*columns).collect())
    b = Counter(plain(r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, FOLDER).limit(5).collect() is not None
