import math
import os

import duckdb
import pytest

from rillflow.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def same(rows, columns, sql_rows, sql_columns):
    assert sorted(columns) == sorted(sql_columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    sql_order = sorted(range(len(sql_columns)), key=lambda i: sql_columns[i])
    a = sorted(repr([plain(r[i]) for i in order]) for r in rows)
    b = sorted(repr([plain(r[i]) for i in sql_order]) for r in sql_rows)
    assert a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    sql = db.execute(SQL[name])
    columns = [c[0] for c in sql.description]
    same([tuple(r) for r in df.collect()], df.columns, sql.fetchall(), columns)
