"""Every registered query beside the same result in SQL, or, without one, its schema and a full run."""

import os
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from opsdesk.plans import catalog

DATA = os.environ.get("OPSDESK_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, (float, Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, date) else v


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in catalog.ORACLE_SQL:
        cur = duck.execute(catalog.ORACLE_SQL[name])
        assert got == rows([c[0] for c in cur.description], cur.fetchall())


def test_code_walk_with_many_lines(spark, tmp_path):
    customers = spark.range(700_000).select(F.col("id").alias("c_custkey"), F.format_string("Customer#%09d", "id").alias("c_name"))
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert catalog.QUERIES["code_walk"](spark, str(tmp_path)).distinct().count() == 2 * 116_667
