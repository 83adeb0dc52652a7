from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as driver
from ravelin.plans import catalog


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{data}/{name}'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, want.fetchall())


def test_posting_order_does_not_depend_on_files(spark, tmp_path, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").withColumn("n", F.row_number().over(Window.orderBy("vec_id")))
    for i, (lo, hi) in enumerate([(0, 50), (50, 150), (150, 500)]):  # larger files are read first
        part = rows.filter((F.col("n") > lo) & (F.col("n") <= hi)).drop("n").orderBy(F.desc("vec_id") if i == 1 else "vec_id")
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    df, want = catalog.posting_order(spark, str(tmp_path)), con.sql(catalog.ORACLE_SQL["posting_order"])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of(want.columns, want.fetchall())


def test_entry_and_contract(spark):
    assert driver.entry(spark).count() == catalog.K
    assert set(catalog.QUERIES) <= set(driver.queries())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_batch_recall(spark, data):
    rows = catalog.recall_at_k(spark, data).collect()
    assert sum(r.n_found for r in rows) >= 0.9 * sum(r.n_exact for r in rows)
