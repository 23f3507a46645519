"""Queries against their SQL on tables that are larger or odder than the driver's smallest ones."""

import os

import duckdb
import pytest

from holdgraph.plans.catalogue import ORACLE_SQL, QUERIES


def equal(spark, folder, name, **tables):
    """The query and its SQL give the same rows, as multisets, over tables given as SQL; returns them."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = QUERIES[name](spark, str(folder))
    cursor = con.execute(ORACLE_SQL[name])
    order = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    got, want = sorted(map(repr, map(tuple, df.collect()))), sorted(repr(tuple(r[i] for i in order)) for r in cursor.fetchall())
    assert got == want and want
    return want


def test_signal_merge_rounds_halves_to_even_and_puts_nulls_last(spark, tmp_path):
    rows = "(1, 'signup', 1, 2.5), (1, 'signup', 2, 2.4), (1, 'signup', 3, 1.0), (2, 'signup', 4, 2.5), (2, 'signup', 5, 3.0), (3, 'signup', NULL, 4.0), (3, 'signup', 7, 4.0), (3, 'click', 8, 1.0), (3, 'click', 11, NULL), (4, NULL, 12, 0.5)"
    want = equal(spark, tmp_path, "signal_merge", events=f"SELECT CAST(user_id AS BIGINT) AS user_id, event_type, CAST(event_id AS BIGINT) AS event_id, CAST(value AS DOUBLE) AS value FROM (VALUES {rows}) t(user_id, event_type, event_id, value)")
    assert repr((2, "signup", 2, 5)) in want and repr((3, "signup", 1, 7)) in want


def test_sector_assets_end_at_twelve_hops(spark, tmp_path):
    customers = "SELECT k AS c_custkey, 'n' || k AS c_name, CAST(k % 25 AS INTEGER) AS c_nationkey, 0.0 AS c_acctbal, 'A' AS c_mktsegment FROM range(42, 90000, 50) t(k)"
    orders = "SELECT k AS o_orderkey, 42 + 50 * (k % 1800) AS o_custkey, CASE k % 3 WHEN 0 THEN '5-LOW' WHEN 1 THEN '1-URGENT' END AS o_orderpriority FROM range(0, 3600) t(k)"
    equal(spark, tmp_path, "sector_assets", customer=customers, orders=orders)
