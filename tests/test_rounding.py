"""Values in the middle between two rounded ones: queries and their SQL take the same."""

from __future__ import annotations

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgrid.plans import catalogue
from quillgrid.plans.registry import rounded


@pytest.fixture(scope="module")
def halves(spark, tmp_path_factory):
    """Events of every value that has two digits, 28.5 and 57.45 among them, two a user."""
    path = str(tmp_path_factory.mktemp("halves"))
    day = datetime.datetime(2024, 1, 20)
    kinds = ("click", "error")
    held = [(i, day + datetime.timedelta(seconds=i), i // 8, kinds[i % 2], i / 100) for i in range(10_001)]
    spark.createDataFrame(held, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_rounded_equals_the_sql(spark, halves):
    read = spark.read.parquet(f"{halves}/events.parquet")
    got = read.select("event_id", *(rounded(F.col("value") / 100, p).alias(f"p{p}") for p in (2, 3))).orderBy("event_id").collect()
    want = duckdb.sql(f"SELECT event_id, round(value / 100, 2), round(value / 100, 3) FROM '{halves}/events.parquet/*.parquet' ORDER BY 1").fetchall()
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize("name", ["review_items", "top_candidates"])
def test_queries_round_as_their_sql(spark, halves, name):
    df = catalogue.QUERIES[name](spark, halves)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{halves}/events.parquet/*.parquet'")
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(found.fetchall(), key=key)
