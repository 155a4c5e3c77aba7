"""Daily sums: any cut into batches, batches run again, late days, odd rows."""

from __future__ import annotations

import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgrid.operators.rollups import Rollup, mean_and_deviation

SCHEMA = "ts timestamp, kind string, v double"
ROWS = [(datetime(2024, 1, 1 + i % 5, i % 24), "ab"[i % 2], None if i % 7 == 0 else float(i)) for i in range(60)] + [(None, "a", 1.0), (datetime(2024, 1, 2), None, 2.0)]


def rolled(spark, path, batches, first=0):
    like = spark.createDataFrame([], SCHEMA)
    r = Rollup(like, str(path), "ts", ("kind",), {"high": F.col("v") > 30}, {"v": F.col("v")})
    for i, rows in enumerate(batches, first):
        r.add(spark.createDataFrame(rows, SCHEMA), i)
    return r


def sums(r):
    return sorted((tuple(x) for x in r.days().collect()), key=str)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    return sums(rolled(spark, tmp_path_factory.mktemp("whole") / "t", [ROWS]))


def test_plain(whole):
    plain = {}
    for ts, kind, v in ROWS:
        s = plain.setdefault((ts and ts.date(), kind), [0, 0, 0, 0.0, 0.0])
        s[0] += 1
        if v is not None:
            s[1] += v > 30
            s[2:] = [s[2] + 1, s[3] + v, s[4] + v * v]
    assert whole == sorted(((*k, *s) for k, s in plain.items()), key=str)


@pytest.mark.parametrize("cut", [(20, 40), (1, 61), (30, 30)])
def test_any_cut(spark, tmp_path, whole, cut):
    a, b = cut
    assert sums(rolled(spark, tmp_path / "t", [ROWS[:a], ROWS[a:b], ROWS[b:]])) == whole


def test_a_batch_run_again_counts_once(spark, tmp_path, whole):
    r = rolled(spark, tmp_path / "t", [ROWS[:30], ROWS[30:50]])
    r.add(spark.createDataFrame(ROWS[30:50], SCHEMA), 1)
    r.add(spark.createDataFrame(ROWS[50:], SCHEMA), 2)
    r.add(spark.createDataFrame(ROWS[50:], SCHEMA), 2)
    assert sums(r) == whole


def test_a_late_day_is_rewritten_alone(spark, tmp_path):
    r = rolled(spark, tmp_path / "t", [ROWS])
    parts = lambda: {p.parent.name: p.name for p in pathlib.Path(tmp_path / "t").glob("day=*/*.parquet")}
    before = parts()
    r.add(spark.createDataFrame([(datetime(2024, 1, 3), "a", 9.0)], SCHEMA), 1)
    after = parts()
    assert {d for d in before if before[d] != after[d]} == {"day=2024-01-03"} and before.keys() == after.keys()
    for i in range(2, 6):  # rows of a day do not pile up
        r.add(spark.createDataFrame([(datetime(2024, 1, 3), "a", 9.0)], SCHEMA), i)
    assert spark.read.parquet(str(tmp_path / "t")).filter("day = '2024-01-03' AND kind = 'a'").count() == 2


def test_windows_weeks_and_nothing(spark, tmp_path):
    r = rolled(spark, tmp_path / "t", [ROWS, []])
    as_of = F.lit("2024-01-09")
    assert r.windows(as_of, (4, 5, 90)).first().asDict() == {"d4": 12, "d5": 24, "d90": 61}
    assert [(x["week"], x["n"]) for x in r.weeks(as_of, 3).orderBy("week").collect()] == [(0, 36), (1, 25), (2, 0)]
    mean, deviation = mean_and_deviation("v")
    got = r.totals().select("n", mean.alias("m"), deviation.alias("s")).first()
    values = [v for _, _, v in ROWS if v is not None]
    m = sum(values) / len(values)
    assert got["n"] == 62 and got["m"] == pytest.approx(m) and got["s"] == pytest.approx((sum((v - m) ** 2 for v in values) / (len(values) - 1)) ** 0.5)
    assert r.totals(F.lit("2025-01-01")).first()["n"] == 0
