"""Table sets, accretion, failed rows, cycles and soft deletes on small inputs."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.operators import evaluation, learning, mutations
from quillgrid.sources.versions import TableSet
from quillgrid.storage import new_path
from quillgrid.streaming import inbox, schedule


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_table_set_publishes_all_or_nothing(spark):
    tables = TableSet(spark, new_path(spark))
    assert tables.version() == 0 and tables.state() == {}
    a, b = spark.range(3), spark.range(10, 12)
    assert tables.commit(reload={"a": a, "b": b}) == 1
    with pytest.raises(Exception, match="no such number"):
        tables.commit(reload={"a": spark.range(9)}, append={"b": spark.range(5).select(F.raise_error(F.lit("no such number")).cast("long").alias("id"))})
    assert tables.version() == 1 and values(tables.read("a"), "id") == [0, 1, 2]
    assert len(tables.state()["b"]) == 1
    assert tables.commit(append={"b": spark.range(1)}) == 2
    assert values(tables.read("b"), "id") == [0, 10, 11] and values(tables.read("b", 1), "id") == [10, 11]


def test_table_set_reload_from_itself(spark):
    tables = TableSet(spark, new_path(spark))
    tables.commit(reload={"a": spark.range(6)})
    tables.commit(reload={"a": tables.read("a").filter("id > 3")})
    assert values(tables.read("a"), "id") == [4, 5]


def test_table_set_of_two_writers(spark):
    root = new_path(spark)
    one, two = TableSet(spark, root), TableSet(spark, root)
    one.commit(reload={"a": spark.range(1)})
    two.version = lambda: 0  # read before the other published
    with pytest.raises(RuntimeError, match="another writer"):
        two.commit(reload={"a": spark.range(5)})
    assert one.read("a").count() == 1


GATE = "id long, analyte_id string, norm string, confirmed boolean, margin double, ts timestamp"


def decided(spark, *rows):
    return spark.createDataFrame([(i, n, n, True, 0.5, t) for i, n, t in rows], GATE)


def test_dual_gate_counts_what_days_have_taken(spark):
    d = [datetime(2024, 1, 1, h) for h in range(5)]
    rows = decided(spark, *((i, f"n{i}", t) for i, t in enumerate(d)))
    none = spark.createDataFrame([], "analyte_id string, norm string")
    t = Thresholds(daily_cap=3)
    got = lambda before: [r["outcome"] for r in learning.dual_gate(rows, none, t, before).orderBy("id").collect()]
    days = lambda n: spark.createDataFrame([(d[0].date(), n)], "day date, n long")
    assert got(None) == ["ingested"] * 3 + ["daily_cap"] * 2
    assert got(days(2)) == ["ingested"] + ["daily_cap"] * 4
    assert got(days(3)) == ["daily_cap"] * 5
    assert got(spark.createDataFrame([(date(2024, 1, 2), 3)], "day date, n long")) == ["ingested"] * 3 + ["daily_cap"] * 2
    assert learning.dual_gate(rows.limit(0), none, t).count() == 0


def test_accretion_over_batches(spark):
    tables = TableSet(spark, new_path(spark))
    tables.commit(reload={"synonyms": spark.createDataFrame([("n0", "n0", None)], "analyte_id string, norm string, ts timestamp")})
    step = inbox.accrete(tables, t=Thresholds(daily_cap=3))
    day = [datetime(2024, 1, 1, h) for h in range(6)]
    first = decided(spark, (0, "n0", day[0]), (1, "n1", day[1]), (2, "n2", day[2]))
    step(first, 0)
    step(first, 0)  # the batch runs again
    assert values(tables.read("synonyms"), "norm") == ["n0", "n1", "n2"]
    step(decided(spark, (3, "n2", day[3]), (4, "n3", day[4]), (5, "n4", day[5])), 1)
    assert values(tables.read("synonyms"), "norm") == ["n0", "n1", "n2", "n3"]


def test_route_keeps_failed_rows_and_repeats_a_batch(spark):
    out = new_path(spark)
    parse = lambda df: df.withColumn("error", F.when(F.col("id") > 2, "too large"))
    step = inbox.route(parse, f"{out}/done", f"{out}/failed")
    step(spark.range(5), 0)
    step(spark.range(5), 0)
    step(spark.range(1), 1)
    assert values(spark.read.parquet(f"{out}/done"), "id") == [0, 0, 1, 2]
    assert values(spark.read.parquet(f"{out}/failed"), "id") == [3, 4]


def test_cycle_runs_what_is_due():
    ran = []

    def fails():
        raise ValueError("no file")

    steps = [schedule.Step("ingest", lambda: ran.append("ingest")), schedule.Step("learn", fails), schedule.Step("calibrate", lambda: ran.append("calibrate"), day=1)]
    assert schedule.run_cycle(steps, date(2024, 2, 2)) == [("ingest", "done", ""), ("learn", "failed", "ValueError: no file"), ("calibrate", "not_due", "")]
    schedule.run_cycle(steps, date(2024, 3, 1))
    assert ran == ["ingest", "ingest", "calibrate"]


def test_clear_conflicting_leaves_other_keys(spark):
    rows = spark.createDataFrame([(1, "A", True), (1, "B", True), (1, None, True), (2, "B", True), (2, "C", False)], "k int, v string, valid_for_consensus boolean")
    kept = spark.createDataFrame([(1, "A")], "k int, v string")
    got = {(r["k"], r["v"]): r["valid_for_consensus"] for r in mutations.clear_conflicting(rows, kept, ["k"], "v").collect()}
    assert got == {(1, "A"): True, (1, "B"): False, (1, None): False, (2, "B"): True, (2, "C"): False}


def test_empty_batch_has_a_summary(spark):
    empty = spark.createDataFrame([], "method string, confidence double, band string, disagreement boolean, ms long")
    row = evaluation.batch_summary(empty, F.col("ms")).first()
    assert (row["total"], row["exact_rate"], row["mean_confidence"], row["per_second"]) == (0, 0.0, 0.0, None)


def test_consistency_counts_no_analyte_as_one(spark):
    rows = spark.createDataFrame([("x", None), ("x", None), ("y", "A"), ("y", None), ("z", "B")], "name string, analyte string")
    row = evaluation.consistency_rate(rows, "name", "analyte", 2).first()
    assert (row["names"], row["consistent"], row["common"]) == (3, 2, 2) and abs(row["percent"] - 200 / 3) < 1e-9
