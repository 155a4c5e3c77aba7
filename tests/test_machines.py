"""Stateful streams cut into batches in several ways against their batch forms; prefix sums against plain ones."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.operators import learning
from quillgrid.operators.prefix_sums import running_sums
from quillgrid.storage import new_path
from quillgrid.streaming import inbox, machines

EVENTS = "lab_vendor string, observed_text string, analyte_id string, ts timestamp, id long"
T0 = datetime(2024, 1, 1)


def play(spark, batches, kind, make, out, mode, each):
    """Micro-batches one run after the other, over one checkpoint."""
    for part in batches:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{out}/in")
        with machines.state_store(spark):
            inbox.run_once(make(spark.readStream.schema(kind).parquet(f"{out}/in")), f"{out}/state", each=each, mode=mode)


def machine(spark, batches, **how):
    out = new_path(spark)
    save = lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/out")
    play(spark, batches, EVENTS, lambda s: machines.vendor_machine(s, **how), out, "update", save)
    return [r for r in spark.read.parquet(f"{out}/out").orderBy("batch").collect() if r["lab_vendor"]]


def test_vendor_machine_takes_events_in_order_of_time(spark):
    """Within the watermark events may come in any order and cut; a cooldown ends by its timer alone."""
    rng = random.Random(3)
    rows = [(v, "x", rng.choice(["A", "B", None]), T0 + timedelta(hours=3 * i), i) for i in range(40) for v in ("v", "w")]
    mixed = [rows[:30], rows[30:50], rows[50:]]
    for part in mixed:
        rng.shuffle(part)
    beat = lambda day: [(None, None, None, T0 + timedelta(days=day, seconds=1), -1)]
    got = machine(spark, [*mixed, beat(6), beat(40)])
    want = {r["lab_vendor"]: (r["confirmations"], r["collision_count"]) for r in learning.collisions(spark.createDataFrame(rows, EVENTS), ["lab_vendor", "observed_text"], "analyte_id", ["ts", "id"]).collect()}
    for v in ("v", "w"):
        mine = [r for r in got if r["lab_vendor"] == v]
        assert (mine[-1]["confirmations"], mine[-1]["collisions"]) == want[v]
        states = [r["status"] for r in mine]
        assert "UNSTABLE" in states and states[-1] == "RECOVERED"


def test_vendor_machine_starts_from_a_table_and_forgets(spark):
    seed = spark.createDataFrame([("v", "x", "A", 7, 2, T0 - timedelta(days=1)), ("old", "x", "A", 3, 0, None)], machines.SEED)
    rows = [("v", "x", "B", T0, 1), ("v", "x", "B", T0 + timedelta(hours=1), 2)]
    got = machine(spark, [rows, [(None, None, None, T0 + timedelta(days=1), -1)], [(None, None, None, T0 + timedelta(days=60), -2)], [("v", "x", "C", T0 + timedelta(days=61), 3)], [(None, None, None, T0 + timedelta(days=62), -3)]], initial=seed, idle_days=30)
    first = next(r for r in got if r["confirmations"] == 9)
    assert (first["collisions"], first["analyte_id"], first["status"]) == (3, "B", "UNSTABLE")
    # After thirty days without an event the variant is new.
    assert (got[-1]["confirmations"], got[-1]["collisions"], got[-1]["status"]) == (1, 0, "STABLE")


DECISIONS = "id long, analyte_id string, norm string, confirmed boolean, margin double, ts timestamp"


@pytest.mark.parametrize("cuts", [(), (7,), (1, 2, 20, 33)])
def test_accretion_equals_the_batch_gate_over_any_cut(spark, cuts):
    rng = random.Random(5)
    rows = [(i, f"a{rng.randrange(4)}", f"n{rng.randrange(9)}", rng.random() > 0.1, rng.choice([0.01, 0.5, None]), T0 + timedelta(hours=2 * i)) for i in range(60)]
    known, t = spark.createDataFrame([("a0", "n0"), ("a1", "n1")], "analyte_id string, norm string"), Thresholds(daily_cap=2)
    want = {r["id"] for r in learning.dual_gate(spark.createDataFrame(rows, DECISIONS), known, t).filter("outcome = 'ingested'").collect()}
    out = new_path(spark)
    machines.prepare(spark, out)
    edges = [0, *cuts, len(rows)]
    play(spark, [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)], DECISIONS, lambda s: machines.first_forms(s, known, t), out, "append", machines.accrete_first(out, t))
    added = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/added")
    assert sorted(r["id"] for r in added.collect()) == sorted(want)


def test_a_batch_that_runs_again_adds_nothing(spark):
    out, t = new_path(spark), Thresholds(daily_cap=2)
    machines.prepare(spark, out)
    step = machines.accrete_first(out, t)
    rows = lambda *ids: spark.createDataFrame([("a", f"n{i}", T0 + timedelta(hours=i), i) for i in ids], "analyte_id string, norm string, ts timestamp, id long")
    step(rows(1), 0)
    step(rows(1), 0)
    step(rows(2, 3), 1)
    step(rows(2, 3), 1)
    assert sorted(r["id"] for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/added").collect()) == [1, 2]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(x, rng.randrange(5), None if rng.random() < 0.1 else 1) for x in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "k long, a long, b long").repartition(6)
    got = sorted(running_sums(df, F.desc("k"), {"a": "ra", "b": "rb"}, {"a": "all_a"}).collect(), key=lambda r: -r["k"])
    a = b = 0
    for r, (k, x, y) in zip(got, sorted(rows, reverse=True), strict=True):
        a, b = a + x, b + (y or 0)
        assert (r["k"], r["ra"], r["rb"]) == (k, a, b)
    assert {r["all_a"] for r in got} == {a}
    assert running_sums(df.limit(0), F.col("k"), {"a": "ra"}).count() == 0


def test_thresholds_have_no_window_over_all(spark):
    df = spark.createDataFrame([(i / 100, i % 3 > 0) for i in range(100)], "s double, ok boolean")
    for f in (learning.precision_threshold, learning.f1_threshold):
        plan = f(df, "s", F.col("ok"))._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "SinglePartition" not in plan.split("Window")[1].split("FileScan")[0]
