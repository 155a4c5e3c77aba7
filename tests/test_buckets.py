"""Keys that share buckets of state: what each is told is its own."""

from __future__ import annotations

import random
from datetime import timedelta

from quillgrid.operators import learning
from quillgrid.storage import new_path
from quillgrid.streaming import inbox, machines
from test_machines import DECISIONS, EVENTS, T0, machine, play


def test_variants_of_a_bucket_have_states_of_their_own(spark):
    rng = random.Random(8)
    rows = [(f"v{rng.randrange(40)}", rng.choice("xy"), rng.choice(["A", "B", None]), T0 + timedelta(minutes=7 * i), i) for i in range(900)]
    first, rest = rows[:200], rows[200:]
    keys = ["lab_vendor", "observed_text"]
    batch = lambda part: learning.collisions(spark.createDataFrame(part, EVENTS), keys, "analyte_id", ["ts", "id"])
    seed = batch(first).selectExpr("lab_vendor", "observed_text", "validated AS analyte_id", "confirmations", "collision_count AS collisions", "last_collision")
    rng.shuffle(rest)
    beat = [(None, None, None, T0 + timedelta(days=40), -1)]
    got = machine(spark, [rest, beat], initial=seed, buckets=2)
    last = {(r["lab_vendor"], r["observed_text"]): (r["confirmations"], r["collisions"], r["last_collision"], r["status"]) for r in got}
    want = {(r["lab_vendor"], r["observed_text"]): (r["confirmations"], r["collision_count"], r["last_collision"]) for r in batch(rows).collect()}
    moved = {(r[0], r[1]) for r in rest}
    assert moved <= set(last) <= set(want)
    status = lambda hits: "STABLE" if not hits else "COLLIDED" if hits <= 2 else "RECOVERED"
    assert last == {v: (*want[v], status(want[v][1])) for v in last}
    assert machines.BUCKETS > 2


def test_vendor_states_of_a_bucket(spark, tmp_path):
    """Two batches over two buckets, null names among them, against a plain loop."""
    rng = random.Random(9)
    kind = "lab_vendor string, observed_text string, analyte_id string, ts timestamp"
    rows = [(rng.choice(["v", "w", None]), f"x{rng.randrange(12)}", rng.choice(["A", "B", None]), T0 + timedelta(minutes=11 * i)) for i in range(400)]
    want: dict = {}
    for v, x, a, _ in rows:
        was, n, hits = want.get((v, x), (None, 0, 0))
        want[v, x] = (a, n + 1, hits + (was is not None and a != was))
    got: dict = {}
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(rng.sample(part, len(part)), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = inbox.vendor_states(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), buckets=2)
        inbox.run_once(stream, str(tmp_path / "state"), each=lambda df, i: got.update({(r[0], r[1]): tuple(r)[2:5] for r in df.collect()}), mode="update")
    assert got == want


def test_first_forms_of_a_bucket(spark):
    """Known forms and those of earlier batches stay out; of a batch the first row by time passes."""
    rows = [(i, f"a{i % 3}", f"n{i % 5}", True, 0.5, T0 + timedelta(hours=i)) for i in range(40)]
    known = spark.createDataFrame([("a0", "n0"), ("a1", "n1")], "analyte_id string, norm string")
    out, got = new_path(spark), []
    keep = lambda df, i: got.extend(r["id"] for r in df.collect())
    play(spark, [rows[6:0:-1], rows[:0:-1]], DECISIONS, lambda s: machines.first_forms(s, known, buckets=1), out, "append", keep)
    assert sorted(got) == list(range(2, 15))
