"""The best product of each group with each query, against plain loops."""

from __future__ import annotations

import random

import pytest

from quillgrid.operators import vector_index


@pytest.mark.parametrize("rows", [2, 5_000])
def test_best_by_group(spark, monkeypatch, rows):
    """Blocks of any size; null groups, null and short vectors, ids that come twice, a query that has no product."""
    monkeypatch.setattr(vector_index, "BLOCK_VECTORS", rows)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", rows)
    rng = random.Random(2)
    vector = lambda n=3: [rng.uniform(-1, 1) for _ in range(n)]
    vectors = [(i, rng.choice([None, "a", "b"]), vector()) for i in range(40)] + [(40, "c", None), (41, "c", [1.0, None, 0.0]), (42, "d", vector(2)), (1, "b", vector()), (43, "e", [float("nan")] * 3)]
    queries = [(i, vector()) for i in range(7)] + [(7, None), (8, vector(2))]
    v = spark.createDataFrame(vectors, "vector_id long, kind string, vector array<double>")
    q = spark.createDataFrame(queries, "input_id string, vector array<double>")
    got = {(r["input_id"], r["kind"]): r["sim"] for r in vector_index.best_by_group(q, v, "kind").collect()}
    assert len(got) == 9 * 6
    whole = lambda x: x is not None and None not in x
    for i, x in queries:
        for kind in (None, "a", "b", "c", "d", "e"):
            sims = [sum(p * r for p, r in zip(x, y, strict=True)) for _, k, y in vectors if k == kind and whole(x) and whole(y) and len(x) == len(y)]
            held = got[str(i), kind]
            assert (held is None) if not sims else held == pytest.approx(max(sims), abs=1e-12, nan_ok=True)


def test_closest_by_label_compares_in_blocks(spark, sf_dir):
    from quillgrid.plans import catalogue

    plan = catalogue.QUERIES["closest_by_label"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
