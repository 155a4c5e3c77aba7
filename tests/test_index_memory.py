"""Queries that lie far from all vectors need every cell; they are sent to groups of cells, and no copy a cell is made."""

from __future__ import annotations

import numpy as np
import pytest

from quillgrid.operators import vector_index


@pytest.mark.parametrize("block", [40, 8_192])
def test_far_queries(spark, monkeypatch, block):
    monkeypatch.setattr(vector_index, "BLOCK_VECTORS", block)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 24)), rng.normal(size=(20, 24))
    index = vector_index.build(spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vector_id long, analyte_id string, vector array<double>"))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "input_id long, vector array<double>")
    assert index._bounds(asked.withColumnRenamed("vector", "q"), 4).columns == ["input_id", "cell", "low", "first"]
    sims = (q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.linalg.norm(x, axis=1)[:, None]).T
    want = {(i, int(j), r + 1) for i, row in enumerate(sims) for r, j in enumerate(np.argsort(-row)[:4])}
    assert {(r["input_id"], r["vector_id"], r["rank"]) for r in index.search(asked, 4).collect()} == want
