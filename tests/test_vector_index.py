"""The vector index against all pairs, before and after appends, and hashed n-grams against a plain version."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgrid.operators import matching, vector_index
from quillgrid.operators.vector_index import Index

KIND = "vector_id long, analyte_id string, vector array<double>"


def clustered(n, groups=12, dim=8, seed=1, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return (centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))) * rng.uniform(0.5, 3, size=(n, 1))


def rows(x, start=0):
    return [(start + i, f"A{(start + i) % 7}", v.tolist()) for i, v in enumerate(x)]


def nearest(x, q, k):
    u = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    s = np.round(u(q) @ u(x).T, 12)
    return {(i, int(j), r + 1) for i in range(len(q)) for r, j in enumerate(sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k])}


def found(index, q, k):
    asked = index.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "input_id long, vector array<double>")
    return {(r["input_id"], r["vector_id"], r["rank"]) for r in index.search(asked, k).collect()}


@pytest.mark.parametrize(("vectors", "queries"), [(8192, 2048), (16, 5)], ids=["whole", "blocks"])
def test_search_equals_all_pairs(spark, monkeypatch, vectors, queries):
    monkeypatch.setattr(vector_index, "BLOCK_VECTORS", vectors)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", queries)
    x, q = clustered(300), np.concatenate([clustered(20, seed=2), np.random.default_rng(3).normal(size=(6, 8))])
    x[10:14] = x[9]  # ties
    index = vector_index.build(spark.createDataFrame(rows(x[:200]), KIND))
    assert found(index, q, 4) == nearest(x[:200], q, 4)
    before = {r["cell"]: r["radius"] for r in index.statistics().collect()}
    index.append(spark.createDataFrame(rows(x[200:], 200), KIND))
    again = Index(spark, index.path)
    assert found(again, q, 4) == nearest(x, q, 4)
    after = {r["cell"]: (r["radius"], r["n"]) for r in again.statistics().collect()}
    assert sum(n for _, n in after.values()) == 300 and all(after[c][0] >= r for c, r in before.items())


def test_an_append_far_from_all_centroids_is_found(spark):
    x = clustered(100, groups=3, spread=0.01)
    far = -x[:3] + 0.2
    index = vector_index.build(spark.createDataFrame(rows(x), KIND)).append(spark.createDataFrame(rows(far, 100), KIND))
    assert found(index, far, 2) == nearest(np.concatenate([x, far]), far, 2)


def test_cells_are_left_unread(spark):
    x, q = clustered(600, groups=20, spread=0.02), clustered(30, groups=20, spread=0.02)
    index = vector_index.build(spark.createDataFrame(rows(x), KIND))
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "input_id long, vector array<double>")
    top, read = index.probe(asked, 3)
    cells = index.statistics().count()
    assert {(r["input_id"], r["vector_id"], r["rank"]) for r in top.collect()} == nearest(x, q, 3)
    assert read.count() == read.distinct().count() < 0.5 * cells * len(q)


def test_vectors_without_direction(spark):
    odd = [(100, "z", [0.0, 0.0]), (101, "n", None), (102, "m", [None, 1.0]), (103, "i", [float("inf"), 1.0]), (104, "w", [float("nan"), 1.0]), (105, "l", [1.0, 2.0, 3.0])]
    good = [(i, "a", [1.0, float(i)]) for i in range(8)]
    index = vector_index.build(spark.createDataFrame(good + odd, KIND))
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, 2.0, 3.0]), (4, [5.0, 0.1])], "input_id long, vector array<double>")
    got = [(r["input_id"], r["vector_id"]) for r in index.search(asked, 20).collect()]
    assert sorted(set(i for i, _ in got)) == [0, 4] and len(got) == 16 and all(v < 8 for _, v in got)


def test_empty_index(spark):
    index = vector_index.build(spark.createDataFrame([], KIND))
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "input_id long, vector array<double>")
    assert index.search(asked, 3).count() == 0


def test_semantic_match_is_one_plan_for_any_query_set(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_VECTORS", 10)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 4)
    x, q = clustered(60, groups=3), clustered(23, groups=3, seed=4)
    vectors = spark.createDataFrame(rows(x) + [(900, "short", [1.0])], KIND)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(50, [2.0]), (51, None)], "input_id long, vector array<double>")
    top = matching.match_semantic(queries, vectors, -1.0, 3)
    assert top._jdf.queryExecution().analyzed().toString().count("Union") == 0
    got = Counter((r["input_id"], r["rank"]) for r in top.collect())
    assert set(got.values()) == {1} and len(got) == 23 * 3 + 1
    u = lambda m: m / np.sqrt((m * m).sum(1))[:, None]
    assert matching.match_semantic(queries, vectors, 0.5, None).count() == int((u(q) @ u(x).T >= 0.5).sum()) + 1


def test_hashed_grams(spark):
    texts = ["benzene", "toluene", "b", "", None, "bb bb bb"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    idf = vector_index.document_frequencies(df, "id", "t", 16)
    got = {r["id"]: r["vector"] for r in vector_index.vectorise(df, "id", "t", idf, 16).collect()}

    def plain(t):
        out = [0.0] * 16
        p = f" {t} "
        for i in range(len(p) - 2):
            h = int(hashlib.md5(p[i : i + 3].encode()).hexdigest()[:8], 16)
            out[h % 16] += 1 if h // 16 % 2 == 0 else -1
        return [x * idf.get(i, 1.0) for i, x in enumerate(out)]

    assert set(got) == {0, 1, 5} and all(got[i] == pytest.approx(plain(texts[i])) for i in got)
    assert spark.createDataFrame([("bb bb bb",)], "t string").select(F.length("t")).first()[0] == 8


def test_ids_of_queries_may_be_texts(spark):
    from quillgrid.operators import matching

    v = spark.createDataFrame([(i, f"A{i}", [float(i == j) for j in range(4)]) for i in range(4)], "vector_id long, analyte_id string, vector array<double>")
    q = v.selectExpr("concat('q', vector_id) AS input_id", "vector")
    got = {(r["input_id"], r["analyte_id"]) for r in matching.match_semantic(q, v, 0.5, 2).collect()}
    assert got == {(f"q{i}", f"A{i}") for i in range(4)}
    assert {(r["input_id"], r["vector_id"]) for r in vector_index.build(v, cells=2).search(q, 1).collect()} == {(f"q{i}", i) for i in range(4)}
