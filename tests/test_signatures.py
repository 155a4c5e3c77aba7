"""The signature join against all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillgrid.functions.similarity import lcs_length
from quillgrid.operators import learning, matching, signatures


def names(rng, n):
    parts = ["benz", "tol", "chloro", "ane", "ol", "2,4-", "meth", "é", " ", "yl", "aaaa", "z" * 30]
    out = {"", "a", "ab", "z" * 60, *("".join(rng.choices(parts, k=rng.randint(1, 7))) for _ in range(n))}
    return sorted(out | {x[:2] + x[3:] for x in out if rng.random() < 0.5})


def ratio(a, b):
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a and b else 0.0


@pytest.mark.parametrize("least", [0.95, 0.8, 0.6, 0.3])
@pytest.mark.parametrize("grid", [4000, 3], ids=["plain", "grid"])
def test_no_pair_is_lost_or_repeated(spark, monkeypatch, least, grid):
    monkeypatch.setattr(signatures, "GRID_ROWS", grid)
    a, b = names(random.Random(1), 40), names(random.Random(2), 50)
    left, right = (spark.createDataFrame([(x, i) for i, x in enumerate(side)] + [(None, -1)], f"{n}_t string, {n}_i int").repartition(3) for n, side in (("a", a), ("b", b)))
    got = [(r["a_i"], r["b_i"]) for r in signatures.candidates(left, right, "a_t", "b_t", least).collect()]
    assert len(got) == len(set(got))
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if ratio(x, y) >= least}
    assert want <= set(got)
    # What the bounds let through beside them is little where the ratio is high.
    if least >= 0.95:
        assert len(got) <= 3 * len(want) + 50


def test_plan_has_no_nested_loop(spark):
    left, right = spark.createDataFrame([("benzene",)], "a string"), spark.createDataFrame([("benzen",)], "b string")
    plan = signatures.candidates(left, right, "a", "b", 0.8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize(("longest", "least"), [(1, 0.5), (40, 0.73), (300, 0.9)])
def test_bands_hold_every_pair_of_lengths(longest, least):
    held = signatures.bands(longest)
    assert [x for a, b in held for x in range(a, b + 1)][:longest] == list(range(1, longest + 1))
    pairs = {(i, j): (common, k) for i, j, common, k in signatures.band_pairs(longest, least)}
    band = {x: i for i, (a, b) in enumerate(held) for x in range(a, b + 1)}
    for m in range(1, longest + 1):
        for n in range(1, longest + 1):
            if 2 * min(m, n) >= least * (m + n):
                common, k = pairs[band[m], band[n]]
                assert k <= common <= max(1, -int(-least * (m + n) // 2))


def test_fuzzy_match_with_the_vendors_boost(spark, monkeypatch):
    """The vendor's synonym is less alike by less than the boost, and wins; on signatures as by broadcast."""
    synonyms = spark.createDataFrame([(1, "A1", "dichlorobenzene number one two", None), (2, "A2", "dichlorobenzene number one twox", "LAB"), (3, "A3", "toluene", None)], "synonym_id long, analyte_id string, synonym_norm string, lab_vendor string")
    inputs = spark.createDataFrame([(1, "dichlorobenzene number one two!", "LAB"), (2, "dichlorobenzene number one two!", None)], "input_id long, norm string, vendor string")
    for rows in (200_000, 0):
        monkeypatch.setattr(matching, "CORPUS_ROWS", rows)
        found = {(r["input_id"], r["rank"]): r["analyte_id"] for r in matching.match_fuzzy(inputs, synonyms).collect()}
        assert found == {(1, 1): "A2", (1, 2): "A1", (2, 1): "A1", (2, 2): "A2"}, rows


def test_pairs_of_one_table(spark, monkeypatch):
    held = [x for x in names(random.Random(5), 40)]
    keys = spark.createDataFrame([(x, i) for i, x in enumerate(held)], "t string, k int").select(F.struct("k", "t").alias("key"))
    want = sorted((a, b) for a in range(len(held)) for b in range(a + 1, len(held)) if ratio(held[a], held[b]) >= 0.7)
    for rows in (50_000, 0):
        monkeypatch.setattr(learning, "CORPUS_ROWS", rows)
        assert sorted((r["a"]["k"], r["b"]["k"]) for r in learning.indel_pairs(keys, 0.7).collect()) == want
