"""Truncated names against a plain search, and the lookup cache over several runs."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillgrid.operators import lookup_cache, prefix_join
from quillgrid.operators.lookup_cache import LookupCache
from quillgrid.storage import new_path


def plain(text, names):
    def shared(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    most = max((shared(text, n) for n in names), default=0)
    return (text, most, min((n for n in names if shared(text, n) == most), key=lambda n: (len(n), n)) if most else None)


@pytest.mark.parametrize("rows", [20_000, 7, 1], ids=["one_range", "ranges", "tiny_ranges"])
def test_truncated_names(spark, monkeypatch, rows):
    monkeypatch.setattr(prefix_join, "RANGE_ROWS", rows)
    monkeypatch.setattr(prefix_join.cuts, "__defaults__", ("name", rows))
    rng = random.Random(4)
    names = sorted({"".join(rng.choices("abé😀 ", k=rng.randint(1, 9))) for _ in range(120)} | {"a", "", "zzz"})
    texts = sorted({n[: rng.randint(0, len(n))] + rng.choice(["", "", "x", "é"]) for n in names} | {"", "q", "zzzzz", "\U0010ffff"})
    df = lambda values, c: spark.createDataFrame([(v,) for v in [*values, None, values[0]]], f"{c} string").repartition(3)
    got = [tuple(r) for r in prefix_join.complete(df(texts, "text"), df(names, "name")).collect()]
    assert sorted(got, key=str) == sorted((plain(t, names) for t in texts), key=str)
    met = [(r["prefix"], r["name"]) for r in prefix_join.starting_with(spark.createDataFrame([(t,) for t in texts], "prefix string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    assert sorted(met) == sorted((t, n) for t in texts for n in names if n.startswith(t))


def test_no_names_and_no_texts(spark):
    none = lambda c: spark.createDataFrame([], f"{c} string")
    some = spark.createDataFrame([("abc",)], "text string")
    assert [tuple(r) for r in prefix_join.complete(some, none("name")).collect()] == [("abc", 0, None)]
    assert prefix_join.complete(none("text"), some.withColumnRenamed("text", "name")).count() == 0


def test_least_letters(spark):
    names = spark.createDataFrame([("benzene",), ("benzoic acid",)], "name string")
    texts = spark.createDataFrame([("benz",), ("be",), ("toluene",), ("benzo x",)], "text string")
    assert {tuple(r) for r in prefix_join.complete(texts, names, 4).collect()} == {("benz", 4, "benzene"), ("be", 2, None), ("toluene", 0, None), ("benzo x", 5, "benzoic acid")}


def registry_client():
    """A client that tasks get by value; it fails for one key."""

    def ask(keys):
        if any(k == "broken" for k in keys):
            raise OSError("no answer")
        return [{"numbers": [f"n-{k}"], "synonyms": [f"{k} two", "DTXSID1", "x" * 200]} if k != "unknown" else None for k in keys]

    return ask


registry = registry_client()


def at(day):
    return F.lit(day).cast("timestamp")


def test_what_was_asked_is_not_asked_again(spark):
    cache = LookupCache(spark, new_path(spark), found_days=100, missing_days=10, batch=1, tasks=2, retries=1, pause=0.0)
    asked = spark.createDataFrame([(" Benzene",), ("benzene",), ("unknown",), ("broken",), (None,), ("",)], "key string")

    def refuses(keys):
        raise AssertionError(keys)

    first = {r["key"]: r for r in cache.look_up(asked, registry, at("2024-01-01")).collect()}
    assert set(first) == {"benzene", "unknown"} and first["benzene"]["found"] and not first["unknown"]["found"]
    assert first["benzene"]["numbers"] == ["n-benzene"] and first["unknown"]["numbers"] == []
    # Only what failed is asked for again, and nothing comes of it.
    again = {r["key"] for r in cache.look_up(asked, refuses, at("2024-01-02")).collect()}
    assert again == set(first) and cache.entries().count() == 2
    # What was not found expires first.
    cache.look_up(asked, registry, at("2024-02-01"))
    cache.look_up(asked, registry, at("2024-05-01"))
    counts = {r["key"]: r["count"] for r in cache.entries().groupBy("key").count().collect()}
    assert counts == {"benzene": 2, "unknown": 3}
    assert {r["fetched_at"] for r in cache.fresh(at("2024-01-05")).collect()} == {datetime(2024, 1, 1)}


def test_learned_synonyms(spark):
    cache = LookupCache(spark, new_path(spark), pause=0.0)
    known = cache.look_up(spark.createDataFrame([("Benzol",), ("toluol",), ("unknown",)], "key string"), registry, at("2024-01-01"))
    analytes = spark.createDataFrame([("A2", "n-benzol"), ("A1", "n-benzol"), ("A3", "other")], "analyte_id string, cas_number string")
    synonyms = spark.createDataFrame([("A3", "n-toluol", "n toluol"), ("A3", "Toluol", "toluol")], "analyte_id string, synonym_raw string, synonym_norm string")
    got = {tuple(r) for r in lookup_cache.learned_synonyms(known, analytes, synonyms).collect()}
    # The normal form parts what may be a descriptor from the letter after it.
    assert got == {("A1", "benzol", "be nz ol"), ("A1", "benzol two", "be nz ol two"), ("A3", "toluol two", "toluol two")}
