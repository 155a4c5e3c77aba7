"""Fill-in-the-middle and importance resampling against plain versions and on odd inputs."""

from __future__ import annotations

import random

import pytest
from brute import fim as plain_fim
from brute import fim_units, resampled, sha
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_corpus_operators import SCHEMA, frame, make, tables

from quillgrid.llm import fim, resampling
from quillgrid.llm import queries as q

ODD = [(None, "no id at all"), (None, None), (-5, "x <P> y"), (7, "a<S"), (7, "a<S"), (8, "é😀 a😀b\n\n"), (9, ""), (10, "<"), (11, "<M"), (12, "zz\x00z9"), (13, "\U00010400abc" * 40)]


@pytest.fixture(scope="module")
def rows():
    return make(random.Random(3))


def test_fim(spark, rows, monkeypatch):
    held = [(d, t) for d, t, *_ in rows] + ODD
    docs = spark.createDataFrame([(d, t, "en", "a", 1, "x", 1, "y", "z", 0.5) for d, t in held], SCHEMA).repartition(3)
    tables(monkeypatch, documents=docs)
    got = [tuple(r) for r in q.op11_fim(spark, "").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted((plain_fim(d, t) for d, t in held), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


SAME = {
    "letters": (fim.LETTERS, lambda a, b: (a + b).isascii() and (a + b).isalpha()),
    "words": (fim.WORDS, lambda a, b: a not in " \n\t" or b in " \n\t"),
    "lines": (fim.LINES, lambda a, b: a != "\n"),
    "characters": (fim.CHARACTERS, lambda a, b: False),
}


@pytest.mark.parametrize("name", SAME)
def test_grammars(spark, name):
    grammar, joined = SAME[name]
    rng = random.Random(4)
    texts = ["", "\n", "a", "😀", *("".join(rng.choices("abZ 1\n\t.é😀", k=rng.randint(1, 40))) for _ in range(80))]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", fim.units(F.col("text"), grammar).alias("u")).collect()
    for r in got:
        assert r["u"] == fim_units(r["text"], joined) and "".join(r["u"]) == r["text"]


def test_formats_restore(spark):
    """Every text comes back, also with sentinels of one's own and texts made of their parts."""
    how = fim.Format("~a", "~c", "~dd", plain_from=95, spm_below=50)
    rng = random.Random(5)
    texts = ["".join(rng.choices("~acd b", k=rng.randint(0, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = fim.transform(docs, fim.CHARACTERS, how)
    got = {r["doc_id"]: r for r in out.withColumn("back", fim.restore(F.col("output"), F.col("form"), how)).collect()}
    assert all(got[i]["back"] == t for i, t in enumerate(texts)) and {r["form"] for r in got.values()} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "<S<", "<M>"), ("<P>", "[S]", "<M>")])
def test_sentinels_that_cannot_be_told_apart(marks):
    with pytest.raises(ValueError):
        fim.Format(*marks)


def test_resampling(spark, rows, monkeypatch):
    held = [(d, t) for d, t, *_ in rows] + ODD + [(50, "one two three " * 30)] * 3
    aims = [(0, rows[5][1]), (1, None), (2, ""), (3, rows[8][1] and rows[8][1][:200])]
    docs = spark.createDataFrame([(d, t, "en", "a", 1, "x", 1, "y", "z", 0.5) for d, t in held], SCHEMA).repartition(3)
    tables(monkeypatch, documents=docs, benchmark=spark.createDataFrame(aims, "item_id long, text string"))
    got = [tuple(r) for r in q.op12_resample(spark, "").collect()]
    want = [(d, n, w, s, r) for d, _, n, w, s, r in resampled(held, [t for _, t in aims])]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in want)))


@pytest.mark.parametrize("order", [2, 3])
def test_resampling_by_longer_grams(spark, rows, order, monkeypatch):
    """n-grams of several orders, few buckets, slices of one text each."""
    monkeypatch.setattr(resampling, "SLICE", 1)
    held, aims = [(d, t) for d, t, *_ in rows[:40]] + ODD, [rows[5][1], "a b"]
    plan = resampling.Plan(order=order, buckets=64, percent=30, least_words=3)
    found = resampling.resample(spark.createDataFrame(held, "doc_id long, text string").repartition(2), spark.createDataFrame([(t,) for t in aims], "text string"), plan)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(resampled(held, aims, order, 64, 30, 3), key=key)


def test_no_target_and_no_documents(spark, rows):
    docs, none = frame(spark, rows[:30]), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).count() == 0 and resampling.resample(none, none).count() == 0
    got = [tuple(r) for r in resampling.resample(docs, none).collect()]
    assert sorted(got, key=str) == sorted(resampled([r[:2] for r in rows[:30]], []), key=str)


def test_ranks_of_equal_rows(spark):
    """Ranks are 1 to n whatever repeats, and rows in order of the key have rising ranks."""
    from quillgrid.llm.common import materialise

    rng = random.Random(2)
    rows = [(rng.randrange(5) if i % 3 else 2, rng.randrange(3)) for i in range(2000)]
    held = materialise(spark.createDataFrame(rows, "a long, b long").repartition(5))
    got = sorted(resampling.ranked(held, F.desc("a"), F.col("b")).collect(), key=lambda r: r["__qg_rank"])
    assert [r["__qg_rank"] for r in got] == list(range(1, 2001))
    assert [(-r["a"], r["b"]) for r in got] == sorted((-a, b) for a, b in rows)


@given(st.text(alphabet="abc \n<PSM>é", max_size=30))
@settings(max_examples=80, deadline=None)
def test_outputs_hold_each_sentinel_once(text):
    """Where a text holds no sentinel, three parts around any cuts bring each sentinel in once."""
    if any(m in text for m in fim.Format().sentinels):
        return
    for a in range(0, len(text) + 1, 3):
        out = f"<P>{text[:a]}<S>{text[a:]}<M>{text[:a]}"
        assert all(out.count(m) == 1 for m in ("<P>", "<S>", "<M>")), (sha(text), out)
