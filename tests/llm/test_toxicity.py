"""Deobfuscation and toxicity scores against plain versions, on disguised words and on odd inputs."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from test_corpus_operators import frame, make, tables

from quillgrid.llm import queries as q
from quillgrid.llm import toxicity as tox

CORPUS = "the stupid idiot and the worthless clown say that the loser has trash in the room of the house over there " * 40


@pytest.fixture(scope="module")
def cost():
    return tox.costs(tox.trigram_counts(CORPUS))


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain_trigrams(text):
    out = Counter()
    for word in re.findall(r"[a-z\x80-\U0010ffff]+", lower(text)):
        s = [0, 0, *(tox._symbol(c) for c in word), 0]
        out.update(zip(s, s[1:], s[2:], strict=False))
    return out


@given(st.text(alphabet="abzZ é😀\n.1", max_size=40))
@settings(max_examples=100, deadline=None)
def test_trigram_counts(text):
    got = tox.trigram_counts(text)
    want = plain_trigrams(text)
    n = tox.SYMBOLS
    assert {(c // n // n, c // n % n, c % n): int(got[c]) for c in np.flatnonzero(got)} == dict(want)


def test_characters_are_counted_over_all_texts(spark):
    rows = make(random.Random(8), 40)
    want = sum((plain_trigrams(t or "") for _, t, *_ in rows), Counter())
    got = tox.count_characters(frame(spark, rows).repartition(3))
    assert int(got.sum()) == want.total() and np.count_nonzero(got) == len(want)


def path_cost(readings, cost):
    text, total, s = "".join(t for t, _ in readings), sum(c for _, c in readings), 0
    for c in text + " ":
        if c == " ":
            total += cost[s * tox.SYMBOLS] if s else 0
            s = 0
        else:
            total += cost[s * tox.SYMBOLS + tox._symbol(c)]
            s = s % tox.SYMBOLS * tox.SYMBOLS + tox._symbol(c)
    return total


@given(st.text(alphabet="idot10! .$é", min_size=1, max_size=7))
@settings(max_examples=150, deadline=None)
@example("i d i o t")
@example("1dioott!")
def test_viterbi_finds_the_cheapest_of_all_paths(span):
    cost = tox.costs(tox.trigram_counts(CORPUS)).tolist()
    text, paid = tox.decode(span, cost)
    paths = list(itertools.product(*tox.lattice(span)))
    best = min(path_cost(p, cost) for p in paths)
    assert paid == pytest.approx(best)
    assert any(" ".join("".join(t for t, _ in p).split()) == " ".join(text.split()) and path_cost(p, cost) == pytest.approx(best) for p in paths)


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("the 1d10t is here", "the idiot is here"), ("that $tup1d clown", "that stupid clown"), ("so s t u p i d !", "so stupid"), ("you i.d.i.o.t, go", "you idiot go"), ("l-o-s-e-r", "loser"),
        ("stuuuupid idioooot", "stupid idiot"), ("TR@SH", "trash"), ("w0rthle55 house", "worthless house"), ("id*ot", "idiot"), ("c l 0 w n", "clown"), ("plain words stay", "plain words stay"), ("", ""), ("12 345", "12 345"),
    ],
)
def test_restores(cost, text, words):
    got = tox.Restorer(cost).text(text)
    assert re.findall(r"[a-z0-9\x80-\U0010ffff]+", got) == words.split()


@given(st.lists(st.text(alphabet="aab1 !.o0dité\n", max_size=14), min_size=1, max_size=6))
@settings(max_examples=120, deadline=None)
@example(["a b", "c d"])
@example(["a", "b", "c"])
@example(["", "aa", ""])
def test_texts_are_restored_each_on_its_own(texts):
    """A slice of texts gives each what it gets alone: no run crosses a border, offsets follow."""
    restorer = tox.Restorer(tox.costs(tox.trigram_counts(CORPUS)))
    held = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in held])])
    new, at = restorer.restore(data, offs)
    assert [new[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)] == [restorer.text(t) for t in texts]


def test_features_of_words_and_beginnings():
    data = np.frombuffer("stupid aé stupids".encode(), np.uint8)
    row, h, n = tox.features(data, np.array([0, 7, len(data)]))
    assert n.tolist() == [1, 2] and set(row.tolist()) == {0, 1}
    # "stupid" as a word is not "stupid" as a beginning; the two words share the beginnings of 4 and 5 bytes.
    assert len(set(h[row == 0].tolist()) & set(h[row == 1].tolist())) == 2


def test_toxicity_held_out(spark, monkeypatch):
    from quillgrid.llm.common import table

    where = "/root/testdata/sf0.01"
    docs = table(spark, where, "documents")
    tables(monkeypatch, documents=docs, labels=table(spark, where, "labels"))
    got = {r["doc_id"]: r for r in q.op13_toxicity(spark, "").collect()}
    marked = {r["doc_id"]: r["toxic"] for r in table(spark, where, "labels").collect()}
    held = [d for d in marked if got[d]["held_out"]]
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert np.mean([got[d]["predicted"] == marked[d] for d in held]) > 0.95
    assert not any(got[d]["predicted"] for d in held if not marked[d])


@pytest.fixture(scope="module")
def few(spark):
    rng = random.Random(2)
    words = CORPUS.split()
    bad = ["stupid", "idiot", "worthless", "clown"]
    clean = [w for w in words if w not in (*bad, "loser", "trash")]
    rows = [(i, " ".join([*rng.choices(clean, k=30), *(rng.sample(bad, 2) if i % 4 == 0 else [])])) for i in range(120)]
    return rows, [(i, int(i % 4 == 0)) for i in range(120)]


def test_disguises_score_like_plain_words(spark, few):
    rows, marks = few
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = tox.train(docs, labels)
    forms = ["stupid", "$tup1d", "s t u p i d", "s.t.u.p.i.d", "stuuuupiiiid", "STUPID", "st*pid"]
    odd = [(i, f"the room of the {w} house") for i, w in enumerate(forms)] + [(90, "the room of the house over there"), (91, None), (92, ""), (None, "the idiot"), (93, "the\x00house " * 3000)]
    got = {r["doc_id"]: r["score"] for r in tox.score(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()}
    assert all(got[i] >= 0.5 for i in range(len(forms))) and got[None] >= 0.5
    assert got[91] == got[92] == got[90] < 0.5 and got[93] < 0.5
    restored = {r["doc_id"]: r["restored"] for r in tox.restored_texts(spark.createDataFrame(odd, "doc_id long, text string"), model.cost).collect()}
    assert all("stupid" in restored[i] for i in range(len(forms))) and restored[91] == ""


def test_models_repeat(spark, few):
    rows, marks = few
    labels = spark.createDataFrame([*marks, *marks[:30], (5, None), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*rows, *rows[:20], (None, "idiot")], "doc_id long, text string")
    a, b = tox.train(docs.repartition(2), labels), tox.train(docs.repartition(5), labels)
    assert a.intercept == b.intercept and np.array_equal(a.keys, b.keys) and np.array_equal(a.weights, b.weights)
    assert tox.train(docs, labels, sample=50).intercept != a.intercept


def test_no_labels_one_class_no_texts(spark, few):
    rows, marks = few
    docs, none = spark.createDataFrame(rows[:10], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    score = lambda labels: {round(r["score"], 5) for r in tox.score(docs, tox.train(docs, labels)).collect()}
    assert score(none) == {0.5}
    assert score(none.unionByName(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))) == {0.0}
    assert score(none.unionByName(spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))) == {1.0}
    assert tox.score(docs.limit(0), tox.train(docs.limit(0), none)).count() == 0


def test_clashing_columns_and_repeats(spark, monkeypatch):
    rows = make(random.Random(3), 20)
    tables(monkeypatch, documents=frame(spark, rows + rows[:5]), labels=spark.createDataFrame([(i, i % 2, 1, "x") for i in range(20)], "doc_id long, toxic int, quality int, text string"))
    assert q.op13_toxicity(spark, "").count() == len(rows) + 5
