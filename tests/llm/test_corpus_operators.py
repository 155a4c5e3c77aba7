"""Operators against plain versions and on odd inputs."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from brute import alnum, base_phrases, chunks, contamination, fingerprint, language, language_profiles, licence_evidence, line_dedup, sha, simhash, substrings, targets, text_features
from hypothesis import example, given, settings
from hypothesis import strategies as st

from quillgrid.llm import chat, decontaminate, kernels, langid, licenses, linededup, mixing, quality, vectors
from quillgrid.llm import queries as q
from quillgrid.llm import simhash as sh
from quillgrid.llm import substrings as sub
from quillgrid.llm.common import join_hot
from quillgrid.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, hash int, size string, u string, fp double"


def make(rng, n=60):
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts and repeated rows."""
    vocabulary = ["".join(rng.choices("abcdéß", k=rng.randint(1, 7))) for _ in range(150)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    passage, lines = text(70), "\n".join(text(9) for _ in range(8))
    rows = []
    for i in range(n):
        t = text(rng.choice([0, 1, 2, 12, 60, 150, 300]))
        if i % 5 == 1:
            t = f"{t} {passage} {text(5)}"
        if i % 7 == 2:
            t = f"{t}\n{lines}\n{text(4)}"
        if i % 9 == 3:
            t += "\nReleased under the MIT License. SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0)\n"
        if i % 6 == 4:
            t = rows[rng.randrange(len(rows))][1]
        if i % 11 == 5 and t:
            t = t.replace(" ", "  ", 3) + " tail"
        rows.append((i, t, ["en", "fr", None][i % 3], [None, "a", "b", "B"][i % 4], len(t or "")))
    rows += [(n, None, "en", "a", 0), (n + 1, "", "fr", None, 0), (n + 2, text(40_000), "en", "a", 1), (n + 3, "a " * 400, "en", "b", 1), (n + 4, "a " * 300, "fr", "b", 1), (n + 5, "!!! ... \t\n", "fr", "c", 1)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make(random.Random(3))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 0.5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tables(monkeypatch, **held):
    monkeypatch.setattr(q, "table", lambda spark, sf_dir, name: held[name])


@given(st.lists(st.text(alphabet="ab Zé\n\x00#9-", max_size=30), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_kernels(texts):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([None, *texts])], names=["text"])
    got = []
    for _, _, data, offs in kernels.text_slices(batch, "text", 8):
        data = kernels.LOWER_BYTES[data]
        starts, ends, first = kernels.word_spans(data, offs, kernels.ALNUM)
        words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
        h = kernels.word_hashes(data, starts, ends)
        assert len(set(words)) == len(set(h.tolist()))
        got += [words[a:b] for a, b in zip(first, first[1:], strict=False)]
        for width in (2, 3, 5):
            windows = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
            assert len(set(windows)) == len(set(kernels.window_hashes(h, width).tolist()))
    assert got == [alnum(t) for t in [None, *texts]]


def test_long_words_hash():
    data = np.frombuffer(b"a" * 600 + b" " + b"a" * 601 + b" " + b"a" * 600, np.uint8)
    s, e, _ = kernels.word_spans(data, np.array([0, len(data)]), kernels.NONSPACE)
    h = kernels.word_hashes(data, s, e)
    assert h[0] == h[2] != h[1]


def test_licenses(docs, rows):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        n, found = base_phrases(text)
        r = got[doc]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert (r["first_word"], r["last_word"]) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    tagged = next(r for r in got.values() if r["expressions"])
    assert tagged["expressions"][0] == "MIT GPL-2.0-only Classpath-exception-2.0 WITH OR" and "gpl" in tagged["labels"]


LICENCES = ["mit license", "apache license", "lesser general public license", "cc by", "cc by nc sa", "CC-BY-SA-4.0", "\nSPDX-License-Identifier: ", "MIT", "Apache-2.0", "(", ")", "AND", "or", "WITH", "Classpath-exception-2.0", "LicenseRef-x", "see", "NONE", "GPL-3.0-only", "word", "\n"]


@given(st.lists(st.sampled_from(LICENCES), max_size=14))
@settings(max_examples=150, deadline=None)
def test_licence_evidence(parts):
    text = " ".join(parts)
    got = licenses.scan_text(text.encode())
    labels, score = licence_evidence(text, licenses.NOTICE_PHRASES, licenses.RESTRICTION, licenses.family, licenses.is_identifier)
    assert (got["labels"], got["score"]) == (labels, pytest.approx(score))


def test_words_that_name_no_licence():
    label = lambda x: licenses.scan_text(f"SPDX-License-Identifier: {x}".encode())["labels"]
    assert label("see the file") == label("NOASSERTION") == "" and label("MIT as stated") == "mit" and label("LicenseRef-Own") == "licenseref-own" and label("Artistic-2.0 OR FTL") == "artistic,ftl"


@pytest.mark.parametrize(("text", "level"), [("MIT OR GPL-3.0", 1), ("MIT AND GPL-3.0", 3), ("GPL-2.0 WITH Classpath-exception-2.0", 2), ("(MIT OR GPL-3.0) AND MPL-2.0", 2), ("MIT OR GPL-3.0 AND MPL-2.0", 1), ("MIT and", 1)])
def test_expressions(text, level):
    assert licenses.evaluate(licenses.to_rpn(text))[1] == level


@pytest.mark.parametrize("text", ["", "AND", "(MIT", ")", "OR MIT"])
def test_expressions_without_value(text):
    assert licenses.evaluate(licenses.to_rpn(text)) is None


def test_mixing(spark, docs, rows):
    from brute import WORD

    got = mixing.mix(mixing.size_documents(docs)).collect()
    again = mixing.mix(mixing.size_documents(docs.repartition(7))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    goal = targets(sizes)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["source_size"] == sizes[s] and mine[0]["target"] == pytest.approx(goal[s], rel=1e-9)
        assert abs(sum(r["taken"] for r in mine) - goal[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
        assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in mine)


def test_inclusion(spark):
    """Certain documents and shares as filled one size after the other; expected words are those that remain."""
    rng = random.Random(11)
    rows = [(s, size, rng.randint(1, 30)) for s in (None, "a", "b") for size in rng.sample(range(1, 5000), 25)] + [("c", 7, 100), ("d", 9, 3)]
    words = {s: sum(size * n for t, size, n in rows if t == s) for s in (None, "a", "b", "c", "d")}
    rest = {None: 0.99 * words[None], "a": 0.3 * words["a"], "b": 0.7 * words["b"], "c": 0.5 * words["c"], "d": 0.0}
    df = spark.createDataFrame([(*r, float(rest[r[0]])) for r in rows], "source string, size long, n long, rest double").repartition(3)
    got = {r["source"]: (r["most"], r["share"]) for r in mixing.inclusion(df).collect()}
    for s in words:
        mine, left, free = sorted((x[1:] for x in rows if x[0] == s), reverse=True), rest[s], None
        for k, (size, _) in enumerate(mine):
            free = mine[k:]
            share = left / sum(x * round(x**0.5 * 1024) * n for x, n in free)
            if share * round(size**0.5 * 1024) <= 1:
                break
            left -= size * mine[k][1]
        assert got[s] == (free[0][0], pytest.approx(share))
        most, share = got[s]
        assert sum(size * n * (1 if size > most else share * round(size**0.5 * 1024)) for size, n in mine) == pytest.approx(rest[s])


def test_mix_keeps_other_columns(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 7, "r", 1, 2.0) for i in range(50)], "doc_id long, source string, size long, _rank string, taken int, rest double")
    got = mixing.mix(df)
    assert sorted(got.columns) == sorted([*df.columns, "source_size", "target"]) and got.filter("_rank = 'r' AND rest = 2.0").count() == 50


@given(st.dictionaries(st.sampled_from([None, "a", "b", "é", "z", "Z", ""]), st.integers(0, 1000), min_size=1))
@example({None: 1, "a": 1, "b": 0, "é": 0})
@example({"a": 10, "b": 1000, "z": 2, None: 10})
@settings(max_examples=8, deadline=None)
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").coalesce(1)
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(targets(sizes))


def test_decontaminate(spark, docs, rows, monkeypatch):
    items = [(1, rows[1][1][:200]), (2, rows[6][1]), (3, "one two"), (4, None), (5, "..."), (6, " ".join(rows[12][1].split()[:20])), (2, rows[6][1]), (10, "a")]
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, n_hit string")
    tables(monkeypatch, documents=docs, benchmark=bench)
    got = {tuple(r) for r in q.op3_decontaminate(spark, "").collect()}
    assert got == set(contamination([r[:2] for r in rows], [(str(i), t) for i, t in items]))


def test_benchmark_beyond_a_block(spark, docs, rows, monkeypatch):
    """Many blocks and pieces give what one gives; only one block is held at a time."""
    items = [(i, rows[i % 25][1][: 40 + 13 * i]) for i in range(60)] + [(99, "a"), (98, "a b"), (97, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set(contamination([r[:2] for r in rows], [(str(i), t) for i, t in items]))
    monkeypatch.setattr(decontaminate, "BLOCK", 400)
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    monkeypatch.setattr(decontaminate, "SHARD", 4000)
    assert sum(1 for _ in decontaminate.query_blocks(bench)) > 5
    tables(monkeypatch, documents=docs, benchmark=bench)
    assert {tuple(r) for r in q.op3_decontaminate(spark, "").collect()} == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "the quick red brown fox jumps"), (2, "quick x x x x x brown"), (3, "quick brown fox")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "quick brown fox")], "item_id long, text string")
    index, blocks = decontaminate.build_index(docs), decontaminate.query_blocks(items)
    found = lambda slop: {r["doc_id"] for r in decontaminate.matches(index, blocks, slop).collect() if r["n_matches"]}
    assert found(0) == {3} and found(1) == {1, 3}


def test_chat_round_trip(spark, monkeypatch):
    rng = random.Random(5)
    odd = ["", None, "\\", "### Assistant: </turn>", "\\### x </turn>\n### User: ", "a\n\nb", "</turn>\n", "é" * 50, "word " * 900]
    turns = []
    for conv in [*range(12), None]:
        for k in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant", "system", None, "to:ol\n#"]) if k else rng.choice(["system", "user"])
            turns.append((conv, rng.choice([k, k, None]), role, rng.choice([*odd, "some words here " * rng.randint(1, 60)])))
    turns += turns[:3]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, window string").repartition(4)
    tables(monkeypatch, conversations=df)
    got = {r["conv_id"]: r for r in q.op4_chat_format(spark, "").collect()}
    want = {}
    for c, t, r, x in [*turns, *q.PROBE]:
        want.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    assert set(got) == set(want)
    for conv, held in want.items():
        held = [(r[1], x[1]) for _, r, x in sorted(held)]
        loss = "".join(x for r, x in held if r == "assistant")
        row = got[conv]
        assert row["n_turns"] == len(held)
        assert row["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for r, x in held))
        assert (row["loss_chars"], row["loss_sha256"]) == (len(loss), sha(loss))
    windows = chat.format_windows(df, 300, 80).collect()
    assert sum(len(w["formatted"]) for w in chat.format_windows(df).collect()) == sum(r["formatted_chars"] for k, r in got.items() if k != -7)
    for w in windows:
        turns_ = chat.read_window(w["formatted"])
        assert w["n_repeated"] < len(turns_)
        sizes = [chat.count_tokens(x) + chat.count_tokens(r) + 3 for r, x in turns_]
        assert w["n_tokens"] == sum(sizes)
        # Beyond the budget only with a turn that is so itself, and then beside the system turn at most.
        assert w["n_tokens"] <= 300 or (sizes[-1] > 300 and len(turns_) - w["n_repeated"] == 1 and w["n_repeated"] <= 1)
    stored = spark.createDataFrame(sorted(windows, key=lambda w: (w["window"], str(w["conv_id"])), reverse=True), chat.SCHEMA).repartition(5)
    again = {r["conv_id"]: tuple(r)[:5] for r in chat.read_back(stored).collect()}
    assert again == {k: tuple(r)[:5] for k, r in got.items() if k != -7}


def test_history_gives_way_to_turns_that_fit():
    def windows(*turns, budget=300, history=80):
        held, out = chat.Windows(budget, history, len), []
        for role, n in turns:
            out += held.add(role, "x" * (n - len(role) - 3))
        return [(w[1], w[2]) for w in [*out, held.close()]]

    assert windows(("system", 24), ("user", 60), ("assistant", 264)) == [(0, 84), (1, 288)]
    assert windows(("system", 24), ("user", 270), ("user", 70), ("assistant", 150)) == [(0, 294), (1, 244)]
    assert windows(("system", 24), ("user", 250), ("user", 40), ("user", 40), ("assistant", 230)) == [(0, 274), (1, 104), (2, 294)]
    assert windows(("system", 24), ("user", 200), ("assistant", 290)) == [(0, 224), (0, 290)]
    assert windows(("system", 24), ("user", 200), ("assistant", 400)) == [(0, 224), (1, 424)]


@given(st.text(max_size=60), st.text(max_size=20))
@settings(max_examples=100, deadline=None)
def test_escape(text, role):
    line = chat.HEAD + chat.escape(role, chat._ROLE) + chat.MIDDLE + chat.escape(text) + chat.TAIL
    assert chat.read_window(line * 2) == [(role, text)] * 2


def test_language(spark, docs, rows):
    learned = [(t, lang) for d, t, lang, *_ in rows]
    profiles, plain = langid.train(docs), language_profiles(learned)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, profiles).collect()}
    for doc, text, *_ in rows:
        lang, score = language(text, plain)
        assert got[doc][0] == lang and got[doc][1] == pytest.approx(score)
    kept = langid.identify(docs, profiles, least=0.0)
    assert kept.columns == docs.columns and kept.count() == sum(v[0] != "und" for v in got.values())


def test_language_held_out(spark, sf_dir):
    got = q.op5_language_id(spark, sf_dir).join(q.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got) > 0


@pytest.mark.parametrize(("cap", "queries"), [(vectors.CAP, vectors.QUERIES), (150, 60)], ids=["whole", "pieces_and_slices"])
def test_vectors(spark, monkeypatch, cap, queries):
    monkeypatch.setattr(vectors, "CAP", cap)
    monkeypatch.setattr(vectors, "QUERIES", queries)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16))
    near = np.repeat(x, 8, axis=0) + rng.normal(size=(320, 16)) * rng.choice([0.05, 0.2, 0.3], size=(320, 1))
    held = [list(map(float, v)) for v in near] + [list(map(float, near[0]))] * 30 + [[2 * float(a) for a in near[5]]]
    held += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.01]]
    order = rng.permutation(len(held)).tolist()
    df = spark.createDataFrame([(i, held[k], "e") for i, k in enumerate(order)], "vec_id long, embedding array<double>, node string").repartition(5)
    tables(monkeypatch, embeddings=df)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in q.op6_embedding_dedup(spark, "").collect()}
    from brute import union

    fine = {i: np.array(held[k]) for i, k in enumerate(order) if held[k] and all(a is not None and np.isfinite(a) for a in held[k]) and any(held[k])}
    pairs = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / np.sqrt((fine[a] @ fine[a]) * (fine[b] @ fine[b])) >= 0.95]
    n = {i: 0 for i in range(len(order))}
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    roots = union(pairs, range(len(order)))
    found = sum(v[0] for v in got.values())
    assert 0.98 * sum(n.values()) <= found <= sum(n.values())
    assert all(got[i][0] <= n[i] for i in n) and np.mean([got[i][1] == roots[i] for i in n]) >= 0.99
    assert all(v[2] == (i == v[1]) for i, v in got.items())


def test_vectors_where_the_search_fails(spark, monkeypatch):
    """A search that finds nothing fails the audit, which looks until it sees links; then all is compared, in pieces."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8))
    x[-12:] = x[:12] + 0.01
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(5, list(map(float, x[7]))), (None, list(map(float, x[7]))), (2000, [1e200] * 8), (2001, [1e-200] * 8), (2002, None)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(vectors, "search", lambda x, lists, entries, q, *a: np.zeros((len(q), len(x)), bool))
    monkeypatch.setattr(vectors, "AUDIT", 16)
    monkeypatch.setattr(vectors, "TRIES", 1)
    monkeypatch.setattr(vectors, "CAP", 200)
    monkeypatch.setattr(vectors, "QUERIES", 300)
    nodes = vectors.distinct_vectors(df)
    assert vectors.audit(nodes, vectors._link(nodes, 0.95, 1, 4), size=16) == 0
    got = {(r["vec_id"], r["n_links"], r["component_id"]) for r in vectors.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    links = near.sum(axis=1) - 1 + near[:, 7]  # vec_id 5 has the vector of 7 as well: their links add up
    assert {(i, n) for i, n, _ in got if i not in (5, 7, None) and i < 900} == {(i, int(links[i])) for i in range(900) if i not in (5, 7)}
    assert {(2000, 0, 2000), (2001, 0, 2001), (2002, 0, 2002), (None, 0, None)} <= got


def test_audit_of_a_table_without_links(spark, monkeypatch):
    """The sample stays bounded; planted neighbours tell a search that works from one that finds nothing."""
    x = np.random.default_rng(8).normal(size=(700, 16))
    df = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(x)] + [(1000 + i, [0.0] * 16) for i in range(300)], "vec_id long, embedding array<double>")
    nodes = vectors.distinct_vectors(df)
    seen = []
    real = vectors._seen
    monkeypatch.setattr(vectors, "_seen", lambda nodes, linked, sample, cosine: (seen.append(len(sample)), real(nodes, linked, sample, cosine))[1])
    link = lambda df: vectors._link(df, 0.95, 2, 40)
    assert vectors.audit(nodes, link(nodes), size=16, links=40, most=64, again=link) >= 0.9 and seen == [16, 64, 40]
    plants = vectors.planted(nodes, nodes.limit(20).collect(), 0.95)
    of = {r["node"]: np.array(r["x"]) for r in nodes.collect()}
    best = [max(float(np.array(p[3]) @ v / np.linalg.norm(p[3]) / np.linalg.norm(v)) for v in of.values()) for p in plants]
    assert len(plants) == 20 and min(best) >= 0.95 and max(p[0] for p in plants) < min(of)
    monkeypatch.setattr(vectors, "search", lambda x, lists, entries, q, *a: np.zeros((len(q), len(x)), bool))
    assert vectors.audit(nodes, link(nodes), size=16, links=40, most=64, again=link) < 0.1
    got = {tuple(r) for r in vectors.near_duplicates(df).collect()}
    assert got == {(i, 0, i, True) for i in [*range(700), *range(1000, 1300)]}


def test_substrings(spark, docs, rows, monkeypatch):
    tables(monkeypatch, documents=docs)
    monkeypatch.setattr(sub, "SHARD", 2000)
    assert {tuple(r) for r in q.op7_substring_dedup(spark, "").collect()} == set(substrings([r[:2] for r in rows]))


def packed(*texts):
    raw = [t.encode() for t in texts]
    return sub.Shard(np.arange(len(raw)).tobytes(), np.array([len(x) for x in raw]).tobytes(), __import__("zstandard").compress(b"".join(raw)))


@given(st.data())
@settings(max_examples=25, deadline=None)
def test_equal_windows_have_equal_phrases(data):
    """The parse of a repeated window agrees in its inner part, whatever stands around it: one phrase, at one place."""
    letters = data.draw(st.sampled_from(["ab", "abc", "abcdefgh"]))
    word = st.text(alphabet=letters, min_size=1, max_size=1)
    window = data.draw(st.lists(word, min_size=50, max_size=50))
    seen = set()
    for _ in range(4):
        left, right = (data.draw(st.lists(word, max_size=30)) for _ in range(2))
        s = packed(" ".join([*left, *window, *right]))
        q = sub.Phrases(s)
        k = int(q.least(np.array([len(left)]), len(s.words))[0])
        seen.add((int(q.left[k]), int(q.right[k]), int(q.start[k]) - len(left), int(q.end[k]) - len(left)))
        assert sub.MARGIN <= q.start[k] - len(left) and q.end[k] - len(left) <= sub.WINDOW - sub.MARGIN
    assert len(seen) == 1


def test_phrases_name_what_they_hold():
    """Phrases of equal definitions hold equal words, and the other way round where symbols start alike."""
    rng = random.Random(8)
    s = packed(" ".join(rng.choices("abc", k=3000)), " ".join(rng.choices("ab", k=3000)))
    q, words = sub.Phrases(s), [s.raw[a:b] for a, b in zip(s.starts, s.ends, strict=True)]
    held = {}
    for left, right, a, b in zip(q.left.tolist(), q.right.tolist(), q.start.tolist(), q.end.tolist(), strict=True):
        held.setdefault((left, right), set()).add(b" ".join(words[a:b]))
    assert all(len(x) == 1 for x in held.values()) and len(held) < len(q.key)


def test_shards_lie_in_the_buckets_of_their_numbers(spark, docs):
    from pyspark.sql import functions as F

    x = np.array([0, 1, -1, 5 << 32, (7 << 32) | 9, 2**63 - 1, -(2**63)])
    got = spark.createDataFrame([(int(i),) for i in x], "x long").select(F.hash("x")).collect()
    assert kernels.spark_hash(x).tolist() == [r[0] for r in got]
    plan = sub.remove_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning(shard") == plan.count("Exchange ") == 1


def test_substrings_of_odd_ids(spark, monkeypatch):
    """The largest long is an id like any other; null comes after the others and is no repeat of itself."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(2**63 - 1, text), (None, text), (-(2**63), text), (None, text), (3, None), (4, "")]
    tables(monkeypatch, documents=spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, shard string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in q.op7_substring_dedup(spark, "").collect()), key=str)
    assert got == sorted([(2**63 - 1, 60, 60), (None, 60, 60), (-(2**63), 60, 0), (None, 60, 60), (3, 0, 0), (4, 0, 0)], key=str)
    tables(monkeypatch, documents=spark.createDataFrame([(None, text), (2**63 - 1, text)], "doc_id long, text string"))
    assert {r["n_removed"] for r in q.op7_substring_dedup(spark, "").collect()} == {0}


def test_quality(spark, sf_dir):
    got = q.op8_quality(spark, sf_dir).join(q.table(spark, sf_dir, "labels"), "doc_id").collect()
    held = [(r["score"], r["quality"]) for r in got if r["held_out"]]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) >= 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_quality_features(rows):
    import pyarrow as pa

    texts = [r[1] for r in rows if r[1] is None or len(r[1]) < 5000] + ["| a | B |", "x" * 30 + " END. why?! $$ 12\n\nx\nx", "\n", "é É"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = np.concatenate([quality.features(data, offs) for _, _, data, offs in kernels.text_slices(batch, "text", 3000)])
    assert got == pytest.approx(np.array([text_features(t) for t in texts]))


def test_quality_repeated_ids(spark, rows, monkeypatch):
    """Rows of one id are all scored; labels that repeat or disagree, null ids and ties in the sample change no count."""
    docs = frame(spark, [*rows[:20], *rows[:5], (None, *rows[1][1:]), (None, *rows[2][1:])])
    labels = spark.createDataFrame([(i % 10, i % 3 % 2, "x") for i in range(60)] + [(None, 1, "x")], "doc_id long, quality int, text string")
    tables(monkeypatch, documents=docs, labels=labels)
    first, again = (sorted(map(tuple, q.op8_quality(spark, "").collect()), key=str) for _ in range(2))
    assert len(first) == 27 and first == again and all(0 <= r[2] <= 1 for r in first)
    small = quality.train(docs, labels.select("doc_id", "quality"), sample=7)
    assert quality.score(docs, small).count() == 27


def test_quality_odd(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, one)).count() == len(rows)
    x = np.random.default_rng(0).normal(size=(400, 3))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    m = quality.fit(x, y)
    assert np.mean((m.score(x) >= 0.5) == y) > 0.85 and (0, 1) in m.pairs


def test_simhash(spark, docs, rows, monkeypatch):
    tables(monkeypatch, documents=docs)
    assert {tuple(r) for r in q.op9_simhash(spark, "").collect()} == simhash([r[:2] for r in rows])
    assert sh.fingerprint("Ab cd  EF gh".encode()) == fingerprint("ab cd ef GH")


@pytest.mark.parametrize("split", [4096, 20])
def test_links_lose_none(split, monkeypatch):
    monkeypatch.setattr(sh, "SPLIT", split)
    rng = random.Random(2)
    values = set()
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 40)):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    v = np.array(sorted(values), np.uint64)
    from brute import union

    pairs = [(a, b) for i, a in enumerate(v.tolist()) for b in v.tolist()[i + 1 :] if (a ^ b).bit_count() <= 2]
    got = [(int(a), int(b)) for u, r in sh._link_large(v, frozenset(), 2) for a, b in zip(u, r, strict=True)]
    assert union(got, v.tolist()) == union(pairs, v.tolist())


@pytest.mark.parametrize("hot", [1024, 2], ids=["dealt_once", "hot_buckets_dealt_again"])
def test_links_of_buckets(spark, hot, monkeypatch):
    """Fingerprints that share half their bits, some of them all but a byte, against all pairs."""
    monkeypatch.setattr(sh, "SPLIT", 30)
    monkeypatch.setattr(sh, "HOT", hot)
    rng = random.Random(6)
    values = {(0xABCD1234 << 32 | rng.getrandbits(32)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {0x7F0011FFABCD0000 | rng.getrandbits(10) for _ in range(200)}
    values |= {v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in sorted(values)[::3]}
    from brute import union

    v = sorted(values)
    pairs = [(a, b) for i, a in enumerate(v) for b in v[i + 1 :] if (a ^ b).bit_count() <= 2]
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in v], "fp long").repartition(3)
    got = [(r["u"] % 2**64, r["v"] % 2**64) for r in sh.links(nodes).collect()]
    assert union(got, v) == union(pairs, v)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(500, k) for k in range(501, 560)]
    from brute import union

    want = union(edges, {x for e in edges for x in e})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_components_of_a_hub_among_many(spark):
    """The hub is beyond the share from which a key is hot, the other nodes are below it."""
    edges = [(7, k) for k in range(10_000, 13_000)] + [(k, k + 1) for k in range(20_000, 23_000, 3)] + [(12_999, 22_999), (5, 5)]
    from brute import union

    want = union(edges, {x for e in edges for x in e})
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {k: got.get(k, k) for k in want} == want


def test_join_hot(spark):
    rows = [(1, i) for i in range(3000)] + [(k, k) for k in range(2, 1500)] + [(None, 1), (9000, 1)]
    few = [(1, "hot", 3000), *((k, f"v{k}", 1) for k in range(2, 1500)), (9001, "none", 0)]
    left, right = spark.createDataFrame(rows, "k long, x long"), spark.createDataFrame(few, "k long, name string, n long")
    names = {k: name for k, name, _ in few}
    want = sorted((k, x, names[k]) for k, x in rows if k in names)
    assert sorted(map(tuple, join_hot(left, right, "k", 4500).collect())) == want
    assert join_hot(left.limit(0), right, "k", 0).count() == 0


def test_line_dedup(spark, docs, rows, monkeypatch):
    tables(monkeypatch, documents=docs)
    got = {tuple(r) for r in q.op10_line_dedup(spark, "").collect()}
    want = {(d, n, gone, sha(t or "")) for d, t, n, gone in line_dedup([r[:2] for r in rows])}
    assert got == want and any(r[2] for r in got)


@given(st.data())
@settings(max_examples=30, deadline=None)
def test_chunks(data):
    """Chunks as a plain version cuts them; no layer leaves out a line."""
    lines = data.draw(st.lists(st.sampled_from([b"a", b"b", b"", b"cc", "é".encode()]), min_size=1, max_size=90))
    assert set(linededup.Lines(b"\n".join(lines)).chunks()) == chunks(lines)


def test_chunks_resist_shifts():
    rng = random.Random(1)
    lines = [f"line {rng.random()}" for _ in range(60)]

    def bodies(x):
        held = linededup.Lines("\n".join(x).encode())
        return {held.body(a, b) for a, b in held.chunks()}

    a, b = bodies(lines), bodies(["new", *lines[:30], "other", *lines[30:]])
    assert len(a & b) >= 0.8 * len(a)


def test_repeated_passages_go_whole(spark):
    """Passages of six lines between lines of their own; a run of one line; a repeat within one text."""
    rng = random.Random(9)
    own = lambda k: [f"own {rng.random()}" for _ in range(k)]
    passages = [own(6) for _ in range(40)]
    first = [(i, "\n".join([*own(3), *p, *own(2)])) for i, p in enumerate(passages)]
    second = [(100 + i, "\n".join([*own(4), *p, *own(5)])) for i, p in enumerate(passages)]
    run = [(200, "\n".join([*own(2), *["same"] * 100, *own(2)]))]
    within = own(9)
    self_repeat = [(201, "\n".join([*within, *own(3), *within]))]
    rows = [*first, *second, *run, *self_repeat, (None, "\n".join(within)), (None, "\n".join(within)), (300, None), (301, ""), (302, "\n\n\n"), (303, "\n\n\n")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, `key` int").repartition(3)
    got = {r["key"]: r for r in linededup.dedup_lines(docs).collect()}
    plain = line_dedup(rows)
    # Rows of one id and text are one document here, two in the plain version.
    assert all((got[i]["text"], got[i]["__qg_n_removed"]) == (t, gone) for i, (d, t, _, gone) in enumerate(plain))
    removed = [got[i]["__qg_n_removed"] for i in range(40, 80)]
    assert all(got[i]["__qg_n_removed"] == 0 for i in range(40)) and removed == [6] * 40
    assert got[80]["__qg_n_removed"] == 98 and got[81]["__qg_n_removed"] == 9


@pytest.mark.parametrize("size", [2, 3, 4, 10])
def test_short_passages_go_whole(spark, size):
    """Every copy but the first of a passage of two lines or more goes, and no line of its surroundings."""
    rng = random.Random(size)
    own = lambda k: [f"own {rng.random()}" for _ in range(k)]
    passages = [own(size) for _ in range(80)]
    rows = [(100 * copy + i, "\n".join([*own(1 + i % 4), *p, *own(i % 3)])) for copy in range(2) for i, p in enumerate(passages)]
    got = {r["doc_id"]: r["__qg_n_removed"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == 0 and got[100 + i] == size for i in range(80))


def test_one_key_of_two_texts(spark):
    """Places of one key are told apart by their bytes, and those that occur once are no repeats."""
    from pyspark.sql import functions as F

    rows = [(1, 10, 0, 2, b"a\nb"), (2, 20, 4, 2, b"c\nd"), (3, 30, 1, 2, b"a\nb"), (4, 40, 0, 2, b"c\nd"), (5, 50, 0, 2, b"e\nf")]
    detail = spark.createDataFrame(rows, "doc_id long, text_key long, place int, lines int, chunk binary").withColumn("key", F.struct(F.lit(7).alias("k1"), F.lit(8).alias("k2")))
    more = spark.createDataFrame([(6, 60, 3, 2, b"g\nh"), (None, 70, 5, 2, b"g\nh")], detail.drop("key").schema).withColumn("key", F.struct(F.lit(9).alias("k1"), F.lit(8).alias("k2")))
    got = {(r["doc_id"], r["place"], r["first"]["doc_id"]) for r in linededup.met_again(detail.unionByName(more)).collect()}
    assert got == {(1, 0, 1), (3, 1, 1), (2, 4, 2), (4, 0, 2), (6, 3, 6), (None, 5, 6)}


def test_repeated_rows(spark, rows, monkeypatch):
    twice = frame(spark, rows[:25] + rows[:25])
    tables(monkeypatch, documents=twice, benchmark=spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    for f in (q.op1_license_scan, q.op2_source_mix, q.op3_decontaminate, q.op5_language_id, q.op7_substring_dedup, q.op9_simhash, q.op10_line_dedup):
        assert f(spark, "").count() == 50, f.__name__


def test_null_ids(spark, rows, monkeypatch):
    some = frame(spark, rows[:20]).unionByName(frame(spark, [(None, *r[1:]) for r in rows[:4]]))
    tables(monkeypatch, documents=some, benchmark=spark.createDataFrame([(None, "a b")], "item_id long, text string"))
    for f in (q.op1_license_scan, q.op2_source_mix, q.op3_decontaminate, q.op5_language_id, q.op7_substring_dedup, q.op9_simhash, q.op10_line_dedup):
        assert f(spark, "").count() == 24, f.__name__


def test_empty_tables(spark, empty, monkeypatch):
    tables(
        monkeypatch, documents=empty, benchmark=spark.createDataFrame([], "item_id long, text string"), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"), embeddings=spark.createDataFrame([], "vec_id long, embedding array<float>"),
    )
    for name, f in q.QUERIES.items():
        assert f(spark, "").count() == (1 if name.startswith("op4_") else 0), name


def test_digest_of_no_items():
    assert decontaminate.digest([]) == hashlib.sha256(b"").hexdigest()
