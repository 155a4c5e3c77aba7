"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import corpus_pipeline
from brute import WORD, contamination, language, language_profiles, line_dedup, simhash, targets
from zlib import crc32

from quillgrid.llm.common import table


def test_pipeline(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").collect()]
    items = [(str(i), t) for i, t in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    profiles = language_profiles([(t, lang) for d, t, lang, _ in rows if crc32(str(d).encode()) % 4 != 2])
    rows = [r for r in rows if (x := language(r[1], profiles))[0] != "und" and x[1] >= corpus_pipeline.LEAST_SCORE]
    cleaned = [(d, t, lang, source) for (d, t, _, _), (_, _, lang, source) in zip(line_dedup([r[:2] for r in rows]), rows, strict=True)]
    stays = {d for d, _, c in simhash([r[:2] for r in cleaned]) if d == c}
    cleaned = [r for r in cleaned if r[0] in stays]
    bad = {r[0] for r in contamination([r[:2] for r in cleaned], items) if r[-1]}
    cleaned = [r for r in cleaned if r[0] not in bad]
    got = corpus_pipeline.run(spark, sf_dir).collect()
    size = {d: len(WORD.findall(t)) for d, t, *_ in cleaned}
    assert {(r["doc_id"], r["size"]) for r in got} == set(size.items())
    by_source = {}
    for d, _, _, s in cleaned:
        by_source[s] = by_source.get(s, 0) + size[d]
    goal = targets(by_source)
    assert all(abs(r["target"] - goal[r["source"]]) < 1e-6 for r in got)


def test_stages_keep_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(30)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema.simpleString() == docs.schema.simpleString(), name


def test_near_copies_with_null_and_shared_ids(spark):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(1, word(1)), (2, word(1)), (2, word(2)), (3, word(3)), (3, word(4)), (None, word(5)), (None, word(6)), (None, word(6)), (None, word(1))]
    want = [(None, word(5)), (None, word(6)), (1, word(1)), (2, word(2)), (3, word(3)), (3, word(4))]
    order = lambda r: (r[0] or 0, r[1])
    for more in ([], [(9, word(9))], [(9, word(9))] * 2):
        docs = spark.createDataFrame(rows + more, "doc_id long, text string")
        got = [tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
        assert sorted(got, key=order) == sorted(want + more[:1], key=order)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, hash int, `key` string, taken int, shard long, doc int"
STAGES = dict(corpus_pipeline.STAGES)


def odd_rows():
    word = lambda k, n=60: " ".join(f"wort{k}x{i}" for i in range(n))
    block = "\n".join(word(900 + i, 5) for i in range(8))
    rows = [(1, word(1)), (1, word(1)), (1, word(2)), (2, word(1)), (None, word(3)), (None, word(3)), (None, word(4)), (None, None), (3, None), (4, ""), (5, "... !!!"), (6, f"{word(5)}\n{block}"), (None, f"{block}\n{word(6)}"), (7, word(7, 40_000)), (8, word(8, 14))]
    return [(d, t, "de", [None, "a", "b"][i % 3], len(t or ""), 0.5, "x", 1, "k", 2, 3, 4) for i, (d, t) in enumerate(rows)]


def frames(spark, tmp_path):
    spark.createDataFrame([("i1", " ".join(f"wort8x{i}" for i in range(13))), ("i2", None)], "item_id string, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3), spark.createDataFrame([], SCHEMA), str(tmp_path)


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, ids with several texts, very long texts, and columns with the operators' names."""
    docs, empty, where = frames(spark, tmp_path)
    rows = [tuple(r) for r in docs.collect()]
    order = lambda x: sorted(((r[0], r[1], r[3]) for r in x), key=str)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, empty, where)
        assert none.count() == 0, name
        found = stage(spark, docs, where)
        if name != "source_mix":
            assert found.schema.simpleString() == docs.schema.simpleString() == none.schema.simpleString(), name
        out[name] = found.collect()
    assert order(out["language_id"]) == order(r for r in rows if r[1] and "wort" in r[1])
    lines = {(r["doc_id"], r["n_chars"]): r["text"] for r in out["line_dedup"]}
    assert len(out["line_dedup"]) == len(rows) and sum(r["text"] is None for r in out["line_dedup"]) == 2
    block = next(t.split("\n", 1)[1] for _, t, *_ in odd_rows() if t and t.startswith("wort5x"))
    assert [block in (t or "") for (d, _), t in lines.items() if d == 6] == [True] and sum(block in (r["text"] or "") for r in out["line_dedup"]) == 1
    assert all(r["n_chars"] == len(r["text"] or "") for r in out["line_dedup"])
    # One of each text stays; null, empty and unlettered texts are no words or words of their own.
    near = out["simhash_near_dedup"]
    assert sorted(str(r["doc_id"]) for r in near if r["text"] and r["text"].startswith("wort1x")) == ["1"]
    assert sum(not r["text"] for r in near) == 1 and len({r["text"] for r in near}) == len(near) == len({r[1] or "" for r in rows})
    assert order(out["decontaminate"]) == order(r for r in rows if r[0] != 8)
    mixed = out["source_mix"]
    assert sorted((str(r["doc_id"]), r["size"]) for r in mixed) == sorted((str(r[0]), len(WORD.findall(r[1] or ""))) for r in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)


def test_run_on_an_empty_table(spark, tmp_path):
    _, empty, where = frames(spark, tmp_path)
    empty.write.parquet(f"{where}/documents.parquet")
    assert corpus_pipeline.run(spark, where).count() == 0
