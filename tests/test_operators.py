"""Cascade, changes, learning, extraction, files and streams."""

from __future__ import annotations

import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillgrid import schema
from quillgrid.config import Thresholds
from quillgrid.functions.names import normalise
from quillgrid.operators import extraction, learning, matching, mutations, reports
from quillgrid.sources import files
from quillgrid.streaming import inbox

SYNONYMS = {
    "V1": ["Benzene", "benzol", "71-43-2"], "V2": ["Toluene", "methylbenzene", "toluol"], "V3": ["Ethylbenzene", "ethyl benzene"], "V4": ["Xylenes (total)", "Total Xylenes", "Xylenes, total"],
    "P1": ["PHC F1", "F1", "Fraction 1", "C6-C10"], "P2": ["PHC F2", "F2", "F2 (C10-C16)"], "M1": ["Arsenic", "As", "Arsenic, total"], "M2": ["Lead", "Pb"],
    "M3": ["Chromium", "Cr", "Chrome"], "M4": ["Chromium VI", "Chromium (VI)", "Hexavalent Chromium", "Cr(VI)"], "N1": ["Naphthalene", "Napthalene"], "N2": ["Benzo(a)pyrene", "BaP", "Benzo[a]pyrene"],
}
NUMBERS = {"V1": "71-43-2", "V2": "108-88-3", "V3": "100-41-4"}


@pytest.fixture(scope="module")
def registry(spark):
    analytes = spark.createDataFrame([(k, v[0], NUMBERS.get(k)) for k, v in SYNONYMS.items()], "analyte_id string, preferred_name string, cas_number string")
    rows = [(k, s) for k, v in SYNONYMS.items() for s in v]
    synonyms = spark.createDataFrame([(i, k, s, None) for i, (k, s) in enumerate(rows)], "synonym_id long, analyte_id string, synonym_raw string, lab_vendor string")
    return analytes, synonyms.withColumn("synonym_norm", normalise(F.col("synonym_raw")))


CASCADE = {
    "Benzene": ("V1", "exact", 1.0, 1.0, "AUTO_ACCEPT", False), "BENZENE": ("V1", "exact", 1.0, 1.0, "AUTO_ACCEPT", False), "Ethyl Benzene": ("V3", "exact", 1.0, 1.0, "AUTO_ACCEPT", False),
    "Benzen": ("V1", "fuzzy", 0.941176, 1.0, "AUTO_ACCEPT", False), "Toluenne": ("V2", "fuzzy", 0.941176, 1.0, "AUTO_ACCEPT", False), "Xylene (total)": ("V4", "fuzzy", 0.928571, 1.0, "REVIEW", False),
    "Arsnic": ("M1", "fuzzy", 0.875, 1.0, "REVIEW", False), "Benzeen": ("V1", "fuzzy", 0.842105, 1.0, "REVIEW", False), "Leed": ("M2", "fuzzy", 0.8, 1.0, "REVIEW", False),
    "Chromium 6": ("M3", "fuzzy", 0.84, 0.030435, "REVIEW", True), "PHC F3": ("P1", "fuzzy", 0.833333, 0.0, "REVIEW", True), "Toluene, total": ("V4", "fuzzy", 0.758621, 1.0, "REVIEW", False),
    "Mystery Chemical X": (None, None, None, 0.0, "UNKNOWN", False), "CAS 108-88-3": ("V2", "cas_extracted", 1.0, 1.0, "AUTO_ACCEPT", False),
}


def test_cascade(spark, registry):
    analytes, synonyms = registry
    df = spark.createDataFrame([(t,) for t in [*CASCADE, "Benzene"]], "input_text string")
    got = {r["input_text"]: r for r in matching.resolve(matching.distinct_inputs(df), analytes, synonyms).collect()}
    assert set(got) == set(CASCADE)
    for text, (analyte, method, confidence, margin, band, disagreement) in CASCADE.items():
        r = got[text]
        assert (r["analyte_id"], r["method"], r["band"], r["disagreement"]) == (analyte, method, band, disagreement), text
        assert r["confidence"] == (None if confidence is None else pytest.approx(confidence, abs=1e-6)), text
        assert r["margin"] == pytest.approx(margin, abs=1e-6), text


def test_cascade_phases(spark, registry):
    analytes, synonyms = registry
    inputs = matching.distinct_inputs(spark.createDataFrame([("benz thing", "v"), ("Odd Name", None), ("vector only", None)], "input_text string, vendor string"), vendor="vendor")
    cache = spark.createDataFrame([("v", "be nz thing", "V1", 0.95, False)], "lab_vendor string, observed_text string, analyte_id string, confidence double, stale boolean")
    lookup = spark.createDataFrame([("odd name", ["1-11-4", "108-88-3"])], "key string, numbers array<string>")
    q = inputs.filter("input_text = 'vector only'").select("input_id", F.array(F.lit(1.0), F.lit(0.2)).alias("vector"))
    v = spark.createDataFrame([(1, "M1", [1.0, 0.1]), (2, "M2", [0.0, 1.0])], "vector_id long, analyte_id string, vector array<double>")
    got = {r["input_text"]: r for r in matching.resolve(inputs, analytes, synonyms, cache, lookup, q, v).collect()}
    assert [(got[k]["analyte_id"], got[k]["method"]) for k in ("benz thing", "Odd Name", "vector only")] == [("V1", "vendor_cache"), ("V2", "api"), ("M1", "semantic")]


def test_fuzzy_blocks_equal_broadcast(spark, registry, monkeypatch):
    analytes, synonyms = registry
    inputs = matching.distinct_inputs(spark.createDataFrame([(t,) for t in CASCADE], "input_text string"))
    want = sorted(map(str, matching.match_fuzzy(inputs, synonyms).collect()))
    monkeypatch.setattr(matching, "CORPUS_ROWS", 3)
    assert sorted(map(str, matching.match_fuzzy(inputs, synonyms).collect())) == want


def test_changes(spark, registry):
    analytes, synonyms = registry
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id int, v string, t int")
    b = spark.createDataFrame([(2, "z", 1), (3, "w", 0)], "id int, v string, t int")
    assert {tuple(r) for r in mutations.upsert(a, b, ["id"], "t").collect()} == {(1, "x", 1), (2, "z", 1), (3, "w", 0)}
    assert [r["id"] for r in mutations.append_new(a, b.union(b), ["id"]).collect()] == [3]
    assert {r["v"] for r in mutations.update_where(a, F.col("id") == 2, v=F.lit("n")).collect()} == {"x", "n"}
    assert mutations.delete_where(a, F.col("v") == "x").count() == 1
    assert mutations.next_id(spark.createDataFrame([("V_007",), ("V_010",), ("X_99",)], "id string"), "id", "V").first()[0] == "V_011"
    child, names = mutations.child_entity(analytes.withColumns({"analyte_type": F.lit("s"), "group_code": F.lit("g"), "chemical_group": F.lit("c")}).filter("analyte_id = 'V1'"), "V9", "Child", ["child", "Other"], normalise)
    assert child.first()["parent_analyte_id"] == "V1" and {r["synonym_raw"] for r in names.collect()} == {"Child", "Other"}
    assert mutations.seed_synonyms(analytes, synonyms, normalise).count() == 0
    assert mutations.content_hash(a, "id", "v").first() == mutations.content_hash(a.orderBy(F.desc("id")), "id", "v").first()
    reg = spark.createDataFrame([("1", "k", "h", True, datetime(2024, 1, 1)), ("2", "k", "i", False, datetime(2024, 2, 1)), ("9", "o", "j", True, datetime(2024, 3, 1))], schema.TABLES["snapshot_registry"])
    assert mutations.latest_snapshot(reg, "k").first()["version"] == "2"
    assert {r["version"]: r["is_active"] for r in mutations.activate_snapshot(reg, "k", "2").collect()} == {"1": False, "2": True, "9": True}


def test_dual_gate(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"A{i}", f"n{i}", True, 0.1, t0 + timedelta(minutes=i)) for i in range(25)]
    rows += [(100, "A1", "n1", True, 0.2, t0 + timedelta(days=1)), (101, "B", "b", False, 0.9, t0), (102, "B", "b", True, 0.01, t0), (103, "K", "known", True, 0.5, t0 + timedelta(days=2))]
    df = spark.createDataFrame(rows, "id long, analyte_id string, norm string, confirmed boolean, margin double, ts timestamp")
    known = spark.createDataFrame([("K", "known")], "analyte_id string, norm string")
    got = {r["id"]: r["outcome"] for r in learning.dual_gate(df, known).collect()}
    assert [got[i] for i in range(25)] == ["ingested"] * 20 + ["daily_cap"] * 5
    assert [got[i] for i in (100, 101, 102, 103)] == ["duplicate", "not_confirmed", "small_margin", "duplicate"]


def test_clusters(spark):
    df = spark.createDataFrame([("b", i, t) for i, t in enumerate(["benzene", "benzen", "toluene", "benzenes", "toluen"])], "block string, k int, t string")
    got = {r["t"]: r["anchor"] for r in learning.greedy_clusters(df, "block", "k", "t", 0.85).collect()}
    assert got == {"benzene": "benzene", "benzen": "benzene", "benzenes": "benzene", "toluene": "toluene", "toluen": "toluene"}


def test_clusters_of_all(spark, sf_dir):
    from quillgrid.functions.similarity import lcs_length
    from quillgrid.plans import catalogue

    def plain(names, least):
        anchor = {}
        for i, a in enumerate(names):
            if a not in anchor:
                anchor[a] = a
                for b in names[i + 1 :]:
                    if b not in anchor and 2 * lcs_length(a, b) / (len(a) + len(b)) >= least:
                        anchor[b] = a
        return anchor

    got = catalogue.QUERIES["cluster_greedy"](spark, sf_dir).collect()
    names = [r["preferred_name"] for r in sorted(got, key=lambda r: r["k"])]
    assert {r["preferred_name"]: r["anchor"] for r in got} == plain(names, 0.7)
    assert any(r["preferred_name"][0] != r["anchor"][0] for r in got)
    df = spark.createDataFrame(list(enumerate(names)), "k long, t string")
    for least, few in ((0.5, 20), (0.7, 0)):
        assert {r["t"]: r["anchor"] for r in learning.greedy_clusters_of_all(df, "k", "t", least, few).collect()} == plain(names, least)


def test_clusters_of_all_in_blocks_of_lengths(spark, monkeypatch):
    texts = ["benzene", "benzen", None, "toluene", "xbenzene", "", "toluen", "benzene"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    want = {(0, "benzene"), (1, "benzene"), (2, None), (3, "toluene"), (4, "benzene"), (5, ""), (6, "toluene"), (7, "benzene")}
    for rows in (0, 50_000):
        monkeypatch.setattr(learning, "CORPUS_ROWS", rows)
        assert {(r["k"], r["anchor"]) for r in learning.greedy_clusters_of_all(df, "k", "t", 0.8).collect()} == want


def test_plateau(spark):
    weeks = lambda ns: spark.createDataFrame(list(enumerate(ns)), "week long, n long")
    assert learning.plateau(weeks([5, 5, 5, 5])).first()["plateau"] is False
    assert learning.plateau(weeks([5, 5, 5, 5]), constant_is_plateau=True).first()["plateau"] is True
    up = learning.plateau(weeks([8, 6, 4, 2])).first()
    assert up["slope"] == pytest.approx(2.0) and up["plateau"] is False


def test_integrity(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "s"), (3, "b", "t"), (4, None, None)], "id int, a string, s string")
    got = {r["check"]: r["n"] for r in schema.violations(df, one=schema.exactly_one(F.col("a"), F.col("s")), positive=F.col("id") > 1).collect()}
    assert got == {"one": 2, "positive": 1}
    for ddl in schema.TABLES.values():
        assert spark.createDataFrame([], ddl).columns


def grid_a():
    """A workbook of the first layout: two samples, three chemicals, headings and a footer."""
    rows = [[None] * 10 for _ in range(24)]
    rows[6][0] = "Report No. 7"
    rows[13][8:10] = ["S-1", "S-2"]
    rows[14][8:10] = ["2024-01-01", "2024-01-02"]
    for i, (name, x, y) in enumerate([("Benzene", "<0.5", "1.2"), ("Toluene", "3", None), ("Total", "9", "9"), ("Lead", "7", "8")]):
        rows[18 + i][:2], rows[18 + i][6], rows[18 + i][8:10] = [name, "ug/L"], "0.5", [x, y]
    rows[23][0] = "This report shall not be copied"
    return rows


@pytest.fixture(scope="module")
def workbook(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    (d / "a.xlsx").write_bytes(files.write_workbook({"One & two": grid_a()}))
    (d / "bad.xlsx").write_bytes(b"no zip")
    (d / "~$a.xlsx").write_bytes(b"lock")
    return d


def test_workbooks(spark, workbook):
    grid = files.read_grids(spark, str(workbook)).cache()
    assert {r["file"] for r in grid.filter("row < 0").collect()} == {"bad.xlsx"}
    assert grid.filter("sheet = 'One & two'").count() > 20
    good = grid.filter("file = 'a.xlsx'").drop("sheet")
    assert {(r["file"], r["layout"]) for r in extraction.detect_layout(good, "markc", "markb").collect()} == {("a.xlsx", "layout_a")}
    got = {(r["chemical"], r["sample_id"]): (r["result_value"], r["units"], r["detection_limit"], r["sample_date"]) for r in extraction.unpivot(good, extraction.LAYOUTS[0]).collect()}
    assert got[("Benzene", "S-1")] == ("<0.5", "ug/L", "0.5", "2024-01-01") and got[("Toluene", "S-2")][0] is None
    assert {k[0] for k in got} == {"Benzene", "Toluene", "Lead"} and len(got) == 6
    assert extraction.files_with_text(good, "BENZ").count() == 1
    assert extraction.key_values(good, {"report": "report no"}).first()["report"] is None
    assert extraction.first_result(good).count() == 5  # four results, and the row of dates, which start like numbers


def test_unpivot_without_samples(spark):
    cells = [("f", 20, 1, "Lead"), ("f", 20, 2, "mg/L"), ("f", 14, 0, "Metals"), ("f", 14, 1, "Zinc")]
    grid = spark.createDataFrame(cells, "file string, row int, col int, value string")
    got = extraction.unpivot(grid, extraction.LAYOUTS[2]).orderBy("row_num").collect()
    assert [(r["chemical"], r["sample_id"], r["chemical_group"]) for r in got] == [("Zinc", None, "Metals"), ("Lead", None, "Metals")]


def test_headers(spark):
    rows = [["x", None], ["Parameter", "Units"], *[["Benzene", "mg"]] * 6]
    cells = [("f", r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row) if v]
    grid = spark.createDataFrame(cells, "file string, row int, col int, value string")
    h = extraction.header_row(grid, ("parameter", "units"))
    assert (h.first()["row"], h.first()["hits"], h.first()["confidence"]) == (1, 2, 0.4)
    c = extraction.text_column(grid, h, ("parameter",)).first()
    assert (c["col"], c["confidence"]) == (0, 0.9)


def test_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text("Analyte_ID,Preferred_Name,Analyte_Type,CAS_Number,Group_Code,Table_Number,Chemical_Group,Parent_Analyte_ID\n A1 ,Benzene,single,71-43-2,G,2,VOC\n,None,single,,,,,\nA2,Lead,odd,,,x,Metals,\n")
    good, bad = files.canonical_rows(files.read_table(spark, str(tmp_path / "r.csv"), inferSchema=False), ("SINGLE", "MIXTURE"), "SINGLE")
    assert [(r["analyte_id"], r["analyte_type"], r["table_number"]) for r in good.collect()] == [("A1", "SINGLE", 2)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad number", "no id"]
    (tmp_path / "l.json").write_text('{" Odd Name ": {"cas_numbers": ["1-2-3"], "found": true}, "b": {"found": false}}')
    assert {(r["key"], tuple(r["numbers"]), r["found"]) for r in files.read_lookups(spark, str(tmp_path / "l.json")).collect()} == {("odd name", ("1-2-3",), True), ("b", (), False)}
    assert files.sniff_columns(["raw_variant", "Chosen Match"], {"text": ("variant",), "match": ("chosen match", "match")}) == {"text": "raw_variant", "match": "Chosen Match"}
    assert files.backoff_delays(8) == [1, 2, 4, 8, 16, 32, 60, 60]


def test_new_files(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "one"), ("c", "two"), ("d", "three")):
        (tmp_path / name).write_text(text)
    found = spark.read.format("binaryFile").load(str(tmp_path))
    known = found.filter(F.col("path").endswith("/d")).select(F.md5("content").alias("file_hash"))
    assert {r["path"][-1] for r in files.new_files(found, known).collect()} == {"a", "c"}


def test_inbox_once_per_content(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for name, text in (("a.txt", "1"), ("b.txt", "1"), ("c.txt", "2"), ("~$c.txt", "3")):
        (src / name).write_text(text)
    run = lambda: inbox.run_once(inbox.watch(spark, str(src), "*.txt").select("file_hash"), str(tmp_path / "state"), path=out)
    run()
    assert spark.read.parquet(out).count() == 2
    shutil.copy(src / "a.txt", src / "again.txt")
    (src / "d.txt").write_text("4")
    run()
    assert spark.read.parquet(out).count() == 3


def test_vendor_states_over_batches(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("v", "x", a, t0 + timedelta(hours=i)) for i, a in enumerate("AABAB")]
    kind = "lab_vendor string, observed_text string, analyte_id string, ts timestamp"
    stream = lambda: inbox.vendor_states(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    save = lambda df, i: df.write.mode("append").parquet(str(tmp_path / "out"))
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        inbox.run_once(stream(), str(tmp_path / "state"), each=save, mode="update")
    got = {(r["confirmations"], r["collisions"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(3, 1, "COLLIDED"), (5, 3, "UNSTABLE")}


def test_reports(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, c string, o int")
    wide = {r["k"]: (r["x"], r["y"]) for r in reports.pivot_first(df, "k", "c", ["x", "y"], F.col("o"), "o").collect()}
    assert wide == {"a": (1, 2), "b": (3, None)}
    assert {(r["section"], r["value"], r["n"]) for r in reports.sections(df.select("k", "c"), "k", "c").collect()} == {("k", "a", 2), ("k", "b", 1), ("c", "x", 2), ("c", "y", 1)}
    q = reports.review_queue(spark.createDataFrame([(" t ", "A", 0.6, datetime(2024, 1, 2)), ("t", "B", 0.7, datetime(2024, 1, 3)), ("u", None, None, datetime(2024, 1, 3)), ("w", "A", 0.99, datetime(2024, 1, 3))], "t string, a string, c double, ts timestamp"), "t", "a", "c", "ts", F.lit("2024-01-01").cast("timestamp"))
    assert {(r["text"], r["frequency"], r["best_match"]) for r in q.collect()} == {("t", 2, "B"), ("u", 1, None)}


def test_caps_are_ordered():
    t = Thresholds()
    assert t.ood < t.review < t.disagreement_cap < t.auto_accept
