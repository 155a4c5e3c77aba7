"""Workbooks as a source and sink: what is written is read, parts of a scan, streams of files that still grow."""

from __future__ import annotations

import io
import threading
import time
import zipfile

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from quillgrid.sources import files, workbooks
from quillgrid.streaming import inbox

pytestmark = pytest.mark.usefixtures("spark")  # schemas are parsed by a session
ODD = ["plain", " spaces ", "a<b & \"c\"", "bell\x07", "_x0007_ as text", "line\nbreak", "ünïcode 水", "\ufffe"]


def book(path, sheets: dict[str, list[list]], columns=("id", "note")) -> None:
    with open(path, "wb") as f, workbooks.Book(f, list(columns), {}) as b:
        for name, rows in sheets.items():
            b.add(name, iter(rows))


def scan(path, schema=None, **options):
    s = StructType.fromDDL(schema or workbooks.CELLS)
    return workbooks.Scan({"path": str(path)} | options, s)


def everything(s) -> list[tuple]:
    return [tuple(r.values()) for w in s.tasks(s.list()) for b in s.read(w) for r in b.to_pylist()]


def test_odd_texts_come_back(tmp_path):
    book(tmp_path / "a.xlsx", {"s": [[i, t] for i, t in enumerate(ODD)]})
    got = everything(scan(tmp_path, "id bigint, note string", header="true"))
    assert got == list(enumerate(ODD))


def test_rows_through_spark(spark, tmp_path):
    rows = [(f"{k % 3}.xlsx", "one" if k % 2 else "two [x]", k, None if k % 7 == 0 else f"n{k}", k / 4) for k in range(500)]
    df = spark.createDataFrame(rows, "file string, sheet string, k bigint, n string, v double")
    workbooks.write(df, str(tmp_path / "b"), ["k"], {"n": ["yes", 'a "no"']})
    got = workbooks.read(spark, str(tmp_path / "b"), "file string, sheet string, k bigint, n string, v double")
    assert sorted(got.collect()) == sorted((f, s.replace("[", "_").replace("]", "_"), k, n, v) for f, s, k, n, v in rows)
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["0.xlsx", "1.xlsx", "2.xlsx"]
    one = got.filter("file = '1.xlsx' AND sheet = 'one' AND k > 100")
    assert {r["k"] for r in one.collect()} == {k for k in range(500) if k % 3 == 1 and k % 2 and k > 100}
    # A second write replaces what was there.
    workbooks.write(df.filter("file = '0.xlsx'"), str(tmp_path / "b"), ["k"])
    assert [p.name for p in (tmp_path / "b").iterdir()] == ["0.xlsx"]


def test_other_reader_agrees(tmp_path):
    book(tmp_path / "a.xlsx", {"first": [[1, "x"], [2, None]], "second": [[3, "y"]]})
    got = sorted((s, r, c, v) for f, s, r, c, v in everything(scan(tmp_path)))
    assert got == sorted(files.sheet_cells((tmp_path / "a.xlsx").read_bytes()))


def test_shared_strings_relations_and_implied_places(tmp_path):
    """A file as office programs write it: shared strings, relations out of order, cells without places."""
    main, rel = workbooks._MAIN, workbooks._LINKS
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" sheetId="1" r:id="r2"/><sheet name="A" sheetId="2" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{rel}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>one</t></si><si><r><t>tw</t></r><r><t>o</t></r><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert everything(scan(tmp_path)) == [("a.xlsx", "B", 2, 1, "two"), ("a.xlsx", "A", 0, 0, "one"), ("a.xlsx", "A", 0, 1, "7")]


def test_filters_leave_files_and_sheets_unread(tmp_path):
    for n in "ab":
        book(tmp_path / f"{n}.xlsx", {"one": [[1, "x"]], "two": [[2, "y"]]})
    s = scan(tmp_path, "file string, sheet string, id int", header="true")
    rest = list(workbooks.Reader(s).pushFilters([EqualTo(("file",), "a.xlsx"), In(("sheet",), ("two", "three")), GreaterThan(("id",), 0)]))
    assert rest == [GreaterThan(("id",), 0)]
    assert [p.rpartition("/")[2] for p, _, _ in s.list()] == ["a.xlsx"]
    assert everything(s) == [("a.xlsx", "two", 2)]


def test_large_workbooks_are_split_by_sheet_and_small_ones_packed(tmp_path, monkeypatch):
    for n in range(4):
        book(tmp_path / f"{n}.xlsx", {"one": [[1, "x"]], "two": [[2, "y"]]})
    whole = everything(scan(tmp_path))
    assert len(scan(tmp_path).tasks(scan(tmp_path).list())) == 1
    monkeypatch.setattr(workbooks, "TASK_BYTES", 10)
    s = scan(tmp_path)
    assert [len(w.items) for w in s.tasks(s.list())] == [1] * 8
    assert sorted(everything(s)) == sorted(whole)


def test_rows_beyond_a_sheet_go_on_in_the_next(tmp_path, monkeypatch):
    monkeypatch.setattr(workbooks, "SHEET_ROWS", 4)
    book(tmp_path / "a.xlsx", {"s" * 40: [[i, None] for i in range(7)]})
    got = everything(scan(tmp_path, "sheet string, id int", header="true"))
    assert [i for _, i in got] == list(range(7))
    assert [len(n) for n in dict(got)] == [31, 31, 31]


@pytest.mark.parametrize("content", [b"", b"no zip", None])
def test_files_that_are_no_workbooks(tmp_path, content):
    if content is None:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            z.writestr("other", "x")
        content = held.getvalue()
    (tmp_path / "a.xlsx").write_bytes(content)
    (tmp_path / "~$b.xlsx").write_bytes(b"lock")
    [(file, sheet, row, col, error)] = everything(scan(tmp_path))
    assert (file, sheet, row, col) == ("a.xlsx", "", -1, -1) and error
    with pytest.raises(ValueError):
        everything(scan(tmp_path, "id int", header="true"))
    assert everything(scan(tmp_path, "id int", header="true", skip_bad="true")) == []


def test_odd_columns(tmp_path):
    book(tmp_path / "a.xlsx", {"s": [["1", "x", "y"], ["no number", None, None], [1e300, 5, None]], "empty": []}, ("id", "n", "n"))
    got = everything(scan(tmp_path, "id int, n string, gone double", header="true"))
    assert got == [(1, "x", None), (None, None, None), (None, "5", None)]
    assert everything(scan(tmp_path / "nowhere")) == []


def test_a_workbook_of_two_tasks_is_refused(spark, tmp_path):
    df = spark.range(100, numPartitions=4).selectExpr("'a.xlsx' AS file", "'s' AS sheet", "id")
    workbooks.register(spark)
    with pytest.raises(Exception, match="more than one task"):
        df.write.format("workbooks").options(path=str(tmp_path / "b")).mode("append").save()
    assert not [p for p in (tmp_path / "b").iterdir()]


def test_stream_waits_for_files_that_grow(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    book(folder / "done.xlsx", {"s": [[1, "x"]]})
    (folder / "growing.xlsx").write_bytes(b"PK")
    ended = threading.Event()

    def grow():
        while not ended.is_set():
            with open(folder / "growing.xlsx", "ab") as f:
                f.write(b"x")
            time.sleep(0.02)

    worker = threading.Thread(target=grow)
    worker.start()
    options = {"log": str(tmp_path / "log"), "settle_seconds": "0.2"}
    r = workbooks.StreamReader(scan(folder), options)
    try:
        assert r.latestOffset() == {"entry": 1} and r.latestOffset() == {"entry": 1}
    finally:
        ended.set()
        worker.join()
    names = lambda r, a, b: [p.rpartition("/")[2] for w in r.partitions({"entry": a}, {"entry": b}) for p, _ in w.items]
    assert names(r, 0, 1) == ["done.xlsx"]
    book(folder / "growing.xlsx", {"s": [[2, "y"]]})
    again = workbooks.StreamReader(scan(folder), options)  # as after a restart
    assert again.latestOffset() == {"entry": 2}
    assert names(again, 1, 2) == ["growing.xlsx"] and names(again, 0, 1) == ["done.xlsx"] and names(again, 2, 2) == []


def test_stream_archives_what_is_committed(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        book(folder / f"{n}.xlsx", {"s": [[n, "x"]]})
    r = workbooks.StreamReader(scan(folder), {"log": str(tmp_path / "log"), "settle_seconds": "0", "files_per_trigger": "2", "archive": str(tmp_path / "old")})
    first = r.latestOffset()
    r.commit(first)
    assert len(list((tmp_path / "old").iterdir())) == 2 and len(list(folder.iterdir())) == 1
    assert r.latestOffset() == {"entry": 2}


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    schema = "file string, id int, note string"

    def run():
        rows = workbooks.stream(spark, str(folder), str(tmp_path / "log"), schema, settle_seconds="0")
        inbox.run_once(rows, str(tmp_path / "state"), path=str(out))
        return sorted(spark.read.schema(schema).parquet(str(out)).collect())

    book(folder / "a.xlsx", {"s": [[1, "x"], [2, "y"]]})
    assert run() == sorted(workbooks.read(spark, str(folder), schema).collect())
    book(folder / "b.xlsx", {"s": [[3, "z"]]})
    assert run() == sorted(workbooks.read(spark, str(folder), schema).collect()) == run()
