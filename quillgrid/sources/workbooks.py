"""Workbooks as a Spark data source: batch and stream scans, and a sink.

``register(spark)`` makes the format ``workbooks`` known. A scan gives cells
(file, sheet, row, col, value), or with ``header`` a row for every row below
each sheet's first, in the columns of the given schema. Only columns in the
schema are made. Equality and IN filters on file and sheet are pushed: files
are not opened and sheets not parsed.

Sheets are parsed as a stream of XML; only a workbook's shared strings, which
any of its cells may point to, are held whole. Paths may be of any kind that
pyarrow knows; driver and executors both read them.

Defined results: an empty folder gives no rows; a file that is no workbook
gives one row with the error in ``value`` (cells) or fails the task unless
``skip_bad`` is true (header); empty sheets give no rows; a column that a sheet
lacks is null, as is a number that does not parse; of two columns of a sheet
with one name the first counts.
"""

from __future__ import annotations

import fnmatch
import json
import re
import sys
import time
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from itertools import groupby
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs as afs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CELLS = "file string, sheet string, row int, col int, value string"
#: Small workbooks are packed into tasks of this many bytes; one that is larger gets a task for every sheet.
TASK_BYTES = 16 << 20
BATCH_ROWS = 4096
#: Fixed values of the format: rows of a sheet, letters of a sheet's name, signs that it may not hold.
SHEET_ROWS, NAME_LETTERS, NAME_SIGNS = 1_048_576, 31, r"[\[\]:*?/\\]"
#: The escape of signs that XML cannot hold, and those signs.
ESCAPED, UNSAFE = re.compile(r"_x([0-9A-Fa-f]{4})_"), re.compile(r"_(?=x[0-9A-Fa-f]{4}_)|[\x00-\x08\x0b-\x1f\ufffe\uffff]")
_REF = re.compile(r"([A-Z]+)(\d+)")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


def letters(n: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _place(ref: str) -> tuple[int, int] | None:
    found = _REF.fullmatch(ref)
    if not found:
        return None
    n = 0
    for c in found[1]:
        n = 26 * n + ord(c) - 64
    return int(found[2]) - 1, n - 1


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _text(e) -> str:
    """Text of an item, without phonetic hints."""
    spoken = {id(t) for r in e.iter() if _local(r) == "rPh" for t in r.iter()}
    return ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in e.iter() if _local(t) == "t" and id(t) not in spoken))


def sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(title, part) in the order of the workbook; the relations say which part a sheet is."""
    parts = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter():
        if _local(e) == "sheet":
            target = parts.get(e.get(f"{{{_LINKS}}}id"), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in z.NameToInfo and "worksheets/" in part:
                out.append((e.get("name"), part))
    return out


def rows_of(z: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(row, [(column, text)]) of a sheet's filled cells, one row in memory at a time."""
    row = -1
    with z.open(part) as f:
        held: list = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            kind = _local(e)
            if event == "start":
                if kind == "row":
                    row = int(e.get("r")) - 1 if e.get("r") else row + 1
                    held = []
                continue
            if kind == "c":
                at = _place(e.get("r", ""))
                col = at[1] if at else (held[-1][0] + 1 if held else 0)
                raw = next((v.text or "" for v in e if _local(v) == "v"), "")
                text = _text(e) if e.get("t") == "inlineStr" else shared[int(raw)] if e.get("t") == "s" and raw else raw
                held.append((col, text))
            elif kind == "row":
                if filled := [(c, t) for c, t in held if t]:
                    yield row, filled
                e.clear()
            elif kind in ("sheetData",):
                e.clear()


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.NameToInfo:
        return []
    out = []
    with z.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if _local(e) == "si":
                out.append(_text(e))
                e.clear()
    return out


BAD = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError, EOFError)


def _open(path: str) -> tuple[afs.FileSystem, str]:
    return afs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+:", path) else (afs.LocalFileSystem(), path)


class Scan:
    """What a scan's options and filters say. Plain values only: it is sent to tasks."""

    def __init__(self, options, schema: StructType):
        self.path, self.pattern = options["path"], options.get("pattern", "*.xlsx")
        self.header, self.skip_bad = options.get("header", "false").lower() == "true", options.get("skip_bad", "false").lower() == "true"
        self.schema, self.only = schema, {}

    def list(self) -> list[tuple[str, int, int]]:
        """(path, bytes, time in ns) of the workbooks in the folder and those below; lock files and unfinished ones left out."""
        system, root = _open(self.path)
        found = system.get_file_info(afs.FileSelector(root, recursive=True, allow_not_found=True))
        keep = lambda f: f.type == afs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith(("~$", ".", "_")) and "/_parts-" not in f.path
        return sorted((f.path, f.size, f.mtime_ns or 0) for f in found if keep(f) and ("file" not in self.only or f.base_name in self.only["file"]))

    def tasks(self, files: list[tuple[str, int, int]]) -> list[Work]:
        """Small files packed by bytes; of a large one every sheet by itself."""
        system, _ = _open(self.path)
        out, pack, held = [], [], 0
        for path, size, _ in files:
            if size > TASK_BYTES:
                try:
                    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        out += [Work([(path, title)]) for title, _ in sheets(z) if self.wants(title)]
                    continue
                except BAD:
                    pass  # its task reports it
            if pack and held + size > TASK_BYTES:
                out.append(Work(pack))
                pack, held = [], 0
            pack.append((path, None))
            held += size
        return [*out, Work(pack)] if pack else out

    def wants(self, title: str) -> bool:
        return "sheet" not in self.only or title in self.only["sheet"]

    def read(self, work: Work) -> Iterator[pa.RecordBatch]:
        arrow, names = to_arrow_schema(self.schema), self.schema.names
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else [()] * len(names)
            out = pa.RecordBatch.from_arrays([_array(c, t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)
            held.clear()
            return out

        if not names:
            raise ValueError("a scan needs a column")
        for path, title in work.items:
            for row in self._rows(path, title):
                held.append(tuple(row.get(n) for n in names))
                if len(held) >= BATCH_ROWS:
                    yield batch()
        if held:
            yield batch()

    def _rows(self, path: str, only: str | None) -> Iterator[dict]:
        system, _ = _open(self.path)
        file = path.rpartition("/")[2]
        try:
            with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                shared = None
                for title, part in sheets(z):
                    if (only is not None and title != only) or not self.wants(title):
                        continue
                    shared = _shared(z) if shared is None else shared
                    base, named = {"file": file, "sheet": title}, None
                    for row, cells in rows_of(z, part, shared):
                        if not self.header:
                            yield from ({**base, "row": row, "col": c, "value": v} for c, v in cells)
                        elif named is None:
                            named = {}
                            for c, v in cells:
                                if v not in named.values() and v not in base:
                                    named[c] = v
                        else:
                            yield {**{named[c]: v for c, v in cells if c in named}, **base}
        except BAD as e:
            if not self.header:
                yield {"file": file, "sheet": "", "row": -1, "col": -1, "value": f"{type(e).__name__}: {e}"}
            elif not self.skip_bad:
                raise ValueError(f"{path} is no workbook: {e}") from e


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    """Texts as the column's type; what does not parse is null."""

    def number(v, to):
        try:
            return None if v is None else to(v)
        except ValueError:
            return None

    if pa.types.is_integer(kind):
        low, high = -(1 << (kind.bit_width - 1)), (1 << (kind.bit_width - 1)) - 1
        whole = (number(v, int) for v in values)
        return pa.array([v if v is not None and low <= v <= high else None for v in whole], kind)
    if pa.types.is_floating(kind):
        return pa.array([number(v, float) for v in values], kind)
    return pa.array(values, pa.string()).cast(kind)


class Work(InputPartition):
    """(path, sheet or None for all) of one task."""

    def __init__(self, items: list[tuple[str, str | None]]):
        super().__init__(items)
        self.items = items


class Reader(DataSourceReader):
    def __init__(self, scan: Scan):
        self.scan = scan

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Files and sheets by name, exactly; Spark sees to the rest."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in ("file", "sheet"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.scan.only[name] = self.scan.only.get(name, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self.scan.tasks(self.scan.list()) or [Work([])]

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        return self.scan.read(partition)


class StreamReader(DataSourceStreamReader):
    """New workbooks, each once its size and time stay the same over two looks.

    Offsets count entries of a log in the shared folder ``log``; an entry names
    the files of one offset, so a batch that is run again reads the same files.
    A file written anew under its name counts as new. With ``archive``, files
    move there once their batch is committed and their entries are emptied.
    """

    def __init__(self, scan: Scan, options):
        self.scan, self.log = scan, options["log"].rstrip("/")
        self.settle, self.per_trigger = float(options.get("settle_seconds", "1")), int(options.get("files_per_trigger", "1000"))
        self.archive = options.get("archive")
        self.seen: set[tuple] | None = None

    def _entries(self) -> list[int]:
        system, root = _open(self.log)
        found = system.get_file_info(afs.FileSelector(root, allow_not_found=True))
        return sorted(int(f.base_name) for f in found if f.base_name.isdigit())

    def _entry(self, n: int) -> list[tuple]:
        system, root = _open(self.log)
        with system.open_input_stream(f"{root}/{n}") as f:
            return [tuple(x) for x in json.loads(f.read())]

    def _write(self, n: int, files: list[tuple]) -> None:
        system, root = _open(self.log)
        system.create_dir(root, recursive=True)
        part = f"{root}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(json.dumps(files).encode())
        system.move(part, f"{root}/{n}")

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        entries = self._entries()
        if self.seen is None:
            self.seen = {f for n in entries for f in self._entry(n)}
        first = [f for f in self.scan.list() if f not in self.seen]
        last = entries[-1] if entries else 0
        if not first:
            return {"entry": last}
        time.sleep(self.settle)
        again = set(self.scan.list())
        stable = [f for f in first if f in again][: self.per_trigger]
        if stable:
            last += 1
            self._write(last, stable)
            self.seen |= set(stable)
        return {"entry": last}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.scan.tasks([f for n in range(start["entry"] + 1, end["entry"] + 1) for f in self._entry(n)])

    def read(self, partition: Work) -> Iterator[pa.RecordBatch]:
        return self.scan.read(partition)

    def commit(self, end: dict) -> None:
        if not self.archive:
            return
        system, _ = _open(self.scan.path)
        _, to = _open(self.archive)
        system.create_dir(to, recursive=True)
        for n in self._entries():
            files = self._entry(n) if n <= end["entry"] else []
            for path, _, at in files:
                if system.get_file_info(path).type == afs.FileType.File:
                    system.move(path, f"{to}/{at}-{path.rpartition('/')[2]}")
            if files:
                self._write(n, [])
                self.seen = self.seen - set(files) if self.seen else self.seen


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class Writer(DataSourceWriter):
    """Workbooks from rows that come together by ``file`` and ``sheet`` (``write`` sees to that).

    Tasks write whole workbooks, a row at a time, into a folder of parts; the
    commit moves them to their names. Tasks that were lost or run twice leave
    only parts, which go with the folder.
    """

    def __init__(self, options, schema: StructType, overwrite: bool):
        self.path, self.names, self.overwrite = options["path"].rstrip("/"), schema.names, overwrite
        self.choices = json.loads(options.get("choices", "{}"))
        self.parts = f"{self.path}/_parts-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, parts = _open(self.parts)
        system.create_dir(parts, recursive=True)
        at = {n: i for i, n in enumerate(self.names)}
        columns = [n for n in self.names if n not in ("file", "sheet")]
        done = []
        for file, of_file in groupby(iterator, key=lambda r: r[at["file"]]):
            if not file or "/" in file or file.startswith((".", "_", "~$")):
                raise ValueError(f"{file!r} is no name of a workbook")
            part = f"{uuid.uuid4().hex}-{file}"
            with system.open_output_stream(f"{parts}/{part}") as out, Book(out, columns, self.choices) as book:
                for sheet, rows in groupby(of_file, key=lambda r: r[at["sheet"]]):
                    book.add(sheet or "Sheet", ([r[at[c]] for c in columns] for r in rows))
            done.append(part)
        return Written(done)

    def commit(self, messages) -> None:
        system, root = _open(self.path)
        _, parts = _open(self.parts)
        names = [n for m in messages if m is not None for n in m.names]
        finals = [n[33:] for n in names]
        if len(set(finals)) != len(finals):
            self.abort(messages)
            raise ValueError("the rows of a workbook came in more than one task")
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(afs.FileSelector(root)):
                if f.type == afs.FileType.File and f.base_name.endswith(".xlsx") and f.base_name not in finals:
                    system.delete_file(f.path)
        for part, final in zip(names, finals, strict=True):
            system.move(f"{parts}/{part}", f"{root}/{final}")
        self.abort(messages)

    def abort(self, messages) -> None:
        system, parts = _open(self.parts)
        if system.get_file_info(parts).type == afs.FileType.Directory:
            system.delete_dir(parts)


class Book:
    """One workbook, written front to back: a bold, frozen and filtered heading, widths, lists of choices."""

    def __init__(self, out, columns: list[str], choices: dict[str, list[str]]):
        self.z, self.columns, self.choices, self.titles = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), columns, choices, []

    def __enter__(self) -> Book:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self._finish()
        self.z.close()

    def _title(self, wanted: str) -> str:
        base = re.sub(NAME_SIGNS, "_", wanted).strip("'") or "Sheet"
        title, n, used = base[:NAME_LETTERS], 1, {t.lower() for t in self.titles}
        while title.lower() in used:
            n += 1
            title = f"{base[: NAME_LETTERS - len(f' ({n})')]} ({n})"
        self.titles.append(title)
        return title

    def add(self, wanted: str, rows: Iterator[list]) -> None:
        """A sheet; rows beyond what a sheet may hold go on in a further one."""
        rows = iter(rows)
        row = next(rows, None)
        while row is not None:
            self._title(wanted)
            with self.z.open(f"xl/worksheets/sheet{len(self.titles)}.xml", "w", force_zip64=True) as f:
                widths = "".join(f'<col min="{i}" max="{i}" width="{max(12, min(60, len(c) + 4))}" customWidth="1"/>' for i, c in enumerate(self.columns, 1))
                f.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><cols>{widths}</cols><sheetData>'.encode())
                f.write(self._row(1, self.columns, 1))
                at = 1
                while row is not None and at < SHEET_ROWS:
                    at += 1
                    f.write(self._row(at, row, 0))
                    row = next(rows, None)
                lists = []
                for i, c in enumerate(self.columns):
                    if c in self.choices:
                        listed = ",".join(self.choices[c]).replace('"', '""')
                        lists.append(f'<dataValidation type="list" allowBlank="1" sqref="{letters(i)}2:{letters(i)}{at}"><formula1>"{escape(listed)}"</formula1></dataValidation>')
                checks = f'<dataValidations count="{len(lists)}">{"".join(lists)}</dataValidations>' if lists else ""
                f.write(f'</sheetData><autoFilter ref="A1:{letters(max(len(self.columns) - 1, 0))}{at}"/>{checks}</worksheet>'.encode())

    @staticmethod
    def _row(n: int, values: list, style: int) -> bytes:
        cells = []
        for i, v in enumerate(values):
            if v is None:
                continue
            if isinstance(v, int | float) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
                cells.append(f'<c r="{letters(i)}{n}" s="{style}"><v>{v!r}</v></c>')
            else:
                text = escape(UNSAFE.sub(lambda m: f"_x{ord(m[0]):04X}_", str(v)))
                cells.append(f'<c r="{letters(i)}{n}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        return f'<row r="{n}">{"".join(cells)}</row>'.encode()

    def _finish(self) -> None:
        n = len(self.titles)
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        part = lambda name, of: f'<Override PartName="/xl/{name}.xml" ContentType="{kind}.{of}+xml"/>'
        pages = "".join(part(f"worksheets/sheet{i}", "worksheet") for i in range(1, n + 1))
        link = lambda i, of, to: f'<Relationship Id="r{i}" Type="{_LINKS}/{of}" Target="{to}"/>'
        links = lambda inner: f'<Relationships xmlns="{_PACKAGE}/relationships">{inner}</Relationships>'
        self.z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{part("workbook", "sheet.main")}{part("styles", "styles")}{pages}</Types>')
        self.z.writestr("_rels/.rels", links(link(1, "officeDocument", "xl/workbook.xml")))
        self.z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>' + "".join(f'<sheet name="{escape(t, {chr(34): "&quot;"})}" sheetId="{i}" r:id="r{i}"/>' for i, t in enumerate(self.titles, 1)) + "</sheets></workbook>")
        self.z.writestr("xl/_rels/workbook.xml.rels", links("".join(link(i, "worksheet", f"worksheets/sheet{i}.xml") for i in range(1, n + 1)) + link(n + 1, "styles", "styles.xml")))
        fill = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFD9E1F2"/></patternFill></fill>'
        plain, head = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0" xfId="0"/>', '<xf numFmtId="0" fontId="1" fillId="2" borderId="0" xfId="0" applyFont="1" applyFill="1"/>'
        self.z.writestr("xl/styles.xml", f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts><fills count="3">{fill}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2">{plain}{head}</cellXfs></styleSheet>')


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> Reader:
        return Reader(Scan(self.options, schema))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(Scan(self.options, schema), self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with pushed filters.

    This module goes by value: the process that plans a stream does not look
    at the session's Python files.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)


def read(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Cells of all workbooks in a folder, or with a schema the rows below the headings."""
    register(spark)
    reader = spark.read.format("workbooks").options(path=path, **options)
    return (reader.schema(schema).option("header", "true") if schema else reader).load()


def stream(spark: SparkSession, path: str, log: str, schema: str | None = None, **options) -> DataFrame:
    """The same as a stream of new workbooks; ``log`` is a folder that outlives the query, as its checkpoint does."""
    register(spark)
    reader = spark.readStream.format("workbooks").options(path=path, log=log, **options)
    return (reader.schema(schema).option("header", "true") if schema else reader).load()


def write(df: DataFrame, path: str, order: list[str], choices: dict[str, list[str]] | None = None) -> None:
    """One workbook for every ``file`` (its name) with a sheet for every ``sheet``, rows in ``order``; other columns become the sheet's.

    A workbook is one task's work, a row in memory at a time. ``choices`` puts lists to choose from on columns.
    """
    register(df.sparkSession)
    laid = df.repartition("file").sortWithinPartitions("file", "sheet", *order)
    laid.write.format("workbooks").options(path=path, choices=json.dumps(choices or {})).mode("overwrite").save()
