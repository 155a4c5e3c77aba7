"""Files as tables: workbooks, delimited and JSON files, hashes, lookups, sinks.

Workbooks are read as binary files on executors with the standard library
(an .xlsx is a zip of XML); every cell becomes a row, so later steps need no
driver-side frames. The older binary workbook format is not read.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID = "file string, sheet string, row int, col int, value string"
_REF = re.compile(r"([A-Z]+)(\d+)")


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of every filled cell of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        local = lambda e: e.tag.rpartition("}")[2]
        texts = lambda e: "".join(t.text or "" for t in e.iter() if local(t) == "t")
        shared = [texts(si) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si) == "si"] if "xl/sharedStrings.xml" in names else []
        titles = [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"] if "xl/workbook.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for k, sheet in enumerate(sheets):
            title = titles[k] if k < len(titles) else f"Sheet{k + 1}"
            for cell in ElementTree.fromstring(z.read(sheet)).iter():
                if local(cell) != "c" or not (ref := _REF.fullmatch(cell.get("r", ""))):
                    continue
                raw = next((e.text or "" for e in cell if local(e) == "v"), None)
                text = texts(cell) if cell.get("t") == "inlineStr" else shared[int(raw)] if cell.get("t") == "s" and raw else raw
                if text:
                    yield title, int(ref[2]) - 1, _column(ref[1]), text


def read_grids(spark: SparkSession, path: str, pattern: str = "*.xlsx") -> DataFrame:
    """Cells of all workbooks under ``path``; files that are no workbooks give one row at -1, -1 with the error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    rows = [(file, *c) for c in sheet_cells(bytes(content))]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError) as e:
                    rows = [(file, "", -1, -1, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["file", "sheet", "row", "col", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    named = files.filter(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.mapInPandas(work, GRID)


def write_workbook(sheets: dict[str, list[list]]) -> bytes:
    """A plain workbook of small reports (already collected)."""
    esc = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def letters(n: int) -> str:
        out = ""
        n += 1
        while n:
            n, r = divmod(n - 1, 26)
            out = chr(65 + r) + out
        return out

    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{esc(n)}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, rows in enumerate(sheets.values(), 1):
            cells = "".join(f'<row r="{r}">' + "".join(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>' for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def read_table(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """A delimited file with a header, blanks as nulls."""
    reader = spark.read.options(header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, **options)
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*(F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def canonical_rows(df: DataFrame, allowed: tuple[str, ...], default: str) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) rows of a registry file of strings: numbers parsed, types checked, rejects with a reason."""
    kind = F.upper(F.coalesce("Analyte_Type", F.lit(default)))
    parsed = df.select(
        F.trim("Analyte_ID").alias("analyte_id"), F.trim("Preferred_Name").alias("preferred_name"), F.when(kind.isin(*allowed), kind).otherwise(default).alias("analyte_type"),
        F.col("CAS_Number").alias("cas_number"), F.col("Group_Code").alias("group_code"), F.col("Chemical_Group").alias("chemical_group"),
        F.col("Table_Number").try_cast("int").alias("table_number"), F.col("Parent_Analyte_ID").alias("parent_analyte_id"),
        F.when(F.col("Analyte_ID").isNull(), "no id").when(F.col("Preferred_Name").isNull(), "no name").when(F.col("Table_Number").isNotNull() & F.col("Table_Number").try_cast("int").isNull(), "bad number").alias("reason"),
    )
    return parsed.filter("reason IS NULL").drop("reason"), parsed.filter("reason IS NOT NULL")


def sniff_columns(columns: list[str], wanted: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """Role to column: the first column whose name holds one of the role's words, in order of the words."""
    out = {}
    for role, words in wanted.items():
        hit = next((c for w in words for c in columns if w in c.lower().replace("_", " ")), None)
        if hit:
            out[role] = hit
    return out


def read_lookups(spark: SparkSession, path: str) -> DataFrame:
    """(key, numbers, found): a JSON map of cached outside lookups, keys trimmed and lower-cased."""
    entry = "map<string, struct<cas_numbers:array<string>,synonyms:array<string>,found:boolean>>"
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", entry).alias("m")).select(F.explode("m").alias("k", "v"))
    return held.select(F.lower(F.trim("k")).alias("key"), F.coalesce(F.col("v")["cas_numbers"], F.array()).alias("numbers"), F.coalesce(F.col("v")["found"], F.lit(False)).alias("found"))


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Binary files whose content is not known, each content once (the first path)."""
    hashed = files.select("path", F.md5("content").alias("file_hash"), "content")
    first = hashed.groupBy("file_hash").agg(F.min("path").alias("path"))
    return hashed.join(first, ["file_hash", "path"], "left_semi").join(known.select("file_hash"), "file_hash", "left_anti")


def vendor_of(text: Column, filename: Column, signatures: dict[str, str]) -> Column:
    """From the text of a document, then from its file name."""
    from quillgrid.functions.names import first_signature

    by_text, by_name = first_signature(text, signatures, ""), first_signature(filename, signatures, "")
    return F.coalesce(F.nullif(by_text, F.lit("")), F.nullif(by_name, F.lit("")), F.lit("Unknown"))


def backoff_delays(retries: int = 3, base: float = 1.0, most: float = 60.0) -> list[float]:
    """Seconds to wait before each retry of an outside request."""
    return [min(base * 2**n, most) for n in range(retries)]


def write_rejects(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_sheets(frames: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder a sheet."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")
