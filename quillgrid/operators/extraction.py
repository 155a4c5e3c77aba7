"""Grids of cells to rows of results: layouts, headers, unpivot, fill-down, row filters.

A grid is rows of (file, row, col, value). Layouts place sample columns side
by side; each becomes one row per chemical and sample. All steps are
windows, conditional aggregates and one equi-join by file and column, so
files of any number are read together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# First cells that are headings, fragments of footers, tokens that are no chemicals.
HEADINGS = (
    "sample id", "sample date / time", "sample date & time", "analysis", "units", "temperature upon receipt", "temperature", "temp upon receipt", "sample date",
    "date received", "date reported", "report no.", "report no", "customer", "attention", "reference", "works#", "title", "method", "mdl", "rdl", "rl", "notes", "comments",
)
FOOTERS = (
    "prior written consent", "analytical results reported", "reproduction", "reporting limit", "r.l. =", "rl =", "mdl =", "laboratory", "laboratories", "copyright",
    "confidential", "prohibited without", "refer to the samples", "digitally signed", "official results", "page ", "of ", "this report", "the results", "revision",
)
NO_CHEMICALS = ("total", "sum", "notes", "comments", "", "nan")


@dataclass(frozen=True)
class Layout:
    """Places of a layout, counted from 0. ``samples_at`` is the first sample column."""

    name: str
    first_row: int
    chemical: int
    units: int
    limit: int
    samples_at: int
    sample_row: int
    client_row: int | None = None
    date_row: int | None = None
    group: int | None = None
    method: int | None = None


LAYOUTS = (
    Layout("layout_a", first_row=18, chemical=0, units=1, limit=6, samples_at=8, sample_row=13, date_row=14),
    Layout("layout_b", first_row=21, chemical=0, units=1, limit=2, samples_at=4, sample_row=18, client_row=17, date_row=19),
    Layout("layout_c", first_row=13, chemical=1, units=2, limit=4, samples_at=5, sample_row=12, group=0, method=3),
)


def _cell(row: int, col: int) -> Column:
    return F.lower(F.trim(F.coalesce(F.max(F.when((F.col("row") == row) & (F.col("col") == col), F.col("value"))), F.lit(""))))


def detect_layout(grid: DataFrame, marker_c: str, marker_b: str) -> DataFrame:
    """(file, layout): ordered probes of single cells, the file name last. The markers are the lab names the layouts show."""
    probes = grid.groupBy("file").agg(_cell(0, 5).alias("c05"), _cell(6, 0).alias("c60"), _cell(7, 5).alias("c75"), _cell(20, 0).alias("c200"), _cell(20, 1).alias("c201"))
    is_xlsx = F.lower("file").endswith(".xlsx")
    return probes.select(
        "file",
        F.when(F.col("c05").contains(marker_c), "layout_c").when(F.col("c60").contains("report no"), "layout_a")
        .when(is_xlsx & (F.col("c75").contains(marker_b) | ((F.col("c200") == "parameter") & (F.col("c201") == "units")) | F.lower("file").contains(marker_b)), "layout_b")
        .otherwise("unknown").alias("layout"),
    )


def is_chemical_row(text: Column, layout: Column) -> Column:
    """Whether the first cell of a row names a chemical."""
    low = F.lower(F.trim(text))
    footer = reduce(lambda a, b: a | b, (low.contains(x) for x in FOOTERS))
    heading = (layout == "layout_a") & (low.isin(*HEADINGS) | reduce(lambda a, b: a | b, (low.startswith(x) for x in ("sample ", "date ", "time "))))
    return F.coalesce(F.length(text).between(2, 100) & ~text.rlike(r"^[\d.\-<>]+$") & ~low.isin(*NO_CHEMICALS) & ~footer & ~heading, F.lit(False))


def fill_down(df: DataFrame, part: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value above that is not blank."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(F.nullif(F.trim(value), F.lit("")), ignorenulls=True).over(w))


def unpivot(grid: DataFrame, layout: Layout) -> DataFrame:
    """One row per chemical and sample of the files of one layout; without samples one row with blanks."""
    at = lambda c: F.max(F.when(F.col("col") == c, F.col("value"))) if c is not None else F.lit(None).cast("string")
    rows = grid.groupBy("file", "row").agg(at(layout.chemical).alias("chemical"), at(layout.units).alias("units"), at(layout.limit).alias("detection_limit"), at(layout.method).alias("lab_method"), at(layout.group).alias("_group"))
    rows = fill_down(rows, "file", "row", F.col("_group"), "chemical_group").filter(F.col("row") >= layout.first_row)
    rows = rows.filter(is_chemical_row(F.col("chemical"), F.lit(layout.name))).drop("_group")
    head = lambda r: F.max(F.when(F.col("row") == r, F.col("value"))) if r is not None else F.lit(None).cast("string")
    samples = grid.filter(F.col("col") >= layout.samples_at).groupBy("file", "col").agg(head(layout.sample_row).alias("sample_id"), head(layout.client_row).alias("client_id"), head(layout.date_row).alias("sample_date"))
    samples = samples.filter(F.coalesce(F.trim("sample_id"), F.lit("")) != "")
    values = grid.select("file", "row", "col", F.col("value").alias("result_value"))
    long = rows.join(samples, "file", "left").join(values, ["file", "row", "col"], "left")
    return long.select("file", F.col("row").alias("row_num"), "chemical", "units", "detection_limit", "result_value", "sample_id", "client_id", "sample_date", "lab_method", "chemical_group")


def header_row(grid: DataFrame, keywords: tuple[str, ...], within: int = 30) -> DataFrame:
    """(file, row, hits, confidence): the first of the rows with most keyword hits."""
    hit = reduce(lambda a, b: a | b, (F.lower("value").contains(k) for k in keywords))
    scored = grid.filter(F.col("row") < within).groupBy("file", "row").agg(F.count(F.when(hit, 1)).alias("hits"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc("hits"), "row"))).filter("_n = 1").drop("_n")
    return best.withColumn("confidence", F.least(F.col("hits") / 5.0, F.lit(1.0)))


def text_column(grid: DataFrame, header: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(file, col, confidence): a header cell with a keyword and five texts or more among the next nine cells; else column 0 at 0.5."""
    hit = reduce(lambda a, b: a | b, (F.lower("value").contains(k) for k in keywords))
    h = header.select("file", F.col("row").alias("h"))
    cells = grid.join(h, "file").filter(F.col("row").between(F.col("h"), F.col("h") + 9))
    wordy = (F.length(F.trim("value")) > 3) & F.col("value").try_cast("double").isNull()
    cols = cells.groupBy("file", "col").agg(F.max(((F.col("row") == F.col("h")) & hit).cast("int")).alias("named"), F.count(F.when((F.col("row") > F.col("h")) & wordy, 1)).alias("texts"))
    found = cols.filter("named = 1 AND texts >= 5").groupBy("file").agg(F.min("col").alias("col"))
    return h.join(found, "file", "left").select("file", F.coalesce("col", F.lit(0)).alias("col"), F.when(F.col("col").isNull(), 0.5).otherwise(0.9).alias("confidence"))


def first_result(grid: DataFrame, reach: int = 9) -> DataFrame:
    """(file, row, result): per row the first cell after column 0 that starts like a number."""
    cells = grid.filter(F.col("col").between(1, reach) & F.trim("value").rlike(r"^[<>]?[\d.,\-]+"))
    return cells.groupBy("file", "row").agg(F.min_by(F.trim("value"), "col").alias("result"))


def key_values(grid: DataFrame, keys: dict[str, str], within: int = 20) -> DataFrame:
    """(file, one column a key): the cell to the right of a label."""
    w = Window.partitionBy("file", "row").orderBy("col")
    pairs = grid.filter(F.col("row") < within).withColumn("right", F.lead("value").over(w))
    return pairs.groupBy("file").agg(*(F.min_by("right", F.when(F.lower("value").contains(label), F.struct("row", "col"))).alias(k) for k, label in keys.items()))


def files_with_text(grid: DataFrame, needle: str) -> DataFrame:
    return grid.filter(F.lower("value").contains(needle.lower())).select("file").distinct()
