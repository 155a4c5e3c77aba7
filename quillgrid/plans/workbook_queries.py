"""Given rows written as workbooks and read back, as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.plans.registry import query, table
from quillgrid.sources import workbooks
from quillgrid.storage import new_path
from quillgrid.streaming import inbox

_ROWS = "file string, sheet string, id bigint, name string, balance double, note string"
_SQL = "SELECT n_name || '.xlsx' AS file, c_mktsegment AS sheet, c_custkey AS id, c_name AS name, round(c_acctbal, 2)::DOUBLE AS balance, CASE WHEN c_acctbal < 0 THEN 'owes <' || c_custkey || '> & \"more\"' END AS note FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _books(spark, sf_dir) -> str:
    """Customers: a workbook for every nation, a sheet for every segment."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat("n_name", F.lit(".xlsx")).alias("file"), F.col("c_mktsegment").alias("sheet"), F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"),
        F.round(F.col("c_acctbal").cast("double"), 2).alias("balance"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("owes <"), "c_custkey", F.lit('> & "more"'))).alias("note"),
    )
    path = new_path(spark)
    workbooks.write(rows, path, ["id"], {"note": ["paid", "open"]})
    return path


@query(_SQL)
def workbook_rows(spark, sf_dir):
    return workbooks.read(spark, _books(spark, sf_dir), _ROWS)


@query(f"SELECT sheet, count(*) AS n, round(sum(balance), 2) AS balance FROM ({_SQL}) WHERE sheet IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def workbook_sheets(spark, sf_dir):
    """Two sheets of every workbook, two columns of them: the filter is pushed, so other sheets are not parsed."""
    rows = workbooks.read(spark, _books(spark, sf_dir), "sheet string, balance double").filter(F.col("sheet").isin("BUILDING", "MACHINERY"))
    return rows.groupBy("sheet").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query(
    "SELECT file, sheet, count(*) + 1 AS filled_rows, 4 + 3 * count(*) + count(note) AS cells, CAST(sum(id) AS BIGINT) AS ids "
    f"FROM ({_SQL}) GROUP BY 1, 2"
)
def workbook_cells(spark, sf_dir):
    """Cells as they lie in the sheets, headings included."""
    cells = workbooks.read(spark, _books(spark, sf_dir))
    return cells.groupBy("file", "sheet").agg(
        F.countDistinct("row").alias("filled_rows"), F.count("*").alias("cells"), F.sum(F.when((F.col("col") == 0) & (F.col("row") > 0), F.col("value").cast("long"))).alias("ids")
    )


@query(_SQL)
def stream_workbooks(spark, sf_dir):
    """The same rows from a stream that takes a few workbooks at a time."""
    path, out = _books(spark, sf_dir), new_path(spark)
    rows = workbooks.stream(spark, path, f"{out}/log", _ROWS, files_per_trigger="10", settle_seconds="0.2")
    for _ in range(3):  # a trigger that ends takes what one look finds
        inbox.run_once(rows, f"{out}/state", path=f"{out}/rows")
    return spark.read.schema(_ROWS).parquet(f"{out}/rows")
