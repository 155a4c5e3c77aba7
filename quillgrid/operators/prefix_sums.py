"""Running sums over a total order without bringing all rows to one task.

Rows are dealt by ranges of the order, each range is summed, and the sums of
the ranges before it are added to the running sums within it. The driver sees
one row a range, as many as the tasks of the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.storage import materialise


def running_sums(rows: DataFrame, order: Column, sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with the running sum of each long column of ``sums`` under its new name, in ``order`` up to and including the row, and the sum of all of each of ``totals``.

    Equal keys of the order lie in one range, and among them the sums rise in
    no particular order: sum up by key first, as thresholds do. Nulls add
    nothing. An empty table gives an empty one.
    """
    totals = totals or {}
    # Written with their ranges: a range must be the same for its sum and its rows.
    placed = materialise(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    columns = sorted({*sums, *totals})
    of_range = sorted((r["_range"], *(r[c] for c in columns)) for r in placed.groupBy("_range").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns)).collect())
    run, starts = [0] * len(columns), []
    for k, *values in of_range:
        starts.append((k, *run))
        run = [a + b for a, b in zip(run, values, strict=True)]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, " + ", ".join(f"_before_{c} long" for c in columns)))
    within = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done = placed.join(offsets, "_range").select(
        *rows.columns, *((F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_before_{c}")).alias(name) for c, name in sums.items()), *(F.lit(run[columns.index(c)]).cast("long").alias(name) for c, name in totals.items())
    )
    return done
