"""Statistics by day as sums that merge, kept up to date by a stream; reports read these and no longer the rows.

A table has one folder a day. In it are one row for everything settled and one
for the last batch that touched the day, told apart by ``batch``. A batch
rewrites only the days that it has rows of, late ones included, and a batch
that is run again takes its own rows out first, so nothing counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.storage import materialise, release

SETTLED = -1


class Rollup:
    """A table of daily sums under ``path``.

    ``like``: a table or stream with the rows' columns. ``by``: columns that rows are told apart by within a day. ``flags``: name
    to condition, counted where true. ``values``: name to number; sum, sum of
    squares and count of what is not null. Rows without a time are kept under
    a null day and are in no window; null conditions count as false.
    """

    def __init__(self, like: DataFrame, path: str, ts: str, by: tuple[str, ...] = (), flags: dict[str, Column] | None = None, values: dict[str, Column] | None = None):
        self.spark, self.path, self.ts, self.by, self.flags, self.values = like.sparkSession, path.rstrip("/"), ts, tuple(by), flags or {}, values or {}
        self.rows = like.schema
        self.sums = ["n", *self.flags, *(f"{v}_{k}" for v in self.values for k in ("n", "sum", "sq"))]

    def partials(self, rows: DataFrame) -> DataFrame:
        """A row for every day and combination of ``by``."""
        number = {v: c.cast("double") for v, c in self.values.items()}
        sums = [F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(f) for f, c in self.flags.items())]
        for v, c in number.items():
            sums += [F.count(c).alias(f"{v}_n"), F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{v}_sum"), F.coalesce(F.sum(c * c), F.lit(0.0)).alias(f"{v}_sq")]
        return rows.groupBy(F.col(self.ts).cast("date").alias("day"), *self.by).agg(*sums)

    def _merged(self, partials: DataFrame, *keys: str) -> DataFrame:
        return partials.groupBy(*keys).agg(*(F.sum(s).alias(s) for s in self.sums))

    def _stored(self, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).option("basePath", self.path).parquet(self.path)

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows. Reads and writes the days of the batch only."""
        new = materialise(self.partials(rows).withColumn("batch", F.lit(batch).cast("long")))
        days = [r["day"] for r in new.select("day").distinct().collect()]
        if not days:
            release(new)
            return
        if _exists(self.spark, self.path):
            touched = F.col("day").isin([d for d in days if d is not None]) if any(days) else F.lit(False)
            held = self._stored(new).filter(touched | F.col("day").isNull() if None in days else touched).filter(F.col("batch") != batch)
            settled = self._merged(held, "day", *self.by).withColumn("batch", F.lit(SETTLED).cast("long"))
            all_rows = materialise(settled.unionByName(new))
        else:
            all_rows = new
        out = all_rows.repartition("day")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)
        release(all_rows)
        if all_rows is not new:
            release(new)

    def each(self) -> Callable[[DataFrame, int], None]:
        """Body of a stream's ``foreachBatch``."""
        return lambda df, i: self.add(df, i)

    def days(self) -> DataFrame:
        """(day, by, sums): what all batches add up to."""
        like = self.partials(self.spark.createDataFrame([], self.rows)).withColumn("batch", F.lit(0).cast("long"))
        return self._merged(self._stored(like), "day", *self.by)

    def windows(self, as_of: Column, spans: tuple[int, ...], what: str = "n") -> DataFrame:
        """One row: ``what`` of the last 7, 30, ... days as d7, d30, ...; days to come count as well."""
        age = F.datediff(as_of.cast("date"), F.col("day"))
        return self.days().agg(*(F.coalesce(F.sum(F.when(age <= s, F.col(what))), F.lit(0)).cast("long").alias(f"d{s}") for s in spans))

    def weeks(self, as_of: Column, weeks: int) -> DataFrame:
        """(week, sums) of whole weeks back from ``as_of``, its own day the last of week 0; weeks without rows as zeros."""
        back = F.floor(F.datediff(as_of.cast("date"), F.col("day")) / 7)
        found = self._merged(self.days().withColumn("week", back), "week")
        zero = lambda s: F.coalesce(F.col(s), F.lit(0))
        return self.spark.range(weeks).withColumnRenamed("id", "week").join(F.broadcast(found.filter(F.col("week").between(0, weeks - 1))), "week", "left").select("week", *(zero(s).alias(s) for s in self.sums))

    def totals(self, since: Column | None = None) -> DataFrame:
        """One row of sums over all days, or those from ``since`` on."""
        days = self.days() if since is None else self.days().filter(F.col("day") >= since.cast("date"))
        return days.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in self.sums))


def share(flag: str, of: str = "n") -> Column:
    """Of no rows: 0."""
    return F.coalesce(F.try_divide(F.col(flag), F.col(of)), F.lit(0.0))


def mean_and_deviation(value: str) -> tuple[Column, Column]:
    """Mean and sample deviation from the sums of ``value``; null where undefined."""
    n, total, squares = F.col(f"{value}_n"), F.col(f"{value}_sum"), F.col(f"{value}_sq")
    spread = F.try_divide(squares - F.try_divide(total * total, n), n - 1)
    return F.try_divide(total, n), F.sqrt(F.greatest(spread, F.lit(0.0)))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
