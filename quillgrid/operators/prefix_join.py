"""Truncated names by a prefix range join.

A registry in order is cut into ranges at the quantiles of a bounded sample;
names and truncated names are dealt to ranges by equal keys. All names that
begin with a prefix are one run of the order, so a prefix meets only
the ranges from its own to that of the last text that begins with it. The name
with the longest common prefix is next to a text in the order: it is the last
name before it or the first one after it, in its range or, where that has
none, at the end of a range near it.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.storage import materialise

#: Names that the cuts are taken from, and names a range.
SAMPLE, RANGE_ROWS, MOST_RANGES = 20_000, 20_000, 512
#: Greater than any text that begins with what comes before it.
LAST = "\U0010ffff"


def cuts(names: DataFrame, name: str = "name", rows: int = RANGE_ROWS) -> list[str]:
    """Borders of ranges of about ``rows`` names, at most ``MOST_RANGES``. A name lies in range r if r borders are not above it."""
    ranges = min(MOST_RANGES, -(-names.count() // rows))
    held = sorted(r[0] for r in names.select(name).orderBy(F.xxhash64(name), name).limit(SAMPLE).collect())  # bounded by the parameter
    return sorted({held[i * len(held) // ranges] for i in range(1, ranges)}) if held and ranges > 1 else []


def range_of(text: Column, borders: list[str]) -> Column:
    """Binary search as an array expression would read all borders; a batch of texts is searched at once instead."""
    if not borders:
        return F.lit(0)
    import pandas as pd

    return F.pandas_udf(lambda s: pd.Series([bisect_right(borders, x) for x in s], dtype="int32"), "int")(text)


def common_prefix(a: Column, b: Column) -> Column:
    """Letters that two texts begin with alike; 0 where one is null."""
    same = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0))


def starting_with(prefixes: DataFrame, names: DataFrame, prefix: str = "prefix", name: str = "name", borders: list[str] | None = None) -> DataFrame:
    """``prefixes`` joined to the ``names`` that begin with them. An empty prefix begins every name."""
    borders = cuts(names, name) if borders is None else borders
    asked = prefixes.filter(F.col(prefix).isNotNull()).withColumn("_r", F.explode(F.sequence(range_of(F.col(prefix), borders), range_of(F.concat(prefix, F.lit(LAST)), borders))))
    return asked.join(names.filter(F.col(name).isNotNull()).withColumn("_r", range_of(F.col(name), borders)), "_r").filter(F.startswith(F.col(name), F.col(prefix))).drop("_r")


def complete(texts: DataFrame, names: DataFrame, least: int = 1) -> DataFrame:
    """(text, common, name) for distinct ``texts`` (text) against distinct ``names`` (name): of the names that share the longest prefix, of ``least`` letters or more, the shortest, then the first in order; null where there is none.

    Order is that of code points. Null texts and names are left out; an empty
    text shares nothing.
    """
    names = materialise(names.filter("name IS NOT NULL").select("name").distinct())
    texts = materialise(texts.filter("text IS NOT NULL").select("text").distinct())
    borders = cuts(names)
    ranged = names.withColumn("_r", range_of(F.col("name"), borders))
    # Ends of ranges: one row a range, MOST_RANGES at most.
    ends = sorted((r["_r"], r["a"], r["b"]) for r in ranged.groupBy("_r").agg(F.min("name").alias("a"), F.max("name").alias("b")).collect())
    held = dict((r, (a, b)) for r, a, b in ends)
    before, after, near = None, None, {}
    for r in range(len(borders) + 1):
        near[r] = [before, None]
        before = held.get(r, (None, before))[1]
    for r in range(len(borders), -1, -1):
        near[r][1] = after
        after = held.get(r, (after, None))[0]
    spark = names.sparkSession
    outer = F.broadcast(spark.createDataFrame([(r, a, b) for r, (a, b) in near.items()], "_r int, _before string, _after string"))
    # Names sort before texts that equal them, so that an equal name is the last one before its text.
    both = ranged.select("_r", F.col("name").alias("t"), F.lit(0).alias("kind")).unionByName(texts.select(range_of(F.col("text"), borders).alias("_r"), F.col("text").alias("t"), F.lit(1).alias("kind")))
    w = Window.partitionBy("_r").orderBy("t", "kind")
    name = F.when(F.col("kind") == 0, F.col("t"))
    placed = both.withColumn("low", F.last(name, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("high", F.first(name, True).over(w.rowsBetween(0, Window.unboundedFollowing))).filter("kind = 1")
    found = placed.join(outer, "_r").select(F.col("t").alias("text"), F.coalesce("low", "_before").alias("low"), F.coalesce("high", "_after").alias("high"))
    common = F.greatest(common_prefix(F.col("text"), F.col("low")), common_prefix(F.col("text"), F.col("high")))
    shared = materialise(found.select("text", common.alias("common")))
    able = shared.filter(F.col("common") >= max(least, 1)).withColumn("prefix", F.substring("text", F.lit(1), F.col("common")))
    best = starting_with(able.select("prefix").distinct(), names, borders=borders).groupBy("prefix").agg(F.min(F.struct(F.length("name").alias("n"), "name")).alias("b"))
    done = able.join(best, "prefix").select("text", F.col("b.name").alias("name"))
    return shared.join(done, "text", "left").select("text", "common", "name")
