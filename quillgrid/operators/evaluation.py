"""How well a resolver does: baselines of gates, bins, signals, summaries of batches, agreement across files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.operators.matching import band
from quillgrid.operators.reports import count_where, share

#: Borders of the bins that baselines report.
MARGIN_BINS = ((0.20, "wide"), (0.05, "medium"))
CONFIDENCE_BINS = ((0.95, "0.95-1.00"), (0.93, "0.93-0.95"), (0.85, "0.85-0.93"), (0.75, "0.75-0.85"), (0.50, "0.50-0.75"))
#: Methods by the class that a batch summary counts them in.
EXACT_METHODS = ("exact", "cas_extracted")


def gate_baseline(resolved: DataFrame, group: str, correct: Column, t: Thresholds = Thresholds()) -> DataFrame:
    """Per group of resolved rows: accuracy, bands, level and spread of confidence and margin, and what the margin alone held back.

    A row without a match has confidence 0. The spread is that of a sample, 0 for one row.
    """
    c, m, b = F.coalesce("confidence", F.lit(0.0)), F.col("margin"), F.col("band")
    return resolved.groupBy(group).agg(
        F.count("*").alias("items"), share(correct).alias("accuracy"), share(b == "AUTO_ACCEPT").alias("auto_rate"), share(b == "REVIEW").alias("review_rate"),
        share(~b.isin("AUTO_ACCEPT", "REVIEW")).alias("unknown_rate"), F.avg(c).alias("mean_confidence"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd_confidence"),
        F.avg(m).alias("mean_margin"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("sd_margin"),
        count_where((b == "REVIEW") & (c >= t.auto_accept) & (m < t.margin)).alias("margin_forced"),
    )


def bins(resolved: DataFrame) -> DataFrame:
    """(section, bin, n): margins and confidences by bin, in one pass."""
    c = F.coalesce("confidence", F.lit(0.0))
    cells = F.array(
        F.struct(F.lit("margin").alias("section"), band(F.col("margin"), MARGIN_BINS, "narrow").alias("bin")),
        F.struct(F.lit("confidence").alias("section"), band(c, CONFIDENCE_BINS, "0.00-0.50").alias("bin")),
    )
    return resolved.select(F.explode(cells).alias("x")).groupBy("x.section", "x.bin").agg(F.count("*").alias("n"))


def signal_counts(resolved: DataFrame) -> DataFrame:
    """(signal, n): how many rows each signal took part in. A score takes part if it is above 0, a text if there is one."""
    kinds = {f.name: f.dataType.simpleString() for f in resolved.schema["signals"].dataType.fields}
    s = F.col("signals")
    used = {k: s[k] if kind == "boolean" else s[k] > 0 if kind == "double" else s[k].isNotNull() for k, kind in kinds.items()}
    names = F.array_compact(F.array(*(F.when(u, F.lit(k)) for k, u in used.items())))
    return resolved.select(F.explode(names).alias("signal")).groupBy("signal").agg(F.count("*").alias("n"))


def batch_summary(resolved: DataFrame, millis: Column) -> DataFrame:
    """One row: rows by class of method, doubtful ones, mean confidence of the matched, time and rows a second (null for no time)."""
    method, c = F.col("method"), F.col("confidence")
    total_ms = F.coalesce(F.sum(millis), F.lit(0))
    got = resolved.agg(
        F.count("*").alias("total"), count_where(method.isin(*EXACT_METHODS)).alias("exact"), count_where(method == "fuzzy").alias("fuzzy"), count_where(method == "semantic").alias("semantic"),
        count_where(method.isNull()).alias("unknown"), count_where((F.col("band") == "REVIEW") | F.col("disagreement")).alias("review_flagged"),
        F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)).alias("mean_confidence"), total_ms.alias("total_ms"),
    )
    of_all = lambda n: F.coalesce(F.try_divide(F.col(n).cast("double"), "total"), F.lit(0.0))
    return got.withColumns({"exact_rate": of_all("exact"), "unknown_rate": of_all("unknown"), "per_second": F.try_divide(F.col("total") * 1000.0, "total_ms")})


def method_stats(decisions: DataFrame, method: str, disagreement: Column) -> DataFrame:
    """(method, n, share, disagreement_rate). The window sees one row a method."""
    by_method = decisions.groupBy(F.col(method).alias("method")).agg(F.count("*").alias("n"), share(disagreement).alias("disagreement_rate"))
    return by_method.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def common_names(results: DataFrame, name: str, confidence: Column, least: int = 5) -> DataFrame:
    """Names that appear ``least`` times or more, with their mean confidence."""
    return results.groupBy(name).agg(F.count("*").alias("appearances"), F.avg(confidence).alias("mean_confidence")).filter(F.col("appearances") >= least)


def unique_names(results: DataFrame, files: DataFrame, name: str, file: str) -> DataFrame:
    """Per file of ``files``: how many of its names appear nowhere else and once only."""
    once = results.groupBy(name).agg(F.count("*").alias("n"), F.min(file).alias(file)).filter("n = 1")
    return files.select(file).distinct().join(once.groupBy(file).agg(F.count("*").alias("unique_names")), file, "left").fillna(0, ["unique_names"])


def consistency_rate(results: DataFrame, name: str, analyte: str, least: int = 5) -> DataFrame:
    """One row: names, those with one analyte (none counts as one), their percentage, and those with ``least`` appearances or more."""
    value = F.coalesce(F.col(analyte).cast("string"), F.lit("\0"))
    # Smallest and largest tell whether there is one value; both combine before the shuffle.
    by_name = results.groupBy(name).agg(F.count("*").alias("n"), (F.min(value) == F.max(value)).alias("same"))
    got = by_name.agg(F.count("*").alias("names"), count_where(F.col("same")).alias("consistent"), count_where(F.col("n") >= least).alias("common"))
    return got.withColumn("percent", F.coalesce(F.try_divide(F.col("consistent") * 100.0, "names"), F.lit(0.0)))
