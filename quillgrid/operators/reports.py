"""Joins, conditional aggregation, pivots and integrity reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; a null condition does not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def effective_id(corrected: Column, automatic: Column) -> Column:
    """The human correction where there is one."""
    return F.coalesce(F.nullif(F.trim(corrected), F.lit("")), automatic)


def enrich(results: DataFrame, analytes: DataFrame, key: str) -> DataFrame:
    """Left join of names and groups, blank where unknown. The registry is a dimension; Spark broadcasts it by its size."""
    names = analytes.select(F.col("analyte_id").alias("_id"), "preferred_name", "group_code")
    return results.join(names, F.col(key) == F.col("_id"), "left").drop("_id").fillna("", ["preferred_name", "group_code"])


def with_parent(analytes: DataFrame) -> DataFrame:
    parent = analytes.select(F.col("analyte_id").alias("_p"), F.col("preferred_name").alias("parent_name"))
    return analytes.join(parent, F.col("parent_analyte_id") == F.col("_p"), "left").drop("_p")


def coverage(analytes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Synonyms per analyte. ``rows`` is what an outer join counts (1 for none), ``synonyms`` the true number."""
    return analytes.join(synonyms.select("analyte_id", "synonym_id"), "analyte_id", "left").groupBy("analyte_id").agg(F.count("*").alias("rows"), F.countDistinct("synonym_id").alias("synonyms"))


def submission_summary(submissions: DataFrame, results: DataFrame, key: str, confidence: str, status: str) -> DataFrame:
    """Per submission: totals by status, high share, and mean confidence of what is accepted."""
    rows = submissions.select(key).join(results.select(key, confidence, status), key, "left")
    c, s = F.col(confidence), F.col(status)
    return rows.groupBy(key).agg(
        F.count(status).alias("total"), count_where(s == "validated").alias("validated"), count_where(s == "pending").alias("pending"), count_where(s == "skipped").alias("skipped"),
        count_where(c >= 0.95).alias("high"), F.avg(F.when(s == "validated", c)).alias("mean_accepted"),
    )


def all_high(summary: DataFrame) -> DataFrame:
    return summary.filter("total = high AND total > 0")


def histogram(df: DataFrame, value: Column, cuts: tuple[tuple[float, str], ...], below: str) -> DataFrame:
    """Named buckets, the highest first."""
    bucket = F.when(F.lit(False), "")
    for least, name in cuts:
        bucket = bucket.when(value >= least, name)
    return df.groupBy(bucket.otherwise(below).alias("bucket")).agg(F.count("*").alias("n"), F.min(value).alias("least")).orderBy(F.desc("least"))


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def pivot_first(df: DataFrame, row: str, column: str, values: list[str], value: Column, order: str) -> DataFrame:
    """One column per value, the first entry by ``order`` in each cell. Values are given, so no extra pass looks for them."""
    held = df.select(row, column, F.struct(F.col(order).alias("o"), value.alias("v")).alias("e"))
    wide = held.groupBy(row).pivot(column, values).agg(F.min("e"))
    return wide.select(row, *(F.col(f"`{v}`.v").alias(v) for v in values))


def consistency(results: DataFrame, name: str, file: str, analyte: str) -> DataFrame:
    """Names in several files: how many files and analytes, and whether they agree."""
    return (
        results.groupBy(name).agg(F.countDistinct(file).alias("files"), F.countDistinct(analyte).alias("analytes"), F.count("*").alias("n"))
        .filter("files > 1").withColumn("consistent", F.col("analytes") == 1)
    )


def first_last_trend(df: DataFrame, order: str, value: str, n: int = 3) -> DataFrame:
    """One row: means of the first and last ``n`` rows and their difference."""
    first = df.orderBy(order).limit(n).agg(F.avg(value).alias("first_mean"))
    last = df.orderBy(F.desc(order)).limit(n).agg(F.avg(value).alias("last_mean"))
    return first.join(last, F.lit(True)).withColumn("change", F.col("last_mean") - F.col("first_mean"))


def review_queue(decisions: DataFrame, text: str, analyte: str, confidence: str, ts: str, since: Column, below: float = 0.85, least: int = 1) -> DataFrame:
    """Texts that are unmatched or doubtful since a day: how often, the best candidate so far and its confidence."""
    doubt = decisions.filter((F.col(ts) >= since) & (F.col(analyte).isNull() | (F.col(confidence) < below)))
    grouped = doubt.groupBy(F.trim(text).alias("text")).agg(
        F.count("*").alias("frequency"), F.max(confidence).alias("best_confidence"), F.max_by(analyte, F.struct(F.col(confidence), F.col(analyte))).alias("best_match"), F.max(ts).alias("last_seen")
    )
    return grouped.filter(F.col("frequency") >= least)


def review_items(decisions: DataFrame, analytes: DataFrame, variants: DataFrame, since: Column, below: float = 0.85, least: int = 1) -> DataFrame:
    """The review queue with what a reviewer needs to see.

    ``decisions``: (id, input_text, analyte_id, confidence, candidates, ts). Of a
    text's doubtful decisions the one of highest confidence above 0 gives the
    match (ties: the earliest), the latest that has candidates gives these.
    ``variants``: (observed_text, lab_vendor, matrix, frequency_count); the
    first by vendor gives vendor and matrix and may raise the frequency. Null
    texts are no items.
    """
    when = F.struct("ts", "id")
    doubt = decisions.filter((F.col("ts") >= since) & (F.col("analyte_id").isNull() | (F.col("confidence") < below)) & F.col("input_text").isNotNull())
    scored = F.when(F.col("confidence") > 0, F.struct((-F.col("confidence")).alias("order"), "ts", "id"))
    grouped = doubt.groupBy(F.trim("input_text").alias("text")).agg(
        F.count("*").alias("seen"), F.min_by("analyte_id", scored).alias("analyte_id"), F.coalesce(F.max(F.when(F.col("confidence") > 0, F.col("confidence"))), F.lit(0.0)).alias("best_confidence"),
        F.max_by("candidates", F.when(F.col("candidates").isNotNull(), when)).alias("candidates"), F.max("ts").alias("last_seen"),
    )
    known = variants.groupBy(F.col("observed_text").alias("text")).agg(F.min_by(F.struct("lab_vendor", "matrix", "frequency_count"), F.struct("lab_vendor", "matrix", "frequency_count")).alias("v"))
    named = grouped.filter(F.col("seen") >= least).join(analytes.select("analyte_id", F.col("preferred_name").alias("best_match_name")), "analyte_id", "left").join(known, "text", "left")
    often = F.greatest("seen", F.coalesce(F.col("v.frequency_count"), F.lit(0)).cast("long"))
    return named.select("text", often.alias("frequency"), F.col("analyte_id").alias("best_match_id"), "best_match_name", "best_confidence", "candidates", F.col("v.lab_vendor").alias("lab_vendor"), F.col("v.matrix").alias("matrix"), "last_seen")


def sections(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by every single key in one pass, one section a key."""
    own = [F.grouping(k) == 0 for k in keys]
    label = F.coalesce(*(F.when(g, F.lit(k)) for g, k in zip(own, keys, strict=True)))
    value = F.coalesce(*(F.when(g, F.col(k).cast("string")) for g, k in zip(own, keys, strict=True)))
    grouped = df.groupingSets([[F.col(k)] for k in keys], *(F.col(k) for k in keys)).agg(label.alias("section"), value.alias("value"), F.count("*").alias("n"))
    return grouped.select("section", "value", "n")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def search(df: DataFrame, column: str, needle: str, limit: int) -> DataFrame:
    """Case-insensitive search; ``%`` and ``_`` of the needle stand for themselves."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.filter(F.col(column).ilike(f"%{escaped}%")).orderBy(column).limit(limit)


def filters(vendor: str | None = None, status: str | None = None, text: str | None = None, band: tuple[float, float] | None = None) -> Column:
    """Conjunction of the filters that are set."""
    out = F.lit(True)
    if vendor:
        out &= F.col("vendor") == vendor
    if status:
        out &= F.col("validation_status") == status
    if text:
        out &= F.col("chemical_raw").ilike(f"%{text}%")
    if band:
        out &= F.col("match_confidence").between(*band)
    return out


def verdict(looked_up: Column, found: Column, given: Column, names_agree: Column) -> Column:
    """CORRECT, LIKELY, WRONG, UNCERTAIN, NOT_FOUND or NO_MATCH of an outside check."""
    return (
        F.when(given.isNull(), "NO_MATCH").when(~F.coalesce(looked_up, F.lit(False)), "NOT_FOUND").when(found == given, "CORRECT")
        .when(found.isNull() & names_agree, "LIKELY").when(found.isNull(), "UNCERTAIN").otherwise("WRONG")
    )


def candidates_json(candidates: Column, n: int = 3) -> Column:
    """The first candidates as JSON, rounded."""
    return F.to_json(F.slice(F.transform(candidates, lambda c: F.struct(c["analyte_id"].alias("id"), F.round(c["confidence"], 3).alias("confidence"))), 1, n))


def rank_by(df: DataFrame, key: str, *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
