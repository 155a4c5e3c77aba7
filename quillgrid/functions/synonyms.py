"""Sanity rules for harvested synonyms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.functions.names import chain

# Terms that make a text no synonym, marks of trade names.
MIXTURE_TERMS = ("mixture", "formulation", "solution", "preparation", "blend", "suspension", "emulsion", "concentrate")
GENERIC_TERMS = (
    "standard", "total", "sample", "control", "blank", "reference", "reagent", "analytical",
    "certified", "pure", "technical", "grade", "unspecified", "unknown", "other", "various",
)
TRADE_MARKS = ("®", "™", "©")
MOST_CHARS = 120

#: Why a text is dropped, in the order the rules are tried.
REASONS = ("empty", "too_long", "non_ascii", "trade_name", "mixture_term", "generic_term", "invalid_abbreviation", "duplicate")


#: What ``clean`` takes out, in this order. Fixed values.
CLEAN = ((r"\s*\[\s*\d{1,7}-\d{2}-\d\s*\]\s*$", ""), (r"\s*\([^)]*\)\s*$", ""), (r"\s+", " "))


def clean(text: Column) -> Column:
    """Without a number in square brackets or a remark in round ones at the end."""
    return F.trim(chain(text, *CLEAN))


def _holds(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(text).contains(t) for t in terms))


def is_abbreviation(text: Column) -> Column:
    return F.length(text).between(2, 10) & text.rlike(r"^[a-zA-Z0-9\-.']+$")


def reason(text: Column, single_substance: Column, most: int = MOST_CHARS, ascii_only: bool = True) -> Column:
    """Why a cleaned text is dropped, or null. Duplicates are left to ``keep_synonyms``."""
    rules = F.when(F.coalesce(text, F.lit("")) == "", "empty").when(F.length(text) > most, "too_long")
    if ascii_only:
        rules = rules.when(text.rlike(r"[^\x00-\x7F]"), "non_ascii")
    return (
        rules.when(reduce(lambda a, b: a | b, (text.contains(m) for m in TRADE_MARKS)), "trade_name")
        .when(single_substance & _holds(text, MIXTURE_TERMS), "mixture_term")
        .when(_holds(text, GENERIC_TERMS), "generic_term")
        .when((F.length(text) <= 10) & ~is_abbreviation(text), "invalid_abbreviation")
    )


def judge_synonyms(df: DataFrame, text: str, group: str, order: str, single_substance: Column | None = None, most: int = MOST_CHARS) -> DataFrame:
    """Add ``cleaned`` and ``reason``: of equal texts (whatever their case) within a group the first by ``order`` stays."""
    judged = df.withColumn("cleaned", clean(F.col(text))).withColumn("reason", reason(F.col("cleaned"), F.lit(True) if single_substance is None else single_substance, most))
    nth = F.row_number().over(Window.partitionBy(group, F.lower("cleaned"), F.col("reason").isNull()).orderBy(order))
    return judged.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate").otherwise(F.col("reason")))


def letter_share(text: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(text))


def is_plausible(text: Column, most: int = 200) -> Column:
    """Short enough, not a bare number, and a third of it letters or near."""
    t = F.trim(text)
    return F.coalesce(F.length(t).between(1, most) & ~t.rlike(r"^[\d\-]+$") & (letter_share(t) >= 0.3), F.lit(False))
