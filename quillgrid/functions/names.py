"""Name normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.storage import materialise

# Words written out, Greek letter names and their symbols.
SPELLED = {"tert": "tertiary", "sec": "secondary", "iso": "iso", "ortho": "ortho", "meta": "meta", "para": "para"}
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ",
    "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "omicron": "ο", "pi": "π",
    "rho": "ρ", "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
}


def chain(text: Column, *rules: tuple[str, str]) -> Column:
    """Replacements applied one after the other."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def _word(word: str) -> str:
    return rf"(?i)\b{word}\b"


def _compose(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def fold_unicode(text: Column) -> Column:
    """NFKC and case folding, which have no built-in."""
    return F.pandas_udf(lambda t: _fold(_compose(t)), "string")(text)


def with_normal_form(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``, the form of a text: NFKC first, case folding last. These have no built-in, so rows that are not ASCII, and only they, pass Python."""
    odd = F.coalesce(F.col(text).rlike(r"[^\x00-\x7F]"), F.lit(False))
    compose, fold = F.pandas_udf(_compose, "string"), F.pandas_udf(_fold, "string")
    plain = df.filter(~odd).withColumn(out, normalise(F.col(text)))
    return plain.unionByName(df.filter(odd).withColumn(out, fold(normalise(compose(F.col(text))))))


def with_forms(df: DataFrame, text: str, **forms: Column) -> DataFrame:
    """``df`` with columns that depend on ``text`` alone, computed once for each of its distinct values, in tasks of their own."""
    spark = df.sparkSession
    texts = df.select(F.col(text).alias("_text")).distinct()
    # A long chain of patterns is much work a row: a file or two of texts must not be one task.
    texts = texts.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_text").withColumnRenamed("_text", text)
    held = materialise(texts.select(F.col(text).alias("_text"), *(c.alias(n) for n, c in forms.items())))
    few = held.limit(100_001).count() <= 100_000
    return df.join(F.broadcast(held) if few else held, F.col(text).eqNullSafe(F.col("_text")), "left").drop("_text")


def normalise(text: Column) -> Column:
    """The form names are matched in.

    Brackets, commas, dashes, quotes and colons become spaces before the
    patterns that would need them, so locants like ``o-`` are not spelled out;
    and a space follows every r, s, e or z that stands before a letter. Both
    are parts of the form, which is why it is not idempotent: normalise raw
    names once. Names that may not be ASCII take ``with_normal_form``.
    """
    spaced = chain(text, (r"[(){}\[\],'\";:\-‐-―−]", " "), (r"\s+", " "))
    spelled = chain(spaced, *((_word(k), v) for k, v in SPELLED.items()), *((_word(k), v) for k, v in GREEK.items()))
    split = F.regexp_replace(spelled, r"([+±RSEZrsez])([a-zA-Z])", "$1 $2")
    return F.coalesce(F.trim(chain(F.lower(F.regexp_replace(split, r"\.+\s*$", "")), (r"\s+", " "))), F.lit(""))


def compact(text: Column) -> Column:
    """Lower case without spaces, dashes, commas and brackets, for containment tests."""
    return F.regexp_replace(F.lower(text), r"[,\s\-()]", "")


def contains_either_way(a: Column, b: Column) -> Column:
    a, b = compact(a), compact(b)
    return (a != "") & (b != "") & (a.contains(b) | b.contains(a))


def without_annotations(text: Column) -> Column:
    """Without bracketed remarks and Roman numerals."""
    return F.trim(chain(text, (r"\([^)]*\)", " "), (r"\b(?:III|II|IV|VI|V|I)\b", " "), (r"\s+", " ")))


def identifier_in_brackets(text: Column) -> Column:
    """``ID`` of ``Name (ID)``, or the whole text."""
    found = F.regexp_extract(text, r"\(([A-Z0-9_]+)\)\s*$", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def percent(text: Column) -> Column:
    """``98.5%`` as 0.985; null if it is not a number."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double") / 100.0


def submission_in_filename(name: Column) -> Column:
    return F.regexp_extract(name, r"validation_(\d+)_", 1).try_cast("long")


def confidence_of_label(label: Column) -> Column:
    return F.when(F.upper(label) == "HIGH", 1.0).when(F.upper(label) == "LOW", 0.8).otherwise(0.9)


def first_signature(text: Column, signatures: dict[str, str], default: str = "Unknown") -> Column:
    """Value of the first signature that the text holds, in order."""
    out = F.lit(default)
    for needle, value in reversed(signatures.items()):
        out = F.when(F.lower(text).contains(needle.lower()), value).otherwise(out)
    return out


def bar(share: Column, width: int = 20) -> Column:
    """Text bar of a share between 0 and 1."""
    n = F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * width).cast("int")
    return F.rpad(F.repeat(F.lit("#"), n), width, ".")
