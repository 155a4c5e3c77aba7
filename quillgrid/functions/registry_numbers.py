"""Registry numbers of the form ``digits-dd-d`` with a check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values. Two grammars are in use: extraction asks for two leading digits, validation for one.
EXTRACT = r"\b(\d{2,7}-\d{2}-\d)\b"
VALIDATE = r"\b(\d{1,7}-\d{2}-\d)\b"


def check_ok(number: Column) -> Column:
    """The last digit is the sum of the others, each times its place from the right, modulo 10."""
    digits = F.regexp_replace(number, "-", "")
    body = F.reverse(F.left(digits, F.length(digits) - 1))
    places = F.filter(F.split(body, ""), lambda x: x != "")
    total = F.aggregate(F.transform(places, lambda x, i: x.cast("int") * (i + 1)), F.lit(0), lambda a, x: a + x)
    return total % 10 == F.right(digits, F.lit(1)).cast("int")


def extract_all(text: Column, grammar: str = EXTRACT) -> Column:
    """Valid numbers in order."""
    return F.filter(F.regexp_extract_all(text, F.lit(grammar), 1), check_ok)


def extract(text: Column, grammar: str = EXTRACT) -> Column:
    """First valid number, or null."""
    return F.get(extract_all(text, grammar), F.lit(0))


def looks_like(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^\d{2,7}-\d{2}-\d"), F.lit(False))


def is_valid(text: Column) -> Column:
    """The whole text is a number of the wider grammar whose check digit holds."""
    whole = F.trim(text)
    return F.coalesce(F.when(whole.rlike(r"^\d{1,7}-\d{2}-\d$"), check_ok(whole)), F.lit(False))


def format_digits(digits: Column) -> Column:
    """Hyphens put into bare digits; null unless the result is valid."""
    bare = F.regexp_replace(digits, r"[^0-9]", "")
    n = F.length(bare)
    out = F.concat_ws("-", F.substring(bare, F.lit(1), n - 3), F.substring(bare, n - 2, F.lit(2)), F.substring(bare, n, F.lit(1)))
    return F.when(n.between(5, 10) & check_ok(out), out)


def same(a: Column, b: Column) -> Column:
    """Equality without dashes, spaces and leading zeros."""
    bare_a, bare_b = (F.regexp_replace(F.regexp_replace(c, r"[-\s]", ""), "^0+", "") for c in (a, b))
    return bare_a == bare_b
