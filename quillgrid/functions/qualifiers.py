"""Qualifiers of measured quantities, petroleum fractions and regional notation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgrid.functions.names import chain, normalise

# Qualifiers in declared order, and those that are never stripped.
QUALIFIERS = (
    "total", "dissolved", "recoverable", "extractable", "hexavalent", "trivalent", "total recoverable", "acid extractable",
    "weak acid dissociable", "reactive", "available", "soluble", "inorganic", "organic", "elemental", "ionic", "free", "combined", "as n", "as p", "as cn",
)
ALWAYS = ("hexavalent", "trivalent", "as n", "as p", "as cn", "elemental", "ionic")

# Carbon ranges and descriptions of the fractions.
FRACTIONS = {
    "F1": ("C6", "C10", "Light aliphatic hydrocarbons (C6-C10)"),
    "F2": ("C10", "C16", "Medium aliphatic hydrocarbons (C10-C16)"),
    "F3": ("C16", "C34", "Heavy aliphatic hydrocarbons (C16-C34)"),
    "F4": ("C34", None, "Very heavy aliphatic hydrocarbons (>C34)"),
}

# Regional short forms, applied in this order, and notation variants.
SHORT_FORMS = (
    (r"\b1,4\s*diox\b", "1,4-dioxane"), (r"\bdiox\b", "dioxane"),
    (r"\b1,1,1-tca\b", "1,1,1-trichloroethane"), (r"\btca\b", "trichloroethane"), (r"\btce\b", "trichloroethylene"),
    (r"\bpce\b", "tetrachloroethylene"), (r"\bdce\b", "dichloroethylene"), (r"\bdca\b", "dichloroethane"),
    (r"\bphc\s+f([1-4])\b", "petroleum hydrocarbons f$1"),
    (r"\bhexavalent\s+cr\b", "chromium, hexavalent"), (r"\bcr\s*\(vi\)", "chromium, hexavalent"), (r"\bcr6\+", "chromium, hexavalent"),
    (r"\bpah\b", "polyaromatic hydrocarbon"), (r"\bnaph\b", "naphthalene"),
    (r"\bbtex\b", "benzene, toluene, ethylbenzene, xylene"),
    (r"\btotal\s+p\b", "phosphorus, total"), (r"\bt?p\s+\(total\)", "phosphorus, total"),
    (r"\btotal\s+n\b", "nitrogen, total"), (r"\btn\b", "nitrogen, total"), (r"\btkn\b", "nitrogen, total kjeldahl"),
)
VALENCES = ("chromium, hexavalent",)
NOTATION = ((r"\bf-?([1-4])\b", "f$1"), (r"\bp-", "para-"), (r"\bo-", "ortho-"), (r"\bm-", "meta-"), (r"\bdiss\b", "dissolved"), (r"\btot\b", "total"), (r"\brec\b", "recoverable"))


def _word(q: str) -> str:
    return rf"(?i)\b{q}\b"


def found_qualifiers(text: Column) -> Column:
    """Qualifiers that the text holds, in declared order."""
    return F.filter(F.array(*(F.when(text.rlike(_word(q)), F.lit(q)) for q in QUALIFIERS)), lambda q: q.isNotNull())


def has_qualifier(text: Column, qualifier: str) -> Column:
    return F.coalesce(text.rlike(_word(qualifier)), F.lit(False))


def strip_qualifiers(text: Column, preserve: tuple[str, ...] = ()) -> Column:
    """struct(clean, stripped): longest qualifiers go first, so ``total recoverable`` is one."""
    clean, stripped = text, []
    for q in sorted(QUALIFIERS, key=len, reverse=True):
        if q not in preserve:
            stripped.append(F.when(clean.rlike(_word(q)), F.lit(q)))
            clean = F.regexp_replace(clean, _word(q), "")
    tidy = chain(clean, (r"\(\s*\)|\[\s*\]", ""), (r"\s*,\s*(?=,|$)", ""), (r"^\s*,\s*", ""), (r"\s+", " "), (r"\s+,", ","), (r"^[\s,]+|[\s,]+$", ""))
    return F.struct(F.coalesce(tidy, F.lit("")).alias("clean"), F.filter(F.array(*stripped), lambda q: q.isNotNull()).alias("stripped"))


def keeps_qualifier(qualifier: Column, with_it: Column, without_it: Column) -> Column:
    """Whether to keep it: always for some; else if the registry tells the two forms apart."""
    return F.lower(qualifier).isin(*ALWAYS) | (F.coalesce(with_it, F.lit(False)) & F.coalesce(without_it, F.lit(False)))


def fraction(text: Column) -> Column:
    """``F1`` to ``F4`` from names, carbon ranges (each end off by one at most) or ``>C34``; else null."""
    named = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"(?i)(?:phc|petroleum\s+hydrocarbons?)\s*(?:fraction\s*)?f?([1-4])", r"(?i)\bf(?:raction\s*)?([1-4])\b")))
    ends = r"(?i)\bc(\d+)\s*(?:-|to)\s*c(\d+)\b"
    low, high = (F.regexp_extract(text, ends, k).try_cast("int") for k in (1, 2))
    ranges = [(f, int(a[1:]), int(b[1:])) for f, (a, b, _) in FRACTIONS.items() if b]
    exact = reduce(lambda c, r: c.when((low == r[1]) & (high == r[2]), r[0]), ranges, F.when(F.lit(False), ""))
    close = reduce(lambda c, r: c.when((F.abs(low - r[1]) <= 1) & (F.abs(high - r[2]) <= 1), r[0]), ranges, F.when(F.lit(False), ""))
    beyond = F.when(F.regexp_extract(text, r"(?i)>\s*c(\d+)", 1).try_cast("int") >= 34, "F4")
    lower = F.lower(text)
    spelled = F.when(lower.contains("greater than c34"), "F4")
    return F.coalesce(F.concat(F.lit("F"), named), exact, close, beyond, spelled)


def fraction_notation(text: Column) -> Column:
    """``phc f2`` where a fraction is named, else the text as it is."""
    f = fraction(text)
    return F.coalesce(F.concat(F.lit("phc "), F.lower(f)), text, F.lit(""))


def is_petroleum(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(lower.contains("phc") | lower.contains("petroleum hydrocarbon") | fraction(text).isNotNull(), F.lit(False))


def fraction_range(f: Column) -> Column:
    """struct(low, high) of a fraction, null for any other text."""
    rows = F.create_map(*(x for k, (a, b, _) in FRACTIONS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("low"), F.lit(b).cast("string").alias("high")))))
    return F.try_element_at(rows, F.upper(f))


def fraction_description(f: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in FRACTIONS.items() for x in (k, v[2]))), F.upper(f))


def number_spacing(text: Column) -> Column:
    """``1, 2, 3-`` as ``1,2,3-``."""
    return F.regexp_replace(text, r"(\d)\s*,\s*(?=\d)", "$1,")


def regional(text: Column) -> Column:
    """Short forms written out, then spacing and notation."""
    long = chain(F.lower(text), *((f"(?i){p}", v) for p, v in SHORT_FORMS))
    return F.coalesce(F.trim(chain(number_spacing(long), *((f"(?i){p}", v) for p, v in NOTATION), (r"\s+", " "))), F.lit(""))


def written_out(text: Column) -> Column:
    """The normal form with its short forms written out; empty for null."""
    return F.coalesce(chain(normalise(text), *((f"(?i){p}", v) for p, v in SHORT_FORMS)), F.lit(""))


def metal_notation(text: Column) -> Column:
    """The normal form with valence states written out as ``metal, state``; empty for null.

    Normal forms have no brackets and a space after some letters, so only
    ``Cr6+`` is still itself there; ``regional`` writes out the others.
    """
    return F.coalesce(chain(normalise(text), *((f"(?i){p}", v) for p, v in SHORT_FORMS if v in VALENCES)), F.lit(""))


def is_short_form(text: Column) -> Column:
    """The text holds a short form that ``regional`` writes out."""
    return F.coalesce(reduce(lambda a, b: a | b, (text.rlike(f"(?i){p}") for p, _ in SHORT_FORMS)), F.lit(False))


def medium_of_units(units: Column) -> Column:
    """Soil for units by mass, Water for units by volume, else empty; soil is tested first."""
    u = F.lower(units)
    any_of = lambda *needles: reduce(lambda a, b: a | b, (u.contains(n) for n in needles))
    return F.when(any_of("ug/g", "mg/kg", "µg/g", "ng/g", "ug/kg", "pg/g"), "Soil").when(any_of("ug/l", "mg/l", "µg/l", "ng/l", "pg/l"), "Water").otherwise("")


def medium_of_filename(name: Column) -> Column:
    n = F.upper(name)
    return F.when(n.contains(" GW ") | n.contains("_GW_") | n.startswith("GW"), "Water").otherwise("")


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns), F.lit(""))


def cell_qualifier(value: Column) -> Column:
    """``<`` or ``>`` in front of a result, else null."""
    return F.nullif(F.regexp_extract(F.trim(value), r"^([<>])", 1), F.lit(""))


def cell_number(value: Column) -> Column:
    """The number of a result cell, without qualifier and thousands marks."""
    found = F.regexp_extract(F.trim(value), r"^[<>]?\s*([\d.,\-]+)", 1)
    return F.regexp_replace(found, ",", "").try_cast("double")
