"""Structure of substance names, and variants of them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parent chains, bonds, functional groups, substituents, multiplicities, aromatic places.
CHAINS = (
    "meth", "eth", "prop", "but", "pent", "hex", "hept", "oct", "non", "dec", "undec", "dodec", "tridec", "tetradec", "pentadec", "hexadec",
    "benz", "naphthal", "anthrac", "phenanthr", "pyren", "chrysen", "fluoranth", "fluoren", "acenaph",
)
BONDS = {"ane": "single", "ene": "double", "yne": "triple", "adiene": "two_double", "atriene": "three_double"}
GROUPS = {"oic acid": "carboxylic_acid", "al": "aldehyde", "one": "ketone", "ol": "alcohol", "amine": "amine", "ether": "ether", "thiol": "thiol", "nitrile": "nitrile"}
SUBSTITUENTS = (
    "methyl", "ethyl", "propyl", "butyl", "pentyl", "hexyl", "chloro", "bromo", "iodo", "fluoro",
    "nitro", "amino", "hydroxy", "carboxy", "phenyl", "benzyl", "tolyl", "cyano", "acetyl", "formyl",
)
MULTIPLES = {"di": 2, "tri": 3, "tetra": 4, "penta": 5, "hexa": 6, "hepta": 7, "octa": 8, "nona": 9, "deca": 10}
AROMATIC = {"ortho": "1,2", "o": "1,2", "meta": "1,3", "m": "1,3", "para": "1,4", "p": "1,4"}

MOST_VARIANTS = 50


def _first(cases: dict[str, str], test) -> Column:
    out = F.when(F.lit(False), "")
    for k, v in cases.items():
        out = out.when(test(k), v)
    return out


def by_length(words) -> list[str]:
    return sorted(words, key=lambda c: (-len(c), c))


# Marks of stereochemistry in front of a name or its parts.
STEREO = r"\((R|S|RS|E|Z|cis|trans|\+|-|\+/-)\)-?"


def parse_name(name: Column) -> Column:
    """struct(stereo, locants, aromatic, multiplicity, substituents, chain, bond, group).

    Locants stand in front, or at the end after a comma or space; without any
    the aromatic place gives them. Of several parent chains the longest counts.
    """
    stereo = F.regexp_extract_all(name, F.lit(f"(?i){STEREO}"), 1)
    low = F.trim(F.regexp_replace(F.lower(F.trim(name)), f"(?i){STEREO}", ""))
    aromatic = _first(AROMATIC, lambda k: low.rlike(rf"^{k}-"))
    written = F.greatest(F.regexp_extract(low, r"^(\d+(?:[,-]\d+)*)-", 1), F.regexp_extract(low, r"[,\s]\s*(\d+(?:[,-]\d+)*)-?$", 1))
    locants = F.coalesce(F.when(written != "", written), aromatic, F.lit(""))
    chain = F.coalesce(*(F.when(low.contains(c), F.lit(c)) for c in by_length(CHAINS)))
    multiple = F.coalesce(*(F.when(low.rlike(rf"(?:^|[-\d ]){k}(?:{'|'.join(SUBSTITUENTS)})"), F.lit(v)) for k, v in MULTIPLES.items()))
    return F.struct(
        F.when(F.size(stereo) > 0, F.concat_ws(",", stereo)).alias("stereo"),
        F.array_sort(F.transform(F.filter(F.split(locants, "[,-]"), lambda x: x != ""), lambda x: x.try_cast("int"))).alias("locants"),
        aromatic.alias("aromatic"),
        multiple.alias("multiplicity"),
        F.filter(F.array(*(F.when(low.contains(s), F.lit(s)) for s in SUBSTITUENTS)), lambda s: s.isNotNull()).alias("substituents"),
        chain.alias("chain"),
        _first(dict(sorted(BONDS.items(), key=lambda b: -len(b[0]))), lambda k: low.rlike(f"{k}$")).alias("bond"),
        _first(GROUPS, lambda k: low.endswith(k)).alias("group"),
    )


def canonical(name: Column, parsed: Column) -> Column:
    """Sorted locants, multiplicity, substituents in order of the alphabet, chain, and group or bond; the name itself where nothing was parsed."""
    low = F.lower(F.trim(name))
    ending = lambda cases: F.coalesce(*(F.when(low.endswith(k), F.lit(k)) for k in by_length(cases)))
    back = F.coalesce(*(F.when(parsed["multiplicity"] == v, F.lit(k)) for k, v in MULTIPLES.items()), F.lit(""))
    places = F.when(F.size(parsed["locants"]) > 0, F.concat(F.concat_ws(",", F.transform(parsed["locants"], lambda x: x.cast("string"))), F.lit("-"))).otherwise(F.lit(""))
    out = F.concat(places, back, F.concat_ws("", F.array_sort(parsed["substituents"])), F.coalesce(parsed["chain"], F.lit("")), F.coalesce(ending(GROUPS), ending(BONDS), F.lit("")))
    return F.when(out == "", low).otherwise(out)


def simple_variants(name: Column) -> Column:
    """The name, and with aromatic places as locants and the other way, with and without hyphens and commas."""
    low = F.lower(F.trim(name))
    forms = [low, F.regexp_replace(low, "-", " "), F.regexp_replace(low, "-", ""), F.regexp_replace(low, ",", " ")]
    for word, places in (("ortho", "1,2"), ("meta", "1,3"), ("para", "1,4")):
        forms += [F.regexp_replace(low, rf"^(?:{word}|{word[0]})-", f"{places}-"), F.regexp_replace(low, rf"^{places}-", f"{word}-"), F.regexp_replace(low, rf"^{places}-", f"{word[0]}-")]
    return F.array_distinct(F.array(*forms))


# Points of a variant.
SAME, ALIKE, LONG, SPACED, PLACES, AROMATIC_WORD, CAPITALS, SMALL = 100.0, 10.0, -5.0, -2.0, 3.0, 2.0, -1.0, 1.0


def quality(variant: Column, original: Column) -> Column:
    """Higher is better: the name itself, alike in length, with places and aromatic words, in small letters; long, spaced and capital forms lose."""
    size, own = F.length(variant), F.length(original)
    has_case = F.lower(variant) != F.upper(variant)
    points = (
        (F.lower(variant) == F.lower(original), SAME), (size > 40, LONG), (size - F.length(F.replace(variant, F.lit(" "), F.lit(""))) > 3, SPACED), (variant.rlike(r"\d+,\d+"), PLACES),
        (F.lower(variant).rlike("ortho|meta|para"), AROMATIC_WORD), (has_case & (variant == F.upper(variant)) & (size > 5), CAPITALS), (has_case & (variant == F.lower(variant)), SMALL),
    )
    return sum((F.when(held, F.lit(n)).otherwise(F.lit(0.0)) for held, n in points), ALIKE * F.least(size, own) / F.greatest(size, own, F.lit(1)))


def quality_of(variant: str, original: str) -> float:
    """The same points for one variant, where tasks rank variants as they find them."""
    small, size, own = variant.lower(), len(variant), len(original)
    has_case = small != variant.upper()
    points = (
        (small == original.lower(), SAME), (size > 40, LONG), (variant.count(" ") > 3, SPACED), (re.search(r"[0-9]+,[0-9]+", variant), PLACES),
        (re.search("ortho|meta|para", small), AROMATIC_WORD), (has_case and variant == variant.upper() and size > 5, CAPITALS), (has_case and variant == small, SMALL),
    )
    return sum((n for held, n in points if held), ALIKE * min(size, own) / max(size, own, 1))
