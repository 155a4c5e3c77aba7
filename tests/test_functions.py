"""Golden values of names, numbers, qualifiers, fractions, synonyms and similarities."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.functions import names, qualifiers, registry_numbers, similarity, synonyms
from quillgrid.functions.similarity import bag_bound, indel_ratio, indel_ratio_arrow, lcs_length, letter_counts
from quillgrid.operators import matching, variants


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


NORMAL = {
    "Benzene": "be nz ene", "Benzo(a)pyrene": "be nz o a pyr ene", "Benzo[a]pyrene": "be nz o a pyr ene", "1,4-Dioxane": "1 4 dioxane",
    "tert-Butanol": "te rtiar y butanol", "alpha-BHC": "α bhc", "Xylenes, total": "xyle ne s total", "PHC F2 (C10-C16)": "phc f2 c10 c16",
    "Cr(VI)": "cr vi", "Chromium (VI)": "chr omium vi", "o-Xylene": "o xyle ne", "n-Hexane": "n he xane", "Arsenic, total": "ar se nic total",
    "71-43-2": "71 43 2", "(R)-2-Butanol": "r 2 butanol", "Toluene": "tolue ne", "": "", " .. ": "",
}


def test_normalise(spark):
    assert column(spark, [*NORMAL, None], names.normalise) == [*NORMAL.values(), ""]
    assert column(spark, ["Benzene"], lambda c: names.normalise(names.normalise(c))) == ["be nz e ne"]
    assert column(spark, ["ﬁne Straße", None], names.fold_unicode) == ["fine strasse", None]


def test_registry_numbers(spark):
    cases = {"71-43-2": "71-43-2", "Benzene (CAS 71-43-2)": "71-43-2", "100-41-4 Ethylbenzene": "100-41-4", "No number": None, "Invalid 999-99-999": None, "71432": None, "71-43-3 then 108-88-3": "108-88-3"}
    assert column(spark, cases, registry_numbers.extract) == list(cases.values())
    assert column(spark, ["71432", "108883", "12", "71433"], registry_numbers.format_digits) == ["71-43-2", "108-88-3", None, None]
    assert column(spark, ["71-43-2", "71-43-3", "x", None, "1-11-4"], registry_numbers.is_valid) == [True, False, False, False, False]
    assert column(spark, ["0071-43-2", "7143 2"], lambda c: registry_numbers.same(c, F.lit("71-43-2"))) == [True, True]


def test_fractions(spark):
    cases = {
        "PHC F1": "F1", "F1": "F1", "Fraction 1": "F1", "C6-C10": "F1", "PHC F2 (C10-C16)": "F2", "F2 (C10-C16)": "F2", "C10-C16": "F2", "PHC F3": "F3",
        "F3 (C16-C34)": "F3", "PHC F4": "F4", ">C34": "F4", "Greater than C34": "F4", "C10 to C17": "F2", "Not a fraction": None,
    }
    assert column(spark, cases, qualifiers.fraction) == list(cases.values())
    assert column(spark, ["PHC F2 (C10-C16)", "Toluene"], qualifiers.fraction_notation) == ["phc f2", "Toluene"]
    assert column(spark, ["f4", "F9"], lambda c: qualifiers.fraction_range(c)["low"]) == ["C34", None]
    assert column(spark, ["Total PHC", "lead"], qualifiers.is_petroleum) == [True, False]


def test_qualifiers(spark):
    strip = lambda c: qualifiers.strip_qualifiers(c)
    got = column(spark, ["Iron (Total Recoverable)", "Arsenic, total", "Hexavalent chromium", "Lead", None], strip)
    assert [(r["clean"], r["stripped"]) for r in got] == [("Iron", ["total recoverable"]), ("Arsenic", ["total"]), ("chromium", ["hexavalent"]), ("Lead", []), ("", [])]
    kept = column(spark, ["Chromium, Hexavalent"], lambda c: qualifiers.strip_qualifiers(c, ("hexavalent",)))[0]
    assert (kept["clean"], kept["stripped"]) == ("Chromium, Hexavalent", [])
    assert column(spark, ["1,4 Diox", "1, 1, 1-TCA", "PHC F2", "Total P", "2, 4-D"], qualifiers.regional) == ["1,4-dioxane", "1,1,1-trichloroethane", "petroleum hydrocarbons f2", "phosphorus, total", "2,4-d"]


def test_cells(spark):
    assert column(spark, ["<0.5", "> 1,200.5", "ND", "7"], qualifiers.cell_number) == [0.5, 1200.5, None, 7.0]
    assert column(spark, ["<0.5", "12"], qualifiers.cell_qualifier) == ["<", None]
    assert column(spark, ["x GW y.xlsx", "soil.xlsx"], qualifiers.medium_of_filename) == ["Water", ""]
    assert column(spark, ["98.5%", "x"], names.percent) == [0.985, None]


def test_synonym_rules(spark):
    cases = {
        "Benzene [71-43-2]": None, "x" * 121: "too_long", "naïve": "non_ascii", "Benzene solution": "mixture_term", "pure benzene": "generic_term",
        "a b": "invalid_abbreviation", "": "empty", "(only a remark)": "empty", "benzene": "duplicate", "DDT": None, "Acme®": "non_ascii",
    }
    rows = spark.createDataFrame([(i, "g", t) for i, t in enumerate(cases)], "i int, g string, t string")
    got = [r["reason"] for r in synonyms.judge_synonyms(rows, "t", "g", "i").orderBy("i").collect()]
    assert got == list(cases.values())


RATIOS = {
    ("Benzen", "Benzene"): 0.941176, ("Benzine", "Benzene"): 0.888889, ("Benzine", "Benzol"): 0.705882, ("Tolune", "Toluene"): 0.857143, ("Napthalene", "Naphthalene"): 0.956522,
}


def test_indel_ratio(spark):
    rows = [(names_[0], names_[1], r) for names_, r in RATIOS.items()]
    df = spark.createDataFrame(rows, "a string, b string, r double").select(names.normalise(F.col("a")).alias("a"), names.normalise(F.col("b")).alias("b"), "r")
    for x, y, r, s in df.select("r", indel_ratio(F.col("a"), F.col("b")), indel_ratio_arrow(F.col("a"), F.col("b")), bag_bound(F.col("a"), F.col("b"), letter_counts(F.col("a")), letter_counts(F.col("b")))).collect():
        assert x == pytest.approx(y, abs=1e-6) and y == r and s >= y
    assert 2 * lcs_length("kitten", "sitting") / 13 == pytest.approx(0.615385, abs=1e-6)


def test_lcs_against_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]


def test_decay(spark):
    ages = [0, 37, 38, 90, 180, 400]
    got = column(spark, ages, lambda a: 0.95 * matching.decay(a), "int")
    assert got == pytest.approx([0.95, 0.930472, 0.929944, 0.9025, 0.855, 0.855], abs=1e-6)


def test_vendor_cache(spark):
    as_of = date(2024, 6, 1)
    day = lambda n: as_of - timedelta(days=n)
    variants_ = spark.createDataFrame(
        [(1, "v", "a", "A", day(0), 0, None), (2, "v", "b", "A", day(0), 3, day(1)), (3, "v", "c", "A", day(0), 3, day(30)), (4, "v", "d", None, day(0), 0, None), (5, "v", "e", "A", day(90), 1, day(3))],
        "id long, lab_vendor string, observed_text string, validated_match_id string, last_seen_date date, collision_count int, last_collision_date date",
    )
    confirmed = [(1, s) for s in range(3)] + [(2, s) for s in range(9)] + [(3, s) for s in range(8)] + [(4, s) for s in range(5)] + [(5, s) for s in range(3)]
    c = spark.createDataFrame([(v, s, True) for v, s in confirmed], "variant_id long, submission_id long, valid_for_consensus boolean")
    got = {r["observed_text"]: (round(r["confidence"], 4), r["stale"]) for r in matching.vendor_cache(variants_, c, F.lit(as_of)).collect()}
    assert got == {"a": (0.95, False), "c": (0.95, False)}


def test_thresholds():
    assert Thresholds().problems() == []
    assert Thresholds.load("matching:\n  auto_accept: 0.95\n").auto_accept == 0.95
    assert Thresholds.load(Thresholds().dump()) == Thresholds()
    with pytest.raises(ValueError, match="does not hold"):
        Thresholds().merged(review=0.9)


def test_name_structure(spark):
    r = column(spark, ["1,2-dichloroethane", "o-xylene", "2-butanol"], variants.parse_name)
    assert (r[0]["locants"], r[0]["multiplicity"], r[0]["substituents"], r[0]["chain"], r[0]["bond"]) == ([1, 2], 2, ["chloro"], "eth", "single")
    assert r[1]["aromatic"] == "1,2" and r[2]["group"] == "alcohol" and r[2]["chain"] == "but"


def test_input_ids(spark):
    """128 bits that tell texts and vendors apart wherever the border lies, nulls included."""
    pairs = [("a", None), ("a", ""), ("a", "b"), ("ab", None), ("a=b", None), ("", "a"), (None, None), (None, ""), (None, "a"), ("null=", None), ("", None), ("1:a", None)]
    df = spark.createDataFrame(pairs, "t string, v string")
    got = [r[0] for r in df.select(matching.input_id(F.col("t"), F.col("v"))).collect()]
    assert all(len(x) == 32 for x in got)
    assert len(set(got)) == len(pairs)


def test_short_forms_and_valences(spark):
    """Short forms go by the normal form, which has no brackets; null gives an empty text."""
    texts = ["TCA", "1,4 Diox", "Hexavalent Cr", "Cr6+", "Cr(VI)", "Ozone", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", qualifiers.written_out(F.col("t")).alias("w"), qualifiers.metal_notation(F.col("t")).alias("m"))
    got = {r["i"]: (r["w"], r["m"]) for r in rows.collect()}
    assert [got[i] for i in range(8)] == [
        ("trichloroethane", "tca"), ("1 4 dioxane", "1 4 diox"), ("he xavale nt cr", "he xavale nt cr"), ("chromium, hexavalent", "chromium, hexavalent"), ("cr vi", "cr vi"), ("oz one", "oz one"), ("", ""), ("", ""),
    ]


@pytest.mark.parametrize("masks", [1 << 22, 300])
def test_ratios_of_a_batch(monkeypatch, masks):
    """Batches give what pairs give: nulls, empty texts, words of 64 letters and beyond, letters beyond ASCII, zero bytes."""
    monkeypatch.setattr(similarity, "MASKS", masks)
    rng = random.Random(5)
    texts = [None, "", "a", "a\0", "\0", "é", "x" * 64, "x" * 65, "ab" * 40] + ["".join(rng.choices("abcd é漢", k=rng.randint(1, 70))) for _ in range(60)]
    pairs = [(x, y) for x in texts for y in texts]
    got = similarity._ratios(pd.Series([x for x, _ in pairs], dtype=object), pd.Series([y for _, y in pairs], dtype=object))
    for (x, y), r in zip(pairs, got, strict=True):
        if x is None or y is None:
            assert r != r
        else:
            assert r == (2 * lcs_length(x, y) / (len(x) + len(y)) if x and y else 0.0), (x, y)
