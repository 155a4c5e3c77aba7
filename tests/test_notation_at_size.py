"""Long chains of patterns are worked out once a distinct text, not once a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import names, qualifiers
from quillgrid.plans import catalogue


def test_notation_forms_has_no_pattern_over_all_rows(spark, sf_dir):
    plan = catalogue.QUERIES["notation_forms"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" not in plan.lower()


def test_forms_of_repeated_and_missing_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["TCE ", None, "TCE ", "", "Cr6+", None])], "id long, t string")
    got = names.with_forms(df, "t", long=qualifiers.regional(F.col("t")), short=qualifiers.is_short_form(F.col("t"))).orderBy("id").collect()
    want = df.select("id", "t", qualifiers.regional(F.col("t")).alias("long"), qualifiers.is_short_form(F.col("t")).alias("short")).orderBy("id").collect()
    assert got == want
