"""Phases of the cascade beyond exact and similar names: numbers, vendor cache, vectors, lookups, conflicts, novel names, names beyond ASCII."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.functions import names, registry_numbers
from quillgrid.operators import matching
from quillgrid.plans.registry import SYNONYMS_SQL, analytes, norm_sql, query, ratio_sql, synonyms, table

#: Length of the stand-in vectors: one place for each registry name, of which there are fewer.
DIM = 256
_DAY = "2024-12-31"


def _numbered(spark, sf_dir):
    """The registry with numbers whose check digit holds, and each entry's place in it."""
    a = analytes(spark, sf_dir).withColumn("k", F.substring("analyte_id", 2, 20).cast("long"))
    any_digit = F.array(*(F.concat((F.col("k") + 10).cast("string"), F.lit(f"-11-{d}")) for d in range(10)))
    return a.select("analyte_id", "preferred_name", "k", F.get(F.filter(any_digit, registry_numbers.is_valid), F.lit(0)).alias("cas_number"), (F.row_number().over(Window.orderBy("k")) - 1).alias("i"))


_NUMBERED = (
    f"{SYNONYMS_SQL}, numbered AS (SELECT analyte_id, preferred_name, k, (k + 10) || '-11-' || list_sum(list_transform(range(1, len(body) + 1), lambda i: substr(body, len(body) + 1 - i::INT, 1)::INT * i)) % 10 AS number, "
    "lead(analyte_id, 1, first) OVER (ORDER BY k) AS other FROM (SELECT *, (k + 10) || '11' AS body, first(analyte_id) OVER (ORDER BY k) AS first FROM analytes))"
)
_TAIL = "preferred_name || repeat('x', len(preferred_name) // 3)"


@query(
    f"WITH {_NUMBERED}, mixed AS (SELECT {_TAIL} AS input_text, other, {norm_sql(_TAIL)} AS norm FROM numbered), "
    f"pairs AS (SELECT input_text, other, s.analyte_id, synonym_id, {ratio_sql('norm', 'synonym_norm')} AS sim FROM mixed, synonyms s WHERE 2.0 * least(len(norm), len(synonym_norm)) >= 0.73 * (len(norm) + len(synonym_norm))), "
    "fuzzy AS (SELECT *, row_number() OVER (PARTITION BY input_text ORDER BY sim DESC, synonym_id) AS rank FROM pairs WHERE sim >= 0.75 QUALIFY rank <= 5), "
    "told AS (SELECT input_text, count(CASE WHEN analyte_id <> other AND sim > 0.75 THEN 1 END) > 0 AS conflict, count(CASE WHEN rank <= 2 THEN 1 END) = 2 AND count(DISTINCT CASE WHEN rank <= 2 THEN analyte_id END) = 2 AND max(CASE WHEN rank = 1 THEN sim END) - max(CASE WHEN rank = 2 THEN sim END) < 0.05 AS dis FROM fuzzy GROUP BY 1) "
    "SELECT 'number' AS kind, 'no. ' || number || ' x' AS input_text, analyte_id, 1.0::DOUBLE AS confidence, 'cas_extracted' AS method, 'AUTO_ACCEPT' AS band, false AS conflict FROM numbered "
    "UNION ALL SELECT 'vendor', 'vv ' || k, analyte_id, 0.95, 'vendor_cache', 'AUTO_ACCEPT', false FROM numbered "
    "UNION ALL SELECT 'lookup', 'kq ' || k || ' kq', analyte_id, 1.0, 'api', 'AUTO_ACCEPT', false FROM numbered "
    "UNION ALL SELECT 'vector', 'wk' || k || 'wk', analyte_id, 1.0, 'semantic', 'AUTO_ACCEPT', false FROM numbered "
    "UNION ALL SELECT 'conflict', input_text, other, CASE WHEN conflict OR dis THEN 0.84 ELSE 1.0 END, 'semantic', CASE WHEN conflict OR dis THEN 'REVIEW' ELSE 'AUTO_ACCEPT' END, coalesce(conflict, false) FROM mixed LEFT JOIN told USING (input_text)"
)
def cascade_phases(spark, sf_dir):
    """Inputs that only a number, the vendor's cache, a vector or a lookup can match, and inputs of which names and vectors say different things."""
    a, s = _numbered(spark, sf_dir), synonyms(spark, sf_dir)
    k, n = F.col("k").cast("string"), F.count("*").over(Window.partitionBy())
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), text.alias("input_text"), F.lit(vendor).cast("string").alias("lab")) for kind, text, vendor in (
        ("number", F.concat(F.lit("no. "), "cas_number", F.lit(" x")), None), ("vendor", F.concat(F.lit("vv "), k), "LAB"), ("lookup", F.concat(F.lit("kq "), k, F.lit(" kq")), None),
        ("vector", F.concat(F.lit("wk"), k, F.lit("wk")), None), ("conflict", F.concat("preferred_name", F.repeat(F.lit("x"), F.floor(F.length("preferred_name") / 3).cast("int"))), None),
    ))))
    asked = a.withColumn("n", n).select("k", "i", "n", "analyte_id", "cas_number", kinds.alias("x")).select("*", "x.*").drop("x")
    inputs = matching.distinct_inputs(asked, "input_text", "lab")
    place = lambda i: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda x: (x == i).cast("double"))
    query_vectors = asked.filter(F.col("kind").isin("vector", "conflict")).select(
        matching.input_id(F.col("input_text"), F.lit(None).cast("string")).alias("input_id"), place(F.when(F.col("kind") == "vector", F.col("i")).otherwise((F.col("i") + 1) % F.col("n"))).alias("vector")
    )
    vectors = a.select(F.col("k").alias("vector_id"), "analyte_id", place(F.col("i")).alias("vector"))
    day = F.lit(_DAY).cast("date")
    seen = a.select(F.col("k").alias("id"), F.lit("LAB").alias("lab_vendor"), F.concat(F.lit("vv "), k).alias("observed_text"), F.col("analyte_id").alias("validated_match_id"), day.alias("last_seen_date"), F.lit(0).alias("collision_count"), F.lit(None).cast("date").alias("last_collision_date"))
    confirmed = a.select(F.col("k").alias("variant_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("submission_id"), F.lit(True).alias("valid_for_consensus"))
    lookup = a.select(F.concat(F.lit("kq "), k, F.lit(" kq")).alias("key"), F.array(F.lit("7732-18-5"), "cas_number").alias("numbers"))
    done = matching.resolve(inputs, a, s, cache=matching.vendor_cache(seen, confirmed, day), lookup=lookup, query_vectors=query_vectors, vectors=vectors)
    told = done.select("input_text", "analyte_id", F.round("confidence", 9).alias("confidence"), "method", "band", F.col("signals.cross_method_conflict").alias("conflict"))
    return asked.select("kind", "input_text").join(told, "input_text")


_STRANGE = "'zq' || reverse(preferred_name) || 'kw'"


@query(
    f"WITH {SYNONYMS_SQL}, inputs AS (SELECT {_STRANGE} AS input_text, {norm_sql(_STRANGE)} AS norm FROM analytes), "
    f"pairs AS (SELECT input_text, s.analyte_id, synonym_id, {ratio_sql('norm', 'synonym_norm')} AS sim FROM inputs, synonyms s), "
    "fuzzy AS (SELECT *, row_number() OVER (PARTITION BY input_text ORDER BY sim DESC, synonym_id) AS rank FROM pairs WHERE sim >= 0.4 QUALIFY rank <= 5), "
    "best AS (SELECT input_text, max(sim) AS c, count(CASE WHEN rank <= 2 THEN 1 END) = 2 AND count(DISTINCT CASE WHEN rank <= 2 THEN analyte_id END) = 2 AND max(CASE WHEN rank = 1 THEN sim END) - max(CASE WHEN rank = 2 THEN sim END) < 0.05 AS dis FROM fuzzy GROUP BY 1) "
    "SELECT input_text, CASE WHEN c IS NULL THEN 'UNKNOWN' WHEN c < 0.5 THEN 'NOVEL_COMPOUND' WHEN CASE WHEN dis THEN least(c, 0.84) ELSE c END >= 0.75 THEN 'REVIEW' ELSE 'UNKNOWN' END AS band FROM inputs LEFT JOIN best USING (input_text)"
)
def novel_gate(spark, sf_dir):
    """With a low threshold, names that resemble something, but too little to be it, are novel."""
    strange = analytes(spark, sf_dir).select(F.concat(F.lit("zq"), F.reverse("preferred_name"), F.lit("kw")).alias("input_text"))
    done = matching.resolve(matching.distinct_inputs(strange), analytes(spark, sf_dir), synonyms(spark, sf_dir), threshold=0.4)
    return done.select("input_text", "band")


_WIDE = "".join(chr(0xFF21 + i) for i in range(26)) + "".join(chr(0xFF41 + i) for i in range(26))


@query(f"WITH {SYNONYMS_SQL} SELECT k AS partkey, {norm_sql('preferred_name')} AS norm, (SELECT arg_min(s.analyte_id, synonym_id) FROM synonyms s WHERE synonym_norm = {norm_sql('preferred_name')}) AS analyte_id FROM analytes")
def unicode_names(spark, sf_dir):
    """Names in full-width letters have the form of their plain ones, and match as these do."""
    a = analytes(spark, sf_dir).withColumn("k", F.substring("analyte_id", 2, 20).cast("long"))
    wide = a.select(F.col("k").alias("partkey"), F.translate("preferred_name", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _WIDE).alias("input_text"))
    inputs = matching.distinct_inputs(wide)
    found = matching.match_exact(inputs, synonyms(spark, sf_dir), a).select("input_id", "analyte_id")
    return inputs.join(found, "input_id", "left").join(wide, "input_text").select("partkey", "norm", "analyte_id")


@query(
    f"WITH {SYNONYMS_SQL} SELECT synonym_norm, CAST(min_confidence AS DOUBLE) AS min_confidence, count(CASE WHEN confidence >= min_confidence THEN 1 END) AS held FROM (SELECT *, CASE WHEN lab_vendor IS NULL THEN 1.0 ELSE 0.8 END AS confidence FROM synonyms), (SELECT unnest([0.0, 0.8, 0.9]) AS min_confidence) GROUP BY 1, 2"
)
def synonyms_from_confidence(spark, sf_dir):
    """How many synonyms of a form a lookup with a least confidence gets."""
    s = synonyms(spark, sf_dir).withColumn("confidence", F.when(F.col("lab_vendor").isNull(), 1.0).otherwise(0.8))
    asked = s.select("synonym_norm").distinct().withColumn("min_confidence", F.explode(F.array(*map(F.lit, (0.0, 0.8, 0.9)))))
    held = matching.synonyms_of(asked, s, F.col("min_confidence"))
    return held.groupBy("synonym_norm", "min_confidence").agg(F.count("synonym_id").alias("held"))


@query(
    "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CASE c_custkey % 4 WHEN 0 THEN '7732-18-5' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE '50-00-0' END AS formatted, c_custkey % 4 IN (0, 1) AS looks, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_numbers FROM customer"
)
def number_forms(spark, sf_dir):
    """Digits put into the form of a number, texts that look like one, and all valid numbers of a text."""
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, "7732-18-5").when(k == 1, "7732-18-4").when(k == 2, "50-00-0 and 64-17-5, not 64-17-4").otherwise("50000")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), text.alias("t"))
    t = F.col("t")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 4 != 2, registry_numbers.format_digits(t)).alias("formatted"), (registry_numbers.looks_like(t) & (F.col("c_custkey") % 4 != 2)).alias("looks"), F.size(registry_numbers.extract_all(t)).alias("n_numbers"))


@query("SELECT p_partkey, trim(regexp_replace(p_type, '\\s+', ' ', 'g')) AS plain, regexp_replace(lower(p_name), '[,\\s\\-()]', '', 'g') AS compact FROM part")
def name_clean_up(spark, sf_dir):
    """Names without remarks and Roman numerals, and compact forms."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", names.without_annotations(F.concat("p_type", F.lit(" (dissolved) IV"))).alias("plain"), names.compact(F.col("p_name")).alias("compact"))
