"""Work for reviewers: doubtful texts with candidates and context, boosts that decide, nearest rows of every label."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.operators import matching, reports, vector_index
from quillgrid.plans.registry import INPUTS_SQL, inputs, query, ratio_sql, rounded, synonyms, table

_SINCE = "2024-01-10"
_DECISIONS = (
    "dec AS (SELECT event_id AS id, ' ' || event_type || '-' || user_id AS input_text, CASE WHEN value >= 5 THEN 'U' || (event_id % 7) END AS analyte_id, round(least(value / 100, 1), 2)::DOUBLE AS confidence, "
    "CASE WHEN event_id % 3 > 0 THEN 'U' || (event_id % 7) || ',U' || (event_id % 11) END AS candidates, ts FROM events)"
)


@query(
    f"WITH {_DECISIONS}, doubt AS (SELECT *, trim(input_text) AS t FROM dec WHERE ts >= TIMESTAMP '{_SINCE}' AND (analyte_id IS NULL OR confidence < 0.85)), "
    "best AS (SELECT t, analyte_id FROM doubt WHERE confidence > 0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY confidence DESC, ts, id) = 1), "
    "last AS (SELECT t, candidates FROM doubt WHERE candidates IS NOT NULL QUALIFY row_number() OVER (PARTITION BY t ORDER BY ts DESC, id DESC) = 1), "
    "g AS (SELECT t, count(*) AS seen, coalesce(max(CASE WHEN confidence > 0 THEN confidence END), 0)::DOUBLE AS best_confidence, max(ts) AS last_seen FROM doubt GROUP BY 1 HAVING count(*) >= 2), "
    "var AS (SELECT event_type || '-' || user_id AS t, 'V' || min(user_id % 3) AS lab_vendor, count(*) AS f FROM events WHERE event_type <> 'view' GROUP BY 1) "
    "SELECT g.t AS text, greatest(seen, coalesce(f, 0)) AS frequency, b.analyte_id AS best_match_id, 'user ' || substr(b.analyte_id, 2) AS best_match_name, best_confidence, candidates, lab_vendor, CASE WHEN lab_vendor IS NOT NULL THEN 'soil' END AS matrix, last_seen::VARCHAR AS last_seen "
    "FROM g LEFT JOIN best b ON g.t = b.t LEFT JOIN last l ON g.t = l.t LEFT JOIN var v ON g.t = v.t"
)
def review_items(spark, sf_dir):
    """Doubtful events with their best match, last candidates and what the laboratories' variants say."""
    e = table(spark, sf_dir, "events")
    text, unit = F.concat_ws("-", "event_type", F.col("user_id").cast("string")), lambda m: F.concat(F.lit("U"), F.col("event_id") % m)
    decisions = e.select(
        F.col("event_id").alias("id"), F.concat(F.lit(" "), text).alias("input_text"), F.when(F.col("value") >= 5, unit(7)).alias("analyte_id"), rounded(F.least(F.col("value") / 100, F.lit(1.0)), 2).alias("confidence"),
        F.when(F.col("event_id") % 3 > 0, F.concat_ws(",", unit(7), unit(11))).alias("candidates"), "ts",
    )
    users = spark.range(11).select(F.concat(F.lit("U"), "id").alias("analyte_id"), F.concat(F.lit("user "), "id").alias("preferred_name"))
    variants = e.filter("event_type <> 'view'").groupBy(text.alias("observed_text")).agg(F.concat(F.lit("V"), F.min(F.col("user_id") % 3)).alias("lab_vendor"), F.count("*").alias("frequency_count")).withColumn("matrix", F.lit("soil"))
    found = reports.review_items(decisions, users, variants, F.lit(_SINCE).cast("timestamp_ntz"), least=2)
    return found.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz").cast("string"))


@query(
    f"WITH {INPUTS_SQL}, asked AS (SELECT input_text, norm, unnest([NULL, 'SGX', 'other']) AS vendor FROM inputs), "
    f"pairs AS (SELECT input_text, vendor, s.analyte_id, synonym_id, lab_vendor, {ratio_sql('norm', 'synonym_norm')} AS ratio FROM asked, synonyms s WHERE len(norm) > 0 AND len(synonym_norm) > 0 AND 2.0 * least(len(norm), len(synonym_norm)) >= 0.73 * (len(norm) + len(synonym_norm))), "
    "boosted AS (SELECT *, least(ratio + CASE WHEN vendor = lab_vendor THEN 0.02::DOUBLE ELSE 0 END, 1.0)::DOUBLE AS sim FROM pairs) "
    "SELECT input_text, coalesce(vendor, '-') AS vendor, analyte_id, row_number() OVER (PARTITION BY input_text, vendor ORDER BY sim DESC, synonym_id) AS rank, round(sim, 9) AS sim FROM boosted WHERE sim >= 0.75 QUALIFY rank <= 5"
)
def match_fuzzy_vendor(spark, sf_dir):
    """Every input asked by no vendor, the one that has synonyms of its own, and another: the boost moves ranks and lets in what lies just below."""
    vendors = F.explode(F.array(F.lit(None).cast("string"), F.lit("SGX"), F.lit("other"))).alias("vendor")
    i = matching.distinct_inputs(inputs(spark, sf_dir).select("input_text", vendors), vendor="vendor")
    found = matching.match_fuzzy(i, synonyms(spark, sf_dir))
    return found.join(i, "input_id").select("input_text", F.coalesce("vendor", F.lit("-")).alias("vendor"), "analyte_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("sim"))


_DOT = "list_dot_product(list_transform(e.embedding, lambda x: x::DOUBLE), list_transform(q.embedding, lambda x: x::DOUBLE))"


@query(f"SELECT query, label, vec_id, rank, round(s, 6) AS sim FROM (SELECT q.vec_id AS query, e.label, e.vec_id, {_DOT} AS s, row_number() OVER (PARTITION BY q.vec_id, e.label ORDER BY round({_DOT}, 12) DESC, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 3")
def closest_k_by_label(spark, sf_dir):
    """The three best of every label for each of a query set: vectors and queries meet in blocks of a label, each of which keeps three a query. Rows without a label are in no group."""
    e = table(spark, sf_dir, "embeddings").filter("label IS NOT NULL").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    labels = F.broadcast(e.select(F.col("label").alias("cell")).distinct())  # the result has a row for each of them and every query
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("input_id"), F.col("embedding").cast("array<double>").alias("q")).join(labels)
    vectors = e.select(F.col("vec_id").alias("vector_id"), F.col("label").cast("string").alias("analyte_id"), F.col("v").alias("vector"), F.col("label").alias("cell"))
    order = Window.partitionBy("input_id", "analyte_id").orderBy(F.desc(F.round("sim", 12)), "vector_id")
    best = vector_index.products(queries, vectors, least=float("-inf"), k=3).withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    kind = table(spark, sf_dir, "embeddings").schema["label"].dataType
    return best.select(F.col("input_id").alias("query"), F.col("analyte_id").cast(kind).alias("label"), F.col("vector_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))
