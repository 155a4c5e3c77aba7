"""Matching over the registry of part names, vectors and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.operators import matching
from quillgrid.plans.registry import INPUTS_SQL, SYNONYMS_SQL, analytes, inputs, query, ratio_sql, synonyms, table

_EXACT = "exact AS (SELECT input_text, arg_min(analyte_id, synonym_id) AS analyte_id FROM inputs JOIN synonyms ON norm = synonym_norm GROUP BY input_text)"
_FUZZY = (
    f"pairs AS (SELECT input_text, s.analyte_id, synonym_id, {ratio_sql('norm', 'synonym_norm')} AS sim FROM inputs ANTI JOIN exact USING (input_text), synonyms s WHERE len(norm) > 0 AND len(synonym_norm) > 0 "
    "AND 2.0 * least(len(norm), len(synonym_norm)) >= 0.73 * (len(norm) + len(synonym_norm))), "
    "fuzzy AS (SELECT *, row_number() OVER (PARTITION BY input_text ORDER BY sim DESC, synonym_id) AS rank FROM pairs WHERE sim >= 0.75 QUALIFY rank <= 5)"
)


@query(f"WITH {INPUTS_SQL}, {_EXACT} SELECT input_text, analyte_id FROM exact")
def match_exact(spark, sf_dir):
    i = matching.distinct_inputs(inputs(spark, sf_dir))
    return matching.match_exact(i, synonyms(spark, sf_dir), analytes(spark, sf_dir)).join(i, "input_id").select("input_text", "analyte_id")


@query(f"WITH {INPUTS_SQL}, {_EXACT}, {_FUZZY} SELECT input_text, analyte_id, synonym_id * 0 + rank AS rank, round(sim, 9) AS sim FROM fuzzy")
def match_fuzzy_topk(spark, sf_dir):
    i = matching.distinct_inputs(inputs(spark, sf_dir))
    s = synonyms(spark, sf_dir)
    open_ = i.join(matching.match_exact(i, s, analytes(spark, sf_dir)).select("input_id"), "input_id", "left_anti")
    found = matching.match_fuzzy(open_, s)
    return found.join(i, "input_id").select("input_text", "analyte_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("sim"))


_DECIDE = (
    f"{INPUTS_SQL}, {_EXACT}, {_FUZZY}, cand AS (SELECT input_text, analyte_id, 1.0::DOUBLE AS c, 1 AS phase, 1 AS rank FROM exact UNION ALL SELECT input_text, analyte_id, sim, 2, rank FROM fuzzy), "
    "uniq AS (SELECT *, row_number() OVER (PARTITION BY input_text ORDER BY c DESC, phase, rank) AS place FROM (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY input_text, analyte_id ORDER BY c DESC, phase, rank) = 1)), "
    "m AS (SELECT input_text, count(*) AS n, max(CASE WHEN place = 1 THEN c END) AS c1, max(CASE WHEN place = 2 THEN c END) AS c2 FROM uniq GROUP BY 1), "
    "d AS (SELECT input_text, count(*) = 2 AND count(DISTINCT analyte_id) = 2 AND max(sim) - min(sim) < 0.05 AS dis FROM fuzzy WHERE rank <= 2 GROUP BY 1), "
    "b AS (SELECT input_text, arg_min(analyte_id, rank) AS analyte_id, max(c) AS c, min(phase) AS phase FROM cand WHERE rank = 1 GROUP BY 1), "
    "r AS (SELECT i.input_text, b.analyte_id, CASE WHEN coalesce(dis, false) THEN least(b.c, 0.84) ELSE b.c END AS conf, phase, coalesce(dis, false) AS disagreement, coalesce(n, 0) AS n, "
    "CASE WHEN n IS NULL THEN 0.0 WHEN n = 1 THEN 1.0 ELSE c1 - c2 END AS margin FROM inputs i LEFT JOIN b USING (input_text) LEFT JOIN m USING (input_text) LEFT JOIN d USING (input_text)), "
    "g AS (SELECT *, CASE WHEN analyte_id IS NULL THEN 'UNKNOWN' WHEN conf >= 0.93 AND margin >= 0.05 THEN 'AUTO_ACCEPT' WHEN conf >= 0.75 THEN 'REVIEW' ELSE 'UNKNOWN' END AS band FROM r)"
)


def _resolved(spark, sf_dir):
    i = matching.distinct_inputs(inputs(spark, sf_dir))
    return matching.resolve(i, analytes(spark, sf_dir), synonyms(spark, sf_dir))


@query(
    f"WITH {_DECIDE} SELECT input_text, CASE WHEN band <> 'UNKNOWN' THEN analyte_id END AS analyte_id, CASE WHEN band <> 'UNKNOWN' THEN round(conf, 9) END AS confidence, "
    "CASE WHEN band <> 'UNKNOWN' THEN CASE phase WHEN 1 THEN 'exact' ELSE 'fuzzy' END END AS method, band FROM g"
)
def match_cascade(spark, sf_dir):
    return _resolved(spark, sf_dir).select("input_text", "analyte_id", F.round("confidence", 9).alias("confidence"), "method", "band")


@query(f"WITH {_DECIDE} SELECT band, count(*) AS n, count(CASE WHEN disagreement THEN 1 END) AS disagreements FROM g GROUP BY band")
def decision_gate(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy("band").agg(F.count("*").alias("n"), F.count(F.when(F.col("disagreement"), 1)).alias("disagreements"))


@query(f"WITH {_DECIDE} SELECT input_text, round(margin, 9)::DOUBLE AS margin, least(n, 5)::BIGINT AS n_candidates FROM g")
def match_margin(spark, sf_dir):
    return _resolved(spark, sf_dir).select("input_text", F.round("margin", 9).alias("margin"), F.size("candidates").cast("long").alias("n_candidates"))


@query(f"WITH {_DECIDE} SELECT input_text, disagreement, analyte_id IS NOT NULL AND band = 'REVIEW' OR disagreement AS needs_review FROM g")
def disagreement(spark, sf_dir):
    return _resolved(spark, sf_dir).select("input_text", "disagreement", ((F.col("band") == "REVIEW") | F.col("disagreement")).alias("needs_review"))


@query(f"WITH {_DECIDE} SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, band FROM lineitem JOIN part ON l_partkey = p_partkey JOIN g ON input_text = upper(p_name)")
def resolve_batch(spark, sf_dir):
    """Every line's dirty name, each distinct name resolved once."""
    named = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("dirty")), F.col("l_partkey") == F.col("p_partkey"))
    done = matching.resolve_batch(named, "dirty", None, analytes=analytes(spark, sf_dir), synonyms=synonyms(spark, sf_dir))
    return done.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "band")


_SIM = "list_dot_product(list_transform(a.embedding, lambda e: e::DOUBLE), list_transform(b.embedding, lambda e: e::DOUBLE)) / sqrt(list_dot_product(list_transform(a.embedding, lambda e: e::DOUBLE), list_transform(a.embedding, lambda e: e::DOUBLE)) * list_dot_product(list_transform(b.embedding, lambda e: e::DOUBLE), list_transform(b.embedding, lambda e: e::DOUBLE)))"


def _semantic(spark, sf_dir, threshold, k):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("input_id"), "vector")
    v = e.select(F.col("vec_id").alias("vector_id"), F.col("vec_id").cast("string").alias("analyte_id"), "vector")
    found = matching.match_semantic(q, v, threshold, k)
    return found.select("input_id", "analyte_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_HELD = f"(SELECT a, b, {_SIM} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


@query(f"SELECT input_id, analyte_id, rank, round(s, 6) AS score FROM (SELECT a.vec_id AS input_id, b.vec_id::VARCHAR AS analyte_id, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(s, 12) DESC, b.vec_id) AS rank FROM {_HELD} WHERE s >= -1) WHERE rank <= 5")
def semantic_topk(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all."""
    return _semantic(spark, sf_dir, -1.0, 5)


@query(f"SELECT a.vec_id AS input_id, b.vec_id::VARCHAR AS analyte_id, round(s, 6) AS score FROM {_HELD} WHERE s >= 0.25")
def semantic_threshold(spark, sf_dir):
    """All hits of the same queries, however many."""
    return _semantic(spark, sf_dir, 0.25, None).drop("rank")


_AGES = "SELECT user_id, event_type, max(ts) AS last_ts, count(*) AS n, date_diff('day', max(ts)::DATE, DATE '2024-12-31') AS age FROM events GROUP BY 1, 2"


@query(
    f"SELECT user_id, event_type, age::BIGINT AS age, round(0.95 * f, 9)::DOUBLE AS confidence, f < 1 AND 0.95 * f < 0.93 AS stale FROM (SELECT *, greatest(0.9::DOUBLE, 1::DOUBLE - 0.1::DOUBLE * least(1::DOUBLE, age / 180::DOUBLE)) AS f FROM ({_AGES})) WHERE n >= 3"
)
def vendor_cache_decay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    variants = e.groupBy("user_id", "event_type").agg(F.max("ts").cast("date").alias("last_seen_date")).select(
        F.xxhash64("user_id", "event_type").alias("id"), F.col("user_id").cast("string").alias("lab_vendor"), F.col("event_type").alias("observed_text"), F.lit("A1").alias("validated_match_id"),
        "last_seen_date", F.lit(0).alias("collision_count"), F.lit(None).cast("date").alias("last_collision_date"), "user_id",
    )
    confirmations = e.select(F.xxhash64("user_id", "event_type").alias("variant_id"), F.col("event_id").alias("submission_id"), F.lit(True).alias("valid_for_consensus"))
    served = matching.vendor_cache(variants, confirmations, F.lit("2024-12-31").cast("date"))
    ages = variants.select(F.col("lab_vendor").alias("v"), F.col("observed_text").alias("o"), F.datediff(F.lit("2024-12-31").cast("date"), "last_seen_date").cast("long").alias("age"))
    return served.join(ages, (F.col("v") == F.col("lab_vendor")) & (F.col("o") == F.col("observed_text"))).select(F.col("lab_vendor").cast("long").alias("user_id"), F.col("observed_text").alias("event_type"), "age", F.round("confidence", 9).alias("confidence"), "stale")


@query(
    f"WITH {SYNONYMS_SQL}, q AS (SELECT unnest(['red bolt', 'RED GEAR', 'anvil', 'nothing']) AS query) SELECT query, coalesce((SELECT min(analyte_id) FROM analytes WHERE lower(preferred_name) = lower(query)), (SELECT min(analyte_id) FROM synonyms WHERE lower(synonym_raw) = lower(query)), (SELECT min(analyte_id) FROM analytes WHERE contains(lower(preferred_name), lower(query)))) AS analyte_id, "
    "CASE WHEN EXISTS (SELECT 1 FROM analytes WHERE lower(preferred_name) = lower(query)) OR EXISTS (SELECT 1 FROM synonyms WHERE lower(synonym_raw) = lower(query)) THEN 1.0 WHEN EXISTS (SELECT 1 FROM analytes WHERE contains(lower(preferred_name), lower(query))) THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM q"
)
def nearest_name(spark, sf_dir):
    q = spark.createDataFrame([("red bolt",), ("RED GEAR",), ("anvil",), ("nothing",)], "query string")
    return matching.nearest_analyte(q, analytes(spark, sf_dir), synonyms(spark, sf_dir))


@query("SELECT CASE WHEN c >= 0.95 THEN 'HIGH' WHEN c >= 0.85 THEN 'MEDIUM' WHEN c >= 0.75 THEN 'LOW' ELSE 'VERY_LOW' END AS band, CASE WHEN c >= 0.95 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS ingest_band, count(*) AS n FROM (SELECT round(1 - 3 * l_discount, 6) AS c FROM lineitem) GROUP BY 1, 2")
def confidence_bands(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.round(1 - 3 * F.col("l_discount"), 6).alias("c"))
    return c.groupBy(matching.band(F.col("c"), matching.QUALITY_BANDS, "VERY_LOW").alias("band"), matching.band(F.col("c"), matching.INGEST_BANDS, "LOW").alias("ingest_band")).agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey, count(CASE WHEN 1 - l_discount >= 0.98 THEN 1 END) AS accepted, min(CASE WHEN round(1 - l_discount, 6) >= 0.98 THEN 1 ELSE 0 END) = 1 AS validated FROM (SELECT l_orderkey, l_discount FROM lineitem) GROUP BY 1"
    .replace("WHEN 1 - l_discount >=", "WHEN round(1 - l_discount, 6) >=")
)
def auto_accept(spark, sf_dir):
    """A submission is validated if every one of its results is accepted."""
    ok = F.round(1 - F.col("l_discount"), 6) >= 0.98
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.when(ok, 1)).alias("accepted"), F.min(ok).alias("validated"))


@query(
    "SELECT user_id, event_type, collisions, confirmations, CASE WHEN collisions = 0 THEN 'STABLE' WHEN collisions <= 2 THEN 'COLLIDED' WHEN date_diff('day', last_collision::DATE, DATE '2024-02-01') < 7 THEN 'UNSTABLE' ELSE 'RECOVERED' END AS status FROM ("
    "SELECT user_id, event_type, count(*) AS confirmations, CAST(sum(ch::INT) AS BIGINT) AS collisions, max(CASE WHEN ch THEN ts END) AS last_collision FROM ("
    "SELECT *, coalesce(k <> lag(k) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), false) AS ch FROM (SELECT *, floor(value / 20) AS k FROM events)) GROUP BY 1, 2)"
)
def vendor_collision(spark, sf_dir):
    from quillgrid.operators import learning

    e = table(spark, sf_dir, "events").withColumn("k", F.floor(F.col("value") / 20))
    c = learning.collisions(e, ["user_id", "event_type"], "k", ["ts", "event_id"])
    status = learning.stability(F.col("collision_count"), F.datediff(F.lit("2024-02-01").cast("date"), F.col("last_collision").cast("date")), Thresholds())
    return c.select("user_id", "event_type", F.col("collision_count").alias("collisions"), "confirmations", status.alias("status"))


@query("SELECT user_id, event_type, count(DISTINCT CASE WHEN value > 5 THEN ts::DATE END) AS consensus, count(DISTINCT CASE WHEN value > 5 THEN ts::DATE END) >= 3 AS trusted FROM events GROUP BY 1, 2")
def vendor_consensus(spark, sf_dir):
    n = F.countDistinct(F.when(F.col("value") > 5, F.to_date("ts")))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(n.alias("consensus")).withColumn("trusted", F.col("consensus") >= 3)


@query("SELECT event_id, user_id, round(value - nxt, 6) AS margin FROM (SELECT *, row_number() OVER w AS r, lead(value) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value DESC, event_id)) WHERE r = 1")
def rank_margin(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.row_number().over(w).alias("r"), F.lead("value").over(w).alias("nxt"))
    return e.filter("r = 1").select("event_id", "user_id", F.round(F.col("value") - F.col("nxt"), 6).alias("margin"))
