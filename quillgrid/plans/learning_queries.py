"""Calibration, maturity, gates, clusters, variants and streams over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.operators import learning, variant_search, variants
from quillgrid.plans.registry import ANALYTES_SQL, AS_OF, WEEKS_SQL, analytes, query, ratio_sql, rounded, table
from quillgrid.streaming import inbox


def _scored(spark, sf_dir):
    """Labels with a score: longer documents score higher."""
    d = table(spark, sf_dir, "documents").select("doc_id", rounded(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)), 3).alias("score"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "score", (F.col("quality") == 1).alias("ok"))


_SCORED = "SELECT l.doc_id, round(least(n_chars / 4000.0::DOUBLE, 1.0), 3)::DOUBLE AS score, quality = 1 AS ok FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_RUN = f"SELECT score AS s, sum(n) OVER w AS n, sum(good) OVER w AS good, sum(good) OVER () AS all_good FROM (SELECT score, count(*) AS n, count(CASE WHEN ok THEN 1 END) AS good FROM ({_SCORED}) GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(f"SELECT coalesce(max(s), 0.95::DOUBLE) AS threshold FROM ({_RUN}) WHERE n >= 10 AND good / n >= 0.9")
def calib_precision_threshold(spark, sf_dir):
    return learning.precision_threshold(_scored(spark, sf_dir), "score", F.col("ok"), 0.9)


@query(f"SELECT s AS threshold, round(f1, 9) AS f1 FROM (SELECT s, good / n AS p, good / all_good AS r, 2 * (good / n) * (good / all_good) / (good / n + good / all_good) AS f1 FROM ({_RUN})) WHERE p >= 0.5 AND r >= 0.5 ORDER BY f1 DESC, s DESC LIMIT 1")
def calib_f1_threshold(spark, sf_dir):
    return learning.f1_threshold(_scored(spark, sf_dir), "score", F.col("ok"), 0.5).select("threshold", F.round("f1", 9).alias("f1"))


_DECISIONS = "SELECT round(least(value / 100, 1), 6) AS c, event_type = 'purchase' AS v, event_type = 'error' AS d, event_type = 'click' AS i, ts FROM events"


@query(
    f"SELECT count(*) AS total, round(avg(v::INT), 9) AS validation_rate, round(avg(d::INT), 9) AS disagreement_rate, round(avg(i::INT), 9) AS ingestion_rate, round(avg(c), 6) AS mean_confidence, round(stddev_samp(c), 6) AS sd_confidence, "
    "date_diff('day', min(ts)::DATE, max(ts)::DATE)::INT AS period_days, count(CASE WHEN c >= 0.95 THEN 1 END) AS bin_95, count(CASE WHEN c >= 0.9 AND c < 0.95 THEN 1 END) AS bin_90, count(CASE WHEN c >= 0.85 AND c < 0.9 THEN 1 END) AS bin_85, "
    f"count(CASE WHEN c >= 0.75 AND c < 0.85 THEN 1 END) AS bin_75, count(CASE WHEN c >= 0.5 AND c < 0.75 THEN 1 END) AS bin_50, count(CASE WHEN c < 0.5 THEN 1 END) AS bin_low FROM ({_DECISIONS})"
)
def calib_bins(spark, sf_dir):
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    d = e.select(F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("confidence_score"), (kind == "purchase").alias("human_validated"), (kind == "error").alias("disagreement_flag"), (kind == "click").alias("ingested"), F.col("ts").alias("decision_timestamp"))
    s = learning.decision_stats(d)
    places = {"validation_rate": 9, "disagreement_rate": 9, "ingestion_rate": 9, "mean_confidence": 6, "sd_confidence": 6}
    return s.select(*(F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in s.columns))


_WEEKS = WEEKS_SQL


def _weeks(spark, sf_dir):
    return learning.weekly_counts(table(spark, sf_dir, "events"), "ts", F.lit(AS_OF).cast("timestamp"))


@query(_WEEKS)
def maturity_weekly(spark, sf_dir):
    return _weeks(spark, sf_dir)


@query(f"SELECT round(regr_slope(n, -week), 6) AS slope, abs(regr_slope(n, -week)) < 0.01 AS plateau FROM ({_WEEKS}) WHERE week < 4")
def plateau_slope(spark, sf_dir):
    return learning.plateau(_weeks(spark, sf_dir)).select(F.round("slope", 6).alias("slope"), "plateau")


@query("SELECT count(CASE WHEN a <= 7 THEN 1 END) AS d7, count(CASE WHEN a <= 30 THEN 1 END) AS d30, count(CASE WHEN a <= 90 THEN 1 END) AS d90 FROM (SELECT date_diff('day', ts::DATE, DATE '2024-01-31') AS a FROM events)")
def growth_windows(spark, sf_dir):
    a = table(spark, sf_dir, "events").select(F.datediff(F.lit(AS_OF).cast("date"), F.col("ts").cast("date")).alias("a"))
    return a.agg(*(F.count(F.when(F.col("a") <= d, 1)).alias(f"d{d}") for d in (7, 30, 90)))


_DAY = "2024-03-01"
_TRIGGERS = (
    "SELECT count(CASE WHEN event_type = 'purchase' THEN 1 END) >= 2000 AS volume, coalesce(avg(CASE WHEN age BETWEEN 60 AND 89 THEN (value < 5)::INT END) - avg(CASE WHEN age < 30 THEN (value < 5)::INT END) < 0.02, false) AS unknown_plateau, "
    "avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) > 0.3 AS semantic_share, avg(CASE WHEN value BETWEEN 75 AND 85 THEN 1.0 ELSE 0 END) > 0.2 AS borderline_share "
    f"FROM (SELECT *, date_diff('day', ts::DATE, DATE '{_DAY}') AS age FROM events)"
)


@query(f"SELECT *, CASE WHEN fired >= 2 THEN 'RECOMMENDED' WHEN fired >= 1 THEN 'CONSIDER' ELSE 'NOT_NEEDED' END AS advice FROM (SELECT *, volume::INT + unknown_plateau::INT + semantic_share::INT + borderline_share::INT AS fired FROM ({_TRIGGERS}))")
def retrain_triggers(spark, sf_dir):
    """Volume, an unknown rate that has not fallen, share of vector matches, share of doubtful confidences."""
    kind, v = F.col("event_type"), F.col("value")
    age = F.datediff(F.lit(_DAY).cast("date"), F.col("ts").cast("date"))
    got = table(spark, sf_dir, "events").agg(
        F.count(F.when(kind == "purchase", 1)).alias("bought"), learning.rate_plateau(v < 5, age).alias("flat"), F.avg((kind == "view").cast("double")).alias("views"), F.avg(v.between(75, 85).cast("double")).alias("near")
    )
    return learning.retraining({"volume": F.col("bought") >= 2000, "unknown_plateau": F.col("flat"), "semantic_share": F.col("views") > 0.3, "borderline_share": F.col("near") > 0.2}, got)


@query(
    "SELECT r AS region, round(least(100, 50 * e + 30 * (1 - u) + 0.2 * least(10 * s, 100)), 6)::DOUBLE AS score FROM (SELECT c_nationkey % 5 AS r, avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0 END) AS e, avg(CASE WHEN c_acctbal < 0 THEN 1.0::DOUBLE ELSE 0 END) AS u, count(*)::DOUBLE / count(DISTINCT c_mktsegment) / 100 AS s FROM customer GROUP BY 1)"
)
def maturity_by_region(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("region")).agg(
        F.avg((F.col("c_acctbal") > 0).cast("double")).alias("e"), F.avg((F.col("c_acctbal") < 0).cast("double")).alias("u"), (F.count("*") / F.countDistinct("c_mktsegment") / 100).alias("s")
    )
    return c.select("region", F.round(learning.maturity_score(F.col("e"), F.col("u"), F.col("s")), 6).alias("score"))


DUAL_GATE_SQL = (
    "WITH a AS (SELECT event_id AS id, user_id, ts, CASE WHEN event_type = 'error' THEN 'not_confirmed' WHEN value / 100 < 0.06 THEN 'small_margin' END AS o FROM events), "
    "b AS (SELECT *, o IS NULL AND user_id >= 5 AND row_number() OVER (PARTITION BY user_id, o IS NULL ORDER BY ts, id) = 1 AS fresh FROM a), "
    "c AS (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY ts::DATE ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM b)"
)


def dual_gate_rows(events):
    """Events as decisions."""
    user = F.col("user_id").cast("string")
    return events.select(F.col("event_id").alias("id"), user.alias("analyte_id"), user.alias("norm"), (F.col("event_type") != "error").alias("confirmed"), (F.col("value") / 100).alias("margin"), "ts")


@query(f"{DUAL_GATE_SQL} SELECT id, coalesce(o, CASE WHEN taken >= 20 THEN 'daily_cap' WHEN NOT fresh THEN 'duplicate' ELSE 'ingested' END) AS outcome FROM c")
def dual_gate_daily_cap(spark, sf_dir):
    known = spark.range(5).select(F.col("id").cast("string").alias("analyte_id"), F.col("id").cast("string").alias("norm"))
    return learning.dual_gate(dual_gate_rows(table(spark, sf_dir, "events")), known).select("id", "outcome")


@query(
    f"WITH {ANALYTES_SQL}, g AS (SELECT preferred_name AS t, list_distinct(list_transform(range(1, len(preferred_name)), lambda i: substr(preferred_name, i::INT, 2))) AS g FROM analytes) "
    "SELECT a.t AS a, b.t AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 9) AS sim FROM g a JOIN g b ON a.t < b.t WHERE len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))) >= 0.5"
)
def cluster_pairs(spark, sf_dir):
    return learning.similarity_pairs(analytes(spark, sf_dir).select("preferred_name"), 0.5).select("a", "b", F.round("sim", 9).alias("sim"))


@query(
    f"WITH RECURSIVE {ANALYTES_SQL}, n AS (SELECT k, preferred_name AS t, row_number() OVER (ORDER BY k, preferred_name) AS i FROM analytes), "
    f"near AS (SELECT b.i AS i, list(a.i) AS before FROM n a JOIN n b ON a.i < b.i WHERE {ratio_sql('a.t', 'b.t')} >= 0.7 GROUP BY 1), steps AS (SELECT n.i, coalesce(before, []) AS before FROM n LEFT JOIN near USING (i)), "
    "walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS anchors UNION ALL SELECT s.i, CASE WHEN list_has_any(s.before, anchors) THEN anchors ELSE list_append(anchors, s.i) END FROM walk JOIN steps s ON s.i = walk.i + 1), "
    "told AS (SELECT s.i, coalesce(list_min(list_intersect(s.before, anchors)), s.i) AS anchor FROM steps s, (SELECT anchors FROM walk ORDER BY i DESC LIMIT 1)) "
    "SELECT substr(n.t, 1, 1) AS block, n.k AS k, n.t AS preferred_name, a.t AS anchor FROM told JOIN n ON told.i = n.i JOIN n a ON told.anchor = a.i"
)
def cluster_greedy(spark, sf_dir):
    """Order-dependent clusters of all names; block is a name's first letter and bounds nothing."""
    a = analytes(spark, sf_dir).select(F.substring("preferred_name", 1, 1).alias("block"), F.substring("analyte_id", 2, 20).cast("long").alias("k"), "preferred_name")
    return learning.greedy_clusters_of_all(a, "k", "preferred_name", 0.7)


def _spelled(spark, sf_dir):
    """Names with places, marks, qualifiers and oxidation states, made from the registry's words."""
    last = F.element_at(F.split("preferred_name", " "), -1)
    forms = F.array(F.concat(F.lit("(R)-2-chloro"), last), F.concat(F.lit("o-"), last, F.lit("benzene")), F.concat(last, F.lit(" (VI)")), F.concat(last, F.lit(", hot water soluble")), F.concat(last, F.lit(" (total)")), F.lit("1,2-dichloroethane"))
    return analytes(spark, sf_dir).select("analyte_id", F.explode(forms).alias("name")).distinct()


_FOUND = "list_distinct([" + ", ".join("trim(regexp_replace(regexp_replace(v, '{}', '{}', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))".format(p.replace("'", "''"), to) for p, to in variant_search.RULES) + "])"
_SPELLED_SQL = (
    f"{ANALYTES_SQL}, w AS (SELECT analyte_id, string_split(preferred_name, ' ')[-1] AS x FROM analytes), "
    "named AS (SELECT DISTINCT analyte_id, unnest(['(R)-2-chloro' || x, 'o-' || x || 'benzene', x || ' (VI)', x || ', hot water soluble', x || ' (total)', '1,2-dichloroethane']) AS name FROM w), "
    f"closure AS (SELECT DISTINCT name, lower(name) AS v FROM named UNION SELECT name, n AS v FROM (SELECT name, unnest({_FOUND}) AS n FROM closure) WHERE len(n) <= len(name) + {variant_search.ROOM} AND NOT regexp_matches(n, '{variant_search.SPURIOUS}'))"
)


@query(f"WITH RECURSIVE {_SPELLED_SQL} SELECT analyte_id, name, count(*) AS spellings, string_agg(v, '|' ORDER BY v) AS variants FROM named JOIN closure USING (name) GROUP BY 1, 2")
def name_closure(spark, sf_dir):
    """Every spelling in small letters that the rules lead to."""
    names = _spelled(spark, sf_dir).groupBy("name").agg(F.collect_list("analyte_id").alias("ids"))
    found = variant_search.name_variants(names.withColumn("key", F.struct("name", "ids")), "key", "name", None).filter("variant = lower(variant)")
    listed = found.groupBy("key").agg(F.count("*").alias("spellings"), F.concat_ws("|", F.array_sort(F.collect_list("variant"))).alias("variants"))
    return listed.select(F.explode("key.ids").alias("analyte_id"), "key.name", "spellings", "variants")


@query()
def name_variants(spark, sf_dir):
    """The best fifty spellings of every registry name and of the names above, in the order in which they are found."""
    both = _spelled(spark, sf_dir).unionByName(analytes(spark, sf_dir).select("analyte_id", F.col("preferred_name").alias("name")))
    return variant_search.name_variants(both.withColumn("key", F.struct("analyte_id", "name")), "key", "name").select("key.*", "variant", F.round("score", 9).alias("score"), "place")


_CHAIN = "CASE " + " ".join(f"WHEN contains(low, '{c}') THEN '{c}'" for c in variants.by_length(variants.CHAINS)) + " END"
_SUBSTITUENTS = "list_filter([" + ", ".join(f"CASE WHEN contains(low, '{x}') THEN '{x}' END" for x in variants.SUBSTITUENTS) + "], lambda x: x IS NOT NULL)"


@query(
    f"WITH {ANALYTES_SQL}, n AS (SELECT analyte_id, '(R)-1,2-dichloro' || split_part(preferred_name, ' ', -1) || 'ethane' AS name FROM analytes UNION ALL SELECT analyte_id, split_part(preferred_name, ' ', -1) || 'methylbenzene, 2,1' FROM analytes), "
    f"p AS (SELECT *, lower(regexp_replace(name, '\\(R\\)-', '')) AS low FROM n), q AS (SELECT *, {_CHAIN} AS chain, {_SUBSTITUENTS} AS subs, contains(low, 'dichloro') AS two FROM p) "
    "SELECT analyte_id, name, CASE WHEN two THEN 'R' END AS stereo, CASE WHEN two THEN 2 END AS multiplicity, array_to_string(subs, ',') AS substituents, chain, CASE WHEN ends_with(low, 'ane') THEN 'single' WHEN ends_with(low, 'ene') THEN 'double' END AS bond, "
    "'1,2-' || CASE WHEN two THEN 'di' ELSE '' END || array_to_string(list_sort(subs), '') || coalesce(chain, '') || CASE WHEN ends_with(low, 'ane') THEN 'ane' ELSE '' END AS canonical FROM q"
)
def name_structure(spark, sf_dir):
    """Structure and canonical form of names made from the registry's words."""
    last = F.element_at(F.split("preferred_name", " "), -1)
    names_ = F.explode(F.array(F.concat(F.lit("(R)-1,2-dichloro"), last, F.lit("ethane")), F.concat(last, F.lit("methylbenzene, 2,1"))))
    a = analytes(spark, sf_dir).select("analyte_id", names_.alias("name")).withColumn("p", variants.parse_name(F.col("name")))
    p = F.col("p")
    return a.select(
        "analyte_id", "name", p["stereo"].alias("stereo"), p["multiplicity"].alias("multiplicity"), F.concat_ws(",", p["substituents"]).alias("substituents"), p["chain"].alias("chain"), p["bond"].alias("bond"),
        variants.canonical(F.col("name"), p).alias("canonical"),
    )


_FORMS = "[p_name, upper(p_name), replace(p_name, ' ', ''), '1,2-' || p_name, 'Para ' || p_name || ' of p  q r', repeat(p_name, 5)]"


@query(
    f"SELECT p_partkey, v AS variant, round(CASE WHEN lower(v) = lower(p_name) THEN 100.0::DOUBLE ELSE 0 END + 10.0::DOUBLE * least(len(v), len(p_name)) / greatest(len(v), len(p_name)) - CASE WHEN len(v) > 40 THEN 5 ELSE 0 END "
    "- CASE WHEN len(v) - len(replace(v, ' ', '')) > 3 THEN 2 ELSE 0 END + CASE WHEN regexp_matches(v, '[0-9]+,[0-9]+') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(lower(v), 'ortho|meta|para') THEN 2 ELSE 0 END "
    f"- CASE WHEN v = upper(v) AND v <> lower(v) AND len(v) > 5 THEN 1 ELSE 0 END + CASE WHEN v = lower(v) AND v <> upper(v) THEN 1 ELSE 0 END, 9) AS score FROM (SELECT p_partkey, p_name, unnest({_FORMS}) AS v FROM part)"
)
def variant_scores(spark, sf_dir):
    """Scores of forms of every part's name."""
    n = F.col("p_name")
    forms = F.array(n, F.upper(n), F.replace(n, F.lit(" "), F.lit("")), F.concat(F.lit("1,2-"), n), F.concat(F.lit("Para "), n, F.lit(" of p  q r")), F.repeat(n, F.lit(5)))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.explode(forms).alias("variant"))
    return p.select("p_partkey", "variant", F.round(variants.quality(F.col("variant"), n), 9).alias("score"))


def _folder(spark):
    """A folder that driver and executors share; a local session may do without one named."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillgrid-")
    return f"{where.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 7 DAYS, ts, TIMESTAMP '1970-01-01')::DATE::VARCHAR AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly_window(spark, sf_dir):
    """The event log as a stream: weekly counts, all there is and stop."""
    src, out = table(spark, sf_dir, "events"), _folder(spark)
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    weekly = inbox.weekly(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "3650 days")
    inbox.run_once(weekly, f"{out}/state", each=lambda df, i: df.write.mode("overwrite").parquet(f"{out}/weeks"), mode="complete")
    return spark.read.parquet(f"{out}/weeks").select(F.col("week").cast("date").cast("string").alias("week"), "event_type", "n")


@query()
def stream_inbox(spark, sf_dir):
    """The tables' own files as an inbox: each content once."""
    out = _folder(spark)
    inbox.take_in(spark, sf_dir, f"{out}/files", f"{out}/state", "*.parquet")
    return spark.read.schema(inbox.HASHED).parquet(f"{out}/files").select("file_hash", F.element_at(F.split("path", "/"), -1).alias("name"), "length")


@query(
    "WITH o AS (SELECT *, row_number() OVER w AS i, lag(analyte_id) OVER w AS p FROM (SELECT CAST(user_id AS VARCHAR) AS lab_vendor, event_type AS observed_text, CAST(CAST(floor(value / 20) AS BIGINT) AS VARCHAR) AS analyte_id, ts FROM events) "
    "WINDOW w AS (PARTITION BY lab_vendor, observed_text ORDER BY ts, analyte_id)), "
    "s AS (SELECT lab_vendor, observed_text, arg_max(analyte_id, i) AS analyte_id, count(*) AS confirmations, count(CASE WHEN p <> analyte_id THEN 1 END) AS collisions, epoch(max(ts)) - epoch(max(CASE WHEN p <> analyte_id THEN ts END)) AS since FROM o GROUP BY 1, 2) "
    f"SELECT lab_vendor, observed_text, analyte_id, confirmations, collisions, CASE WHEN collisions = 0 THEN 'STABLE' WHEN collisions <= {Thresholds().max_collisions} THEN 'COLLIDED' WHEN since < {Thresholds().cooldown_days} * 86400 THEN 'UNSTABLE' ELSE 'RECOVERED' END AS status FROM s"
)
def stream_vendor_states(spark, sf_dir):
    """State machine of (user, event type) over the event log as a stream."""
    out = _folder(spark)
    src = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("lab_vendor"), F.col("event_type").alias("observed_text"), F.floor(F.col("value") / 20).cast("string").alias("analyte_id"), "ts")
    inbox.run_once(inbox.vendor_states(rows), f"{out}/state", each=lambda df, i: df.write.mode("append").parquet(f"{out}/states"), mode="update")
    return spark.read.parquet(f"{out}/states")
