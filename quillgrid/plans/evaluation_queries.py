"""Baselines, summaries and table sets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.operators import evaluation, mutations
from quillgrid.plans.learning_queries import DUAL_GATE_SQL, dual_gate_rows
from quillgrid.plans.match_queries import _DECIDE, _resolved
from quillgrid.plans.registry import analytes, query, synonyms, table
from quillgrid.sources.versions import TableSet
from quillgrid.storage import new_path
from quillgrid.streaming import inbox


def _judged(spark, sf_dir):
    """Dirty names with what they were made from, one submission a kind of dirt, and what the cascade says."""
    name = F.col("preferred_name")
    forms = F.array(F.upper(name), F.concat(F.substring(name, 1, 4), F.expr("substring(preferred_name, 6)")), F.concat(name, F.lit(", total")), F.concat(F.lit("zq"), F.reverse(name), F.lit("kw")))
    asked = analytes(spark, sf_dir).select(F.col("analyte_id").alias("truth"), F.posexplode(forms).alias("submission", "input_text"))
    return asked.join(_resolved(spark, sf_dir), "input_text")


_JUDGED = (
    f"{_DECIDE}, asked AS (SELECT analyte_id AS truth, unnest([0, 1, 2, 3]) AS submission, unnest([upper(preferred_name), substr(preferred_name, 1, 4) || substr(preferred_name, 6), preferred_name || ', total', 'zq' || reverse(preferred_name) || 'kw']) AS input_text FROM analytes), "
    "j AS (SELECT submission, truth, margin::DOUBLE AS margin, band, phase, disagreement, input_text, CASE WHEN band <> 'UNKNOWN' THEN conf END AS held, CASE WHEN band <> 'UNKNOWN' THEN analyte_id END AS got, CASE WHEN band <> 'UNKNOWN' THEN conf ELSE 0 END::DOUBLE AS c FROM asked JOIN g USING (input_text))"
)
_PART = "round(avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END), 6)"


@query(
    f"WITH {_JUDGED} SELECT submission, count(*) AS items, {_PART.format('got = truth')} AS accuracy, {_PART.format(chr(39).join(['band = ', 'AUTO_ACCEPT', '']))} AS auto_rate, {_PART.format(chr(39).join(['band = ', 'REVIEW', '']))} AS review_rate, "
    f"{_PART.format(chr(39).join(['band = ', 'UNKNOWN', '']))} AS unknown_rate, round(avg(c), 6) AS mean_confidence, round(coalesce(stddev_samp(c), 0), 6) AS sd_confidence, round(avg(margin), 6) AS mean_margin, round(coalesce(stddev_samp(margin), 0), 6) AS sd_margin, "
    "count(CASE WHEN band = 'REVIEW' AND c >= 0.93 AND margin < 0.05 THEN 1 END) AS margin_forced FROM j GROUP BY 1"
)
def gate_accuracy(spark, sf_dir):
    """The cascade against known answers, by submission."""
    got = evaluation.gate_baseline(_judged(spark, sf_dir), "submission", F.col("analyte_id") == F.col("truth"))
    return got.select("submission", "items", "margin_forced", *(F.round(c, 6).alias(c) for c in got.columns if c not in ("submission", "items", "margin_forced")))


@query(
    f"WITH {_JUDGED} SELECT 'margin' AS section, CASE WHEN margin >= 0.2 THEN 'wide' WHEN margin >= 0.05 THEN 'medium' ELSE 'narrow' END AS bin, count(*) AS n FROM j GROUP BY 2 UNION ALL "
    "SELECT 'confidence', CASE WHEN c >= 0.95 THEN '0.95-1.00' WHEN c >= 0.93 THEN '0.93-0.95' WHEN c >= 0.85 THEN '0.85-0.93' WHEN c >= 0.75 THEN '0.75-0.85' WHEN c >= 0.5 THEN '0.50-0.75' ELSE '0.00-0.50' END, count(*) FROM j GROUP BY 2"
)
def gate_bins(spark, sf_dir):
    """How margins and confidences of the cascade spread."""
    return evaluation.bins(_judged(spark, sf_dir))


@query(f"WITH {_DECIDE} SELECT CASE phase WHEN 1 THEN 'exact_match' ELSE 'fuzzy_match' END AS signal, count(*) AS n FROM g WHERE phase IS NOT NULL GROUP BY 1")
def gate_signals(spark, sf_dir):
    """How many inputs each signal of the cascade took part in."""
    return evaluation.signal_counts(_resolved(spark, sf_dir))


@query(
    f"WITH {_JUDGED} SELECT *, exact::DOUBLE / total AS exact_rate, unknown::DOUBLE / total AS unknown_rate, round(total * 1000.0::DOUBLE / total_ms, 9) AS per_second FROM (SELECT count(*) AS total, count(CASE WHEN held IS NOT NULL AND phase = 1 THEN 1 END) AS exact, count(CASE WHEN held IS NOT NULL AND phase = 2 THEN 1 END) AS fuzzy, "
    "0::BIGINT AS semantic, count(CASE WHEN held IS NULL THEN 1 END) AS unknown, count(CASE WHEN band = 'REVIEW' OR disagreement THEN 1 END) AS review_flagged, round(coalesce(avg(CASE WHEN held > 0 THEN held END), 0), 6) AS mean_confidence, CAST(sum(len(input_text)) AS BIGINT) AS total_ms FROM j)"
)
def batch_summary(spark, sf_dir):
    """Summary of a batch of which each text took as many milliseconds as it has characters."""
    return evaluation.batch_summary(_judged(spark, sf_dir), F.length("input_text")).withColumns({"mean_confidence": F.round("mean_confidence", 6), "per_second": F.round("per_second", 9)})


@query(
    f"WITH {_DECIDE} SELECT method, n, round(d, 9) AS disagreement_rate, round(n::DOUBLE / sum(n) OVER (), 9) AS share FROM (SELECT CASE WHEN band = 'UNKNOWN' THEN NULL WHEN phase = 1 THEN 'exact' ELSE 'fuzzy' END AS method, count(*) AS n, avg(CASE WHEN disagreement THEN 1.0::DOUBLE ELSE 0 END) AS d FROM g GROUP BY 1)"
)
def calib_methods(spark, sf_dir):
    """Share of each method, and how often it disagrees."""
    got = evaluation.method_stats(_resolved(spark, sf_dir), "method", F.col("disagreement"))
    return got.select("method", "n", F.round("disagreement_rate", 9).alias("disagreement_rate"), F.round("share", 9).alias("share"))


@query("SELECT l_partkey, count(*) AS appearances, round(avg(1 - l_discount), 6)::DOUBLE AS mean_confidence FROM lineitem GROUP BY 1 HAVING count(*) >= 5")
def cross_file_common(spark, sf_dir):
    got = evaluation.common_names(table(spark, sf_dir, "lineitem"), "l_partkey", 1 - F.col("l_discount"))
    return got.select("l_partkey", "appearances", F.round("mean_confidence", 6).cast("double").alias("mean_confidence"))


@query("SELECT o_orderkey, coalesce(n, 0) AS unique_names FROM orders LEFT JOIN (SELECT o_orderkey, count(*) AS n FROM (SELECT min(l_orderkey) AS o_orderkey FROM lineitem GROUP BY l_partkey HAVING count(*) = 1) GROUP BY 1) USING (o_orderkey)")
def cross_file_unique(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return evaluation.unique_names(li, table(spark, sf_dir, "orders"), "l_partkey", "o_orderkey")


@query("SELECT count(*) AS names, count(CASE WHEN a = 1 THEN 1 END) AS consistent, count(CASE WHEN n >= 5 THEN 1 END) AS common, round(count(CASE WHEN a = 1 THEN 1 END) * 100.0::DOUBLE / count(*), 9) AS percent FROM (SELECT l_partkey, l_linestatus, count(*) AS n, count(DISTINCT l_returnflag) AS a FROM lineitem GROUP BY 1, 2)")
def cross_file_rate(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_partkey", "l_linestatus").alias("name"), "l_returnflag")
    return evaluation.consistency_rate(li, "name", "l_returnflag").withColumn("percent", F.round("percent", 9))


@query(
    "SELECT event_id, value > 5 AND floor(value / 20) = kept AS valid FROM events JOIN (SELECT user_id, event_type, floor(arg_max(value, {'a': ts, 'b': event_id}) / 20) AS kept FROM events GROUP BY 1, 2) USING (user_id, event_type)"
)
def soft_delete(spark, sf_dir):
    """Confirmations that name another analyte than the newest one of their variant stop counting."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.floor(F.col("value") / 20).alias("k"), (F.col("value") > 5).alias("valid"))
    kept = e.groupBy("user_id", "event_type").agg(F.max_by("k", F.struct("ts", "event_id")).alias("k"))
    return mutations.clear_conflicting(e, kept, ["user_id", "event_type"], "k", "valid").select("event_id", "valid")


_HASH = "substr(sha256(count(*) || ':' || CAST(sum(('0x' || substr(sha256({}), 1, 8))::BIGINT) AS BIGINT)), 1, 16)"


@query(
    f"SELECT 'names' AS kind, 'v1' AS version, count(*) AS n, {_HASH.format('p_name')} AS content_hash, true AS is_active FROM part UNION ALL SELECT 'names', 'v2', count(*), {_HASH.format('p_brand || chr(31) || p_name')}, false FROM part "
    f"UNION ALL SELECT 'regions', 'v1', count(*), {_HASH.format('r_name')}, true FROM region"
)
def snapshot_registry(spark, sf_dir):
    """Two snapshots of one kind and one of another, and back to the first."""
    empty = spark.createDataFrame([], "kind string, version string, n long, content_hash string, created_at date, is_active boolean")
    part, day = table(spark, sf_dir, "part"), F.lit("2024-01-31").cast("date")
    held = mutations.register_snapshot(empty, "names", "v1", part, ["p_name"], day)
    held = mutations.register_snapshot(held, "regions", "v1", table(spark, sf_dir, "region"), ["r_name"], day)
    held = mutations.register_snapshot(held, "names", "v2", part, ["p_brand", "p_name"], F.date_add(day, 1))
    return mutations.activate_snapshot(held, "names", "v1").drop("created_at")


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM region) AS regions, (SELECT count(*) FROM nation) AS before FROM nation WHERE n_regionkey < 3")
def table_set_reload(spark, sf_dir):
    """A table reloaded from itself in one step with another, the version before still there."""
    tables = TableSet(spark, new_path(spark))
    first = tables.commit(reload={"nation": table(spark, sf_dir, "nation"), "region": table(spark, sf_dir, "region").limit(0)})
    tables.commit(reload={"nation": tables.read("nation").filter("n_regionkey < 3")}, append={"region": table(spark, sf_dir, "region")})
    return tables.read("nation").select("n_nationkey", "n_name", F.lit(tables.read("region").count()).alias("regions"), F.lit(tables.read("nation", first).count()).alias("before"))


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids, CAST(sum(vec_id) AS BIGINT) AS total FROM embeddings GROUP BY 1")
def index_append(spark, sf_dir):
    """An index of vectors that grows by what it doesn't hold yet; appending all rows again changes nothing."""
    tables, e = TableSet(spark, new_path(spark)), table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    tables.commit(reload={"index": e.filter("label = 0")})
    for _ in range(2):
        tables.commit(append={"index": mutations.append_new(tables.read("index"), e, ["vec_id"])})
    return tables.read("index").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.sum("vec_id").alias("total"))


@query(f"{DUAL_GATE_SQL} SELECT CAST(user_id AS VARCHAR) AS analyte_id, ts::VARCHAR AS ts FROM c WHERE o IS NULL AND taken < 20 AND fresh")
def stream_accretion(spark, sf_dir):
    """The event log as a stream of decisions; what passes the dual gate joins the corpus."""
    out, src = new_path(spark), table(spark, sf_dir, "events")
    tables = TableSet(spark, f"{out}/tables")
    known = spark.range(5).select(F.col("id").cast("string").alias("analyte_id"), F.col("id").cast("string").alias("norm"), F.lit(None).cast(src.schema["ts"].dataType).alias("ts"))
    tables.commit(reload={"synonyms": known})
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    inbox.run_once(dual_gate_rows(stream), f"{out}/state", each=inbox.accrete(tables))
    return tables.read("synonyms").filter("ts IS NOT NULL").select("analyte_id", F.col("ts").cast("string").alias("ts"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount < 0.02")
def stream_failed_route(spark, sf_dir):
    """Rows of a stream that can't be parsed, here those with a small discount, go to a folder of their own."""
    out, src = new_path(spark), table(spark, sf_dir, "lineitem")
    stream = spark.readStream.schema(src.schema).parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet*").select("l_suppkey", "l_orderkey", "l_linenumber", "l_discount")
    parse = lambda df: df.withColumn("error", F.when(F.col("l_discount") < 0.02, "small"))
    inbox.run_once(stream, f"{out}/state", each=inbox.route(parse, f"{out}/processed", f"{out}/failed"))
    return spark.read.parquet(f"{out}/failed").drop("batch", "error")
