"""Baselines, statistics of harvests, ingestion and clusters, and checks of derived values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.functions import names, qualifiers, registry_numbers, synonyms
from quillgrid.operators import learning, mutations, reports, vector_index
from quillgrid.plans.registry import ANALYTES_SQL, AS_OF, SYNONYMS_SQL, WEEKS_SQL, analytes, norm_sql, query, rounded, table
from quillgrid.plans.registry import synonyms as registry_synonyms

_SHARE = "round(avg(CASE WHEN {} THEN 1.0::DOUBLE ELSE 0 END), 9)"


@query(
    f"SELECT user_id % 10 AS source, count(*) AS requests, {_SHARE.format('value > 5')} AS success_rate, CAST(sum(event_id % 7) AS BIGINT) AS synonyms_found, round(avg(CASE WHEN value > 1 THEN value END), 6) AS mean_seconds, "
    "count(CASE WHEN event_type = 'error' THEN 1 END) AS rate_limited FROM events GROUP BY 1"
)
def harvest_statistics(spark, sf_dir):
    """Requests by source: success, yield, mean of the non-trivial times, refusals."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("source")).agg(
        F.count("*").alias("requests"), F.round(reports.share(F.col("value") > 5), 9).alias("success_rate"), F.sum(F.col("event_id") % 7).alias("synonyms_found"),
        F.round(F.avg(F.when(F.col("value") > 1, F.col("value"))), 6).alias("mean_seconds"), reports.count_where(F.col("event_type") == "error").alias("rate_limited"),
    )


@query("SELECT event_type AS source, user_id % 3 AS kind, count(*) AS n, count(DISTINCT user_id) AS analytes FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2")
def ingestion_statistics(spark, sf_dir):
    """Rows by exact source and kind; sources with a suffix are other sources."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return e.groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 3).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("analytes"))


@query(
    "SELECT event_type AS vendor, count(*) AS n, round(avg(c), 6) AS mean, round(stddev_samp(c), 6) AS sd, count(CASE WHEN c >= 0.93 THEN 1 END) AS accepted, count(CASE WHEN c >= 0.75 AND c < 0.93 THEN 1 END) AS review, count(CASE WHEN c < 0.75 THEN 1 END) AS unknown, "
    "count(CASE WHEN c - p < 0.05 THEN 1 END) AS close_margin FROM (SELECT *, lag(c, 1, 0.0::DOUBLE) OVER (PARTITION BY event_type ORDER BY c, event_id) AS p FROM (SELECT event_type, event_id, round(least(value / 100, 1), 6) AS c FROM events)) GROUP BY 1"
)
def gate_baseline(spark, sf_dir):
    """Per vendor: level and spread of confidence, bands, and how many stand close to the next lower one.

    Confidences have six digits, so a vendor has a million at most however many
    rows it has: rows are counted by confidence before any window sees them.
    All but the first row of a confidence stand close, beside their equals.
    """
    c = F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6)
    e = table(spark, sf_dir, "events").groupBy("event_type", c.alias("c")).agg(F.count("*").alias("n"))
    e = e.withColumn("p", F.lag("c", 1, 0.0).over(Window.partitionBy("event_type").orderBy("c")))
    c, n = F.col("c"), F.col("n")
    total = lambda at: F.coalesce(F.sum(F.when(at, n)), F.lit(0))
    mean = F.sum(c * n) / F.sum("n")
    spread = F.when(F.sum("n") > 1, F.sqrt(F.greatest(F.sum(c * c * n) - F.sum("n") * mean * mean, F.lit(0.0)) / (F.sum("n") - 1)))
    return e.groupBy(F.col("event_type").alias("vendor")).agg(
        F.sum("n").alias("n"), F.round(mean, 6).alias("mean"), F.round(spread, 6).alias("sd"), total(c >= 0.93).alias("accepted"), total((c >= 0.75) & (c < 0.93)).alias("review"), total(c < 0.75).alias("unknown"),
        F.sum(F.when(c - F.col("p") < 0.05, n).otherwise(n - 1)).alias("close_margin"),
    )


@query(
    "SELECT signal, count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS strong FROM (SELECT unnest([event_type, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END]) AS signal, value FROM events) GROUP BY 1"
)
def signal_counts(spark, sf_dir):
    """How often each signal of a map was set."""
    held = F.create_map(F.col("event_type"), F.lit(True), F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"), F.lit(True))
    e = table(spark, sf_dir, "events").select(F.explode(held).alias("signal", "is_set"), "value").filter("is_set")
    return e.groupBy("signal").agg(F.count("*").alias("n"), reports.count_where(F.col("value") > 50).alias("strong"))


@query(
    "SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS members, round(avg(n), 6) AS mean_size, max(n) AS largest, min(n) AS smallest, count(CASE WHEN n = 1 THEN 1 END) AS singletons FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)"
)
def cluster_statistics(spark, sf_dir):
    sizes = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.round(F.avg("n"), 6).alias("mean_size"), F.max("n").alias("largest"), F.min("n").alias("smallest"), reports.count_where(F.col("n") == 1).alias("singletons"))


@query(
    "SELECT query, label, round(max(list_dot_product(list_transform(embedding, lambda e: e::DOUBLE), c)), 6) AS best FROM embeddings, (SELECT vec_id AS query, list_transform(embedding, lambda e: e::DOUBLE) AS c FROM embeddings WHERE vec_id % 20 = 0) GROUP BY 1, 2"
)
def closest_by_label(spark, sf_dir):
    """The best similarity of each label's vectors to each of a query set (every id divisible by 20)."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vector"))
    best = vector_index.best_by_group(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("input_id"), "vector"), e.withColumnRenamed("vec_id", "vector_id"), "label")
    return best.select(F.col("input_id").alias("query"), "label", F.round("sim", 6).alias("best"))


@query(
    "SELECT doc_id, count(*) AS words, count(CASE WHEN len(w) BETWEEN 1 AND 200 AND NOT regexp_full_match(w, '[0-9\\-]+') AND len(regexp_replace(w, '[^\\p{L}]', '', 'g')) / len(w) >= 0.3 THEN 1 END) AS plausible FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) GROUP BY 1"
    .replace("(SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)", "(SELECT doc_id, trim(w) AS w FROM (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE len(w) > 0)")
)
def plausible_synonyms(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("length(w) > 0")
    return words.groupBy("doc_id").agg(F.count("*").alias("words"), reports.count_where(synonyms.is_plausible(F.col("w"))).alias("plausible"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'Cell' WHEN l_shipmode = 0 THEN 'Water' WHEN l_shipmode = 1 THEN 'Soil' ELSE '' END AS medium FROM (SELECT *, l_partkey % 3 AS l_shipmode FROM lineitem)"
)
def backfill_medium(spark, sf_dir):
    """Blank media from the file name, then from the units."""
    cell = F.when(F.col("l_linestatus") == "O", "Cell").otherwise(" ")
    k = F.col("l_partkey") % 3
    name, units = F.when(k == 0, "site_GW_1.xlsx").otherwise("site.xlsx"), F.when(k == 1, "mg/kg").otherwise("%")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", qualifiers.first_filled(cell, qualifiers.medium_of_filename(name), qualifiers.medium_of_units(units)).alias("medium"))


@query("SELECT (SELECT count(*) FROM part) AS analytes, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done, (SELECT count(*) FROM orders) AS submissions, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS measured")
def scalar_counts(spark, sf_dir):
    """Counts of several tables in one row, one pass a table."""
    p = table(spark, sf_dir, "part").agg(F.count("*").alias("analytes"))
    o = table(spark, sf_dir, "orders").agg(reports.count_where(F.col("o_orderstatus") == "F").alias("done"), F.count("*").alias("submissions"))
    return p.join(o).join(table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("measured")))


@query(f"WITH {SYNONYMS_SQL} SELECT a.analyte_id, synonym_norm FROM synonyms s JOIN analytes a USING (analyte_id)")
def corpus_extract(spark, sf_dir):
    """All synonyms with their analytes."""
    s = registry_synonyms(spark, sf_dir)
    return s.join(analytes(spark, sf_dir).select("analyte_id"), "analyte_id").select("analyte_id", "synonym_norm")


@query(
    f"WITH {SYNONYMS_SQL} SELECT analyte_id, preferred_name AS synonym_raw FROM analytes a WHERE NOT EXISTS (SELECT 1 FROM synonyms s WHERE s.analyte_id = a.analyte_id AND s.synonym_norm = {norm_sql('a.preferred_name')} AND synonym_id % 4 = 0)"
)
def seed_synonyms(spark, sf_dir):
    """Registry names that a part of the synonyms doesn't hold yet."""
    held = registry_synonyms(spark, sf_dir).filter("synonym_id % 4 = 0")
    return mutations.seed_synonyms(analytes(spark, sf_dir), held, names.normalise).select("analyte_id", "synonym_raw")


@query(
    f"WITH {ANALYTES_SQL} SELECT analyte_id, cas_number, regexp_replace(replace(cas_number, '-', ''), '^0+', '') AS bare, true AS same FROM analytes"
)
def number_equality(spark, sf_dir):
    """Numbers are equal whatever their dashes, spaces and leading zeros."""
    a = analytes(spark, sf_dir)
    padded = F.concat(F.lit("00"), F.replace("cas_number", F.lit("-"), F.lit(" ")))
    return a.select("analyte_id", "cas_number", F.regexp_replace(F.replace("cas_number", F.lit("-"), F.lit("")), "^0+", "").alias("bare"), registry_numbers.same(F.col("cas_number"), padded).alias("same"))


@query("SELECT o_orderkey, o_orderstatus, rpad(repeat('#', CAST(round(least(o_totalprice / 500000, 1) * 20) AS INT)), 20, '.') AS bar FROM orders")
def text_bars(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", names.bar(F.col("o_totalprice") / 500000).alias("bar"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'eco') THEN 'Economy lab' WHEN contains(lower(p_type), 'small') THEN 'Small lab' ELSE 'Unknown' END AS vendor FROM part")
def vendor_signature(spark, sf_dir):
    """Vendors by the first signature that a text holds."""
    return table(spark, sf_dir, "part").select("p_partkey", names.first_signature(F.col("p_type"), {"eco": "Economy lab", "SMALL": "Small lab"}).alias("vendor"))


@query(
    "SELECT user_id, array_to_string(list_transform(list_slice(list_sort(list(struct_pack(a := -round(least(value / 100, 1), 3), b := event_id))), 1, 3), lambda x: x.b || ':' || printf('%.3f', -x.a)), ',') AS top FROM events GROUP BY 1"
)
def top_candidates(spark, sf_dir):
    """The three best of each group, rounded, as one text."""
    e = table(spark, sf_dir, "events").select("user_id", (-rounded(F.least(F.col("value") / 100, F.lit(1.0)), 3)).alias("a"), F.col("event_id").alias("b"))
    ranked = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("a", "b"))).filter("n <= 3")
    listed = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("n", "a", "b"))).alias("t"))
    return listed.select("user_id", F.concat_ws(",", F.transform("t", lambda x: F.concat(x["b"].cast("string"), F.lit(":"), F.format_string("%.3f", -x["a"])))).alias("top"))


@query(
    "SELECT l_suppkey, count(*) AS n, round(avg(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round(sum(CASE WHEN l_returnflag = 'A' THEN 1.0::DOUBLE ELSE 0 END) / nullif(count(CASE WHEN l_returnflag <> 'N' THEN 1 END), 0), 9) AS accuracy_of_judged FROM lineitem GROUP BY 1"
)
def accuracy_metrics(spark, sf_dir):
    """Two accuracies: of all rows, and of those that were judged."""
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.round(reports.share(flag == "A"), 9).alias("accuracy"), F.round(F.try_divide(reports.count_where(flag == "A").cast("double"), reports.count_where(flag != "N")), 9).alias("accuracy_of_judged")
    )


@query(
    "SELECT window_start::DATE::VARCHAR AS day, user_id, n, n > 2 AS capped FROM (SELECT date_trunc('day', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2)"
)
def daily_rate_counters(spark, sf_dir):
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    e = table(spark, sf_dir, "events").groupBy(day.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").cast("date").cast("string").alias("day"), "user_id", "n", (F.col("n") > 2).alias("capped"))


@query(
    "SELECT p_type, array_to_string(list_sort(list(p_brand)), ',') AS brands FROM (SELECT DISTINCT p_type, p_brand FROM part WHERE p_size BETWEEN 5 AND 9) GROUP BY 1"
)
def parameterised_in_list(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter(F.col("p_size").isin(5, 6, 7, 8, 9)).select("p_type", "p_brand").distinct()
    return p.groupBy("p_type").agg(F.concat_ws(",", F.sort_array(F.collect_list("p_brand"))).alias("brands"))


@query("SELECT count(*) AS unmatched FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def exists_check(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey")
    return table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").agg(F.count("*").alias("unmatched"))


@query("SELECT l_partkey, l_suppkey AS first_supplier FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) = 1")
def limit_one_lookup(spark, sf_dir):
    """One row of the right side a key, before the join, so that it cannot fan out."""
    first = reports.rank_by(table(spark, sf_dir, "lineitem"), "l_partkey", F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")).filter("rank = 1")
    p = table(spark, sf_dir, "part").select("p_partkey")
    return p.join(first, F.col("p_partkey") == F.col("l_partkey")).select("l_partkey", F.col("l_suppkey").alias("first_supplier"))


@query(
    "SELECT volume, plateau, semantic_share, volume::INT + plateau::INT + semantic_share::INT AS fired, CASE WHEN volume::INT + plateau::INT + semantic_share::INT >= 2 THEN 'RECOMMENDED' WHEN volume::INT + plateau::INT + semantic_share::INT >= 1 THEN 'CONSIDER' ELSE 'NOT_NEEDED' END AS advice FROM ("
    "SELECT count(CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN 1 END) >= 2000 AS volume, "
    f"(SELECT abs(regr_slope(n, -week)) < 1000 FROM ({WEEKS_SQL}) WHERE week < 4) AS plateau, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0 END) > 0.3 AS semantic_share FROM events)"
)
def retrain_library_triggers(spark, sf_dir):
    """Additions of thirty days, plateau and share of vector matches; two are needed."""
    e = table(spark, sf_dir, "events").agg(reports.count_where(F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz")).alias("added"), reports.share(F.col("event_type") == "click").alias("share"))
    weeks = learning.weekly_counts(table(spark, sf_dir, "events"), "ts", F.lit(AS_OF).cast("timestamp"))
    flat = learning.plateau(weeks, least_slope=1000.0).select("plateau")
    return learning.retraining({"volume": F.col("added") >= 2000, "plateau": F.col("plateau"), "semantic_share": F.col("share") > 0.3}, e.join(flat))
