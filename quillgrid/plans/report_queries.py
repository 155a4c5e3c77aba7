"""Joins, aggregates, changes, extraction and limits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgrid.operators import extraction, mutations, reports
from quillgrid.plans.registry import ANALYTES_SQL, analytes, query, table


@query(
    "SELECT l_orderkey, l_linenumber, o_orderstatus AS status, coalesce(p_name, '') AS preferred_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN (SELECT p_partkey, CASE WHEN p_size > 10 THEN p_name END AS p_name FROM part) ON l_partkey = p_partkey"
)
def results_enriched(spark, sf_dir):
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    named = p.select(F.col("p_partkey").alias("analyte_id"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("preferred_name"), F.col("p_brand").alias("group_code"))
    joined = li.select("l_orderkey", "l_linenumber", "l_partkey").join(o.select("o_orderkey", F.col("o_orderstatus").alias("status")), F.col("l_orderkey") == F.col("o_orderkey"))
    return reports.enrich(joined, named, "l_partkey").select("l_orderkey", "l_linenumber", "status", "preferred_name")


@query("SELECT c.n_name AS child, p.n_name AS parent_name FROM nation c LEFT JOIN nation p ON c.n_nationkey // 5 - 1 = p.n_nationkey")
def parent_self_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("analyte_id"), F.col("n_name").alias("preferred_name"), (F.floor(F.col("n_nationkey") / 5) - 1).cast("string").alias("parent_analyte_id"))
    return reports.with_parent(n).select(F.col("preferred_name").alias("child"), "parent_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def no_children_anti(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def orphan_anti(spark, sf_dir):
    from quillgrid import schema

    parents = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return schema.orphans(table(spark, sf_dir, "labels"), parents, "doc_id", "doc_id").select("doc_id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_vendor(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    return table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT c_custkey AS analyte_id, count(*) AS rows, count(DISTINCT o_orderkey) AS synonyms FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def synonym_coverage(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("analyte_id"))
    return reports.coverage(c, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("analyte_id"), F.col("o_orderkey").alias("synonym_id")))


_RESULTS = "SELECT l_orderkey, round(1 - l_discount, 6) AS c, CASE l_returnflag WHEN 'A' THEN 'validated' WHEN 'N' THEN 'pending' ELSE 'skipped' END AS s FROM lineitem"


def _summary(spark, sf_dir):
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "validated").when(flag == "N", "pending").otherwise("skipped")
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.round(1 - F.col("l_discount"), 6).alias("c"), status.alias("s"))
    return reports.submission_summary(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), results, "k", "c", "s")


_SUMMARY = (
    f"SELECT o_orderkey AS k, count(s) AS total, count(CASE WHEN s = 'validated' THEN 1 END) AS validated, count(CASE WHEN s = 'pending' THEN 1 END) AS pending, count(CASE WHEN s = 'skipped' THEN 1 END) AS skipped, "
    f"count(CASE WHEN c >= 0.95 THEN 1 END) AS high, avg(CASE WHEN s = 'validated' THEN c END) AS mean_accepted FROM orders LEFT JOIN ({_RESULTS}) ON l_orderkey = o_orderkey GROUP BY 1"
)


@query(f"SELECT k, total, validated, pending, skipped FROM ({_SUMMARY})")
def conditional_counts(spark, sf_dir):
    return _summary(spark, sf_dir).select("k", "total", "validated", "pending", "skipped")


@query(f"SELECT k, round(mean_accepted, 6) AS mean_accepted FROM ({_SUMMARY})")
def conditional_avg(spark, sf_dir):
    return _summary(spark, sf_dir).select("k", F.round("mean_accepted", 6).alias("mean_accepted"))


@query(f"SELECT k, total FROM ({_SUMMARY}) WHERE total = high AND total > 0")
def having_all_high(spark, sf_dir):
    return reports.all_high(_summary(spark, sf_dir)).select("k", "total")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) <= 20")
def having_low_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).filter("n <= 20")


@query("SELECT CASE WHEN c >= 0.98 THEN 'top' WHEN c >= 0.95 THEN 'high' WHEN c >= 0.92 THEN 'medium' ELSE 'low' END AS bucket, count(*) AS n, min(c) AS least FROM (SELECT round(1 - l_discount, 6) AS c FROM lineitem) GROUP BY 1")
def bucket_histogram(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.round(1 - F.col("l_discount"), 6).alias("c"))
    return reports.histogram(c, F.col("c"), ((0.98, "top"), (0.95, "high"), (0.92, "medium")), "low")


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def topn_frequent(spark, sf_dir):
    return reports.top_n(table(spark, sf_dir, "lineitem"), "l_partkey", 20)


@query("SELECT l_partkey, count(DISTINCT CASE WHEN l_returnflag <> 'R' THEN l_suppkey END) AS suppliers FROM lineitem GROUP BY 1")
def distinct_consensus(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct(F.when(F.col("l_returnflag") != "R", F.col("l_suppkey"))).alias("suppliers"))


@query("SELECT printf('Brand_%03d', (max(CAST(substr(p_brand, 7) AS INT)) + 1)::INT) AS next_id FROM part")
def max_suffix_id(spark, sf_dir):
    return mutations.next_id(table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("_")).alias("id")), "id", "Brand")


@query(
    "SELECT l_orderkey, max(CASE WHEN f = 'A' THEN v END) AS A, max(CASE WHEN f = 'N' THEN v END) AS N, max(CASE WHEN f = 'R' THEN v END) AS R FROM ("
    "SELECT l_orderkey, l_returnflag AS f, arg_min(l_linestatus || l_quantity::INT, {'a': l_linenumber, 'b': l_linestatus || l_quantity::INT}) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1"
)
def pivot_first(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return reports.pivot_first(li, "l_orderkey", "l_returnflag", ["A", "N", "R"], F.concat("l_linestatus", F.col("l_quantity").cast("int").cast("string")), "l_linenumber")


@query("SELECT l_partkey, count(DISTINCT l_orderkey) AS files, count(DISTINCT l_suppkey) AS analytes, count(*) AS n, count(DISTINCT l_suppkey) = 1 AS consistent FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def cross_file_consistency(spark, sf_dir):
    return reports.consistency(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", "l_suppkey")


@query("SELECT section, value, n FROM (SELECT 'l_returnflag' AS section, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2)")
def summary_grouping_sets(spark, sf_dir):
    return reports.sections(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), "l_returnflag", "l_linestatus")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders ORDER BY place LIMIT 100")
def priority_sort_limit(spark, sf_dir):
    first = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    top = table(spark, sf_dir, "orders").select("o_orderkey", first.alias("p")).orderBy("p", "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("p", "o_orderkey")).cast("long").alias("place"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 50 OFFSET 100")
def paged_list(spark, sf_dir):
    return reports.page(table(spark, sf_dir, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")], 100, 50)


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%BOLT%' ORDER BY p_name, p_partkey LIMIT 30")
def ilike_search(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").filter(F.col("p_name").ilike("%BOLT%")).orderBy("p_name", "p_partkey").limit(30)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'O' THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def status_update(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return mutations.update_where(o, (F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") == "O"), o_orderstatus=F.lit("R")).drop("o_totalprice")


@query(
    "WITH i AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 2 = 0), e AS (SELECT o_custkey, o_orderdate, o_orderkey FROM orders WHERE o_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1), "
    "f AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1) "
    "SELECT o_custkey, o_orderdate FROM (SELECT o_custkey, o_orderdate, 0 AS k FROM e UNION ALL SELECT o_custkey, o_orderdate, 1 FROM f) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, k DESC) = 1"
)
def upsert_latest(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    newest = lambda df: reports.rank_by(df, "o_custkey", F.desc("o_orderdate"), F.col("o_orderkey")).filter("rank = 1").select("o_custkey", "o_orderdate")
    return mutations.upsert(newest(o.filter("o_orderkey % 2 = 1")), newest(o.filter("o_orderkey % 2 = 0")), ["o_custkey"], "o_orderdate")


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem a WHERE a.l_returnflag = 'A' AND a.l_partkey = l.l_partkey AND a.l_suppkey = l.l_suppkey)")
def idempotent_insert(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    return mutations.append_new(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]).select("l_partkey", "l_suppkey")


@query("SELECT user_id, event_type, count(*) AS frequency_count, min(ts::DATE)::VARCHAR AS first_seen_date, max(ts::DATE)::VARCHAR AS last_seen_date FROM events GROUP BY 1, 2")
def observed_variants(spark, sf_dir):
    seen = mutations.observe(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), ["user_id", "event_type"], "day")
    return seen.withColumns({c: F.col(c).cast("string") for c in ("first_seen_date", "last_seen_date")})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return mutations.delete_cascade(o, o.filter("o_orderstatus = 'F'"), "o_orderkey", (li, "l_orderkey"))[1]


@query(
    "SELECT 'quantity' AS check, count(CASE WHEN NOT l_quantity BETWEEN 1 AND 40 THEN 1 END) AS n FROM lineitem UNION ALL SELECT 'discount', count(CASE WHEN NOT l_discount BETWEEN 0 AND 1 THEN 1 END) FROM lineitem UNION ALL SELECT 'flag', count(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 1 END) FROM lineitem"
)
def integrity_checks(spark, sf_dir):
    from quillgrid import schema

    return schema.violations(table(spark, sf_dir, "lineitem"), quantity=F.col("l_quantity").between(1, 40), discount=F.col("l_discount").between(0, 1), flag=F.col("l_returnflag").isin("A", "N"))


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    from quillgrid import schema

    return schema.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")


@query(
    "SELECT l_orderkey AS file, l_linenumber::INT AS row_num, m AS sample, v AS result_value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_tax AS tax, l_discount AS discount FROM lineitem) ON quantity, tax, discount INTO NAME m VALUE v)"
)
def unpivot_samples(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("row_num"), F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"))
    return li.unpivot(["file", "row_num"], ["quantity", "tax", "discount"], "sample", "result_value")


@query(
    "SELECT event_id, last_value(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM (SELECT event_id, user_id, CASE WHEN event_type = 'purchase' OR event_type = 'error' THEN event_type || event_id END AS g FROM events)"
)
def forward_fill(spark, sf_dir):
    mark = F.when(F.col("event_type").isin("purchase", "error"), F.concat("event_type", F.col("event_id").cast("string")))
    return extraction.fill_down(table(spark, sf_dir, "events"), "user_id", "event_id", mark, "carried").select("event_id", "carried")


_GRID = "SELECT doc_id AS file, i AS row, unnest(range(len(cells))) AS col, unnest(cells) AS value FROM (SELECT doc_id, i, string_split(line, ' ') AS cells FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents))"


def _grid(spark, sf_dir):
    """Documents as grids: a line is a row, a word a cell."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.select("file", "row", F.posexplode(F.split("line", " ")).alias("col", "value"))


@query(
    f"SELECT file, row, hits, least(hits / 5.0, 1.0)::DOUBLE AS confidence FROM (SELECT file, row, count(CASE WHEN contains(lower(value), 'tion') OR contains(lower(value), 'the') THEN 1 END) AS hits FROM ({_GRID}) WHERE row < 30 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY file ORDER BY hits DESC, row) = 1"
)
def header_score(spark, sf_dir):
    found = extraction.header_row(_grid(spark, sf_dir), ("tion", "the"))
    return found.select("file", F.col("row").cast("long").alias("row"), "hits", "confidence")


@query(f"SELECT file, row, arg_min(trim(value), col) AS result FROM ({_GRID}) WHERE col BETWEEN 1 AND 9 AND regexp_matches(trim(value), '^[<>]?[0-9.,\\-]+') GROUP BY 1, 2")
def first_result_cell(spark, sf_dir):
    return extraction.first_result(_grid(spark, sf_dir)).select("file", F.col("row").cast("long").alias("row"), "result")


@query(f"SELECT DISTINCT file FROM ({_GRID}) WHERE contains(lower(value), 'license')")
def cell_search(spark, sf_dir):
    return extraction.files_with_text(_grid(spark, sf_dir), "License")


def _chemical_sql():
    low = "lower(trim(line))"
    footer = " OR ".join(f"contains({low}, '{x}')" for x in extraction.FOOTERS)
    return f"len(line) BETWEEN 2 AND 100 AND NOT regexp_full_match(line, '[0-9.\\-<>]+') AND {low} NOT IN ({', '.join(repr(x) for x in extraction.NO_CHEMICALS)}) AND NOT ({footer})"


@query(f"SELECT doc_id, count(*) AS lines, count(CASE WHEN {_chemical_sql()} THEN 1 END) AS kept FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1")
def chemical_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count(F.when(extraction.is_chemical_row(F.col("line"), F.lit("layout_b")), 1)).alias("kept"))


@query("SELECT avg(CASE WHEN a <= 3 THEN o_totalprice END) AS first_mean, avg(CASE WHEN d <= 3 THEN o_totalprice END) AS last_mean FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderkey DESC) AS d FROM orders)".replace("avg(CASE WHEN a <= 3 THEN o_totalprice END)", "round(avg(CASE WHEN a <= 3 THEN o_totalprice END), 4)").replace("avg(CASE WHEN d <= 3 THEN o_totalprice END)", "round(avg(CASE WHEN d <= 3 THEN o_totalprice END), 4)"))
def first_last_trend(spark, sf_dir):
    t = reports.first_last_trend(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")
    return t.select(F.round("first_mean", 4).alias("first_mean"), F.round("last_mean", 4).alias("last_mean"))


@query(
    "SELECT event_type || '-' || user_id AS text, count(*) AS frequency, max(c) AS best_confidence, max(ts) AS last_seen FROM (SELECT *, round(least(value / 100, 1), 6) AS c FROM events) WHERE ts >= TIMESTAMP '2024-01-10' AND c < 0.85 GROUP BY 1 HAVING count(*) >= 2"
)
def review_queue(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("t"), F.col("event_type").alias("a"), F.round(F.least(F.col("value") / 100, F.lit(1.0)), 6).alias("c"), "ts")
    return reports.review_queue(e, "t", "a", "c", "ts", F.lit("2024-01-10").cast("timestamp"), least=2).select("text", "frequency", "best_confidence", "last_seen")


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'NO_MATCH' WHEN p_size % 5 = 1 THEN 'NOT_FOUND' WHEN p_size % 5 = 2 THEN 'CORRECT' WHEN p_size % 5 = 3 THEN 'WRONG' ELSE 'LIKELY' END AS verdict FROM part"
)
def outside_verdict(spark, sf_dir):
    k = F.col("p_size") % 5
    given, found = F.when(k != 0, "1-11-1"), F.when(k == 2, "1-11-1").when(k == 3, "2-22-2")
    return table(spark, sf_dir, "part").select("p_partkey", reports.verdict(k != 1, found, given, F.lit(True)).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'fixed' ELSE l_linestatus END AS id FROM lineitem")
def effective_id(spark, sf_dir):
    fix = F.when(F.col("l_returnflag") == "R", "fixed").when(F.col("l_returnflag") == "A", " ")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reports.effective_id(fix, F.col("l_linestatus")).alias("id"))


@query(f"WITH {ANALYTES_SQL} SELECT count(*) AS n FROM analytes WHERE preferred_name LIKE '%bolt%' OR analyte_id IN ('A1', 'A2', 'A3')")
def filter_builder(spark, sf_dir):
    df = analytes(spark, sf_dir).withColumn("chemical_raw", F.col("preferred_name"))
    return df.filter(reports.filters(text="BOLT") | F.col("analyte_id").isin("A1", "A2", "A3")).agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) > 50 AS high FROM events")
def json_signals(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k > 50).alias("high"))


@query("SELECT p_partkey, md5(p_name) AS m, sha256(p_brand || p_type) AS s FROM part")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(F.col("p_name").cast("binary")).alias("m"), F.sha2(F.concat("p_brand", "p_type").cast("binary"), 256).alias("s"))


@query("SELECT n_name, list_sort(list(DISTINCT c_mktsegment)) AS segments FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY 1".replace("list_sort(list(DISTINCT c_mktsegment)) AS segments", "array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments"))
def variant_sets(spark, sf_dir):
    j = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.concat_ws(",", F.sort_array(F.collect_set("c_mktsegment"))).alias("segments"))


@query("SELECT p_brand FROM part WHERE p_size > 30 EXCEPT SELECT p_brand FROM part WHERE p_type = 'SMALL'")
def missing_columns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.filter("p_size > 30").select("p_brand").subtract(p.filter("p_type = 'SMALL'").select("p_brand"))
