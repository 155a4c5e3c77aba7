"""Signatures and hashed vectors over every full name of a part, the vector index, thresholds of continuous scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions.similarity import KINDS, indel_ratio_arrow
from quillgrid.operators import learning, lookup_cache, prefix_join, signatures, vector_index
from quillgrid.plans.registry import query, ratio_sql, table
from quillgrid.storage import materialise, new_path

LEAST = 0.9


def full_names(spark, sf_dir):
    """Every distinct name of name, brand and type."""
    return table(spark, sf_dir, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("name")).distinct()


_FULL = "SELECT DISTINCT lower(concat_ws(' ', p_name, p_brand, p_type)) AS name FROM part"
_BAG = "[" + ", ".join(f"len({{0}}) - len(replace({{0}}, '{k}', ''))" for k in KINDS) + ", len(regexp_replace({0}, '[a-z ]', '', 'g'))]"


@query(
    f"WITH names AS ({_FULL}), a AS (SELECT input, {_BAG.format('input')} AS bag FROM (SELECT substr(name, 1, 4) || substr(name, 6) AS input FROM names)), b AS (SELECT name, {_BAG.format('name')} AS bag FROM names), "
    f"near AS (SELECT DISTINCT input, name FROM a, b WHERE 2.0 * list_sum(list_transform(list_zip(a.bag, b.bag), lambda x: least(x[1], x[2]))) >= {LEAST} * (len(input) + len(name))) "
    f"SELECT input, name, round(ratio, 9) AS ratio FROM (SELECT input, name, {ratio_sql('input', 'name')} AS ratio FROM near) WHERE ratio >= {LEAST}"
)
def similar_names(spark, sf_dir):
    """Every full name without its fifth letter against all full names, met on signatures."""
    names = full_names(spark, sf_dir)
    asked = names.select(F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)")).alias("input")).distinct()
    met = signatures.candidates(asked, names, "input", "name", LEAST)
    return met.withColumn("ratio", indel_ratio_arrow(F.col("input"), F.col("name"))).filter(F.col("ratio") >= LEAST).select("input", "name", F.round("ratio", 9).alias("ratio"))


_SIM = "list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))"
_DOUBLES = "SELECT vec_id, list_transform(embedding, lambda e: e::DOUBLE) AS v FROM embeddings"
_NEAREST = f"SELECT a.vec_id AS input_id, b.vec_id AS vector_id, {_SIM} AS s FROM ({_DOUBLES}) a, ({_DOUBLES}) b WHERE a.vec_id % 20 = 0"


def _indexed(spark, sf_dir):
    """Two thirds of the vectors indexed, the rest appended."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("vec_id").cast("string").alias("analyte_id"), F.col("embedding").alias("vector"))
    index = vector_index.build(e.filter("vector_id % 3 <> 0")).append(e.filter("vector_id % 3 = 0"))
    return index, e.filter("vector_id % 20 = 0").select(F.col("vector_id").alias("input_id"), "vector")


@query(f"SELECT input_id, vector_id, rank, round(s, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY round(s, 12) DESC, vector_id) AS rank FROM ({_NEAREST})) WHERE rank <= 5")
def index_topk(spark, sf_dir):
    """Nearest vectors of every vector whose id is divisible by 20, from an index that was built and then appended to."""
    index, queries = _indexed(spark, sf_dir)
    return index.search(queries, 5).select("input_id", "vector_id", F.col("rank").cast("long").alias("rank"), F.round("sim", 6).alias("sim"))


_GRAM = "unnest(list_transform(range(1, len(p) - 1), lambda i: substr(p, i::INT, 3)))"
_H = "('0x' || substr(md5(g), 1, 8))::BIGINT"


def _buckets_sql(source):
    return f"SELECT text, {_H} % 256 AS bucket, sum(CASE WHEN ({_H} // 256) % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS tf FROM (SELECT text, {_GRAM} AS g FROM (SELECT text, ' ' || text || ' ' AS p FROM {source})) GROUP BY 1, 2"


@query(
    f"WITH names AS (SELECT name AS text FROM ({_FULL})), asked AS (SELECT DISTINCT substr(text, 1, 4) || substr(text, 6) AS text FROM names), nb AS ({_buckets_sql('names')}), ab AS ({_buckets_sql('asked')}), "
    "idf AS (SELECT bucket, ln((1 + (SELECT count(*) FROM names))::DOUBLE / (1 + count(*))) + 1 AS w FROM nb GROUP BY 1), "
    "nw AS (SELECT text, bucket, tf * coalesce(w, 1) AS x FROM nb LEFT JOIN idf USING (bucket)), aw AS (SELECT text, bucket, tf * coalesce(w, 1) AS x FROM ab LEFT JOIN idf USING (bucket)), "
    "nn AS (SELECT text, sqrt(sum(x * x)) AS l FROM nw GROUP BY 1), an AS (SELECT text, sqrt(sum(x * x)) AS l FROM aw GROUP BY 1), "
    "met AS (SELECT aw.text AS input, nw.text AS name, sum(aw.x * nw.x) AS d FROM aw JOIN nw USING (bucket) GROUP BY 1, 2) "
    "SELECT input, max(round(d / (an.l * nn.l), 6)) AS sim FROM met JOIN an ON input = an.text JOIN nn ON name = nn.text GROUP BY 1"
)
def semantic_names(spark, sf_dir):
    """The similarity of the nearest full name to every full name without its fifth letter: hashed n-grams, weighed, indexed and searched."""
    names = full_names(spark, sf_dir).withColumn("id", F.xxhash64("name"))
    asked = names.select(F.concat(F.substring("name", 1, 4), F.expr("substring(name, 6)")).alias("input")).distinct().withColumn("input_id", F.xxhash64("input"))
    idf = vector_index.document_frequencies(names, "id", "name")
    # Written once: every filter and sample of the index would work the vectors out again.
    held, questions = (materialise(vector_index.vectorise(*what, idf)) for what in ((names, "id", "name"), (asked, "input_id", "input")))
    index = vector_index.build(held.select(F.col("id").alias("vector_id"), F.lit(None).cast("string").alias("analyte_id"), "vector"))
    found = index.search(questions, 1)
    return found.join(asked, "input_id").select("input", F.round("sim", 6).alias("sim"))


_PRICED = "SELECT l_extendedprice * (1 - l_discount) AS s, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS ok FROM lineitem"
_PRICED_RUN = f"SELECT s, sum(n) OVER w AS n, sum(good) OVER w AS good, sum(good) OVER () AS all_good FROM (SELECT s, count(*) AS n, sum(ok) AS good FROM ({_PRICED}) GROUP BY 1) WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("s"), (F.col("l_returnflag") != "R").alias("ok"))


@query(f"SELECT coalesce(max(s), 0.95::DOUBLE) AS threshold FROM ({_PRICED_RUN}) WHERE n >= 10 AND good / n >= 0.7")
def precision_of_continuous(spark, sf_dir):
    """The precision threshold of a score with as many values as rows."""
    return learning.precision_threshold(_priced(spark, sf_dir), "s", F.col("ok"), 0.7)


@query(f"SELECT s AS threshold, round(f1, 9) AS f1 FROM (SELECT s, good / n AS p, good / all_good AS r, 2 * (good / n) * (good / all_good) / (good / n + good / all_good) AS f1 FROM ({_PRICED_RUN})) WHERE p >= 0.5 AND r >= 0.5 ORDER BY f1 DESC, s DESC LIMIT 1")
def f1_of_continuous(spark, sf_dir):
    """The score of best F1 among as many values as rows."""
    return learning.f1_threshold(_priced(spark, sf_dir), "s", F.col("ok"), 0.5).select("threshold", F.round("f1", 9).alias("f1"))


_CUT = "substr(name, 1, len(name) * 2 // 3) || CASE WHEN len(name) % 2 = 0 THEN '' ELSE '. x' END"


@query(
    f"WITH names AS ({_FULL}), asked AS (SELECT DISTINCT {_CUT} AS text FROM names), begun AS (SELECT DISTINCT substr(name, 1, i::INT) AS prefix FROM (SELECT name, unnest(range(1, len(name) + 1)) AS i FROM names)), "
    "cut AS (SELECT text, substr(text, 1, i::INT) AS prefix, i FROM (SELECT text, unnest(range(1, len(text) + 1)) AS i FROM asked)), "
    "shared AS (SELECT text, max(i)::INT AS common FROM cut JOIN begun USING (prefix) GROUP BY 1), "
    "best AS (SELECT text, min(struct_pack(n := len(name), name := name)).name AS name FROM shared JOIN names ON starts_with(name, substr(text, 1, common)) GROUP BY 1) "
    "SELECT text, coalesce(common, 0) AS common, name FROM asked LEFT JOIN shared USING (text) LEFT JOIN best USING (text)"
)
def truncated_names(spark, sf_dir):
    """Full names cut after two thirds, every other one with a remark that no name has, completed from the registry."""
    names = full_names(spark, sf_dir)
    n = F.length("name")
    cut = F.concat(F.substring("name", F.lit(1), F.floor(n * 2 / 3).cast("int")), F.when(n % 2 == 0, "").otherwise(". x"))
    return prefix_join.complete(names.select(cut.alias("text")), names)


def _registry(keys: list[str]) -> list[dict | None]:
    """A stand-in for the outside registry: every third name, by its length, is unknown to it."""
    return [None if len(k) % 3 == 0 else {"numbers": [f"{len(k)}-00-{len(k) % 10}"], "synonyms": [k.split(" ")[0], k.upper()]} for k in keys]


@query(
    f"WITH names AS ({_FULL}) SELECT name AS key, len(name) % 3 <> 0 AS found, CASE WHEN len(name) % 3 <> 0 THEN len(name) || '-00-' || len(name) % 10 END AS number, 1::BIGINT AS asked_in_january, 0::BIGINT AS asked_again, CASE WHEN len(name) % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS asked_in_march FROM names"
)
def lookup_read_through(spark, sf_dir):
    """Every full name looked up thrice: the second time nothing is asked, two months later what was not found is asked again."""
    cache = lookup_cache.LookupCache(spark, new_path(spark), found_days=365, missing_days=30)
    names, runs = full_names(spark, sf_dir).select(F.col("name").alias("key")), []
    for day in ("2024-01-01", "2024-01-02", "2024-03-01"):
        known = cache.look_up(names, _registry, F.lit(day).cast("timestamp"))
        runs.append(cache.entries().filter(F.col("fetched_at") == F.lit(day).cast("timestamp")).groupBy("key").agg(F.count("*").alias(f"n_{len(runs)}")))
    out = known.select("key", "found", F.get("numbers", F.lit(0)).alias("number"))
    for r in runs:
        out = out.join(r, "key", "left")
    return out.select("key", "found", "number", *(F.coalesce(f"n_{i}", F.lit(0)).cast("long").alias(name) for i, name in enumerate(("asked_in_january", "asked_again", "asked_in_march"))))
