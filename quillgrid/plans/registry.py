"""Registration of named queries, and the tables in the roles the queries give them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions.names import normalise
from quillgrid.shipping import shipped

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL for the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def analytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names as the registry."""
    rows = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    number = F.concat_ws("-", F.col("k") + 10, F.lit("11"), (F.col("k") % 10).cast("string"))
    return rows.select(F.concat(F.lit("A"), "k").alias("analyte_id"), F.col("p_name").alias("preferred_name"), number.alias("cas_number"))


def synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two synonyms an analyte: its name, and its name without its third letter, the latter of one vendor."""
    base = analytes(spark, sf_dir).withColumn("k", F.substring("analyte_id", 2, 20).cast("long"))
    typo = F.concat(F.substring("preferred_name", 1, 2), F.expr("substring(preferred_name, 4)"))
    both = base.select("analyte_id", "k", F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("preferred_name").alias("raw")), F.struct(F.lit(1).alias("v"), typo.alias("raw")))).alias("s"))
    return both.select(
        (F.col("k") * 2 + F.col("s.v")).alias("synonym_id"), "analyte_id", F.col("s.raw").alias("synonym_raw"), normalise(F.col("s.raw")).alias("synonym_norm"),
        F.when(F.col("s.v") == 1, "SGX").alias("lab_vendor"),
    )


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty names: as written in capitals, without the fifth letter, with a tail, and one unknown a name."""
    name = F.col("preferred_name")
    forms = F.array(F.upper(name), F.concat(F.substring(name, 1, 4), F.expr("substring(preferred_name, 6)")), F.concat(name, F.lit(", total")), F.concat(F.lit("zq"), F.reverse(name), F.lit("kw")))
    return analytes(spark, sf_dir).select(F.explode(forms).alias("input_text")).distinct()


def rounded(x: Column, places: int) -> Column:
    """A double rounded as the SQL does it: times a power of ten, to the nearest whole number, and back. Spark's own rounds the shortest decimal, by which 0.565 is 0.57 and not 0.56."""
    return F.round(x * 10.0**places) / 10.0**places


def norm_sql(x: str) -> str:
    """DuckDB SQL of ``normalise`` for ASCII text."""
    from quillgrid.functions.names import GREEK, SPELLED

    out = f"regexp_replace(regexp_replace({x}, '[(){{}}\\[\\],''\";:-]', ' ', 'g'), '\\s+', ' ', 'g')"
    for k, v in [*SPELLED.items(), *GREEK.items()]:
        out = f"regexp_replace({out}, '\\b{k}\\b', '{v}', 'gi')"
    out = f"regexp_replace({out}, '([+RSEZrsez])([a-zA-Z])', '\\1 \\2', 'g')"
    return f"trim(regexp_replace(lower(regexp_replace({out}, '\\.+\\s*$', '')), '\\s+', ' ', 'g'))"


def ratio_sql(a: str, b: str) -> str:
    """DuckDB SQL of the indel ratio: one row of the dynamic programme a letter."""
    lcs = (
        f"list_reduce(list_prepend(list_transform(range(len({b}) + 1), lambda i: 0), list_transform(string_split({a}, ''), lambda c: list_transform(string_split({b}, ''), lambda d: (c = d)::INT))), "
        "lambda r, m: list_reduce(list_prepend([0], list_transform(range(1, len(m) + 1), lambda j: [m[j], r[j], r[j + 1]])), "
        "lambda acc, e: list_append(acc, CASE WHEN e[1] = 1 THEN e[2] + 1 ELSE greatest(acc[len(acc)], e[3]) END)))"
    )
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0::DOUBLE ELSE 2::DOUBLE * list_extract({lcs}, -1) / (len({a}) + len({b})) END"


#: The day that queries take for today.
AS_OF = "2024-01-31"
#: Events by week back from it.
WEEKS_SQL = f"SELECT week, coalesce(n, 0) AS n FROM (SELECT unnest(range(12)) AS week) LEFT JOIN (SELECT CAST(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 604800) AS BIGINT) AS week, count(*) AS n FROM events GROUP BY 1) USING (week)"

#: WITH clauses of the roles above.
ANALYTES_SQL = "analytes AS (SELECT 'A' || min(p_partkey) AS analyte_id, p_name AS preferred_name, min(p_partkey) AS k, (min(p_partkey) + 10) || '-11-' || (min(p_partkey) % 10) AS cas_number FROM part GROUP BY p_name)"
SYNONYMS_SQL = (
    f"{ANALYTES_SQL}, synonyms AS (SELECT k * 2 + v AS synonym_id, analyte_id, raw AS synonym_raw, {norm_sql('raw')} AS synonym_norm, CASE WHEN v = 1 THEN 'SGX' END AS lab_vendor FROM ("
    "SELECT analyte_id, k, 0 AS v, preferred_name AS raw FROM analytes UNION ALL SELECT analyte_id, k, 1, substr(preferred_name, 1, 2) || substr(preferred_name, 4) FROM analytes))"
)
INPUTS_SQL = (
    f"{SYNONYMS_SQL}, inputs AS (SELECT DISTINCT input_text, {norm_sql('input_text')} AS norm FROM (SELECT unnest([upper(preferred_name), substr(preferred_name, 1, 4) || substr(preferred_name, 6), preferred_name || ', total', 'zq' || reverse(preferred_name) || 'kw']) AS input_text FROM analytes))"
)
