"""Regional notation, short forms and valence states, and outside checks, each computed by the SQL from the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgrid.functions import names, qualifiers
from quillgrid.operators import reports
from quillgrid.plans.registry import norm_sql, query, table

#: A part's first word stands before these, so that each row has words around its short form or none.
FORMS = (
    "1,4 Diox", "Diox.", "1,1,1-TCA", "tca", "TCE ", "pce", "DCE", "dca", "PHC  F3", "Hexavalent Cr", "Cr (VI)", "Cr6+ ", "PAH", "Naph", "BTEX",
    "Total P", "TP (total)", "total  N", "TN", "TKN", "F-2", "p-xylene", "o-Xylene", "m- xylene", "diss lead", "Tot Lead", "rec. lead", "1, 2, 3-X", "2 ,4-D",
)


def _chain_sql(x: str, pairs) -> str:
    for p, to in pairs:
        x = f"regexp_replace({x}, '{p}', '{to.replace('$', chr(92))}', 'gi')"
    return x


# RE2 has no look-ahead, so a digit between two commas takes a second pass, which leaves out what is closed up.
_SPACED = ((r"(\d)\s+,\s*(\d)", "$1,$2"), (r"(\d),\s+(\d)", "$1,$2")) * 2
_METALS = [x for x in qualifiers.SHORT_FORMS if x[1] in qualifiers.VALENCES]
_REGIONAL_SQL = f"trim(regexp_replace({_chain_sql(_chain_sql(_chain_sql('lower(given)', qualifiers.SHORT_FORMS), _SPACED), qualifiers.NOTATION)}, '\\s+', ' ', 'g'))"
_GIVEN_SQL = "SELECT p_partkey, unnest([{}]) AS form, split_part(p_name, ' ', 1) AS word FROM part".format(", ".join(f"'{x}'" for x in FORMS))


@query(
    f"SELECT p_partkey, form, {_REGIONAL_SQL} AS regional, {_chain_sql(norm_sql('given'), qualifiers.SHORT_FORMS)} AS written_out, {_chain_sql(norm_sql('given'), _METALS)} AS metal, "
    + "(" + " OR ".join(f"regexp_matches(given, '{p}', 'i')" for p, _ in qualifiers.SHORT_FORMS) + ") AS short_form "
    + f"FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN word || ' ' || form ELSE form END AS given FROM ({_GIVEN_SQL}))"
)
def notation_forms(spark, sf_dir):
    """All regional short forms, fractions and valence states, alone and after a word of a part's name."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"))
    # A row becomes as many as there are forms: the rows of one file are dealt to all tasks before.
    rows = part.repartition(spark.sparkContext.defaultParallelism, "p_partkey").withColumn("form", F.explode(F.array(*map(F.lit, FORMS))))
    given = F.when(F.col("p_partkey") % 2 == 0, F.concat("word", F.lit(" "), "form")).otherwise(F.col("form"))
    found = names.with_forms(
        rows.select("p_partkey", "form", given.alias("given")), "given",
        regional=qualifiers.regional(F.col("given")), written_out=qualifiers.written_out(F.col("given")), metal=qualifiers.metal_notation(F.col("given")), short_form=qualifiers.is_short_form(F.col("given")),
    )
    return found.drop("given")


@query(
    "SELECT verdict, count(*) AS n, min(l_orderkey) AS first_order FROM (SELECT l_orderkey, CASE WHEN given IS NULL THEN 'NO_MATCH' WHEN NOT looked_up THEN 'NOT_FOUND' WHEN found = given THEN 'CORRECT' "
    "WHEN found IS NULL AND agree THEN 'LIKELY' WHEN found IS NULL THEN 'UNCERTAIN' ELSE 'WRONG' END AS verdict FROM (SELECT l_orderkey, CASE WHEN l_linenumber < 7 THEN (l_suppkey % 4)::VARCHAR END AS given, "
    "CASE WHEN l_returnflag <> 'R' THEN (l_partkey % 4)::VARCHAR END AS found, l_quantity < 45 AS looked_up, s_nationkey = c_nationkey AS agree "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)) GROUP BY 1"
)
def outside_verdicts(spark, sf_dir):
    """Every verdict of an outside check, with what was found, given and agreed taken from four tables."""
    line, orders, customer, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    given = F.when(F.col("l_linenumber") < 7, (F.col("l_suppkey") % 4).cast("string"))
    found = F.when(F.col("l_returnflag") != "R", (F.col("l_partkey") % 4).cast("string"))
    told = reports.verdict(F.col("l_quantity") < 45, found, given, F.col("s_nationkey") == F.col("c_nationkey"))
    return rows.groupBy(told.alias("verdict")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))
