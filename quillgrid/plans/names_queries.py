"""Scalar functions over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import names, qualifiers, registry_numbers, synonyms
from quillgrid.functions.similarity import bigrams, indel_ratio, indel_ratio_arrow, jaccard
from quillgrid.operators import matching
from quillgrid.plans.registry import ANALYTES_SQL, analytes, norm_sql, query, ratio_sql, table

LINES_SQL = "SELECT doc_id, i, unnest_line AS line FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS unnest_line FROM documents)"


@query(f"SELECT p_partkey, {norm_sql('p_name')} AS norm, {norm_sql(norm_sql('p_name'))} AS norm_twice FROM part")
def normalize_names(spark, sf_dir):
    once = names.normalise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", once.alias("norm"), names.normalise(once).alias("norm_twice"))


_CHECK = "list_sum(list_transform(range(1, len(body) + 1), lambda i: substr(body, len(body) + 1 - i::INT, 1)::INT * i)) % 10"


@query(
    "WITH t AS (SELECT p_partkey, (p_partkey + 10) || '-' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-' || (p_partkey % 10) AS num, (p_partkey + 10) || lpad(CAST(p_size AS VARCHAR), 2, '0') AS body FROM part) "
    f"SELECT p_partkey, num, {_CHECK} = p_partkey % 10 AS ok, CASE WHEN {_CHECK} = p_partkey % 10 THEN num END AS extracted FROM t"
)
def cas_checksum(spark, sf_dir):
    num = F.concat_ws("-", F.col("p_partkey") + 10, F.lpad(F.col("p_size").cast("string"), 2, "0"), F.col("p_partkey") % 10)
    df = table(spark, sf_dir, "part").select("p_partkey", num.alias("num"))
    return df.select("p_partkey", "num", registry_numbers.is_valid(F.col("num")).alias("ok"), registry_numbers.extract(F.concat(F.lit("no. "), "num", F.lit(" x"))).alias("extracted"))


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(line, '\s*\[\s*\d{1,7}-\d{2}-\d\s*\]\s*$', ''), '\s*\([^)]*\)\s*$', ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, i, {_CLEAN} AS cleaned FROM ({LINES_SQL})")
def clean_text(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", F.col("i").cast("long").alias("i"), synonyms.clean(F.col("line")).alias("cleaned"))


def _holds_sql(x, terms):
    return "(" + " OR ".join(f"contains(lower({x}), '{t}')" for t in terms) + ")"


_REASON = (
    "CASE WHEN c = '' THEN 'empty' WHEN len(c) > 120 THEN 'too_long' WHEN regexp_matches(c, '[^\\x00-\\x7F]') THEN 'non_ascii' WHEN "
    + "(" + " OR ".join(f"contains(c, '{m}')" for m in synonyms.TRADE_MARKS) + ")"
    + f" THEN 'trade_name' WHEN {_holds_sql('c', synonyms.MIXTURE_TERMS)} THEN 'mixture_term' WHEN {_holds_sql('c', synonyms.GENERIC_TERMS)} THEN 'generic_term' "
    "WHEN len(c) <= 10 AND NOT (len(c) >= 2 AND regexp_full_match(c, '[a-zA-Z0-9\\-.'']+')) THEN 'invalid_abbreviation' END"
)


@query(
    f"WITH a AS (SELECT doc_id, i, {_CLEAN} AS c FROM ({LINES_SQL})), b AS (SELECT doc_id, i, c, {_REASON} AS r FROM a), "
    "n AS (SELECT doc_id, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY doc_id, lower(c), r IS NULL ORDER BY i) > 1 THEN 'duplicate' ELSE r END AS reason FROM b) "
    "SELECT doc_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1, 2"
)
def filter_reasons(spark, sf_dir):
    judged = synonyms.judge_synonyms(_lines(spark, sf_dir), "line", "doc_id", "i")
    return judged.groupBy("doc_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def _strip_sql(x):
    for q in sorted(qualifiers.QUALIFIERS, key=len, reverse=True):
        x = f"regexp_replace({x}, '\\b{q}\\b', '', 'gi')"
    for a, b in ((r"\(\s*\)|\[\s*\]", ""), (r"^\s*,\s*", ""), (r"\s+", " "), (r"\s+,", ","), (r"^[\s,]+|[\s,]+$", "")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_QUALIFIED = "p_name || CASE p_size % 5 WHEN 0 THEN ' (Total Recoverable)' WHEN 1 THEN ', Dissolved' WHEN 2 THEN ' hexavalent' WHEN 3 THEN ' as N' ELSE '' END"


@query(
    f"SELECT p_partkey, {_strip_sql('q')} AS clean, array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(q, '\\b{x}\\b', 'i') THEN '{x}' END" for x in qualifiers.QUALIFIERS)
    + f"], lambda z: z IS NOT NULL), ',') AS found FROM (SELECT p_partkey, {_QUALIFIED} AS q FROM part)"
)
def qualifier_strip(spark, sf_dir):
    k = F.col("p_size") % 5
    tail = F.when(k == 0, " (Total Recoverable)").when(k == 1, ", Dissolved").when(k == 2, " hexavalent").when(k == 3, " as N").otherwise("")
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("q"))
    return df.select("p_partkey", qualifiers.strip_qualifiers(F.col("q"))["clean"].alias("clean"), F.concat_ws(",", qualifiers.found_qualifiers(F.col("q"))).alias("found"))


_FRACTIONS = "CASE p_size % 8 WHEN 0 THEN 'PHC F2' WHEN 1 THEN 'Petroleum Hydrocarbons Fraction 3' WHEN 2 THEN 'C6-C10' WHEN 3 THEN 'C10 to C17' WHEN 4 THEN '> C35' WHEN 5 THEN 'F4 gravimetric' WHEN 6 THEN 'C20-C28' ELSE p_name END"


@query(
    f"SELECT p_partkey, f AS fraction, coalesce('phc ' || lower(f), x) AS notation, x AS given FROM (SELECT p_partkey, {_FRACTIONS} AS x, "
    "CASE p_size % 8 WHEN 0 THEN 'F2' WHEN 1 THEN 'F3' WHEN 2 THEN 'F1' WHEN 3 THEN 'F2' WHEN 4 THEN 'F4' WHEN 5 THEN 'F4' END AS f FROM part)"
)
def carbon_fraction(spark, sf_dir):
    forms = ["PHC F2", "Petroleum Hydrocarbons Fraction 3", "C6-C10", "C10 to C17", "> C35", "F4 gravimetric", "C20-C28"]
    text = reduce(lambda c, kv: c.when(F.col("p_size") % 8 == kv[0], kv[1]), enumerate(forms), F.when(F.lit(False), "")).otherwise(F.col("p_name"))
    df = table(spark, sf_dir, "part").select("p_partkey", text.alias("given"))
    return df.select("p_partkey", "given", qualifiers.fraction(F.col("given")).alias("fraction"), qualifiers.fraction_notation(F.col("given")).alias("notation"))


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Soil' WHEN 1 THEN 'Water' WHEN 2 THEN 'Water' ELSE '' END AS medium, "
    "CASE p_size % 3 WHEN 0 THEN '<' WHEN 1 THEN '>' END AS qualifier, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size + 0.5 END::DOUBLE AS number FROM part"
)
def unit_medium(spark, sf_dir):
    k = F.col("p_size") % 4
    units = F.when(k == 0, "ug/g dry").when(k == 1, "mg/L").when(k == 2, "Ug/L").otherwise("%")
    mark = F.when(F.col("p_size") % 3 == 0, "<").when(F.col("p_size") % 3 == 1, ">").otherwise("")
    cell = F.concat(mark, F.when(F.col("p_size") % 7 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"))))
    df = table(spark, sf_dir, "part").select("p_partkey", units.alias("units"), cell.alias("cell"))
    return df.select("p_partkey", qualifiers.medium_of_units(F.col("units")).alias("medium"), qualifiers.cell_qualifier(F.col("cell")).alias("qualifier"), qualifiers.cell_number(F.col("cell")).alias("number"))


@query(
    "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1,4-dioxane' WHEN 1 THEN 'petroleum hydrocarbons f2' WHEN 2 THEN 'phosphorus, total' ELSE '1,2,3-x' END AS written, p_size % 4 <> 3 AS short_form FROM part"
)
def regional_names(spark, sf_dir):
    k = F.col("p_size") % 4
    text = F.when(k == 0, "1,4 Diox").when(k == 1, "PHC  F2").when(k == 2, "Total P").otherwise("1, 2, 3-X")
    return table(spark, sf_dir, "part").select("p_partkey", qualifiers.regional(text).alias("written"), qualifiers.is_short_form(text).alias("short_form"))


_GRAMS = "list_distinct(list_transform(range(1, len({x})), lambda i: substr({x}, i::INT, 2)))"


@query(
    f"WITH {ANALYTES_SQL}, g AS (SELECT analyte_id, preferred_name, {_GRAMS.format(x='preferred_name')} AS g FROM analytes) SELECT a.analyte_id AS a, b.analyte_id AS b, "
    "round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 9) AS jaccard FROM g a JOIN g b ON a.preferred_name < b.preferred_name"
)
def bigram_jaccard(spark, sf_dir):
    g = analytes(spark, sf_dir).select("analyte_id", "preferred_name", bigrams(F.col("preferred_name")).alias("g"))
    a, b = g.alias("a"), g.alias("b")
    return a.join(b, F.col("a.preferred_name") < F.col("b.preferred_name")).select(F.col("a.analyte_id").alias("a"), F.col("b.analyte_id").alias("b"), F.round(jaccard(F.col("a.g"), F.col("b.g")), 9).alias("jaccard"))


@query(f"WITH {ANALYTES_SQL} SELECT a.analyte_id AS a, b.analyte_id AS b, round({ratio_sql('a.preferred_name', 'b.preferred_name')}, 9) AS ratio, true AS agree FROM analytes a JOIN analytes b ON a.preferred_name < b.preferred_name")
def indel_ratio_pairs(spark, sf_dir):
    """Every pair of registry names, by the expression; ``agree`` says that the Arrow form gives the same."""
    left = analytes(spark, sf_dir).select(F.col("analyte_id").alias("a"), F.col("preferred_name").alias("x"))
    right = analytes(spark, sf_dir).select(F.col("analyte_id").alias("b"), F.col("preferred_name").alias("y"))
    x, y = F.col("x"), F.col("y")
    pairs = left.join(right, x < y).select("a", "b", indel_ratio(x, y).alias("r"), indel_ratio_arrow(x, y).alias("s"))
    return pairs.select("a", "b", F.round("r", 9).alias("ratio"), (F.col("r") == F.col("s")).alias("agree"))


@query(
    "SELECT c_custkey, c_mktsegment || ' (SEG_' || c_nationkey || ')' AS given, 'SEG_' || c_nationkey AS id, round(c_nationkey / 100.0, 6)::DOUBLE AS share, c_custkey AS submission, "
    "CASE WHEN c_nationkey % 3 = 0 THEN 1.0 WHEN c_nationkey % 3 = 1 THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence FROM customer"
)
def field_parsers(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_nationkey")
    df = c.select("c_custkey", F.concat("c_mktsegment", F.lit(" (SEG_"), k, F.lit(")")).alias("given"), F.concat(k, F.lit("%")).alias("pct"), F.concat(F.lit("validation_"), "c_custkey", F.lit("_x.csv")).alias("file"), F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "low").alias("label"))
    return df.select("c_custkey", "given", names.identifier_in_brackets(F.col("given")).alias("id"), F.round(names.percent(F.col("pct")), 6).alias("share"), names.submission_in_filename(F.col("file")).alias("submission"), names.confidence_of_label(F.col("label")).alias("confidence"))


@query("SELECT a.r_name AS region, n_name AS nation, (contains(lower(n_name), lower(r_name)) OR contains(lower(r_name), lower(n_name))) AS either_way FROM region a, nation")
def containment_match(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    both = reduce(DataFrame.unionByName, (n.join(block, F.lit(True)) for block in matching.in_blocks(table(spark, sf_dir, "region"), "r_name")))
    return both.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), names.contains_either_way(F.col("r_name"), F.col("n_name")).alias("either_way"))
