"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

1. Sizes are summed by source; sources in code-point order (null last) weigh
   5, 2, 1, repeating. Targets share the total by weight, stop at three times
   the source's size, and what is cut off is shared again by weight.
2. Every document is taken ``floor(target / source size)`` times whole.
3. What remains of a target is filled by a Pareto sample (Rosen 1997) of fixed
   size, counted in words. A document's inclusion probability grows with the
   square root of its size, so that long documents carry less of the variance,
   and the probabilities are such that the expected words are those that
   remain; documents whose probability would pass 1 are certain, and the others
   share what these leave. Documents are ranked by random odds divided by
   inclusion odds, the certain ones first, and taken until their words come
   nearest to what remains. The random number is a hash of doc_id: reruns
   agree. The sums behind the probabilities are integers, so their order does
   not matter.

Probabilities depend on sizes only and are found from the number of documents
of each size. Ranking never sorts a whole source in one task: ranks are cut
into ``CELLS`` cells by their logarithm, which spreads documents over cells
whatever the probabilities are, cells are summed by source, and only the one
cell of each source in which its target is reached is sorted.

Null texts have size 0 and are taken 0 times; a null source is a source of
its own; a null doc_id draws the number of an empty id. Repeated rows are
rows like any other (equal ranks are told apart by doc_id and size, so which
of two identical rows is taken makes no difference). An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.llm.common import materialise

WEIGHTS = (5, 2, 1)
MOST = 3
CELLS = 65_536
#: Inclusion weights are square roots in steps of 1 / ROOT; cells cover logarithms of ranks from -SPAN to SPAN.
ROOT, SPAN = 1024, 32.0
SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column) -> Column:
    """Uniform in (0, 1) from 52 bits of the id's digest."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows of (source, size). One row a source, so the unpartitioned windows see sources, not documents."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    k = F.row_number().over(by_name) - 1
    weighed = total.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (k % len(WEIGHTS) + 1).cast("int")).cast("long"))
    # Sources reach their cap in the order of cap over weight; with the first of them capped, the rest share what is left by weight.
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    below = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy()
    onward = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    level = (F.sum("source_size").over(everywhere) - MOST * F.coalesce(F.sum("source_size").over(below), F.lit(0))) / onward
    shared = weighed.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= MOST * F.col("source_size"))
    # From the first source below its cap on levels never rise, so the first one's is the largest, also where sources tie.
    at_last = shared.withColumn("level", F.max(F.when(F.col("free"), F.col("level"))).over(everywhere))
    target = F.least(MOST * F.col("source_size").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.lit(0.0)))
    return at_last.select("source", "source_size", target.alias("target"))


def _weight(size: Column) -> Column:
    return F.round(F.sqrt(size.cast("double")) * ROOT).cast("decimal(38,0)")


def inclusion(sizes: DataFrame) -> DataFrame:
    """(source, most, share) from rows of (source, size, n, rest): documents above ``most`` are certain, the others have probability ``share`` times their weight.

    With k sizes certain, from the largest down, the rest of the words by the
    sum of weighed words of the other sizes is their share; k is the smallest
    for which no probability passes 1.
    """
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above, every = down.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source")
    words = F.col("n").cast("decimal(38,0)") * F.col("size")
    held = sizes.withColumn("words", words.cast("decimal(38,0)")).withColumn("weight", _weight(F.col("size"))).withColumn("weighed", (F.col("words") * F.col("weight")).cast("decimal(38,0)"))
    zero = F.lit(0).cast("decimal(38,0)")
    held = held.withColumn("share", (F.col("rest") - F.coalesce(F.sum("words").over(above), zero).cast("double")) / (F.sum("weighed").over(every) - F.coalesce(F.sum("weighed").over(above), zero)).cast("double"))
    fits = held.filter(F.col("share") * F.col("weight").cast("double") <= 1)
    return fits.groupBy("source").agg(F.max("size").alias("most"), F.max_by("share", "size").alias("share"))


def mix(sized: DataFrame) -> DataFrame:
    """Add source_size, target and taken to rows that have doc_id, source and size; taken / size is the number of whole copies.

    Other columns are passed on, whatever their names; those of this operator's
    three names are replaced. Names that start with ``__qg_`` are its own.
    """
    sized = sized.drop("source_size", "target", "taken")
    # Tables of one row a source are broadcast after a count of the sources; beyond the bound they are joined by shuffle.
    few = sized.select("source").distinct().limit(SOURCES + 1).count() <= SOURCES
    per_source = F.broadcast if few else lambda df: df
    whole = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = targets(sized).withColumn("__qg_copies", whole).withColumn("__qg_rest", F.col("target") - F.col("__qg_copies") * F.col("source_size"))
    goal = materialise(goal.withColumnRenamed("source", "__qg_source"))
    same = sized["source"].eqNullSafe(F.col("__qg_source"))
    counted = sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")).join(per_source(goal), F.col("source").eqNullSafe(F.col("__qg_source")))
    odds_of = inclusion(counted.select("source", "size", "n", F.col("__qg_rest").alias("rest")))
    odds_of = odds_of.select(F.col("source").alias("__qg_s"), F.col("most").alias("__qg_most"), F.col("share").alias("__qg_share"))
    goal = materialise(goal.join(per_source(odds_of), F.col("__qg_source").eqNullSafe(F.col("__qg_s")), "left").drop("__qg_s"))
    u = draw(F.col("doc_id"))
    p = F.col("__qg_share") * _weight(F.col("size")).cast("double")
    certain = (F.col("size") > F.col("__qg_most")) | (p >= 1)
    rank = F.when(certain, F.lit(0.0)).when(p <= 0, F.lit(1e300)).otherwise(u / (1 - u) / (p / (1 - p)))
    depth = F.floor((F.log(F.when(F.col("__qg_rank") > 0, F.col("__qg_rank"))) + SPAN) / (2 * SPAN) * CELLS)
    rows = (
        sized.join(per_source(goal), same, "inner")
        .withColumn("__qg_rank", F.when(F.col("size") > 0, rank))
        .withColumn("__qg_cell", F.when(F.col("__qg_rank") == 0, F.lit(-1)).otherwise(F.greatest(F.lit(0), F.least(depth, F.lit(CELLS - 1)))).cast("int"))
    )
    by_source = Window.partitionBy("__qg_source").orderBy("__qg_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.filter("size > 0").groupBy("__qg_source", "__qg_cell").agg(F.sum("size").alias("__qg_in"), F.first("__qg_rest").alias("__qg_need"))
        .withColumn("__qg_before", F.coalesce(F.sum("__qg_in").over(by_source), F.lit(0)))
    )
    # Cells wholly below the target are taken, cells wholly above it are not; one cell of a source is cut.
    cut = cells.filter("__qg_before <= __qg_need and __qg_before + __qg_in > __qg_need").select(F.col("__qg_source").alias("__qg_s"), F.col("__qg_cell").alias("__qg_cut"), "__qg_before")
    rows = rows.join(per_source(cut), rows["__qg_source"].eqNullSafe(F.col("__qg_s")), "left").drop("__qg_s")
    inside = Window.partitionBy("__qg_source").orderBy("__qg_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_cut = F.coalesce(F.col("__qg_cell") == F.col("__qg_cut"), F.lit(False))
    edge = rows.filter(is_cut).withColumn("__qg_more", F.col("__qg_before") + F.sum("size").over(inside) - F.col("size") / 2 <= F.col("__qg_rest"))
    rest = rows.filter(~is_cut).withColumn("__qg_more", F.coalesce((F.col("size") > 0) & F.when(F.col("__qg_cut").isNull(), F.col("__qg_rest") > 0).otherwise(F.col("__qg_cell") < F.col("__qg_cut")), F.lit(False)))
    out = edge.unionByName(rest).withColumn("taken", ((F.col("__qg_copies") + F.col("__qg_more").cast("long")) * F.col("size")).cast("long"))
    return out.drop(*(f"__qg_{x}" for x in ("source", "copies", "rest", "most", "share", "rank", "cell", "cut", "before", "more")))


def size_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size), written once: the mix reads it several times and never the texts again."""
    return materialise(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")))


#: What the query returns, in DuckDB's SQL.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY source_size / weight, source IS NULL, encode(source))
), goal AS (
  SELECT source, source_size, least(3 * source_size::DOUBLE,
    coalesce((SELECT max(level) FROM levels WHERE level * weight <= 3 * source_size) * weight, 0)) AS target
  FROM levels
), drawn AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS copies,
    (('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), shares AS (
  SELECT source, max(size) AS most, max_by(share, size) AS share FROM (
    SELECT source, size, weight, (rest - coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weighed) OVER (PARTITION BY source) - coalesce(sum(weighed) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS share
    FROM (SELECT source, size, rest, round(sqrt(size::DOUBLE) * 1024)::HUGEINT AS weight, count(*)::HUGEINT * size AS words, count(*)::HUGEINT * size * round(sqrt(size::DOUBLE) * 1024)::HUGEINT AS weighed
      FROM (SELECT *, target - copies * source_size AS rest FROM drawn) WHERE size > 0 GROUP BY source, size, rest)
    WINDOW w AS (PARTITION BY source ORDER BY size DESC)
  ) WHERE share * weight::DOUBLE <= 1 GROUP BY source
), odds AS (
  SELECT d.*, target - copies * source_size AS rest, most, share * round(sqrt(size::DOUBLE) * 1024) AS p
  FROM drawn d LEFT JOIN shares h ON d.source IS NOT DISTINCT FROM h.source
), ranked AS (
  SELECT *, CASE WHEN size > 0 THEN CASE WHEN size > most OR p >= 1 THEN 0.0 WHEN p <= 0 THEN 1e300 ELSE u / (1 - u) / (p / (1 - p)) END END AS pareto FROM odds
), filled AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY pareto, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM ranked WHERE size > 0
)
SELECT doc_id, size, source_size, target, CAST((copies + CASE WHEN rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM filled
UNION ALL
SELECT doc_id, size, source_size, target, CAST(0 AS BIGINT) FROM ranked WHERE size = 0
"""
