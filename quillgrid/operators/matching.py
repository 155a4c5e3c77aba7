"""Match cascade: vendor cache, registry number, exact form, similarity join, vectors, decision gate.

Inputs are resolved as distinct (text, vendor) pairs and joined back, so a
name that occurs a million times is matched once. Later phases see only what
earlier ones left open (an anti join on the residue), and candidates of all
phases are united, ranked by windows and gated by one CASE chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.functions import names, registry_numbers
from quillgrid.functions.similarity import KINDS, bag_bound, indel_ratio_arrow, letter_counts, unit
from quillgrid.operators import signatures, vector_index
from quillgrid.storage import materialise

#: Phases in the order in which equal confidences rank.
VENDOR, EXACT, FUZZY, SEMANTIC, LOOKUP = 0, 1, 2, 3, 4
CANDIDATES = ("input_id", "analyte_id", "confidence", "method", "score", "phase", "rank")
#: Rows of the corpus side of the similarity join that may be broadcast; above that names meet on signatures.
CORPUS_ROWS = 200_000
#: Rows of a query set that are broadcast at a time.
QUERY_ROWS = 20_000


def input_id(text: Column, vendor: Column) -> Column:
    """128 bits of a text and its vendor, null or not: the length in front tells where the text ends."""
    told = F.concat(F.length(text), F.lit(":"), text, F.coalesce(F.concat(F.lit("="), vendor), F.lit("")))
    return F.md5(F.coalesce(told, F.concat(F.lit("null"), F.coalesce(F.concat(F.lit("="), vendor), F.lit("")))))


def distinct_inputs(df: DataFrame, text: str = "input_text", vendor: str | None = None) -> DataFrame:
    """(input_id, input_text, vendor, norm, number): one row per distinct text and vendor. The id is a digest of both."""
    v = F.col(vendor) if vendor else F.lit(None).cast("string")
    pairs = df.select(F.col(text).alias("input_text"), v.alias("vendor")).distinct()
    rows = pairs.select(input_id(F.col("input_text"), F.col("vendor")).alias("input_id"), "input_text", "vendor", registry_numbers.extract(F.col("input_text")).alias("number"))
    return names.with_normal_form(rows, "input_text", "norm").select("input_id", "input_text", "vendor", "norm", "number")


def _candidates(df: DataFrame, confidence, method, score, phase: int, rank=None) -> DataFrame:
    return df.select("input_id", "analyte_id", confidence.alias("confidence"), (F.lit(method) if isinstance(method, str) else method).alias("method"), score.alias("score"), F.lit(phase).alias("phase"), (F.lit(1) if rank is None else rank).alias("rank"))


def match_exact(inputs: DataFrame, synonyms: DataFrame, analytes: DataFrame) -> DataFrame:
    """Registry number first, else the normalised form; the lowest synonym_id wins. Two equi-joins."""
    by_number = inputs.filter("number IS NOT NULL").join(analytes.select("analyte_id", "cas_number"), F.col("number") == F.col("cas_number")).groupBy("input_id").agg(F.min("analyte_id").alias("analyte_id"))
    forms = synonyms.groupBy("synonym_norm").agg(F.min_by("analyte_id", "synonym_id").alias("analyte_id"))
    by_form = inputs.select("input_id", "norm").join(forms, F.col("norm") == F.col("synonym_norm")).select("input_id", "analyte_id")
    rest = by_form.join(by_number.select("input_id"), "input_id", "left_anti")
    one = F.lit(1.0)
    return _candidates(by_number, one, "cas_extracted", one, EXACT).unionByName(_candidates(rest, one, "exact", one, EXACT))


def synonyms_of(forms: DataFrame, synonyms: DataFrame, least: Column | float = 0.0) -> DataFrame:
    """``forms`` (synonym_norm, and what ``least`` needs) with every synonym of the form whose confidence is ``least`` or more; forms without one stay."""
    least = F.lit(least) if isinstance(least, float) else least
    held = synonyms.select(F.col("synonym_norm").alias("_norm"), "synonym_id", "analyte_id", "confidence")
    return forms.join(held, (F.col("synonym_norm") == F.col("_norm")) & (F.col("confidence") >= least), "left").drop("_norm")


def spread(df: DataFrame) -> int:
    """Partitions for work that is heavy a row: few rows would else share a task, since partitions are sized by bytes."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def match_fuzzy(inputs: DataFrame, synonyms: DataFrame, t: Thresholds = Thresholds(), threshold: float | None = None) -> DataFrame:
    """Top ``top_k`` synonyms by indel ratio, with a boost for the input's own vendor; ties by synonym_id.

    Two bounds that lose no pair come before the ratio: the ratio is at most
    2 * min(lengths) / sum of lengths, and at most what the bags of letters
    share. A small corpus is broadcast, since comparing all pairs by these
    bounds is then the cheapest; a large one is met on signatures.
    """
    least = (t.review if threshold is None else threshold)
    floor = least - t.vendor_boost
    corpus = synonyms.select("synonym_id", "analyte_id", "synonym_norm", F.col("lab_vendor").alias("s_vendor")).filter(F.length("synonym_norm") > 0)
    left = inputs.filter(F.length("norm") > 0).select("input_id", "norm", "vendor")
    if corpus.limit(CORPUS_ROWS + 1).count() <= CORPUS_ROWS:
        corpus = corpus.select("*", *(c.alias(f"s_{i}") for i, c in enumerate(letter_counts(F.col("synonym_norm")))))
        left = left.select("*", *(c.alias(f"i_{i}") for i, c in enumerate(letter_counts(F.col("norm"))))).repartition(spread(left))
        la, lb = F.length("norm"), F.length("synonym_norm")
        bags = ([F.col(f"{side}_{i}") for i in range(len(KINDS) + 1)] for side in "is")
        bound = (2.0 * F.least(la, lb) >= floor * (la + lb)) & (bag_bound(F.col("norm"), F.col("synonym_norm"), *bags) >= floor)
        pairs = left.join(F.broadcast(corpus), bound)
    else:
        pairs = signatures.candidates(left, corpus, "norm", "synonym_norm", floor)
    ratio = indel_ratio_arrow(F.col("norm"), F.col("synonym_norm"))
    boost = F.when(F.col("vendor") == F.col("s_vendor"), t.vendor_boost).otherwise(0.0)
    scored = pairs.select("input_id", "analyte_id", "synonym_id", ratio.alias("ratio"), boost.alias("boost")).withColumn("sim", F.least(F.col("ratio") + F.col("boost"), F.lit(1.0)))
    ranked = scored.filter(F.col("sim") >= least).withColumn("rank", F.row_number().over(Window.partitionBy("input_id").orderBy(F.desc("sim"), "synonym_id")))
    return _candidates(ranked.filter(F.col("rank") <= t.top_k), F.col("sim"), "fuzzy", F.col("sim"), FUZZY, F.col("rank"))


def in_blocks(queries: DataFrame, key: str, rows: int = QUERY_ROWS) -> list[DataFrame]:
    """A query set as broadcast blocks of about ``rows`` rows each, so that what it is held against is never shuffled."""
    blocks = max(1, -(-queries.count() // rows))
    return [F.broadcast(queries.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)) for b in range(blocks)]


def match_semantic(queries: DataFrame, vectors: DataFrame, threshold: float, k: int | None) -> DataFrame:
    """Top ``k`` vectors by cosine (equal to twelve digits: smallest id first), or with no ``k`` all, each of rank 1. ``queries``: (input_id, vector); ``vectors``: (vector_id, analyte_id, vector). All pairs of equal length are compared, in blocks of one plan; ``vector_index`` compares fewer."""
    left = materialise(queries.filter("vector IS NOT NULL").select("input_id", unit(F.col("vector")).alias("q"), F.size("vector").alias("cell")))
    right = vectors.filter("vector IS NOT NULL").select("vector_id", "analyte_id", unit(F.col("vector")).alias("vector"), F.size("vector").alias("cell"))
    scored = vector_index.products(left, right, threshold, k)
    ranked = scored.withColumn("rank", F.lit(1)) if k is None else vector_index.best(scored, k)
    confidence = F.least(F.greatest(F.col("sim"), F.lit(0.0)), F.lit(1.0))
    return _candidates(ranked, confidence, "semantic", F.col("sim"), SEMANTIC, F.col("rank"))


def decay(age_days: Column, t: Thresholds = Thresholds(), missing: Column | None = None) -> Column:
    """Factor of a confirmation's age: 1 when new, the floor from ``decay_days`` on; ``missing`` for no date."""
    factor = F.greatest(F.lit(t.decay_floor), 1.0 - t.decay_lambda * F.least(F.lit(1.0), age_days / t.decay_days))
    return F.coalesce(factor, F.lit(t.decay_floor) if missing is None else missing)


def vendor_cache(variants: DataFrame, confirmations: DataFrame, as_of: Column, t: Thresholds = Thresholds()) -> DataFrame:
    """(lab_vendor, observed_text, analyte_id, confidence, stale) of the variants that may be served.

    A variant serves if it has a match, is not cooling down after too many
    collisions, and its distinct valid confirmations outnumber collisions by
    ``min_confirmations``. The floor bounds the decay factor, not the product.
    """
    valid = confirmations.filter("valid_for_consensus").groupBy("variant_id").agg(F.countDistinct("submission_id").alias("confirmed"))
    rows = variants.join(valid, F.col("id") == F.col("variant_id"), "left")
    since = F.datediff(as_of, "last_collision_date")
    cooling = (F.coalesce("collision_count", F.lit(0)) > t.max_collisions) & F.coalesce(since < t.cooldown_days, F.lit(False))
    enough = F.coalesce("confirmed", F.lit(0)) - F.coalesce("collision_count", F.lit(0)) >= t.min_confirmations
    factor = decay(F.coalesce(F.datediff(as_of, "last_seen_date"), F.lit(0)), t)
    served = rows.filter(F.col("validated_match_id").isNotNull() & ~cooling & enough).withColumn("confidence", 0.95 * factor)
    return served.select("lab_vendor", "observed_text", F.col("validated_match_id").alias("analyte_id"), "confidence", ((factor < 1) & (F.col("confidence") < t.auto_accept)).alias("stale"))


def match_vendor(inputs: DataFrame, cache: DataFrame, analytes: DataFrame) -> DataFrame:
    hit = inputs.join(cache, (F.col("vendor") == F.col("lab_vendor")) & (F.col("norm") == F.col("observed_text"))).join(analytes.select("analyte_id"), "analyte_id", "left_semi")
    return _candidates(hit, F.col("confidence"), "vendor_cache", F.col("confidence"), VENDOR)


def match_lookup(inputs: DataFrame, cache: DataFrame, analytes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Cached outside lookups: (key, numbers array) where the first number that the registry knows decides."""
    listed = inputs.join(cache, F.lower(F.trim("input_text")) == F.col("key")).select("input_id", F.posexplode("numbers").alias("pos", "number_"))
    by_number = listed.join(analytes.select("analyte_id", "cas_number"), F.col("number_") == F.col("cas_number")).select("input_id", "pos", F.lit(0).alias("via"), "analyte_id")
    by_synonym = listed.join(synonyms.select("analyte_id", "synonym_raw"), F.col("number_") == F.col("synonym_raw")).select("input_id", "pos", F.lit(1).alias("via"), "analyte_id")
    best = by_number.unionByName(by_synonym).groupBy("input_id").agg(F.min_by("analyte_id", F.struct("pos", "via", "analyte_id")).alias("analyte_id"))
    return _candidates(best, F.lit(1.0), "api", F.lit(1.0), LOOKUP)


def decide(inputs: DataFrame, candidates: DataFrame, analytes: DataFrame, t: Thresholds = Thresholds(), threshold: float | None = None) -> DataFrame:
    """Best match, candidates, margin, disagreement and band for every input.

    The best is chosen by phase: exact over vendor; a fuzzy hit only where
    nothing stands; vectors and lookups where they are strictly better.
    """
    least = t.review if threshold is None else threshold
    known = candidates.join(analytes.select("analyte_id", "preferred_name"), "analyte_id")
    # An input has at most 2 * top_k + 3 candidates: one list holds them, and one shuffle brings them together.
    lists = known.groupBy("input_id").agg(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "phase", "rank", "confidence", "analyte_id", "preferred_name", "method", "score")).alias("a"))
    rows = inputs.select("input_id", "input_text", "vendor", "number").join(lists, "input_id", "left")
    rows = rows.withColumn("a", F.sort_array(F.coalesce("a", F.array().cast(lists.schema["a"].dataType))))
    of_phase = lambda p: F.get(F.filter("a", lambda x: (x["phase"] == p) & (x["rank"] == 1)), F.lit(0))
    rows = rows.withColumns({n: of_phase(p) for p, n in ((VENDOR, "v"), (EXACT, "e"), (FUZZY, "f"), (SEMANTIC, "s"), (LOOKUP, "l"))})
    # Fuzzy ranks one and two on different analytes with scores that close: the match is in doubt.
    rows = rows.withColumn("f2", F.get(F.filter("a", lambda x: (x["phase"] == FUZZY) & (x["rank"] == 2)), F.lit(0)))
    better = lambda a, b: F.when(a.isNull() | (b["confidence"] > a["confidence"]), b).otherwise(a)
    best = F.coalesce("e", "v", "f")
    best = F.when(F.col("s").isNotNull(), better(best, F.col("s"))).otherwise(best)
    best = F.when(F.col("l").isNotNull(), better(best, F.col("l"))).otherwise(best)
    # The list is sorted, so the first entry of each analyte is its best.
    good = F.filter("a", lambda x: x["confidence"] >= least)
    unique = F.filter(good, lambda x, i: F.array_position(F.transform(good, lambda y: y["analyte_id"]), x["analyte_id"]) == i + 1)
    rows = rows.withColumn("u", unique).withColumn("u5", F.slice("u", 1, 5))
    first_by = lambda method: F.get(F.filter("u5", lambda x: x["method"] == method), F.lit(0))
    rows = rows.withColumns({
        "n": F.size("u"), "c1": F.get("u", F.lit(0))["confidence"], "c2": F.get("u", F.lit(1))["confidence"], "uf": first_by("fuzzy"), "us": first_by("semantic"),
        "candidates": F.transform("u5", lambda x: F.struct(*(x[c].alias(c) for c in ("analyte_id", "preferred_name", "confidence", "method", "score")))),
    })
    disagreement = F.coalesce((F.col("f")["analyte_id"] != F.col("f2")["analyte_id"]) & (F.col("f")["score"] - F.col("f2")["score"] < t.margin), F.lit(False))
    conflict = F.coalesce((F.col("uf")["analyte_id"] != F.col("us")["analyte_id"]) & (F.col("uf")["confidence"] > 0.75) & (F.col("us")["confidence"] > 0.75), F.lit(False))
    rows = rows.withColumn("b", best).withColumn("disagreement", disagreement).withColumn("conflict", conflict)
    capped = F.when(F.col("disagreement") | F.col("conflict"), F.least(F.col("b")["confidence"], F.lit(t.disagreement_cap))).otherwise(F.col("b")["confidence"])
    margin = F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).when(F.col("n") == 1, 1.0).otherwise(F.col("c1") - F.col("c2"))
    rows = rows.withColumn("conf", capped).withColumn("margin", margin)
    band = (
        F.when(F.col("b").isNull(), F.when(F.coalesce("n", F.lit(0)) > 0, "NOVEL_COMPOUND").otherwise("UNKNOWN"))
        .when(F.col("conf") < t.ood, "NOVEL_COMPOUND")
        .when((F.col("conf") >= t.auto_accept) & (F.col("margin") >= t.margin) & ~F.col("conflict"), "AUTO_ACCEPT")
        .when(F.col("conf") >= t.review, "REVIEW")
        .otherwise("UNKNOWN")
    )
    rows = rows.withColumn("band", band)
    held = F.col("band").isin("AUTO_ACCEPT", "REVIEW")
    match = lambda c: F.when(held, c)
    return rows.select(
        "input_id", "input_text", "vendor", match(F.col("b")["analyte_id"]).alias("analyte_id"), match(F.col("b")["preferred_name"]).alias("preferred_name"),
        match(F.col("conf")).alias("confidence"), match(F.col("b")["method"]).alias("method"), "candidates",
        F.struct(
            F.col("number").alias("cas_extracted"), F.col("e").isNotNull().alias("exact_match"), F.col("f")["score"].alias("fuzzy_match"), F.col("s")["score"].alias("semantic_match"),
            F.col("v").isNotNull().alias("vendor_cache"), F.col("conflict").alias("cross_method_conflict"),
        ).alias("signals"),
        "disagreement", "margin", "band",
    )


def resolve(
    inputs: DataFrame, analytes: DataFrame, synonyms: DataFrame, cache: DataFrame | None = None, lookup: DataFrame | None = None,
    query_vectors: DataFrame | None = None, vectors: DataFrame | None = None, t: Thresholds = Thresholds(), threshold: float | None = None, hold=None,
) -> DataFrame:
    """The whole cascade over ``distinct_inputs`` rows.

    Every phase reads the inputs, and vectors and lookups need what the
    similarity join has found, to leave it out, and again among the candidates;
    ``hold`` keeps both from being computed more than once. By default they
    are written to the shared folder.
    """
    least = t.review if threshold is None else threshold
    hold = hold or materialise
    inputs = hold(inputs)
    found = match_exact(inputs, synonyms, analytes)
    if cache is not None:
        found = found.unionByName(match_vendor(inputs, cache, analytes))

    def open_after(so_far: DataFrame) -> DataFrame:
        done = so_far.groupBy("input_id").agg(F.coalesce(F.max(F.when(F.col("phase") == EXACT, F.col("confidence"))), F.max("confidence")).alias("c")).filter(F.col("c") >= t.auto_accept)
        return inputs.join(done.select("input_id"), "input_id", "left_anti")

    found = found.unionByName(match_fuzzy(open_after(found), synonyms, t, least))
    found = hold(found)
    if query_vectors is not None and vectors is not None:
        found = found.unionByName(match_semantic(query_vectors.join(open_after(found).select("input_id"), "input_id", "left_semi"), vectors, least, t.top_k))
        # Lookups read what vectors have found, and the decision reads it again.
        found = hold(found) if lookup is not None else found
    if lookup is not None:
        found = found.unionByName(match_lookup(open_after(found), lookup, analytes, synonyms))
    return decide(inputs, found, analytes, t, least)


def resolve_batch(df: DataFrame, text: str, vendor: str | None, **how) -> DataFrame:
    """``df`` with the result of its text: distinct inputs are resolved once and joined back."""
    done = resolve(distinct_inputs(df, text, vendor), **how).drop("input_id")
    same = df[text].eqNullSafe(done["input_text"]) & (df[vendor].eqNullSafe(done["vendor"]) if vendor else F.lit(True))
    return df.join(done, same, "left").drop(done["vendor"]).drop(done["input_text"])


def band(confidence: Column, cuts: tuple[tuple[float, str], ...], below: str) -> Column:
    """Name of the first cut that the confidence reaches."""
    out = F.when(F.lit(False), "")
    for least, name in cuts:
        out = out.when(confidence >= least, name)
    return out.otherwise(below)


QUALITY_BANDS = ((0.95, "HIGH"), (0.85, "MEDIUM"), (0.75, "LOW"))
EXPORT_BANDS = ((0.95, "HIGH"), (0.75, "MEDIUM"), (1e-12, "LOW"))
INGEST_BANDS = ((0.95, "HIGH"), (0.70, "MEDIUM"))


def nearest_analyte(queries: DataFrame, analytes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query, analyte_id, score): exact name 1.0, exact synonym 1.0, else the first name that contains the text 0.8."""
    names_ = analytes.select("analyte_id", F.lower("preferred_name").alias("n"))
    q = queries.select("query", F.lower("query").alias("k"))
    hits = (
        q.join(names_, F.col("k") == F.col("n")).select("query", "analyte_id", F.lit(0).alias("way"))
        .unionByName(q.join(synonyms.select("analyte_id", F.lower("synonym_raw").alias("n")), F.col("k") == F.col("n")).select("query", "analyte_id", F.lit(1).alias("way")))
        .unionByName(reduce(DataFrame.unionByName, (names_.join(block, F.col("n").contains(F.col("k"))) for block in in_blocks(q, "query"))).select("query", "analyte_id", F.lit(2).alias("way")))
    )
    best = hits.groupBy("query").agg(F.min(F.struct("way", "analyte_id")).alias("b"))
    return q.select("query").join(best, "query", "left").select("query", F.col("b")["analyte_id"].alias("analyte_id"), F.when(F.col("b").isNull(), 0.0).when(F.col("b")["way"] == 2, 0.8).otherwise(1.0).alias("score"))
