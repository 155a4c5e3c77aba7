"""Learning from decisions: gates, consensus and collisions, calibration, maturity, retraining, clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid.config import Thresholds
from quillgrid.functions.similarity import KINDS, bag_bound, indel_ratio_arrow, lcs_length, letter_counts
from quillgrid.operators import signatures
from quillgrid.operators.prefix_sums import running_sums
from quillgrid.storage import materialise, release


def dual_gate(rows: DataFrame, existing: DataFrame, t: Thresholds = Thresholds(), before: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` to rows of (id, analyte_id, norm, confirmed, margin, ts).

    Tried in order: not confirmed by the cascade, margin too small, the day's
    cap reached, already known. Only rows that pass the first two count
    towards the cap, in order of time and id. ``before`` (day, n) is what
    days have taken earlier.
    """
    known = existing.select("analyte_id", "norm").distinct().withColumn("known", F.lit(True))
    judged = rows.withColumn("outcome", F.when(~F.coalesce("confirmed", F.lit(False)), "not_confirmed").when(~F.coalesce(F.col("margin") >= t.dual_gate_margin, F.lit(False)), "small_margin"))
    judged = judged.join(known, ["analyte_id", "norm"], "left")
    open_ = F.col("outcome").isNull()
    first = F.row_number().over(Window.partitionBy("analyte_id", "norm", open_).orderBy("ts", "id")) == 1
    judged = judged.withColumn("fresh", open_ & F.col("known").isNull() & first).withColumn("_day", F.to_date("ts"))
    # Of a day's fresh rows only the first ``daily_cap`` are brought together; what comes after the last of them meets a full day.
    place = F.struct("ts", "id")
    taken = judged.filter("fresh").select("_day", place.alias("place")).withColumn("nth", F.row_number().over(Window.partitionBy("_day").orderBy("place"))).filter(F.col("nth") <= t.daily_cap)
    earlier = before.select(F.col("day").alias("_day"), F.col("n").alias("earlier")) if before is not None else None
    if earlier is not None:
        taken = taken.join(earlier, "_day", "left").filter(F.col("nth") <= t.daily_cap - F.coalesce("earlier", F.lit(0)))
    spent = F.count("*") + (F.coalesce(F.first("earlier"), F.lit(0)) if earlier is not None else F.lit(0))
    last = taken.groupBy("_day").agg(F.when(spent >= t.daily_cap, F.max("place")).alias("_last")).withColumnRenamed("_day", "_d")
    judged = judged.join(last, F.col("_day").eqNullSafe(F.col("_d")), "left")
    full = F.coalesce(place > F.col("_last"), F.lit(False)) | F.lit(t.daily_cap <= 0)
    if earlier is not None:
        judged = judged.join(earlier, "_day", "left")
        full |= F.coalesce(F.col("earlier") >= t.daily_cap, F.lit(False))
    outcome = F.coalesce("outcome", F.when(full, "daily_cap").when(~F.col("fresh"), "duplicate").otherwise("ingested"))
    return judged.select(*rows.columns, outcome.alias("outcome"))


def collisions(confirmations: DataFrame, key: list[str], value: str, order: list[str]) -> DataFrame:
    """Collisions of each variant: confirmations that name another analyte than the one before."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(False))
    marked = confirmations.withColumn("_changed", changed)
    return marked.groupBy(*key).agg(
        F.count("*").alias("confirmations"), F.sum(F.col("_changed").cast("long")).alias("collision_count"),
        F.max(F.when(F.col("_changed"), F.col(order[0]))).alias("last_collision"), F.max_by(value, F.struct(*order)).alias("validated"),
    )


def stability(collision_count: Column, since_days: Column, t: Thresholds = Thresholds()) -> Column:
    """STABLE, COLLIDED, UNSTABLE (too many, still cooling down) or RECOVERED."""
    return (
        F.when(F.coalesce(collision_count, F.lit(0)) == 0, "STABLE").when(collision_count <= t.max_collisions, "COLLIDED")
        .when(F.coalesce(since_days < t.cooldown_days, F.lit(False)), "UNSTABLE").otherwise("RECOVERED")
    )


def precision_threshold(scored: DataFrame, score: str, correct: Column, target: float = 0.95, at_least: int = 10, default: float = 0.95) -> DataFrame:
    """One row: the first confidence, going down, at which precision over ``at_least`` rows or more reaches ``target``.

    Rows are summed by score first, and scores, which may be as many as rows,
    by ranges: no task sees them all.
    """
    cells = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("cell_n"), F.sum(correct.cast("long")).alias("cell_ok"))
    run = running_sums(cells, F.desc("s"), {"cell_n": "n", "cell_ok": "ok"})
    return run.filter((F.col("n") >= at_least) & (F.col("ok") / F.col("n") >= target)).agg(F.coalesce(F.max("s"), F.lit(default)).alias("threshold"))


def f1_threshold(scored: DataFrame, score: str, correct: Column, least: float = 0.90, default: float = 0.75) -> DataFrame:
    """One row: the score of best F1 with precision and recall of ``least`` or more; the higher score on ties."""
    cells = scored.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("cell_n"), F.sum(correct.cast("long")).alias("cell_ok"))
    run = running_sums(cells, F.desc("s"), {"cell_n": "n", "cell_ok": "ok"}, {"cell_ok": "all_ok"})
    p, r = F.col("ok") / F.col("n"), F.try_divide("ok", "all_ok")
    good = run.select("s", p.alias("p"), r.alias("r"), F.try_divide(2 * p * r, p + r).alias("f1")).filter((F.col("p") >= least) & (F.col("r") >= least))
    return good.agg(F.max(F.struct("f1", "s")).alias("b")).select(F.coalesce(F.col("b")["s"], F.lit(default)).alias("threshold"), F.col("b")["f1"].alias("f1"))


def decision_stats(decisions: DataFrame) -> DataFrame:
    """One pass over decisions: totals, rates and the share of each confidence bin."""
    c = F.col("confidence_score")
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    bins = [(0.95, 9.0, "bin_95"), (0.90, 0.95, "bin_90"), (0.85, 0.90, "bin_85"), (0.75, 0.85, "bin_75"), (0.50, 0.75, "bin_50"), (-9.0, 0.50, "bin_low")]
    return decisions.agg(
        F.count("*").alias("total"), share(F.col("human_validated")).alias("validation_rate"), share(F.col("disagreement_flag")).alias("disagreement_rate"),
        share(F.col("ingested")).alias("ingestion_rate"), F.avg(c).alias("mean_confidence"), F.stddev_samp(c).alias("sd_confidence"),
        F.datediff(F.max("decision_timestamp"), F.min("decision_timestamp")).alias("period_days"),
        *(F.count(F.when((c >= lo) & (c < hi), 1)).alias(name) for lo, hi, name in bins),
    )


def weekly_counts(events: DataFrame, ts: str, as_of: Column, weeks: int = 12) -> DataFrame:
    """(week, n) for weeks back from ``as_of``, empty ones as 0."""
    back = F.floor((as_of.cast("timestamp").cast("long") - F.col(ts).cast("timestamp").cast("long")) / (7 * 86400))
    counted = events.groupBy(back.alias("week")).agg(F.count("*").alias("n"))
    return events.sparkSession.range(weeks).select(F.col("id").alias("week")).join(counted, "week", "left").select("week", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def plateau(weekly: DataFrame, points: int = 4, least_slope: float = 0.01, constant_is_plateau: bool = False) -> DataFrame:
    """One row: the slope over the last ``points`` weeks in order of time, and whether it is a plateau. A constant series has no correlation and is no plateau unless asked for."""
    last = weekly.filter(F.col("week") < points)
    got = last.agg(F.regr_slope(F.col("n").cast("double"), -F.col("week").cast("double")).alias("slope"), F.stddev_pop("n").alias("sd"), F.count("*").alias("k"))
    return got.select(F.coalesce("slope", F.lit(0.0)).alias("slope"), F.when((F.col("k") < points) | F.col("sd").isNull(), False).when(F.col("sd") == 0, constant_is_plateau).otherwise(F.abs("slope") < least_slope).alias("plateau"))


def rate_plateau(is_unknown: Column, age_days: Column, least: float = 0.02) -> Column:
    """Aggregate: whether the share of unknowns of the last 30 days is not ``least`` below that of 60 to 89 days ago; false without rows in either span."""
    share = lambda held: F.avg(F.when(held, is_unknown.cast("double")))
    return F.coalesce(share(age_days.between(60, 89)) - share(age_days < 30) < least, F.lit(False))


def maturity_score(exact_share: Column, unknown_share: Column, synonyms_per_analyte: Column) -> Column:
    """Of 100: half exact matches, three tenths known ones, two tenths breadth of synonyms."""
    return F.least(F.lit(100.0), 0.5 * 100 * exact_share + 0.3 * 100 * (1 - unknown_share) + 0.2 * F.least(10 * synonyms_per_analyte, F.lit(100.0)))


def retraining(triggers: dict[str, Column], rows: DataFrame, need: int = 2) -> DataFrame:
    """One row: every trigger, how many fired, and RECOMMENDED, CONSIDER or NOT_NEEDED."""
    got = rows.select(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in triggers.items()))
    fired = sum((F.col(k).cast("int") for k in triggers), F.lit(0))
    return got.withColumn("fired", fired).withColumn("advice", F.when(F.col("fired") >= need, "RECOMMENDED").when(F.col("fired") >= 1, "CONSIDER").otherwise("NOT_NEEDED"))


def similarity_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) of distinct texts with a bigram Jaccard of ``least`` or more, a before b.

    Texts meet on shared bigrams of the prefix that similarity cannot avoid:
    in order of rarity, a text's first n - ceil(least * n) + 1 bigrams. No
    pair that reaches ``least`` is missed, and none is compared otherwise.
    """
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - 1, F.lit(1))), lambda i: F.substring("t", i, F.lit(2))))
    base = texts.select(F.col(texts.columns[0]).alias("t")).filter(F.length("t") >= 2).distinct().withColumn("g", grams)
    rarity = base.select(F.explode("g").alias("x")).groupBy("x").agg(F.count("*").alias("df"))
    ranked = base.select("t", F.size("g").alias("n"), F.explode("g").alias("x")).join(rarity, "x").withColumn("k", F.row_number().over(Window.partitionBy("t").orderBy("df", "x")))
    prefix = ranked.filter(F.col("k") <= F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).select("t", "x")
    met = prefix.alias("p").join(prefix.alias("q"), (F.col("p.x") == F.col("q.x")) & (F.col("p.t") < F.col("q.t"))).select(F.col("p.t").alias("a"), F.col("q.t").alias("b")).distinct()
    both = met.join(base.select(F.col("t").alias("a"), F.col("g").alias("ga")), "a").join(base.select(F.col("t").alias("b"), F.col("g").alias("gb")), "b")
    sim = F.size(F.array_intersect("ga", "gb")) / F.size(F.array_union("ga", "gb"))
    return both.select("a", "b", sim.alias("sim")).filter(F.col("sim") >= least)


def greedy_clusters(rows: DataFrame, block: str, order: str, text: str, least: float) -> DataFrame:
    """Add ``anchor``: in order, a text that has none becomes the anchor of all later ones within reach.

    The outcome depends on the order, so each block is worked through by one
    task; blocks have to be bounded by the caller (a vendor, a first letter).
    """
    schema = rows.schema.simpleString()[len("struct<") : -1] + ", anchor:string"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, text], kind="stable")
        names = pdf[text].tolist()
        anchor: list[str | None] = [None] * len(names)
        for i, a in enumerate(names):
            if anchor[i] is None:
                anchor[i] = a
                for j in range(i + 1, len(names)):
                    if anchor[j] is None and a and names[j] and 2 * lcs_length(a, names[j]) >= least * (len(a) + len(names[j])):
                        anchor[j] = a
        return pdf.assign(anchor=anchor)

    return rows.groupBy(block).applyInPandas(work, schema)


#: Rows that may be broadcast in ``indel_pairs``, and open pairs that the driver may put in order.
CORPUS_ROWS, DRIVER_PAIRS = 50_000, 100_000


def indel_pairs(keys: DataFrame, least: float) -> DataFrame:
    """(a, b) of structs ``key`` with a text t, a before b, with an indel ratio of ``least`` > 0 or more.

    The bounds of lengths and of bags of letters come first. They give way by
    1e-9, so that rounding loses no pair.
    """
    full = keys.filter(F.length(F.col("key")["t"]) > 0)
    a, b = F.col("a")["t"], F.col("b")["t"]
    if full.limit(CORPUS_ROWS + 1).count() > CORPUS_ROWS:
        sides = (full.select(F.col("key").alias(n), F.col("key")["t"].alias(f"{n}_t")) for n in "ab")
        met = signatures.candidates(*sides, "a_t", "b_t", least, F.col("a") < F.col("b"))
    else:
        floor = least - 1e-9
        left, right = (full.select(F.col("key").alias(n), *(c.alias(f"{n}_{i}") for i, c in enumerate(letter_counts(F.col("key")["t"])))) for n in "ab")
        la, lb = F.length(a), F.length(b)
        bags = ([F.col(f"{n}_{i}") for i in range(len(KINDS) + 1)] for n in "ab")
        met = left.join(F.broadcast(right), (F.col("a") < F.col("b")) & (2.0 * F.least(la, lb) >= floor * (la + lb)) & (bag_bound(a, b, *bags) >= floor))
    return met.filter(indel_ratio_arrow(a, b) >= least).select("a", "b")


def greedy_members(pairs: DataFrame, few: int = DRIVER_PAIRS) -> DataFrame:
    """(b) of all that the sequential order gives to an anchor before them, from all pairs (a, b), a before b.

    In rounds: what no open pair reaches is an anchor, what it reaches is a
    member, and pairs with a decided end are closed. The driver finishes once
    ``few`` pairs are open.
    """
    open_, done = pairs, []
    while open_.limit(few + 1).count() > few:
        heads = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        # Written, not cached: a round's plan would else hold those of all rounds before it, twice over each time.
        reached = materialise(open_.join(heads, "a", "left_semi").select("b").distinct())
        done.append(reached)
        left = materialise(open_.join(reached, "b", "left_anti").join(reached.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
        if open_ is not pairs:
            release(open_)
        open_ = left
    members = set()
    for a, b in sorted(open_.collect()):
        if a not in members:
            members.add(b)
    last = pairs.sparkSession.createDataFrame([(b,) for b in members], pairs.select("b").schema)
    return reduce(DataFrame.unionByName, done, last)


def greedy_clusters_of_all(rows: DataFrame, order: str, text: str, least: float, few: int = DRIVER_PAIRS) -> DataFrame:
    """``greedy_clusters`` over all rows, without blocks: distinct texts meet in ``indel_pairs``, and the order runs over the pairs."""
    place = F.col(order)
    key = F.struct(F.min(place).isNull().alias("last"), F.coalesce(F.min(place), F.lit(0)).alias("k"), F.col("t"))
    keys = rows.select(place, F.col(text).alias("t")).groupBy("t").agg(key.alias("key")).select("key")
    pairs = materialise(indel_pairs(keys, least))
    members = greedy_members(pairs, few)
    # Whatever is no member is an anchor; a member goes to the first that reaches it.
    anchors = pairs.join(members.select(F.col("b").alias("a")), "a", "left_anti").groupBy("b").agg(F.min("a").alias("a"))
    found = anchors.select(F.col("b")["t"].alias("_t"), F.col("a")["t"].alias("_anchor"))
    return rows.join(found, F.col(text) == F.col("_t"), "left").select(*rows.columns, F.coalesce("_anchor", text).alias("anchor"))


def vector_clusters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body: mean and extreme pairwise cosine of clusters given as rows of (cluster, vectors)."""
    import numpy as np

    for pdf in batches:
        out = []
        for cluster, vectors in zip(pdf["cluster"], pdf["vectors"], strict=True):
            x = np.array([np.asarray(v, float) for v in vectors])
            x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
            s = (x @ x.T)[np.triu_indices(len(x), 1)]
            out.append((cluster, len(x), float(s.mean()) if len(s) else 1.0, float(s.min()) if len(s) else 1.0))
        yield pd.DataFrame(out, columns=["cluster", "n", "mean_sim", "min_sim"])
