"""Stateful streams over the event log, against the batch forms' SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgrid.operators import rollups
from quillgrid.plans.learning_queries import DUAL_GATE_SQL, dual_gate_rows
from quillgrid.plans.registry import AS_OF, query, table
from quillgrid.storage import new_path
from quillgrid.streaming import inbox, machines

#: Files that the log is cut into, one a micro-batch.
BATCHES = 4


def _replay(log: DataFrame, path: str, at: str) -> DataFrame:
    """A table as a stream of ``BATCHES`` micro-batches in order of ``at``: a source takes files by age, so they are written one after the other."""
    spark = log.sparkSession
    seconds = F.col(at).cast("timestamp").cast("double")
    cuts = log.select(seconds.alias("s")).approxQuantile("s", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        log.filter((F.lit(low is None) | (seconds >= F.lit(low))) & (F.lit(high is None) | (seconds < F.lit(high)))).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "SELECT CAST(user_id AS VARCHAR) AS lab_vendor, event_type AS observed_text, collisions, confirmations, CASE WHEN collisions = 0 THEN 'STABLE' WHEN collisions <= 2 THEN 'COLLIDED' WHEN date_diff('day', last_collision::DATE, DATE '2024-02-01') < 7 THEN 'UNSTABLE' ELSE 'RECOVERED' END AS status FROM ("
    "SELECT user_id, event_type, count(*) AS confirmations, CAST(sum(ch::INT) AS BIGINT) AS collisions, max(CASE WHEN ch THEN ts END) AS last_collision FROM ("
    "SELECT *, coalesce(k <> lag(k) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), false) AS ch FROM (SELECT *, floor(value / 20) AS k FROM events)) GROUP BY 1, 2)"
)
def stream_vendor_machine(spark, sf_dir):
    """The batch form's states from a stream: a quarter of the log is the state to start from, the rest comes in micro-batches, and a last event on the first of February moves the watermark there."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("lab_vendor"), F.col("event_type").alias("observed_text"), F.floor(F.col("value") / 20).cast("string").alias("analyte_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))
    out, first = new_path(spark), F.col("ts") < F.lit("2024-01-08").cast("timestamp")
    from quillgrid.operators import learning

    seed = learning.collisions(e.filter(first), ["lab_vendor", "observed_text"], "analyte_id", ["ts", "id"])
    seed = seed.select("lab_vendor", "observed_text", F.col("validated").alias("analyte_id"), "confirmations", F.col("collision_count").alias("collisions"), "last_collision")
    beat = spark.range(1).select(F.lit(None).cast("string").alias("lab_vendor"), F.lit(None).cast("string").alias("observed_text"), F.lit(None).cast("string").alias("analyte_id"), F.lit("2024-02-01 00:00:01").cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("id"))
    stream = _replay(e.filter(~first).unionByName(beat), f"{out}/log", "ts")
    with machines.state_store(spark):
        inbox.run_once(machines.vendor_machine(stream, initial=seed), f"{out}/state", each=lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/states"), mode="update")
    changes = spark.read.parquet(f"{out}/states").filter("lab_vendor IS NOT NULL")
    last = F.struct("batch", "confirmations")
    moved = changes.groupBy("lab_vendor", "observed_text").agg(F.max_by(F.struct("collisions", "confirmations", "status"), last).alias("s")).select("lab_vendor", "observed_text", "s.*")
    # Variants without an event or timer since keep the state they started with.
    status = learning.stability(F.col("collisions"), F.datediff(F.lit("2024-02-01").cast("date"), F.col("last_collision").cast("date")))
    kept = seed.join(moved.select("lab_vendor", "observed_text"), ["lab_vendor", "observed_text"], "left_anti").select("lab_vendor", "observed_text", "collisions", "confirmations", status.alias("status"))
    return moved.unionByName(kept)


@query(f"{DUAL_GATE_SQL} SELECT CAST(user_id AS VARCHAR) AS analyte_id, id, ts::VARCHAR AS ts FROM c WHERE o IS NULL AND taken < 20 AND fresh")
def stream_dual_gate(spark, sf_dir):
    """The dual gate over micro-batches: forms seen are state, days are counted, the corpus is never read."""
    out, src = new_path(spark), table(spark, sf_dir, "events")
    known = spark.range(5).select(F.col("id").cast("string").alias("analyte_id"), F.col("id").cast("string").alias("norm"))
    stream = _replay(src, f"{out}/log", "ts")
    machines.prepare(spark, out)
    with machines.state_store(spark):
        inbox.run_once(machines.first_forms(dual_gate_rows(stream), known), f"{out}/state", each=machines.accrete_first(out))
    added = spark.read.schema("analyte_id string, norm string, ts timestamp, id long, day date").option("recursiveFileLookup", "true").parquet(f"{out}/added")
    return added.select("analyte_id", "id", F.col("ts").cast("timestamp_ntz").cast("string").alias("ts"))


def _rolled(spark, sf_dir) -> rollups.Rollup:
    """Daily sums of events that come in order of their ids, not of time, so that every batch has late days."""
    out, e = new_path(spark), table(spark, sf_dir, "events")
    kind, v = F.col("event_type"), F.col("value")
    flags = {"exact": kind == "purchase", "semantic": kind == "view", "unknown": v < 5}
    rolled = rollups.Rollup(e, f"{out}/days", "ts", ("event_type",), flags, {"confidence": F.round(F.least(v / 100, F.lit(1.0)), 6)})
    inbox.run_once(_replay(e, f"{out}/log", "event_id"), f"{out}/state", each=rolled.each())
    return rolled


_BACK = f"CAST(floor(date_diff('day', ts::DATE, DATE '{AS_OF}') / 7) AS BIGINT)"


@query(
    "SELECT week, coalesce(n, 0) AS n, coalesce(exact_rate, 0) AS exact_rate, coalesce(unknown_rate, 0) AS unknown_rate FROM (SELECT unnest(range(12)) AS week) LEFT JOIN ("
    f"SELECT {_BACK} AS week, count(*) AS n, round(avg((event_type = 'purchase')::INT), 9) AS exact_rate, round(avg((value < 5)::INT), 9) AS unknown_rate FROM events GROUP BY 1) USING (week)"
)
def stream_rollup_weeks(spark, sf_dir):
    """Weekly counts and rates from daily sums."""
    w = _rolled(spark, sf_dir).weeks(F.lit(AS_OF), 12)
    return w.select("week", "n", F.round(rollups.share("exact"), 9).alias("exact_rate"), F.round(rollups.share("unknown"), 9).alias("unknown_rate"))


@query(
    "SELECT (SELECT count(*) FROM events WHERE ts::DATE >= DATE '2024-01-24') AS d7, (SELECT count(*) FROM events WHERE ts::DATE >= DATE '2024-01-01') AS d30, count(*) AS total, round(avg((event_type = 'purchase')::INT), 9) AS exact_rate, "
    "round(avg((event_type = 'view')::INT), 9) AS semantic_rate, round(avg((value < 5)::INT), 9) AS unknown_rate, round(avg(c), 6) AS mean_confidence, round(stddev_samp(c), 6) AS sd_confidence FROM (SELECT *, round(least(value / 100, 1), 6) AS c FROM events)"
)
def stream_rollup_maturity(spark, sf_dir):
    """Growth and the corpus's rates from daily sums."""
    rolled = _rolled(spark, sf_dir)
    mean, deviation = rollups.mean_and_deviation("confidence")
    rates = rolled.totals().select(
        F.col("n").alias("total"), F.round(rollups.share("exact"), 9).alias("exact_rate"), F.round(rollups.share("semantic"), 9).alias("semantic_rate"), F.round(rollups.share("unknown"), 9).alias("unknown_rate"),
        F.round(mean, 6).alias("mean_confidence"), F.round(deviation, 6).alias("sd_confidence"),
    )
    return rolled.windows(F.lit(AS_OF), (7, 30)).join(rates)
