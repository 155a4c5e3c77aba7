"""Streams: inbox of files, weekly windows, vendor state machine, daily caps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillgrid.config import Thresholds
from quillgrid.operators import learning
from quillgrid.sources.digests import md5_of_files
from quillgrid.sources.versions import TableSet
from quillgrid.storage import materialise, release

#: Buckets that keys share, whose state is read and written as one.
BUCKETS = 1024
FILES = "path string, modificationTime timestamp, length long, content binary"


HASHED = "file_hash string, path string, modificationTime timestamp, length long"


def _files(spark: SparkSession, folder: str, pattern: str, per_trigger: int, archive: str | None) -> DataFrame:
    """New files of a folder; a file is opened only if its content is asked for."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder).filter(~F.element_at(F.split("path", "/"), -1).startswith("~$"))


def watch(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int = 100, archive: str | None = None) -> DataFrame:
    """New files of a folder, each content once: (file_hash, path, length, content). Files should arrive by rename.

    A file's content is one value, so a task reads it whole and 2 GB are the
    most; ``take_in`` has neither limit, and gives no content.
    """
    return _files(spark, folder, pattern, per_trigger, archive).withColumn("file_hash", F.md5("content")).dropDuplicates(["file_hash"])


def take_in(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*", per_trigger: int = 100, archive: str | None = None) -> None:
    """Take in the new files of a folder and stop: each content once, as (file_hash, path, modificationTime, length) into ``out`` as Parquet.

    Files may be of any size: a batch's are hashed in windows
    (``sources.digests``) and written to a log under ``checkpoint``, which a
    second stream reads that lets every hash pass once. A batch that runs again
    replaces its part of the log. Files should arrive by rename.
    """
    log = f"{checkpoint}/hashes"

    def work(batch: DataFrame, batch_id: int) -> None:
        found = md5_of_files(batch)
        hashed = batch.sparkSession.createDataFrame([(h, r["path"], r["modificationTime"], r["length"]) for r, h in found], HASHED)
        hashed.coalesce(1).write.mode("overwrite").parquet(f"{log}/{batch_id}")

    spark.createDataFrame([], HASHED).write.mode("ignore").parquet(f"{log}/start")
    files = _files(spark, folder, pattern, per_trigger, archive).select("path", "modificationTime", "length", "_metadata.file_path")
    run_once(files, f"{checkpoint}/files", each=work)
    run_once(spark.readStream.schema(HASHED).parquet(f"{log}/*").dropDuplicates(["file_hash"]), f"{checkpoint}/contents", path=out)


def run_once(df: DataFrame, checkpoint: str, each=None, path: str | None = None, mode: str = "append") -> None:
    """Process what is there and stop: into ``path`` as Parquet, or batch by batch through ``each(df, id)``."""
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def accrete(tables: TableSet, name: str = "synonyms", t: Thresholds = Thresholds()):
    """Body of ``run_once``: rows that pass the dual gate join the corpus, which the next batch reads anew.

    The corpus has (analyte_id, norm, ts). The day's cap counts what earlier
    batches added; a batch that runs twice finds its rows known.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        corpus = tables.read(name)
        before = corpus.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).filter("day IS NOT NULL")
        passed = learning.dual_gate(batch, corpus, t, before).filter("outcome = 'ingested'")
        tables.commit(append={name: passed.select("analyte_id", "norm", "ts")})

    return work


def route(parse, processed: str, failed: str):
    """Body of ``run_once``: ``parse(batch)`` adds ``error``, null where all went well; rows go to one of two folders, each batch to its own part."""

    def work(batch: DataFrame, batch_id: int) -> None:
        held = materialise(parse(batch))
        for path, rows in ((processed, held.filter("error IS NULL").drop("error")), (failed, held.filter("error IS NOT NULL"))):
            rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")
        release(held)

    return work


def weekly(events: DataFrame, ts: str, key: str, late: str = "2 days") -> DataFrame:
    """Counts by tumbling week and key; what is later than ``late`` is dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "7 days"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("week"), key, "n")


def daily_caps(events: DataFrame, ts: str, key: str, late: str = "1 day") -> DataFrame:
    """Counts by day and key, to hold against daily caps."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day"), key).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), key, "n")


def vendor_states(confirmations: DataFrame, t: Thresholds = Thresholds(), buckets: int = BUCKETS) -> DataFrame:
    """State of each (lab_vendor, observed_text) after every batch: confirmations, collisions, status.

    Input: lab_vendor, observed_text, analyte_id, ts. Events of a batch are
    taken in order of time; an event that names another analyte than the one
    before is a collision. Variants share ``buckets``, a number fixed for a
    checkpoint, and a bucket's events are taken as arrays.
    """
    out = "lab_vendor string, observed_text string, analyte_id string, confirmations long, collisions long, status string"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {(v, x): row for v, x, *row in zip(*state.get, strict=True)} if state.exists else {}  # [analyte, n, hits, last]
        rows = pd.concat(list(batches)).sort_values(["ts", "analyte_id"], kind="stable")
        plain = lambda c: rows[c].astype(object).where(rows[c].notna(), None).to_numpy()
        codes: dict[tuple, int] = {}
        code = np.array([codes.setdefault(v, len(codes)) for v in zip(plain("lab_vendor"), plain("observed_text"), strict=True)])
        order = np.argsort(code, kind="stable")
        code, analyte = code[order], plain("analyte_id")[order]
        seconds = rows["ts"].to_numpy("datetime64[us]").astype(np.int64)[order] / 1e6
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        states = [held.setdefault(v, [None, 0, 0, None]) for v in codes]  # in order of codes
        before = np.concatenate([[None], analyte[:-1]]).astype(object)
        before[starts] = np.array([s[0] for s in states], object)
        changed = np.array([b is not None and a != b for a, b in zip(analyte, before, strict=True)], bool)
        hits, last = np.add.reduceat(changed.astype(np.int64), starts), np.maximum.reduceat(np.where(changed, seconds, -np.inf), starts)
        found = []
        for v, s, a, b, h, at in zip(codes, states, starts.tolist(), [*starts[1:].tolist(), len(code)], hits.tolist(), last.tolist(), strict=True):
            s[:] = [analyte[b - 1], s[1] + b - a, s[2] + h, at if h else s[3]]
            cooling = s[3] is not None and seconds[b - 1] - s[3] < t.cooldown_days * 86400
            found.append((*v, *s[:3], "STABLE" if not s[2] else "COLLIDED" if s[2] <= t.max_collisions else "UNSTABLE" if cooling else "RECOVERED"))
        state.update((*(list(c) for c in zip(*held, strict=True)), *(list(c) for c in zip(*held.values(), strict=True))))
        yield pd.DataFrame(found, columns=["lab_vendor", "observed_text", "analyte_id", "confirmations", "collisions", "status"])

    dealt = confirmations.withColumn("_bucket", F.pmod(F.xxhash64("lab_vendor", "observed_text"), F.lit(buckets)).cast("int"))
    return dealt.groupBy("_bucket").applyInPandasWithState(
        step, out, "vendor array<string>, text array<string>, analyte array<string>, n array<long>, hits array<long>, last array<double>", "update", GroupStateTimeout.NoTimeout
    )
