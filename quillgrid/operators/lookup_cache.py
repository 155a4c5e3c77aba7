"""Read-through cache of outside lookups, with expiry and write-back.

Hits come by a join, misses by an anti join; misses are put to an injected
client in bounded batches, by few tasks at a time, with retries and growing
pauses. Results, also that nothing was found, are appended to the cache, so
what was asked once is not asked again before it expires. Keys whose requests
failed are not cached and are asked again next time.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import names
from quillgrid.sources.files import backoff_delays

#: For each key {"numbers": [...], "synonyms": [...]}, or None where the registry knows nothing.
Client = Callable[[list[str]], list[dict | None]]
ENTRY = "key string, numbers array<string>, synonyms array<string>, found boolean, fetched_at timestamp"
#: Beginnings of synonyms that are numbers of other registries. Fixed values.
FOREIGN = ("DTXSID", "DTXCID", "SCHEMBL", "RefChem:", "AKOS", "MFCD", "NSC-", "EINECS", "EC ")
LONGEST = 120


@dataclass(frozen=True)
class LookupCache:
    """Entries live under ``path``; those found last ``found_days``, the others ``missing_days``."""

    spark: SparkSession
    path: str
    found_days: int = 180
    missing_days: int = 30
    #: Keys a request, tasks that ask at the same time, requests tried again and the first pause in seconds.
    batch: int = 50
    tasks: int = 4
    retries: int = 3
    pause: float = 1.0

    def entries(self) -> DataFrame:
        """All that was ever fetched."""
        try:
            return self.spark.read.schema(ENTRY).parquet(self.path)
        except Exception as e:  # nothing was fetched yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], ENTRY)

    def fresh(self, as_of: Column) -> DataFrame:
        """The last entry of each key, if it has not expired."""
        last = self.entries().filter(F.col("fetched_at") <= as_of).groupBy("key").agg(F.max_by(F.struct("numbers", "synonyms", "found", "fetched_at"), "fetched_at").alias("e")).select("key", "e.*")
        days = F.when(F.col("found"), self.found_days).otherwise(self.missing_days)
        return last.filter(F.col("fetched_at") + F.make_dt_interval(days) > as_of)

    def look_up(self, asked: DataFrame, client: Client, as_of: Column) -> DataFrame:
        """(key, numbers, synonyms, found, fetched_at) of every distinct key of ``asked`` that is known now; keys are trimmed and lower-cased, null and empty ones left out."""
        keys = asked.select(F.lower(F.trim("key")).alias("key")).filter("key <> ''").distinct()
        misses = keys.join(self.fresh(as_of).select("key"), "key", "left_anti")
        size, delays = self.batch, backoff_delays(self.retries, self.pause)

        def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                listed = pdf["key"].tolist()
                for at in range(0, len(listed), size):
                    part = listed[at : at + size]
                    got = _ask(client, part, delays)
                    if got is not None:
                        yield pd.DataFrame({"key": part, "numbers": [(g or {}).get("numbers", []) for g in got], "synonyms": [(g or {}).get("synonyms", []) for g in got], "found": [g is not None for g in got]})

        fetched = misses.repartition(self.tasks, "key").mapInPandas(ask, "key string, numbers array<string>, synonyms array<string>, found boolean")
        # Written before it is read: a task that runs again asks again, but what was written is not asked twice.
        fetched.withColumn("fetched_at", as_of).write.mode("append").parquet(self.path)
        return keys.join(self.fresh(as_of), "key")


def _ask(client: Client, keys: list[str], delays: list[float]) -> list[dict | None] | None:
    """The client's answer; None where it failed as often as may be."""
    for wait in [*delays, None]:
        try:
            return client(keys)
        except Exception:  # noqa: BLE001  whatever an outside service raises
            if wait is None:
                return None
            time.sleep(wait)
    return None


def learned_synonyms(known: DataFrame, analytes: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(analyte_id, synonym_raw, synonym_norm) to append: the asked name and the fetched synonyms of keys of which a number is in the registry, but for what the analyte has and what is no name.

    The first number that an analyte or a synonym has decides, an analyte
    before a synonym, the smaller id before the greater.
    """
    listed = known.filter("found").select("key", "synonyms", F.posexplode("numbers").alias("pos", "number"))
    ids = analytes.select(F.col("cas_number").alias("number"), F.lit(0).alias("via"), "analyte_id").unionByName(synonyms.select(F.col("synonym_raw").alias("number"), F.lit(1).alias("via"), "analyte_id"))
    hit = listed.join(ids, "number").groupBy("key").agg(F.min_by(F.struct("analyte_id", "synonyms"), F.struct("pos", "via", "analyte_id")).alias("h"))
    told = hit.select(F.col("h.analyte_id").alias("analyte_id"), F.explode(F.concat(F.array("key"), "h.synonyms")).alias("synonym_raw"))
    name = (F.length("synonym_raw") <= LONGEST) & ~F.col("synonym_raw").rlike("^(" + "|".join(FOREIGN) + ")")
    formed = told.filter(name).withColumn("synonym_norm", names.normalise(F.col("synonym_raw"))).filter("synonym_norm <> ''")
    one = formed.groupBy("analyte_id", "synonym_norm").agg(F.min("synonym_raw").alias("synonym_raw"))
    return one.join(synonyms.select("analyte_id", "synonym_norm"), ["analyte_id", "synonym_norm"], "left_anti").select("analyte_id", "synonym_raw", "synonym_norm")
