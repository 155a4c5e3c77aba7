"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the
last return the columns of ``documents``, whatever further columns these have.

An empty table gives an empty result in every stage. Texts are read whole.
Rows with a null doc_id are rows like any other; stages that remove rows tell
them apart by their texts, as they do rows that share a doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import decontaminate, langid, linededup, mixing, simhash
from quillgrid.llm.common import broadcast_if_small, materialise, table
from quillgrid.shipping import shipped

#: Texts whose nearest profile is this far off (or that have no letters) are in none of the learned languages.
LEAST_SCORE = 0.02


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no learned language: null texts, texts without letters and those far from every profile. Repeated rows share one fate."""
    return langid.identify(docs, langid.train(langid.learn_from(docs)), least=LEAST_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated chunks of lines; n_chars follows the text where it changed. Every row stays, null texts as they are, exact repeats of a row alike."""
    found = linededup.dedup_lines(docs)
    changed = F.when(F.col("__qg_n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group: the smallest id, nulls last, and of that id's texts the smallest key.

    Null and empty texts form one group; of exact repeats of a row one stays.
    """
    found = materialise(simhash.heads(docs))
    gone = materialise(found.filter("NOT head").select(F.col("doc_id").alias("__qg_gone"), F.col("text_key").alias("__qg_gone_key")).distinct())
    keyed = docs.withColumn("__qg_key", F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col("__qg_gone")) & (F.col("__qg_key") == F.col("__qg_gone_key"))
    kept = keyed.join(broadcast_if_small(gone), same, "left_anti")
    # Every row left heads its group, so rows of one id and text are repeats of one head.
    repeats = found.filter("head").groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count()
    return (kept.dropDuplicates(["doc_id", "__qg_key"]) if repeats else kept).drop("__qg_key")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the benchmark contaminates, all repeats of them; null texts stay."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = materialise(found.filter("contaminated").select(F.col("doc_id").alias("__qg_gone"), F.col("text_key").alias("__qg_key")).distinct())
    same = F.col("doc_id").eqNullSafe(F.col("__qg_gone")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__qg_key"))
    return docs.join(broadcast_if_small(gone), same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target and words taken. A row per row; null texts have size 0, a null source is a source."""
    return mixing.mix(mixing.size_documents(docs)).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", shipped(language)),
    ("line_dedup", shipped(lines)),
    ("simhash_near_dedup", shipped(near_copies)),
    ("decontaminate", shipped(decontaminated)),
    ("source_mix", shipped(mixed)),
]

#: Fingerprints and profiles are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
