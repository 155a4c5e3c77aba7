"""Importance resampling towards a target distribution (Xie et al., "Data Selection for Language Models via Importance Resampling", 2023).

Texts are bags of word n-grams hashed to ``buckets`` buckets. DuckDB works
inside each task on slices of whole texts: SQL unnests words, windows join them
to n-grams, and a registered CRC function names the bucket of each distinct
n-gram. A first pass counts buckets; what a task has counted, one row a bucket
it met, is spilled to Parquet in the shared folder, and Spark adds it up. The
gains, one number a bucket, go back to all tasks, and a second pass adds them
up by document. Scores, the draw and the ranks are Spark columns.

The draw is the Gumbel top-k trick: a random number from the id's digest is
added to the weight, and the highest sums are drawn. Ranks are global
but no task sees all rows: rows are dealt by ranges of score, counted by
range, and numbered from their range's offset.

Null texts have no words. A null id draws as an empty one. Repeated rows are
rows like any other: each has a rank of its own, which of two equal rows comes
first makes no difference, and a salt keeps a row repeated any number of times
from landing in one range. Ties of scores go to the smaller id, nulls last.
Texts are read whole, however long. Without a target, or without documents, gains
follow from the same formula; an empty table gives an empty result. Columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.llm.common import LOWER, UPPER, materialise, release
from quillgrid.llm.kernels import text_slices

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of text that a query of DuckDB is given, at least one whole text.
SLICE = 4 << 20
_LOWERED = f"translate(text, '{UPPER}', '{LOWER}')"


@dataclass(frozen=True)
class Plan:
    """n-grams of 1 to ``order`` words in ``buckets`` buckets; ``percent`` of the documents with ``least_words`` words or more are drawn."""

    order: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    scale: int = 1000
    seed: str = "2024"


def _engine(plan: Plan):
    """A DuckDB connection of this task with the CRC function: one thread, nothing on disk."""
    import duckdb

    def crc(grams: pa.ChunkedArray) -> pa.Array:
        return pa.array([zlib.crc32(x.encode()) % plan.buckets for x in grams.to_pylist()], pa.int64())

    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.execute("SET enable_progress_bar = false")
    con.create_function("crc_bucket", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def _grams_sql(order: int) -> str:
    """Rows (row, gram) of the relation ``texts`` (row, text): every run of 1 to ``order`` words."""
    words = f"SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT row, regexp_extract_all({_LOWERED}, '{WORD}') AS w FROM texts)"
    if order == 1:
        return f"SELECT row, word AS gram FROM ({words})"
    longer = "".join(f", lead(word, {k}) OVER s AS w{k}" for k in range(1, order))
    runs = [f"SELECT row, {" || ' ' || ".join(['word', *(f'w{k}' for k in range(1, n))])} AS gram FROM spread{f' WHERE w{n - 1} IS NOT NULL' if n > 1 else ''}" for n in range(1, order + 1)]
    return f"WITH spread AS (SELECT row, word{longer} FROM ({words}) WINDOW s AS (PARTITION BY row ORDER BY pos)) {' UNION ALL '.join(runs)}"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Table]]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        for a, b, _, _ in text_slices(batch, "text", SLICE):
            yield batch.slice(a, b - a), pa.table({"row": pa.array(np.arange(b - a)), "text": texts.slice(a, b - a)})


def bucket_counts(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(bucket, n) over all texts. Each task writes its counts once; Spark adds them up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(plan.buckets, np.int64)
        con = _engine(plan)
        try:
            for _, texts in _slices(batches):
                con.register("texts", texts)
                found = con.sql(f"SELECT crc_bucket(gram) AS bucket, n FROM (SELECT gram, count(*) AS n FROM ({_grams_sql(plan.order)}) GROUP BY gram)").fetchnumpy()
                np.add.at(held, found["bucket"], found["n"])
                con.unregister("texts")
        finally:
            con.close()
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(held[met])], names=["bucket", "n"])

    spilled = materialise(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "bucket long, n long"))
    return spilled.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, plan: Plan = Plan()) -> np.ndarray:
    """By bucket floor(scale * ln of target share over source share), one added to every count. ``source`` and ``target`` are bucket counts: at most ``buckets`` rows each reach the driver."""
    s, t = np.zeros(plan.buckets, np.int64), np.zeros(plan.buckets, np.int64)
    for counts, held in ((source, s), (target, t)):
        for r in counts.collect():
            held[r["bucket"]] = r["n"]
    S, T = int(s.sum()), int(t.sum())
    # Integers first, one division, one logarithm: as the formula reads.
    return np.array([math.floor(plan.scale * math.log(((y + 1) * (S + plan.buckets)) / ((x + 1) * (T + plan.buckets)))) for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, by_bucket: np.ndarray, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_words, n_features, weight): sums of gains over every feature of a document."""
    sent = docs.sparkSession.sparkContext.broadcast(by_bucket)
    words = f"SELECT row, CAST(len(regexp_extract_all({_LOWERED}, '{WORD}')) AS BIGINT) AS n_words FROM texts"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine(plan)
        try:
            con.register("gains", pa.table({"bucket": pa.array(np.arange(plan.buckets)), "gain": pa.array(sent.value)}))
            for rows, texts in _slices(batches):
                con.register("texts", texts)
                found = con.sql(
                    f"WITH grams AS MATERIALIZED (SELECT row, gram, count(*) AS n FROM ({_grams_sql(plan.order)}) GROUP BY row, gram), "
                    "named AS (SELECT gram, gain FROM (SELECT gram, crc_bucket(gram) AS bucket FROM (SELECT DISTINCT gram FROM grams)) JOIN gains USING (bucket)) "
                    f"SELECT row, n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight FROM ({words}) "
                    "LEFT JOIN (SELECT row, sum(n) AS n, sum(n * gain) AS weight FROM grams JOIN named USING (gram) GROUP BY row) USING (row) ORDER BY row"
                ).to_arrow_table()
                columns = [pa.array(found.column(c).fill_null(0).to_numpy()) for c in ("n_words", "n_features", "weight")]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])
                con.unregister("texts")
        finally:
            con.close()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, plan: Plan = Plan()) -> Column:
    """floor(scale * Gumbel noise) from the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(plan.scale)) * F.log(-F.log(u))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` in ``order`` with ``__qg_rank`` 1, 2, 3 ...: no task sees all rows.

    ``rows`` must be read from a written table, so that the salt of a row, its
    place there, is the same whenever a task runs again. The salt makes the
    order total, so equal rows spread over ranges.
    """
    salted = rows.withColumn("__qg_salt", F.monotonically_increasing_id())
    placed = materialise(salted.orderBy(*order, "__qg_salt").drop("__qg_salt").withColumn("__qg_at", F.monotonically_increasing_id()))
    # The upper bits of a place are its range; ranges are as many as the tasks of the sort.
    of = F.shiftright("__qg_at", 33)
    counts = sorted((r["k"], r["count"]) for r in placed.groupBy(of.alias("k")).count().collect())
    starts, total = [], 0
    for k, n in counts:
        starts.append((k, total))
        total += n
    offsets = F.broadcast(placed.sparkSession.createDataFrame(starts, "__qg_k long, __qg_start long"))
    here = F.col("__qg_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, of == F.col("__qg_k")).withColumn("__qg_rank", F.col("__qg_start") + here + 1).drop("__qg_at", "__qg_k", "__qg_start")


def resample(docs: DataFrame, target: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every document; the rank of those drawn, else null."""
    found = gains(bucket_counts(docs, plan), bucket_counts(target, plan), plan)
    scored = materialise(weights(docs, found, plan).withColumn("score", F.col("weight") + noise(F.col("doc_id"), plan)))
    able = F.coalesce(F.col("n_words") >= plan.least_words, F.lit(False))
    drawn = scored.filter(able).count() * plan.percent // 100
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    top = ranked(scored.filter(able), *order).withColumn("rank", F.when(F.col("__qg_rank") <= drawn, F.col("__qg_rank"))).drop("__qg_rank")
    return top.unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))


#: The CRC-32 of a text's UTF-8 bytes in SQL: its table by rule, then a fold over the bytes. Words are folded once each.
CRC_SQL = """
crc_steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8
)"""
#: What the query returns, in DuckDB's SQL.
ORACLE = rf"""
WITH RECURSIVE {CRC_SQL.strip()}, words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w, row_number() OVER () AS r FROM documents
), spread AS (
  SELECT r, unnest(w) AS word FROM words
), aims AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')) AS word FROM benchmark
), types AS (
  SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM spread UNION SELECT word FROM aims)
), named AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM types, crc_table
), held AS (
  SELECT bucket, count(*) AS s FROM spread JOIN named USING (word) GROUP BY bucket
), wanted AS (
  SELECT bucket, count(*) AS t FROM aims JOIN named USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(s) FROM held), 0)::BIGINT AS ss, coalesce((SELECT sum(t) FROM wanted), 0)::BIGINT AS tt
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (tt + 10000))::DOUBLE)) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM named) LEFT JOIN held USING (bucket) LEFT JOIN wanted USING (bucket), totals
), weighed AS (
  SELECT r, sum(gain)::BIGINT AS weight FROM spread JOIN named USING (word) JOIN gained USING (bucket) GROUP BY r
), scored AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM words LEFT JOIN weighed USING (r)
), drawn AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= floor(10 * able / 100) THEN place END AS rank FROM drawn
"""
