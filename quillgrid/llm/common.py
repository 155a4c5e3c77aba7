"""Reading, materialising and size-checked broadcasting shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.storage import materialise, new_path, release  # noqa: F401  the operators take these from here

#: ASCII letters only; other characters keep their case.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows of a two-long table that may be broadcast (about 100 MB as a hash relation).
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``materialise`` as a table in ``n`` buckets of ``key``: joins on ``key`` leave its rows where they are.

    The catalogue holds it only while it is written.
    """
    spark = df.sparkSession
    name = f"quillgrid_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", new_path(spark)).option("compression", "uncompressed").bucketBy(n, key).saveAsTable(name)
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external one: its files stay
    return held


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side takes the shuffle join.

    ``df`` should be materialised: it is counted here and read again by the join.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than this share of all rows is hot; fewer than HOT keys can be.
HOT = 1024


def join_hot(rows: DataFrame, unique: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which has one row a key and, in ``n``, how many of ``rows`` have it.

    ``total`` is the sum of all ``n``. Keys with more than ``total / HOT`` rows
    are fewer than ``HOT``, whatever the data are: these are broadcast, so that
    a key's rows stay where they are, and only the others are shuffled. ``n`` is
    dropped; null keys meet nothing.
    """
    hot = F.col("n") > total / HOT
    hubs = F.broadcast(unique.filter(hot))
    met = rows.join(hubs, key).drop("n")
    rest = rows.join(hubs.select(key), key, "left_anti").join(unique.filter(~hot), key).drop("n")
    return met.unionByName(rest)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)
