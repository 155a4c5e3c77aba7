"""Table changes as copies: append, upsert, conditional update, soft and cascading delete, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_new(existing: DataFrame, rows: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows whose key is not there yet, of each key the first by ``order`` (by all other columns if none is given): what an idempotent insert adds."""
    rest = [c for c in (order or []) if c not in key] + [c for c in rows.columns if c not in key and c not in (order or [])]
    first = rows
    if rest:
        held = F.struct(*(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(f"c{i}") for i, c in enumerate(rest)))
        first = rows.groupBy(*key).agg(F.min(held).alias("_first")).select(*key, *(F.col("_first")[f"c{i}"]["value"].alias(c) for i, c in enumerate(rest))).select(*rows.columns)
    else:
        first = rows.distinct()
    return first.join(existing.select(*key).distinct(), key, "left_anti")


def upsert(existing: DataFrame, rows: DataFrame, key: list[str], newest: str) -> DataFrame:
    """The newest row of each key; of equally new rows the incoming one."""
    both = existing.withColumn("_in", F.lit(0)).unionByName(rows.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(newest), F.desc("_in")))
    return both.withColumn("_n", nth).filter("_n = 1").drop("_in", "_n")


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """New values where the condition holds (a null condition does not)."""
    return df.withColumns({k: F.when(condition, v).otherwise(F.col(k)) for k, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Parents and children without the keys of ``gone``."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return [df.join(ids, F.col(k) == F.col("_gone"), "left_anti") for df, k in [(parents, key), *children]]


def observe(variants: DataFrame, key: list[str], day: str) -> DataFrame:
    """Frequency, first and last day of what was observed: the state that increments would leave."""
    return variants.groupBy(*key).agg(F.count("*").alias("frequency_count"), F.min(day).alias("first_seen_date"), F.max(day).alias("last_seen_date"))


def next_id(existing: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row: the number after the largest ``prefix_ddd``."""
    number = F.regexp_extract(column, f"^{prefix}_(\\d+)$", 1).try_cast("int")
    return existing.agg(F.format_string(f"{prefix}_%03d", F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_id"))


def child_entity(parent: DataFrame, new_id: str, name: str, synonyms: list[str], normalise) -> tuple[DataFrame, DataFrame]:
    """An analyte under ``parent`` with its group, and its synonyms, the first of each normalised form."""
    spark = parent.sparkSession
    child = parent.select(
        F.lit(new_id).alias("analyte_id"), F.lit(name).alias("preferred_name"), "analyte_type", "group_code", "chemical_group", F.col("analyte_id").alias("parent_analyte_id")
    )
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([name, *synonyms])], "place int, synonym_raw string")
    normed = rows.select("place", "synonym_raw", normalise(F.col("synonym_raw")).alias("synonym_norm"))
    first = normed.groupBy("synonym_norm").agg(F.min_by("synonym_raw", "place").alias("synonym_raw"))
    return child, first.select(F.lit(new_id).alias("analyte_id"), "synonym_raw", "synonym_norm")


def seed_synonyms(analytes: DataFrame, synonyms: DataFrame, normalise) -> DataFrame:
    """Synonyms from preferred names that (analyte, form) does not hold yet."""
    rows = analytes.select("analyte_id", F.col("preferred_name").alias("synonym_raw"), normalise(F.col("preferred_name")).alias("synonym_norm"))
    return append_new(synonyms, rows, ["analyte_id", "synonym_norm"])


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One row: count and 16 hex digits that do not depend on the order of rows."""
    row = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns)).cast("binary"), 256)
    part = F.conv(F.substring(row, 1, 8), 16, 10).cast("long")
    return df.agg(F.count("*").alias("n"), F.sum(part).alias("s")).select("n", F.substring(F.sha2(F.concat_ws(":", "n", "s").cast("binary"), 256), 1, 16).alias("content_hash"))


def latest_snapshot(registry: DataFrame, kind: str) -> DataFrame:
    return registry.filter(F.col("kind") == kind).agg(F.max_by(F.struct("version", "content_hash", "created_at"), F.struct("created_at", "version")).alias("s")).filter("s IS NOT NULL").select("s.*")


def activate_snapshot(registry: DataFrame, kind: str, version: str) -> DataFrame:
    """The one version of its kind becomes active, the others of the kind do not stay so."""
    return update_where(registry, F.col("kind") == kind, is_active=F.col("version") == version)


def register_snapshot(registry: DataFrame, kind: str, version: str, table: DataFrame, columns: list[str], created_at: Column) -> DataFrame:
    """The registry (kind, version, n, content_hash, created_at, is_active) with a snapshot of ``table``, which becomes the active one of its kind."""
    row = content_hash(table, *columns).select(F.lit(kind).alias("kind"), F.lit(version).alias("version"), "n", "content_hash", created_at.alias("created_at"), F.lit(True).alias("is_active"))
    same = (F.col("kind") == kind) & (F.col("version") == version)
    return activate_snapshot(delete_where(registry, same).unionByName(row), kind, version)


def clear_conflicting(confirmations: DataFrame, kept: DataFrame, key: list[str], value: str, flag: str = "valid_for_consensus") -> DataFrame:
    """Soft delete: confirmations of a key of ``kept`` that name another value than the kept one no longer count. Other rows stay as they are."""
    right = kept.select(*key, F.col(value).alias("_kept"))
    held = confirmations.join(right, key, "left")
    return update_where(held, F.col("_kept").isNotNull() & ~F.col(value).eqNullSafe(F.col("_kept")), **{flag: F.lit(False)}).select(*confirmations.columns)
