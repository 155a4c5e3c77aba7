"""Schemas of the canonical tables and of match results, and the checks Spark does not make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = {
    "analytes": "analyte_id string, preferred_name string, analyte_type string, cas_number string, group_code string, chemical_group string, table_number int, parent_analyte_id string",
    "synonyms": "synonym_id long, analyte_id string, synonym_raw string, synonym_norm string, synonym_type string, confidence double, harvest_source string, lab_vendor string",
    "lab_variants": "id long, lab_vendor string, observed_text string, validated_match_id string, frequency_count int, first_seen_date date, last_seen_date date, collision_count int, last_collision_date date",
    "lab_variant_confirmations": "variant_id long, submission_id long, confirmed_analyte_id string, valid_for_consensus boolean, confirmed_at timestamp",
    "match_decisions": "decision_id long, input_text string, matched_analyte_id string, match_method string, confidence_score double, margin double, human_validated boolean, disagreement_flag boolean, ingested boolean, decision_timestamp timestamp, correction_of long",
    "embeddings_metadata": "embedding_id long, analyte_id string, synonym_id long, vector array<float>",
    "api_harvest_metadata": "harvest_id long, analyte_id string, source string, succeeded boolean, rate_limited boolean, synonyms_found int, seconds double, harvested_at timestamp",
    "snapshot_registry": "version string, kind string, content_hash string, is_active boolean, created_at timestamp",
    "lab_submissions": "submission_id long, file_name string, file_hash string, vendor string, validation_status string, received_at timestamp",
    "lab_results": "result_id long, submission_id long, row_number int, chemical_raw string, analyte_id string, correct_analyte_id string, match_method string, match_confidence double, validation_status string, sample_id string, result_value string, units string, detection_limit string, medium string, top_candidates string",
    "learned_templates": "template_id long, vendor string, fingerprint string, created_at timestamp",
    "extraction_errors": "error_id long, submission_id long, field string, extracted_value string, corrected_value string",
}

CANDIDATE = "struct<analyte_id:string,preferred_name:string,confidence:double,method:string,score:double>"
METHODS = ("exact", "fuzzy", "semantic", "cas_extracted", "vendor_cache", "api", "manual", "novel", "none")


def violations(df: DataFrame, **checks) -> DataFrame:
    """(check, n): rows that break each condition; a null condition breaks it as well."""
    counted = df.agg(*(F.count(F.when(~F.coalesce(c, F.lit(False)), 1)).alias(k) for k, c in checks.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.col(k).alias("n")) for k in checks)))).select("col.*")


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_parent"), "left_anti")


def exactly_one(*columns):
    """Condition that one of the columns is set and the others are not."""
    return reduce(lambda a, b: a + b, (F.when(c.isNotNull(), 1).otherwise(0) for c in columns)) == 1
