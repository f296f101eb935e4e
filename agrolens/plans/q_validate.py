"""Validation queries (A2-A10, J9) on the aligned canonical sample table."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import ingest, validation
from agrolens.plans.common import SAMPLES_SQL, d, rsql, samples
from agrolens.plans.oracle_fixtures import with_fx
from agrolens.plans.q_ingest import _ALIGN_COLS
from agrolens.plans.registry import register
from agrolens.sources import dims

ALIGNED_SQL = [SAMPLES_SQL, f"aligned AS (SELECT {_ALIGN_COLS} FROM samples)"]
_FX = with_fx("soil_samples", extra=ALIGNED_SQL)
_NUM = {n for n, t in dims.CANONICAL_COLUMNS if t in ("double", "bigint")}


def _aligned(spark, sf_dir):
    return ingest.align_canonical(samples(spark, sf_dir))


_NULL_ROWS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, AVG(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM aligned"
    for c in dims.REQUIRED_FEATURES)


@register("check_null_rates", sql=_FX + f"""
SELECT feature, {rsql('r', 6)} AS null_rate, r <= {d(0.5)} AS passed FROM ({_NULL_ROWS})""")
def q_check_null_rates(spark, sf_dir):
    return validation.null_rates(_aligned(spark, sf_dir))


_RANGE_ROWS = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {d(lo)} AS lo, {d(hi)} AS hi, COUNT(*) FILTER (WHERE {f} < {d(lo)}) AS below_min, "
    f"COUNT(*) FILTER (WHERE {f} > {d(hi)}) AS above_max, CAST(MIN({f}) AS DOUBLE) AS actual_min, "
    f"CAST(MAX({f}) AS DOUBLE) AS actual_max FROM aligned"
    for f, lo, hi in dims.FEATURE_RANGES if f in _NUM)


@register("check_ranges", sql=_FX + _RANGE_ROWS)
def q_check_ranges(spark, sf_dir):
    return validation.feature_ranges(_aligned(spark, sf_dir))


_KNOWN = "(VALUES " + ", ".join(f"('{c}')" for c in dims.CROP_LABELS) + ") AS k(target_crop)"


@register("unknown_labels", sql=_FX + f"""
SELECT DISTINCT target_crop FROM aligned
WHERE target_crop IS NOT NULL AND target_crop NOT IN (SELECT target_crop FROM {_KNOWN})""")
def q_unknown_labels(spark, sf_dir):
    return validation.unknown_labels(_aligned(spark, sf_dir))


@register("check_class_balance", sql=_FX + """
SELECT COUNT(*) FILTER (WHERE c < 10) AS n_under, MIN(c) AS min_samples, MAX(c) AS max_samples,
       COUNT(*) FILTER (WHERE c < 10) = 0 AS passed
FROM (SELECT target_crop, COUNT(*) AS c FROM aligned WHERE target_crop IS NOT NULL GROUP BY target_crop)""")
def q_check_class_balance(spark, sf_dir):
    return validation.class_balance(_aligned(spark, sf_dir))


_NN = " + ".join(f"CASE WHEN COUNT({c}) = 0 THEN 1 ELSE 0 END" for c, _ in dims.CANONICAL_COLUMNS)
_HIGH = " + ".join(f"CASE WHEN {d(1.0)} - CAST(COUNT({c}) AS DOUBLE) / COUNT(*) > {d(0.5)} THEN 1 ELSE 0 END"
                   for c in dims.REQUIRED_FEATURES)
_VIOL = " + ".join(f"CASE WHEN COUNT(*) FILTER (WHERE {f} < {d(lo)} OR {f} > {d(hi)}) > 0 THEN 1 ELSE 0 END"
                   for f, lo, hi in dims.FEATURE_RANGES if f in _NUM)
CHECKS_SQL = f"""checks AS (
  SELECT 'required_columns_present' AS name, 'critical' AS severity, TRUE AS passed, {d(0.0)} AS metric
  UNION ALL SELECT 'no_all_null_columns', 'warning', ({_NN}) = 0, CAST(({_NN}) AS DOUBLE) FROM aligned
  UNION ALL SELECT 'null_rates_acceptable', 'critical', ({_HIGH}) = 0, CAST(({_HIGH}) AS DOUBLE) FROM aligned
  UNION ALL SELECT 'feature_ranges_valid', 'critical', ({_VIOL}) = 0, CAST(({_VIOL}) AS DOUBLE) FROM aligned
  UNION ALL SELECT 'no_duplicate_sample_ids', 'warning', dup = 0, CAST(dup AS DOUBLE) FROM (
    SELECT COUNT(*) - COUNT(DISTINCT sample_id) - LEAST(COUNT(*) - COUNT(sample_id), 1) AS dup FROM aligned)
  UNION ALL SELECT 'location_ids_present', 'critical', COUNT(location_id) = COUNT(*) AND COUNT(DISTINCT location_id) >= 2,
                   CAST(COUNT(DISTINCT location_id) AS DOUBLE) FROM aligned
  UNION ALL SELECT 'target_cardinality', 'warning', COUNT(*) = 0, CAST(COUNT(*) AS DOUBLE) FROM (
    SELECT DISTINCT target_crop FROM aligned
    WHERE target_crop IS NOT NULL AND target_crop NOT IN (SELECT target_crop FROM {_KNOWN}))
  UNION ALL SELECT 'class_balance_minimum', 'warning', COUNT(*) FILTER (WHERE c < 10) = 0,
                   CAST(COUNT(*) FILTER (WHERE c < 10) AS DOUBLE) FROM (
    SELECT target_crop, COUNT(*) AS c FROM aligned WHERE target_crop IS NOT NULL GROUP BY target_crop)
)"""


@register("validation_checks", sql=with_fx("soil_samples", extra=ALIGNED_SQL + [CHECKS_SQL]) + """
SELECT name, severity, passed, metric FROM checks""")
def q_validation_checks(spark, sf_dir):
    return validation.validation_checks(_aligned(spark, sf_dir))


@register("validation_report", sql=with_fx("soil_samples", extra=ALIGNED_SQL + [CHECKS_SQL]) + """
SELECT COUNT(*) AS total_checks, COUNT(*) FILTER (WHERE passed) AS passed,
       COUNT(*) FILTER (WHERE NOT passed AND severity = 'critical') AS critical_failures,
       COUNT(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings,
       CASE WHEN COUNT(*) FILTER (WHERE NOT passed AND severity = 'critical') = 0 THEN 'PASS' ELSE 'FAIL' END
         AS overall_status
FROM checks""")
def q_validation_report(spark, sf_dir):
    return validation.validation_report(validation.validation_checks(_aligned(spark, sf_dir)))
