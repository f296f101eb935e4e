"""ETL queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import ingest
from agrolens.plans.common import AS_OF, SAMPLES_SQL, rsql, samples
from agrolens.plans.oracle_fixtures import with_fx
from agrolens.plans.registry import register
from agrolens.sources import dims, fixtures

_NORM = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"

PRODUCTION_SQL = f"""production AS (
  SELECT record_id, State_Name AS state, District_Name AS district, Crop_Year AS year, Season AS season,
         {_NORM.format(c='Crop')} AS target_crop, Area AS area_ha, Production AS production_tonnes,
         CASE WHEN Area > 0 THEN Production * CAST(1000 AS DOUBLE) / Area END AS yield_kg_ha
  FROM crop_production
)"""

MEDIANS_SQL = """medians AS (
  SELECT target_crop, COUNT(*) AS n_records, MEDIAN(yield_kg_ha) AS yield_kg_ha_median
  FROM production WHERE target_crop IS NOT NULL AND yield_kg_ha IS NOT NULL GROUP BY target_crop
)"""


def _production(spark, sf_dir):
    return ingest.production_canonical(fixtures.crop_production(spark, sf_dir))


@register("normalize_crop", sql=with_fx("soil_samples") + f"""
SELECT row_uid, label, {_NORM.format(c='label')} AS target_crop FROM soil_samples""")
def q_normalize_crop(spark, sf_dir):
    raw = fixtures.soil_samples(spark, sf_dir)
    return raw.select("row_uid", "label", ingest.normalize_crop(F.col("label")).alias("target_crop"))


@register("rename_canonical", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + """
SELECT row_uid, N_kg_ha, P_kg_ha, K_kg_ha, avg_temp_c, humidity_pct, pH, avg_precip_mm, target_crop
FROM samples""")
def q_rename_canonical(spark, sf_dir):
    return samples(spark, sf_dir).select("row_uid", *dims.REQUIRED_FEATURES, "target_crop")


_PRESENT = {"sample_id": "sample_id", "date": "date", "latitude": "latitude", "longitude": "longitude",
            "location_id": "location_id", "pH": "pH", "N_kg_ha": "N_kg_ha", "P_kg_ha": "P_kg_ha",
            "K_kg_ha": "K_kg_ha", "avg_precip_mm": "avg_precip_mm", "avg_temp_c": "avg_temp_c",
            "humidity_pct": "humidity_pct", "target_crop": "target_crop"}
_SQLTYPE = {"string": "VARCHAR", "date": "DATE", "double": "DOUBLE", "bigint": "BIGINT"}
_ALIGN_COLS = ",\n       ".join(
    (f"CAST({_PRESENT[n]} AS {_SQLTYPE[t]}) AS {n}" if n in _PRESENT else f"CAST(NULL AS {_SQLTYPE[t]}) AS {n}")
    for n, t in dims.CANONICAL_COLUMNS)


@register("align_canonical", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + f"""
SELECT {_ALIGN_COLS}
FROM samples""")
def q_align_canonical(spark, sf_dir):
    return ingest.align_canonical(samples(spark, sf_dir))


@register("compute_yield", sql=with_fx("crop_production", extra=[PRODUCTION_SQL]) + f"""
SELECT record_id, target_crop, area_ha, production_tonnes, {rsql('yield_kg_ha', 6)} AS yield_kg_ha
FROM production""")
def q_compute_yield(spark, sf_dir):
    p = _production(spark, sf_dir)
    return p.select("record_id", "target_crop", "area_ha", "production_tonnes",
                    F.round("yield_kg_ha", 6).alias("yield_kg_ha"))


@register("yield_median_by_crop", sql=with_fx("crop_production", extra=[PRODUCTION_SQL, MEDIANS_SQL]) + f"""
SELECT target_crop, n_records, {rsql('yield_kg_ha_median', 6)} AS yield_kg_ha_median FROM medians""")
def q_yield_median_by_crop(spark, sf_dir):
    m = ingest.yield_median_by_crop(_production(spark, sf_dir))
    return m.select("target_crop", "n_records", F.round("yield_kg_ha_median", 6).alias("yield_kg_ha_median"))


@register("merge_median_yield", sql=with_fx("soil_samples", "crop_production",
                                             extra=[SAMPLES_SQL, PRODUCTION_SQL, MEDIANS_SQL]) + f"""
SELECT s.row_uid, s.target_crop, {rsql('m.yield_kg_ha_median', 6)} AS yield_kg_ha
FROM samples s LEFT JOIN medians m ON s.target_crop = m.target_crop""")
def q_merge_median_yield(spark, sf_dir):
    s = samples(spark, sf_dir).select("row_uid", "target_crop")
    out = ingest.merge_median_yield(s, ingest.yield_median_by_crop(_production(spark, sf_dir)))
    return out.select("row_uid", "target_crop", F.round("yield_kg_ha", 6).alias("yield_kg_ha"))


@register("crop_counts", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + """
SELECT target_crop, COUNT(*) AS n_samples FROM samples GROUP BY target_crop""")
def q_crop_counts(spark, sf_dir):
    return ingest.crop_counts(samples(spark, sf_dir))


@register("run_manifest", sql=with_fx("soil_samples", "crop_production",
                                       extra=[SAMPLES_SQL, PRODUCTION_SQL, MEDIANS_SQL]) + f"""
SELECT COUNT(*) AS num_samples, CAST(27 AS BIGINT) AS num_features,
       COUNT(DISTINCT s.target_crop) AS num_crops, COUNT(DISTINCT s.location_id) AS num_locations,
       STRING_AGG(DISTINCT s.target_crop, ',' ORDER BY s.target_crop) AS crops,
       {rsql('AVG(CASE WHEN m.yield_kg_ha_median IS NOT NULL THEN 1.0 ELSE 0.0 END)', 6)} AS yield_coverage
FROM samples s LEFT JOIN medians m ON s.target_crop = m.target_crop""")
def q_run_manifest(spark, sf_dir):
    s = samples(spark, sf_dir)
    merged = ingest.merge_median_yield(s, ingest.yield_median_by_crop(_production(spark, sf_dir)))
    return ingest.run_manifest(ingest.align_canonical(merged))


_TEXTS = ", ".join(f"COALESCE(CAST({n if t != 'double' else f'CAST({n} AS DECIMAL(30,6))'} AS VARCHAR), '~')" for n, t in dims.CANONICAL_COLUMNS)


@register("table_fingerprint", sql=with_fx("soil_samples", extra=[SAMPLES_SQL, f"aligned AS (SELECT {_ALIGN_COLS} FROM samples)"]) + f"""
SELECT COUNT(*) AS num_rows,
       CAST(SUM(CAST(CAST('0x' || substr(sha256(concat_ws('|', {_TEXTS})), 1, 15) AS BIGINT) AS HUGEINT)) % {2 ** 60} AS BIGINT) AS fingerprint
FROM aligned""")
def q_table_fingerprint(spark, sf_dir):
    return ingest.table_fingerprint(ingest.align_canonical(samples(spark, sf_dir)))


_ZCOLS = ["avg_temp_c", "humidity_pct", "avg_precip_mm", "pH"]
_ZSTATS = ", ".join(f"MEDIAN({c}) AS med_{c}" for c in _ZCOLS)
_ZFILL = ", ".join(f"COALESCE(s.{c}, m.med_{c}) AS {c}" for c in _ZCOLS)
_ZMOM = ", ".join(f"AVG({c}) AS mu_{c}, STDDEV_SAMP({c}) AS sd_{c}" for c in _ZCOLS)
_ZOUT = ", ".join(f"{rsql(f'(f.{c} - st.mu_{c}) / (st.sd_{c} + CAST(1e-08 AS DOUBLE))', 6)} AS {c}_z"
                  for c in _ZCOLS)


@register("zscore_features", sql=with_fx("soil_samples", extra=[SAMPLES_SQL, f"""med AS (SELECT {_ZSTATS} FROM samples)""",
                                                                  f"""filled AS (SELECT s.row_uid, {_ZFILL} FROM samples s, med m)""",
                                                                  f"""st AS (SELECT {_ZMOM} FROM filled)"""]) + f"""
SELECT f.row_uid, {_ZOUT} FROM filled f, st""")
def q_zscore_features(spark, sf_dir):
    z = ingest.zscore_features(samples(spark, sf_dir).select("row_uid", *_ZCOLS), _ZCOLS)
    return z.select("row_uid", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in _ZCOLS])


@register("stamp_samples", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + """
SELECT row_uid, substr(sha256(row_uid || '|' || CAST(location_id AS VARCHAR)), 1, 16) AS sample_id,
       DATE '2025-01-15' AS date, 'kaggle_expert_recommendation' AS label_source FROM samples""")
def q_stamp_samples(spark, sf_dir):
    """Ids from the row's key, so that a repeated load stamps the same."""
    s = ingest.stamp_samples(samples(spark, sf_dir), ["row_uid", "location_id"], AS_OF)
    return s.select("row_uid", "sample_id", "date", "label_source")
