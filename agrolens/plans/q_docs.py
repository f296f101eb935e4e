"""Documented-only operators (D2-D14) and seasonal weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import extras, features, ingest, location
from agrolens.plans.common import SAMPLES_SQL, d, rsql, samples
from agrolens.plans.oracle_fixtures import with_fx
from agrolens.plans.q_features import _bin_sql
from agrolens.plans.q_ingest import PRODUCTION_SQL
from agrolens.plans.registry import register
from agrolens.sources import dims, fixtures
from agrolens.sources.tables import table

_CELL = d(0.045)


@register("grid_location_id", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + f"""
SELECT row_uid, grid_y, grid_x, substr(sha256(CAST(grid_y AS VARCHAR) || ':' || CAST(grid_x AS VARCHAR)), 1, 16) AS grid_id
FROM (SELECT row_uid, CAST(FLOOR(latitude / {_CELL}) AS BIGINT) AS grid_y,
             CAST(FLOOR(longitude / {_CELL}) AS BIGINT) AS grid_x FROM samples)""")
def q_grid_location_id(spark, sf_dir):
    return extras.grid_location_id(samples(spark, sf_dir)).select("row_uid", "grid_y", "grid_x", "grid_id")


@register("pseudonymize", sql="""
SELECT sha256('agrolens-salt|' || CAST(c_custkey AS VARCHAR)) AS participant_id, c_nationkey, c_mktsegment FROM customer""")
def q_pseudonymize(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return extras.pseudonymize(c, "c_custkey", "agrolens-salt", ["c_name"]).select("participant_id", "c_nationkey", "c_mktsegment")


@register("k_anonymous_counts", sql="""
SELECT c_nationkey, c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1, 2 HAVING COUNT(*) >= 5""")
def q_k_anonymous_counts(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    p = extras.pseudonymize(c, "c_custkey", "agrolens-salt", ["c_name"])
    return extras.k_anonymous_counts(p, ["c_nationkey", "c_mktsegment"], 5)


@register("trial_outcomes", sql=with_fx("scored_requests") + f"""
SELECT arm, COUNT(*) AS n, {rsql('AVG(CASE WHEN actual_idx = pred_idx THEN 1.0 ELSE 0.0 END)', 6)} AS hit_rate,
       {rsql('AVG(latency_s)', 6)} AS mean_latency_s, COUNT(DISTINCT pred_idx) AS n_crops,
       {rsql('-SUM(CASE WHEN rn0 = 1 THEN p * LN(p) END)', 6)} AS crop_diversity
FROM (SELECT *, CAST(COUNT(*) OVER (PARTITION BY arm, pred_idx) AS DOUBLE) / COUNT(*) OVER (PARTITION BY arm) AS p,
             row_number() OVER (PARTITION BY arm, pred_idx) AS rn0 FROM scored_requests) t
GROUP BY arm""")
def q_trial_outcomes(spark, sf_dir):
    """Per trial arm: size, hit rate, mean latency, distinct crops and
    Shannon diversity of recommended crops (counts joined, no window)."""
    r = fixtures.scored_requests(spark, sf_dir)
    per = r.groupBy("arm", "pred_idx").agg(F.count("*").alias("c"))
    tot = per.groupBy("arm").agg(F.sum("c").alias("t"))
    div = per.join(tot, "arm").withColumn("p", F.col("c") / F.col("t")).groupBy("arm").agg(
        F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("crop_diversity"))
    base = r.groupBy("arm").agg(F.count("*").alias("n"),
                                F.round(F.avg((F.col("actual_idx") == F.col("pred_idx")).cast("double")), 6).alias("hit_rate"),
                                F.round(F.avg("latency_s"), 6).alias("mean_latency_s"),
                                F.countDistinct("pred_idx").alias("n_crops"))
    return base.join(div, "arm")


@register("outlier_filter", sql=with_fx("crop_production", extra=[PRODUCTION_SQL, """m AS (
  SELECT target_crop, MEDIAN(yield_kg_ha) AS med FROM production WHERE yield_kg_ha IS NOT NULL GROUP BY 1
)""", """mad AS (
  SELECT p.target_crop, MEDIAN(ABS(p.yield_kg_ha - m.med)) AS mad
  FROM production p JOIN m USING (target_crop) WHERE p.yield_kg_ha IS NOT NULL GROUP BY 1
)"""]) + f"""
SELECT p.record_id, p.target_crop, {rsql('p.yield_kg_ha', 6)} AS yield_kg_ha
FROM production p JOIN m USING (target_crop) JOIN mad USING (target_crop)
WHERE p.yield_kg_ha IS NOT NULL AND ABS(p.yield_kg_ha - m.med) <= {d(3.0 * 1.4826)} * mad.mad""")
def q_outlier_filter(spark, sf_dir):
    p = ingest.production_canonical(fixtures.crop_production(spark, sf_dir))
    f = extras.outlier_filter(p.select("record_id", "target_crop", "yield_kg_ha"), "target_crop", "yield_kg_ha")
    return f.select("record_id", "target_crop", F.round("yield_kg_ha", 6).alias("yield_kg_ha"))


@register("seasonal_weather", sql=with_fx("weather_daily") + f"""
SELECT location_id, {rsql('AVG(t_mean)', 1)} AS avg_temp_c, {rsql('AVG(humidity)', 1)} AS humidity_pct,
       COUNT(t_mean) AS data_points
FROM weather_daily WHERE month(d) >= 11 OR month(d) <= 3 GROUP BY location_id""")
def q_seasonal_weather(spark, sf_dir):
    """A14 (with the real month filter): rabi-season normals."""
    w = location.season_filter(fixtures.weather_daily(spark, sf_dir), "rabi")
    return location.weather_normals(w).select("location_id", "avg_temp_c", "humidity_pct", "data_points")


_RAIN = next(b for b in dims.BINS if b[1] == "rainfall_bin")


@register("drift_psi", sql=with_fx("soil_samples", extra=[SAMPLES_SQL, f"""b AS (
  SELECT date < DATE '1998-01-01' AS is_ref, {_bin_sql('avg_precip_mm', _RAIN[2], _RAIN[3])} AS rainfall_bin FROM samples
)""", f"""dist AS (
  SELECT COALESCE(r.rainfall_bin, c.rainfall_bin) AS bin, COALESCE(r.p, 0) + {d(1e-06)} AS p, COALESCE(c.q, 0) + {d(1e-06)} AS q
  FROM (SELECT rainfall_bin, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS p FROM b WHERE is_ref GROUP BY 1) r
  FULL OUTER JOIN (SELECT rainfall_bin, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS q FROM b WHERE NOT is_ref GROUP BY 1) c
  ON r.rainfall_bin = c.rainfall_bin
)"""]) + f"""
SELECT {rsql('SUM((q - p) * LN(q / p))', 6)} AS psi, {rsql('SUM(p * LN(p / q))', 6)} AS kl FROM dist""")
def q_drift_psi(spark, sf_dir):
    """Rainfall-bin drift between samples before 1998 and from 1998 on."""
    b = features.add_bins(samples(spark, sf_dir)).select("date", "rainfall_bin")
    return extras.psi(b, F.col("date") < F.lit("1998-01-01").cast("date"), "rainfall_bin")
