"""Merged tables, the field trial, the fitted encoder and the location job."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import export, features, location, location_job, payloads, seasonal, trial
from agrolens.plans import q_location as ql
from agrolens.plans import q_ml
from agrolens.plans import q_payloads as qp
from agrolens.plans.common import AS_OF, SAMPLES_SQL, d, rsql, samples
from agrolens.plans.oracle_fixtures import with_fx
from agrolens.plans.q_features import _bin_sql
from agrolens.plans.q_ingest import PRODUCTION_SQL, _production
from agrolens.plans.registry import REGISTRY, register
from agrolens.sources import dims, fixtures

_NAMES = ", ".join(f"('{c}', '{m}')" for c, m in dims.CROP_TO_COMMODITY.items())
_COVERS = ", ".join(f"('{t}', '{s}')" for t, names in seasonal.COVERS.items() for s in names)


def _season_sql(day: str) -> str:
    return (f"CASE WHEN month({day}) BETWEEN 6 AND 10 THEN 'kharif' WHEN month({day}) IN (4, 5) THEN 'zaid' ELSE 'rabi' END AS season, "
            f"CAST(year({day}) - CASE WHEN month({day}) <= 3 THEN 1 ELSE 0 END AS INTEGER) AS season_year")


def _sum(col: str) -> str:
    return f"CAST(SUM(CAST({col} AS DECIMAL(38,6))) AS DOUBLE)"


@register("merge_location_season_crop", sql=with_fx("crop_production", "weather_daily", "mandi_prices", "soil_values", extra=[
    PRODUCTION_SQL, ql._SOIL_SQL, f"veg AS ({REGISTRY['vegetation_score'].sql})", f"""base AS (
  SELECT CAST(substr(district, 10) AS BIGINT) % 20 AS location_id, c.season, p.year AS season_year, target_crop AS crop, COUNT(*) AS n_records,
         {_sum('area_ha')} AS area, {_sum('production_tonnes')} AS made
  FROM production p JOIN (VALUES {_COVERS}) AS c(text, season) ON lower(trim(p.season)) = c.text WHERE target_crop IS NOT NULL GROUP BY ALL
)""", f"""w AS (
  SELECT location_id, season, season_year, {_sum('t_mean')} AS t, COUNT(t_mean) AS tn, {_sum('precip')} AS rain, COUNT(*) AS days
  FROM (SELECT *, {_season_sql('d')} FROM weather_daily) GROUP BY ALL
)""", f"""wn AS (SELECT location_id, season, {_sum('t')} AS t, SUM(tn) AS tn, {_sum('rain')} AS rain, COUNT(*) AS years FROM w GROUP BY ALL)""", f"""p AS (
  SELECT season, season_year, crop, {_sum('modal')} AS p, COUNT(*) AS pn
  FROM (SELECT n.crop, TRY_CAST(modal_price AS DOUBLE) AS modal, {_season_sql('arrival_date')} FROM mandi_prices m JOIN (VALUES {_NAMES}) AS n(crop, commodity) USING (commodity))
  WHERE modal > 0 GROUP BY ALL
)""", f"pn AS (SELECT season, crop, {_sum('p')} AS p, SUM(pn) AS pn FROM p GROUP BY ALL)"]) + f"""
SELECT b.location_id, b.season, b.season_year, b.crop, b.n_records, {rsql(f'CASE WHEN b.area <> 0 THEN b.made * {d(1000.0)} / b.area END', 4)} AS yield_kg_ha,
       {rsql('CASE WHEN w.days IS NOT NULL THEN CASE WHEN w.tn > 0 THEN w.t / w.tn END WHEN wn.tn > 0 THEN wn.t / wn.tn END', 4)} AS avg_temp_c,
       {rsql('CASE WHEN w.days IS NOT NULL THEN w.rain ELSE wn.rain / wn.years END', 4)} AS season_rain_mm,
       CASE WHEN w.days IS NOT NULL THEN 'year' WHEN wn.years IS NOT NULL THEN 'normal' END AS weather_source,
       s.pH, s.N_kg_ha, s.P_kg_ha, s.K_kg_ha, v.vegetation_score,
       {rsql('COALESCE(p.p / p.pn, pn.p / pn.pn)', 4)} AS price_per_quintal,
       CASE WHEN p.pn IS NOT NULL THEN 'year' WHEN pn.pn IS NOT NULL THEN 'normal' END AS price_source
FROM base b LEFT JOIN w USING (location_id, season, season_year) LEFT JOIN wn ON wn.location_id = b.location_id AND wn.season = b.season
LEFT JOIN soil s ON s.location_id = b.location_id LEFT JOIN veg v ON v.location_id = b.location_id
LEFT JOIN p ON p.season = b.season AND p.season_year = b.season_year AND p.crop = b.crop LEFT JOIN pn ON pn.season = b.season AND pn.crop = b.crop""")
def q_merge_location_season_crop(spark, sf_dir):
    """The 40 districts of the production records are dealt onto the 20 weather locations."""
    made = _production(spark, sf_dir).withColumn("location_id", F.pmod(F.substring("district", 10, 20).cast("bigint"), F.lit(20)))
    soil = location.soil_record(location.parse_soil(fixtures.soil_payloads(spark, sf_dir)))
    names = spark.createDataFrame(list(dims.CROP_TO_COMMODITY.items()), "crop string, commodity string")
    prices = fixtures.mandi_prices(spark, sf_dir).join(F.broadcast(names), "commodity").select("crop", "arrival_date", F.col("modal_price").try_cast("double").alias("modal"))
    return seasonal.merge_location_season_crop(made, fixtures.weather_daily(spark, sf_dir), soil, payloads.vegetation_score(qp.vegetation_payloads(spark, sf_dir)), prices)


_ARMS = """arms AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY zone, irrigated ORDER BY sha256('42|' || CAST(cluster_id AS VARCHAR)), cluster_id) % 2 = 1 THEN 'treatment' ELSE 'control' END AS arm
  FROM (SELECT DISTINCT cluster_id, zone, irrigated FROM trial_harvests)
)"""


def _assigned(spark, sf_dir):
    return trial.assign(fixtures.trial_harvests(spark, sf_dir), "cluster_id", ["zone", "irrigated"])


@register("trial_assignment", sql=with_fx("trial_harvests", extra=[_ARMS]) + "SELECT * FROM arms")
def q_trial_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)


_TOP3 = "((chosen_idx - recommended_idx + 22) % 22 <= 2)"
_MEASURES = {"yield_kg_ha": "yield_kg_ha", "net_income": "revenue - input_cost", "adherence": "CAST(chosen_idx = recommended_idx AS DOUBLE)", "top3_hit": f"CAST({_TOP3} AS DOUBLE)"}
_LONG = " UNION ALL ".join(f"SELECT arm, cluster_id, '{m}' AS measure, CAST({e} AS DOUBLE) AS v FROM trial_harvests JOIN arms USING (cluster_id)" for m, e in _MEASURES.items())


@register("trial_effects", sql=with_fx("trial_harvests", extra=[_ARMS, f"""c AS (
  SELECT measure, arm, cluster_id, SUM(v) AS s, COUNT(v) AS n FROM ({_LONG}) WHERE v IS NOT NULL GROUP BY ALL
)""", "m AS (SELECT measure, arm, SUM(s) / SUM(n) AS mean, SUM(n) AS rows, COUNT(*) AS g FROM c GROUP BY ALL)", """a AS (
  SELECT measure, arm, ANY_VALUE(mean) AS mean, ANY_VALUE(rows) AS rows, ANY_VALUE(g) AS g,
         CASE WHEN ANY_VALUE(g) > 1 THEN CAST(ANY_VALUE(g) AS DOUBLE) / (ANY_VALUE(g) - 1) * SUM((s - n * mean) * (s - n * mean)) / (CAST(ANY_VALUE(rows) AS DOUBLE) * ANY_VALUE(rows)) END AS var
  FROM c JOIN m USING (measure, arm) GROUP BY ALL
)"""]) + f"""
SELECT t.measure, {rsql('t.mean', 4)} AS treatment_mean, {rsql('k.mean', 4)} AS control_mean, CAST(t.rows AS BIGINT) AS treatment_rows, t.g AS treatment_clusters,
       CAST(k.rows AS BIGINT) AS control_rows, k.g AS control_clusters, {rsql('t.mean - k.mean', 4)} AS difference,
       {rsql(f't.mean - k.mean - {d(trial.Z95)} * sqrt(t.var + k.var)', 4)} AS ci_low, {rsql(f't.mean - k.mean + {d(trial.Z95)} * sqrt(t.var + k.var)', 4)} AS ci_high
FROM a t JOIN a k USING (measure) WHERE t.arm = 'treatment' AND k.arm = 'control'""")
def q_trial_effects(spark, sf_dir):
    h = fixtures.trial_harvests(spark, sf_dir)
    return trial.effects(h, _assigned(spark, sf_dir), "cluster_id", {m: F.expr(e) for m, e in _MEASURES.items()})


_BINS_SQL = ", ".join(f"{_bin_sql(src, edges, labels)} AS {out}" for src, out, edges, labels in dims.BINS)
_LISTED = "[" + ", ".join(f"'{out}_' || {out}" for _, out, _, _ in dims.BINS) + "]"


@register("onehot_fitted", sql=with_fx("soil_samples", extra=[SAMPLES_SQL, f"b AS (SELECT row_uid, location_id, {_BINS_SQL} FROM samples)",
                                                              f"fitted AS (SELECT DISTINCT unnest({_LISTED}) AS name FROM b WHERE location_id < 3)"]) + f"""
SELECT row_uid, array_to_string(list_sort(list_filter({_LISTED}, lambda x: list_contains(names, x))), ',') AS indicators
FROM b CROSS JOIN (SELECT list(name) AS names FROM fitted) WHERE location_id >= 3""")
def q_onehot_fitted(spark, sf_dir):
    """The encoder fitted on three locations, applied to the others; the names of a row's indicators that are set."""
    b = features.add_bins(samples(spark, sf_dir)).select("row_uid", "location_id", *[out for _, out, _, _ in dims.BINS])
    fitted = features.fit_onehot(b.where("location_id < 3"))
    x = features.transform_onehot(b.where("location_id >= 3"), fitted)
    names = F.array_compact(F.array(*[F.when(F.col(f"`{n}`") == 1.0, F.lit(n)) for n in fitted]))
    return x.select("row_uid", F.array_join(F.array_sort(names), ",").alias("indicators"))


def _rules_rec(spark, sf_dir):
    return ql.q_recommend_by_location(spark, sf_dir)


def location_run(spark, sf_dir, mode: str, recommend=_rules_rec):
    """The location job over FX4 with the recommender ``recommend`` (location_id, rank, crop, probability), or none."""
    rec = recommend and (lambda: recommend(spark, sf_dir))
    resolved = lambda: ql._resolved(spark, sf_dir)

    def boosted():
        return export.export_scores(spark, resolved().where(F.col("error").isNull()), AS_OF, recommended=rec().select("location_id", "rank", "crop"))

    return location_job.run(mode, resolved, lambda: qp.q_location_profile_full(spark, sf_dir), rec, boosted if rec else None)


@register("location_dry_run", sql=f"SELECT location_id, latitude, longitude, state, display_name FROM ({REGISTRY['resolve_locations'].sql}) WHERE error IS NULL")
def q_location_dry_run(spark, sf_dir):
    return location_run(spark, sf_dir, "dry_run")


_FULL = REGISTRY["location_profile_full"].sql


@register("location_data_only", sql=f"SELECT *, CAST(NULL AS VARCHAR) AS recommended, best_export AS refined_export, export_score AS refined_score FROM ({_FULL})")
def q_location_data_only(spark, sf_dir):
    return location_run(spark, sf_dir, "data_only")


@register("location_full_run", sql=f"""WITH prof AS ({_FULL}), recs AS ({REGISTRY['recommend_by_location'].sql}), better AS ({REGISTRY['export_scores_boosted'].sql})
SELECT p.*, r.recommended, COALESCE(b.crop, p.best_export) AS refined_export, COALESCE(b.export_score, p.export_score) AS refined_score
FROM prof p LEFT JOIN (SELECT location_id, string_agg(crop || ':' || printf('%.4f', probability), '|' ORDER BY rank) AS recommended FROM recs GROUP BY 1) r USING (location_id)
LEFT JOIN (SELECT * FROM better WHERE rank = 1 AND export_score <> 0) b USING (location_id)""")
def q_location_full_run(spark, sf_dir):
    return location_run(spark, sf_dir, "full_run")


@register("recommend_by_location_model", note="model output: rows-only check")
def q_recommend_by_location_model(spark, sf_dir):
    """M15 with the stored classifier: top-3 crops, probability, yield and version for each location's profile."""
    model, saved, _ = q_ml._classifier(spark, sf_dir)
    p = ql.model_inputs(spark, sf_dir)
    got = q_ml.serving.recommend(p, ["location_id"], model, saved, q_ml._medians(spark, sf_dir))
    return got.select("location_id", "model_version", F.posexplode("top").alias("pos", "t")).select(
        "location_id", (F.col("pos") + 1).cast("int").alias("rank"), "t.crop", "t.probability", "t.expected_yield_kg_ha", "model_version")


@register("location_full_run_model", note="model output: rows-only check")
def q_location_full_run_model(spark, sf_dir):
    """M15 + E8 + R6: the whole job with the stored classifier's recommendations."""
    return location_run(spark, sf_dir, "full_run", q_recommend_by_location_model)
