"""Location, soil, weather, market and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import export, location
from agrolens.plans.common import AS_OF, d, rsql
from agrolens.plans.oracle_fixtures import dim_cte, with_fx
from agrolens.plans.registry import register
from agrolens.sources import dims, fixtures

MONTH = export.target_month(AS_OF)

RESOLVE_SQL = [r"""cl AS (
  SELECT location_id, location AS raw_input, regexp_replace(location, '^\s+|\s+$', '', 'g') AS loc FROM locations_raw
)""", r"""k AS (
  SELECT *, CASE WHEN loc = '' THEN 'empty' WHEN regexp_matches(loc, '^\d{6}$') THEN 'pin'
                 WHEN regexp_matches(loc, '^-?\d+\.?\d*\s*,\s*-?\d+\.?\d*$') THEN 'coords'
                 ELSE 'unrecognised' END AS kind
  FROM cl
)""", r"""p AS (
  SELECT k.*, CASE WHEN kind = 'coords' THEN TRY_CAST(regexp_replace(split_part(loc, ',', 1), '^\s+|\s+$', '', 'g') AS DOUBLE) END AS clat,
         CASE WHEN kind = 'coords' THEN TRY_CAST(regexp_replace(split_part(loc, ',', 2), '^\s+|\s+$', '', 'g') AS DOUBLE) END AS clon,
         dir.pin IS NOT NULL AS found, dir.lat AS plat, dir.lon AS plon, dir.state AS pstate,
         dir.district AS pdist, dir.place AS pplace
  FROM k LEFT JOIN pin_directory dir ON dir.pin = k.loc
)""", """r AS (
  SELECT *, CASE WHEN kind = 'empty' THEN 'location string is empty'
                 WHEN kind = 'unrecognised' THEN 'unrecognized location format'
                 WHEN kind = 'pin' AND NOT found THEN 'could not geocode PIN code'
                 WHEN kind = 'coords' AND (clat < -90 OR clat > 90) THEN 'latitude out of range'
                 WHEN kind = 'coords' AND (clon < -180 OR clon > 180) THEN 'longitude out of range' END AS error
  FROM p
)""", """resolved AS (
  SELECT location_id, raw_input, kind,
         CASE WHEN error IS NULL THEN CASE WHEN kind = 'pin' THEN plat ELSE clat END END AS latitude,
         CASE WHEN error IS NULL THEN CASE WHEN kind = 'pin' THEN plon ELSE clon END END AS longitude,
         CASE WHEN error IS NULL AND kind = 'pin' THEN pstate END AS state,
         CASE WHEN error IS NULL AND kind = 'pin' THEN pdist END AS district,
         CASE WHEN error IS NULL AND kind = 'pin' THEN loc END AS pin_code,
         CASE WHEN error IS NULL THEN CASE WHEN kind = 'pin' THEN concat_ws(', ', pplace, pdist, pstate, 'India')
                                           ELSE printf('%.4f, %.4f', clat, clon) END END AS display_name,
         error
  FROM r
)"""]
_LOC_FX = with_fx("locations_raw", "pin_directory", extra=RESOLVE_SQL)


def _resolved(spark, sf_dir):
    return location.resolve_locations(fixtures.locations_raw(spark, sf_dir), fixtures.pin_directory(spark, sf_dir))


@register("classify_location", sql=_LOC_FX + "SELECT location_id, kind FROM k")
def q_classify_location(spark, sf_dir):
    return location.classify_location(fixtures.locations_raw(spark, sf_dir)).select("location_id", "kind")


@register("resolve_locations", sql=_LOC_FX + "SELECT * FROM resolved")
def q_resolve_locations(spark, sf_dir):
    return _resolved(spark, sf_dir)


@register("location_quarantine", sql=_LOC_FX + "SELECT location_id, raw_input, error FROM resolved WHERE error IS NOT NULL")
def q_location_quarantine(spark, sf_dir):
    return _resolved(spark, sf_dir).where(F.col("error").isNotNull()).select("location_id", "raw_input", "error")


_HAV = ("{R} * (atan2(sqrt(a), sqrt({one} - a)) * 2)").format(R=d(6371.0), one=d(1.0))
PORT_SQL = [dim_cte("port"), f"""pd AS (
  SELECT location_id, port_idx, name, type, cold_storage, raw_km * {d(1.3)} AS road
  FROM (
    SELECT v.location_id, p.*, {_HAV} AS raw_km
    FROM (SELECT v.location_id, p.port_idx,
                 POW(SIN((p.lat - v.latitude) * {d(3.141592653589793 / 180.0)} / 2), 2)
                 + COS(v.latitude * {d(3.141592653589793 / 180.0)}) * COS(p.lat * {d(3.141592653589793 / 180.0)})
                   * POW(SIN((p.lon - v.longitude) * {d(3.141592653589793 / 180.0)} / 2), 2) AS a
          FROM resolved v CROSS JOIN port p WHERE v.error IS NULL) v
    JOIN port p USING (port_idx))
)""", f"""pr AS (
  SELECT *, {rsql('road', 0)} AS distance_km, {rsql(f'road / {d(40.0)}', 1)} AS transit_hours,
         row_number() OVER (PARTITION BY location_id ORDER BY {rsql('road', 0)}, port_idx) AS port_rank
  FROM pd
)"""]


@register("nearest_ports", sql=with_fx("locations_raw", "pin_directory", extra=RESOLVE_SQL + PORT_SQL) + """
SELECT location_id, CAST(port_rank AS INTEGER) AS port_rank, name, distance_km, transit_hours
FROM pr WHERE port_rank <= 3""")
def q_nearest_ports(spark, sf_dir):
    r = export.with_nearest_ports(_resolved(spark, sf_dir).where(F.col("error").isNull()), 3)
    return r.select("location_id", F.posexplode("ports").alias("i", "p")).select(
        "location_id", (F.col("i") + 1).cast("int").alias("port_rank"), F.col("p.name").alias("name"),
        F.col("p.distance_km").alias("distance_km"), F.col("p.transit_hours").alias("transit_hours"))


def _regional_sql():
    return dim_cte("state_crop")


@register("regional_crops", sql=with_fx("locations_raw", "pin_directory",
                                         extra=RESOLVE_SQL + [_regional_sql(), dim_cte("season_label")]) + """
SELECT v.location_id, c.crop, c.season, CAST(c.rank AS INTEGER) AS rank, COALESCE(l.label, c.season) AS season_label
FROM resolved v JOIN state_crop c ON lower(c.state) = lower(v.state)
LEFT JOIN season_label l ON l.season = c.season
WHERE v.error IS NULL""")
def q_regional_crops(spark, sf_dir):
    """J4 + P27: crops grown in the location's state, with a readable season."""
    r = _resolved(spark, sf_dir).where(F.col("error").isNull())
    sc = F.broadcast(spark.createDataFrame(
        [(s.lower(), c, season, rank) for s, lst in dims.STATE_CROPS.items() for c, season, rank in lst],
        "_sl string, crop string, season string, rank int"))
    lab = F.broadcast(spark.createDataFrame(list(dims.SEASON_LABELS.items()), "season string, _label string"))
    out = r.join(sc, F.lower(r["state"]) == sc["_sl"]).join(lab, "season", "left")
    return out.select("location_id", "crop", "season", "rank",
                      F.coalesce("_label", "season").alias("season_label"))


_TARGETS = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(dims.DEFAULT_TARGET_CROPS)) + ") AS t(pos, crop)"
_NT = len(dims.DEFAULT_TARGET_CROPS)
_KNOWN_STATES = "(VALUES " + ", ".join(f"('{s}')" for s in dims.STATE_SUITABILITY) + ") AS ks(s)"


def _wrap(k):
    return (MONTH - 1 + k) % 12 + 1


EXPORT_SQL = RESOLVE_SQL + PORT_SQL + [
    dim_cte("state_crop"), dim_cte("export_stats"), dim_cte("state_suitability"), dim_cte("default_suitability"),
    "rec AS (SELECT CAST(NULL AS BIGINT) AS location_id, CAST(NULL AS VARCHAR) AS crop, 0 AS rk, TRUE AS hit WHERE FALSE)",
    f"""cand AS (
  SELECT location_id, crop, MIN(pos) AS pos FROM (
    SELECT v.location_id, t.crop, t.pos FROM resolved v CROSS JOIN {_TARGETS} WHERE v.error IS NULL
    UNION ALL
    SELECT v.location_id, c.crop, {_NT} + c.rank - 1 FROM resolved v JOIN state_crop c ON lower(c.state) = lower(v.state)
    WHERE v.error IS NULL AND c.rank <= 5
    UNION ALL
    SELECT v.location_id, r.crop, 1000 + r.rk FROM resolved v JOIN rec r ON r.location_id = v.location_id WHERE v.error IS NULL
  ) GROUP BY location_id, crop
)""", f"""scored AS (
  SELECT c.location_id, c.crop, s.*, v.state, n.name AS nearest_port, n.distance_km, n.transit_hours,
         n.type AS port_type, n.cold_storage AS port_cold,
         CAST(CASE WHEN v.state IS NULL OR v.state = '' THEN COALESCE(ds.score, 50)
                   WHEN lower(v.state) IN (SELECT s FROM {_KNOWN_STATES}) THEN COALESCE(ss.score, 45)
                   ELSE COALESCE(ds.score, 45) END AS INTEGER) AS suitability_score,
         GREATEST({d(5.0)}, LEAST({d(100.0)}, {d(40.0)} + s.quarterly_growth_pct * {d(2.0)})) AS demand_score,
         CASE s.price_trend WHEN 'rising' THEN {d(85.0)} WHEN 'stable' THEN {d(50.0)} WHEN 'falling' THEN {d(15.0)}
              ELSE {d(50.0)} END AS price_score,
         GREATEST({d(0.0)}, LEAST({d(100.0)}, GREATEST({d(0.0)}, {d(100.0)} - n.distance_km / {d(20.0)})
              + CASE WHEN s.cold_chain_required AND NOT n.cold_storage THEN {d(-25.0)} ELSE {d(0.0)} END
              + CASE WHEN n.type = 'container' THEN {d(10.0)} ELSE {d(0.0)} END)) AS logistics_score,
         CASE WHEN len(s.peak_export_months) = 0 THEN {d(40.0)}
              WHEN list_contains(s.peak_export_months, {MONTH}) THEN {d(90.0)}
              WHEN list_contains(s.peak_export_months, {_wrap(1)}) THEN {d(60.0)}
              WHEN list_contains(s.peak_export_months, {_wrap(-1)}) OR list_contains(s.peak_export_months, {_wrap(2)})
                   THEN {d(35.0)}
              ELSE {d(15.0)} END AS timing_score,
         CASE s.phytosanitary_complexity WHEN 'low' THEN {d(90.0)} WHEN 'medium' THEN {d(60.0)}
              WHEN 'high' THEN {d(30.0)} ELSE {d(60.0)} END AS regulatory_score
  FROM cand c JOIN export_stats s ON s.crop = c.crop
  JOIN resolved v ON v.location_id = c.location_id
  JOIN pr n ON n.location_id = c.location_id AND n.port_rank = 1
  LEFT JOIN state_suitability ss ON ss.state = lower(v.state) AND ss.crop = lower(c.crop)
  LEFT JOIN default_suitability ds ON ds.crop = lower(c.crop)
)""", f"""totals AS (
  SELECT *, CASE WHEN ml THEN LEAST({d(100.0)}, base + {d(15.0)}) ELSE base END AS total FROM (
    SELECT sc.*, COALESCE(rc.hit, FALSE) AS ml,
           ({d(0.35)} * demand_score + {d(0.2)} * price_score + {d(0.2)} * {rsql('logistics_score', 1)}
             + {d(0.15)} * timing_score + {d(0.1)} * regulatory_score)
            * CASE WHEN suitability_score < 40 THEN {d(0.3)} WHEN suitability_score < 60 THEN {d(0.7)} ELSE {d(1.0)} END
            AS base
    FROM scored sc LEFT JOIN rec rc ON rc.location_id = sc.location_id AND rc.crop = lower(sc.crop))
)""", f"""final AS (
  SELECT location_id, crop, {rsql('total', 1)} AS export_score, {rsql('demand_score', 1)} AS demand_score,
         {rsql('price_score', 1)} AS price_score, {rsql('logistics_score', 1)} AS logistics_score,
         {rsql('timing_score', 1)} AS timing_score, {rsql('regulatory_score', 1)} AS regulatory_score,
         suitability_score, ml AS ml_recommended, {rsql(f'LEAST({d(92.0)}, total * {d(0.92)})', 1)} AS confidence,
         nearest_port, distance_km AS port_distance_km, CAST(avg_price_usd_ton AS BIGINT) AS avg_price_usd_ton,
         cold_chain_required, processing_required, certification_days,
         concat_ws(' | ',
           CASE WHEN quarterly_growth_pct > 5 THEN 'Strong export demand (+' || CAST(quarterly_growth_pct AS VARCHAR) || '% q/q)'
                WHEN quarterly_growth_pct > 0 THEN 'Positive export demand (+' || CAST(quarterly_growth_pct AS VARCHAR) || '% q/q)'
                ELSE 'Moderate export demand (' || CAST(quarterly_growth_pct AS VARCHAR) || '% q/q)' END,
           CASE WHEN len(top_destinations) > 0 THEN 'Key markets: ' || array_to_string(top_destinations[1:3], ', ') END,
           'Port: ' || nearest_port || ' (' || CAST(CAST(distance_km AS BIGINT) AS VARCHAR) || ' km, ~'
             || CAST(CAST(round_even(transit_hours, 0) AS BIGINT) AS VARCHAR) || ' hrs)',
           CASE WHEN avg_price_usd_ton <> 0 THEN 'Export price: $' || CAST(avg_price_usd_ton AS VARCHAR) || '/ton ('
                || price_trend || ')' END,
           CASE WHEN harvest_to_export_weeks <> 0 THEN 'Harvest to export: ~' || CAST(harvest_to_export_weeks AS VARCHAR)
                || ' weeks' END,
           CASE WHEN ml THEN 'Soil & climate suitable for this location (AI-verified)' END,
           CASE WHEN suitability_score >= 70 THEN 'Agroclimatic suitability: High (' || CAST(suitability_score AS VARCHAR) || '/100)'
                WHEN suitability_score >= 50 THEN 'Agroclimatic suitability: Moderate (' || CAST(suitability_score AS VARCHAR) || '/100)'
                END) AS reason
  FROM totals
)""", """ranked_exports AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY location_id ORDER BY export_score DESC, crop) AS INTEGER) AS rank
  FROM final
)"""]
_EXP_FX = with_fx("locations_raw", "pin_directory", extra=EXPORT_SQL)


def _export_scores(spark, sf_dir):
    r = _resolved(spark, sf_dir).where(F.col("error").isNull())
    return export.export_scores(spark, r, AS_OF)


@register("export_scores", sql=_EXP_FX + "SELECT * FROM ranked_exports")
def q_export_scores(spark, sf_dir):
    return _export_scores(spark, sf_dir)


@register("export_best", sql=_EXP_FX + "SELECT * FROM ranked_exports WHERE rank = 1 AND export_score <> 0")
def q_export_best(spark, sf_dir):
    return export.export_best(_export_scores(spark, sf_dir))


@register("candidate_crops", sql=_EXP_FX + "SELECT location_id, crop, row_number() OVER (PARTITION BY location_id ORDER BY pos) - 1 AS pos FROM cand")
def q_candidate_crops(spark, sf_dir):
    r = _resolved(spark, sf_dir).where(F.col("error").isNull())
    return export.candidate_crops(spark, r).select("location_id", "crop", F.col("pos").cast("bigint").alias("pos"))


# ---- weather ----------------------------------------------------------------

_END = f"(CAST('{AS_OF}' AS DATE) - 5)"
WEATHER_SQL = [f"""wx AS (
  SELECT * FROM weather_daily WHERE d BETWEEN {_END} - {365 * 3} AND {_END}
)"""]


@register("weather_normals", sql=with_fx("weather_daily", extra=WEATHER_SQL) + f"""
SELECT location_id, {rsql('AVG(t_mean)', 1)} AS avg_temp_c, {rsql('AVG(t_max)', 1)} AS temp_max_c,
       {rsql('AVG(t_min)', 1)} AS temp_min_c, {rsql('AVG(humidity)', 1)} AS humidity_pct,
       {rsql(f'SUM(precip) / GREATEST({d(1.0)}, COUNT(precip) / {d(365.0)})', 1)} AS avg_precip_mm,
       COUNT(t_mean) AS data_points
FROM wx GROUP BY location_id""")
def q_weather_normals(spark, sf_dir):
    daily = location.weather_window(fixtures.weather_daily(spark, sf_dir), AS_OF)
    return location.weather_normals(daily)


@register("growing_degree_days", sql=with_fx("weather_daily") + f"""
SELECT location_id, {rsql(f'SUM(GREATEST(t_mean - {d(10.0)}, {d(0.0)}))', 4)} AS gdd
FROM weather_daily GROUP BY location_id""")
def q_growing_degree_days(spark, sf_dir):
    return location.growing_degree_days(fixtures.weather_daily(spark, sf_dir), 10.0)


# ---- market -----------------------------------------------------------------

@register("latest_price", sql=with_fx("mandi_prices") + """
SELECT state, commodity, arrival_date, record_id, modal AS modal_price_per_quintal,
       TRY_CAST(min_price AS DOUBLE) AS min_price_per_quintal, TRY_CAST(max_price AS DOUBLE) AS max_price_per_quintal,
       market
FROM (SELECT *, TRY_CAST(modal_price AS DOUBLE) AS modal,
             row_number() OVER (PARTITION BY state, commodity ORDER BY arrival_date DESC, record_id) AS rn
      FROM mandi_prices WHERE TRY_CAST(modal_price AS DOUBLE) > 0)
WHERE rn = 1""")
def q_latest_price(spark, sf_dir):
    return location.latest_prices(fixtures.mandi_prices(spark, sf_dir))


# ---- soil -------------------------------------------------------------------

@register("soil_profile", sql=with_fx("soil_values") + f"""
SELECT location_id,
       CASE WHEN empty_payload THEN {d(6.5)} ELSE phh2o / {d(10.0)} END AS pH,
       CASE WHEN empty_payload THEN {d(50.0)}
            ELSE {rsql(f'GREATEST({d(5.0)}, LEAST(nitrogen / {d(100.0)} * {d(1950.0)} * {d(0.03)}, {d(400.0)}))', 1)} END AS N_kg_ha,
       CASE WHEN empty_payload THEN {d(25.0)}
            ELSE {rsql(f'GREATEST({d(3.0)}, LEAST(soc / {d(10.0)} * {d(2.5)} + {d(5.0)}, {d(200.0)}))', 1)} END AS P_kg_ha,
       CASE WHEN empty_payload THEN {d(25.0)}
            ELSE {rsql(f'GREATEST({d(5.0)}, LEAST(cec / {d(10.0)} * {d(0.03)} * {d(39.1)} * {d(20.0)}, {d(400.0)}))', 1)} END AS K_kg_ha,
       CASE WHEN empty_payload THEN NULL ELSE clay / {d(10.0)} END AS clay_pct,
       CASE WHEN empty_payload THEN NULL ELSE soc / {d(10.0)} END AS soc_g_kg,
       CASE WHEN empty_payload THEN 'defaults' ELSE 'soilgrids' END AS source
FROM soil_values""")
def q_soil_profile(spark, sf_dir):
    return location.soil_record(location.parse_soil(fixtures.soil_payloads(spark, sf_dir)))


# ---- location profile and recommendation by location -------------------------

def _profile(spark, sf_dir):
    r = _resolved(spark, sf_dir).where(F.col("error").isNull())
    soil = location.soil_record(location.parse_soil(fixtures.soil_payloads(spark, sf_dir)))
    wx = location.weather_normals(location.weather_window(fixtures.weather_daily(spark, sf_dir), AS_OF))
    return location.location_profile(r, soil, wx)


def model_inputs(spark, sf_dir):
    """A profile's fields under their canonical names."""
    return _profile(spark, sf_dir).select(
        "location_id", F.col("N").alias("N_kg_ha"), F.col("P").alias("P_kg_ha"), F.col("K").alias("K_kg_ha"),
        F.col("temperature").alias("avg_temp_c"), F.col("humidity").alias("humidity_pct"), F.col("ph").alias("pH"),
        F.col("rainfall").alias("avg_precip_mm"))


_REG_STATES = "(VALUES " + ", ".join(f"('{s.lower()}')" for s in dims.STATE_CROPS) + ") AS rs(s)"
_SOIL_SQL = f"""soil AS (
  SELECT location_id,
         CASE WHEN empty_payload THEN {d(6.5)} ELSE phh2o / {d(10.0)} END AS pH,
         CASE WHEN empty_payload THEN {d(50.0)}
              ELSE {rsql(f'GREATEST({d(5.0)}, LEAST(nitrogen / {d(100.0)} * {d(1950.0)} * {d(0.03)}, {d(400.0)}))', 1)} END AS N_kg_ha,
         CASE WHEN empty_payload THEN {d(25.0)}
              ELSE {rsql(f'GREATEST({d(3.0)}, LEAST(soc / {d(10.0)} * {d(2.5)} + {d(5.0)}, {d(200.0)}))', 1)} END AS P_kg_ha,
         CASE WHEN empty_payload THEN {d(25.0)}
              ELSE {rsql(f'GREATEST({d(5.0)}, LEAST(cec / {d(10.0)} * {d(0.03)} * {d(39.1)} * {d(20.0)}, {d(400.0)}))', 1)} END AS K_kg_ha,
         CASE WHEN empty_payload THEN 'defaults' ELSE 'soilgrids' END AS source
  FROM soil_values
)"""
_WX_SQL = f"""wxn AS (
  SELECT location_id, {rsql('AVG(t_mean)', 1)} AS avg_temp_c, {rsql('AVG(humidity)', 1)} AS humidity_pct,
         {rsql(f'SUM(precip) / GREATEST({d(1.0)}, COUNT(precip) / {d(365.0)})', 1)} AS avg_precip_mm
  FROM wx GROUP BY location_id
)"""
_PROFILE_SQL = f"""profile AS (
  SELECT v.location_id,
         COALESCE(s.N_kg_ha, {d(50.0)}) AS N, COALESCE(s.P_kg_ha, {d(25.0)}) AS P, COALESCE(s.K_kg_ha, {d(25.0)}) AS K,
         COALESCE(w.avg_temp_c, {d(27.0)}) AS temperature, COALESCE(w.humidity_pct, {d(70.0)}) AS humidity,
         COALESCE(s.pH, {d(6.5)}) AS ph, COALESCE(w.avg_precip_mm, {d(1000.0)}) AS rainfall,
         concat_ws(', ',
           CASE WHEN (s.source IS NULL OR s.source = 'defaults') AND COALESCE(s.N_kg_ha, {d(50.0)}) = {d(50.0)} THEN 'N' END,
           CASE WHEN w.avg_temp_c IS NULL THEN 'temperature' END,
           CASE WHEN w.humidity_pct IS NULL THEN 'humidity' END,
           CASE WHEN w.avg_precip_mm IS NULL THEN 'rainfall' END) AS used_defaults,
         concat_ws('; ', '{location.SOURCE_GEO}', '{location.SOURCE_SOIL}',
           CASE WHEN w.avg_temp_c IS NOT NULL THEN '{location.SOURCE_WEATHER}' END,
           CASE WHEN lower(v.state) IN (SELECT s FROM {_REG_STATES}) THEN '{location.SOURCE_REGIONAL}' END) AS data_sources
  FROM resolved v LEFT JOIN soil s ON s.location_id = v.location_id LEFT JOIN wxn w ON w.location_id = v.location_id
  WHERE v.error IS NULL
)"""
_PROFILE_FX = with_fx("locations_raw", "pin_directory", "soil_values", "weather_daily",
                      extra=RESOLVE_SQL + [_SOIL_SQL] + WEATHER_SQL + [_WX_SQL, _PROFILE_SQL])


@register("location_profile", sql=_PROFILE_FX + "SELECT * FROM profile")
def q_location_profile(spark, sf_dir):
    return _profile(spark, sf_dir)


def _loc_samples_sql():
    from agrolens.plans.q_rules import SCORED_CTES
    loc_samples = """samples AS (
  SELECT CAST(location_id AS VARCHAR) AS row_uid, CAST(location_id AS VARCHAR) AS sample_id, NULL AS target_crop,
         NULL AS date, N AS N_kg_ha, P AS P_kg_ha, K AS K_kg_ha, temperature AS avg_temp_c, humidity AS humidity_pct,
         ph AS pH, rainfall AS avg_precip_mm
  FROM profile
)"""
    return [loc_samples] + SCORED_CTES[1:]


@register("recommend_by_location", sql=with_fx(
    "locations_raw", "pin_directory", "soil_values", "weather_daily",
    extra=RESOLVE_SQL + [_SOIL_SQL] + WEATHER_SQL + [_WX_SQL, _PROFILE_SQL] + _loc_samples_sql()) + f"""
SELECT CAST(row_uid AS BIGINT) AS location_id, CAST(rk AS INTEGER) AS rank, crop,
       {rsql(f"score / CASE WHEN tot = 0 THEN {d(1.0)} ELSE tot END", 4)} AS probability,
       y.kg_ha AS expected_yield_kg_ha
FROM top3 JOIN crop_avg_yield y USING (crop)""")
def q_recommend_by_location(spark, sf_dir):
    """M15 (rule backend): location -> model input -> top-3 crops with yields."""
    from agrolens.operators import rules
    p = model_inputs(spark, sf_dir)
    t = rules.rule_topk_long(p, ["location_id"], 3)
    return t.select("location_id", "rank", "crop", F.round(F.col("score") / F.col("denom"), 4).alias("probability"),
                    "expected_yield_kg_ha")



def _boosted_sql():
    rule_ctes = [c.replace("scored AS (", "rscored AS (", 1).replace("FROM scored", "FROM rscored")
                 for c in _loc_samples_sql()]
    rec = "rec AS (SELECT CAST(row_uid AS BIGINT) AS location_id, crop, MIN(rk) AS rk, TRUE AS hit FROM top3 GROUP BY ALL)"
    base = [c for c in EXPORT_SQL if not c.startswith("rec AS (")]
    i = next(k for k, c in enumerate(base) if c.startswith("cand AS ("))
    extra = ([c for c in base[:i] if c not in RESOLVE_SQL] + [_SOIL_SQL] + WEATHER_SQL + [_WX_SQL, _PROFILE_SQL]
             + rule_ctes + [rec] + base[i:])
    return with_fx("locations_raw", "pin_directory", "soil_values", "weather_daily",
                   extra=RESOLVE_SQL + extra) + "SELECT * FROM ranked_exports"


@register("export_scores_boosted", sql=_boosted_sql())
def q_export_scores_boosted(spark, sf_dir):
    """E7 + E8 + J10: the recommender's top 3 join a location's candidates, and
    score +15 (capped at 100)."""
    rec = q_recommend_by_location(spark, sf_dir).select("location_id", "rank", "crop")
    r = _resolved(spark, sf_dir).where(F.col("error").isNull())
    return export.export_scores(spark, r, AS_OF, recommended=rec)


@register("certification_info", sql=with_fx("locations_raw", "pin_directory", extra=EXPORT_SQL + [dim_cte("certification")]) + """
SELECT r.location_id, r.crop, s.phytosanitary_complexity AS complexity, COALESCE(c.days, l.days) AS certification_days,
       array_to_string(COALESCE(c.steps, l.steps), '; ') AS certification_steps
FROM ranked_exports r LEFT JOIN export_stats s ON s.crop = r.crop LEFT JOIN certification c ON c.complexity = s.phytosanitary_complexity
JOIN certification l ON l.complexity = 'low'""")
def q_certification_info(spark, sf_dir):
    return export.certification_info(_export_scores(spark, sf_dir))
