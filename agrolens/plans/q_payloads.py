"""Payload queries (R2-R5, F4, A15, J11, P24), and weather over years.

The payloads are built from orders and suppliers, so their number grows with the
tables; order dates span years, so windows and seasons do remove rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import location, payloads
from agrolens.plans.common import d, rsql
from agrolens.plans.oracle_fixtures import CROPS, with_fx
from agrolens.plans import q_location as ql
from agrolens.plans.q_location import _SOIL_SQL
from agrolens.plans.registry import REGISTRY, register
from agrolens.sources import dims, fixtures
from agrolens.sources.tables import table

HISTORY_AS_OF = "1997-06-01"


def weather_payloads(spark, sf_dir):
    """Three days from each order's date; the second day lacks its temperature, every fifth payload is empty."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k = F.col("o_orderkey")
    day = F.col("o_orderdate").cast("date")
    t = F.lit(10.0) + F.pmod(k * 7, F.lit(2500)).cast("double") / 100

    def arr(*cols):
        return F.array(*cols)

    daily = F.struct(
        arr(*[F.date_add(day, i).cast("string") for i in range(3)]).alias("time"),
        arr(t, F.lit(None).cast("double"), t + 1).alias("temperature_2m_mean"), arr(t + 5, t + 6, t + 7).alias("temperature_2m_max"),
        arr(t - 5, t - 6, F.lit(None).cast("double")).alias("temperature_2m_min"),
        arr(F.pmod(k, F.lit(30)).cast("double"), F.lit(0.0), F.lit(None).cast("double")).alias("precipitation_sum"),
        arr(F.lit(60.0), F.pmod(k, F.lit(100)).cast("double"), F.lit(70.0)).alias("relative_humidity_2m_mean"))
    text = F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"})
    return o.select(F.col("o_orderkey").alias("record_id"), F.pmod("o_custkey", F.lit(20)).alias("location_id"),
                    F.when(F.pmod(k, F.lit(5)) == 0, F.lit("{}")).otherwise(text).alias("payload"))


_T = "(10 + CAST((o_orderkey * 7) % 2500 AS DOUBLE) / 100)"
HISTORY_SQL = f"""history AS (
  SELECT o_orderkey AS record_id, o_custkey % 20 AS location_id, CAST(CAST(o_orderdate AS DATE) + i AS DATE) AS d,
         CASE i WHEN 0 THEN {_T} WHEN 2 THEN {_T} + 1 END AS t_mean, {_T} + 5 + i AS t_max,
         CASE i WHEN 0 THEN {_T} - 5 WHEN 1 THEN {_T} - 6 END AS t_min,
         CASE i WHEN 0 THEN CAST(o_orderkey % 30 AS DOUBLE) WHEN 1 THEN CAST(0 AS DOUBLE) END AS precip,
         CASE i WHEN 0 THEN CAST(60 AS DOUBLE) WHEN 1 THEN CAST(o_orderkey % 100 AS DOUBLE) ELSE CAST(70 AS DOUBLE) END AS humidity
  FROM orders, (VALUES (0), (1), (2)) AS n(i) WHERE o_orderkey % 5 <> 0
)"""


def _history(spark, sf_dir):
    return payloads.parse_weather(weather_payloads(spark, sf_dir))


@register("parse_weather_json", sql=f"WITH {HISTORY_SQL} SELECT record_id, location_id, d, {rsql('t_mean', 4)} AS t_mean, "
          f"{rsql('t_max', 4)} AS t_max, {rsql('t_min', 4)} AS t_min, precip, humidity FROM history")
def q_parse_weather_json(spark, sf_dir):
    h = _history(spark, sf_dir)
    return h.select("record_id", "location_id", "d", *[F.round(c, 4).alias(c) for c in ("t_mean", "t_max", "t_min")], "precip", "humidity")


_END = f"(CAST('{HISTORY_AS_OF}' AS DATE) - 5)"
_NORMALS = f"""SELECT location_id, {rsql('AVG(t_mean)', 1)} AS avg_temp_c, {rsql('AVG(t_max)', 1)} AS temp_max_c,
       {rsql('AVG(t_min)', 1)} AS temp_min_c, {rsql('AVG(humidity)', 1)} AS humidity_pct,
       {rsql(f'SUM(precip) / GREATEST({d(1.0)}, COUNT(precip) / {d(365.0)})', 1)} AS avg_precip_mm,
       COUNT(t_mean) AS data_points FROM history"""


@register("weather_normals_history", sql=f"WITH {HISTORY_SQL} {_NORMALS} WHERE d BETWEEN {_END} - {365 * 3} AND {_END} GROUP BY location_id")
def q_weather_normals_history(spark, sf_dir):
    return location.weather_normals(location.weather_window(_history(spark, sf_dir), HISTORY_AS_OF))


def _season_sql(season):
    a, b = next((a, b) for s, a, b in dims.SEASON_MONTHS if s == season)
    cond = f"month(d) BETWEEN {a} AND {b}" if a <= b else f"(month(d) >= {a} OR month(d) <= {b})"
    return f"WITH {HISTORY_SQL} {_NORMALS} WHERE {cond} AND d BETWEEN {_END} - {365 * 3} AND {_END} GROUP BY location_id"


for _season in [s for s, _, _ in dims.SEASON_MONTHS]:
    register(f"seasonal_weather_{_season.lower()}", sql=_season_sql(_season))(
        lambda spark, sf_dir, season=_season: location.weather_normals(
            location.season_filter(location.weather_window(_history(spark, sf_dir), HISTORY_AS_OF), season)))


def vegetation_payloads(spark, sf_dir):
    """Three months of rain and sun a supplier, with fill values; every ninth payload has no rain."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")

    def month(c, i):
        return F.struct(F.lit(f"20240{i}").alias("key"), c.cast("double").alias("value"))

    rain = F.map_from_entries(F.array(month(F.pmod(k, F.lit(9)), 1), month(F.lit(-999.0), 2), month(F.pmod(k * 3, F.lit(7)), 3)))
    sun = F.map_from_entries(F.array(month(F.pmod(k, F.lit(6)) + 1, 1), month(F.lit(4.5), 2), month(F.lit(-999.0), 3)))
    entry = F.map_from_entries(F.array(F.struct(F.lit("PRECTOTCORR").alias("key"), rain.alias("value")), F.struct(F.lit("ALLSKY_SFC_SW_DWN").alias("key"), sun.alias("value"))))
    return s.select(k.alias("location_id"), F.to_json(F.struct(F.struct(entry.alias("parameter")).alias("properties"))).alias("payload"))


_VEG_SQL = """veg AS (
  SELECT s_suppkey AS location_id, parameter, month, value FROM supplier, LATERAL (VALUES
    ('PRECTOTCORR', '202401', CAST(s_suppkey % 9 AS DOUBLE)), ('PRECTOTCORR', '202402', CAST(-999 AS DOUBLE)),
    ('PRECTOTCORR', '202403', CAST((s_suppkey * 3) % 7 AS DOUBLE)), ('ALLSKY_SFC_SW_DWN', '202401', CAST(s_suppkey % 6 + 1 AS DOUBLE)),
    ('ALLSKY_SFC_SW_DWN', '202402', CAST(4.5 AS DOUBLE)), ('ALLSKY_SFC_SW_DWN', '202403', CAST(-999 AS DOUBLE))) AS v(parameter, month, value)
)"""


@register("parse_veg_json", sql=f"WITH {_VEG_SQL} SELECT location_id, parameter, month, value FROM veg")
def q_parse_veg_json(spark, sf_dir):
    return payloads.parse_vegetation(vegetation_payloads(spark, sf_dir))


@register("vegetation_score", sql=f"""WITH {_VEG_SQL}, m AS (
  SELECT location_id, COALESCE(AVG(value) FILTER (WHERE value > 0 AND parameter = 'PRECTOTCORR'), {d(0.0)}) AS p,
         COALESCE(AVG(value) FILTER (WHERE value > 0 AND parameter = 'ALLSKY_SFC_SW_DWN'), {d(0.0)}) AS s FROM veg GROUP BY 1
), sc AS (SELECT *, LEAST({d(100.0)}, p / {d(5.0)} * {d(40.0)} + s / {d(6.0)} * {d(60.0)}) AS x FROM m)
SELECT location_id, CASE WHEN x > 70 THEN 'High' WHEN x > 40 THEN 'Moderate' ELSE 'Low' END AS vegetation_activity,
       {rsql('x', 1)} AS vegetation_score, {rsql('p', 2)} AS avg_precip, {rsql('s', 2)} AS avg_solar FROM sc""")
def q_vegetation_score(spark, sf_dir):
    return payloads.vegetation_score(vegetation_payloads(spark, sf_dir))


def price_payloads(spark, sf_dir):
    """Two market records an order: the first often unusable; some crops name no commodity."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    crop = F.element_at(F.array(*[F.lit(c) for c in dims.CROP_LABELS]), F.pmod(k, F.lit(22)).cast("int") + 1)

    def record(modal, low, high, market):
        return F.struct(modal.cast("string").alias("Modal_x0020_Price"), low.cast("string").alias("Min_x0020_Price"),
                        high.cast("string").alias("Max_x0020_Price"), market.alias("Market"))

    first = record(F.when(F.pmod(k, F.lit(3)) == 0, F.lit("NA")).when(F.pmod(k, F.lit(3)) == 1, F.lit("0")).otherwise((k % 900).cast("string")),
                   F.lit("10"), F.when(F.pmod(k, F.lit(4)) == 0, F.lit("-")).otherwise(F.lit("99")), F.lit("A"))
    second = record(F.pmod(k * 3, F.lit(500)), F.lit("5"), F.lit("600"), F.lit("B"))
    return o.select(k.alias("record_id"), F.upper(crop).alias("crop"), F.to_json(F.struct(F.array(first, second).alias("records"))).alias("payload"))


@register("parse_price_json", sql=f"""
SELECT record_id, crop, commodity,
       CASE WHEN one THEN m1 ELSE m2 END AS modal_price_per_quintal, CASE WHEN one THEN {d(10.0)} ELSE {d(5.0)} END AS min_price_per_quintal,
       CASE WHEN one THEN {d(99.0)} ELSE {d(600.0)} END AS max_price_per_quintal, CASE WHEN one THEN 'A' ELSE 'B' END AS market
FROM (SELECT o_orderkey AS record_id, upper({CROPS}[o_orderkey % 22 + 1]) AS crop, c.commodity,
             o_orderkey % 3 = 2 AND o_orderkey % 900 > 0 AND o_orderkey % 4 <> 0 AS one,
             CAST(o_orderkey % 900 AS DOUBLE) AS m1, CAST((o_orderkey * 3) % 500 AS DOUBLE) AS m2
      FROM orders JOIN {dims.values_sql('crop_commodity')} AS c ON c.crop = {CROPS}[o_orderkey % 22 + 1])
WHERE one OR m2 > 0""".replace(f"{dims.values_sql('crop_commodity')} AS c", f"(SELECT * FROM {dims.values_sql('crop_commodity')}) AS c"))
def q_parse_price_json(spark, sf_dir):
    return payloads.parse_prices(price_payloads(spark, sf_dir))


def lab_requests(spark, sf_dir):
    """A tier a supplier; lab results for every other one, some of them no JSON."""
    k = F.col("s_suppkey")
    tier = F.element_at(F.array(*[F.lit(x) for x in ("Primary", "Secondary", "Tertiary")]), F.pmod(k, F.lit(3)).cast("int") + 1)
    text = F.concat(F.lit('{"pH": 6.'), F.pmod(k, F.lit(9)).cast("string"), F.lit(', "N_kg_ha": '), F.pmod(k, F.lit(90)).cast("string"), F.lit(', "P_kg_ha": 20, "K_kg_ha": 30}'))
    lab = F.when(F.pmod(k, F.lit(2)) == 1, F.lit(None).cast("string")).when(F.pmod(k, F.lit(8)) == 0, F.lit("{pH 6")).otherwise(text)
    return table(spark, sf_dir, "supplier").select(k.alias("location_id"), tier.alias("tier"), lab.alias("lab_payload"))


_LAB_SQL = f"""lab AS (
  SELECT s_suppkey AS location_id, ['Primary', 'Secondary', 'Tertiary'][s_suppkey % 3 + 1] AS tier,
         s_suppkey % 2 = 0 AND s_suppkey % 8 <> 0 AS ok, s_suppkey % 8 = 0 AS bad,
         CAST('6.' || CAST(s_suppkey % 9 AS VARCHAR) AS DOUBLE) AS lab_ph, CAST(s_suppkey % 90 AS DOUBLE) AS lab_n FROM supplier
)"""


@register("parse_lab_json", sql=f"""WITH {_LAB_SQL}
SELECT location_id, CASE WHEN ok THEN lab_ph END AS lab_pH, CASE WHEN ok THEN lab_n END AS lab_N_kg_ha, CASE WHEN ok THEN {d(20.0)} END AS lab_P_kg_ha,
       CASE WHEN ok THEN {d(30.0)} END AS lab_K_kg_ha, CASE WHEN bad THEN 'invalid lab data' END AS lab_error FROM lab""")
def q_parse_lab_json(spark, sf_dir):
    return payloads.parse_lab(lab_requests(spark, sf_dir)).drop("tier", "lab_payload")


@register("soil_tier", sql=with_fx("soil_values", extra=[_SOIL_SQL, _LAB_SQL]) + f"""
SELECT l.location_id, tier, CASE WHEN use_lab THEN lab_ph ELSE s.pH END AS pH, CASE WHEN use_lab THEN lab_n ELSE s.N_kg_ha END AS N_kg_ha,
       CASE WHEN use_lab THEN {d(20.0)} ELSE s.P_kg_ha END AS P_kg_ha, CASE WHEN use_lab THEN {d(30.0)} ELSE s.K_kg_ha END AS K_kg_ha,
       CASE WHEN use_lab THEN '{payloads.LAB_SOURCE}' ELSE s.source END AS source,
       CASE WHEN tier = 'Primary' AND NOT use_lab THEN '{payloads.NO_LAB}' WHEN tier = 'Secondary' THEN '{payloads.NO_SCRAPE}' END AS warning
FROM (SELECT *, tier = 'Primary' AND ok AS use_lab FROM lab) l LEFT JOIN soil s ON s.location_id = l.location_id""")
def q_soil_tier(spark, sf_dir):
    modelled = location.soil_record(location.parse_soil(fixtures.soil_payloads(spark, sf_dir)))
    return payloads.soil_tier(lab_requests(spark, sf_dir), modelled)


def _full_sql():
    crops = [(dims.CROP_TO_COMMODITY[c], c) for c in dims.DEFAULT_TARGET_CROPS if c in dims.CROP_TO_COMMODITY]
    names = ", ".join(f"('{a}', '{b}')" for a, b in crops)
    market = f"""market AS (
  SELECT state, string_agg(DISTINCT n.crop || ':' || CAST(CAST(modal AS BIGINT) AS VARCHAR), ', ' ORDER BY n.crop || ':' || CAST(CAST(modal AS BIGINT) AS VARCHAR)) AS market
  FROM (SELECT *, TRY_CAST(modal_price AS DOUBLE) AS modal,
               row_number() OVER (PARTITION BY state, commodity ORDER BY arrival_date DESC, record_id) AS rn
        FROM mandi_prices WHERE TRY_CAST(modal_price AS DOUBLE) > 0) p
  JOIN (VALUES {names}) AS n(commodity, crop) USING (commodity) WHERE rn = 1 GROUP BY state
)"""
    reg = """reg AS (
  SELECT v.location_id, string_agg(c.crop, ', ' ORDER BY c.rank) AS regional_crops FROM resolved v
  JOIN state_crop c ON lower(c.state) = lower(v.state) WHERE v.error IS NULL GROUP BY 1
)"""
    veg = REGISTRY["vegetation_score"].sql
    extra = (ql.RESOLVE_SQL + [c for c in ql.EXPORT_SQL if c not in ql.RESOLVE_SQL] + [_SOIL_SQL] + ql.WEATHER_SQL
             + [ql._WX_SQL, ql._PROFILE_SQL, market, reg, f"vegetation AS ({veg})"])
    loc = location
    return with_fx("locations_raw", "pin_directory", "soil_values", "weather_daily", "mandi_prices", extra=extra) + f"""
SELECT p.* EXCLUDE (data_sources), m.market, r.regional_crops, g.vegetation_activity, g.vegetation_score, b.crop AS best_export, b.export_score,
       concat_ws('; ', '{loc.SOURCE_GEO}', '{loc.SOURCE_SOIL}', CASE WHEN w.avg_temp_c IS NOT NULL THEN '{loc.SOURCE_WEATHER}' END,
                 CASE WHEN m.market IS NOT NULL THEN '{loc.SOURCE_MARKET}' END, CASE WHEN r.regional_crops IS NOT NULL THEN '{loc.SOURCE_REGIONAL}' END,
                 CASE WHEN g.vegetation_score IS NOT NULL THEN '{loc.SOURCE_VEGETATION}' END, CASE WHEN b.crop IS NOT NULL THEN '{loc.SOURCE_EXPORT}' END) AS data_sources,
       concat_ws('; ', CASE WHEN COALESCE(s.source, 'defaults') = 'defaults' THEN '{loc.WARN_SOIL}' END,
                 CASE WHEN w.avg_temp_c IS NULL THEN '{loc.WARN_WEATHER}' END) AS warnings
FROM profile p JOIN resolved v USING (location_id) LEFT JOIN soil s USING (location_id) LEFT JOIN wxn w USING (location_id)
LEFT JOIN market m ON m.state = v.state LEFT JOIN reg r USING (location_id) LEFT JOIN vegetation g USING (location_id)
LEFT JOIN (SELECT * FROM ranked_exports WHERE rank = 1 AND export_score <> 0) b USING (location_id)"""


@register("location_profile_full", sql=_full_sql())
def q_location_profile_full(spark, sf_dir):
    resolved = ql._resolved(spark, sf_dir).where(F.col("error").isNull())
    soil = location.soil_record(location.parse_soil(fixtures.soil_payloads(spark, sf_dir)))
    market = location.market_by_state(fixtures.mandi_prices(spark, sf_dir), dims.DEFAULT_TARGET_CROPS)
    best = ql.q_export_best(spark, sf_dir)
    return location.location_profile_full(resolved, ql._profile(spark, sf_dir), soil, market, ql.q_regional_crops(spark, sf_dir),
                                          payloads.vegetation_score(vegetation_payloads(spark, sf_dir)), best)
