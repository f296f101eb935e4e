"""DuckDB SQL for the fixture projections and dimensions, used as CTEs by oracles.

These restate FIXTURES.md part B in plain SQL; they are the *inputs* of each
oracle, while the operator logic of every oracle is written independently
in ``oracles.py``.
"""

from __future__ import annotations

from agrolens.sources import dims

_PRIMES = {"n": 7919, "p": 104729, "k": 1299709, "t": 15485863,
           "h": 32452843, "ph": 49979687, "r": 67867967}


def _f(name: str) -> str:
    m, s, p = f"{name}_m", f"{name}_s", _PRIMES[name]
    return (f"CAST(CAST({m}-2*{s} AS BIGINT) + CAST(FLOOR(CAST(4*{s}*((k*{p})%2001) AS DOUBLE)/2000)"
            f" AS BIGINT) AS DOUBLE)/10")


def _arr(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


STATES = _arr(dims.FIXTURE_STATES)
SEASONS = _arr(dims.FIXTURE_SEASONS)
CROPS = _arr(dims.CROP_LABELS)
COMMODITIES = _arr(list(dims.CROP_TO_COMMODITY.values()))

FX = {}

FX["soil_samples"] = f"""soil_samples AS (
  SELECT CONCAT(l_orderkey, '-', l_linenumber) AS sample_id,
         CONCAT_WS('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_uid,
         CAST(l_shipdate AS DATE) AS sample_date,
         k % 20 AS location_id,
         CASE WHEN k % 499 = 0 THEN 'quinoa'
              WHEN k % 5 = 0 THEN '  ' || UPPER(crop) || ' '
              ELSE crop END AS label,
         GREATEST({_f('n')}, CAST(0 AS DOUBLE)) AS N,
         GREATEST({_f('p')}, CAST(0 AS DOUBLE)) AS P,
         GREATEST({_f('k')}, CAST(0 AS DOUBLE)) AS K,
         {_f('t')} AS temperature,
         CASE WHEN k % 211 = 0 THEN CAST(120 AS DOUBLE) ELSE LEAST({_f('h')}, CAST(100 AS DOUBLE)) END AS humidity,
         CASE WHEN k % 97 = 0 THEN NULL ELSE {_f('ph')} END AS ph,
         GREATEST({_f('r')}, CAST(0 AS DOUBLE)) AS rainfall,
         8 + CAST(l_suppkey*37 % 2700 AS DOUBLE)/100 AS lat,
         68 + CAST(l_suppkey*53 % 2900 AS DOUBLE)/100 AS lon
  FROM (SELECT *, l_orderkey*31 + l_partkey*17 + l_suppkey*13 + l_linenumber*7
                  + CAST(FLOOR(l_quantity) AS BIGINT)*3 AS k FROM lineitem) li
  JOIN {dims.values_sql('sample_profile')} ON li.l_partkey % 22 = sample_profile.class_idx
)"""

FX["trial_harvests"] = """trial_harvests AS (
  SELECT o_orderkey AS harvest_id, o_custkey AS farm_id, o_custkey % 60 AS cluster_id, o_custkey % 60 % 4 AS zone, o_custkey % 60 % 3 = 0 AS irrigated,
         CASE WHEN o_orderkey % 23 <> 0 THEN o_totalprice / (o_custkey % 50 + 10) END AS yield_kg_ha, o_totalprice AS revenue,
         CAST((o_custkey % 50 + 1) * 500 AS DOUBLE) AS input_cost, CAST(o_orderkey % 22 AS INTEGER) AS recommended_idx,
         CAST((o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 WHEN o_orderkey % 7 = 0 THEN 4 ELSE 0 END) % 22 AS INTEGER) AS chosen_idx
  FROM orders
)"""

FX["crop_production"] = f"""crop_production AS (
  SELECT o_orderkey AS record_id,
         {STATES}[o_custkey % 13 + 1] AS State_Name,
         'District_' || CAST(o_custkey % 40 AS VARCHAR) AS District_Name,
         CAST(2015 + o_orderkey % 8 AS INTEGER) AS Crop_Year,
         {SEASONS}[o_custkey % 3 + 1] AS Season,
         {CROPS}[o_orderkey % 22 + 1] AS Crop,
         CAST((o_custkey % 50) * 10 AS DOUBLE) AS Area,
         o_totalprice / 100 AS Production
  FROM orders
)"""

_V = "CAST(FLOOR(value*100 + 0.5) AS BIGINT)"

FX["weather_daily"] = f"""weather_daily AS (
  SELECT event_id, location_id, d, t_mean, t_mean + 5 AS t_max, t_mean - 5 AS t_min, precip, humidity
  FROM (
    SELECT event_id, user_id % 20 AS location_id, CAST(ts AS DATE) AS d,
           CASE WHEN event_type = 'error' THEN NULL ELSE 10 + CAST({_V} % 2500 AS DOUBLE)/100 END AS t_mean,
           CASE WHEN event_type = 'view' THEN NULL ELSE CAST({_V} % 300 AS DOUBLE)/10 END AS precip,
           CAST(20 + {_V} % 80 AS DOUBLE) AS humidity
    FROM events)
)"""

FX["locations_raw"] = """locations_raw AS (
  SELECT c_custkey AS location_id,
         CASE c_custkey % 5
           WHEN 0 THEN CAST(100000 + c_custkey AS VARCHAR)
           WHEN 1 THEN CAST(8 + c_custkey % 27 AS VARCHAR) || '.' || CAST(c_custkey % 10 AS VARCHAR)
                       || ' , ' || CAST(68 + c_custkey % 29 AS VARCHAR) || '.5'
           WHEN 2 THEN ' 9' || CAST(c_custkey % 10 AS VARCHAR) || '.25,77.5 '
           WHEN 3 THEN 'not-a-location'
           ELSE '  ' END AS location
  FROM customer
)"""

FX["pin_directory"] = f"""pin_directory AS (
  SELECT CAST(100000 + c_custkey AS VARCHAR) AS pin,
         8 + CAST(c_custkey*37 % 2700 AS DOUBLE)/100 AS lat,
         68 + CAST(c_custkey*53 % 2900 AS DOUBLE)/100 AS lon,
         {STATES}[c_nationkey % 18 + 1] AS state,
         'District_' || CAST(c_nationkey AS VARCHAR) AS district,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS place
  FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 3 <> 0
)"""

# Soil payload values, computed from the supplier key directly (no JSON parsing).
FX["soil_values"] = """soil_values AS (
  SELECT s_suppkey AS location_id, s_suppkey % 11 = 0 AS empty_payload,
         CAST(45 + (s_suppkey*7) % 45 AS DOUBLE) AS phh2o, CAST(250 AS DOUBLE) AS clay,
         CAST(50 + (s_suppkey*17) % 200 AS DOUBLE) AS soc, CAST(500 AS DOUBLE) AS nitrogen,
         CAST(150 AS DOUBLE) AS cec
  FROM supplier
)"""

FX["mandi_prices"] = f"""mandi_prices AS (
  SELECT o_orderkey AS record_id,
         {STATES}[o_custkey % 18 + 1] AS state,
         {COMMODITIES}[o_orderkey % 17 + 1] AS commodity,
         CAST(o_orderdate AS DATE) AS arrival_date,
         CASE WHEN o_orderkey % 13 = 0 THEN 'NA' WHEN o_orderkey % 29 = 0 THEN '0'
              ELSE CAST(800 + (o_orderkey*37) % 4000 AS VARCHAR) END AS modal_price,
         CAST(650 + (o_orderkey*37) % 4000 AS VARCHAR) AS min_price,
         CAST(950 + (o_orderkey*37) % 4000 AS VARCHAR) AS max_price,
         'Market_' || CAST(o_custkey % 7 AS VARCHAR) AS market
  FROM orders
)"""

FX["scored_requests"] = f"""scored_requests AS (
  SELECT event_id AS request_id, ts,
         CAST({_V} % 1500 AS DOUBLE)/1000 AS latency_s,
         CAST(user_id % 22 AS INTEGER) AS actual_idx,
         CAST(CASE WHEN event_id % 4 = 0 THEN (user_id + 1) % 22 ELSE user_id % 22 END AS INTEGER) AS pred_idx,
         CASE WHEN user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm
  FROM events
)"""

FX["class_scores"] = """class_scores AS (
  SELECT vec_id, CAST(i - 1 AS INTEGER) AS class_idx, CAST(embedding[i] AS DOUBLE) AS score
  FROM embeddings, range(1, 23) AS r(i)
)"""


def with_fx(*names: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named fixture CTEs plus extra CTE strings."""
    parts = [FX[n] for n in names] + list(extra or [])
    return "WITH " + ",\n".join(parts) + "\n"


def dim_cte(name: str) -> str:
    """A dimension as a CTE: ``name AS (SELECT * FROM (VALUES ...))``."""
    return f"{name} AS (SELECT * FROM {dims.values_sql(name)})"
