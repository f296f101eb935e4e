"""Whole soil records, degree days by crop, and the switches that keep the reference's quirks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from agrolens.ml import models
from agrolens.operators import location
from agrolens.plans import q_location as ql
from agrolens.plans import q_payloads as qp
from agrolens.plans.common import AS_OF, d, rsql
from agrolens.plans.oracle_fixtures import with_fx
from agrolens.plans.q_ingest import _production
from agrolens.plans.q_joined import _season_sql
from agrolens.plans.registry import register
from agrolens.sources import dims, fixtures
from agrolens.sources.tables import table

#: Raw values a supplier's soil payload has, as (property, first value, step, number of values).
_RAW = [("phh2o", 45, 7, 45), ("clay", 100, 13, 400), ("sand", 200, 19, 500), ("silt", 150, 23, 300),
        ("soc", 50, 17, 200), ("nitrogen", 60, 29, 500), ("cec", 80, 31, 300), ("bdod", 100, 37, 60)]


def whole_soil_payloads(spark, sf_dir):
    """All eight layers a supplier; every seventh lacks sand, every eleventh payload is empty."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = F.col("s_suppkey")

    def layer(name, first, step, n):
        value = F.lit(first) + F.pmod(k * step, F.lit(n))
        value = F.when(F.pmod(k, F.lit(7)) != 0, value) if name == "sand" else value
        depth = F.struct(F.lit("0-5cm").alias("label"), F.struct(value.cast("double").alias("mean")).alias("values"))
        return F.struct(F.lit(name).alias("name"), F.array(depth).alias("depths"))

    text = F.to_json(F.struct(F.struct(F.array(*[layer(*r) for r in _RAW]).alias("layers")).alias("properties")))
    return s.select(k.alias("location_id"), F.when(F.pmod(k, F.lit(11)) == 0, F.lit("{}")).otherwise(text).alias("payload"))


def _whole_soil_sql() -> str:
    raw = {n: f"CAST({first} + (s_suppkey * {step}) % {m} AS DOUBLE)" for n, first, step, m in _RAW}
    raw["sand"] = f"CASE WHEN s_suppkey % 7 <> 0 THEN {raw['sand']} END"
    unit = {c: f"{raw[p]} / {d(float(round(1 / f)))}" if f < 1 else f"{raw[p]} * {d(f)}" for p, c, f in dims.SOIL_PROPERTIES}

    def clamped(x, lo, hi):
        return rsql(f"GREATEST({d(lo)}, LEAST({x}, {d(hi)}))", 1)

    npk = {"N_kg_ha": (clamped(f"nitrogen_g_kg * {d(1950.0)} * {d(0.03)}", 5.0, 400.0), 50.0), "P_kg_ha": (clamped(f"soc_g_kg * {d(2.5)} + {d(5.0)}", 3.0, 200.0), 25.0),
           "K_kg_ha": (clamped(f"cec_mmol_kg / {d(10.0)} * {d(0.03)} * {d(39.1)} * {d(20.0)}", 5.0, 400.0), 25.0)}
    cols = [f"CASE WHEN gone THEN {d(6.5) if c == 'pH' else 'NULL'} ELSE {c} END AS {c}" for c in unit]
    cols += [f"CASE WHEN gone THEN {d(v)} ELSE {e} END AS {n}" for n, (e, v) in npk.items()]
    inner = ", ".join(f"{e} AS {c}" for c, e in unit.items())
    return (f"SELECT location_id, {', '.join(cols)}, CASE WHEN gone THEN 'defaults' ELSE 'soilgrids' END AS source "
            f"FROM (SELECT s_suppkey AS location_id, s_suppkey % 11 = 0 AS gone, {inner} FROM supplier)")


@register("soil_profile_full", sql=_whole_soil_sql())
def q_soil_profile_full(spark, sf_dir):
    """Texture and all other layers in canonical units, kept to the record."""
    return location.soil_record_full(location.parse_soil(whole_soil_payloads(spark, sf_dir)))


_BASES = ", ".join(f"('{c}', '{s}', {d(b)})" for c, s, b in dims.DEGREE_DAY_BASES)
_DEGREES = f"""SELECT x.location_id, b.crop, x.season, x.season_year,
       {{}} AS gdd, COUNT(x.t_mean) AS n_days
FROM (SELECT *, {_season_sql('d')} FROM history) x JOIN (VALUES {_BASES}) AS b(crop, season, base_c) USING (season) GROUP BY ALL"""


def _degrees_sql(floor: bool) -> str:
    term = f"GREATEST(t_mean - base_c, {d(0.0)})" if floor else "t_mean - base_c"
    term = f"COALESCE(SUM(CASE WHEN t_mean IS NOT NULL THEN {term} END), {d(0.0)})"
    return f"WITH {qp.HISTORY_SQL} " + _DEGREES.format(rsql(term, 4))


@register("crop_degree_days", sql=_degrees_sql(True))
def q_crop_degree_days(spark, sf_dir):
    return location.crop_degree_days(qp._history(spark, sf_dir))


@register("crop_degree_days_unfloored", sql=_degrees_sql(False))
def q_crop_degree_days_unfloored(spark, sf_dir):
    return location.crop_degree_days(qp._history(spark, sf_dir), floor_at_zero=False)


#: As a user may write them; the last is unknown.
_ASKED = ("Kharif ", "rabi", "ZAID", "monsoon")


def _asked_sql(strict: bool) -> str:
    months = {s: (a, b) for s, a, b in dims.SEASON_MONTHS}
    out = []
    for asked in _ASKED:
        name = asked.strip().lower()
        a, b = months.get(name, (1, 12))
        cond = "TRUE" if strict else f"month(d) BETWEEN {a} AND {b}" if a <= b else f"(month(d) >= {a} OR month(d) <= {b})"
        tag = f"'{name}'" if name in months else "CAST(NULL AS VARCHAR)"
        out.append(f"SELECT '{asked}' AS asked, n.*, {tag} AS season FROM ({qp._NORMALS} WHERE {cond} AND d BETWEEN {qp._END} - {365 * 3} AND {qp._END} GROUP BY location_id) n")
    return f"WITH {qp.HISTORY_SQL} " + " UNION ALL ".join(out)


def _asked(spark, sf_dir, strict):
    daily = location.weather_window(qp._history(spark, sf_dir), qp.HISTORY_AS_OF)
    parts = [location.seasonal_normals(daily, s, strict).withColumn("asked", F.lit(s)) for s in _ASKED]
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("seasonal_normals", sql=_asked_sql(False))
def q_seasonal_normals(spark, sf_dir):
    return _asked(spark, sf_dir, False)


@register("seasonal_normals_compat", sql=_asked_sql(True))
def q_seasonal_normals_compat(spark, sf_dir):
    """A14 as the reference has it: the season is a tag only."""
    return _asked(spark, sf_dir, True)


def _compat_profile_sql() -> str:
    names = ("used_defaults", "temperature", "humidity", "rainfall")
    kept = "CASE WHEN list_contains(string_split(used_defaults, ', '), 'N') THEN 'N' ELSE '' END AS used_defaults"
    zero = [f"CASE WHEN list_contains(string_split(used_defaults, ', '), '{n}') THEN {d(0.0)} ELSE {n} END AS {n}" for n in names[1:]]
    return ql._PROFILE_FX + f"SELECT * REPLACE ({', '.join([kept, *zero])}) FROM profile"


@register("location_profile_compat", sql=_compat_profile_sql())
def q_location_profile_compat(spark, sf_dir):
    """P25 as the reference has it: missing weather becomes 0 and is not named."""
    r = ql._resolved(spark, sf_dir).where(F.col("error").isNull())
    soil = location.soil_record(location.parse_soil(fixtures.soil_payloads(spark, sf_dir)))
    wx = location.weather_normals(location.weather_window(fixtures.weather_daily(spark, sf_dir), AS_OF))
    return location.location_profile(r, soil, wx, strict_compat=True)


@register("train_yield_compat", note="boosted-tree predictions: rows-only")
def q_train_yield_compat(spark, sf_dir):
    """M8 as the reference has it: the crop is no feature (20 trees here, as ``train_yield`` has the full count)."""
    return models.train_yield(_production(spark, sf_dir), max_iter=20, strict_compat=True)
