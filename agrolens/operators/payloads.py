"""Service payloads as JSON text: weather, vegetation, market prices, lab results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.sources import dims

WEATHER_SCHEMA = ("struct<daily: struct<time: array<string>, temperature_2m_mean: array<double>, temperature_2m_max: array<double>, "
                  "temperature_2m_min: array<double>, precipitation_sum: array<double>, relative_humidity_2m_mean: array<double>>>")
VEGETATION_SCHEMA = "struct<properties: struct<parameter: map<string, map<string, double>>>>"
PRICE_SCHEMA = "struct<records: array<struct<Modal_x0020_Price: string, Min_x0020_Price: string, Max_x0020_Price: string, Market: string>>>"
LAB_SCHEMA = "struct<pH: double, N_kg_ha: double, P_kg_ha: double, K_kg_ha: double>"
#: Best vegetation inputs: mm of rain a day, kWh of sun a square metre and day, and their weights.
VEGETATION_PARTS = (("PRECTOTCORR", 5.0, 40.0), ("ALLSKY_SFC_SW_DWN", 6.0, 60.0))


def parse_weather(payloads: DataFrame) -> DataFrame:
    """R2: parallel arrays to one row a day; no ``daily`` block, no rows."""
    doc = F.from_json("payload", WEATHER_SCHEMA)["daily"]
    names = {"temperature_2m_mean": "t_mean", "temperature_2m_max": "t_max", "temperature_2m_min": "t_min",
             "precipitation_sum": "precip", "relative_humidity_2m_mean": "humidity"}
    keys = [c for c in payloads.columns if c != "payload"]
    x = payloads.select(*keys, doc.alias("_d"))
    days = F.transform(F.col("_d.time"), lambda t, i: F.struct(
        t.try_cast("date").alias("d"), *[F.get(F.col(f"_d.{src}"), i).alias(name) for src, name in names.items()]))
    return x.select(*keys, F.inline(days))


def parse_vegetation(payloads: DataFrame) -> DataFrame:
    """Nested maps to rows (parameter, month, value)."""
    keys = [c for c in payloads.columns if c != "payload"]
    params = F.from_json("payload", VEGETATION_SCHEMA)["properties"]["parameter"]
    long = payloads.select(*keys, F.explode(params).alias("parameter", "_months"))
    return long.select(*keys, "parameter", F.explode("_months").alias("month", "value"))


def vegetation_score(payloads: DataFrame) -> DataFrame:
    """F4 + A15: means of the positive values (fill values drop out), scored 0 to 100, in the row."""
    keys = [c for c in payloads.columns if c != "payload"]
    params = F.from_json("payload", VEGETATION_SCHEMA)["properties"]["parameter"]
    x = payloads.select(*keys, params.alias("_p")).where(F.col("_p").isNotNull())

    def mean(name):
        good = F.filter(F.coalesce(F.map_values(F.col("_p")[name]), F.array().cast("array<double>")), lambda v: v > 0)
        total = F.aggregate(good, lit_d(0.0), lambda a, v: a + v)
        return F.when(F.size(good) > 0, total / F.size(good)).otherwise(lit_d(0.0))

    x = x.withColumns({f"_m{i}": mean(name) for i, (name, _, _) in enumerate(VEGETATION_PARTS)})
    parts = [F.col(f"_m{i}") / lit_d(best) * lit_d(weight) for i, (_, best, weight) in enumerate(VEGETATION_PARTS)]
    x = x.withColumn("_s", F.least(lit_d(100.0), parts[0] + parts[1]))
    return x.select(*keys, F.when(F.col("_s") > 70, "High").when(F.col("_s") > 40, "Moderate").otherwise("Low").alias("vegetation_activity"),
                    F.round("_s", 1).alias("vegetation_score"), F.round("_m0", 2).alias("avg_precip"), F.round("_m1", 2).alias("avg_solar"))


def parse_prices(payloads: DataFrame) -> DataFrame:
    """R4 + J11: the first record whose three prices are numbers and whose modal price is positive;
    the payload's crop names a commodity, other crops are skipped."""
    commodity = F.broadcast(payloads.sparkSession.createDataFrame(list(dims.CROP_TO_COMMODITY.items()), "_crop string, commodity string"))
    keys = [c for c in payloads.columns if c != "payload"]
    x = payloads.join(commodity, F.lower("crop") == F.col("_crop")).drop("_crop")
    num = F.transform(F.from_json("payload", PRICE_SCHEMA)["records"], lambda r: F.struct(
        *[F.coalesce(r[f"{n}_x0020_Price"], F.lit("0")).try_cast("double").alias(a) for n, a in (("Modal", "modal"), ("Min", "low"), ("Max", "high"))],
        F.coalesce(r["Market"], F.lit("")).alias("market")))
    good = F.filter(num, lambda r: (r["modal"] > 0) & r["low"].isNotNull() & r["high"].isNotNull())
    x = x.withColumn("_r", F.get(good, 0)).where(F.col("_r").isNotNull())
    return x.select(*keys, "commodity", F.col("_r.modal").alias("modal_price_per_quintal"), F.col("_r.low").alias("min_price_per_quintal"),
                    F.col("_r.high").alias("max_price_per_quintal"), F.col("_r.market").alias("market"))


def parse_lab(payloads: DataFrame) -> DataFrame:
    """Lab results, or an error where the text is no JSON object."""
    doc = F.from_json("lab_payload", "struct<pH: double, N_kg_ha: double, P_kg_ha: double, K_kg_ha: double, _bad: string>",
                      {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    x = payloads.withColumn("_l", doc)
    bad = F.col("_l._bad").isNotNull()
    values = [F.when(~bad, F.col(f"_l.{c}")).alias(f"lab_{c}") for c in ("pH", "N_kg_ha", "P_kg_ha", "K_kg_ha")]
    return x.select(*payloads.columns, *values, F.when(bad, F.lit("invalid lab data")).alias("lab_error"))


LAB_SOURCE = "Lab soil test (user-provided)"
NO_LAB = "Primary pipeline selected but no lab_data provided; falling back to SoilGrids"
NO_SCRAPE = "Secondary pipeline (SHC scraping) not yet automated; using SoilGrids as proxy"


def soil_tier(requests: DataFrame, modelled: DataFrame) -> DataFrame:
    """The primary tier takes lab results where they are given; every other case takes the
    modelled record, with a warning for a primary without results and for the secondary tier."""
    x = parse_lab(requests).join(modelled.select("location_id", *[F.col(c).alias(f"_m_{c}") for c in ("pH", "N_kg_ha", "P_kg_ha", "K_kg_ha", "source")]), "location_id", "left")
    lab = (F.col("tier") == "Primary") & F.col("lab_payload").isNotNull() & F.col("lab_error").isNull()
    warning = F.when((F.col("tier") == "Primary") & ~lab, F.lit(NO_LAB)).when(F.col("tier") == "Secondary", F.lit(NO_SCRAPE))
    return x.select("location_id", "tier", *[F.when(lab, F.col(f"lab_{c}")).otherwise(F.col(f"_m_{c}")).alias(c) for c in ("pH", "N_kg_ha", "P_kg_ha", "K_kg_ha")],
                    F.when(lab, F.lit(LAB_SOURCE)).otherwise(F.col("_m_source")).alias("source"), warning.alias("warning"))
