"""Location resolution, soil/weather/market payload parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import clamp, lit_d
from agrolens.sources import dims

PIN_RE = r"^\d{6}$"
COORD_RE = r"^-?\d+\.?\d*\s*,\s*-?\d+\.?\d*$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def classify_location(df: DataFrame, col: str = "location") -> DataFrame:
    """kind = empty | pin | coords | unrecognised (input stripped first)."""
    s = strip(F.col(col))
    kind = (F.when(s == "", F.lit("empty")).when(s.rlike(PIN_RE), F.lit("pin"))
            .when(s.rlike(COORD_RE), F.lit("coords")).otherwise(F.lit("unrecognised")))
    return df.withColumn("_loc", s).withColumn("kind", kind)


def parse_coordinates(df: DataFrame) -> DataFrame:
    """lat/lon from 'lat,lon' with range checks; errors as a column, never raised."""
    parts = F.split(F.col("_loc"), ",")
    lat = strip(F.get(parts, 0)).try_cast("double")
    lon = strip(F.get(parts, 1)).try_cast("double")
    is_c = F.col("kind") == "coords"
    err = (F.when(~is_c, F.lit(None).cast("string"))
           .when((lat < -90) | (lat > 90), F.lit("latitude out of range"))
           .when((lon < -180) | (lon > 180), F.lit("longitude out of range")))
    return (df.withColumn("_lat", F.when(is_c, lat)).withColumn("_lon", F.when(is_c, lon))
            .withColumn("_coord_err", err))


def resolve_locations(locations: DataFrame, pin_directory: DataFrame) -> DataFrame:
    """J5 + F8 + P20: resolve PINs via the postal directory, parse coordinates,
    and reject empty / unrecognised / out-of-range / unknown-PIN inputs with a
    reason.  One scan and one left join: a row that is no PIN carries a key of its
    own, behind a mark that no PIN has, so it matches nothing and repeated or
    blank texts do not pile up on one key (AQE broadcasts the directory when it is
    small and splits a hot PIN otherwise)."""
    x = parse_coordinates(classify_location(locations))
    own = F.concat(F.lit("#"), F.coalesce(F.col("location_id").cast("string"), F.xxhash64(*locations.columns).cast("string")))
    x = x.withColumn("_key", F.when(F.col("kind") == "pin", F.col("_loc")).otherwise(own))
    pins = pin_directory.select(F.col("pin").alias("_key"), F.col("lat").alias("_plat"),
                                F.col("lon").alias("_plon"), F.col("state").alias("_pstate"),
                                F.col("district").alias("_pdist"), F.col("place").alias("_pplace"),
                                F.lit(True).alias("_found"))
    x = x.join(pins, "_key", "left").drop("_key")
    is_pin, is_c = F.col("kind") == "pin", F.col("kind") == "coords"
    error = (F.when(F.col("kind") == "empty", F.lit("location string is empty"))
             .when(F.col("kind") == "unrecognised", F.lit("unrecognized location format"))
             .when(is_pin & F.col("_found").isNull(), F.lit("could not geocode PIN code"))
             .when(is_c, F.col("_coord_err")))
    ok = error.isNull()
    display = (F.when(is_pin, F.concat_ws(", ", F.col("_pplace"), F.col("_pdist"), F.col("_pstate"), F.lit("India")))
               .when(is_c, F.format_string("%.4f, %.4f", F.col("_lat"), F.col("_lon"))))
    return x.select(
        *[c for c in locations.columns if c != "location"], F.col("location").alias("raw_input"), "kind",
        F.when(ok, F.when(is_pin, F.col("_plat")).otherwise(F.col("_lat"))).alias("latitude"),
        F.when(ok, F.when(is_pin, F.col("_plon")).otherwise(F.col("_lon"))).alias("longitude"),
        F.when(ok & is_pin, F.col("_pstate")).alias("state"),
        F.when(ok & is_pin, F.col("_pdist")).alias("district"),
        F.when(ok & is_pin, F.col("_loc")).alias("pin_code"),
        F.when(ok, display).alias("display_name"),
        error.alias("error"))


# ---- soil payloads (R1, W9, P21, P22, P23) ----------------------------------

SOIL_SCHEMA = ("struct<properties: struct<layers: array<struct<name: string, "
               "depths: array<struct<label: string, values: struct<mean: double>>>>>>>")


def _name_is(prop: str):
    return lambda layer: layer["name"] == F.lit(prop)


def parse_soil(payloads: DataFrame, depth: str = "0-5cm") -> DataFrame:
    """R1 + W9 + P21: payload -> one wide row of canonical soil properties.

    Per layer: first depth whose label contains the depth without 'cm' (or
    equals it), else the first depth, also when the matched mean is missing.
    Units: factor per property from a fixed 8-row table.  Map-only: the
    layers are folded into columns with array filters, no explode/pivot.
    """
    key = depth.replace("cm", "")
    doc = F.from_json("payload", SOIL_SCHEMA)
    layers = doc["properties"]["layers"]
    out = payloads.withColumn("_layers", F.coalesce(layers, F.array().cast(
        "array<struct<name:string,depths:array<struct<label:string,values:struct<mean:double>>>>>")))
    cols = {}
    for prop, canon, factor in dims.SOIL_PROPERTIES:
        layer = F.get(F.filter("_layers", _name_is(prop)), 0)
        depths = layer["depths"]
        hit = F.get(F.filter(depths, lambda dd: (F.instr(dd["label"], key) > 0) | (dd["label"] == depth)), 0)
        v = F.coalesce(hit["values"]["mean"], F.get(depths, 0)["values"]["mean"])
        # divide by the integer divisor (as the reference does) rather than
        # multiplying by 0.1 / 0.01, which rounds differently
        cols[canon] = v / lit_d(round(1 / factor)) if factor < 1 else v * lit_d(factor)
    return out.withColumns(cols).drop("_layers")


def estimate_npk(soil: DataFrame) -> DataFrame:
    """Pedotransfer N/P/K (kg/ha), clamped, rounded to 1 dp."""
    n_from_n = clamp(F.col("nitrogen_g_kg") * lit_d(1950) * lit_d(0.03), 5.0, 400.0)
    n_from_soc = clamp(F.col("soc_g_kg") / lit_d(10.0) * lit_d(1950) * lit_d(0.03), 5.0, 400.0)
    p = clamp(F.col("soc_g_kg") * lit_d(2.5) + lit_d(5.0), 3.0, 200.0)
    k_from_cec = clamp(F.col("cec_mmol_kg") / lit_d(10.0) * lit_d(0.03) * lit_d(39.1) * lit_d(20), 5.0, 400.0)
    k_from_clay = clamp(F.col("clay_pct") * lit_d(1.5) + lit_d(10.0), 5.0, 400.0)
    return soil.withColumns({
        "N_kg_ha": F.round(F.coalesce(n_from_n, n_from_soc, lit_d(50.0)), 1),
        "P_kg_ha": F.round(F.coalesce(p, lit_d(25.0)), 1),
        "K_kg_ha": F.round(F.coalesce(k_from_cec, k_from_clay, lit_d(25.0)), 1),
    })


def soil_record(soil: DataFrame) -> DataFrame:
    """Modelled soil with N/P/K, or the default record when pH is missing."""
    s = estimate_npk(soil)
    miss = F.col("pH").isNull()
    return s.select(
        "location_id",
        F.when(miss, lit_d(6.5)).otherwise(F.col("pH")).alias("pH"),
        F.when(miss, lit_d(50.0)).otherwise(F.col("N_kg_ha")).alias("N_kg_ha"),
        F.when(miss, lit_d(25.0)).otherwise(F.col("P_kg_ha")).alias("P_kg_ha"),
        F.when(miss, lit_d(25.0)).otherwise(F.col("K_kg_ha")).alias("K_kg_ha"),
        F.when(miss, F.lit(None).cast("double")).otherwise(F.col("clay_pct")).alias("clay_pct"),
        F.when(miss, F.lit(None).cast("double")).otherwise(F.col("soc_g_kg")).alias("soc_g_kg"),
        F.when(miss, F.lit("defaults")).otherwise(F.lit("soilgrids")).alias("source"))


def soil_record_full(soil: DataFrame) -> DataFrame:
    """P21 + P23 with every property of the payload: texture (clay, sand, silt), carbon, nitrogen,
    exchange capacity and density beside N/P/K; without a pH the defaults, all else unknown."""
    s = estimate_npk(soil)
    miss = F.col("pH").isNull()
    defaults = {"pH": 6.5, "N_kg_ha": 50.0, "P_kg_ha": 25.0, "K_kg_ha": 25.0}
    names = [c for _, c, _ in dims.SOIL_PROPERTIES] + ["N_kg_ha", "P_kg_ha", "K_kg_ha"]
    return s.select("location_id", *[F.when(miss, F.lit(defaults.get(n)).cast("double")).otherwise(F.col(n)).alias(n) for n in names],
                    F.when(miss, F.lit("defaults")).otherwise(F.lit("soilgrids")).alias("source"))


# ---- weather (F3, F9, A13, A14, D2) -----------------------------------------

def weather_window(daily: DataFrame, as_of: str, years_back: int = 3) -> DataFrame:
    """end = as_of - 5 days, start = end - 365 * years_back."""
    end = F.date_sub(F.lit(as_of).cast("date"), 5)
    start = F.date_sub(end, 365 * years_back)
    return daily.where(F.col("d").between(start, end))


def weather_normals(daily: DataFrame) -> DataFrame:
    """A13 + F3: per location: mean temp/tmax/tmin/humidity (1 dp), annual rain
    = sum / max(1, n/365) (1 dp), data_points = non-null temperature count.
    NULL measures are skipped independently (avg/sum ignore NULL)."""
    n_rain = F.count("precip")
    return daily.groupBy("location_id").agg(
        F.round(F.avg("t_mean"), 1).alias("avg_temp_c"),
        F.round(F.avg("t_max"), 1).alias("temp_max_c"),
        F.round(F.avg("t_min"), 1).alias("temp_min_c"),
        F.round(F.avg("humidity"), 1).alias("humidity_pct"),
        F.round(F.sum("precip") / F.greatest(lit_d(1.0), n_rain / lit_d(365.0)), 1).alias("avg_precip_mm"),
        F.count("t_mean").alias("data_points"))


def season_filter(daily: DataFrame, season: str) -> DataFrame:
    """Keep only the season's months (rabi wraps Nov..Mar)."""
    months = {s: (a, b) for s, a, b in dims.SEASON_MONTHS}
    a, b = months[season]
    m = F.month("d")
    cond = m.between(a, b) if a <= b else (m >= a) | (m <= b)
    return daily.where(cond)


def growing_degree_days(daily: DataFrame, base_c: float, floor_at_zero: bool = True) -> DataFrame:
    """Sum over days of (mean temp - base), floored at 0 by default."""
    term = F.col("t_mean") - lit_d(base_c)
    if floor_at_zero:
        term = F.greatest(term, lit_d(0.0))
    return daily.groupBy("location_id").agg(F.round(F.sum(term), 4).alias("gdd"))


def seasonal_normals(daily: DataFrame, season: str, strict_compat: bool = False) -> DataFrame:
    """A season's normals with its tag.  The name is trimmed and lower-cased; an unknown season gives
    the whole year, untagged.  ``strict_compat`` keeps the reference's quirk: the tag without the month filter."""
    name = season.strip().lower()
    known = name in {s for s, _, _ in dims.SEASON_MONTHS}
    days = season_filter(daily, name) if known and not strict_compat else daily
    return weather_normals(days).withColumn("season", F.lit(name if known else None).cast("string"))


def crop_degree_days(daily: DataFrame, floor_at_zero: bool = True) -> DataFrame:
    """D2 by crop: degree days over each year's season of a crop above the crop's own base temperature.

    A day goes to the season it lies in (winter's January counts to the year before), and the crops of a
    season to its base by a small fixed table; days without a temperature add nothing.  One combinable aggregate."""
    from agrolens.operators.seasonal import season_of

    season, began = season_of(F.col("d"))
    by_season: dict[str, list] = {}
    for crop, of, base in dims.DEGREE_DAY_BASES:
        by_season.setdefault(of, []).append(F.struct(F.lit(crop).alias("crop"), lit_d(base).alias("base_c")))
    days = daily.select("location_id", "t_mean", season.alias("season"), began.alias("season_year")).where(F.col("season").isin(list(by_season)))
    crops = F.coalesce(*[F.when(F.col("season") == of, F.array(*rows)) for of, rows in by_season.items()])
    each = days.select("location_id", "season", "season_year", "t_mean", F.inline(crops))
    term = F.col("t_mean") - F.col("base_c")
    term = F.greatest(term, lit_d(0.0)) if floor_at_zero else term
    # ``greatest`` skips nulls, so a missing temperature is left out beforehand.
    term = F.when(F.col("t_mean").isNotNull(), term)
    return each.groupBy("location_id", "crop", "season", "season_year").agg(
        F.round(F.coalesce(F.sum(term), lit_d(0.0)), 4).alias("gdd"), F.count("t_mean").alias("n_days"))


# ---- market prices (R4, F5, W6, J11) ----------------------------------------

def latest_prices(prices: DataFrame) -> DataFrame:
    """F5 + W6: per (state, commodity) the most recent record with a numeric
    modal price > 0 (ties: lowest record id).  ``max(struct)`` is a combinable
    aggregate with map-side partial aggregation, so a hot commodity never
    lands in one task (a row_number window would)."""
    modal = F.col("modal_price").try_cast("double")
    valid = prices.withColumn("_modal", modal).where(F.col("_modal") > 0)
    best = F.max(F.struct(F.col("arrival_date"), (-F.col("record_id")).alias("neg_id"),
                          F.col("_modal").alias("modal"),
                          F.col("min_price").try_cast("double").alias("minp"),
                          F.col("max_price").try_cast("double").alias("maxp"), F.col("market")))
    return valid.groupBy("state", "commodity").agg(best.alias("b")).select(
        "state", "commodity", F.col("b.arrival_date").alias("arrival_date"),
        (-F.col("b.neg_id")).alias("record_id"), F.col("b.modal").alias("modal_price_per_quintal"),
        F.col("b.minp").alias("min_price_per_quintal"), F.col("b.maxp").alias("max_price_per_quintal"),
        F.col("b.market").alias("market"))


# ---- location profile / model input (J13, P23-P25, P30) ---------------------

SOURCE_GEO = "Nominatim/OpenStreetMap (geocoding)"
SOURCE_SOIL = "ISRIC SoilGrids v2.0 (modeled soil)"
SOURCE_WEATHER = "Open-Meteo ERA5 (weather)"
SOURCE_REGIONAL = "ICAR/MoA Crop Statistics (regional crops)"


def location_profile(resolved: DataFrame, soil: DataFrame, weather: DataFrame, strict_compat: bool = False) -> DataFrame:
    """J13 + P25 + P30: one row per resolved location: model input with
    defaults (N50 P25 K25 T27 H70 pH6.5 rain1000), the list of defaulted
    fields, and the ordered list of data sources used.  Every side is
    optional (left joins on location_id); a missing soil record counts as
    the default soil record.  Builds the intended ``coalesce`` behaviour; with
    ``strict_compat`` missing weather goes on as 0 and is not named, as in the reference."""
    dfl = dims.MODEL_INPUT_DEFAULTS | (dict.fromkeys(("temperature", "humidity", "rainfall"), 0.0) if strict_compat else {})
    named = F.lit(not strict_compat)
    states = [s.lower() for s in dims.STATE_CROPS]
    s = soil.select("location_id", F.col("pH").alias("_s_ph"), F.col("N_kg_ha").alias("_s_n"),
                    F.col("P_kg_ha").alias("_s_p"), F.col("K_kg_ha").alias("_s_k"), F.col("source").alias("_s_src"))
    w = weather.select("location_id", F.col("avg_temp_c").alias("_w_t"), F.col("humidity_pct").alias("_w_h"),
                       F.col("avg_precip_mm").alias("_w_r"))
    x = resolved.select("location_id", "state").join(s, "location_id", "left").join(w, "location_id", "left")
    soil_default = F.col("_s_src").isNull() | (F.col("_s_src") == "defaults")
    out = x.select(
        "location_id",
        F.coalesce("_s_n", lit_d(dfl["N"])).alias("N"), F.coalesce("_s_p", lit_d(dfl["P"])).alias("P"),
        F.coalesce("_s_k", lit_d(dfl["K"])).alias("K"),
        F.coalesce("_w_t", lit_d(dfl["temperature"])).alias("temperature"),
        F.coalesce("_w_h", lit_d(dfl["humidity"])).alias("humidity"),
        F.coalesce("_s_ph", lit_d(dfl["ph"])).alias("ph"),
        F.coalesce("_w_r", lit_d(dfl["rainfall"])).alias("rainfall"),
        F.array_join(F.array_compact(F.array(
            F.when(soil_default & (F.coalesce("_s_n", lit_d(dfl["N"])) == dfl["N"]), F.lit("N")),
            F.when(named & F.col("_w_t").isNull(), F.lit("temperature")),
            F.when(named & F.col("_w_h").isNull(), F.lit("humidity")),
            F.when(named & F.col("_w_r").isNull(), F.lit("rainfall")))), ", ").alias("used_defaults"),
        F.array_join(F.array_compact(F.array(
            F.lit(SOURCE_GEO), F.lit(SOURCE_SOIL),
            F.when(F.col("_w_t").isNotNull(), F.lit(SOURCE_WEATHER)),
            F.when(F.lower("state").isin(states), F.lit(SOURCE_REGIONAL)))), "; ").alias("data_sources"))
    return out


SOURCE_MARKET = "Agmarknet/data.gov.in (market prices)"
SOURCE_VEGETATION = "NASA POWER (satellite-derived)"
SOURCE_EXPORT = "APEDA/MoC Export Statistics (export scoring)"
WARN_SOIL = "SoilGrids API returned no data (service may be paused); using default soil values"
WARN_WEATHER = "Weather data unavailable; using defaults"


def market_by_state(prices: DataFrame, crops: list[str]) -> DataFrame:
    """Latest prices of the crops' commodities, gathered per state (at most one entry a crop)."""
    names = prices.sparkSession.createDataFrame(
        [(dims.CROP_TO_COMMODITY[c], c) for c in crops if c in dims.CROP_TO_COMMODITY], "commodity string, crop string")
    each = latest_prices(prices).join(F.broadcast(names), "commodity")
    entry = F.concat(F.col("crop"), F.lit(":"), F.col("modal_price_per_quintal").cast("bigint").cast("string"))
    return each.groupBy("state").agg(F.array_join(F.sort_array(F.collect_set(entry)), ", ").alias("market"))


def location_profile_full(resolved: DataFrame, profile: DataFrame, soil: DataFrame, market: DataFrame,
                          regional: DataFrame, vegetation: DataFrame, best: DataFrame) -> DataFrame:
    """J13 + P30: one row a resolved location with every side that has something to say,
    the ordered list of sources used and the warnings.

    The sides hold one row a location (market: a state) and are left-joined;
    Spark broadcasts those that are small."""
    reg = regional.groupBy("location_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("rank", "crop"))), lambda s: s["crop"]), ", ").alias("regional_crops"))
    x = (resolved.select("location_id", "state").join(profile.drop("data_sources"), "location_id")
         .join(soil.select("location_id", F.col("source").alias("_soil")), "location_id", "left")
         .join(market, "state", "left").join(reg, "location_id", "left")
         .join(vegetation.select("location_id", "vegetation_activity", "vegetation_score"), "location_id", "left")
         .join(best.select("location_id", F.col("crop").alias("best_export"), "export_score"), "location_id", "left"))
    no_weather = F.array_contains(F.split("used_defaults", ", "), "temperature")
    sources = F.array(
        F.lit(SOURCE_GEO), F.lit(SOURCE_SOIL), F.when(~no_weather, F.lit(SOURCE_WEATHER)),
        F.when(F.col("market").isNotNull(), F.lit(SOURCE_MARKET)), F.when(F.col("regional_crops").isNotNull(), F.lit(SOURCE_REGIONAL)),
        F.when(F.col("vegetation_score").isNotNull(), F.lit(SOURCE_VEGETATION)), F.when(F.col("best_export").isNotNull(), F.lit(SOURCE_EXPORT)))
    warned = F.array(F.when(F.coalesce("_soil", F.lit("defaults")) == "defaults", F.lit(WARN_SOIL)), F.when(no_weather, F.lit(WARN_WEATHER)))
    return x.select(*profile.drop("data_sources").columns, "market", "regional_crops", "vegetation_activity", "vegetation_score", "best_export",
                    "export_score", F.array_join(F.array_compact(sources), "; ").alias("data_sources"),
                    F.array_join(F.array_compact(warned), "; ").alias("warnings"))
