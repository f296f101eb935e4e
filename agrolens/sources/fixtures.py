"""Agricultural inputs projected from the driver tables (FIXTURES.md part B).

Each projection is map-only over its base table (plus a broadcast of a
22-row profile for FX1), so it scales linearly with the input and adds no
shuffle.  Integer arithmetic is written to stay inside BIGINT at any scale
factor: ``(k*p) % 2001`` is computed as ``((k%2001)*(p%2001)) % 2001``,
which is equal for non-negative operands but never overflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.sources import dims
from agrolens.sources.tables import table

_FX1_PRIMES = {"n": 7919, "p": 104729, "k": 1299709, "t": 15485863,
               "h": 32452843, "ph": 49979687, "r": 67867967}


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def state_name(idx: Column) -> Column:
    return F.element_at(_lit_array(dims.FIXTURE_STATES), idx.cast("int") + 1)


def _profile_value(k: Column, m: Column, s: Column, prime: int) -> Column:
    kp = F.pmod(F.pmod(k, F.lit(2001)) * F.lit(prime % 2001), F.lit(2001))
    step = F.floor((F.lit(4) * s * kp) / F.lit(2000)).cast("bigint")
    return ((m - F.lit(2) * s).cast("bigint") + step).cast("double") / F.lit(10.0)


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_shipdate"]


def soil_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: raw crop-sample rows (CSV schema of the reference) from lineitem."""
    li = table(spark, sf_dir, "lineitem").select(*LINEITEM_COLS)
    return soil_samples_from(spark, li)


def soil_samples_from(spark: SparkSession, li: DataFrame) -> DataFrame:
    """FX1 over any lineitem-shaped frame (batch or stream)."""
    k = (F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_suppkey") * 13
         + F.col("l_linenumber") * 7 + F.floor("l_quantity").cast("bigint") * 3)
    prof = F.broadcast(dims.dim(spark, "sample_profile"))
    df = (li.withColumn("k", k)
          .join(prof, F.pmod(F.col("l_partkey"), F.lit(22)) == prof.class_idx))

    def f(name):
        return _profile_value(F.col("k"), F.col(f"{name}_m"), F.col(f"{name}_s"), _FX1_PRIMES[name])

    return df.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string")).alias("sample_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_uid"),
        F.col("l_shipdate").cast("date").alias("sample_date"),
        F.pmod(F.col("k"), F.lit(20)).alias("location_id"),
        F.when(F.pmod("k", F.lit(499)) == 0, F.lit("quinoa"))
         .when(F.pmod("k", F.lit(5)) == 0, F.concat(F.lit("  "), F.upper("crop"), F.lit(" ")))
         .otherwise(F.col("crop")).alias("label"),
        F.greatest(f("n"), F.lit(0.0)).alias("N"),
        F.greatest(f("p"), F.lit(0.0)).alias("P"),
        F.greatest(f("k"), F.lit(0.0)).alias("K"),
        f("t").alias("temperature"),
        F.when(F.pmod("k", F.lit(211)) == 0, F.lit(120.0))
         .otherwise(F.least(f("h"), F.lit(100.0))).alias("humidity"),
        F.when(F.pmod("k", F.lit(97)) == 0, F.lit(None).cast("double"))
         .otherwise(f("ph")).alias("ph"),
        F.greatest(f("r"), F.lit(0.0)).alias("rainfall"),
        (F.lit(8.0) + F.pmod(F.col("l_suppkey") * 37, F.lit(2700)).cast("double") / 100).alias("lat"),
        (F.lit(68.0) + F.pmod(F.col("l_suppkey") * 53, F.lit(2900)).cast("double") / 100).alias("lon"),
    )


def crop_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: raw production rows (State_Name ... Production) from orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("record_id"),
        state_name(F.pmod("o_custkey", F.lit(13))).alias("State_Name"),
        F.concat(F.lit("District_"), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("District_Name"),
        (F.lit(2015) + F.pmod("o_orderkey", F.lit(8))).cast("int").alias("Crop_Year"),
        F.element_at(_lit_array(dims.FIXTURE_SEASONS),
                     F.pmod("o_custkey", F.lit(3)).cast("int") + 1).alias("Season"),
        F.element_at(_lit_array(dims.CROP_LABELS),
                     F.pmod("o_orderkey", F.lit(22)).cast("int") + 1).alias("Crop"),
        (F.pmod("o_custkey", F.lit(50)) * 10).cast("double").alias("Area"),
        (F.col("o_totalprice") / 100).alias("Production"),
    )


def _event_v(col: str = "value") -> Column:
    return F.floor(F.col(col) * 100 + F.lit(0.5)).cast("bigint")


def weather_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: daily weather rows (one per event) keyed by location and date."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    v = _event_v()
    t_mean = F.when(F.col("event_type") == "error", F.lit(None).cast("double")) \
        .otherwise(F.lit(10.0) + F.pmod(v, F.lit(2500)).cast("double") / 100)
    return ev.select(
        "event_id",
        F.pmod("user_id", F.lit(20)).alias("location_id"),
        F.col("ts").cast("date").alias("d"),
        t_mean.alias("t_mean"),
        (t_mean + F.lit(5.0)).alias("t_max"),
        (t_mean - F.lit(5.0)).alias("t_min"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("double"))
         .otherwise(F.pmod(v, F.lit(300)).cast("double") / 10).alias("precip"),
        (F.lit(20) + F.pmod(v, F.lit(80))).cast("double").alias("humidity"),
    )


def locations_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: free-text location strings (PIN, coordinates, junk, blank)."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    ck = F.col("c_custkey")
    kind = F.pmod(ck, F.lit(5))
    coords = F.concat((F.lit(8) + F.pmod(ck, F.lit(27))).cast("string"), F.lit("."),
                      F.pmod(ck, F.lit(10)).cast("string"), F.lit(" , "),
                      (F.lit(68) + F.pmod(ck, F.lit(29))).cast("string"), F.lit(".5"))
    bad_lat = F.concat(F.lit(" 9"), F.pmod(ck, F.lit(10)).cast("string"), F.lit(".25,77.5 "))
    loc = (F.when(kind == 0, (F.lit(100000) + ck).cast("string"))
           .when(kind == 1, coords).when(kind == 2, bad_lat)
           .when(kind == 3, F.lit("not-a-location")).otherwise(F.lit("  ")))
    return c.select(ck.alias("location_id"), loc.alias("location"))


def pin_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: postal directory (pin -> lat/lon/state/district/place)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    ck = F.col("c_custkey")
    return c.where((F.pmod(ck, F.lit(5)) == 0) & (F.pmod(ck, F.lit(3)) != 0)).select(
        (F.lit(100000) + ck).cast("string").alias("pin"),
        (F.lit(8.0) + F.pmod(ck * 37, F.lit(2700)).cast("double") / 100).alias("lat"),
        (F.lit(68.0) + F.pmod(ck * 53, F.lit(2900)).cast("double") / 100).alias("lon"),
        state_name(F.pmod("c_nationkey", F.lit(18))).alias("state"),
        F.concat(F.lit("District_"), F.col("c_nationkey").cast("string")).alias("district"),
        F.when(F.pmod(ck, F.lit(7)) == 0, F.lit(None).cast("string"))
         .otherwise(F.col("c_mktsegment")).alias("place"),
    )


def soil_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX6: raw soil-service JSON payloads, one per supplier-located point."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    sk = F.col("s_suppkey")
    ph = (F.lit(45) + F.pmod(sk * 7, F.lit(45))).cast("string")
    soc = (F.lit(50) + F.pmod(sk * 17, F.lit(200))).cast("string")

    def layer(name, depths):
        inner = ",".join('{"label":"%s","values":{"mean":%s}}' % (lbl, "%s") for lbl, _ in depths)
        parts = inner.split("%s")
        cols = []
        for i, (_, val) in enumerate(depths):
            cols += [F.lit(parts[i]), val if isinstance(val, Column) else F.lit(str(val))]
        cols.append(F.lit(parts[-1]))
        return F.concat(F.lit('{"name":"%s","depths":[' % name), *cols, F.lit("]}"))

    payload = F.concat(
        F.lit('{"properties":{"layers":['),
        layer("phh2o", [("0-5cm", ph)]), F.lit(","),
        layer("clay", [("0-5cm", 250)]), F.lit(","),
        layer("soc", [("5-15cm", 1), ("0-5cm", soc)]), F.lit(","),
        layer("nitrogen", [("0-5cm", 500)]), F.lit(","),
        layer("cec", [("0-5cm", 150)]),
        F.lit("]}}"))
    return s.select(
        sk.alias("location_id"),
        F.when(F.pmod(sk, F.lit(11)) == 0, F.lit("{}")).otherwise(payload).alias("payload"),
    )


def mandi_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX7: market price records with text prices, some unusable."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    ok = F.col("o_orderkey")
    commodities = list(dims.CROP_TO_COMMODITY.values())
    num = F.lit(800) + F.pmod(ok * 37, F.lit(4000))
    modal = (F.when(F.pmod(ok, F.lit(13)) == 0, F.lit("NA"))
             .when(F.pmod(ok, F.lit(29)) == 0, F.lit("0")).otherwise(num.cast("string")))
    return o.select(
        ok.alias("record_id"),
        state_name(F.pmod("o_custkey", F.lit(18))).alias("state"),
        F.element_at(_lit_array(commodities), F.pmod(ok, F.lit(17)).cast("int") + 1).alias("commodity"),
        F.col("o_orderdate").cast("date").alias("arrival_date"),
        modal.alias("modal_price"),
        (num - 150).cast("string").alias("min_price"),
        (num + 150).cast("string").alias("max_price"),
        F.concat(F.lit("Market_"), F.pmod("o_custkey", F.lit(7)).cast("string")).alias("market"),
    )


def scored_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX8: scored requests with latency, true and predicted class, trial arm."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    v = _event_v()
    actual = F.pmod("user_id", F.lit(22))
    return ev.select(
        F.col("event_id").alias("request_id"),
        "ts",
        (F.pmod(v, F.lit(1500)).cast("double") / 1000).alias("latency_s"),
        actual.cast("int").alias("actual_idx"),
        F.when(F.pmod("event_id", F.lit(4)) == 0, F.pmod(F.col("user_id") + 1, F.lit(22)))
         .otherwise(actual).cast("int").alias("pred_idx"),
        F.when(F.pmod("user_id", F.lit(2)) == 0, F.lit("control")).otherwise(F.lit("treatment")).alias("arm"),
    )


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX9: long (vec_id, class_idx, score) from the first 22 embedding values."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (e.select("vec_id", F.posexplode(F.slice("embedding", 1, 22)).alias("class_idx", "score"))
            .select("vec_id", F.col("class_idx").cast("int"), F.col("score").cast("double")))


def trial_harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX10: harvests of trial farms in 60 village clusters of four zones, with costs, revenue, recommended and chosen crop."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    ok, cluster = F.col("o_orderkey"), F.pmod("o_custkey", F.lit(60))
    moved = F.when(F.pmod(ok, F.lit(5)) == 0, 1).when(F.pmod(ok, F.lit(7)) == 0, 4).otherwise(0)
    return o.select(
        ok.alias("harvest_id"), F.col("o_custkey").alias("farm_id"), cluster.alias("cluster_id"),
        F.pmod(cluster, F.lit(4)).alias("zone"), (F.pmod(cluster, F.lit(3)) == 0).alias("irrigated"),
        F.when(F.pmod(ok, F.lit(23)) != 0, F.col("o_totalprice") / (F.pmod("o_custkey", F.lit(50)) + 10)).alias("yield_kg_ha"),
        F.col("o_totalprice").alias("revenue"), ((F.pmod("o_custkey", F.lit(50)) + 1) * 500).cast("double").alias("input_cost"),
        F.pmod(ok, F.lit(22)).cast("int").alias("recommended_idx"), F.pmod(ok + moved, F.lit(22)).cast("int").alias("chosen_idx"))
