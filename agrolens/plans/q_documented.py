"""Documented operators over projections of the tables."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from agrolens.operators import extras, location
from agrolens.plans import q_location as ql
from agrolens.plans import q_payloads as qp
from agrolens.plans.common import SAMPLES_SQL, d, rsql, samples
from agrolens.plans.oracle_fixtures import CROPS, with_fx
from agrolens.plans.registry import REGISTRY, register
from agrolens.sources import dims, fixtures
from agrolens.sources.tables import table

_FX = with_fx("soil_samples", extra=[SAMPLES_SQL])
_NAMES = ", ".join(f"('{c}', '{m}')" for c, m in dims.CROP_TO_COMMODITY.items())


def _economic_sql():
    prices = f"""prices AS (
  SELECT p.state, n.crop, p.modal_price_per_quintal AS price FROM ({REGISTRY["latest_price"].sql}) p
  JOIN (VALUES {_NAMES}) AS n(crop, commodity) USING (commodity)
)"""
    return f"""WITH rec AS ({REGISTRY["recommend_by_location"].sql}), loc AS ({REGISTRY["resolve_locations"].sql}), {prices}
SELECT r.location_id, r.crop, r.rank, {rsql(f'probability * expected_yield_kg_ha / {d(100.0)} * price', 2)} AS economic_value,
       CAST(row_number() OVER (PARTITION BY r.location_id ORDER BY {rsql(f'probability * expected_yield_kg_ha / {d(100.0)} * price', 2)} DESC NULLS LAST, r.rank) AS INTEGER) AS economic_rank
FROM rec r JOIN loc l USING (location_id) LEFT JOIN prices p ON p.state = l.state AND p.crop = r.crop"""


@register("economic_rank", sql=_economic_sql())
def q_economic_rank(spark, sf_dir):
    names = spark.createDataFrame(list(dims.CROP_TO_COMMODITY.items()), "crop string, commodity string")
    prices = location.latest_prices(fixtures.mandi_prices(spark, sf_dir)).join(F.broadcast(names), "commodity")
    prices = prices.select("state", "crop", F.col("modal_price_per_quintal").alias("price"))
    rec = ql.q_recommend_by_location(spark, sf_dir).join(ql._resolved(spark, sf_dir).select("location_id", "state"), "location_id")
    return extras.economic_rank(rec, prices).select("location_id", "crop", "rank", "economic_value", "economic_rank")


@register("ndvi_amplitude", sql=f"""WITH {qp._VEG_SQL}
SELECT location_id, parameter, MAX(value) - MIN(value) AS amplitude FROM veg WHERE value > 0 GROUP BY 1, 2""")
def q_ndvi_amplitude(spark, sf_dir):
    return extras.season_amplitude(qp.q_parse_veg_json(spark, sf_dir), ["location_id", "parameter"])


@register("moisture_index", sql=f"""WITH {qp.HISTORY_SQL}
SELECT record_id, d, {rsql('precip - t_max * 0.1', 4)} AS moisture_index FROM history""")
def q_moisture_index(spark, sf_dir):
    h = qp._history(spark, sf_dir).withColumn("pet", F.col("t_max") * F.lit(0.1).cast("double"))
    return extras.moisture_index(h).select("record_id", "d", F.round("moisture_index", 4).alias("moisture_index"))


@register("impute_layered", sql="""WITH v AS (
  SELECT c_custkey AS id, c_nationkey AS district, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 90 AS DOUBLE) END AS lab,
         CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 70 AS DOUBLE) END AS modelled FROM customer
), m AS (SELECT district, MEDIAN(lab) AS med FROM v WHERE lab IS NOT NULL GROUP BY 1)
SELECT id, COALESCE(lab, modelled, med) AS value, CASE WHEN lab IS NOT NULL THEN 'lab' WHEN modelled IS NOT NULL THEN 'modelled'
       WHEN med IS NOT NULL THEN 'district' END AS source FROM v LEFT JOIN m USING (district)""")
def q_impute_layered(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    v = c.select(k.alias("id"), F.col("c_nationkey").alias("district"), F.when(F.pmod(k, F.lit(3)) == 0, F.pmod(k, F.lit(90)).cast("double")).alias("lab"),
                 F.when(F.pmod(k, F.lit(4)) == 0, F.pmod(k, F.lit(70)).cast("double")).alias("modelled"))
    return extras.impute_layered(v).select("id", "value", "source")


_VOTE = "(o_orderkey + CASE WHEN o_custkey % (r + 2) = 0 THEN r ELSE 0 END) % 22"


@register("label_majority_vote", sql=f"""WITH votes AS (
  SELECT o_orderkey AS sample, {CROPS}[{_VOTE} + 1] AS label FROM orders, (VALUES (1), (2), (3)) AS n(r)
), c AS (SELECT sample, label, COUNT(*) AS n FROM votes GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY n DESC, label) AS rn, SUM(n) OVER (PARTITION BY sample) AS t FROM c)
SELECT sample, label, n AS votes, {rsql('CAST(n AS DOUBLE) / t', 4)} AS agreement, n >= 2 AS accepted FROM k WHERE rn = 1""")
def q_label_majority_vote(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("r"))
    shift = F.when(F.pmod("o_custkey", F.col("r") + 2) == 0, F.col("r")).otherwise(F.lit(0))
    label = F.element_at(F.array(*[F.lit(c) for c in dims.CROP_LABELS]), (F.pmod(F.col("o_orderkey") + shift, F.lit(22)) + 1).cast("int"))
    return extras.majority_vote(o.select(F.col("o_orderkey").alias("sample"), label.alias("label")), "sample")


def _season_flag(s, a, b):
    cond = f"month(date) BETWEEN {a} AND {b}" if a <= b else f"(month(date) >= {a} OR month(date) <= {b})"
    return f"CASE WHEN {cond} THEN 1 ELSE 0 END AS season_{s.lower()}"


@register("alt_features", sql=_FX + f"""SELECT row_uid, {rsql(f'N_kg_ha / GREATEST(P_kg_ha, {d(1.0)})', 6)} AS NP_ratio, {rsql(f'N_kg_ha / GREATEST(K_kg_ha, {d(1.0)})', 6)} AS NK_ratio,
       CASE WHEN pH < 5.5 THEN 'acidic' WHEN pH < 6.5 THEN 'slightly_acidic' WHEN pH <= 7.5 THEN 'neutral' WHEN pH > 7.5 THEN 'alkaline' END AS pH_level,
       {", ".join(_season_flag(*x) for x in dims.SEASON_MONTHS)} FROM samples""")
def q_alt_features(spark, sf_dir):
    x = extras.alternative_features(samples(spark, sf_dir))
    return x.select("row_uid", F.round("NP_ratio", 6).alias("NP_ratio"), F.round("NK_ratio", 6).alias("NK_ratio"), "pH_level",
                    *[f"season_{s.lower()}" for s, _, _ in dims.SEASON_MONTHS])


@register("geo_clusters", note="KMeans labels are not bit-reproducible across engines: rows-only")
def q_geo_clusters(spark, sf_dir):
    """Resolved locations clustered on latitude and longitude, k = 20."""
    r = ql._resolved(spark, sf_dir).where(F.col("error").isNull()).select("location_id", "latitude", "longitude")
    x = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="at").transform(r)
    return KMeans(k=20, seed=42, featuresCol="at", predictionCol="cluster").fit(x).transform(x).select("location_id", "cluster")


@register("stratified_folds", sql=_FX + """, c AS (SELECT location_id, target_crop, COUNT(*) AS n FROM samples WHERE target_crop IS NOT NULL GROUP BY 1, 2),
m AS (SELECT location_id, target_crop AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY n DESC, target_crop) AS rn FROM c) WHERE rn = 1)
SELECT location_id, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY sha256('42|' || CAST(location_id AS VARCHAR)), location_id) - 1) % 5 AS INTEGER) AS fold FROM m""")
def q_stratified_folds(spark, sf_dir):
    return extras.stratified_folds(samples(spark, sf_dir), "location_id", "target_crop")
