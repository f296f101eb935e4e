"""Scoring and evaluation with the fitted classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.ml import attribution, boosting
from agrolens.ml.registry import Saved
from agrolens.operators import features, metrics
from agrolens.sources import dims

#: Fixed text of the gate's advice.
REMEDIATION = "Top-3 accuracy below target: add data, tune hyper-parameters or revisit features"


def exclusive_groups(cols: list[str]) -> list[list[int]]:
    """Places of the indicators of each binned column."""
    return [[i for i, c in enumerate(cols) if c.startswith(f"{out}_")] for _, out, _, _ in dims.BINS]


def crop_at(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in dims.CROP_LABELS]), i + 1)


def recommend(samples: DataFrame, keys: list[str], model: boosting.Booster, saved: Saved, medians: DataFrame, k: int = 3, top_features: int = 5) -> DataFrame:
    """One nested row a sample: the top-k crops, each with probability, expected yield and its
    ``top_features`` contributions (to that crop's margin), the model's version and a checksum.

    Map-only: one Arrow UDF over the features.  Yields are the saved medians (a row a crop,
    22 at most), then the crop's average, then 0.  The checksum covers the result, the version and the model's own checksum.
    """
    spark = samples.sparkSession
    rows = {r.target_crop: float(r.yield_kg_ha_median) for r in medians.where(F.col("target_crop").isin(dims.CROP_LABELS) & F.col("yield_kg_ha_median").isNotNull()).collect()}
    yields = F.array(*[lit_d(round(rows.get(c, dims.CROP_AVG_YIELDS.get(c, 0.0)), 1)) for c in dims.CROP_LABELS])
    x = features.model_matrix(samples, keys)
    x = x.select(*keys, attribution.explained(model, spark, k, top_features).alias("_top"))
    crops = F.transform("_top", lambda t: F.struct(
        crop_at(t["class_idx"]).alias("crop"), F.round(t["probability"], 4).alias("probability"), F.element_at(yields, t["class_idx"] + 1).alias("expected_yield_kg_ha"),
        attribution.named(t["top"], model.features).alias("explanation")))
    x = x.withColumn("top", crops)
    text = F.array_join(F.transform("top", lambda c: F.concat_ws(":", c["crop"], F.format_string("%.4f", c["probability"]), F.format_string("%.1f", c["expected_yield_kg_ha"]))), "|")
    version = F.lit(f"{saved.name}-v{saved.version}")
    x = x.select(*keys, "top", text.alias("result"))  # made once, read twice
    return x.select(*keys, "top", version.alias("model_version"), F.lit(saved.checksum).alias("model_checksum"), "result",
                    F.sha2(F.concat_ws("|", version, F.lit(saved.checksum), "result"), 256).alias("checksum"))


def scored_rows(data: DataFrame, keys: list[str], model: boosting.Booster, k: int = 3) -> DataFrame:
    """(keys, label, pred_idx, rank of the true class, margin contributions): what the report is made of, in one pass."""
    x = data.withColumn("_r", boosting.ranked(model, data.sparkSession))
    rank = F.array_position(F.col("_r.class_idx"), F.col("label")).cast("int")
    return x.select(*keys, "location_id", F.col("label").alias("actual_idx"), F.get("_r.class_idx", F.lit(0)).alias("pred_idx"), rank.alias("true_rank"))


def importance(data: DataFrame, model: boosting.Booster) -> DataFrame:
    """Mean size of the attributions over rows and classes; a task's sums are a row a feature."""
    sums = attribution.booster_sizes(data, model).groupBy("j").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).where("n > 0")
    parts = sums.select("j", (F.col("size") / F.col("n")).alias("importance"))
    name = F.element_at(F.array(*[F.lit(c) for c in model.features]), F.col("j") + 1)
    return parts.select(name.alias("feature"), F.round("importance", 4).alias("importance"))


def report(scored: DataFrame, yields: DataFrame, importances: DataFrame, k: int = 3, target: float = 0.75) -> DataFrame:
    """S8 + A17 + M16: (scope, metric, value) rows from the scored rows (a stored table): accuracy, top-k,
    averages, per class, confusion cells that occur, yield MAE, importances and the gate."""
    def long(df: DataFrame, scope: Column, names: list[str]) -> DataFrame:
        items = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return df.select(scope.alias("scope"), F.explode(items).alias("s")).select("scope", "s.metric", "s.value")

    overall = scored.agg(F.round(F.avg((F.col("true_rank") == 1).cast("double")), 4).alias("top1_accuracy"), F.round(F.avg((F.col("true_rank") <= k).cast("double")), 4).alias("top3_accuracy"),
                         F.count("*").alias("test_set_size"), F.count_distinct("location_id").alias("n_test_locations"))
    overall = overall.withColumn("target_met", (F.col("top3_accuracy") >= target).cast("int"))
    per = metrics.per_class_prf(scored, digits=None)
    pairs = scored.groupBy("actual_idx", "pred_idx").agg(F.count("*").cast("double").alias("value"))
    mae = yields.select(F.coalesce("target_crop", F.lit("overall")).alias("scope"), F.lit("yield_mae").alias("metric"), F.col("mae").alias("value"))
    out = [long(overall, F.lit("overall"), ["top1_accuracy", "top3_accuracy", "test_set_size", "n_test_locations", "target_met"]),
           long(metrics.macro_weighted(per), F.lit("overall"), ["macro_f1", "weighted_f1"]),
           long(per.where("support > 0").select("crop", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")], "support"), F.col("crop"), ["precision", "recall", "f1", "support"]),
           pairs.select(crop_at(F.col("actual_idx")).alias("scope"), F.concat(F.lit("predicted:"), crop_at(F.col("pred_idx"))).alias("metric"), "value"),
           mae, importances.select(F.col("feature").alias("scope"), F.lit("importance").alias("metric"), F.col("importance").alias("value"))]
    got = out[0]
    for o in out[1:]:
        got = got.unionByName(o)
    return got


def gate(scored: DataFrame, k: int = 3, target: float = 0.75) -> DataFrame:
    """Top-k accuracy of the scored rows against the target, with advice."""
    a = scored.agg(F.round(F.avg((F.col("true_rank") <= k).cast("double")), 4).alias("top3_accuracy"), F.count("*").alias("n_test"))
    met = F.col("top3_accuracy") >= target
    return a.select("top3_accuracy", "n_test", met.alias("passed"), F.when(met, F.lit("Target met")).otherwise(F.lit(REMEDIATION)).alias("message"))
