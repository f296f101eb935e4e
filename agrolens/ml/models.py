"""Learning jobs on ``pyspark.ml``.

Splits are by group (location), seeded through ``sha2`` so they are
reproducible on any cluster; training and scoring are distributed by
``pyspark.ml``; top-k over class probabilities is computed per row.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import with_scalars
from agrolens.functions.joins import join_small
from agrolens.functions.ranking import group_row_number
from agrolens.ml import boosting
from agrolens.operators import features, ingest
from agrolens.sources import dims


def group_hash(group: str, seed: int = 42):
    return F.sha2(F.concat(F.lit(str(seed)), F.lit("|"), F.col(group).cast("string")), 256)


def holdout_groups(df: DataFrame, group: str = "location_id", seed: int = 42, denom: int = 5) -> DataFrame:
    """M2: max(1, groups // denom) groups with the smallest seeded hash are held out."""
    g = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_h", group_hash(group, seed))
    ranked = group_row_number(g, ["_h", group], "_rn")
    n = g.agg(F.count("*").alias("_ng"))
    return with_scalars(ranked, n).select(
        group, (F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_ng") / denom))).alias("is_test"))


def group_folds(df: DataFrame, group: str = "location_id", k: int = 5) -> DataFrame:
    """M3: groups by size desc (ties: group id) dealt round-robin into min(k, groups) folds."""
    sizes = df.groupBy(group).agg(F.count("*").alias("group_size"))
    ranked = group_row_number(sizes, [F.desc("group_size"), F.asc(group)], "_rn")
    n = sizes.agg(F.count("*").alias("_ng"))
    return with_scalars(ranked, n).select(
        group, "group_size", F.pmod(F.col("_rn") - 1, F.least(F.lit(k), F.col("_ng"))).cast("int").alias("fold"))


def _label_rows(spark) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c, i) for i, c in enumerate(dims.CROP_LABELS)], "target_crop string, label int"))


def labelled(samples: DataFrame) -> DataFrame:
    """Encode target_crop -> class index; rows with other labels are in ``label_quarantine``."""
    return samples.join(_label_rows(samples.sparkSession), "target_crop")


def label_quarantine(samples: DataFrame) -> DataFrame:
    """The rows that ``labelled`` cannot encode, with the reason; both together are the input."""
    out = samples.join(_label_rows(samples.sparkSession).select("target_crop"), "target_crop", "left_anti")
    return out.withColumn("reason", F.when(F.col("target_crop").isNull(), F.lit("missing label")).otherwise(F.lit("unknown label")))


def feature_frame(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    m = features.model_matrix(samples, keys + ["label", "location_id"])
    cols = [c for c in m.columns if c not in keys + ["label", "location_id"]]
    return VectorAssembler(inputCols=cols, outputCol="features").transform(m), cols


def _estimator(backend: str, params: dict, seed: int = 42):
    """M4: ``logit`` (multinomial logistic regression) or ``rf`` (random forest, 200 trees by default)."""
    common = {"featuresCol": "features", "labelCol": "label"}
    if backend == "rf":
        return RandomForestClassifier(**common, seed=seed, **{"numTrees": 200, "maxDepth": 8, **params})
    return LogisticRegression(**common, family="multinomial", **{"maxIter": 50, **params})


def classifier_data(samples: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Feature rows with ``label`` and ``is_test`` (M2: whole groups are held out), dealt over all cores and
    written once: every pass of a fit reads them."""
    lab = labelled(samples)
    data, cols = feature_frame(boosting.spread(lab, keys), keys)
    return boosting.stored(join_small(data, holdout_groups(lab), "location_id")), cols


def train_classifier(data: DataFrame, backend: str = "logit", **params):
    """M4: fit on the training groups."""
    return _estimator(backend, params).fit(data.where(~F.col("is_test")))


def _ranked_classes():
    """Classes of a row, most probable first (ties: higher class index first)."""
    return F.sort_array(F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("neg"), (-i).alias("neg_idx"))))


def topk_from_probabilities(scored: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """W3 + M5: top-k classes per row by probability."""
    out = scored.select(*keys, "label", F.posexplode(F.slice(_ranked_classes(), 1, k)).alias("pos", "t"))
    return out.select(*keys, "label", (F.col("pos") + 1).cast("int").alias("rank"),
                      (-F.col("t.neg_idx")).cast("int").alias("class_idx"),
                      F.round(-F.col("t.neg"), 4).alias("probability"))


def accuracy(scored: DataFrame, k: int = 3) -> DataFrame:
    """A17 for a classifier: top-1 and top-k accuracy, asked in the row, one global average."""
    at = F.array_position(F.transform(F.slice(_ranked_classes(), 1, k), lambda s: -s["neg_idx"]), F.col("label"))
    r = scored.select(at.alias("at"))
    return r.agg(F.avg((F.col("at") == 1).cast("double")).alias("top1_accuracy"),
                 F.avg((F.col("at") > 0).cast("double")).alias("topk_accuracy"), F.count("*").alias("n_test"))


def tune_classifier(samples: DataFrame, keys: list[str], grid: list[tuple[str, dict]], k: int = 5) -> list[tuple]:
    """M6: mean top-3 accuracy over the group folds for each (backend, params) of ``grid``, best first."""
    lab = labelled(samples)
    data, _ = feature_frame(lab, keys)
    data = join_small(data, group_folds(lab, k=k).select("location_id", "fold"), "location_id").persist()
    try:
        folds = [r.fold for r in data.select("fold").distinct().orderBy("fold").collect()]  # at most k
        out = []
        for i, (backend, params) in enumerate(grid):
            got = [accuracy(_estimator(backend, params).fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f))).first() for f in folds]
            out.append((i, backend, str(sorted(params.items())), len(folds), sum(r.topk_accuracy for r in got) / len(folds)))
        return sorted(out, key=lambda r: (-r[-1], r[0]))
    finally:
        data.unpersist()


def zones_kmeans(samples: DataFrame, keys: list[str], k: int = 20, seed: int = 42, starts: int = 10) -> DataFrame:
    """M1: agro-climatic zones = KMeans on z-scored temp, humidity, rain, pH;
    the best of ``starts`` seeds by training cost."""
    cols = ["avg_temp_c", "humidity_pct", "avg_precip_mm", "pH"]
    z = ingest.zscore_features(boosting.stored(boosting.spread(samples.select(*keys, *cols), keys)), cols)
    vec = VectorAssembler(inputCols=[f"{c}_z" for c in cols], outputCol="features").transform(z)
    points = vec.select("features").persist()
    models = [KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="zone").fit(points) for i in range(starts)]
    points.unpersist()
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model.transform(vec).select(*keys, F.col("zone").cast("int"))


def yield_rows(production: DataFrame) -> DataFrame:
    """Rows of the yield model with ``is_test``: whole districts are held out."""
    base = production.select("record_id", "target_crop", "season", "year", "district", F.col("area_ha").cast("double"), "yield_kg_ha")
    return join_small(base, holdout_groups(production, "district"), "district", "left")


def yield_fit_gate(rows: DataFrame, min_rows: int = 10) -> DataFrame:
    """rows with a yield to fit on, and whether they are more than ``min_rows``, the reference's own rule."""
    n = F.count("yield_kg_ha")
    return rows.agg(n.alias("n_valid"), (n > min_rows).alias("fits"))


def train_yield(production: DataFrame, min_rows: int = 10, max_iter: int = 100, seed: int = 42, strict_compat: bool = False) -> DataFrame:
    """M7 + M8 + F2 + S10: yield regressor with per-crop median fallback.

    Fits ``max_iter`` boosted trees (depth 5, step 0.1) on the training rows
    that have a yield, using area, year and one-hot season and crop (the crop
    is a feature, so each crop gets its own estimate; with ``strict_compat`` the
    model does not see the crop, as in the reference, and all crops of a place,
    season and year get one estimate).  With ``min_rows`` such
    rows or fewer the model is skipped.  Predictions fall back to the exact
    per-crop training median, then 0.  The fitted pipeline is saved to and
    reloaded from the shared folder.
    """
    import uuid

    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    from pyspark.ml.regression import GBTRegressor

    from agrolens.session import shared_dir

    rows = yield_rows(production)
    train = rows.where(~F.col("is_test"))
    medians = ingest.yield_median_by_crop(train).select("target_crop", "yield_kg_ha_median")
    out = join_small(rows, medians, "target_crop", "left")
    keep = ["record_id", "target_crop", "yield_kg_ha", "is_test"]
    if not yield_fit_gate(train, min_rows).first().fits:
        return out.select(*keep, F.coalesce("yield_kg_ha_median", F.lit(0.0)).alias("predicted_yield"))
    stages = [StringIndexer(inputCol="target_crop", outputCol="_ci", handleInvalid="keep"),
              StringIndexer(inputCol="season", outputCol="_si", handleInvalid="keep"),
              OneHotEncoder(inputCols=["_ci", "_si"], outputCols=["_co", "_so"], handleInvalid="keep"),
              VectorAssembler(inputCols=["area_ha", "year", *([] if strict_compat else ["_co"]), "_so"], outputCol="features",
                              handleInvalid="keep"),
              GBTRegressor(featuresCol="features", labelCol="yield_kg_ha", maxDepth=5, maxIter=max_iter,
                           stepSize=0.1, seed=seed, predictionCol="_pred", cacheNodeIds=True)]
    known = boosting.stored(boosting.spread(train.where(F.col("yield_kg_ha").isNotNull()), ["record_id"]))
    model = Pipeline(stages=stages).fit(known)
    path = shared_dir(production.sparkSession, f"models/yield-{uuid.uuid4().hex[:12]}")
    model.write().overwrite().save(path)
    scored = PipelineModel.load(path).transform(out)
    return scored.select(*keep, F.coalesce("_pred", "yield_kg_ha_median", F.lit(0.0)).alias("predicted_yield"))


def _feature_means(data: DataFrame, cols: list[str]) -> dict:
    """Training-set means (one aggregation, one row to the driver)."""
    row = data.agg(*[F.avg(c).alias(c) for c in cols]).first()
    return {c: float(row[c] or 0.0) for c in cols}


def linear_attributions(model, data: DataFrame, cols: list[str], keys: list[str], top_n: int = 5) -> DataFrame:
    """M10 + W11: per row, contribution of each feature to the predicted
    class's margin, coef[pred, j] * (x_j - mean_j) (exact Shapley values of
    a linear model under feature independence); the ``top_n`` by absolute
    value.  Coefficients are a fixed 22 x n_features matrix (inlined)."""
    coef = model.coefficientMatrix.toArray()
    means = _feature_means(data.where(~F.col("is_test")), cols)
    scored = model.transform(data.where(F.col("is_test")))
    pred = F.col("prediction").cast("int")
    items = []
    for j, c in enumerate(cols):
        w = F.element_at(F.array(*[F.lit(float(coef[k][j])) for k in range(coef.shape[0])]), pred + 1)
        items.append(F.struct((-F.abs(w * (F.col(c) - F.lit(means[c])))).alias("neg_abs"), F.lit(c).alias("feature"),
                              (w * (F.col(c) - F.lit(means[c]))).alias("contribution")))
    top = F.slice(F.sort_array(F.array(*items)), 1, top_n)
    out = scored.select(*keys, pred.alias("class_idx"), F.posexplode(top).alias("pos", "t"))
    return out.select(*keys, "class_idx", (F.col("pos") + 1).cast("int").alias("rank"),
                      F.col("t.feature").alias("feature"), F.round("t.contribution", 4).alias("contribution"))


def global_importance(model, data: DataFrame, cols: list[str]) -> DataFrame:
    """M12 + W12: mean |attribution| over rows and classes, all features, sorted desc (4 dp).

    mean_{rows,classes} |coef[c,j] (x_j - mu_j)| = mean_c |coef[c,j]| *
    mean_rows |x_j - mu_j|, so one aggregation over the data suffices."""
    import numpy as np
    coef = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    train = data.where(~F.col("is_test"))
    means = _feature_means(train, cols)
    dev = train.agg(*[F.avg(F.abs(F.col(c) - F.lit(means[c]))).alias(c) for c in cols])
    items = [F.struct(F.lit(c).alias("feature"), (F.col(c) * F.lit(float(coef[j]))).alias("importance"))
             for j, c in enumerate(cols)]
    long = dev.select(F.explode(F.array(*items)).alias("s")).select("s.feature", "s.importance")
    ranked = group_row_number(long, [F.desc("importance"), F.asc("feature")], "rank")
    return ranked.select(
        F.col("rank").cast("int"), "feature", F.round("importance", 4).alias("importance"))


def importance_fallback(data: DataFrame, cols: list[str], num_trees: int = 200, seed: int = 42) -> DataFrame:
    """Importances of a forest of ``num_trees``, joined to feature names (``unknown`` beyond them)."""
    model = train_classifier(data, "rf", numTrees=num_trees)
    imp = model.featureImportances.toArray()
    rows = [(cols[j] if j < len(cols) else "unknown", float(v)) for j, v in enumerate(imp)]
    return data.sparkSession.createDataFrame(rows, "feature string, importance double") \
        .select("feature", F.round("importance", 4).alias("importance"))


def append_run(row: DataFrame, path: str, run_id: str) -> None:
    """One run's row, in a folder of its own under the runs table, so a repeated write replaces it."""
    row.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")
