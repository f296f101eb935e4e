"""Evaluation / monitoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import ingest, metrics, rules
from agrolens.plans.common import d, rsql, samples
from agrolens.plans.oracle_fixtures import CROPS, dim_cte, with_fx
from agrolens.plans.q_ingest import PRODUCTION_SQL
from agrolens.plans.q_rules import KEYS, SCORED_CTES
from agrolens.plans.registry import register
from agrolens.sources import dims, fixtures
from agrolens.sources.tables import table

_REQ = with_fx("scored_requests")


@register("confusion_matrix", sql=_REQ + """
SELECT CAST(a.i AS INTEGER) AS actual_idx, CAST(p.i AS INTEGER) AS pred_idx,
       COALESCE(c.n, 0) AS n
FROM range(22) a(i) CROSS JOIN range(22) p(i)
LEFT JOIN (SELECT actual_idx, pred_idx, COUNT(*) AS n FROM scored_requests GROUP BY 1, 2) c
  ON c.actual_idx = a.i AND c.pred_idx = p.i""")
def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_long(fixtures.scored_requests(spark, sf_dir))


PRF_SQL = f"""prf0 AS (
  SELECT COALESCE(a.class_idx, p.class_idx) AS class_idx, COALESCE(a.support, 0) AS support,
         COALESCE(a.tp, 0) AS tp, COALESCE(p.predicted, 0) AS predicted
  FROM (SELECT actual_idx AS class_idx, COUNT(*) AS support,
               COUNT(*) FILTER (WHERE actual_idx = pred_idx) AS tp FROM scored_requests GROUP BY 1) a
  FULL OUTER JOIN (SELECT pred_idx AS class_idx, COUNT(*) AS predicted FROM scored_requests GROUP BY 1) p
    ON a.class_idx = p.class_idx
), prf1 AS (
  SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE {d(0.0)} END AS precision,
            CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE {d(0.0)} END AS recall
  FROM prf0
), prf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN {d(2.0)} * precision * recall / (precision + recall)
                 ELSE {d(0.0)} END AS f1 FROM prf1
)"""


@register("per_class_prf", sql=with_fx("scored_requests", extra=[PRF_SQL]) + f"""
SELECT CAST(class_idx AS INTEGER) AS class_idx, {CROPS}[class_idx + 1] AS crop,
       {rsql('precision', 6)} AS precision, {rsql('recall', 6)} AS recall, {rsql('f1', 6)} AS f1,
       support, tp, predicted
FROM prf""")
def q_per_class_prf(spark, sf_dir):
    return metrics.per_class_prf(fixtures.scored_requests(spark, sf_dir))


@register("macro_weighted", sql=with_fx("scored_requests", extra=[PRF_SQL, "prr AS (SELECT precision, recall, f1, support FROM prf)"]) + f"""
SELECT {rsql('AVG(precision)', 6)} AS macro_precision, {rsql('AVG(recall)', 6)} AS macro_recall,
       {rsql('AVG(f1)', 6)} AS macro_f1,
       {rsql('SUM(precision * support) / SUM(support)', 6)} AS weighted_precision,
       {rsql('SUM(recall * support) / SUM(support)', 6)} AS weighted_recall,
       {rsql('SUM(f1 * support) / SUM(support)', 6)} AS weighted_f1
FROM prr""")
def q_macro_weighted(spark, sf_dir):
    return metrics.macro_weighted(metrics.per_class_prf(fixtures.scored_requests(spark, sf_dir), digits=None))


@register("topk_accuracy", sql=with_fx("class_scores") + f"""
SELECT {rsql('AVG(CASE WHEN better < 1 THEN 1.0 ELSE 0.0 END)', 6)} AS top1_accuracy,
       {rsql('AVG(CASE WHEN better < 3 THEN 1.0 ELSE 0.0 END)', 6)} AS top3_accuracy,
       COUNT(*) AS n
FROM (
  SELECT e.vec_id, (SELECT COUNT(*) FROM class_scores c
                    WHERE c.vec_id = e.vec_id AND t.score IS NOT NULL
                      AND (c.score > t.score OR (c.score = t.score AND c.class_idx > t.class_idx))) AS better,
         t.score IS NOT NULL AS known
  FROM embeddings e LEFT JOIN class_scores t ON t.vec_id = e.vec_id AND t.class_idx = e.label
) WHERE TRUE""")
def q_topk_accuracy(spark, sf_dir):
    return metrics.topk_accuracy(table(spark, sf_dir, "embeddings"))


_BUCKET_ROWS = " UNION ALL ".join(
    f"SELECT '{b}' AS le, COUNT(*) FILTER (WHERE latency_s <= {d(b)}) AS n FROM scored_requests"
    for b in dims.LATENCY_BUCKETS) + " UNION ALL SELECT '+Inf', COUNT(*) FROM scored_requests"


@register("latency_histogram", sql=_REQ + _BUCKET_ROWS)
def q_latency_histogram(spark, sf_dir):
    return metrics.latency_histogram(fixtures.scored_requests(spark, sf_dir))


@register("latency_percentiles", sql=_REQ + f"""
SELECT {rsql('AVG(latency_s)', 6)} AS mean, {rsql('QUANTILE_CONT(latency_s, 0.5)', 6)} AS p50,
       {rsql('QUANTILE_CONT(latency_s, 0.95)', 6)} AS p95, {rsql('QUANTILE_CONT(latency_s, 0.99)', 6)} AS p99,
       {rsql('MIN(latency_s)', 6)} AS min, {rsql('MAX(latency_s)', 6)} AS max,
       QUANTILE_CONT(latency_s, 0.95) <= {d(0.3)} AS passed
FROM scored_requests""")
def q_latency_percentiles(spark, sf_dir):
    return metrics.latency_percentiles(fixtures.scored_requests(spark, sf_dir))


@register("prediction_counts", sql=with_fx("soil_samples", extra=SCORED_CTES) + """
SELECT crop, COUNT(*) AS n_predictions FROM top3 GROUP BY crop""")
def q_prediction_counts(spark, sf_dir):
    t = rules.rule_topk_long(samples(spark, sf_dir), KEYS, 3)
    return t.groupBy("crop").agg(F.count("*").alias("n_predictions"))


_AVG_Y = dim_cte("crop_avg_yield")


@register("yield_mae", sql=with_fx("crop_production", extra=[PRODUCTION_SQL, _AVG_Y]) + f"""
SELECT p.target_crop, {rsql('AVG(ABS(p.yield_kg_ha - COALESCE(y.kg_ha, 0)))', 2)} AS mae, COUNT(*) AS n
FROM production p LEFT JOIN crop_avg_yield y ON y.crop = p.target_crop
WHERE p.yield_kg_ha IS NOT NULL
GROUP BY ROLLUP (p.target_crop)""")
def q_yield_mae(spark, sf_dir):
    p = ingest.production_canonical(fixtures.crop_production(spark, sf_dir))
    return metrics.yield_mae(_with_fallback_yield(p, "target_crop", "predicted_yield"))


def _with_fallback_yield(df, crop_col, out_col):
    """Crop -> average yield from a 22-row dim (broadcast); missing -> 0."""
    dim = df.sparkSession.createDataFrame([(c, float(v)) for c, v in dims.CROP_AVG_YIELDS.items()],
                                          f"{crop_col} string, _kg double")
    return (df.join(F.broadcast(dim), crop_col, "left")
            .withColumn(out_col, F.coalesce(F.col("_kg"), F.lit(0.0))).drop("_kg"))


@register("predict_yield_fallback", sql=with_fx("scored_requests", extra=[_AVG_Y]) + f"""
SELECT r.request_id, {CROPS}[r.pred_idx + 1] AS crop, COALESCE(y.kg_ha, {d(0.0)}) AS expected_yield_kg_ha
FROM scored_requests r LEFT JOIN crop_avg_yield y ON y.crop = {CROPS}[r.pred_idx + 1]""")
def q_predict_yield_fallback(spark, sf_dir):
    r = fixtures.scored_requests(spark, sf_dir).select("request_id", metrics.crop_name("pred_idx").alias("crop"))
    return _with_fallback_yield(r, "crop", "expected_yield_kg_ha")


def _eval_long(spark, sf_dir):
    req = fixtures.scored_requests(spark, sf_dir)
    prf = metrics.per_class_prf(req)
    mw = metrics.macro_weighted(metrics.per_class_prf(req, digits=None))
    top = metrics.topk_accuracy(table(spark, sf_dir, "embeddings"))
    names = ["macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]
    overall = mw.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                            for n in names])).alias("s"))
    overall = overall.select(F.lit("overall").alias("scope"), "s.metric", "s.value")
    topk = top.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                                          for n in ["top1_accuracy", "top3_accuracy"]])).alias("s"))
    topk = topk.select(F.lit("overall").alias("scope"), "s.metric", "s.value")
    per = prf.where(F.col("support") > 0).select(
        F.col("crop").alias("scope"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                            for n in ["precision", "recall", "f1"]])).alias("s")).select("scope", "s.metric", "s.value")
    return overall.unionByName(topk).unionByName(per)


_TOPK_SQL = f"""topk AS (
  SELECT {rsql('AVG(CASE WHEN better < 1 THEN 1.0 ELSE 0.0 END)', 6)} AS top1_accuracy,
         {rsql('AVG(CASE WHEN better < 3 THEN 1.0 ELSE 0.0 END)', 6)} AS top3_accuracy
  FROM (SELECT (SELECT COUNT(*) FROM class_scores c
                WHERE c.vec_id = e.vec_id AND t.score IS NOT NULL
                  AND (c.score > t.score OR (c.score = t.score AND c.class_idx > t.class_idx))) AS better
        FROM embeddings e LEFT JOIN class_scores t ON t.vec_id = e.vec_id AND t.class_idx = e.label)
)"""
_PRR = f"""prr AS (
  SELECT class_idx, {rsql('precision', 6)} AS precision, {rsql('recall', 6)} AS recall, {rsql('f1', 6)} AS f1, support
  FROM prf)"""
_MW = f"""mw AS (
  SELECT {rsql('AVG(precision)', 6)} AS macro_precision, {rsql('AVG(recall)', 6)} AS macro_recall,
         {rsql('AVG(f1)', 6)} AS macro_f1,
         {rsql('SUM(precision * support) / SUM(support)', 6)} AS weighted_precision,
         {rsql('SUM(recall * support) / SUM(support)', 6)} AS weighted_recall,
         {rsql('SUM(f1 * support) / SUM(support)', 6)} AS weighted_f1
  FROM prf)"""
_EVAL_FX = with_fx("scored_requests", "class_scores", extra=[PRF_SQL, _PRR, _MW, _TOPK_SQL])
_UNPIVOT_MW = " UNION ALL ".join(f"SELECT 'overall' AS scope, '{n}' AS metric, {n} AS value FROM mw" for n in
                                 ["macro_precision", "macro_recall", "macro_f1", "weighted_precision",
                                  "weighted_recall", "weighted_f1"])
_UNPIVOT_TOP = " UNION ALL ".join(f"SELECT 'overall', '{n}', {n} FROM topk" for n in ["top1_accuracy", "top3_accuracy"])
_UNPIVOT_PRF = " UNION ALL ".join(f"SELECT {CROPS}[class_idx + 1], '{n}', {n} FROM prr WHERE support > 0"
                                  for n in ["precision", "recall", "f1"])


@register("eval_report", sql=_EVAL_FX + f"{_UNPIVOT_MW} UNION ALL {_UNPIVOT_TOP} UNION ALL {_UNPIVOT_PRF}")
def q_eval_report(spark, sf_dir):
    """Evaluation metrics as a long (scope, metric, value) table."""
    return _eval_long(spark, sf_dir)


_REMEDIATION = "Top-3 accuracy below target: add data, tune hyper-parameters or revisit features"


@register("target_gate", sql=_EVAL_FX + f"""
SELECT top3_accuracy, top3_accuracy >= {d(0.75)} AS passed,
       CASE WHEN top3_accuracy >= {d(0.75)} THEN 'Target met' ELSE '{_REMEDIATION}' END AS message
FROM topk""")
def q_target_gate(spark, sf_dir):
    """Success gate on top-3 accuracy (>= 0.75) with a remediation message."""
    t = metrics.topk_accuracy(table(spark, sf_dir, "embeddings"))
    ok = F.col("top3_accuracy") >= 0.75
    return t.select("top3_accuracy", ok.alias("passed"),
                    F.when(ok, F.lit("Target met")).otherwise(F.lit(_REMEDIATION)).alias("message"))
