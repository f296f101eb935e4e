"""Streaming queries (T2-T5); oracles are the equal batch answers."""

from __future__ import annotations

from agrolens.plans.common import SAMPLES_SQL, d
from agrolens.plans.oracle_fixtures import CROPS, with_fx
from agrolens.plans.registry import register
from agrolens.sources import dims
from agrolens.streaming import jobs


@register("stream_prediction_counts", sql=with_fx("scored_requests") + f"""
SELECT {CROPS}[pred_idx + 1] AS crop, COUNT(*) AS n_predictions FROM scored_requests GROUP BY 1""")
def q_stream_prediction_counts(spark, sf_dir):
    return jobs.prediction_counts_state(spark, sf_dir)


@register("stream_window_counts", sql="""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end,
       event_type, COUNT(*) AS n,
       (SELECT MAX(ts) FROM events) >= time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 3 HOUR AS closed
FROM events GROUP BY 1, 2, 3, 5""")
def q_stream_window_counts(spark, sf_dir):
    return jobs.window_counts_state(spark, sf_dir)


_BUCKETS = " UNION ALL ".join(
    f"SELECT '{b}' AS le, COUNT(*) FILTER (WHERE latency_s <= {d(b)}) AS n FROM scored_requests"
    for b in dims.LATENCY_BUCKETS) + " UNION ALL SELECT '+Inf', COUNT(*) FROM scored_requests"


@register("stream_latency_hist", sql=with_fx("scored_requests") + _BUCKETS)
def q_stream_latency_hist(spark, sf_dir):
    return jobs.latency_histogram(spark, sf_dir)


@register("stream_dedupe", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + """
SELECT sample_id, date, row_uid, target_crop FROM (
  SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY date, row_uid, target_crop) AS rn FROM samples) WHERE rn = 1""")
def q_stream_dedupe(spark, sf_dir):
    return jobs.dedupe(spark, sf_dir)


@register("stream_first_seen", sql=with_fx("soil_samples", extra=[SAMPLES_SQL]) + "SELECT DISTINCT sample_id FROM samples WHERE date IS NOT NULL")
def q_stream_first_seen(spark, sf_dir):
    return jobs.first_seen(spark, sf_dir)


def _gate_sql():
    parts = []
    for f in dims.REQUIRED_FEATURES:
        lo, hi = next((a, b) for n, a, b in dims.FEATURE_RANGES if n == f)
        parts.append(f"CASE WHEN {f} IS NULL OR isnan({f}) THEN 'missing:{f}' "
                     f"WHEN {f} < {d(lo)} OR {f} > {d(hi)} THEN 'range:{f}' END")
    gate = f"concat_ws(',', {', '.join(parts)})"
    return [SAMPLES_SQL.replace("samples AS (", "raw_samples AS (", 1),
            f"gated AS (SELECT *, {gate} AS violations FROM raw_samples)"]


@register("request_gate", sql=with_fx("soil_samples", extra=_gate_sql()) + """
SELECT row_uid, violations, violations = '' AS accepted FROM gated""")
def q_request_gate(spark, sf_dir):
    from agrolens.operators.serving import request_gate
    from agrolens.plans.common import samples
    return request_gate(samples(spark, sf_dir)).select("row_uid", "violations", "accepted")


def _stream_recommend_sql():
    from agrolens.plans.common import rsql
    from agrolens.plans.q_rules import SCORED_CTES
    ctes = _gate_sql() + ["samples AS (SELECT * FROM gated WHERE violations = '')"] + SCORED_CTES[1:]
    return with_fx("soil_samples", extra=ctes) + f"""
SELECT row_uid, sample_id, CAST(rk AS INTEGER) AS rank, crop,
       {rsql(f"score / CASE WHEN tot = 0 THEN {d(1.0)} ELSE tot END", 4)} AS probability,
       y.kg_ha AS expected_yield_kg_ha, {rsql("score", 4)} AS rule_score
FROM top3 JOIN crop_avg_yield y USING (crop)"""


@register("stream_recommend", sql=_stream_recommend_sql())
def q_stream_recommend(spark, sf_dir):
    return jobs.recommend(spark, sf_dir)["out"]


@register("stream_quarantine", sql=with_fx("soil_samples", extra=_gate_sql()) + """
SELECT row_uid, sample_id, violations FROM gated WHERE violations <> ''""")
def q_stream_quarantine(spark, sf_dir):
    return jobs.recommend(spark, sf_dir)["quarantine"]
