"""Rule recommender queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import rules
from agrolens.plans.common import SAMPLES_SQL, d, rsql, samples
from agrolens.plans.oracle_fixtures import dim_cte, with_fx
from agrolens.plans.registry import register

KEYS = ["row_uid", "sample_id"]

_FEATS = [("N_kg_ha", "n"), ("P_kg_ha", "p"), ("K_kg_ha", "k"), ("avg_temp_c", "t"),
          ("humidity_pct", "h"), ("pH", "ph"), ("avg_precip_mm", "r")]


def _term_sql(v: str, lo: str, hi: str) -> str:
    return (f"(CASE WHEN {v} IS NULL THEN {d(0.0)} WHEN {v} >= {lo} AND {v} <= {hi} THEN {d(1.0)} "
            f"WHEN {v} < {lo} THEN GREATEST({d(0.0)}, {d(1.0)} - ({lo} - {v}) / GREATEST({lo}, {d(1.0)})) "
            f"ELSE GREATEST({d(0.0)}, {d(1.0)} - ({v} - {hi}) / GREATEST({hi}, {d(1.0)})) END)")


SCORE_SQL = "(" + " + ".join(_term_sql(f"s.{c}", f"c.{p}_lo", f"c.{p}_hi") for c, p in _FEATS) + f") / {d(7.0)}"

SCORED_CTES = [SAMPLES_SQL, dim_cte("crop_rule"), dim_cte("crop_avg_yield"), f"""scored AS (
  SELECT s.rid, s.row_uid, s.sample_id, s.target_crop, c.rule_idx, c.crop, {SCORE_SQL} AS score,
         s.N_kg_ha, s.P_kg_ha, s.K_kg_ha, s.avg_temp_c, s.humidity_pct, s.pH, s.avg_precip_mm
  FROM (SELECT row_number() OVER (ORDER BY row_uid, date, N_kg_ha, P_kg_ha, K_kg_ha, avg_temp_c,
                                           humidity_pct, pH, avg_precip_mm, target_crop) AS rid, *
        FROM samples) s CROSS JOIN crop_rule c
)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, rule_idx) AS rk FROM scored
)""", """top3 AS (
  SELECT *, MAX(CASE WHEN rk = 1 THEN score END) OVER (PARTITION BY rid)
            + MAX(CASE WHEN rk = 2 THEN score END) OVER (PARTITION BY rid)
            + MAX(CASE WHEN rk = 3 THEN score END) OVER (PARTITION BY rid) AS tot
  FROM ranked WHERE rk <= 3
)"""]


@register("rule_top3", sql=with_fx("soil_samples", extra=SCORED_CTES) + f"""
SELECT row_uid, sample_id, CAST(rk AS INTEGER) AS rank, crop,
       {rsql(f"score / CASE WHEN tot = 0 THEN {d(1.0)} ELSE tot END", 4)} AS probability,
       y.kg_ha AS expected_yield_kg_ha, {rsql("score", 4)} AS rule_score
FROM top3 JOIN crop_avg_yield y USING (crop)""")
def q_rule_top3(spark, sf_dir):
    return rules.rule_top(samples(spark, sf_dir), KEYS)


@register("rule_scores", sql=with_fx("soil_samples", extra=SCORED_CTES[:3]) + f"""
SELECT s.row_uid, s.sample_id, c.crop, CAST(c.rule_idx AS INTEGER) AS rule_idx, {rsql(SCORE_SQL, 6)} AS score
FROM samples s CROSS JOIN crop_rule c""")
def q_rule_scores(spark, sf_dir):
    return rules.rule_scores_long(samples(spark, sf_dir), KEYS, 6).select(*KEYS, "crop", "rule_idx", "score")


@register("baseline_accuracy", sql=with_fx("soil_samples", extra=SCORED_CTES) + f"""
SELECT {rsql("AVG(CASE WHEN hit1 THEN 1.0 ELSE 0.0 END)", 4)} AS top1_accuracy,
       {rsql("AVG(CASE WHEN hit3 THEN 1.0 ELSE 0.0 END)", 4)} AS top3_accuracy,
       COUNT(*) AS total_samples
FROM (SELECT rid, COALESCE(BOOL_OR(rk = 1 AND crop = target_crop), FALSE) AS hit1,
             COALESCE(BOOL_OR(crop = target_crop), FALSE) AS hit3
      FROM ranked WHERE rk <= 3 GROUP BY rid)""")
def q_baseline_accuracy(spark, sf_dir):
    return rules.baseline_accuracy(samples(spark, sf_dir), KEYS)


_EXPLAIN_COLS = ",\n       ".join(
    f"{rsql(_term_sql('s.' + c, 'c.' + p + '_lo', 'c.' + p + '_hi'), 4)} AS c_{c}" for c, p in _FEATS)


@register("rule_explain", sql=with_fx("soil_samples", extra=SCORED_CTES[:5]) + f"""
SELECT s.row_uid, s.sample_id, c.crop, {rsql("s.score", 4)} AS rule_score,
       {_EXPLAIN_COLS}
FROM ranked s JOIN crop_rule c ON c.rule_idx = s.rule_idx
WHERE s.rk = 1""")
def q_rule_explain(spark, sf_dir):
    return rules.rule_explain(samples(spark, sf_dir), KEYS)


def _topk_sql(k: int) -> str:
    total = " + ".join(f"COALESCE(MAX(CASE WHEN rk = {i} THEN score END) OVER (PARTITION BY rid), {d(0.0)})" for i in range(1, k + 1))
    topk = f"topk AS (SELECT *, {total} AS tot FROM ranked WHERE rk <= {k})"
    return with_fx("soil_samples", extra=[*SCORED_CTES[:-1], topk]) + f"""
SELECT row_uid, sample_id, CAST(rk AS INTEGER) AS rank, crop,
       {rsql(f"score / CASE WHEN tot = 0 THEN {d(1.0)} ELSE tot END", 4)} AS probability,
       y.kg_ha AS expected_yield_kg_ha, {rsql("score", 4)} AS rule_score
FROM topk JOIN crop_avg_yield y USING (crop)"""


for _k in (1, 5, 22):
    register(f"rule_top{_k}", sql=_topk_sql(_k))(lambda spark, sf_dir, k=_k: rules.rule_top(samples(spark, sf_dir), KEYS, k))


_TERMS = " || '|' || ".join(f"'{c}=' || printf('%.4f', {rsql(_term_sql('s.' + c, 'c.' + p + '_lo', 'c.' + p + '_hi'), 4)})" for c, p in _FEATS)


def _place(j: int, what: str) -> str:
    return f"(SELECT list({what} ORDER BY rule_idx) FROM named)[CAST(top[{j}].i AS INTEGER) + 1]"


_RESULT = " || '|' || ".join(
    f"{_place(j, 'crop')} || ':' || printf('%.4f', {rsql(f'-top[{j}].neg / CASE WHEN tot = 0 THEN {d(1.0)} ELSE tot END', 4)}) || ':' || CAST(CAST({_place(j, 'kg_ha')} AS BIGINT) AS VARCHAR)"
    for j in (1, 2, 3))


# Scores of a row as one sorted list: no window over all rows x rules.
@register("scored_requests", sql=with_fx("soil_samples", extra=[*SCORED_CTES[:3], f"""named AS (
  SELECT rule_idx, crop, kg_ha FROM crop_rule JOIN crop_avg_yield USING (crop)
)""", f"""numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, row_uid, {", ".join(c for c, _ in _FEATS)} FROM samples
)""", f"""lists AS (
  SELECT rid, list_sort(list({{'neg': -score, 'i': rule_idx}}))[1:3] AS top
  FROM (SELECT s.rid, c.rule_idx, {SCORE_SQL} AS score FROM numbered s CROSS JOIN crop_rule c) GROUP BY rid
)""", """best AS MATERIALIZED (
  SELECT s.*, top, -top[1].neg - top[2].neg - top[3].neg AS tot, top[1].i AS rule_idx FROM numbered s JOIN lists USING (rid)
)""", f"res AS (SELECT *, {_RESULT} AS result FROM best)"]) + f"""
SELECT s.row_uid, s.result, {_TERMS} AS explained, 'rules-1' AS model_version, sha256('rules-1|' || s.result) AS checksum
FROM res s JOIN crop_rule c ON c.rule_idx = s.rule_idx""")
def q_scored_requests(spark, sf_dir):
    t = rules.scored_requests(samples(spark, sf_dir), ["row_uid"])
    terms = F.transform("explanation", lambda e: F.concat(e["feature"], F.lit("="), F.format_string("%.4f", e["contribution"])))
    return t.select("row_uid", "result", F.array_join(terms, "|").alias("explained"), "model_version", "checksum")
