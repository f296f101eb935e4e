"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolens.operators import features
from agrolens.plans.common import SAMPLES_SQL, d, rsql, samples
from agrolens.plans.oracle_fixtures import with_fx
from agrolens.plans.registry import register
from agrolens.sources import dims

_FX = with_fx("soil_samples", extra=[SAMPLES_SQL])


def _bin_sql(src, edges, labels):
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = d(float(edges[i])), d(float(edges[i + 1]))
        cond = f"{src} >= {lo} AND {src} <= {hi}" if i == 0 else f"{src} > {lo} AND {src} <= {hi}"
        parts.append(f"WHEN {cond} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " ELSE 'nan' END"


_BINS_SQL = ",\n       ".join(f"{_bin_sql(src, e, l)} AS {out}" for src, out, e, l in dims.BINS)


@register("feature_bins", sql=_FX + f"""
SELECT row_uid, {_BINS_SQL}
FROM samples""")
def q_feature_bins(spark, sf_dir):
    t = features.add_bins(samples(spark, sf_dir))
    return t.select("row_uid", *[b[1] for b in dims.BINS])


_EPS = d(1e-06)


@register("nutrient_ratios", sql=_FX + f"""
SELECT row_uid, {rsql(f'N_kg_ha / (P_kg_ha + {_EPS})', 6)} AS N_P_ratio,
       {rsql(f'N_kg_ha / (K_kg_ha + {_EPS})', 6)} AS N_K_ratio,
       {rsql(f'P_kg_ha / (K_kg_ha + {_EPS})', 6)} AS P_K_ratio
FROM samples""")
def q_nutrient_ratios(spark, sf_dir):
    t = features.nutrient_ratios(samples(spark, sf_dir))
    return t.select("row_uid", *[F.round(c, 6).alias(c) for c in ["N_P_ratio", "N_K_ratio", "P_K_ratio"]])


_BIN_EXPR = {out: _bin_sql(src, e, l) for src, out, e, l in dims.BINS}
_NUM_SQL = {
    "N_P_ratio": f"N_kg_ha / (P_kg_ha + {_EPS})", "N_K_ratio": f"N_kg_ha / (K_kg_ha + {_EPS})",
    "P_K_ratio": f"P_kg_ha / (K_kg_ha + {_EPS})"}


def _matrix_col(c):
    if c in dims.NUMERIC_FEATURES:
        expr = _NUM_SQL.get(c, c)
        return f"{rsql(f'COALESCE({expr}, {d(0.0)})', 6)} AS {c}"
    out = next(b[1] for b in dims.BINS if c.startswith(b[1] + "_"))
    lab = c[len(out) + 1:]
    return f"CASE WHEN ({_BIN_EXPR[out]}) = '{lab}' THEN {d(1.0)} ELSE {d(0.0)} END AS {c}"


_MATRIX_COLS = sorted(dims.NUMERIC_FEATURES + features.onehot_columns())


@register("model_matrix", sql=_FX + "SELECT row_uid, " + ",\n       ".join(_matrix_col(c) for c in _MATRIX_COLS)
          + "\nFROM samples")
def q_model_matrix(spark, sf_dir):
    m = features.model_matrix(samples(spark, sf_dir), ["row_uid"])
    return m.select("row_uid", *[F.round(c, 6).alias(c) if c in dims.NUMERIC_FEATURES else F.col(c)
                                 for c in _MATRIX_COLS])


_ABSENT = ("avg_precip_mm", "N_kg_ha")
_WITHOUT = {c for c in _MATRIX_COLS if c in ("avg_precip_mm", "N_kg_ha", "N_P_ratio", "N_K_ratio") or c.startswith("rainfall_bin_")}


@register("model_matrix_absent", sql=_FX + "SELECT row_uid, " + ",\n       ".join(
    f"{d(0.0)} AS {c}" if c in _WITHOUT else _matrix_col(c) for c in _MATRIX_COLS) + "\nFROM samples")
def q_model_matrix_absent(spark, sf_dir):
    """Rows that lack the rain and nitrogen columns altogether."""
    m = features.model_matrix(samples(spark, sf_dir).drop(*_ABSENT), ["row_uid"])
    return m.select("row_uid", *[F.round(c, 6).alias(c) if c in dims.NUMERIC_FEATURES else F.col(c) for c in _MATRIX_COLS])
