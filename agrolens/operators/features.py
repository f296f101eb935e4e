"""Feature engineering (P6-P13): bins, nutrient ratios, one-hot, model matrix.

All plain column expressions (map-only, codegen'd).  Bins are right-closed
with an inclusive lowest edge (``Bucketizer`` is left-closed, so it is not
used); out-of-range or missing values get the label ``'nan'``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d, right_closed_bin
from agrolens.sources import dims

EPS = 1e-6


def nutrient_ratios(df: DataFrame) -> DataFrame:
    """N/P, N/K, P/K with +1e-6 in each denominator."""
    out = {}
    if {"N_kg_ha", "P_kg_ha"} <= set(df.columns):
        out["N_P_ratio"] = F.col("N_kg_ha") / (F.col("P_kg_ha") + lit_d(EPS))
    if {"N_kg_ha", "K_kg_ha"} <= set(df.columns):
        out["N_K_ratio"] = F.col("N_kg_ha") / (F.col("K_kg_ha") + lit_d(EPS))
    if {"P_kg_ha", "K_kg_ha"} <= set(df.columns):
        out["P_K_ratio"] = F.col("P_kg_ha") / (F.col("K_kg_ha") + lit_d(EPS))
    return df.withColumns(out)


def add_bins(df: DataFrame) -> DataFrame:
    """pH, rainfall, temperature and humidity bins."""
    return df.withColumns({out: right_closed_bin(F.col(src), edges, labels)
                           for src, out, edges, labels in dims.BINS if src in df.columns})


def onehot_columns() -> list[str]:
    """Indicator names over the full label space (+ 'nan'), sorted by name."""
    names = []
    for _, out, _, labels in dims.BINS:
        names += [f"{out}_{lab}" for lab in labels + ["nan"]]
    return sorted(names)


def onehot_bins(df: DataFrame) -> DataFrame:
    """One indicator per bin label; bin columns dropped.

    The category list is the closed label set of each bin (plus 'nan'), so
    the output schema is fixed and no fit pass over the data is needed;
    categories absent from the data are simply 0."""
    cols = {}
    for _, out, _, labels in dims.BINS:
        if out in df.columns:
            for lab in labels + ["nan"]:
                cols[f"{out}_{lab}"] = (F.col(out) == lab).cast("double")
    return df.withColumns(cols).drop(*[b[1] for b in dims.BINS])


def fit_onehot(df: DataFrame) -> list[str]:
    """P11 fit: the sorted indicator names of the labels that occur in each bin column (a distinct pass;
    the state is a few names, as a bin has at most seven labels)."""
    cols = [out for _, out, _, _ in dims.BINS if out in df.columns]
    seen = df.agg(*[F.collect_set(c).alias(c) for c in cols]).first()
    return sorted(f"{c}_{v}" for c in cols for v in seen[c])


def transform_onehot(df: DataFrame, fitted: list[str], unseen: list[str] | None = None) -> DataFrame:
    """P11 transform: one indicator a fitted name, 0 where the column or label is absent; bin columns dropped.

    A label that was not fitted sets no indicator.  The reference lets such labels through as
    columns of their own: ``unseen`` gives those names (``fit_onehot`` of the rows to transform)."""
    bins = {out for _, out, _, _ in dims.BINS}
    have = [out for out in bins if out in df.columns]
    cols = {}
    for name in [*fitted, *sorted(set(unseen or []) - set(fitted))]:
        out = max((b for b in bins if name.startswith(f"{b}_")), key=len)
        hit = (F.col(out) == name[len(out) + 1:]).cast("double") if out in have else lit_d(0.0)
        cols[name] = F.coalesce(hit, lit_d(0.0))
    return df.withColumns(cols).drop(*have)


def feature_transform(df: DataFrame) -> DataFrame:
    """The 6-stage chain (pH bin, ratios, rain/temp/humidity bins, one-hot)."""
    return onehot_bins(add_bins(nutrient_ratios(df)))


def model_matrix(df: DataFrame, keys: list[str]) -> DataFrame:
    """P12 + P17: numeric features + indicators sorted by name (ASCII); missing
    values and features that the input has no column for are 0, so the width is fixed."""
    t = feature_transform(df)
    value = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), lit_d(0.0)) for c in t.columns}
    return t.select(*keys, *[value.get(c, lit_d(0.0)).alias(c) for c in sorted(dims.NUMERIC_FEATURES + onehot_columns())])
