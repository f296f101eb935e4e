"""Rule-based recommender: per-crop suitability, top-k, yields, accuracy.

Scoring a sample against the 22 rules is a 22 x 7 matrix of range terms.
Written as Spark column expressions that is ~5,000 expression nodes per
row; Catalyst spends tens of seconds analysing and optimising such a tree
and the generated code overflows the method-size limit.  So the scoring
kernel is one vectorised numpy function applied with ``mapInPandas``:
Arrow batches, map-only, no shuffle, linear in the input, and every other
step (rounding, joins, aggregation) stays in Spark.

Ties keep rule order (a stable sort on -score), as the reference does.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.functions.columns import lit_d
from agrolens.session import ship_package
from agrolens.sources import dims

RULE_FEATURES = [f for f, _ in dims.RULE_FEATURE_DEFAULTS]
_CROPS = np.array([r[0] for r in dims.CROP_RULES], dtype=object)
_LO = np.array([[float(r[1 + 2 * j]) for j in range(7)] for r in dims.CROP_RULES])
_HI = np.array([[float(r[2 + 2 * j]) for j in range(7)] for r in dims.CROP_RULES])
_YIELD = np.array([float(dims.CROP_AVG_YIELDS.get(r[0], 0)) for r in dims.CROP_RULES])


def term_matrix(x: np.ndarray) -> np.ndarray:
    """(n, 7) features -> (n, 22, 7) terms: 1 inside [lo, hi], else
    max(0, 1 - relative distance); a missing value scores 0."""
    v = x[:, None, :]
    lo, hi = _LO[None], _HI[None]
    with np.errstate(invalid="ignore"):
        below = np.maximum(0.0, 1.0 - (lo - v) / np.maximum(lo, 1.0))
        above = np.maximum(0.0, 1.0 - (v - hi) / np.maximum(hi, 1.0))
        t = np.where((v >= lo) & (v <= hi), 1.0, np.where(v < lo, below, above))
    return np.where(np.isnan(v), 0.0, t)


def score_matrix(x: np.ndarray) -> np.ndarray:
    """(n, 7) features -> (n, 22) mean of the terms, as ``term_matrix`` has them, a feature at a time.

    A side that the value does not leave gives 1 or more, so the smaller side, at most 1 and at least 0, is the term."""
    s = np.zeros((len(x), len(_CROPS)))
    with np.errstate(invalid="ignore"):
        for j in range(7):  # left-to-right sum, as the reference adds
            v, lo, hi = x[:, j, None], _LO[:, j], _HI[:, j]
            t = np.minimum(1.0 - (lo - v) / np.maximum(lo, 1.0), 1.0 - (v - hi) / np.maximum(hi, 1.0))
            np.clip(t, 0.0, 1.0, out=t)
            t[np.isnan(x[:, j])] = 0.0
            s += t
    s /= 7.0
    return s


def half_up(v: np.ndarray, digits: int) -> np.ndarray:
    """Spark's ``round`` of numbers from 0 on: half up on the shortest decimal text; only values next to a half need the text."""
    scale = 10.0 ** digits
    y = v * scale
    down = np.floor(y)
    out = np.floor(y + 0.5) / scale
    near = np.abs(y - down - 0.5) < 1e-6
    if near.any():
        values, back = np.unique(v[near], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        out[near] = np.array([float(Decimal(repr(float(x))).quantize(step, ROUND_HALF_UP)) for x in values])[back]
    return out


def _features(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[[f"_rf{j}" for j in range(7)]].to_numpy(dtype=float, na_value=np.nan)


def _prep(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys + the seven rule inputs (absent column -> default; NaN -> NULL)."""
    cols = [F.col(k) for k in keys]
    for j, (name, default) in enumerate(dims.RULE_FEATURE_DEFAULTS):
        if name in df.columns:
            c = F.col(name).cast("double")
            cols.append(F.when(~F.isnan(c), c).alias(f"_rf{j}"))
        else:
            cols.append(F.lit(float(default)).alias(f"_rf{j}"))
    ship_package(df.sparkSession)
    return df.select(*cols)


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def rule_scores_long(df: DataFrame, keys: list[str], digits: int | None = None) -> DataFrame:
    """One row per (sample, rule): rule_idx, crop, score (rounded to ``digits`` where given)."""
    x = _prep(df, keys).withColumn("_s", _scores_udf(digits)(*[F.col(f"_rf{j}") for j in range(7)]))
    t = x.select(*keys, F.posexplode("_s").alias("rule_idx", "score"))
    return t.select(*keys, "rule_idx", _crop_at(F.col("rule_idx")).alias("crop"), "score")


_RANKED = T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("score", T.ArrayType(T.DoubleType()))])


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(values.ravel(), kind))


def _ranked_udf(k: int):
    """Scalar Arrow kernel: only the 7 features go in, only the best ``k`` rules'
    indices and scores come out; keys never leave the JVM."""
    @F.arrow_udf(_RANKED)
    def run(f0: pa.Array, f1: pa.Array, f2: pa.Array, f3: pa.Array, f4: pa.Array, f5: pa.Array, f6: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (f0, f1, f2, f3, f4, f5, f6)])
        s = score_matrix(x)
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(s, order, axis=1)
        return pa.StructArray.from_arrays([_lists(order.astype(np.int32), pa.int32()), _lists(top, pa.float64())], ["idx", "score"])

    return run


def _scores_udf(digits: int | None):
    """Scalar Arrow kernel: the scores of all rules, in rule order."""
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(f0: pa.Array, f1: pa.Array, f2: pa.Array, f3: pa.Array, f4: pa.Array, f5: pa.Array, f6: pa.Array) -> pa.Array:
        s = score_matrix(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (f0, f1, f2, f3, f4, f5, f6)]))
        return _lists(s if digits is None else half_up(s, digits), pa.float64())

    return run


_TOP = T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("probability", T.ArrayType(T.DoubleType())), T.StructField("score", T.ArrayType(T.DoubleType()))])


def _top_udf(k: int):
    """Scalar Arrow kernel: the best ``k`` rules' indices, shares of the sum of their scores (which counts as 1 when it is 0)
    and scores, rounded to 4 digits."""
    @F.arrow_udf(_TOP)
    def run(f0: pa.Array, f1: pa.Array, f2: pa.Array, f3: pa.Array, f4: pa.Array, f5: pa.Array, f6: pa.Array) -> pa.Array:
        s = score_matrix(np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in (f0, f1, f2, f3, f4, f5, f6)]))
        order = np.argsort(-s, axis=1, kind="stable")[:, :k]
        top = np.take_along_axis(s, order, axis=1)
        total = np.cumsum(top, axis=1)[:, -1:]  # left to right
        share = top / np.where(total == 0, 1.0, total)
        return pa.StructArray.from_arrays([_lists(order.astype(np.int32), pa.int32()), _lists(half_up(share, 4), pa.float64()), _lists(half_up(top, 4), pa.float64())], ["idx", "probability", "score"])

    return run


def _crop_at(i):
    return F.element_at(F.array(*[F.lit(c) for c in _CROPS]), i + 1)


def _yield_at(i):
    return F.element_at(F.array(*[F.lit(float(y)) for y in _YIELD]), i + 1)


def rule_topk_long(df: DataFrame, keys: list[str], k: int = 3, extra: list[str] | None = None) -> DataFrame:
    """W2 + J14: one row per (sample, rank): crop, score, denominator, yield.

    ``probability = score / denom`` where denom = sum of the top-k scores
    (1 when that sum is 0); rounding is left to Spark.  The kernel is a
    scalar Arrow UDF over the 7 numeric inputs; the long form is taken JVM-side.
    """
    extra = extra or []
    x = _prep(df, keys + extra)
    t = x.withColumn("_t", _ranked_udf(k)(*[F.col(f"_rf{j}") for j in range(7)]))
    total = F.aggregate("_t.score", lit_d(0.0), lambda a, v: a + v)
    t = t.withColumn("denom", F.when(total == 0, lit_d(1.0)).otherwise(total))
    t = t.select(*keys, *extra, "denom", F.col("_t.score").alias("_s"), F.posexplode("_t.idx").alias("_p", "rule_idx"))
    return t.select(*keys, *extra, (F.col("_p") + 1).alias("rank"), "rule_idx", _crop_at(F.col("rule_idx")).alias("crop"),
                    F.get("_s", F.col("_p")).alias("score"), "denom", _yield_at(F.col("rule_idx")).alias("expected_yield_kg_ha"))


def rule_top(samples: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """Long form of the top-k with rounded probability and rule score."""
    x = _prep(samples, keys).withColumn("_t", _top_udf(k)(*[F.col(f"_rf{j}") for j in range(7)]))
    t = x.select(*keys, F.col("_t.probability").alias("_n"), F.col("_t.score").alias("_s"), F.posexplode("_t.idx").alias("_p", "rule_idx"))
    return t.select(*keys, (F.col("_p") + 1).alias("rank"), _crop_at(F.col("rule_idx")).alias("crop"), F.get("_n", F.col("_p")).alias("probability"),
                    _yield_at(F.col("rule_idx")).alias("expected_yield_kg_ha"), F.get("_s", F.col("_p")).alias("rule_score"))


def rule_explain(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Top-1 crop with the seven per-feature terms of its score (4 dp)."""
    x = _prep(samples, keys)

    def run(it):
        for pdf in it:
            feats = _features(pdf)
            t = term_matrix(feats)
            s = t[:, :, 0]
            for j in range(1, 7):
                s = s + t[:, :, j]
            s = s / 7.0
            best = np.argsort(-s, axis=1, kind="stable")[:, 0]
            out = pdf[keys].copy()
            out["crop"] = _CROPS[best]
            out["rule_score"] = s[np.arange(len(pdf)), best]
            bt = t[np.arange(len(pdf)), best, :]
            for j, name in enumerate(RULE_FEATURES):
                out[f"c_{name}"] = bt[:, j]
            yield out

    schema = (f"{_key_schema(x, keys)}, crop string, rule_score double, "
              + ", ".join(f"c_{n} double" for n in RULE_FEATURES))
    r = x.mapInPandas(run, schema)
    return r.select(*keys, "crop", F.round("rule_score", 4).alias("rule_score"),
                    *[F.round(f"c_{n}", 4).alias(f"c_{n}") for n in RULE_FEATURES])


def baseline_accuracy(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Top-1 and top-3 hit rate of the rules against ``target_crop`` (4 dp).

    One row a sample: the rank of its own crop is its place among the best three rules.
    """
    x = _prep(samples, keys + ["target_crop"])
    best = x.withColumn("_t", _ranked_udf(3)(*[F.col(f"_rf{j}") for j in range(7)]))
    own = F.array_position(F.array(*[F.lit(str(c)) for c in _CROPS]), F.col("target_crop")) - 1  # -1: none of the rules'
    rank = F.coalesce(F.array_position("_t.idx", own.cast("int")), F.lit(0))
    hits = best.select(rank.alias("_r"))
    return hits.agg(
        F.round(F.avg((F.col("_r") == 1).cast("double")), 4).alias("top1_accuracy"),
        F.round(F.avg((F.col("_r") > 0).cast("double")), 4).alias("top3_accuracy"),
        F.count("*").alias("total_samples"))


def scored_requests(samples: DataFrame, keys: list[str], k: int = 3, version: str = "rules-1") -> DataFrame:
    """One nested row a request: the top-k crops with probability and yield, the per-feature
    terms of the best crop, the model's version, and a checksum of the result's text."""
    x = _prep(samples, keys)
    t = x.withColumn("_t", _ranked_udf(k)(*[F.col(f"_rf{j}") for j in range(7)]))
    total = F.aggregate("_t.score", lit_d(0.0), lambda a, v: a + v)
    t = t.withColumn("_n", F.when(total == 0, lit_d(1.0)).otherwise(total))
    crops = F.zip_with("_t.idx", "_t.score", lambda i, s: F.struct(
        _crop_at(i).alias("crop"), F.round(s / F.col("_n"), 4).alias("probability"), _yield_at(i).alias("expected_yield_kg_ha")))
    t = t.withColumn("top", crops)
    text = F.array_join(F.transform("top", lambda c: F.concat_ws(":", c["crop"], F.format_string("%.4f", c["probability"]), c["expected_yield_kg_ha"].cast("bigint"))), "|")
    best = F.get("_t.idx", F.lit(0))
    terms = [F.struct(F.lit(name).alias("feature"), F.round(_term_at(F.col(f"_rf{j}"), best, j), 4).alias("contribution")) for j, name in enumerate(RULE_FEATURES)]
    return t.select(*keys, "top", F.array(*terms).alias("explanation"), F.lit(version).alias("model_version"), text.alias("result"),
                    F.sha2(F.concat_ws("|", F.lit(version), text), 256).alias("checksum"))


def _term_at(v, rule, j: int):
    """Term of feature ``j`` of the rule at an index, as ``term_matrix`` has it."""
    lo = F.element_at(F.array(*[lit_d(r[j]) for r in _LO]), rule + 1)
    hi = F.element_at(F.array(*[lit_d(r[j]) for r in _HI]), rule + 1)
    one, zero = lit_d(1.0), lit_d(0.0)
    return (F.when(v.isNull(), zero).when((v >= lo) & (v <= hi), one)
            .when(v < lo, F.greatest(zero, one - (lo - v) / F.greatest(lo, one)))
            .otherwise(F.greatest(zero, one - (v - hi) / F.greatest(hi, one))))
