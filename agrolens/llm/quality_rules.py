"""Quality rules: boosted trees over document statistics.

Every text gives a row of statistics.  A gradient-boosted ensemble of
complete binary trees is fitted on labelled rows (at most ``max_rows`` of
them, those with the smallest hash of the id) and flattened into numpy node
arrays; scoring walks all trees of a batch at once.  Chosen statistics are
monotone: more junk never raises the score.

Defined results: a null text has no words; an empty table gives an empty
table; without usable labels (no rows, or one class) the verdict is that of
the base rules; repeated rows are scored each for itself; other columns are
ignored, also where their names clash with the result's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import documents, fresh, query, quoted

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Statistics the trees see, with the direction of the score: -1 falls, 0 free.
FEATURES = {
    "n_words": 0, "word_length": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1,
    "distinct_rate": 0, "upper_rate": 0, "digit_rate": 0, "bang_rate": -1, "stop_rate": 0,
    "line_words": 0, "comma_rate": 0, "ascii_rate": 0,
}
BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
_UPPER = re.compile("[A-Z]")
_DIGIT = re.compile("[0-9]")
_PUNCT = re.compile("[,.;:]")


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The five base counts and the feature row of one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split cuts at the six ASCII white spaces only
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = _repeated(words)
    if not n:
        return (0, 0, symbols, dup, 0), (0.0,) * len(FEATURES)
    short = sum(1 for w in words if len(w) <= 3)
    row = (
        float(n), chars / n, symbols / n, dup / len(lines), repeat / n,
        len(set(words)) / n, len(_UPPER.findall(text)) / chars, len(_DIGIT.findall(text)) / chars,
        text.count("!") / n, short / n, n / len(lines), len(_PUNCT.findall(text)) / n, chars / len(raw),
    )
    return (n, chars, symbols, dup, repeat), row


def _repeated(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(words)
    windows = list(zip(words, words[1:], words[2:]))
    seen, twice = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return min(covered, n)


@dataclass
class Forest:
    """Complete trees of one depth as arrays: node ``i`` has children ``2i+1`` and ``2i+2``."""

    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2^depth)
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality, for all rows of ``x`` and all trees at once."""
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        tree, row = np.arange(trees)[None, :], np.arange(len(x))[:, None]
        while inner and at.size and at[0, 0] < inner:
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        margin = self.base + self.leaf[tree, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit_forest(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3,
               rate: float = 0.2, bins: int = 32, l2: float = 1.0, min_weight: float = 1.0) -> Forest:
    """Second-order boosting on the logistic loss over quantile bins.

    A split on a monotone feature must order its children's values, and both
    sides are then bounded by the middle of the two.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    margin, inner = np.full(len(y), base), 2**depth - 1
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        at, bounds = np.zeros(len(y), np.int64), {0: (-np.inf, np.inf)}
        for node in range(inner):
            lo, hi = bounds[node]
            mine = np.flatnonzero(at == node)
            best = _best_split(code[mine], g[mine], h[mine], cuts, signs, lo, hi, l2, min_weight)
            left, right = 2 * node + 1, 2 * node + 2
            bounds[left] = bounds[right] = (lo, hi)
            go = np.zeros(len(mine), bool)
            if best:
                f, k, wl, wr = best
                feature[t, node], threshold[t, node] = f, cuts[f][k]
                go = code[mine, f] > k
                mid = (wl + wr) / 2
                if signs[f] > 0:
                    bounds[left], bounds[right] = (lo, mid), (mid, hi)
                elif signs[f] < 0:
                    bounds[left], bounds[right] = (mid, hi), (lo, mid)
            at[mine] = np.where(go, right, left)
        for k in range(inner + 1):
            mine = at == inner + k
            lo, hi = bounds[inner + k]
            leaf[t, k] = rate * np.clip(-g[mine].sum() / (h[mine].sum() + l2), lo, hi)
        margin += leaf[t, at - inner]
    return Forest(feature, threshold, leaf, base)


def _best_split(code, g, h, cuts, signs, lo, hi, l2, min_weight):
    if len(g) < 2:
        return None
    gt, ht = g.sum(), h.sum()

    def gain(gs, hs, w):
        return -(gs * w + 0.5 * (hs + l2) * w * w)

    best, top = None, gain(gt, ht, np.clip(-gt / (ht + l2), lo, hi)) + 1e-9
    for f, sign in enumerate(signs):
        k = len(cuts[f])
        if not k:
            continue
        gl = np.bincount(code[:, f], g, k + 1).cumsum()[:-1]
        hl = np.bincount(code[:, f], h, k + 1).cumsum()[:-1]
        wl = np.clip(-gl / (hl + l2), lo, hi)
        wr = np.clip(-(gt - gl) / (ht - hl + l2), lo, hi)
        total = gain(gl, hl, wl) + gain(gt - gl, ht - hl, wr)
        total[(hl < min_weight) | (ht - hl < min_weight) | (sign * (wr - wl) < 0)] = -np.inf
        i = int(total.argmax())
        if total[i] > top:
            best, top = (f, i, wl[i], wr[i]), total[i]
    return best


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **params) -> Forest | None:
    """Fit on the labelled documents with the smallest id hashes, at most ``max_rows``."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def row(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t)[1] for t in texts])

    # Bounded by max_rows ids, so the small side is broadcast and the texts stay where they are.
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    got = joined.select("quality", row("text").alias("x")).limit(2 * max_rows).collect()
    y = np.array([float(r.quality) for r in got])
    if len(y) < 2 or y.min() == y.max():
        return None
    order = np.lexsort([*np.array([r.x for r in got]).T[::-1], y])  # the same model whatever the tasks' order
    return fit_forest(np.array([r.x for r in got])[order], y[order], list(FEATURES.values()), **params)


def verdict_udf(forest: Forest | None, threshold: float):
    """text -> struct of base counts, base_failed, score and kept."""
    schema = T.StructType([*BASE.fields, T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [statistics(t) for t in texts]
        out = pd.DataFrame([r[0] for r in rows], columns=BASE.fieldNames(), dtype="int64")
        out["base_failed"] = (out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words)
        out["score"] = forest.score(np.array([r[1] for r in rows]).reshape(len(rows), -1)) if forest else 1.0
        out["kept"] = ~out.base_failed & (out.score >= threshold)
        return out

    return run


def quality_rules(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """One row a document: the base counts, the base verdict, the score and ``kept``."""
    judged = docs.select("doc_id", verdict_udf(forest, threshold)(F.col("text")).alias("v"))
    return judged.select("doc_id", *[f"v.{c}" for c in (*BASE.fieldNames(), "base_failed", "kept", "score")])


def keep_good(docs: DataFrame, forest: Forest | None, threshold: float = 0.5) -> DataFrame:
    """The documents whose verdict is ``kept``, all their columns unchanged."""
    name = fresh(docs, "_verdict")
    judged = docs.withColumn(name, verdict_udf(forest, threshold)(F.col("text")))
    return judged.where(quoted(name).getField("kept")).select(*[quoted(c) for c in docs.columns])


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_rules(docs, train(docs, labels))
