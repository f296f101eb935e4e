"""Request gate (P16): accept rows with all 7 inputs present and in range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.sources import dims

_RANGES = {f: (lo, hi) for f, lo, hi in dims.FEATURE_RANGES}


def request_gate(df: DataFrame) -> DataFrame:
    """Adds ``violations`` (comma-joined, in required-feature order:
    ``missing:<f>`` or ``range:<f>``) and ``accepted`` (no violation)."""
    items = []
    for f in dims.REQUIRED_FEATURES:
        lo, hi = _RANGES[f]
        c = F.col(f)
        items.append(F.when(c.isNull() | F.isnan(c), F.lit(f"missing:{f}"))
                     .when((c < lit_d(lo)) | (c > lit_d(hi)), F.lit(f"range:{f}")))
    v = F.array_join(F.array_compact(F.array(*items)), ",")
    return df.withColumn("violations", v).withColumn("accepted", F.col("violations") == "")
