"""Joins with a side that is usually small."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolens.session import shared_dir

#: Rows up to which the small side is broadcast.
BROADCAST_ROWS = 100_000
#: Parts a key of the large side is dealt into when the other side is larger than that.
SALTS = 32


def join_small(large: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner",
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join on ``key`` with a derived table that has one row a key.

    The small side is written once and its rows counted: up to ``limit`` it is
    broadcast, so the large side is not shuffled.  Beyond that both sides
    are shuffled on (key, salt), which deals a hot key's rows over ``SALTS`` tasks; the
    small side is repeated for each salt.
    """
    spark = large.sparkSession
    path = shared_dir(spark, f"small-{uuid.uuid4().hex}")
    small.write.parquet(path)
    side = spark.read.schema(small.schema).parquet(path)
    if side.count() <= limit:
        return large.join(F.broadcast(side), key, how)
    salted = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(SALTS)).cast("int"))
    keys = [key] if isinstance(key, str) else [*key]
    return mine.join(salted, [*keys, "_salt"], how).drop("_salt")
