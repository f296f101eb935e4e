import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_frames import frame, prose  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, copies."""
    rnd = random.Random(7)
    long = prose(rnd, 20_000)
    passage = prose(rnd, 120)
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, " \t\n\x0b "), (5, long), (6, long), (7, passage), (8, prose(rnd, 60) + "\n" + passage + "\n" + prose(rnd, 60)),
            (None, passage), (9, "x" * 5000), (10, "é漢😀 " * 300), (11, prose(rnd, 300)), (12, "same\nsame\nsame line\nother\nSAME  line")]
    return frame(spark, rows).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
