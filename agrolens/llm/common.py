"""Helpers shared by the operators: tables in the shared folder, Python kernels, registration."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrolens.plans.registry import Query
from agrolens.session import shared_dir

#: Bytes of text that a kernel's batch aims at; one longer text makes a batch of its own.
SLICE_BYTES = 8 << 20

QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register an ``opN_`` query of this subpackage."""
    def deco(fn):
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def stored(df: DataFrame, name: str, group_rows: int | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors.  ``group_rows``
    limits a row group; a table of few large rows needs small groups to be
    read by many tasks.  ``codec`` is the table's compression.
    """
    spark = df.sparkSession
    path = shared_dir(spark, f"llm-{name}-{uuid.uuid4().hex}")
    write = df.write
    if group_rows:
        write = write.option("parquet.block.row.count.limit", group_rows)
    if codec:
        write = write.option("compression", codec)
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def text_udf(kernel: Callable[[str | None], tuple], schema: T.StructType) -> Callable[[Column], Column]:
    """A vectorised UDF over a text column; ``kernel`` gives one tuple a text."""
    names = schema.fieldNames()

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kernel(t) for t in texts], columns=names)

    return run


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``SLICE_BYTES`` of text."""
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * SLICE_BYTES // max(1, b.nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: T.StructType) -> DataFrame:
    """``mapInArrow`` where ``fn`` yields dicts of column lists, NumPy or Arrow arrays."""
    out = to_arrow_schema(schema)

    def column(values, kind: pa.DataType) -> pa.Array:
        return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([column(cols[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def sums_by_size(values: np.ndarray, at: np.ndarray, first: np.ndarray, few: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the rows ``values[at]`` over the groups of places that begin at each of ``first``: some groups and their sums at a time.

    Groups come by size, as many together as a core's cache holds. Their second rows are added at once, then their
    third ones, and so on: whole rows lie together, which ``np.add.reduceat`` does not use. The ``few`` largest
    that are left of those together are summed one by one.
    """
    n = np.diff(np.r_[first, len(at)])
    most = int(n.max(initial=0))
    by = np.argsort((most - n).astype(np.uint16 if most < 1 << 16 else np.int64), kind="stable")  # 16 bits sort by radix
    step = max(64, (1 << 16) // values.shape[1])
    for i in range(0, len(by), step):
        mine = by[i:i + step]
        less, begin = -n[mine], first[mine]
        total = values.take(at[begin], axis=0)
        room, r = np.empty_like(total), 1
        while (more := int(np.searchsorted(less, -r))) >= few:
            total[:more] += np.take(values, at[begin[:more] + r], axis=0, out=room[:more], mode="clip")
            r += 1
        for j in range(more):
            rest = at[begin[j] + r:begin[j] - less[j]]
            total[j] += np.ones(len(rest), values.dtype) @ values.take(rest, axis=0)
        yield mine, total


def grouped_sums(values: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``sums_by_size`` in the groups' own order."""
    out = np.empty((len(first), values.shape[1]), values.dtype)
    for mine, total in sums_by_size(values, at, first):
        out[mine] = total
    return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
