"""Periodic runs of words, found through minimizers of many scales.

A run is a stretch of words with smallest period q that no neighbouring word
extends, at least ``max(least, times * q)`` words long (6 and 4 here).

* Periods below ``FIRST`` are too short for windows: each is a direct scan of
  the table's words against themselves at that lag.
* Scale W (8, 16, 32, ...) finds the periods of [W, 2W].  Every position gets
  the exact name of the 2W words that begin there, by doubling: two neighbouring
  names of half the size are numbered as a pair.  Each window of W positions
  elects its least name in a scrambled order (the leftmost of equals).
  A run of period q holds two windows q apart with the same names, so both elect
  places q apart, and no place between them has that name: else the
  2W >= q words would have a shorter period (Fine and Wilf).  So the next elected
  place with the same name is q away: a seed.  Seeds are linear in the words.
* A seed is extended to both sides by comparing words q apart, in steps that double.
* A stretch found with a multiple of its smallest period has the same ends as
  the stretch of the smallest, whose own scale finds it, so the least period of each
  (start, end) stays.

The texts of a batch are scanned together, with a mark of its own after each,
which equals nothing: no run crosses texts.

Defined results: a null text has no words, and so no runs and an empty collapsed
text; repeated rows each get their result; a null id stays null; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import documents, fresh, query, slices

#: The first period that windows find.
FIRST = 8
#: An odd number scrambles 32-bit names without collisions.
ODD = np.uint64(0x9E3779B1)

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def lag_runs(words: np.ndarray, q: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of at least ``length`` words that repeat at lag ``q``."""
    same = np.zeros(max(0, len(words) - q) + 2, np.int8)
    same[1:-1] = words[q:] == words[:-q]
    turns = np.flatnonzero(np.diff(same))
    starts, ends = turns[::2], turns[1::2] + q
    long = ends - starts >= length
    return starts[long], ends[long]


def doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Names of twice ``size`` words from names of ``size``; what leaves the array is unique."""
    n = len(names)
    right = np.arange(n, 2 * n, dtype=np.int64)
    right[:max(0, n - size)] = names[size:]
    return pd.factorize(names * np.int64(2 * n + 1) + right)[0].astype(np.int64)


def elected(names: np.ndarray, width: int) -> np.ndarray:
    """Places that are the least name of some window of ``width`` (a power of two) places."""
    key = ((names.astype(np.uint64) * ODD) & np.uint64(0xFFFFFFFF)) << np.uint64(32)
    key |= np.arange(len(names), dtype=np.uint64)
    reach = 1
    while reach < width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    places = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places


def matching(words: np.ndarray, i: int, q: int, step: int) -> int:
    """How many words from ``i`` on (downwards for ``step`` -1) equal the word ``q`` before."""
    n, size, got = len(words), 64, 0
    while True:
        if step > 0:
            a, b = i + got, min(n, i + got + size)
            differ = words[a:b] != words[a - q:b - q]
        else:
            a, b = max(q, i - got - size + 1), i - got + 1
            differ = (words[a:b] != words[a - q:b - q])[::-1] if b > a else np.empty(0, bool)
        at = int(differ.argmax()) if differ.any() else -1
        if at >= 0:
            return got + at
        got += len(differ)
        if len(differ) < size:
            return got
        size *= 2


def find_runs(words: np.ndarray, sizes: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of all runs, ordered by start, then period.

    ``words`` holds texts of ``sizes`` words side by side, each followed by a unique mark.
    ``times`` must be 4 or more, as the windows need that many periods.
    """
    if times < 4:
        raise ValueError("times must be 4 or more")
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q in range(1, FIRST):
        s, e = lag_runs(words, q, max(least, times * q))
        found.append((s, e, np.full(len(s), q)))

    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    places, names, size, width = np.arange(len(words)), words, 1, FIRST
    while True:
        large = sizes >= times * width
        if not large.any():
            break
        stay = large[text]
        if not stay.all():
            places, names, text = places[stay], names[stay], text[stay]
        while size < 2 * width:
            names = doubled(names, size)
            size *= 2
        at = elected(names, width)
        order = np.argsort(names[at], kind="stable")
        name, place = names[at][order], places[at][order]
        gap = place[1:] - place[:-1]
        seed = (name[1:] == name[:-1]) & (gap >= width) & (gap <= 2 * width)
        runs, upto = [], {}
        for p, q in sorted(zip(place[:-1][seed].tolist(), gap[seed].tolist())):
            if p < upto.get(q, -1):
                continue
            s, e = p - matching(words, p + q - 1, q, -1), p + q + matching(words, p + q, q, 1)
            upto[q] = e - q
            if e - s >= max(least, times * q):
                runs.append((s, e, q))
        if runs:
            found.append(tuple(np.array(runs, np.int64).T))
        width *= 2

    s, e, q = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    s, e, q = s[first], e[first], q[first]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def side_by_side(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, their numbers with a mark after each text, and the word counts."""
    split = [t.encode().split() if t else [] for t in texts]
    sizes = np.array([len(x) for x in split], np.int64)
    numbers, known = pd.factorize(np.array([w for x in split for w in x], dtype=object)) if sizes.sum() else (np.empty(0, np.int64), [])
    ends = np.cumsum(sizes)
    words = np.insert(numbers.astype(np.int64), ends, len(known) + np.arange(len(sizes)))
    return split, words, sizes


def scan(texts: list[str | None], least: int, times: int) -> tuple[list[list[dict]], list[str]]:
    """Runs and collapsed text of each text."""
    split, words, sizes = side_by_side(texts)
    s, e, q = find_runs(words, sizes, least, times)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    of = np.searchsorted(begin, s, side="right") - 1
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, e, -1)
    dropped = np.cumsum(change[:-1]) > 0
    runs: list[list[dict]] = [[] for _ in texts]
    for d, a, b, p in zip(of.tolist(), s.tolist(), e.tolist(), q.tolist()):
        runs[d].append({"start": a - int(begin[d]), "length": b - a, "period": p})
    out = []
    for d, x in enumerate(split):
        if runs[d]:
            gone = dropped[begin[d]:begin[d] + len(x)]
            x = [w for w, g in zip(x, gone.tolist()) if not g]
        out.append(b" ".join(x).decode())
    return runs, out


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of each text by word number, ordered by start and then
    period, and the text's words without what any run repeats after its first period, with one space between."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.fieldNames()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            runs, collapsed = scan(b.column(1).to_pylist(), least, times)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, runs_type), pa.array(collapsed, pa.string())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def with_planted(docs: DataFrame) -> DataFrame:
    """Documents in which those whose crc32 of the id is a multiple of ten end in a repeated stretch.

    With g a tenth of the crc32: each of the n words from word a = g mod n on is replaced by
    original word a + (i - a) mod p, where p = 1 + (n - a) div (3 + g mod 8).  A row without an id stays.
    """
    @F.pandas_udf("string")
    def plant(texts: pd.Series, tenths: pd.Series) -> pd.Series:
        def one(t, g):
            words = t.encode().split() if t else []
            if not words:
                return t
            a, n = int(g) % len(words), len(words)
            p = 1 + (n - a) // (3 + int(g) % 8)
            return b" ".join([*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]).decode()
        return pd.Series([one(t, g) for t, g in zip(texts, tenths)], dtype=object)

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(F.pmod(h, F.lit(10)) == 0, F.lit(False))
    mark, tenth, new = (fresh(docs, n) for n in ("chosen", "tenth", "planted"))
    out = docs.withColumns({mark: chosen, tenth: F.floor(h / 10).cast("bigint")})
    out = out.withColumn(new, plant(F.when(F.col(mark), F.col("text")), F.coalesce(F.col(tenth), F.lit(0))))
    return out.withColumn("text", F.when(F.col(mark), F.col(new)).otherwise(F.col("text"))).drop(mark, tenth, new)


def summary(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exact length / period (then the earliest, then the shortest period) and digests."""
    none = F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("length"), F.lit(1).cast("bigint").alias("period"))
    top = F.aggregate("runs", none, lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    some = F.size("runs") > 0
    t = found.withColumn("top", F.when(some, top))
    return t.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"), F.col("top.period").alias("period"),
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return summary(periodic_runs(with_planted(documents(spark, sf_dir).select("doc_id", "text"))))

