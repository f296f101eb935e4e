"""Packing of documents into sequences: dominance reduction, then best fit.

The packing problem is small, however many documents there are: it is the
number of pieces of each length, ``capacity`` counts at most.  So

1. documents are encoded and cut into pieces, and every piece gets a
   number among those of its length in its task (a stored table, so a task that
   runs again changes nothing);
2. the counts of each length reach the driver, and the plan is made on counts:

   * Martello and Toth's reduction.  A set F that holds an item and dominates
     every other feasible set with that item may be fixed as a whole sequence: some best
     packing has it.  F dominates S when S falls into parts, each no larger than an item of F of its own.
     For an item of length w with room r = capacity - w, the largest other item t <= r and the
     most others k that fit beside it (the smallest ones):
     nothing fits: {w}; t = r, or k = 1: {w, t}; k = 2 and no pair that fits exceeds t: {w, t};
     k = 2 and each pair that fits and exceeds t has its smaller item within u, the largest
     beside w and t: {w, t, u}.  Taking items away keeps each of these true, so a set is fixed as
     often as its lengths last;
   * best fit, longest first, for what is left: all sequences with the same room are one entry;

3. the plan's runs say, for each length, which numbers go to which sequences and
   where; the pieces look up their place.  A run covers any number of equal sequences,
   so the broadcast plan grows with the lengths, not with the documents
   (at most ``runs_bound``).

Encoding goes by words: no token crosses ASCII white space, neither does any
step of the tokenizer, so a text is its words' ids joined.  Where all characters are
ASCII or Latin-1 letters, the tokenizer's parts of a word are cut out directly.  A task keeps the
ids of what it has met, up to ``HELD`` of them.

Defined results: a null text is empty and has only the closing id; repeated rows
are each packed; a null id stays null; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import os
import re
import struct
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from agrolens.llm.bpe import byte_alphabet
from agrolens.llm.common import documents, fresh, query, quoted, slices, stored

#: Parts and words whose ids a task keeps of each kind; longer ones than ``SHORT`` are not kept.
HELD, SHORT = 400_000, 64

Plan = dict[str, np.ndarray]

#: Texts of these characters lower-case and split alike in every Unicode version and need no normalisation.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The vocabulary's own pattern over a lower-case word of those characters (a fixed value).
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^a-zß-öø-ÿ0-9]+")


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Parts(dict):
    """Ids of a plain part, as little-endian unsigned 32-bit integers: the library's merges over its bytes."""

    def __init__(self, core):
        self.merge = core.model.tokenize
        self.alphabet = {byte: char for char, byte in byte_alphabet().items()}

    def __missing__(self, text: str) -> bytes:
        spelt = text if text.isascii() else text.encode().decode("latin-1").translate(self.alphabet)
        ids = packed([t.id for t in self.merge(spelt)])
        if len(text) <= SHORT:
            self[text] = ids
        return ids


class PlainWords(dict):
    """Ids of a lower-case plain word: those of its parts."""

    def __init__(self, parts: Parts):
        self.parts = parts

    def __missing__(self, word: str) -> bytes:
        cut = PARTS.findall(word)
        ids = self.parts[word] if len(cut) == 1 else b"".join([self.parts[p] for p in cut])
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Words(dict):
    """Ids of a word, by the library."""

    def __init__(self, core):
        self.core = core

    def __missing__(self, word: bytes) -> bytes:
        ids = packed(self.core.encode(word.decode(), add_special_tokens=False).ids)
        if len(word) <= SHORT:
            self[word] = ids
        return ids


class Encoder:
    """Ids of a text, word by word."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        core = Tokenizer.from_str(spec)
        core.no_truncation()
        core.no_padding()
        self.parts, self.words = Parts(core), Words(core)
        self.plain = PlainWords(self.parts)

    def encode(self, text: str | None) -> bytes:
        for held in (self.parts, self.plain, self.words):
            if len(held) > HELD:
                held.clear()
        if not text:
            return b""
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.plain.__getitem__, text.lower().split()))
        return b"".join(map(self.words.__getitem__, text.encode().split()))


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and the closing id, cut at every ``capacity`` ids."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    share = docs.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    close, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        encoder = Encoder(share.value)
        for b in slices(batches):
            place, piece, ids = [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                got = encoder.encode(text) + close
                for p in range(0, len(got), size):
                    place.append(i)
                    piece.append(p // size)
                    ids.append(got[p:p + size])
            number = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(place)), pa.array(piece, pa.int32()), pa.array(number * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def dominating(counts: np.ndarray, w: int, capacity: int) -> tuple[int, ...] | None:
    """A set with an item of length ``w`` that dominates every feasible set with it, if the rules give one."""
    room = capacity - w
    left = counts[:room + 1].copy()
    if w <= room:
        left[w] -= 1
    fit = np.flatnonzero(left)
    if not len(fit):
        return (w,)
    t = int(fit[-1])
    if t == room:
        return w, t
    # The most items beside w: the smallest ones.
    few, used, k = left[fit], 0, 0
    for size, n in zip(fit.tolist(), few.tolist()):
        more = min(n, (room - used) // size, 3 - k)
        k, used = k + more, used + more * size
        if k == 3 or more < n:
            break
    if k == 1:
        return w, t
    if k == 3:
        return None
    # Feasible pairs (a >= b): for each b, the largest a.
    at = np.searchsorted(fit, room - fit, side="right") - 1
    pairs = [(int(fit[i]), b) for b, i, n in zip(fit.tolist(), at.tolist(), few.tolist()) if i >= 0 and (fit[i] > b or (fit[i] == b and n > 1))]
    if not pairs or max(a + b for a, b in pairs) <= t:
        return w, t
    left[t] -= 1
    beside = np.flatnonzero(left[:room - t + 1])
    if not len(beside):
        return None
    u = int(beside[-1])
    return None if any(b > u and a + b > t for a, b in pairs) else (w, t, u)


def reduced(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[tuple[int, ...], int]]]:
    """What is left of ``counts`` (by length), and the sets that are fixed with how often."""
    counts, fixed, again = counts.copy(), [], True
    while again:
        again = False
        for w in np.flatnonzero(counts)[::-1].tolist():
            while counts[w] > 0 and (found := dominating(counts, w, capacity)):
                need = Counter(found)
                times = min(int(counts[s]) // n for s, n in need.items())
                for s, n in need.items():
                    counts[s] -= n * times
                fixed.append((found, times))
                again = True
    return counts, fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences (lengths, how many alike): the longest first, each where the least room is left."""
    rooms: list[int] = []  # sorted rooms that some sequence has
    alike: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)

    def add(held: tuple[int, ...], room: int, n: int) -> None:
        if n:
            if not alike[room]:
                insort(rooms, room)
            alike[room].append((held, n))

    for w in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[w])
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w
                add((w,) * each, capacity - each * w, n // each)
                add((w,) * (n % each), capacity - (n % each) * w, 1 if n % each else 0)
                break
            room = rooms[i]
            held, m = alike[room].pop()
            if not alike[room]:
                rooms.pop(i)
            each = room // w  # a sequence once begun has the least room of all, until it is full
            full = min(m, n // each)
            add(held + (w,) * each, room - each * w, full)
            n -= full * each
            if full < m and n:  # fewer than ``each`` are left
                add(held + (w,) * n, room - n * w, 1)
                add(held, room, m - full - 1)
                n = 0
            else:
                add(held, room, m - full)
    return [x for r in rooms for x in alike[r]]


def plan(counts: dict[int, int], capacity: int) -> Plan:
    """Runs, ordered by length and first number: which numbers of a length go to which sequences, and where.

    Number x of a run goes to sequence ``sequence + (x - first) // each``, at
    ``offset + (x - first) % each * length``.
    """
    by_length = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        by_length[length] = n
    left, fixed = reduced(by_length, capacity)
    sequence, used, runs = 0, defaultdict(int), []
    for held, n in [*fixed, *best_fit(left, capacity)]:
        at = 0
        for length, each in sorted(Counter(held).items(), reverse=True):
            runs.append((length, used[length], sequence, each, at))
            used[length] += n * each
            at += length * each
        sequence += n
    if {k: v for k, v in used.items() if v} != {k: v for k, v in counts.items() if v}:
        raise AssertionError("the plan does not hold every piece")
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 5).T
    return {**dict(zip(("length", "first", "sequence", "each", "offset"), cols)), "sequences": np.array([sequence])}


def runs_bound(capacity: int) -> int:
    """Runs that a plan can have.  Fixing or filling uses up a length or an entry, or splits an entry in
    three, so there are fewer than 8 * capacity entries; distinct lengths in one sum to the capacity at most."""
    return 8 * capacity * int((2 * capacity) ** 0.5 + 1)


def placed(items: DataFrame, capacity: int = 2048, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of items with a length of 1 to ``capacity``.

    The table is written once with each item's task and its number among the task's items of that length.
    """
    task, nth = fresh(items, "task"), fresh(items, "nth")
    schema = T.StructType([*items.schema.fields, T.StructField(task, T.IntegerType()), T.StructField(nth, T.LongType())])
    where = items.columns.index(length)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, me = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            size = b.column(where).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(size, kind="stable")
            here, first, many = np.unique(size[order], return_index=True, return_counts=True)
            mine = np.empty(len(size), np.int64)
            mine[order] = np.arange(len(size)) - np.repeat(first, many) + np.repeat(seen[here], many)
            seen[here] += many
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(size), me, np.int32)), pa.array(mine)], schema=to_arrow_schema(schema))

    rows = stored(items.mapInArrow(number, schema), "pieces")
    counts = stored(rows.groupBy(length, task).agg(F.count("*").alias("n")), "piece-counts")
    totals = {r[0]: r.n for r in counts.groupBy(length).agg(F.sum("n").alias("n")).collect()}  # a row a length
    made = plan(totals, capacity)
    share = items.sparkSession.sparkContext.broadcast(made)
    base, n = fresh(rows, "base"), "n"
    before = Window.partitionBy(length).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    bases = counts.select(length, task, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("bigint").alias(base))
    spots = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    @F.pandas_udf(spots)
    def place(size, x):
        import pandas as pd

        p = share.value
        size, x = size.to_numpy(np.int64), x.to_numpy(np.int64)
        # One ordered key over (length, first number): the runs of a length are side by side.
        lo = np.searchsorted(p["length"], size, side="left")
        hi = np.searchsorted(p["length"], size, side="right")
        while ((hi - lo) > 1).any():  # binary search in every length's own runs at once
            mid = (lo + hi) // 2
            right = p["first"][np.minimum(mid, len(p["first"]) - 1)] <= x
            lo, hi = np.where(right & (hi - lo > 1), mid, lo), np.where(right | (hi - lo <= 1), hi, mid)
        past = x - p["first"][lo]
        return pd.DataFrame({"sequence_id": p["sequence"][lo] + past // p["each"][lo], "offset": p["offset"][lo] + past % p["each"][lo] * size})

    spot = fresh(rows, "spot")
    out = rows.join(bases, [length, task]).withColumn(spot, place(quoted(length).cast("bigint"), F.col(nth) + F.col(base)))
    return out.select(*[quoted(c) for c in items.columns], F.col(f"{spot}.sequence_id").alias("sequence_id"), F.col(f"{spot}.offset").alias("offset"))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset)"""
    return placed(pieces(docs, path, capacity, end_id), capacity)


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    cut = pieces(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return placed(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
