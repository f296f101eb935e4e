"""Benchmark decontamination by latent semantic retrieval.

Terms are the benchmark's words.  One job counts, over all passages of all
documents, how many hold each term; a second multiplies the TF-IDF matrix of
passages, and its transpose, onto a random test matrix, and sums the small
product; a randomised SVD of it (Nystroem form) gives the latent axes, the
index's fitted part, over all documents.  In the third job every document is folded in: prefix sums of its words'
latent vectors give windows of each item's length, windows whose cosine with
an item reaches ``cosine`` are candidates, and a candidate's words are held
against the item's: their longest common subsequence covers ``copied`` of the
item, or ``paraphrased`` of it and the item's answer as well.

Items of less than ``least_words`` words have no windows to speak of; their
whole word sequence is looked for as it is, by an automaton over the folded
text (a sentence of an unspaced script is one word, so its neighbours may touch it).

The benchmark is taken in blocks of ``block`` items, one after another, which
bounds the terms and axes that the driver holds and tasks are sent; each block
is a query set against all rows.

Defined results: null and empty texts and items match nothing; items with
less than ``least_words`` words and ``least_bytes`` bytes are too short to tell and match nothing; ties
in cosine go to the earlier window; repeated rows (or items) give repeated
results; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import arrow_map, documents, fresh, grouped_sums, query, quoted, slices, stored

#: Bytes of words: ASCII letters, digits and all of non-ASCII characters; the rest parts words.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: Words of a passage of the TF-IDF matrix.
PASSAGE = 32
#: Longest window, in words: a longer item is looked for by its windows of this length.
LONGEST = 64
#: Words that window places and lengths are multiples of.
GRAIN = 4
#: Words of a text that are folded in at once; neighbours overlap by twice the longest window.
SEGMENT = 8_000


@dataclass(frozen=True)
class Rule:
    axes: int = 128
    extra: int = 8
    cosine: float = 0.55
    copied: float = 0.8
    paraphrased: float = 0.6
    answered: float = 0.8
    least_words: int = 8
    least_bytes: int = 24
    block: int = 2000
    seed: int = 42


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def places(codes: list[int]) -> dict[int, int]:
    """The bits of the places that each code has."""
    masks: dict[int, int] = {}
    for i, c in enumerate(codes):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Item:
    """A window of a benchmark item: its words as term codes, and the whole item's answer."""

    def __init__(self, item_id, codes: list[int], answer: list[int], whole: bool):
        self.item_id, self.codes, self.n, self.whole = item_id, codes, len(codes), whole
        self.masks, self.answer, self.answer_masks = places(codes), answer, places(answer)

    @property
    def length(self) -> int:
        return min(LONGEST, -(-self.n // 16) * 16)


def subsequence(masks: dict[int, int], n: int, codes: list[int]) -> int:
    """Length of the longest common subsequence, by words of bits."""
    full = (1 << n) - 1
    v = full
    for c in codes:
        m = masks.get(c)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return n - v.bit_count()


def answer_start(text: str, n: int) -> int:
    """Where the answer begins, in words: the last sentence with a word, or the last quarter if there is one sentence."""
    starts = [len(words(text[:m.end()])) for m in re.finditer(r"[.!?]\s", text)]
    return max((at for at in starts if 0 < at < n), default=n - max(1, n // 4))


class Benchmark:
    """A block of items with the vocabulary they span."""

    def __init__(self, rows: list[tuple], rule: Rule):
        self.terms: dict[str, int] = {}
        self.items: list[Item] = []
        self.short: dict[str, list] = {}  # folded bytes, one character each, and their items
        for item_id, text in rows:
            ws = words(text)
            if len(ws) < rule.least_words:
                short = b" ".join(ws)
                if len(short) >= rule.least_bytes:
                    self.short.setdefault(short.decode("latin-1"), []).append(item_id)
                continue
            codes = [self.terms.setdefault(w, len(self.terms)) for w in ws]
            answer = codes[answer_start(text, len(codes)):]
            if len(codes) <= LONGEST:
                self.items.append(Item(item_id, codes, answer, True))
                continue
            for i in range(0, len(codes) - LONGEST // 2, LONGEST // 2):
                self.items.append(Item(item_id, codes[i:i + LONGEST], answer, False))

    def codes(self, text: str | None) -> np.ndarray:
        """Term codes of a text's words; words that no item has share the last code."""
        get, none = self.terms.get, len(self.terms)
        ws = words(text)
        return np.fromiter(map(get, ws, repeat(none)), np.int64, len(ws))


def whole(lists: list[np.ndarray], size: int, none: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes laid end to end, each list from a multiple of ``size`` on and filled up with ``none``; the lists' starts and room."""
    n = np.array([len(c) for c in lists])
    room = -(-n // size) * size
    first = np.cumsum(room) - room
    codes = np.full(int(room.sum()), none)
    codes[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)] = np.concatenate(lists)
    return codes, first, room


def _frequencies(docs: DataFrame, bench: Benchmark) -> tuple[np.ndarray, int]:
    """Passages that hold each term, and all passages."""
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("n", T.LongType())])

    def run(batches) -> Iterator[dict]:
        count, none, held, size = np.zeros(len(bench.terms) + 1, np.int64), len(bench.terms), [], 0

        def add() -> None:
            codes, _, _ = whole(held, PASSAGE, none)
            known = np.flatnonzero(codes < none)
            keys = np.sort((known // PASSAGE * none + codes[known]).astype(np.int32 if len(codes) // PASSAGE * none < 1 << 31 else np.int64))
            count[:none] += np.bincount(keys[np.r_[True, keys[1:] != keys[:-1]]] % none, minlength=none) if len(keys) else 0
            count[none] += len(codes) // PASSAGE

        for b in slices(batches):
            for t in b.column(0).to_pylist():
                c = bench.codes(t)
                if len(c):
                    held.append(c)
                    size += len(c)
                if size > 60_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        yield {"term": np.arange(none + 1, dtype=np.int32), "n": count}

    df = np.zeros(len(bench.terms) + 1, np.int64)
    for r in arrow_map(docs.select("text"), run, schema).groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r.term] = r.n
    return df[:-1], int(df[-1])


def _axes(docs: DataFrame, bench: Benchmark, idf: np.ndarray, rule: Rule) -> np.ndarray:
    """The latent axes (terms x axes) of the passages' TF-IDF matrix, heaviest first."""
    n, width = len(bench.terms), min(rule.axes + rule.extra, len(bench.terms))
    test = np.linalg.qr(np.random.default_rng(rule.seed).standard_normal((n, width)))[0]
    weighted = np.vstack([test * idf[:, None], np.zeros(width)]).astype(np.float32)
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("y", T.BinaryType())])
    size = 512  # terms a row

    def product(lists: list[np.ndarray], y: np.ndarray) -> None:
        codes, _, _ = whole(lists, PASSAGE, n)
        words_ = codes.reshape(-1, PASSAGE).T
        rows = weighted.take(words_[0], axis=0)
        for w in words_[1:]:
            rows += weighted.take(w, axis=0)
        known = np.flatnonzero(codes < n)
        if len(known):
            c = codes[known]
            order = np.argsort(c.astype(np.uint16) if n < 1 << 16 else c, kind="stable")  # 16 bits sort by radix
            c = c[order]
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            y[c[first]] += grouped_sums(rows, known[order] // PASSAGE, first)

    def run(batches) -> Iterator[dict]:
        y, held, size_held = np.zeros((n, width)), [], 0
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                c = bench.codes(t)
                if len(c):
                    held.append(c)
                    size_held += len(c)
                if size_held > 60_000:
                    product(held, y)
                    held, size_held = [], 0
        if held:
            product(held, y)
        for k in range(0, n, size):
            yield {"block": [k // size], "y": [y[k:k + size].tobytes()]}

    def total(batches) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0.0) + np.frombuffer(y)
        for k, y in sums.items():
            yield {"block": [k], "y": [y.tobytes()]}

    parts = arrow_map(docs.select("text"), run, schema)
    y = np.zeros((n, width))
    for r in arrow_map(parts.repartition("block"), total, schema).collect():  # terms x width numbers in all
        y[r.block * size:(r.block + 1) * size] = np.frombuffer(r.y).reshape(-1, width)
    product([np.array(i.codes) for i in bench.items], y)
    y *= idf[:, None]
    shift = 1e-9 * np.linalg.norm(y) + 1e-12
    y += shift * test
    core = test.T @ y
    lower = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(width))
    left = np.linalg.svd(np.linalg.solve(lower, y.T).T, full_matrices=False)[0]
    return left[:, :rule.axes]


class Searcher:
    """Finds a block's items in texts; holds only what the block's size bounds."""

    def __init__(self, bench: Benchmark, vectors: np.ndarray, rule: Rule):
        self.bench, self.rule, self.automaton = bench, rule, None
        self.vectors = np.vstack([vectors, np.zeros(vectors.shape[1])]).astype(np.float32)
        self.least = min((i.n for i in bench.items), default=0) * rule.paraphrased
        self.scales: dict[int, tuple[list[int], np.ndarray]] = {}
        for length in sorted({i.length for i in bench.items}):
            mine = [k for k, i in enumerate(bench.items) if i.length == length]
            z = np.stack([self.vectors[bench.items[k].codes].sum(axis=0) for k in mine])
            has = np.zeros((len(bench.terms) + 1, len(mine)), np.uint8)
            for j, k in enumerate(mine):
                np.add.at(has[:, j], bench.items[k].codes, 1)
            need = np.array([bench.items[k].n * rule.paraphrased for k in mine])
            self.scales[length] = mine, (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).T.copy(), has, need

    def find(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its found items: (item_id, cosine, share of the item in common, start word, kind)."""
        best: list[dict] = [{} for _ in texts]
        held, size = [], 0
        for i, t in enumerate(texts):
            if self.bench.short:
                self._short(t, best[i])
            if not self.bench.items:
                continue
            codes = self.bench.codes(t)
            if np.count_nonzero(codes < len(self.bench.terms)) < self.least:
                continue
            for at in range(0, max(1, len(codes) - 2 * LONGEST), SEGMENT - 2 * LONGEST):
                part = codes[at:at + SEGMENT]
                held.append((i, at, part))
                size += len(part)
                if size >= SEGMENT:
                    self._fold(held, best)
                    held, size = [], 0
        if held:
            self._fold(held, best)
        return [[found[k] for k in sorted(found, key=str)] for found in best]

    def _short(self, text: str | None, best: dict) -> None:
        """Short items by their whole word sequence: an ASCII letter or digit must not go on beyond either end."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for short, ids in self.bench.short.items():
                self.automaton.add_word(short, (short, ids))
            self.automaton.make_automaton()
        folded = b" ".join(words(text)).decode("latin-1")
        for last, (short, ids) in self.automaton.iter(folded):
            start = last + 1 - len(short)
            before, after = folded[max(0, start - 1):start], folded[last + 1:last + 2]
            if before.isascii() and before.strip() and short[0].isascii() or after.isascii() and after.strip() and short[-1].isascii():
                continue
            for item_id in ids:
                best.setdefault(item_id, (item_id, 1.0, 1.0, folded.count(" ", 0, start), "copy"))

    def _fold(self, held: list[tuple[int, int, np.ndarray]], best: list[dict]) -> None:
        """Fold pieces of texts, laid end to end, into the latent space; verify the windows near an item."""
        # Pieces begin on whole grains, so that sums are kept of grains only; what fills a piece up is no term.
        pieces = [c for _, _, c in held]
        n = np.array([len(c) for c in pieces])
        codes, first, room = whole(pieces, GRAIN, len(self.bench.terms))
        known = np.r_[0, np.cumsum(codes < len(self.bench.terms))]
        words_ = codes.reshape(-1, GRAIN).T
        grains = self.vectors.take(words_[0], axis=0)
        for w in words_[1:]:
            grains += self.vectors.take(w, axis=0)
        sums = np.zeros((len(grains) + 1, self.vectors.shape[1]), np.float32)
        np.cumsum(grains, axis=0, out=sums[1:])
        for length, (mine, axes, has, need) in self.scales.items():
            w = np.minimum(length, room)
            step = length // 4
            many = (room - w) // step + 2  # every step, and the text's last window
            of = np.repeat(np.arange(len(n)), many)
            starts = first[of] + np.minimum((np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * step, (room - w)[of])
            lo, hi = np.maximum(starts - length // 2, first[of]), np.minimum(starts + w[of] + length // 2, (first + n)[of])
            # What a region has of known words, and then of an item's words, bounds its common subsequence.
            rich = known[hi] - known[lo] >= need.min()
            of, starts, lo, hi = of[rich], starts[rich], lo[rich], hi[rich]
            z = sums.take((starts + w[of]) // GRAIN, axis=0)
            z -= sums.take(starts // GRAIN, axis=0)
            norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", z, z)), 1e-9)
            near = z @ axes
            # Cosines are made of what a slightly lower bound leaves.
            s, k = np.divmod(np.flatnonzero(near >= (norm * (self.rule.cosine * (1 - 1e-6)))[:, None]), near.shape[1])
            value = near[s, k] / norm[s]
            hit = value >= self.rule.cosine
            s, k, value = s[hit], k[hit], value[hit]
            # Of neighbouring windows the nearer one stands for both: what is verified reaches half a window further.
            after, before = np.minimum(s + 1, len(of) - 1), np.maximum(s - 1, 0)
            beaten = (after > s) & (of[after] == of[s]) & (near[after, k] / norm[after] > value)
            beaten |= (before < s) & (of[before] == of[s]) & (near[before, k] / norm[before] >= value)
            s, k, value = s[~beaten], k[~beaten], value[~beaten]
            for i in range(0, len(s), 4096):
                j = slice(i, i + 4096)
                self._bound(codes, held, first, lo, hi, starts, of, value[j], s[j], k[j], 2 * length, mine, has, need, best)

    def _bound(self, codes, held, first, lo, hi, starts, of, value, s, k, width, mine, has, need, best) -> None:
        place = lo[s][:, None] + np.arange(width)
        met = codes[np.minimum(place, len(codes) - 1)]
        most = has[met, k[:, None]]
        inside = (most > 0) & (place < hi[s][:, None])
        enough = np.flatnonzero(inside.sum(axis=1) >= need[k] - 1e-9)
        if not len(enough):
            return
        # A word counts no more often than the item has it.
        row, col = np.nonzero(inside[enough])
        key, at, count = np.unique(row * len(self.vectors) + met[enough][row, col], return_index=True, return_counts=True)
        bound = np.bincount(key // len(self.vectors), np.minimum(count, most[enough][row[at], col[at]]), len(enough))
        for i in enough[bound >= need[k[enough]] - 1e-9]:
            a, b = s[i], k[i]
            text, offset, piece = held[of[a]]
            self._verify(codes[lo[a]:hi[a]].tolist(), int(starts[a] - first[of[a]]) + offset, self.bench.items[mine[b]], float(value[i]), best[text], piece)

    def _answered(self, item: Item, region: list[int], codes: np.ndarray) -> bool:
        """The whole item's answer is in the region; that of a longer item in any stretch of the text's piece."""
        n = len(item.answer)
        stretches = [region]
        if not item.whole:
            size = 2 * max(n, 16)
            stretches = (codes[i:i + size].tolist() for i in range(0, max(1, len(codes) - size // 2), size // 2))
        return any(subsequence(item.answer_masks, n, c) >= self.rule.answered * n for c in stretches)

    def _verify(self, region: list[int], start: int, item: Item, cosine: float, best: dict, codes: np.ndarray) -> None:
        share = subsequence(item.masks, item.n, region) / item.n
        if share < self.rule.paraphrased or item.item_id in best and best[item.item_id][2] >= share:
            return
        kind = "copy"
        if share < self.rule.copied:
            if not self._answered(item, region, codes):
                return
            kind = "paraphrase"
        best[item.item_id] = (item.item_id, cosine, share, start, kind)


def searchers(docs: DataFrame, benchmark: DataFrame, rule: Rule) -> Iterator[Searcher]:
    """One searcher a block of items; the next is made when the one before has been used."""
    def made(rows: list[tuple]) -> Searcher:
        bench = Benchmark(rows, rule)
        if not bench.items:
            return Searcher(bench, np.zeros((len(bench.terms), 1)), rule)
        df, passages = _frequencies(docs, bench)
        idf = np.log((passages + 1) / (df + 1)) + 1e-3
        return Searcher(bench, _axes(docs, bench, idf, rule) * idf[:, None], rule)

    held = []
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text))
        if len(held) == rule.block:
            yield made(held)
            held = []
    if held:
        yield made(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row a document and item found in it: doc_id, item_id, cosine, common, start_word, kind.

    Each block but the last is a job of its own, whose rows are stored.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType),
        T.StructField("cosine", T.DoubleType()), T.StructField("common", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("kind", T.StringType()),
    ])

    def found(searcher: Searcher) -> DataFrame:
        def run(batches) -> Iterator[dict]:
            for b in slices(batches):
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = [(d, *hit) for d, hits in zip(ids, searcher.find(texts)) for hit in hits]
                yield dict(zip(schema.fieldNames(), zip(*rows) if rows else [()] * 6))

        return arrow_map(docs.select("doc_id", "text"), run, schema)

    parts: list[DataFrame] = []
    for searcher in searchers(docs, benchmark, rule):
        if parts:
            parts[-1] = stored(parts[-1], "contaminated")
        parts.append(found(searcher))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents in which no item is found, all their columns unchanged.

    Each block but the last is a job of its own, whose documents are stored and read by the next.
    """
    name = fresh(docs, "_clean")

    def clean(left: DataFrame, searcher: Searcher) -> DataFrame:
        @F.pandas_udf(T.BooleanType())
        def free(texts: pd.Series) -> pd.Series:
            return pd.Series([not hits for hits in searcher.find(list(texts))], dtype=bool)

        return left.withColumn(name, free("text")).where(quoted(name)).select(*[quoted(c) for c in docs.columns])

    left, blocks = docs, 0
    for searcher in searchers(docs, benchmark, rule):
        left = clean(stored(left, "clean") if blocks else left, searcher)
        blocks += 1
    return left


@query("op1_decontaminate")
def op1_decontaminate(spark, sf_dir):
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
