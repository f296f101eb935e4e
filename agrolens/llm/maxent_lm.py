"""Hashed maximum-entropy language model with a class-factored softmax.

``p(word | history) = p(class | history) * p(word | class, history)``.  The
``head`` most frequent training words share equal classes, in order of
frequency; the other words' classes are powers of two of their counts.  Both
factors of a head word are softmaxes over hashed features: the word before,
the pair before, and the word before that (a skip).  Inside a count class a
word has its smoothed share.  Half a count stands for any word that training has not
seen, as in the unigram base; the probabilities of all others sum to one or
less (a class may have unused places).

Jobs: (1) texts are tokenised once, in chunks with a dictionary of their own;
(2) the dictionaries are counted by word and every chunk gets its words' total
counts back, so that no table of all words is ever in one place; (3) rounds
of training, each over its share of the chunks: tasks run gradient steps from
the round's weights and send their change in blocks, which are averaged by
tokens; (4) chunks are scored.  What is kept on the driver is the weights,
whose size grows with the roots of the corpus' tokens and distinct words
between two parameters (``Shape``'s sizes and ``most``).

Defined results: a null text is empty; an empty text is one end token; a null
id hashes as an empty text; repeated rows are trained on and scored each for
itself; without training tokens every token is unknown; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import arrow_map, documents, query, slices, stored, sums_by_size


@dataclass(frozen=True)
class Shape:
    """Sizes of the model.  ``chunk`` is the text bytes that share a dictionary.

    ``head``, ``bins``, ``rows`` and ``word_rows`` are what a small corpus has;
    ``fitted`` raises them with the corpus.
    """

    head: int = 1024
    width: int = 32  # words a head class
    bins: int = 24  # count classes
    rows: int = 1 << 14  # hashed features of the class softmax
    word_rows: int = 1 << 13  # hashed features of the word softmaxes
    rounds: int = 4
    batch: int = 8192
    rate: float = 0.1
    chunk: int = 16 << 20
    blocks: int = 32
    most: int = 1 << 25  # weights of each softmax at most, whatever the corpus

    @property
    def classes(self) -> int:
        return self.head // self.width + self.bins

    def fitted(self, total: int, distinct: int) -> Shape:
        """The sizes for ``total`` training tokens of ``distinct`` words.

        Each power of two that a count can reach is a class of its own; head
        words grow with the root of the distinct words, and hashed features
        with the root of the tokens, up to ``most`` weights a softmax: that
        bounds what the driver holds and tasks are sent.
        """
        head = min(math.isqrt(max(distinct, 1) - 1) + 1, math.isqrt(self.most))
        grown = 1 << (math.isqrt(max(total, 1) - 1)).bit_length()
        shape = replace(self, head=max(self.head, -(-head // self.width) * self.width), bins=max(self.bins, total.bit_length()))

        def fit(least: int, wanted: int, each: int) -> int:
            return max(least, min(wanted, 1 << (self.most // each).bit_length() - 1))

        return replace(shape, rows=fit(self.rows, grown, shape.classes), word_rows=fit(self.word_rows, grown // 2, self.width))


def _pack(a: np.ndarray) -> bytes:
    """Compressed whole numbers: all their first bytes, then all their second ones, as high bytes are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class Codes(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def held_out(doc_id) -> bool:
    """The folds' rule: crc32 of the id as text, modulo five, is one."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words and the end token, which is empty."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), b""]


def ended(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' ``tokens``, by Arrow, and how many each text has."""
    texts = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(texts, "")), pa.scalar(" ", texts.type), pa.scalar("", texts.type))
    lists = pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(texts))
    return lists.flatten(), lists.value_lengths().to_numpy().astype(np.int32)


def numbered(pieces: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Each token's number, as ``Codes`` numbers them, and the words by number."""
    found = pa.chunked_array(pieces).dictionary_encode().unify_dictionaries()
    return np.concatenate([c.indices.to_numpy() for c in found.chunks]), found.chunk(found.num_chunks - 1).dictionary


def chunked(docs: DataFrame, shape: Shape) -> DataFrame:
    """Rows of both kinds: a chunk's documents as dictionary codes (word null), and its words."""
    ids = T.ArrayType(docs.schema["doc_id"].dataType)
    fields = [("chunk", T.LongType()), ("local", T.IntegerType()), ("word", T.BinaryType()), ("n", T.LongType()),
              ("doc_ids", ids), ("sizes", T.BinaryType()), ("held", T.BinaryType()), ("codes", T.BinaryType())]
    names = [f for f, _ in fields]

    def run(batches) -> Iterator[dict]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        docs_, pieces, counts = [], [], []

        def close() -> Iterator[dict]:
            chunk = part << 24 | seq
            held, sizes = np.array([held_out(d) for d in docs_], bool), np.concatenate(counts)
            codes, words = numbered(pieces)
            n = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(words))
            row = (chunk, None, None, None, docs_, _pack(sizes), _pack(held.astype(np.uint8)), _pack(codes))
            yield dict(zip(names, ([x] for x in row)))
            for i in range(0, len(words), 50_000):
                some = words[i:i + 50_000]
                k, none = len(some), [None] * len(some)
                yield dict(zip(names, ([chunk] * k, np.arange(i, i + k, dtype=np.int32), some, n[i:i + k], none, none, none, none)))

        def add(texts: pa.Array) -> None:
            words, many = ended(texts)
            pieces.append(words)
            counts.append(many)

        for b in slices(batches):
            ids_, texts, at = b.column(0).to_pylist(), b.column(1), 0
            for i, length in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), 1):
                docs_.append(ids_[i - 1])
                size += length
                if size >= shape.chunk:
                    add(texts[at:i])
                    yield from close()
                    seq, size, at = seq + 1, 0, i
                    docs_, pieces, counts = [], [], []
                    pa.default_memory_pool().release_unused()  # a worker stays for the training rounds
            if at < len(ids_):
                add(texts[at:])
        if docs_:
            yield from close()
        pieces.clear()
        pa.default_memory_pool().release_unused()

    return arrow_map(docs.select("doc_id", "text"), run, T.StructType([T.StructField(a, b) for a, b in fields]))


def _rest(a: np.ndarray, n: int) -> np.ndarray:
    """``a % n``; whole-number division by one number is vectorised, the remainder is not."""
    return a - a // n * n


class Weights:
    """Both softmaxes' weights and their features."""

    def __init__(self, shape: Shape, flat: np.ndarray | None = None):
        self.shape = shape
        n = shape.rows * shape.classes
        flat = np.zeros(n + shape.word_rows * shape.width, np.float32) if flat is None else flat
        self.flat = flat
        self.classes = flat[:n].reshape(shape.rows, shape.classes)
        self.words = flat[n:].reshape(shape.word_rows, shape.width)
        self._factors: tuple[Factors, Factors] | None = None

    def factors(self) -> tuple[Factors, Factors]:
        """Both softmaxes to score with, made once: weights do not change any more."""
        if self._factors is None:
            self._factors = Factors(self.classes, True), Factors(self.words, False)
        return self._factors

    def class_rows(self, h1, h2):
        rows = np.stack([h1 * 2654435761 >> 7, h2 * 2246822519 + 97 >> 9, (h1 * 3266489917 ^ h2 * 668265263) + 31 >> 5])
        return _rest(rows, self.shape.rows - 1) + 1

    def word_rows(self, cls, h1, h2):
        first = self.shape.head // self.shape.width  # rows below are the classes' own biases
        r = self.shape.word_rows - first
        return np.stack([cls, _rest(h1 * 2654435761 + cls * 40503 >> 7, r) + first, _rest(h2 * 2246822519 + cls * 60493 >> 9, r) + first])


#: Scores up to this in size have exponentials, and sums of these, that float32 holds.
_PLAIN = 80.0
#: Batches after which the weights' size is looked up anew.
_LOOK = 64


def _plain(table: np.ndarray, rate: float, features: int) -> bool:
    """Sums of ``features`` rows need no shift for ``_LOOK`` steps, of which each moves a weight by ``rate`` at most."""
    return bool(features * (max(-table.min(), table.max()) + _LOOK * rate) <= _PLAIN)


def _pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` rows of ``width`` numbers that stay in a core's cache through several operations."""
    step = max(64, (1 << 16) // width)
    return (slice(i, min(i + step, rows)) for i in range(0, rows, step))


def _probabilities(table: np.ndarray, rows: np.ndarray, bias: bool, plain: bool) -> np.ndarray:
    """The softmax of each column of ``rows``, which are features; ``bias`` adds the table's first row to all.

    Unless scores are ``plain`` (small enough as they are), each token's are taken less their greatest.
    """
    out = np.empty((rows.shape[1], table.shape[1]), np.float32)
    ones = np.ones(table.shape[1], np.float32)
    for s in _pieces(*out.shape):
        z = out[s]
        np.take(table, rows[0, s], axis=0, out=z, mode="clip")
        room = np.empty_like(z)
        for r in rows[1:, s]:
            z += np.take(table, r, axis=0, out=room, mode="clip")
        if bias:
            z += table[0]
        if not plain:
            z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z *= (1 / (z @ ones))[:, None]
    return out


class Factors:
    """A softmax to score with: a row's exponentials are products of its features' ones, which are made once."""

    def __init__(self, table: np.ndarray, bias: bool):
        self.table, self.bias = table, bias
        self.top = table.max(axis=1)  # taken off, so that no product is above one
        self.exp = table - self.top[:, None]
        np.exp(self.exp, out=self.exp)
        self.first = self.exp[0] if bias else np.ones(table.shape[1], np.float32)

    def log_p(self, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probability of each row's ``y``."""
        total = np.empty(len(y), np.float32)
        for s in _pieces(len(y), self.table.shape[1]):
            p = self.exp.take(rows[0, s], axis=0)
            room = np.empty_like(p)
            for r in rows[1:, s]:
                p *= np.take(self.exp, r, axis=0, out=room, mode="clip")
            total[s] = p @ self.first
        # Features whose greatest weights lie far apart leave products too small for float32.
        low = np.flatnonzero(total < 1e-30)
        total[low] = 1
        out = (self.table[rows, y] - self.top[rows]).sum(axis=0) - np.log(total)
        if self.bias:
            out += self.table[0][y] - self.top[0]
        if len(low):
            z = self.table[rows[:, low]].sum(axis=0) + (self.table[0] if self.bias else 0)
            z -= z.max(axis=1, keepdims=True)
            out[low] = z[np.arange(len(low)), y[low]] - np.log(np.exp(z).sum(axis=1))
        return out


def _update(table: np.ndarray, square: np.ndarray, at: np.ndarray, change: np.ndarray, rate: float) -> None:
    """Adaptive steps of the rows ``at`` by their gradients ``change``, which are used up."""
    now = square.take(at, axis=0)
    room = change * change
    now += room
    square[at] = now
    now += 1e-6
    np.sqrt(now, out=now)
    change *= rate
    change /= now
    np.take(table, at, axis=0, out=room, mode="clip")
    room -= change
    table[at] = room


def _step(table: np.ndarray, square: np.ndarray, rows: np.ndarray, y: np.ndarray, rate: float, bias: bool, plain: bool) -> None:
    """One adaptive gradient step on a batch; rows that tokens share get their summed gradient."""
    g = _probabilities(table, rows, bias, plain)
    g.ravel()[np.arange(len(y)) * g.shape[1] + y] -= 1
    flat = rows.ravel().astype(np.uint16 if len(table) <= 1 << 16 else np.int64)  # 16 bits sort by radix
    order = np.argsort(flat, kind="stable")
    at = flat[order]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    order %= len(y)
    at = at[start].astype(np.int64)
    for some, total in sums_by_size(g, order, start):
        _update(table, square, at[some], total, rate)
    if bias:
        _update(table, square, np.zeros(1, np.int64), np.ones((1, len(y)), np.float32) @ g, rate)


class Chunk:
    """One chunk's tokens, with what the whole corpus knows about its words."""

    def __init__(self, row: dict, shape: Shape):
        self.codes = _unpack(row["codes"], np.int32)
        self.word_count, head, self.hashed = _unpack(row["counts"], np.int64), _unpack(row["heads"], np.int32), _unpack(row["hashes"], np.int64)
        self.doc_ids, self.sizes = row["doc_ids"], _unpack(row["sizes"], np.int32)
        self.held = _unpack(row["held"], np.uint8).astype(bool)
        tail = np.minimum(np.log2(np.maximum(self.word_count, 1)).astype(np.int64), shape.bins - 1)
        self.word_class = np.where(head >= 0, head // shape.width, shape.head // shape.width + tail)
        self.word_within = np.where(head >= 0, head % shape.width, -1)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.nth = np.full(len(self.codes), 2, np.uint8)  # a text's first and second token have less history
        self.nth[self.first[self.sizes > 1] + 1] = 1
        self.nth[self.first] = 0

    def tokens(self, k: np.ndarray):
        """Class, place in it (-1: a count class), and hashes of the two words before, of tokens ``k``."""
        w = self.codes[k]
        h1 = np.where(self.nth[k] > 0, self.hashed[self.codes[k - 1]], 1)
        h2 = np.where(self.nth[k] > 1, self.hashed[self.codes[k - 2]], 1)
        return w, self.word_class[w], self.word_within[w], h1, h2

    def logs(self, weights: Weights, tail_mass: np.ndarray) -> np.ndarray:
        """Natural log probability of every token."""
        shape, out = weights.shape, np.empty(len(self.codes))
        tails, classes, words = shape.head // shape.width, *weights.factors()
        for i in range(0, len(out), shape.batch):
            w, cls, within, h1, h2 = self.tokens(np.arange(i, min(i + shape.batch, len(out))))
            lp = classes.log_p(weights.class_rows(h1, h2), cls).astype(np.float64)
            k = np.flatnonzero(within >= 0)
            if len(k):
                lp[k] += words.log_p(weights.word_rows(cls[k], h1[k], h2[k]), within[k])
            k = np.flatnonzero(within < 0)
            lp[k] += np.log((self.word_count[w[k]] + 0.5) / tail_mass[cls[k] - tails])
            out[i:i + shape.batch] = lp
        return out

    def train(self, weights: Weights, squares: Weights) -> int:
        shape = weights.shape
        mine = np.flatnonzero(np.repeat(~self.held, self.sizes))
        for i in range(0, len(mine), shape.batch):
            if i % (_LOOK * shape.batch) == 0:
                plain = _plain(weights.classes, shape.rate, 4), _plain(weights.words, shape.rate, 3)
            _, cls, within, h1, h2 = self.tokens(mine[i:i + shape.batch])
            _step(weights.classes, squares.classes, weights.class_rows(h1, h2), cls, shape.rate, True, plain[0])
            k = np.flatnonzero(within >= 0)
            if len(k):
                _step(weights.words, squares.words, weights.word_rows(cls[k], h1[k], h2[k]), within[k], shape.rate, False, plain[1])
        return len(mine)


def _rows(batches) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def encoded(docs: DataFrame, shape: Shape) -> tuple[DataFrame, int, int, np.ndarray]:
    """(chunks with their words' counts, N, V, mass of each count class)."""
    parts = stored(chunked(docs, shape), "lm-chunks", codec="zstd")
    words = parts.where("word IS NOT NULL").select("chunk", "local", "word", "n")
    # Counts combine before they are exchanged; both sides of the join back are tables, so Spark can split a common word.
    totals = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    seen = totals.where("c > 0")
    total, distinct = seen.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shape = shape.fitted(int(total), int(distinct))
    head = [r.word for r in seen.orderBy(F.desc("c"), "word").limit(shape.head).collect()]
    rank = docs.sparkSession.createDataFrame([(bytes(w), i) for i, w in enumerate(head)], "word binary, head int")
    tail = F.least(F.floor(F.log2(F.col("c").cast("double"))), F.lit(shape.bins - 1))
    mass = np.zeros(shape.bins)
    rest = seen.join(F.broadcast(rank), "word", "left_anti")
    for r in rest.groupBy(tail.cast("int").alias("bin")).agg((F.sum("c") + 0.5 * F.count("*")).alias("m")).collect():
        mass[r.bin] = r.m
    mass[0] += 0.5
    schema = T.StructType([T.StructField("chunk", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("counts", "heads", "hashes"))])

    def assemble(batches) -> Iterator[dict]:
        chunk, held = None, []

        def done() -> dict:
            c, h, at = (np.concatenate(z) for z in zip(*held))
            return {"chunk": [chunk], "counts": [_pack(c)], "heads": [_pack(h)], "hashes": [_pack(at.astype(np.int32).astype(np.int64))]}  # the low half

        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            cut = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]]) if b.num_rows else []
            for s, e in zip(cut, [*cut[1:], b.num_rows]):
                if held and cols[0][s] != chunk:
                    yield done()
                    held = []
                chunk = int(cols[0][s])
                held.append([x[s:e] for x in cols[1:]])
        if held:
            yield done()

    # An entry's place and its word's hash share a number, which sorts by place.
    place = F.shiftleft(F.col("local").cast("long"), 32).bitwiseOR(F.hash("word").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    back = words.select("chunk", "local", "word").join(totals.join(F.broadcast(rank), "word", "left"), "word")
    back = back.select("chunk", "c", F.coalesce("head", F.lit(-1)).alias("head"), place.alias("place"))
    known = arrow_map(back.repartition("chunk").sortWithinPartitions("chunk", "place"), assemble, schema)
    texts = parts.where("word IS NULL").select("chunk", "doc_ids", "sizes", "held", "codes")
    return stored(texts.join(known, "chunk"), "lm-encoded", 1), int(total), int(distinct), mass


def train(chunks: DataFrame, shape: Shape) -> Weights:
    """One pass over the training tokens, in ``rounds`` averaged steps over disjoint shares of the chunks."""
    weights = Weights(shape)
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("delta", T.BinaryType())])

    def total(batches) -> Iterator[dict]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for r in _rows(batches):
            n, d = sums.get(r["block"], (0, 0.0))
            sums[r["block"]] = n + r["n"], d + np.frombuffer(r["delta"], np.float32).astype(np.float64) * r["n"]
        for k, (n, d) in sums.items():
            yield {"block": [k], "n": [n], "delta": [(d / n).astype(np.float32).tobytes()]}

    sc = chunks.sparkSession.sparkContext
    for r in range(shape.rounds):
        sent = sc.broadcast(weights.flat)  # of the size that ``shape`` fixes

        def learn(batches, sent=sent) -> Iterator[dict]:
            mine, squares, n = Weights(shape, sent.value.copy()), Weights(shape), 0
            for row in _rows(batches):
                n += Chunk(row, shape).train(mine, squares)
            if n:
                for k, d in enumerate(np.array_split(mine.flat - sent.value, shape.blocks)):
                    yield {"block": [k], "n": [n], "delta": [d.tobytes()]}

        share = chunks.where(F.pmod(F.xxhash64("chunk"), F.lit(shape.rounds)) == r)
        deltas = arrow_map(share, learn, schema)
        got = {x.block: np.frombuffer(x.delta, np.float32) for x in arrow_map(deltas.repartition("block"), total, schema).collect()}
        if got:
            weights = Weights(shape, weights.flat + np.concatenate([got[k] for k in range(shape.blocks)]))
    return weights


def score(chunks: DataFrame, weights: Weights, total: int, distinct: int, mass: np.ndarray) -> DataFrame:
    """One row a document with base and model scores, in log10."""
    shape = weights.shape
    sent = chunks.sparkSession.sparkContext.broadcast(weights.flat)
    ids = chunks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", ids), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")),
                           T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches) -> Iterator[dict]:
        w = Weights(shape, sent.value)
        for row in _rows(batches):
            c = Chunk(row, shape)
            base = np.log10((c.word_count + 0.5) / (total + 0.5 * (distinct + 1)))[c.codes]
            logs = c.logs(w, mass) / np.log(10)
            yield {"doc_id": c.doc_ids, "held_out": c.held, "n_tokens": c.sizes.astype(np.int64), "n_known": np.add.reduceat((c.word_count > 0)[c.codes].astype(np.int64), c.first),
                   "train_tokens": np.full(len(c.sizes), total), "base_score": np.add.reduceat(base, c.first), "score": np.add.reduceat(logs, c.first)}

    return arrow_map(chunks, run, schema)


def lm_score(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """Train on the folds that are not held out, score all documents."""
    chunks, total, distinct, mass = encoded(docs, shape)
    return score(chunks, train(chunks, shape.fitted(total, distinct)), total, distinct, mass)


@query("op8_maxent_lm")
def op8_maxent_lm(spark, sf_dir):
    return lm_score(documents(spark, sf_dir))
