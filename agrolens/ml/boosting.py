"""Multi-class boosted trees by distributed histograms (M4, M5, M6).

Rows are binned once: a feature's value becomes its place among at most
``BINS - 1`` quantile edges, one byte each.  A round grows one tree a class on
the softmax loss, all classes level by level:

1. every task adds up gradient, second derivative and count by (class, node,
   feature, bin) over its rows, in Arrow batches;
2. the sums of one (class, node) meet in one task, which picks the best split;
3. the driver gets one row a (class, node) and extends the trees.

Several models (settings, folds) grow in the same passes, so a search of many
settings costs as many jobs as its longest model, not as their sum.  What the
driver and the tasks hold is bounded by parameters: models x classes x nodes x bins.
Margins of the rounds so far are written with the rows every ``REFRESH`` rounds
(which also cuts lineage in a way that survives lost executors); rounds since
then are added up in the pass.

Row and column sampling follow hashes of (seed, round), so a task that
runs again picks the same rows, and partial sums are added in task order, so
the trees are the same on every run.  A row without a class or with null features must be kept
out by the caller (``features.model_matrix`` has no nulls).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.session import shared_dir, ship_package

#: Bins of a feature at most (a bin is one byte).
BINS = 64
#: Rounds after which the margins are written anew.
REFRESH = 5
#: Features of one edge that share a number.
FLAGS = 30
#: Rows of a piece at most.
PIECE_ROWS = 10_000
#: Bytes of sums that a task holds at most, beyond one class of one model; more are added up in further passes.
SUMS_BYTES = 128 << 20


@dataclass(frozen=True)
class Params:
    """Settings of one model.  ``min_child_weight`` bounds a child's summed second
    derivatives, ``min_child_samples`` its rows: the two kinds of boosted backend."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    subsample: float = 0.8
    colsample: float = 0.8
    min_child_weight: float = 3.0
    min_child_samples: int = 1
    alpha: float = 0.1
    lam: float = 1.0
    seed: int = 42


@dataclass
class Booster:
    """Trees as arrays [round, class, node]: node i has the children 2i+1 and 2i+2; ``feature`` -1 marks a leaf.

    A row goes left where its feature is at most ``edges[feature][bin]``."""

    features: list[str]
    edges: list[np.ndarray]
    params: Params
    classes: int
    feature: np.ndarray = field(default=None)
    bin: np.ndarray = field(default=None)
    value: np.ndarray = field(default=None)
    cover: np.ndarray = field(default=None)
    #: Groups of 0/1 features of which a row has at most one set (indicators of one column); a group is summed as one column.
    exclusive: list[list[int]] = field(default_factory=list)

    def __post_init__(self):
        if self.feature is None:
            shape = (0, self.classes, 2 ** (self.params.depth + 1) - 1)
            self.feature, self.bin = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
            self.value, self.cover = np.zeros(shape), np.zeros(shape)

    def open_round(self) -> None:
        one = (1, *self.feature.shape[1:])
        self.feature = np.concatenate([self.feature, np.full(one, -1, np.int16)])
        self.bin = np.concatenate([self.bin, np.zeros(one, np.int16)])
        self.value, self.cover = np.concatenate([self.value, np.zeros(one)]), np.concatenate([self.cover, np.zeros(one)])

    def nodes(self, x: np.ndarray, r: int) -> np.ndarray:
        """The node that each row (of bins) reaches in round ``r``'s tree of each class."""
        columns = np.ascontiguousarray(x.T)
        return np.stack([self.reached(columns, r, k) for k in range(self.classes)], axis=1).astype(np.int64)

    def reached(self, columns: np.ndarray, r: int, k: int) -> np.ndarray:
        """The node that each row reaches in one tree; ``columns`` is [feature, row]: a split compares one column of bytes."""
        feature, cut = self.feature[r, k], self.bin[r, k].astype(np.uint8)
        at = np.zeros(columns.shape[1], np.uint8 if len(feature) < 2 ** 8 else np.int32)
        for level in range(self.params.depth):
            first, many = 2 ** level - 1, 2 ** level
            split = first + np.flatnonzero(feature[first:first + many] >= 0)
            if not len(split):
                break
            if len(split) <= 16:
                right, moves = np.zeros(len(at), bool), np.zeros(len(at), bool)
                for n in split:
                    here = at == at.dtype.type(n)
                    right |= here & (columns[feature[n]] > cut[n])
                    moves |= here
            else:
                f = feature[at]
                moves = f >= 0
                right = moves & (columns[np.maximum(f, 0), np.arange(len(at))] > cut[at])
            at += moves * (at + moves + right)
        return at

    def margins(self, x: np.ndarray, first: int = 0) -> np.ndarray:
        """Summed leaf values of the rounds from ``first`` on."""
        return np.ascontiguousarray(self.summed(np.ascontiguousarray(x.T), first).T)

    def summed(self, columns: np.ndarray, first: int = 0) -> np.ndarray:
        """[class, row]: the margins of rows given as [feature, row]."""
        out = np.zeros((self.classes, columns.shape[1]))
        for r in range(first, len(self.feature)):
            for k in range(self.classes):
                out[k] += self.value[r, k][self.reached(columns, r, k)]
        return out

    def binned(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, values[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def binned_columns(self, columns: list[np.ndarray]) -> np.ndarray:
        """[feature, row]: the bins of rows given as one array a feature."""
        return bins_of(self.edges, columns)

    def arrays(self) -> dict:
        return {k: getattr(self, k) for k in ("features", "edges", "params", "classes", "feature", "bin", "value", "cover", "exclusive")}


def bins_of(edges: list[np.ndarray], columns: list[np.ndarray]) -> np.ndarray:
    """[feature, row]: how many of a feature's edges are below each value; one edge is one comparison."""
    return np.stack([(c > e[0]).astype(np.uint8) if len(e) == 1 else np.searchsorted(e, c, side="left").astype(np.uint8) for e, c in zip(edges, columns)])


def numbers(columns) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in columns]


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def most_probable(p: np.ndarray, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(classes, probabilities) [row, rank]: the most probable first (ties: the higher class first)."""
    order = np.argsort(-p[:, ::-1], axis=1, kind="stable")[:, :k]
    classes = p.shape[1] - 1 - order
    return classes, np.take_along_axis(p, classes, 1)


def quantile_edges(df: DataFrame, cols: list[str], bins: int = BINS, indicators: list[int] | None = None) -> list[np.ndarray]:
    """Distinct quantiles of each feature (one pass, mergeable sketches); a value above all is in the last bin.

    ``indicators`` are the places of features that are 0 or 1 (never null): their quantiles follow from the count of zeros."""
    two = set(indicators or [])
    probs = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)])
    sketches = [F.percentile_approx(F.col(f"`{c}`"), probs, 10_000).alias(f"q{j}") for j, c in enumerate(cols) if j not in two]
    got = df.agg(F.count("*").alias("n"), *sketches, *[F.max(F.col(f"`{c}`")).alias(f"m{j}") for j, c in enumerate(cols)], *[F.sum(F.col(f"`{cols[j]}`")).alias(f"s{j}") for j in sorted(two)]).first()
    out = []
    for j in range(len(cols)):
        if j in two:
            ones = got[f"s{j}"] or 0.0
            out.append(np.array([0.0] if ones and (got["n"] - ones) * bins >= got["n"] else [], np.float64))
            continue
        q, top = got[f"q{j}"], got[f"m{j}"]
        e = np.unique(np.array(q if q is not None else [], np.float64))
        out.append(e[e < top] if top is not None else e)
    return out


def bin_rows(df: DataFrame, cols: list[str], edges: list[np.ndarray], label: str, fold: Column, keys: list[str]) -> DataFrame:
    """(x, y, fold, h, m): bins, class, fold, a hash of the keys, and margins (none yet).

    Features of one edge (indicators) cross into Python as bits of one number, those of none not at all."""
    share = [np.asarray(e) for e in edges]
    flags, wide = [j for j, e in enumerate(share) if len(e) == 1], [j for j, e in enumerate(share) if len(e) > 1]
    sets = [flags[i:i + FLAGS] for i in range(0, len(flags), FLAGS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.zeros((b.num_rows, len(share)), np.uint8)
            for i, j in enumerate(wide):
                x[:, j] = np.searchsorted(share[j], b.column(i).to_numpy(zero_copy_only=False), side="left")
            for i, some in enumerate(sets):
                bits = b.column(len(wide) + i).to_numpy(zero_copy_only=False)
                for p, j in enumerate(some):
                    x[:, j] = bits >> p & 1
            places = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(share))
            rows = pa.Array.from_buffers(pa.binary(), len(x), [None, places.buffers()[1], pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([rows, *[b.column(len(wide) + len(sets) + i) for i in range(3)], pa.nulls(b.num_rows, pa.binary())], names=["x", "y", "fold", "h", "m"])

    packed = [reduce(lambda u, v: u.bitwiseOR(v), [F.when(F.col(f"`{cols[j]}`") > float(share[j][0]), F.lit(1 << p)).otherwise(F.lit(0)).cast("bigint") for p, j in enumerate(some)]).alias(f"_b{i}") for i, some in enumerate(sets)]
    got = df.select(*[F.col(f"`{cols[j]}`") for j in wide], *packed, F.col(label).cast("int").alias("y"), fold.cast("int").alias("fold"), F.xxhash64(*keys).alias("h"))
    return got.mapInArrow(run, "x binary, y int, fold int, h bigint, m binary")


#: A piece: up to a batch of binned rows in one row, its arrays as bytes (``x`` by feature, ``m`` by model and class).
PIECE = "n int, x binary, y binary, fold binary, h binary, m binary"


def _packed(batches: Iterator[pa.RecordBatch], most: int = PIECE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``bin_rows`` as pieces of ``most`` rows at most; a pass reads a few large values in place of many rows."""
    for b in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)):
        x = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1)
        y, fold, h = (b.column(i).fill_null(-1).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        values = [np.ascontiguousarray(x.T).tobytes(), y.astype(np.int32).tobytes(), fold.astype(np.int32).tobytes(), h.astype(np.int64).tobytes()]
        yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int32()), *[pa.array([v], pa.binary()) for v in values], pa.nulls(1, pa.binary())], names=["n", "x", "y", "fold", "h", "m"])


def _pieces(batches: Iterator[pa.RecordBatch], everyone: int = 0, classes: int = 0) -> Iterator[tuple]:
    """(x [feature, row], y, fold, h, margins [model, class, row] or None) of each piece."""
    for b in batches:
        for i in range(b.num_rows):
            n = b.column(0)[i].as_py()
            x, y, fold, h = (np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in ((1, np.uint8), (2, np.int32), (3, np.int32), (4, np.int64)))
            held = b.column(5)[i]
            yield x.reshape(-1, n), y, fold, h, np.frombuffer(held.as_buffer(), np.float32).reshape(-1, classes, n)[:everyone] if held.is_valid and everyone else None


def _uniform(h: np.ndarray, seed: int, r: int) -> np.ndarray:
    """A number of [0, 1) for each hash, anew for each round."""
    z = h.view(np.uint64) + np.uint64((seed * 1_000_003 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def _columns(model: Booster, r: int, k: int) -> np.ndarray:
    """Features that round ``r``'s tree of class ``k`` may split."""
    n = len(model.features)
    take = max(1, round(model.params.colsample * n))
    keep = np.zeros(n, bool)
    keep[np.random.default_rng((model.params.seed, r, k)).permutation(n)[:take]] = True
    return keep


def best_split(hist: np.ndarray, sizes: np.ndarray, allowed: np.ndarray, p: Params) -> tuple:
    """(feature, bin, left sums, node sums) of the best split of a node's histogram [bins of all features, 3]; feature -1: none."""
    starts = np.cumsum(sizes) - sizes
    total = hist[:sizes[0]].sum(0)
    upto = np.cumsum(hist, axis=0)
    before = np.concatenate([np.zeros((1, 3)), upto])[starts]
    left = upto - np.repeat(before, sizes, axis=0)
    right = total - left
    score = lambda s: np.maximum(np.abs(s[..., 0]) - p.alpha, 0) ** 2 / (s[..., 1] + p.lam)
    gain = score(left) + score(right) - score(total)
    fits = np.repeat(allowed, sizes) & (left[:, 2] >= p.min_child_samples) & (right[:, 2] >= p.min_child_samples) & (left[:, 1] >= p.min_child_weight) & (right[:, 1] >= p.min_child_weight)
    gain = np.where(fits, gain, -np.inf)
    at = int(gain.argmax())
    if not gain[at] > 1e-9:
        return -1, 0, total, total
    f = int(np.searchsorted(starts, at, side="right")) - 1
    return f, at - int(starts[f]), left[at], total


def _leaf(s: np.ndarray, p: Params) -> float:
    return float(-np.sign(s[0]) * max(abs(s[0]) - p.alpha, 0.0) / (s[1] + p.lam) * p.rate)


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read back."""
    path = shared_dir(df.sparkSession, f"boost-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored_pieces(df: DataFrame, path: str | None = None) -> DataFrame:
    """``stored`` for pieces: small row groups, as a reader decodes a whole group of such few rows at once."""
    path = path or shared_dir(df.sparkSession, f"boost-{uuid.uuid4().hex}")
    df.write.option("parquet.block.size", 8 << 20).option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).option("parquet.enable.dictionary", "false").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt over all cores by their keys, whatever the input's files and row groups."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


class Columns:
    """The columns that histograms sum over: each feature, or one for an exclusive group, side by side.

    A piece's sums are added in its rows' order, each slot from 0, whichever way is taken, so all ways give the same digits."""

    def __init__(self, sizes: np.ndarray, exclusive: list[list[int]]):
        self.sizes, self.groups = sizes, [g for g in exclusive if len(g) > 1 and all(sizes[f] == 2 for f in g)]
        grouped = {f for g in self.groups for f in g}
        self.single = [f for f in range(len(sizes)) if f not in grouped]
        self.widths = np.array([*sizes[self.single], *[len(g) + 1 for g in self.groups]], np.int64)
        self.at, self.width = np.cumsum(self.widths) - self.widths, int(self.widths.sum())
        self.start = np.cumsum(sizes) - sizes
        #: Places of the columns of one slot, of two slots, and of more.
        self.whole, self.pairs, self.wide = (np.flatnonzero(w) for w in (self.widths == 1, self.widths == 2, self.widths > 2))

    def codes(self, columns: np.ndarray) -> np.ndarray:
        """[column, row] of rows given as [feature, row]: each row's bin; in a group, 0 where no feature is set."""
        out = np.empty((len(self.widths), columns.shape[1]), np.int64)
        out[:len(self.single)] = columns[self.single]
        for i, g in enumerate(self.groups):
            rows = columns[g]
            out[len(self.single) + i] = np.where(rows.any(0), rows.argmax(0) + 1, 0)
        return out

    def add(self, sums: np.ndarray, codes: np.ndarray, at: np.ndarray | None, many: int, grad: np.ndarray, hess: np.ndarray) -> None:
        """Adds the rows to the sums [class, 3, node, slot]; ``grad`` and ``hess`` are [class, row], ``at`` [class, row] is each
        row's node of the level (negative: in a leaf above), None at the root."""
        few = many <= 2
        if few:
            self._add_pairs(sums, codes, at, many, grad, hess)
        for k in range(len(sums)):
            live = None if at is None or not (at[k] < 0).any() else at[k] >= 0
            node, weights = (None if at is None else at[k]), (grad[k], hess[k])
            if live is not None:
                node, weights = node[live], (grad[k][live], hess[k][live])
            if not few:
                self._add_whole(sums[k], node, many, weights)
            for i in self.wide if few else (*self.pairs, *self.wide):
                start, width = self.at[i], self.widths[i]
                place = codes[i] if live is None else codes[i][live]
                if node is not None:
                    place = place + node * width
                for kind, weight in zip(sums[k], weights):
                    kind[:, start:start + width] += np.bincount(place, weight, many * width).reshape(many, width)
                if at is not None:
                    sums[k, 2, :, start:start + width] += np.bincount(place, None, many * width).reshape(many, width)
        if at is None:  # the counts of the root do not depend on the class
            for i in self.wide:
                sums[:, 2, 0, self.at[i]:self.at[i] + self.widths[i]] += np.bincount(codes[i], None, self.widths[i])

    def _add_whole(self, sums: np.ndarray, node: np.ndarray, many: int, weights: tuple) -> None:
        """Columns of one slot: all hold the same sums, those of the nodes."""
        if len(self.whole):
            for kind, weight in zip(sums, (*weights, None)):
                kind[:, self.at[self.whole]] += np.bincount(node, weight, many)[:, None]

    def _add_pairs(self, sums: np.ndarray, codes: np.ndarray, at: np.ndarray | None, many: int, grad: np.ndarray, hess: np.ndarray) -> None:
        """Columns of one and two slots, all classes at once: a product with 0 and 1 leaves a sum in the rows' order as it is."""
        classes = len(sums)
        own = np.ones((1, *grad.shape)) if at is None else np.stack([at == n for n in range(many)]).astype(np.float64)  # [node, class, row]
        weights = np.ascontiguousarray(np.concatenate([own * grad, own * hess]).reshape(2 * many * classes, -1).T)
        counted = own.reshape(many * classes, -1).astype(np.float32).T
        for i in self.pairs:
            for side in (0, 1):
                mine = codes[i] == side
                got = np.einsum("n,nk->k", mine.astype(np.float64), weights).reshape(2, many, classes)
                sums[:, :2, :, self.at[i] + side] += got.transpose(2, 0, 1)
                sums[:, 2, :, self.at[i] + side] += (mine.astype(np.float32) @ counted).reshape(many, classes).T
        if len(self.whole):
            got = np.einsum("n,nk->k", np.ones(weights.shape[0]), weights).reshape(2, many, classes).transpose(2, 0, 1)
            sums[:, :2, :, self.at[self.whole]] += got[..., None]
            sums[:, 2][..., self.at[self.whole]] += counted.sum(0, dtype=np.float64).reshape(many, classes).T[..., None]

    def spread(self, sums: np.ndarray) -> np.ndarray:
        """Sums by column slot [slot, 3] as sums by (feature, bin)."""
        out = np.zeros((int(self.sizes.sum()), sums.shape[1]))
        for f, at in zip(self.single, self.at):
            out[self.start[f]:self.start[f] + self.sizes[f]] = sums[at:at + self.sizes[f]]
        for g, at in zip(self.groups, self.at[len(self.single):]):
            total = sums[at:at + len(g) + 1].sum(0)
            for i, f in enumerate(g):
                one = sums[at + 1 + i]
                out[self.start[f]], out[self.start[f] + 1] = total - one, one
        return out


def _blocks(models: dict[int, tuple[Booster, int | None]], level: int) -> Iterator[dict[int, list[int]]]:
    """Classes of each model that one pass adds up, as many as ``SUMS_BYTES`` of a level's sums allow."""
    some = next(iter(models.values()))[0]
    each = 24 * 2 ** level * Columns(np.array([len(e) + 1 for e in some.edges]), some.exclusive).width
    todo = [(j, k) for j, (m, _) in models.items() if m.params.depth > level for k in range(m.classes)]
    take = max(1, SUMS_BYTES // each)
    for at in range(0, len(todo), take):
        block: dict[int, list[int]] = {}
        for j, k in todo[at:at + take]:
            block.setdefault(j, []).append(k)
        yield block


def _grow_level(rows: DataFrame, models: dict[int, tuple[Booster, int | None]], level: int, since: int) -> list:
    """Best splits of all nodes of a level, of all models."""
    return [row for block in _blocks(models, level) for row in _grow_block(rows, models, block, level, since)]


def _grow_block(rows: DataFrame, models: dict[int, tuple[Booster, int | None]], block: dict[int, list[int]], level: int, since: int) -> list:
    """Best splits of all nodes of a level, of the block's classes of each model."""
    some = next(iter(models.values()))[0]
    sizes = np.array([len(e) + 1 for e in some.edges])
    columns, k_all = Columns(sizes, some.exclusive), some.classes
    width = columns.width
    first, many = 2 ** level - 1, 2 ** level
    everyone = max(models) + 1
    models = {j: models[j] for j in block}

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {j: np.zeros((len(ks), 3, many, width)) for j, ks in block.items()}
        for x, y, fold, h, held in _pieces(batches, everyone, k_all):
            for j in sums:
                model, left_out = models[j]
                p, r = model.params, len(model.feature) - 1
                use = np.ones(len(y), bool) if left_out is None else fold != left_out
                if p.subsample < 1:
                    use &= _uniform(h, p.seed, r) < p.subsample
                if not use.any():
                    continue
                xs, ys = np.compress(use, x, axis=1), y[use]
                margins = replace_rounds(model, since, r).summed(xs)
                if held is not None:
                    margins += np.compress(use, held[j], axis=1)
                prob = np.ascontiguousarray(softmax(np.ascontiguousarray(margins.T)).T)
                grad, hess = prob - (ys == np.arange(k_all)[:, None]), np.maximum(2.0 * prob * (1.0 - prob), 1e-16)
                ks = block[j]
                at = np.stack([model.reached(xs, r, k) for k in ks]).astype(np.int64) - first if level else None
                columns.add(sums[j], columns.codes(xs), at, many, grad[ks], hess[ks])
        part = TaskContext.get().partitionId()
        out = [(j, k, n, part, s[i, :, n].T.tobytes()) for j, s in sums.items() for i, k in enumerate(block[j]) for n in range(many) if s[i, 2, n].any()]
        cols = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:4]], pa.array(cols[4], pa.binary())], names=["j", "k", "node", "part", "sums"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, out = None, None, []

        def done():
            j, k, n = key
            model = models[j][0]
            f, at, left, node = best_split(columns.spread(total), sizes, _columns(model, len(model.feature) - 1, k), model.params)
            out.append((j, k, n, f, at, [float(v) for v in (*left, *node)]))

        for b in batches:
            for j, k, n, _, s in zip(*(c.to_pylist() for c in b.columns)):
                if key != (j, k, n):
                    if key:
                        done()
                    key, total = (j, k, n), np.zeros((width, 3))
                total += np.frombuffer(s).reshape(width, 3)
        if key:
            done()
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:5]], pa.array(cols[5], pa.list_(pa.float64()))], names=["j", "k", "node", "feature", "bin", "sums"])

    parts = rows.mapInArrow(histograms, "j int, k int, node int, part int, sums binary")
    dealt = parts.repartition("j", "k", "node").sortWithinPartitions("j", "k", "node", "part")
    return dealt.mapInArrow(choose, "j int, k int, node int, feature int, bin int, sums array<double>").collect()  # models x classes x nodes


def replace_rounds(model: Booster, first: int, last: int) -> Booster:
    """The model with rounds [first, last) only."""
    cut = {k: getattr(model, k)[first:last] for k in ("feature", "bin", "value", "cover")}
    return replace(model, **cut)


def _refreshed(rows: DataFrame, models: dict[int, tuple[Booster, int | None]], since: int, path: str | None = None) -> DataFrame:
    """The rows with the margins of all rounds so far, written to ``path``."""
    k_all, everyone = next(iter(models.values()))[0].classes, max(models) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (x, y, _, _, held) in enumerate(_pieces([b], everyone, k_all)):
                new = np.zeros((everyone, k_all, len(y)), np.float32)
                if held is not None:
                    new += held
                for j, (model, _) in models.items():
                    new[j] += replace_rounds(model, since, len(model.feature)).summed(x)
                one = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*one.columns[:5], pa.array([new.tobytes()], pa.binary())], names=b.schema.names)

    return _stored_pieces(rows.mapInArrow(run, PIECE), path)


def hits(rows: DataFrame, models: dict[int, tuple[Booster, int | None]], k: int = 3) -> dict[int, tuple[int, int]]:
    """Of each model's left-out fold: rows, and rows whose class is among the ``k`` most probable (ties: the higher class first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {j: np.zeros(2, np.int64) for j in models}
        for x, y, fold, _, _ in _pieces(batches):
            for j, (model, left_out) in models.items():
                use = fold == left_out
                m, ys = model.summed(np.compress(use, x, axis=1)).T, y[use]
                mine = m[np.arange(len(ys)), ys][:, None]
                before = ((m > mine) | ((m == mine) & (np.arange(m.shape[1]) > ys[:, None]))).sum(1)
                got[j] += (len(ys), int((before < k).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int32()), *[pa.array([int(v[i]) for v in got.values()], pa.int64()) for i in (0, 1)]], names=["j", "n", "hit"])

    totals = rows.mapInArrow(run, "j int, n bigint, hit bigint").groupBy("j").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))
    return {r.j: (r.n, r.hit) for r in totals.collect()}  # a row a model


def fit_many(rows: DataFrame, models: dict[int, tuple[Booster, int | None]], rungs: dict[int, object] | None = None) -> dict[int, tuple[Booster, int | None]]:
    """Grow all models together, each on the rows outside its left-out fold.

    ``rungs`` maps a number of rounds to a function of (rows, models still growing) that says which go on.
    """
    spark = rows.sparkSession
    ship_package(spark)
    going, since, kept = dict(models), 0, None
    for r in range(max(m.params.rounds for m, _ in models.values())):
        going = {j: v for j, v in going.items() if v[0].params.rounds > r}
        if not going:
            break
        for m, _ in going.values():
            m.open_round()
        for level in range(max(m.params.depth for m, _ in going.values())):
            found = _grow_level(rows, going, level, since)
            split = False
            for row in found:
                m = going[row.j][0]
                at, sums = 2 ** level - 1 + row.node, np.array(row.sums)
                left, node = sums[:3], sums[3:]
                if level == 0:
                    m.value[r, row.k, 0], m.cover[r, row.k, 0] = _leaf(node, m.params), node[2]
                if row.feature >= 0:
                    m.feature[r, row.k, at], m.bin[r, row.k, at] = row.feature, row.bin
                    for child, s in ((2 * at + 1, left), (2 * at + 2, node - left)):
                        m.value[r, row.k, child], m.cover[r, row.k, child] = _leaf(s, m.params), s[2]
                    split = True
            if not split:
                break
        if rungs and r + 1 in rungs:
            stay = rungs[r + 1](rows, going)
            going = {j: v for j, v in going.items() if j in stay}
        if (r + 1) % REFRESH == 0 and going:
            old, kept = kept, shared_dir(spark, f"boost-{uuid.uuid4().hex}")
            rows, since = _refreshed(rows, going, since, kept), r + 1
            _removed(spark, old)  # else every refresh would stay on disk
    return models


def _removed(spark: SparkSession, path: str | None) -> None:
    """Removes a table of margins that a later one replaces."""
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def prepared(df: DataFrame, cols: list[str], edges: list[np.ndarray], label: str, fold: Column, keys: list[str], most: int = PIECE_ROWS) -> DataFrame:
    """The binned rows in pieces, dealt over all cores by their hash and written once: every pass reads them."""
    ship_package(df.sparkSession)
    rows = bin_rows(df, cols, edges, label, fold, keys)
    return _stored_pieces(rows.repartition(df.sparkSession.sparkContext.defaultParallelism, "h").mapInArrow(partial(_packed, most=most), PIECE))


def fit(train: DataFrame, cols: list[str], label: str, classes: int, params: Params, keys: list[str], exclusive: list[list[int]] | None = None) -> Booster:
    """One model on all rows of ``train``."""
    edges = quantile_edges(train, cols, indicators=[f for g in exclusive or [] for f in g])
    rows = prepared(train, cols, edges, label, F.lit(0), keys)
    model = Booster(list(cols), edges, params, classes, exclusive=exclusive or [])
    fit_many(rows, {0: (model, None)})
    return model


def probabilities(model: Booster, spark: SparkSession) -> Column:
    """The class probabilities of a row, from its feature columns (map-only, Arrow batches)."""
    ship_package(spark)
    share = spark.sparkContext.broadcast(model.arrays())

    @F.arrow_udf("array<double>")
    def run(*cols: pa.Array) -> pa.Array:
        p = _probabilities(Booster(**share.value), cols)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))

    return run(*[F.col(f"`{c}`") for c in model.features])


def _probabilities(model: Booster, cols) -> np.ndarray:
    return softmax(np.ascontiguousarray(model.summed(model.binned_columns(numbers(cols))).T))


def ranked(model: Booster, spark: SparkSession, k: int | None = None) -> Column:
    """array<struct<class_idx, probability>> of the ``k`` most probable classes (ties: the higher class first), ranked in the kernel."""
    ship_package(spark)
    share = spark.sparkContext.broadcast(model.arrays())

    @F.arrow_udf("array<struct<class_idx:int,probability:double>>")
    def run(*cols: pa.Array) -> pa.Array:
        classes, p = most_probable(_probabilities(Booster(**share.value), cols), k)
        each = pa.StructArray.from_arrays([pa.array(classes.ravel(), pa.int32()), pa.array(p.ravel())], names=["class_idx", "probability"])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), each)

    return run(*[F.col(f"`{c}`") for c in model.features])


def sampled_settings(trials: int, seed: int, rounds: tuple[int, int], base: Params = Params()) -> list[tuple[str, Params]]:
    """Seeded random settings over the reference's space, the two backends in turn; the same seed gives the same list."""
    rnd = np.random.default_rng(seed)
    out = []
    for i in range(trials):
        weight = i % 2 == 0
        log = lambda lo, hi: float(np.exp(rnd.uniform(np.log(lo), np.log(hi))))
        drawn = Params(rounds=int(rnd.integers(rounds[0], rounds[1] + 1)), depth=int(rnd.integers(3, 11)), rate=log(0.01, 0.3), subsample=float(rnd.uniform(0.5, 1)), colsample=float(rnd.uniform(0.5, 1)),
                       min_child_weight=float(rnd.integers(1, 11)) if weight else 1e-3, min_child_samples=1 if weight else int(rnd.integers(5, 51)),
                       alpha=log(1e-4, 10), lam=log(1e-4, 10), seed=base.seed)
        out.append(("boosted_weight" if weight else "boosted_samples", replace(drawn, depth=min(drawn.depth, base.depth))))
    return out


def search(rows: DataFrame, features: list[str], edges: list[np.ndarray], classes: int, settings: list[tuple[str, Params]], folds: list[int],
           halve_at: tuple[int, ...] = (), k: int = 3, exclusive: list[list[int]] | None = None) -> list[dict]:
    """Mean top-k accuracy over the folds for each setting, best first (ties: the earlier trial).

    All (setting, fold) models grow together.  At each number of rounds in ``halve_at`` the worse half of the
    settings still growing stops early; a stopped setting keeps the score of the rounds it has.
    """
    slots = [(t, f) for t in range(len(settings)) for f in folds]
    models = {j: (Booster(list(features), edges, settings[t][1], classes, exclusive=exclusive or []), f) for j, (t, f) in enumerate(slots)}

    def score(got: dict[int, tuple[int, int]]) -> dict[int, float]:
        by: dict[int, list[float]] = {}
        for j, (n, hit) in got.items():
            by.setdefault(slots[j][0], []).append(hit / n if n else 0.0)
        return {t: sum(v) / len(v) for t, v in by.items()}

    stopped: set[int] = set()

    def halve(now: DataFrame, going: dict[int, tuple[Booster, int | None]]) -> set[int]:
        by = score(hits(now, going, k))
        ranked = sorted(by, key=lambda t: (-by[t], t))
        out = set(ranked[(len(ranked) + 1) // 2:])
        stopped.update(out)
        return {j for j in going if slots[j][0] not in out}

    fit_many(rows, models, {r: halve for r in halve_at})
    last = score(hits(rows, models, k))
    done = {t: max(len(models[j][0].feature) for j, (s, _) in enumerate(slots) if s == t) for t in last}
    out = [{"trial": t, "backend": settings[t][0], "params": json.dumps(asdict(settings[t][1]), sort_keys=True), "folds": len(folds), "rounds": done[t],
            "stopped_early": t in stopped, "top3_accuracy": last[t]} for t in last]
    return sorted(out, key=lambda r: (-r["top3_accuracy"], r["trial"]))
