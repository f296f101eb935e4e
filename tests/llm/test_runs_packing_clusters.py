"""Centroid clusters, packing and periodic runs against plain versions."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from llm_frames import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agrolens.llm import best_fit, centroid_tree, periodic_runs

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# Periodic runs

def plain_runs(words, least=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_summary(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def runs_of(texts):
    split, words, sizes = periodic_runs.side_by_side(texts)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    out = [[] for _ in texts]
    for s, e, q in zip(*(x.tolist() for x in periodic_runs.find_runs(words, sizes))):
        d = int(np.searchsorted(begin, s, side="right")) - 1
        out[d].append((s - int(begin[d]), e - s, q))
    return split, out


def test_runs_equal_a_plain_search():
    rnd = random.Random(3)
    texts = [None, "", "a", "a a a a a a", "a a a a a", "a b " * 4, "a b a b a b a"]
    for _ in range(400):
        letters = "ab" if rnd.random() < 0.5 else "abcdefgh"
        words = []
        for _ in range(rnd.randint(0, 6)):
            block = [rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 30, 33, 64]))]
            words += (block * rnd.randint(1, 7))[:rnd.randint(1, 400)]
        texts.append(" ".join(words))
    for n in (0, 1, 2, 3):  # nested: a run of runs
        texts.append(" ".join((["a"] * 7 + ["b"] * 9 + ["c"] * n) * 5))
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    texts.append(" ".join(fib[-1]))
    split, got = runs_of(texts)
    for words, runs in zip(split, got):
        assert runs == plain_runs(words)


def test_every_period_is_found():
    """Each period from 1 to 300 at exactly four times, alone between other words."""
    rnd = random.Random(5)
    texts = []
    for q in range(1, 301):
        block = [f"w{i}" for i in range(q)]
        texts.append(" ".join([f"x{rnd.random()}" for _ in range(rnd.randint(0, 40))] + block * 6 + ["end"]))
        texts.append(" ".join(["l", *block * 4, "r"]))
        texts.append(" ".join(["l", *(block * 4)[:-1], "r"]))
    split, got = runs_of(texts)
    for i, (words, runs) in enumerate(zip(split, got)):
        q = i // 3 + 1
        if i % 3 < 2 and (i % 3 == 0 or 4 * q >= 6):
            assert [r[2] for r in runs] == [q]
        elif i % 3 == 2:
            assert runs == plain_runs(words)


def test_runs_query(spark, edges, small, nothing):
    edges = edges.where("doc_id IS NULL OR doc_id NOT IN (5, 6)")  # the plain search takes n^2 / 4 steps
    for docs in (edges, small, nothing):
        docs = docs.select("*", F.lit("x").alias("runs"), F.lit(1).alias("collapsed"), F.lit(0).alias("chosen"))
        got = sorted((tuple(r) for r in periodic_runs.summary(periodic_runs.periodic_runs(periodic_runs.with_planted(docs))).collect()), key=repr)
        want = sorted((plain_summary(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len((r.text or "").split()) < 3000), key=repr)
        held = {w[0] for w in want}
        assert [g for g in got if g[0] in held] == want
        assert len(got) == docs.count()


def test_runs_of_long_texts(spark):
    rnd = random.Random(11)
    block = prose(rnd, 7001).split()
    words = prose(rnd, 5000).split() + ["<"] + block * 4 + [">"] + ["z"] * 30_000
    frame = spark.createDataFrame([(1, " ".join(words)), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(frame).collect()}
    runs = [tuple(r) for r in got[1].runs if r.length > 100]
    assert runs == [(5001, 4 * 7001, 7001), (5002 + 4 * 7001, 30_000, 1)]
    assert got[2].runs == [] and got[2].collapsed == ""
    assert len(got[1].collapsed.split()) <= 5000 + 1 + 7001 + 1 + 1


# Packing

@cache
def fewest(items, capacity):
    """The fewest sequences, by search over what goes with the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = 1 + fewest(rest, capacity)
    for n in range(1, len(rest) + 1):
        for at in itertools.combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in at) <= capacity:
                best = min(best, 1 + fewest(tuple(x for i, x in enumerate(rest) if i not in at), capacity))
    return best


def test_reduction_keeps_the_fewest():
    rnd = random.Random(2)
    fixed_some = fixed_all = 0
    for i in range(150):
        capacity = rnd.choice([20, 40, 60])
        items = [rnd.randint(*((1, capacity) if i % 2 else (capacity // 7, capacity // 2))) for _ in range(rnd.randint(1, 9 if i % 2 else 8))]
        counts = np.bincount(items, minlength=capacity + 1)
        left, fixed = best_fit.reduced(counts, capacity)
        used = Counter()
        for held, n in fixed:
            assert sum(held) <= capacity
            used.update({s: m * n for s, m in Counter(held).items()})
        rest = sorted(np.repeat(np.arange(capacity + 1), left).tolist(), reverse=True)
        assert used + Counter(rest) == Counter(items)
        n_fixed = sum(n for _, n in fixed)
        fixed_some += bool(n_fixed and rest)
        fixed_all += not rest
        assert n_fixed + fewest(tuple(rest), capacity) == fewest(tuple(sorted(items, reverse=True)), capacity)
    assert fixed_some >= 3 and 50 < fixed_all < 150


def test_best_fit_by_counts_is_best_fit_by_items():
    rnd = random.Random(4)
    for _ in range(200):
        capacity = rnd.choice([12, 50, 100])
        items = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))), reverse=True)
        rooms = []
        for w in items:
            fit = [r for r in rooms if r >= w]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else capacity) - w)
        got = best_fit.best_fit(np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, np.int64), capacity)
        assert sorted(itertools.chain(*([capacity - sum(h)] * n for h, n in got))) == sorted(rooms)


def test_plan_of_many_items_is_small():
    rnd = np.random.default_rng(1)
    counts = {int(s): int(n) for s, n in enumerate(rnd.integers(0, 10 ** 9, 2049)) if s}
    made = best_fit.plan(counts, 2048)
    assert len(made["length"]) < best_fit.runs_bound(2048) // 10
    # At least: those that share with none, those above a half, and what the small ones need beyond their room.
    n, size = np.array([counts.get(s, 0) for s in range(2049)]), np.arange(2049)
    total, half, bound = (n * size), 1024, 0
    for k in range(1, half + 1):
        alone, wide = n[2049 - k:].sum(), slice(half + 1, 2049 - k)
        room = 2048 * n[wide].sum() - total[wide].sum()
        bound = max(bound, int(alone + n[wide].sum() + max(0, -(-(total[k:half + 1].sum() - room) // 2048))))
    assert bound <= int(made["sequences"][0]) <= 1.001 * bound


def test_words_encode_like_whole_texts():
    rnd = random.Random(8)
    core = Tokenizer.from_file(WORD_BPE)
    encoder = best_fit.Encoder(core.to_str())
    alphabet = list("aAbÉéΣσς'sS'll ' 1٣²  \t\n\x0b\x0c\x1c\x85\xa0 　́̈e漢😀ＡİIıßſKÅ​\x00-.,<|>") + ["<|endoftext|>", "<|startoftext|>", "don't", "Word", "ΟΔΟΣ "]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 30))) for _ in range(4000)] + ["x" * 3000, "ab " * 500]
    latin = list("aBcÀéßÿÖ×÷ºª '0123.,<|>!\t\n_~") + ["'LL", "'s", "'re ", "don't"]
    texts += ["".join(rnd.choice(latin) for _ in range(rnd.randint(0, 40))) for _ in range(4000)]
    for part in (texts[:2000], texts[2000:6000], texts[6000:]):
        got = [encoder.encode(t) for t in part]
        want = core.encode_batch(part, add_special_tokens=False)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [w.ids for w in want]


def check_packing(rows, docs, capacity):
    core = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for r in docs:
        ids = core.encode(r.text or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), capacity):
            part = ids[p:p + capacity]
            want[r.doc_id, p // capacity, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spans in held.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(spark, edges, small, nothing, capacity):
    for docs in (edges, small, nothing):
        docs = docs.select("*", F.lit("x").alias("piece"), F.lit(1).alias("task"))
        got = best_fit.placed(best_fit.pieces(docs, WORD_BPE, capacity).select("*", F.crc32("ids").alias("ids_crc32"), F.lit(0).alias("base"), F.lit(0).alias("nth")).drop("ids"), capacity)
        assert got.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
        n, total = check_packing(got.collect(), docs.select("doc_id", "text").collect(), capacity)
        assert n <= math.ceil(total / capacity) * 1.02 + 1


def test_packing_of_equal_rows(spark):
    """One text that makes almost all rows, without ids."""
    docs = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 10 == 0, F.lit("some other words")).otherwise(F.lit("the same text again")).alias("text")).repartition(7)
    got = best_fit.pack(docs, WORD_BPE, 20).select("*", F.crc32("ids").alias("ids_crc32")).collect()
    n, total = check_packing(got, docs.collect(), 20)
    assert n <= math.ceil(total / 20) * 1.02 + 1


# Clusters

def plain_clusters(rows, k=16, rounds=3):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            x = tuple(math.floor(64 * x) for x in v)
            if max(map(abs, x)) < 1 << 27:
                kept.append((vec_id, x))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x in kept:
            groups[nearest(x)[1]].append(x)
        for i, xs in groups.items():
            centroids[i] = tuple(sum(col) // len(xs) for col in zip(*xs))
    found = [(vec_id, *nearest(x)) for vec_id, x in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((v, c, d, inertia[c], sum(inertia.values()), digest[c]) for v, d, c in found), key=repr)


def got_clusters(frame):
    assigned, centroids = centroid_tree.clusters(frame)
    return sorted((tuple(r) for r in centroid_tree.with_inertia(assigned, centroids).collect()), key=repr)


def test_clusters(spark):
    whole = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in whole.collect()]
    assert got_clusters(whole) == plain_clusters(rows)


def test_clusters_edges(spark):
    rnd = random.Random(6)
    grid = [[rnd.choice([-1.0, 0.0, 1.0, 0.5]) if j < 3 else 0.0 for j in range(64)] for _ in range(300)]  # many ties
    rows = [(i, v) for i, v in enumerate(grid)] + [(i, v) for i, v in enumerate(grid[:60])]  # repeated rows
    rows += [(None, grid[0]), (None, [0.25] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63),
             (906, [None] + [0.0] * 63), (907, [3e38] * 64), (908, [2.0e6] * 64), (909, [-1e-9] * 64)]
    schema = "vec_id long, embedding array<float>, cluster string, v int, sums int"
    frame = lambda r: spark.createDataFrame([(*x, "x", 1, 2) for x in r], schema).repartition(5)
    assert got_clusters(frame(rows)) == plain_clusters(rows)
    assert got_clusters(frame(rows[:5])) == plain_clusters(rows[:5])  # fewer vectors than centroids
    assert got_clusters(frame([])) == [] and got_clusters(frame([(1, None)])) == []


def test_tree_search_is_exact_and_prunes():
    rnd = np.random.default_rng(9)
    for k in (1, 2, 3, 16, 200):
        centres = rnd.integers(-400, 400, (max(1, k // 4), 64))
        centroids = centres[rnd.integers(0, len(centres), k)] + rnd.integers(-3, 4, (k, 64))
        centroids[k // 2:] = np.where(rnd.random((k - k // 2, 1)) < 0.3, centroids[:k - k // 2], centroids[k // 2:])  # equal centroids
        vectors = centroids[rnd.integers(0, k, 500)] + rnd.integers(-2, 3, (500, 64))
        at, d, looked = centroid_tree.search(centroid_tree.build(centroids), vectors)
        every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
        assert (at == every.argmin(1)).all() and (d == every.min(1)).all()
        if k == 200:
            assert looked < 0.5 * every.size
