"""SimHash near-duplicates by multi-index hashing.

A fingerprint has a bit set if more than half of the text's shingle hashes
have it.  Equal fingerprints collapse first, by a combinable aggregate, so a
group of copies is one row from there on.  The 64 bits are cut into three
segments: two fingerprints at distance ``d <= 4`` agree on some segment up to
``d // 3`` bits.  Each fingerprint enters the table of each segment under its
value, and probes the values of the small Hamming ball around it; a ball's
members are enumerated by setting bits only, as of two values that differ in
one bit one has it clear.  Rows meet on (segment, value); all bits are then
compared.  What a bucket gives back is a forest of links, never all its
pairs, and the forests' components are joined by star contraction.

Defined results: null and empty texts have fingerprint zero and link like any
other; a null id is never a component's id unless the component has no other;
repeated rows come back as often as they are listed; an empty table gives an
empty table; other columns are ignored, also where names clash.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import arrow_map, documents, fresh, query, quoted, slices, stored

#: Fingerprints a bucket, on average, up to which three segments are used.
BUCKET = 64
#: Members of a bucket up to which its pairs are expanded together with other buckets'.
SMALL = 64
#: Pairs compared at once.
BLOCK = 1 << 20


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> bytes:
    """The 64-bit fingerprint of one text, most significant byte first."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return bytes(8)
    whole = b" ".join(words)
    if n <= width:
        hashes = xxhash.xxh64_digest(whole, seed)
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(whole[a:b - 1], seed) for a, b in zip(starts, ends[width - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in slices(batches):
            raw = b"".join(fingerprint(t.as_py(), width, seed) for t in b.column(1))
            yield {"doc_id": b.column(0), "fp": np.frombuffer(raw, ">i8").astype(np.int64)}

    return arrow_map(docs.select("doc_id", "text"), run, schema)


def segments(prints: int) -> tuple[tuple[int, int], ...]:
    """(shift, width) of the segments for that many different fingerprints, lowest bits first."""
    return ((0, 22), (22, 21), (43, 21)) if prints <= BUCKET << 21 else ((0, 32), (32, 32))


def _keys(fps: np.ndarray, cuts: tuple[tuple[int, int], ...], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, fp, probe) of all table entries and probes of ``fps``."""
    u = fps.view(np.uint64)
    keys, owners, probes = [], [], []
    for s, (shift, width) in enumerate(cuts):
        value = (u >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(s << 32)
        keys.append(value | tag)
        owners.append(fps)
        probes.append(np.zeros(len(fps), bool))
        for r in range(1, radius + 1):
            for flips in combinations(range(width), r):
                flip = np.uint64(sum(1 << b for b in flips))
                # With one bit only its clear side probes; larger sets of bits are probed from both sides.
                own = (value & flip) == 0 if r == 1 else np.ones(len(fps), bool)
                keys.append((value[own] ^ flip) | tag)
                owners.append(fps[own])
                probes.append(np.ones(int(own.sum()), bool))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(probes)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what (a, b) connect, at most one fewer than the nodes."""
    if not len(a):
        return a, b
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs = np.unique(np.stack([at[:len(a)], at[len(a):]], axis=1), axis=0).tolist()
    up = list(range(len(ids)))
    keep = []
    for x, y in pairs:
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            keep.append((x, y))
            up[max(x, y)] = min(x, y)
    keep = np.array(keep, np.int64).reshape(-1, 2)
    return ids[keep[:, 0]], ids[keep[:, 1]]


def _close(x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= distance


def _large(table: np.ndarray, probe: np.ndarray, distance: int):
    """Links of one large bucket, by growing components: a member is compared with those not yet reached.

    A probe needs comparing with table entries only, so components grow over
    the table first; memory stays linear in the bucket.
    """
    out = []
    left = np.unique(table)
    parts = []
    while len(left):
        reached, todo, left = [], [left[:1]], left[1:]
        while todo:
            front = todo.pop()
            reached.append(front)
            for x in front:
                near = _close(np.full(len(left), x), left, distance)
                if near.any():
                    out.append((np.full(int(near.sum()), x), left[near]))
                    todo.append(left[near])
                    left = left[~near]
        parts.append(np.concatenate(reached))
    probe = np.unique(probe)
    for part in parts:  # a probe is linked once to each component it touches
        got = np.zeros(len(probe), bool)
        for x in part:
            rest = np.flatnonzero(~got)
            near = rest[_close(np.full(len(rest), x), probe[rest], distance)]
            if len(near):
                out.append((np.full(len(near), x), probe[near]))
                got[near] = True
            if got.all():
                break
    return out


def _links(key: np.ndarray, fp: np.ndarray, probe: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links in rows sorted by (key, probe); whole buckets only."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    entries = np.add.reduceat((~probe).astype(np.int64), start)
    out = []
    for i in np.flatnonzero((entries > 0) & (size > SMALL)):
        s, m, n = start[i], entries[i], size[i]
        out += _large(fp[s:s + m], fp[s + m:s + n], distance)
    some = np.flatnonzero((entries > 0) & (size > 1) & (size <= SMALL))
    pairs = np.cumsum(entries[some] * size[some])
    for lo in range(0, len(some), step := max(1, BLOCK // SMALL**2 * 16)):
        part = some[lo:lo + step]
        m, n, s = entries[part], size[part], start[part]
        each = np.repeat(np.arange(len(part)), m * n)
        k = np.arange(len(each)) - np.repeat(np.cumsum(m * n) - m * n, m * n)
        x, y = s[each] + k // n[each], s[each] + k % n[each]
        ok = y > x
        a, b = fp[x[ok]], fp[y[ok]]
        ok = (a != b) & _close(a, b, distance)
        out.append((a[ok], b[ok]))
    del pairs
    if not out:
        return key[:0], key[:0]
    return _forest(np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]))


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): fingerprints whose links have the components of all links at ``distance`` or less.

    ``distinct`` holds one row a fingerprint; it is counted first.
    """
    cuts = segments(distinct.count())
    radius = distance // len(cuts)
    step = max(1, (1 << 21) // sum(comb(w, r) for _, w in cuts for r in range(radius + 1)))  # fingerprints whose keys are held at once
    entry = T.StructType([T.StructField("key", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("probe", T.BooleanType())])
    edge = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def enumerate_balls(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fps), step):
                key, fp, probe = _keys(np.ascontiguousarray(fps[i:i + step]), cuts, radius)
                yield {"key": key, "fp": fp, "probe": probe}

    def match(batches):
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table):
            cols = [t.column(i).to_numpy() for i in range(3)]
            a, b = _links(cols[0], cols[1], cols[2].astype(bool), distance)
            return {"a": a, "b": b}

        rows = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            key = b.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            if rows < 200_000 or (cut == 0 and key[0] == key[-1] and len(held) > 1 and held[-2].column(0)[-1].as_py() == key[0]):
                continue
            whole = pa.Table.from_batches([*held[:-1], b.slice(0, cut)])
            if whole.num_rows:
                yield solve(whole)
            held, rows = [b.slice(cut)], b.num_rows - cut
        if held:
            yield solve(pa.Table.from_batches(held))

    entries = arrow_map(distinct.select("fp"), enumerate_balls, entry)
    met = entries.repartition("key").sortWithinPartitions("key", "probe")
    return arrow_map(met, match, edge)


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), by alternating star contraction.

    What a join reads is stored, so that it has an exchange directly on both
    sides and Spark can split the node of a large component.
    """
    edges = stored(edges.where("a <> b").distinct(), name)
    last = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), name + "-low")
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, name + "-large")
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), name + "-down")
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = stored(small.select("e.a", "e.b").where("a <> b").distinct(), name)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def simhash_groups(docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row a document: doc_id, fingerprint in hex, component_id (its smallest id)."""
    prints = stored(fingerprints(docs, width, seed), "simhash")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct, distance))
    member = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    member = stored(member, "simhash-members")
    least = stored(member.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    named = member.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One document of each group: that with the smallest id; rows without an id stay.

    Rows that repeat the kept id are the same document, and one of them stays.
    """
    groups = simhash_groups(docs, width, distance, seed).where("doc_id = component_id")
    name = fresh(docs, "_rows")
    first = groups.groupBy("doc_id").agg(F.count("*").alias(name))
    key = docs["doc_id"]
    joined = docs.join(first.withColumnRenamed("doc_id", name + "id"), key == F.col(name + "id")).drop(name + "id")
    cols = [quoted(c) for c in docs.columns]
    once = joined.where(F.col(name) == 1).select(*cols)
    again = joined.where(F.col(name) > 1).select(*cols).dropDuplicates(["doc_id"])
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))


@query("op10_simhash")
def op10_simhash(spark, sf_dir):
    return simhash_groups(documents(spark, sf_dir))
