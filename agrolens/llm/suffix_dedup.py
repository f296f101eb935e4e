"""Exact substring dedup by a distributed merge sort of front-coded suffix runs.

Every string of ``length`` bytes that starts twice or more, in any documents,
is removed at all its places.  Not every suffix need be sorted for that.
Each start ``p`` has an anchor, the least ``GRAM`` bytes (by a hash; leftmost
of equals) in its string, so equal strings have their anchors at the same
offset.  An anchor and the neighbouring starts that share it span a context,
about one in 200 bytes.

* Anchors whose gram no other anchor has go at once (counts by hash).
* Equal contexts collapse to one that stands for them; their starts are all
  repeated.  Both are combinable aggregates, so a group of copies of any
  size is one row a task.  On the way back to the starts, the contexts with
  most copies are broadcast; any other one has a small share of the starts.
* What is left are different contexts around an equal gram.  Each task sorts
  its suffixes (the bytes from the anchor on) and front-codes them; the runs
  are exchanged by ranges of their first bytes (first bytes that alone fill a
  range are cut again, by gram); each range is merged by a loser tree that
  keeps common prefix lengths and compares only beyond them.
  Neighbours' common prefixes then bound which starts can be repeated, and
  those few are compared over their whole strings.
* A gram with more than ``hot`` different contexts would make one range too
  large.  Its starts are counted by their strings' digests instead, which is
  exact as well and combines before the exchange.

Texts travel as compressed chunks; a row's place is its chunk and number, so
rows need no unique id.  Defined results: null texts are empty, texts shorter
than ``length`` lose nothing; repeated rows are different places, so both go;
matches never cross documents; other columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import arrow_map, documents, query, slices, stored

GRAM = 32
#: Text bytes of a chunk, and of a merged range.
CHUNK = 16 << 20
RANGE = 16 << 20
#: Copies from which on a context may be broadcast, and the most contexts that are.
MANY = 1000
HOTTEST = 1 << 16
#: Starts whose anchors are found at once; positions then fit the low bits of a key.
STRETCH = 1 << 23
_LOW = 24
_DOCS = 20  # bits of a row's number in its chunk
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place."""
    n = len(data)
    word = np.empty(n - 7, np.uint64)
    for o in range(8):
        part = word[o::8]
        part[:] = np.frombuffer(data, "<u8", len(part), o)
    word *= _MIX
    word ^= word >> np.uint64(29)
    h = word[:n - GRAM + 1].copy()
    for k in range(8, GRAM, 8):
        h *= _MIX
        h ^= h >> np.uint64(32)
        h += word[k:k + len(h)]
    h *= _MIX
    return h ^ (h >> np.uint64(31))


def anchors(data: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first start, last start, gram hash) of a text, in stretches."""
    for s in range(0, len(data) - length + 1, STRETCH):
        part = data[s:s + STRETCH + length - 1]
        h, width = gram_hashes(part), length - GRAM + 1
        key = (h >> np.uint64(_LOW) << np.uint64(_LOW)) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(key) // width) * width
        key = np.concatenate([key, np.full(blocks - len(key), ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(key, axis=1).ravel()
        behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = len(part) - length + 1
        at = (np.minimum(behind[:starts], ahead[width - 1:width - 1 + starts]) & np.uint64((1 << _LOW) - 1)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], starts] - 1
        yield at[first] + s, first + s, last + s, h[at[first]].view(np.int64)


def packed(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first << 20 | (last - first) << 10 | (anchor - first)


def unpacked(pos: int) -> tuple[int, int, int]:
    """(anchor, first start, last start); a context has fewer than 1024 starts."""
    first = pos >> 20
    return first + (pos & 1023), first, first + (pos >> 10 & 1023)


def _chunked(docs: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds: compressed chunks (gram null), and anchors."""
    ids = T.ArrayType(docs.schema["doc_id"].dataType)
    fields = [("chunk", T.LongType()), ("doc_ids", ids), ("sizes", T.BinaryType()), ("blob", T.BinaryType()),
              ("gram", T.LongType()), ("context", T.LongType()), ("place", T.LongType()), ("pos", T.LongType()), ("head", T.LongType())]
    names = [f for f, _ in fields]

    def run(batches) -> Iterator[dict]:
        part, seq, size = TaskContext.get().partitionId(), 0, 0
        held_ids, held = [], []

        def close() -> dict:
            blob = zstandard.compress(b"".join(held), 6)
            row = (part << 20 | seq, held_ids, np.array([len(x) for x in held], np.int64).tobytes(), blob, None, None, None, None, None)
            return dict(zip(names, ([x] for x in row)))

        for b in slices(batches):
            out: list[list] = [[], [], [], [], []]
            chunks = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = (t or "").encode("utf-8", "surrogatepass")
                place = (part << 20 | seq) << _DOCS | len(held)
                for a, lo, hi, g in anchors(data, length):
                    digest = xxhash.xxh3_64_digest
                    context = b"".join([digest(data[x:y]) for x, y in zip(lo.tolist(), (hi + length).tolist())])
                    head = b"".join([data[x:x + 8] for x in a.tolist()])
                    out[0].append(g)
                    out[1].append(np.frombuffer(context, ">i8").astype(np.int64))
                    out[2].append(np.full(len(a), place))
                    out[3].append(packed(a, lo, hi))
                    out[4].append((np.frombuffer(head, ">u8") >> np.uint64(11)).astype(np.int64))
                held_ids.append(d)
                held.append(data)
                size += len(data)
                if size >= CHUNK or len(held) >> _DOCS:
                    chunks.append(close())
                    seq, size, held_ids, held = seq + 1, 0, [], []
            yield from chunks
            if out[0]:
                cols = [np.concatenate(c) for c in out]
                none = [None] * len(cols[0])
                yield dict(zip(names, [none, none, none, none, *cols]))
        if held:
            yield close()

    return arrow_map(docs.select("doc_id", "text"), run, T.StructType([T.StructField(a, b) for a, b in fields]))


def front_coded(strings: list[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """(common prefix with the string before, the rests' bytes, their sizes) of sorted strings."""
    shared, rests, before = [], [], b""
    for s in strings:
        n = prefix(before, s, 0)
        shared.append(n)
        rests.append(s[n:])
        before = s
    return np.array(shared, np.int32), b"".join(rests), np.array([len(r) for r in rests], np.int32)


def decoded(shared: list[int], rests: bytes, sizes: list[int]) -> list[bytes]:
    out, before, at = [], b"", 0
    for n, size in zip(shared, sizes):
        before = before[:n] + rests[at:at + size]
        out.append(before)
        at += size
    return out


def prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of ``a`` and ``b``, of which ``known`` bytes are not compared."""
    n = min(len(a), len(b))
    if n <= known:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the string before) of all strings of sorted runs, in order.

    A loser tree.  Each run's head keeps its common prefix with the string
    that beat it last, so two heads are compared by these numbers, and by
    bytes only beyond them where they are equal.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [[]] * (k - len(runs))
    known = [0 if s else -1 for s in strings]  # -1: the run is at its end
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); sets the loser's common prefix with the winner."""
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        if known[a] < 0:
            return a, b
        x, y = strings[a][at[a]], strings[b][at[b]]
        n = prefix(x, y, known[a])
        if x[n:n + 1] < y[n:n + 1] or len(x) == len(y) == n and a < b:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1)
    while known[top] >= 0:
        yield top, at[top], known[top]
        at[top] += 1
        known[top] = shared[top][at[top]] if at[top] < len(strings[top]) else -1
        node = (top + k) // 2
        while node:
            top, loser[node] = play(top, loser[node])
            node //= 2


def repeated_starts(left: list[bytes], right: list[bytes], span: list[int], shared: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For sorted contexts around one gram, the runs (first, end) of repeated starts, from each context's first.

    A start whose string reaches further right than the context's common
    prefix with either neighbour has no equal.
    """
    seen: Counter[bytes] = Counter()
    digests = []
    for i, (x, y, n) in enumerate(zip(left, right, span)):
        reach = max(shared[i] if i else 0, shared[i + 1] if i + 1 < len(shared) else 0)
        whole = x + y
        mine = [xxhash.xxh3_128_digest(whole[t:t + length]) for t in range(min(n, len(x) - length + reach + 1))]
        seen.update(mine)
        digests.append(mine)
    out = []
    for mine in digests:
        hits = np.flatnonzero([seen[d] > 1 for d in mine])
        cut = np.flatnonzero(np.diff(hits) > 1)
        out.append(list(zip(hits[np.r_[0, cut + 1]].tolist(), (hits[np.r_[cut, -1]] + 1).tolist())) if len(hits) else [])
    return out


class _Texts:
    """A chunk's texts, taken apart."""

    def __init__(self, sizes: bytes, blob: bytes):
        self.data = zstandard.decompress(blob)
        self.ends = np.cumsum(np.frombuffer(sizes, np.int64))
        self.starts = self.ends - np.frombuffer(sizes, np.int64)

    def text(self, place: int) -> bytes:
        i = place & ((1 << _DOCS) - 1)
        return self.data[self.starts[i]:self.ends[i]]


def _with_texts(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Each chunk's row, and after it the rows of its places; all together in one partition."""
    chunk = F.shiftright("place", _DOCS).alias("chunk")
    both = chunks.select("chunk", "doc_ids", "sizes", "blob").unionByName(rows.select(chunk, "*"), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions(F.col("chunk"), F.col("blob").isNull(), *[F.col(c) for c in rows.columns[:2]])


def _by_chunk(batches) -> Iterator[tuple[int, list, _Texts, list[list]]]:
    """(chunk, ids, texts, columns of its rows) of what ``_with_texts`` lays out; columns come after the first four."""
    chunk, ids, texts, rows = None, None, None, []

    def done():
        return chunk, ids, texts, [sum((r[i] for r in rows), []) for i in range(len(rows[0]))] if rows else []

    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(0).to_numpy()
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for s, e in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows]):
            part = b.slice(s, e - s)
            if key[s] != chunk:
                if texts is not None:
                    yield done()
                chunk, rows = int(key[s]), []
                first = part.slice(0, 1).to_pylist()[0]
                ids, texts = first["doc_ids"], _Texts(first["sizes"], first["blob"])
                part = part.slice(1)
            if part.num_rows:
                rows.append([c.to_pylist() for c in part.columns[4:]])
    if texts is not None:
        yield done()


def copied(shared: DataFrame, contexts: DataFrame) -> DataFrame:
    """The rows of ``shared`` whose context occurs twice or more, by the contexts' counts ``n``.

    The ``HOTTEST`` contexts with most copies never meet in one task. Of N rows, one that
    is left has N / HOTTEST at most, or MANY.
    """
    key = ["gram", "context"]
    hottest = F.broadcast(stored(contexts.where(F.col("n") > MANY).orderBy(F.desc("n")).limit(HOTTEST).select(key), "suffix-hottest"))
    others = shared.join(hottest, key, "left_anti").join(contexts.where("n > 1").select(key), key)
    return shared.join(hottest, key, "left_semi").unionByName(others)


def _ranges(reps: DataFrame, length: int) -> tuple[np.ndarray, dict[int, tuple[int, int]], int]:
    """Cuts between heads; (first range, number of ranges) of each head that alone fills one; number of all ranges."""
    most = max(1, RANGE * 2 // (length * 3))
    n = max(1, -(-reps.count() // most))
    cuts = np.array(sorted(reps.approxQuantile("head", [i / n for i in range(1, n)], 0.1 / n)) if n > 1 else [], np.float64)
    heavy = {}
    if n > 1:
        for r in reps.groupBy("head").agg(F.count("*").alias("m")).where(F.col("m") > most).orderBy("head").collect():  # fewer than n
            heavy[r.head] = n, -(-r.m // most)
            n += heavy[r.head][1]
    return cuts, heavy, n


def repeated_bytes(chunks: DataFrame, found: DataFrame, length: int, hot: int) -> DataFrame:
    """(place, start, end): stretches whose bytes all lie in repeated strings."""
    # Aggregates are stored before a join, so that both sides come straight from an exchange and Spark can split a hot key.
    grams = stored(found.groupBy("gram").count().where("count > 1").select("gram"), "suffix-grams")
    shared = stored(found.join(grams, "gram"), "suffix-shared")
    contexts = shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("place", "pos", "head")).alias("rep"))
    contexts = stored(contexts, "suffix-contexts")
    copies = copied(shared, contexts)
    first = F.shiftright("pos", 20)
    whole = copies.select("place", first.alias("start"), (first + F.shiftright("pos", 10).bitwiseAND(F.lit(1023)) + length).alias("end"))
    several = stored(contexts.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "suffix-several")
    reps = contexts.join(several, "gram").select("rep.place", "rep.pos", "rep.head", (F.col("n") > 1).alias("many"), (F.col("m") > hot).alias("hot"))
    reps = stored(reps, "suffix-reps")
    cuts, heavy, ranges = _ranges(reps.where("NOT hot"), length)

    run = T.StructType([T.StructField("range", T.IntegerType()), *(T.StructField(n, T.BinaryType()) for n in ("shared", "rests", "sizes", "lefts", "left_sizes", "places", "poses", "manys")),
                        T.StructField("digest", T.BinaryType()), T.StructField("place", T.LongType()), T.StructField("start", T.LongType())])
    names = run.fieldNames()

    def sort_runs(batches) -> Iterator[dict]:
        for _, _, texts, cols in _by_chunk(batches):
            sorted_: dict[int, list] = {}
            hot_rows: list[list] = [[], [], []]
            for place, pos, head, many, is_hot in zip(*cols):
                a, lo, hi = unpacked(pos)
                data = texts.text(place)
                if is_hot:
                    hot_rows[0] += [xxhash.xxh3_128_digest(data[p:p + length]) for p in range(lo, hi + 1)]
                    hot_rows[1] += [place] * (hi + 1 - lo)
                    hot_rows[2] += range(lo, hi + 1)
                else:
                    if head in heavy:  # equal grams have to meet, others need not
                        r, k = heavy[head]
                        r += xxhash.xxh3_64_intdigest(data[a:a + GRAM]) % k
                    else:
                        r = int(np.searchsorted(cuts, float(head), side="right"))
                    sorted_.setdefault(r, []).append((data[a:hi + length], data[lo:a], place, pos, many))
            for r, rows in sorted_.items():
                rows.sort(key=lambda x: x[0])
                n, rests, sizes = front_coded([x[0] for x in rows])
                lefts = [x[1] for x in rows]
                one = (r, n.tobytes(), zstandard.compress(rests, 3), sizes.tobytes(), zstandard.compress(b"".join(lefts), 3), np.array([len(x) for x in lefts], np.int32).tobytes(),
                       np.array([x[2] for x in rows], np.int64).tobytes(), np.array([x[3] for x in rows], np.int64).tobytes(), np.array([x[4] for x in rows], np.uint8).tobytes(), None, None, None)
                yield dict(zip(names, ([x] for x in one)))
            for i in range(0, len(hot_rows[0]), 100_000):
                part = [c[i:i + 100_000] for c in hot_rows]
                none = [None] * len(part[0])
                yield dict(zip(names, [none] * 9 + part))

    place = T.StructType([T.StructField(n, T.LongType()) for n in ("place", "start", "end")])

    def merge_ranges(batches) -> Iterator[dict]:
        now, held = None, []

        def solve() -> dict:
            runs, sides = [], []
            for r in held:
                n = np.frombuffer(r["shared"], np.int32).tolist()
                runs.append((decoded(n, zstandard.decompress(r["rests"]), np.frombuffer(r["sizes"], np.int32).tolist()), n))
                ends = np.cumsum(np.frombuffer(r["left_sizes"], np.int32)).tolist()
                sides.append((zstandard.decompress(r["lefts"]), [0, *ends], np.frombuffer(r["places"], np.int64).tolist(), np.frombuffer(r["poses"], np.int64).tolist(), r["manys"]))
            out: list[tuple[int, int, int]] = []
            group: list[tuple[int, int, int]] = []

            def close():
                if len(group) > 1:
                    lefts = [sides[r][0][sides[r][1][i]:sides[r][1][i + 1]] for r, i, _ in group]
                    poses = [unpacked(sides[r][3][i]) for r, i, _ in group]
                    hits = repeated_starts(lefts, [runs[r][0][i] for r, i, _ in group], [hi - lo + 1 for _, lo, hi in poses], [n for *_, n in group], length)
                    for (r, i, _), (_, lo, _), found_ in zip(group, poses, hits):
                        if not sides[r][4][i]:  # a context that stands for several is repeated as a whole already
                            out.extend((sides[r][2][i], lo + s, lo + e - 1 + length) for s, e in found_)

            for r, i, n in merged(runs):
                if n < GRAM:
                    close()
                    group = []
                group.append((r, i, n))
            close()
            return dict(zip(("place", "start", "end"), zip(*out) if out else ((), (), ())))

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if held and r["range"] != now:
                    yield solve()
                    held = []
                now = r["range"]
                held.append(r)
        if held:
            yield solve()

    laid = stored(arrow_map(_with_texts(chunks, reps), sort_runs, run), "suffix-runs")
    runs = laid.where("range IS NOT NULL").select(*names[:9])
    ordered = runs.repartitionById(ranges, F.col("range")).sortWithinPartitions("range")
    around = arrow_map(ordered, merge_ranges, place)
    starts = laid.where("digest IS NOT NULL").select("digest", "place", "start")
    twice = stored(starts.groupBy("digest").count().where("count > 1").select("digest"), "suffix-twice")
    hot_ones = starts.join(twice, "digest").select("place", "start", (F.col("start") + length).alias("end"))
    return whole.unionByName(around).unionByName(hot_ones)


def suffix_dedup(docs: DataFrame, length: int = 400, hot: int = 20_000) -> DataFrame:
    """Per document: doc_id, n_bytes, spans removed (bytes, end exclusive) and the bytes that stay."""
    laid = stored(_chunked(docs, length), "suffix-chunks")
    chunks = laid.where("blob IS NOT NULL").select("chunk", "doc_ids", "sizes", "blob")
    gone = repeated_bytes(chunks, laid.where("gram IS NOT NULL").select("gram", "context", "place", "pos", "head"), length, hot)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept", T.BinaryType())])

    def cut(batches) -> Iterator[dict]:
        for _, ids, texts, cols in _by_chunk(batches):
            spans: dict[int, list] = {}
            for place, start, end in zip(*cols):
                mine = spans.setdefault(place & ((1 << _DOCS) - 1), [])
                if mine and start <= mine[-1]["end"]:
                    mine[-1]["end"] = max(mine[-1]["end"], end)
                else:
                    mine.append({"start": start, "end": end})
            for i in range(0, len(ids), 1000):
                rows = [(d, texts.text(k), spans.get(k, [])) for k, d in enumerate(ids[i:i + 1000], i)]
                kept = [b"".join(t[s:e] for s, e in zip([0, *(x["end"] for x in gone_)], [*(x["start"] for x in gone_), len(t)])) for _, t, gone_ in rows]
                yield {"doc_id": [r[0] for r in rows], "n_bytes": [len(r[1]) for r in rows], "spans": [r[2] for r in rows], "kept": kept}

    return arrow_map(_with_texts(chunks, gone), cut, schema)


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    out = suffix_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
