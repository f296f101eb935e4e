"""Byte-level BPE encoding and decoding by tree concatenation.

Texts up to a leaf's size are encoded whole.  A longer text is halved until
its pieces fit; the pieces spread over all tasks and are encoded there, and
the halves' token lists are joined bottom-up.  Around a join a window is
encoded anew, and it grows until both sides agree exactly:

* a cut that no pre-token can span (``safe``) holds in any context, so
  left of it the left half's tokens stand, and right of it the right half's;
* inside one run of letters, digits, marks or spaces there is no such cut:
  there the window must share a whole token with the half.  Neighbouring
  tokens of an encoding stay unmerged in whatever run they occur, so a list in
  which every two neighbours come from some encoding is the encoding.

A window that reaches both ends of the text needs no agreement, so the search
ends.  Decoding looks up each id's bytes.

Defined results: a null text is empty, and an empty text has no tokens;
repeated rows are each encoded; a null id stays null; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import arrow_map, documents, query, slices

#: Byte-level split into words, marks and spaces: a fixed value of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for c, b in [*zip(plain, plain), *((256 + i, b) for i, b in enumerate(rest))]}


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes to id, and special strings to id, of a byte-level BPE JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    order = [spec["model"]["vocab"][a + b] for a, b in merged]
    if order != sorted(order):
        raise ValueError(f"{path}: ids do not follow the merges")
    return ranks, special


def default_path() -> str:
    return os.environ.get("BPE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json")


class Codec:
    """Encoder of one task; ``grow`` is the first window's reach in bytes."""

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], grow: int = 64):
        self.special, self.grow = special, grow
        self.marks = [s.encode() for s in special]
        self.core = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.allowed = set(special)
        size = max([*ranks.values(), *special.values()]) + 1
        self.table = [b""] * size
        for t, i in [*ranks.items(), *((s.encode(), i) for s, i in special.items())]:
            self.table[i] = t
        self.length = np.array([len(t) for t in self.table], np.int64)

    def encode(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def join(self, data: bytes, left: tuple, right: tuple) -> tuple:
        """The node (lo, hi, ids) over two adjacent nodes of ``data``."""
        (lo, j, a), (_, hi, b) = left, right
        if not len(a) or not len(b):
            return lo, hi, a if len(a) else b
        ea, eb = lo + np.cumsum(self.length[a]), j + np.cumsum(self.length[b])
        sa, sb = ea - self.length[a], eb - self.length[b]
        reach = self.grow
        for m in self.marks:  # a special string across the join: look past all of it, where its kinds are mixed
            if data.find(m, max(lo, j - len(m) + 1), min(hi, j + len(m) - 1)) >= 0:
                reach = max(reach, 2 * len(m))
        while True:
            whole_l, whole_r = reach >= j - lo, reach >= hi - j
            p, exact_p, stop = (lo, True, j) if whole_l else self._before(data, lo, j, reach, sa)
            q, exact_q = (hi, True) if whole_r else self._after(data, j, hi, reach, eb)
            if p is not None and q is not None:
                w = self.encode(data[p:q].decode())
                ew = p + np.cumsum(self.length[w])
                sw = ew - self.length[w]
                # Tokens of the left half that stand, and the window's from there on.
                if exact_p:
                    na, fw, ok_l = int(np.searchsorted(sa, p)), 0, True
                    ok_l = na == len(sa) or sa[na] == p
                else:
                    at = _common(sa, ea, sw, ew, p, stop)
                    ok_l = len(at) > 0
                    if ok_l:
                        na, fw = int(np.searchsorted(sa, at[0])), int(np.searchsorted(sw, at[0]))
                if exact_q:
                    nb, lw = int(np.searchsorted(sb, q)), len(w)
                    ok_r = nb == len(sb) or sb[nb] == q
                else:
                    at = _common(sb, eb, sw, ew, j, q)
                    ok_r = len(at) > 0
                    if ok_r:
                        nb, lw = int(np.searchsorted(sb, at[-1])), int(np.searchsorted(sw, at[-1]))
                if ok_l and ok_r and fw <= lw:
                    return lo, hi, np.concatenate([a[:na], w[fw:lw], b[nb:]])
            if whole_l and whole_r:
                return lo, hi, self.encode(data[lo:hi].decode())
            reach *= 2

    def _before(self, data: bytes, lo: int, j: int, reach: int, starts: np.ndarray):
        """Where a window may begin: (position, whether it holds in any context, end of the shared tokens).

        The last space before a word is a pre-token of its own, so tokens shared inside a run of spaces must end before it.
        """
        at = _aligned(data, max(lo, j - reach), -1)
        kinds, places = _kinds(data[at:j].decode(), at)
        for i in range(len(kinds) - 1, 0, -1):
            if self._safe(data, kinds, places, i):
                return places[i], True, j
        if len(set(kinds)) == 1 and kinds[0] != "?":
            k = int(np.searchsorted(starts, at))
            while k < len(starts) and _aligned(data, int(starts[k]), -1) != starts[k]:
                k += 1
            if k < len(starts) and starts[k] < j:
                return int(starts[k]), False, places[-1] if kinds[0] == " " else j
        return None, False, j

    def _after(self, data: bytes, j: int, hi: int, reach: int, ends: np.ndarray):
        at = _aligned(data, min(hi, j + reach), 1)
        kinds, places = _kinds(data[j:at].decode(), j)
        for i in range(1, len(kinds)):
            if self._safe(data, kinds, places, i):
                return places[i], True
        if len(set(kinds)) == 1 and kinds[0] != "?":
            # A window must end before the run of spaces may end, for the same reason.
            k = int(np.searchsorted(ends, places[-1] if kinds[0] == " " else at, side="right")) - 1
            while k >= 0 and ends[k] < hi and _aligned(data, int(ends[k]), -1) != ends[k]:
                k -= 1
            if k >= 0 and ends[k] > j:
                return int(ends[k]), False
        return None, False

    def _safe(self, data: bytes, kinds: list[str], places: list[int], i: int) -> bool:
        """Whether no pre-token of any text with these characters spans the cut before character ``i``."""
        a, b, p = kinds[i - 1], kinds[i], places[i]
        if a == b or a in " ?" or b == "?":
            return False
        if b == "L" and data[p - 1:p] == b"'":
            return False  # may be a contraction
        return not any(data.find(m, max(0, p - len(m) + 1), p + len(m) - 1) >= 0 for m in self.marks)


def _common(s1, e1, s2, e2, lo: int, hi: int) -> np.ndarray:
    """Starts of the tokens that both lists have within [lo, hi]."""
    one, two = (s1 >= lo) & (e1 <= hi), (s2 >= lo) & (e2 <= hi)
    starts, i, j = np.intersect1d(s1[one], s2[two], assume_unique=True, return_indices=True)
    return starts[e1[one][i] == e2[two][j]]


def _aligned(data: bytes, p: int, step: int) -> int:
    """``p`` moved to a character's first byte."""
    while 0 < p < len(data) and data[p] & 0xC0 == 0x80:
        p += step
    return p


def _kinds(text: str, at: int) -> tuple[list[str], list[int]]:
    """Character kinds (L, N, space, O; ``?`` where Unicode versions or engines might differ) and byte places."""
    kinds, places = [], []
    for c in text:
        kind = unicodedata.category(c)
        space = c.isspace()
        if kind == "Cn" or space != bool(regex.match(r"\p{White_Space}", c)):
            kinds.append("?")
        else:
            kinds.append(" " if space else kind[0] if kind[0] in "LN" else "O")
        places.append(at)
        at += len(c.encode())
    return kinds, places


def halves(lo: int, hi: int, leaf: int, data: bytes) -> list[int]:
    """Starts of the leaves of [lo, hi), halved until each has at most ``leaf`` bytes (or one character)."""
    mid = _aligned(data, (lo + hi) // 2, 1)
    if hi - lo <= leaf or not lo < mid < hi:
        return [lo]
    return halves(lo, mid, leaf, data) + halves(mid, hi, leaf, data)


def join_leaves(codec: Codec, data: bytes, starts: list[int], leaves: list[np.ndarray]) -> np.ndarray:
    """Tokens of ``data`` from its leaves' tokens, by the tree that ``halves`` made."""
    ends = [*starts[1:], len(data)]
    at = dict(zip(starts, range(len(starts))))

    def node(lo: int, hi: int):
        i = at[lo]
        if ends[i] == hi:
            return lo, hi, leaves[i]
        mid = _aligned(data, (lo + hi) // 2, 1)
        return codec.join(data, node(lo, mid), node(mid, hi))

    return node(0, len(data))[2] if data else np.empty(0, np.uint32)


def _run(docs: DataFrame, finish: Callable[[Codec, np.ndarray], tuple], fields: list[T.StructField], path: str, leaf: int, grow: int) -> DataFrame:
    ranks, special = vocabulary(path)
    packed = base64.b64encode(json.dumps([[base64.b64encode(t).decode(), i] for t, i in ranks.items()]).encode())

    def codec() -> Codec:
        return Codec({base64.b64decode(t): i for t, i in json.loads(base64.b64decode(packed))}, special, grow)

    ids = docs.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", ids), *fields])
    names = [f.name for f in fields]
    # Leaves are keyed by what they are cut from: a task that runs again makes the same rows.
    piece = T.StructType([T.StructField("doc_id", ids), T.StructField("key", T.BinaryType()), T.StructField("at", T.LongType()), T.StructField("piece", T.BinaryType())])
    coded = T.StructType([*piece.fields, T.StructField("copies", T.LongType()), T.StructField("ids", T.BinaryType())])
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    rows = docs.select("doc_id", "text")

    def short(batches) -> Iterator[dict]:
        c = codec()
        for b in slices(batches):
            got = [finish(c, c.encode(t or "")) for t in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), **dict(zip(names, zip(*got)))}

    def cut(batches) -> Iterator[dict]:
        for b in slices(batches):
            for i, (d, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                data = t.encode()
                starts = halves(0, len(data), leaf, data)
                n = len(starts)
                key = xxhash.xxh3_128_digest(repr(d).encode() + b"\0" + data)
                yield {"doc_id": [d] * n, "key": [key] * n, "at": starts, "piece": [data[s:e] for s, e in zip(starts, [*starts[1:], None])]}

    def encode(batches) -> Iterator[dict]:
        c = codec()
        for b in slices(batches):
            got = [c.encode(x.decode()).astype("<u4").tobytes() for x in b.column(3).to_pylist()]
            yield {**{n: b.column(i) for i, n in enumerate(("doc_id", "key", "at", "piece", "copies"))}, "ids": got}

    def assemble(batches) -> Iterator[dict]:
        c, held = codec(), []

        def done() -> Iterator[dict]:
            tokens = join_leaves(c, b"".join(x[3] for x in held), [x[2] for x in held], [np.frombuffer(x[5], "<u4") for x in held])
            got = finish(c, tokens)
            for i in range(0, held[0][4], 1024):
                n = min(1024, held[0][4] - i)
                yield {"doc_id": [held[0][0]] * n, **{name: [v] * n for name, v in zip(names, got)}}

        for b in slices(batches):
            for x in zip(*(col.to_pylist() for col in b.columns)):
                if held and x[1] != held[0][1]:
                    yield from done()
                    held = []
                held.append(x)
        if held:
            yield from done()

    whole = arrow_map(rows.where(size <= leaf), short, out)
    leaves = arrow_map(rows.where(size > leaf), cut, piece)
    # Equal rows are counted, by a combinable aggregate, and encoded once.
    once = leaves.groupBy("key", "at").agg(F.first("doc_id").alias("doc_id"), F.first("piece").alias("piece"), F.count("*").alias("copies"))
    encoded = arrow_map(once.select("doc_id", "key", "at", "piece", "copies"), encode, coded)
    return whole.unionByName(arrow_map(encoded.repartition("key").sortWithinPartitions("key", "at"), assemble, out))


def bpe_encode(docs: DataFrame, path: str | None = None, leaf: int = 1 << 15, grow: int = 64) -> DataFrame:
    """(doc_id, ids): the token ids of each text, as little-endian unsigned 32-bit integers."""
    return _run(docs, lambda c, ids: (ids.astype("<u4").tobytes(),), [T.StructField("ids", T.BinaryType())], path or default_path(), leaf, grow)


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    ranks, special = vocabulary(path or default_path())
    table = {i: t for t, i in ranks.items()} | {i: s.encode() for s, i in special.items()}
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in slices(batches):
            texts = [None if x is None else b"".join(map(table.__getitem__, np.frombuffer(x, "<u4").tolist())).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield {"doc_id": b.column(0), "text": texts}

    return arrow_map(encoded.select("doc_id", "ids"), run, schema)


def round_trip(docs: DataFrame, path: str | None = None, leaf: int = 1 << 15, grow: int = 64) -> DataFrame:
    """Per document: token count, digest of the ids, digest of the text decoded from them."""
    def finish(c: Codec, ids: np.ndarray) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _run(docs, finish, fields, path or default_path(), leaf, grow)


@query("op7_bpe")
def op7_bpe(spark, sf_dir):
    import public_tokenizers

    return round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
