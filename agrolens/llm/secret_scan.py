"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

The three base patterns are matched over whole texts.  The method then looks
at long strings that follow a sensitive word: the bytes that such a string
adds to a zstandard frame primed with the code around it (less other
occurrences of the string) and the identifiers that a vocabulary's words make
of it, in the usual styles (joined, snake_case, kebab-case, paths).  The same
compressor measures random strings of the same make, each with the identifiers
that the vocabulary makes of them; a string that takes ``least`` of their bytes
or more is predicted by neither code nor words, and is reported.

Defined results: a null text is empty; empty texts have no spans; repeated
rows are scanned each for itself; other columns are ignored.  Spans are in
code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import string
import zlib
from functools import lru_cache

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import documents, fresh, query, quoted, text_udf

KINDS = ("assign", "access", "hex", "novel")
#: Identifiers and placeholders that are no secrets; the compressor is primed with them.
IDENTIFIERS = """example changeme password passwd secret token api_key apikey access_key private_key public_key client_id
client_secret username default placeholder undefined null none true false localhost config settings environment
getenv process.env request response session cookie authorization bearer credentials certificate configuration
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000 xxxxxxxxxxxxxxxx
your_token_here your-api-key-here insert_key_here application/json https://www.example.com/index.html"""
#: What the dictionary holds in front of a measured string, so that a frame has a match already and each further one counts.
LEAD = b"The quick brown fox jumps over the lazy dog; 0123456789 ABCDEF\n"
#: Letters of a dictionary word: shorter than four only where it is a whole part, as random strings hold any three letters.
WORD = (4, 16)
#: Random strings that a candidate is held against.
DRAWS = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CONTEXT = ("password", "passwd", "secret", "token", "key", "auth", "credential", "bearer", "private")
_NEAR = re.compile(r"(?:" + "|".join(_CONTEXT) + r")[A-Za-z_-]{0,12}[^A-Za-z0-9\n]{1,8}([A-Za-z0-9+/_=-]{16,})", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches.

    ``{16,}`` and ``{24,}`` find what the open runs with a length test find: a
    run starts at its first character, and a shorter run has no longer part.
    """
    low = text.lower()
    found = []
    if any(k in low for k in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@lru_cache(4)
def vocabulary(path: str | None = None) -> frozenset[str]:
    """The whole words of a tokenizer's vocabulary with word ends; its size bounds the dictionary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        ends = [w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")]
    return frozenset(w for w in ends if w.isascii() and w.isalpha() and len(w) >= 3)


def known_words(candidate: str, words: frozenset[str]) -> list[str]:
    """Dictionary words of the candidate's camelCase and separated parts, the longest first from the left."""
    found = []
    for m in _PART.finditer(candidate):
        part, at = m[0].lower(), 0
        if len(part) < WORD[0] and part in words:
            found.append(part)
        while at + WORD[0] <= len(part):
            n = next((n for n in range(min(WORD[1], len(part) - at), WORD[0] - 1, -1) if part[at:at + n] in words), 0)
            if n:
                found.append(part[at:at + n])
            at += n or 1
    return found


def marginal_bytes(candidate: str, around: str, words: frozenset[str] | None = None, identifiers: str = IDENTIFIERS) -> int:
    """Bytes that ``candidate`` adds to a frame primed with its surroundings and its dictionary words' identifiers; case is folded."""
    known = known_words(candidate, vocabulary() if words is None else words)
    styles = "\n".join(mark.join(known) for mark in ("", " ", "_", "-", "/", "."))
    primer = "\n".join([identifiers, around, styles]).lower().encode("utf-8", "replace") + b"\n" + LEAD
    primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(press.compress(LEAD + candidate.lower().encode("utf-8", "replace"))) - len(press.compress(LEAD))


def draw(candidate: str, rnd: random.Random) -> str:
    """A random string with the candidate's kinds of characters in their places."""
    low = "abcdef" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", candidate) else string.ascii_lowercase
    kinds = {**dict.fromkeys(string.ascii_lowercase, low), **dict.fromkeys(string.ascii_uppercase, low.upper()), **dict.fromkeys(string.digits, string.digits)}
    return "".join(rnd.choice(kinds.get(c, "+/_=-")) for c in candidate)


def novelty(candidate: str, around: str, words: frozenset[str] | None = None, identifiers: str = IDENTIFIERS) -> float:
    """Marginal bytes of ``candidate`` against those of random strings of its make, which its own text draws."""
    rnd = random.Random(zlib.crc32(candidate.encode("utf-8", "replace")))
    usual = sum(marginal_bytes(draw(candidate, rnd), around, words, identifiers) for _ in range(DRAWS)) / DRAWS
    return marginal_bytes(candidate, around, words, identifiers) / usual


def novel_spans(text: str, words: frozenset[str] | None = None, around: int = 2048, least: float = 0.75) -> list[tuple[int, int, int]]:
    """Strings after a sensitive word that take ``least`` of a random string's bytes or more."""
    low = text.lower()
    if not any(k in low for k in _CONTEXT):
        return []
    found = []
    for m in _NEAR.finditer(text):
        s, e = m.span(1)
        word = m[1]
        # Its copies say nothing about it; wider by a copy, so that none is cut at the edge.
        core = max(word.strip("+/_=-"), word[:8], key=len)  # a key's padding may be left out elsewhere
        before = text[max(0, s - around - len(word)):s].replace(core, "\n")[-around:]
        after = text[e:e + around + len(word)].replace(core, "\n")[:around]
        if novelty(word, before + "\n" + after, words) >= least:
            found.append((s, 3, e))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(text: str | None, words: frozenset[str] | None = None) -> tuple:
    """n_assign, n_access, n_hex, base_sha256, spans, n_novel of one text."""
    text = text or ""
    base = base_spans(text)
    novel = novel_spans(text, words)
    n = [sum(k == i for _, k, _ in base) for i in range(3)]
    return (*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + novel)), len(novel))


SCHEMA = T.StructType([
    *(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_novel", T.LongType()),
])


def secret_scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row a document with counts, the digest of the base spans and all spans.

    ``path`` names the vocabulary; the driver reads it and tasks are sent its words.
    """
    words = vocabulary(path)
    return docs.select("doc_id", text_udf(lambda t: scan(t, words), SCHEMA)(F.col("text")).alias("s")).select("doc_id", "s.*")


def mask(text: str | None, words: frozenset[str] | None = None, mark: str = "<secret>") -> str | None:
    """The text with each reported span (overlapping ones as one) replaced by ``mark``."""
    if not text:
        return text
    out, at = [], 0
    for s, _, e in sorted(base_spans(text) + novel_spans(text, words)):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with secrets masked in ``text``; ``n_chars`` follows where the table has it."""
    words = vocabulary(path)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([mask(t, words) for t in texts], dtype=object)

    name = fresh(docs, "_masked")
    masked = docs.withColumn(name, run(F.col("text")))
    new = {"text": quoted(name), "n_chars": F.length(quoted(name)).cast("long")}
    return masked.select(*[new[c].alias(c) if c in new else quoted(c) for c in docs.columns])


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    return secret_scan(documents(spark, sf_dir))
