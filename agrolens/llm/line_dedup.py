"""Substring dedup by line hashing.

A unit is a line (or a paragraph: a run of lines between blank ones).  Units
are normalised (lower case, white space collapsed), digested and grouped over
all documents; the earliest occurrence, by document id and then place, stays
and every later one goes.  Original offsets of what goes are kept.  A caller may leave
units of fewer than ``least_words`` words alone; the query takes every line.

The aggregate of a digest is its earliest rank, which combines map-side, so a
line that a third of all documents share is one row a task there; the join
back to the occurrences is one that Spark splits where it is skewed.

Defined results: null and empty texts have no units and stay as they are;
units without a word are never removed; a null id ranks last; rows equal in
id and text are one document listed twice and get the same result, rows equal
in id only rank by a hash of their text; other columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm.common import arrow_map, documents, query, slices, stored

_SPACE = re.compile(r"[ \t-\r]+")
_BLANK = re.compile(r"\n(?:[ \t\r\x0b\x0c]*\n)+")
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def units(text: str, kind: str = "line") -> list[tuple[str, int, int]]:
    """(normalised unit, start, end) of a text; ``end`` takes in the break that follows."""
    out, at = [], 0
    breaks = re.finditer("\n", text) if kind == "line" else _BLANK.finditer(text)
    for a, b in [*(m.span() for m in breaks), (len(text), len(text))]:
        norm = _SPACE.sub(" ", text[at:a].lower()).strip(" ")
        if norm:
            out.append((norm, at, b))
        at = b
    return out


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def occurrences(docs: DataFrame, kind: str = "line", least_words: int = 1) -> DataFrame:
    """(digest, doc_id, h, start, end) of every unit of ``least_words`` or more; (doc_id, h) names the document."""
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("doc_id", ids), T.StructField("h", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches):
        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            rows = [(digest(u), d, h, s, e) for d, h, t in zip(*(c.to_pylist() for c in b.columns)) for u, s, e in units(t, kind) if u.count(" ") >= least_words - 1]
            yield dict(zip(schema.fieldNames(), zip(*rows) if rows else [()] * 5))

    return arrow_map(docs.where("text <> ''").select("doc_id", _key(F.col("text")).alias("h"), "text"), run, schema)


def removals(docs: DataFrame, kind: str = "line", least_words: int = 1) -> DataFrame:
    """(doc_id, h, spans): what goes from each document that loses something."""
    found = stored(occurrences(docs, kind, least_words), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "start")
    ranked = found.select("digest", rank.alias("rank"), "end")
    # Stored, so that both sides of the join come straight from an exchange and Spark can split a hot digest.
    first = ranked.groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("final")).where("first < final").drop("final")
    first = stored(first, "repeated-units")
    later = ranked.join(first, "digest").where("rank > first")
    spans = F.sort_array(F.collect_set(F.struct(F.col("rank.start").alias("start"), "end")))
    return later.groupBy("rank.doc_id", "rank.h").agg(spans.alias("spans"))


def line_dedup(docs: DataFrame, kind: str = "line", least_words: int = 1) -> DataFrame:
    """Per document: doc_id, n_units, spans removed (code points, end exclusive) and the text that stays."""
    schema = T.StructType([T.StructField("n_units", T.LongType()), T.StructField("kept", T.StringType())])

    @F.pandas_udf(schema)
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, gone in zip(texts, spans):
            if t is None:
                rows.append((0, None))
                continue
            parts, at = [], 0
            for g in gone if gone is not None else ():
                parts.append(t[at:g["start"]])
                at = g["end"]
            rows.append((len(units(t, kind)), "".join([*parts, t[at:]])))
        return pd.DataFrame(rows, columns=["n_units", "kept"])

    gone = removals(docs, kind, least_words).select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "spans")
    rows = docs.select("doc_id", "text", _key(F.col("text")).alias("h"))
    joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k")), "left")
    spans = F.coalesce("spans", F.array().cast(SPAN))
    return joined.select("doc_id", spans.alias("spans"), cut("text", "spans").alias("c")).select("doc_id", "c.n_units", "spans", "c.kept")


_LATER = "[ \\t-\\r]+"
SQL = f"""
WITH lines AS (
  SELECT doc_id, text, pos, list_extract(parts, pos) AS line, pos = len(parts) AS final,
         list_sum(list_transform(parts[1:pos-1], lambda x: length(x) + 1)) AS before
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents WHERE text <> '')
), norm AS (
  SELECT *, trim(regexp_replace(lower(line), '{_LATER}', ' ', 'g'), ' ') AS unit FROM lines
), ranked AS (
  SELECT *, unit <> '' AS is_unit, unit <> '' AND row_number() OVER (PARTITION BY unit ORDER BY doc_id, pos) > 1 AS gone FROM norm
), agg AS (
  SELECT doc_id, count(*) FILTER (is_unit) AS n_units, count(*) FILTER (gone) AS n_removed,
    coalesce(sum(length(line) + CASE WHEN final THEN 0 ELSE 1 END) FILTER (gone), 0)::BIGINT AS n_removed_chars,
    coalesce(string_agg(CASE WHEN gone THEN coalesce(before, 0)::BIGINT::VARCHAR || ':' || (coalesce(before, 0) + length(line) + CASE WHEN final THEN 0 ELSE 1 END)::BIGINT::VARCHAR END, ',' ORDER BY pos), '') AS removed_spans,
    sha256(string_agg(CASE WHEN gone THEN '' ELSE line || CASE WHEN final THEN '' ELSE chr(10) END END, '' ORDER BY pos)) AS kept_sha256
  FROM ranked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed_chars, 0) AS n_removed_chars,
  coalesce(removed_spans, '') AS removed_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN agg USING (doc_id)
"""


@query("op5_line_dedup", SQL)
def op5_line_dedup(spark, sf_dir):
    out = line_dedup(documents(spark, sf_dir))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select(
        "doc_id", "n_units", F.size("spans").cast("long").alias("n_removed"), length.alias("n_removed_chars"),
        text.alias("removed_spans"), F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"),
    )
