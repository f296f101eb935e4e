"""Chat formatting in budgeted windows.

Each turn's tokens are counted as it is formatted; prefix sums over a
conversation, in two levels so that a long one is not one task's work, cut it
into stretches, and each stretch is packed into spans of whole turns: a span
is closed before the turn that would exceed its room.  A window holds the
system turn, as much of the turns just before its span as the history
allowance covers, and the span, and its formatted text has at most the
budget's tokens.  Only the span's assistant texts are under the loss mask:
what a window repeats is masked, so each assistant text is learned once.

The template marks turns with control strings.  Inside texts and roles each
``<``, ``[`` and backslash is followed by a backslash, which breaks every
control string and is undone by dropping it.

Defined results: a null text or role is empty; turns are ordered by turn
(nulls first), role and text, so ties and repeated rows have a place; rows
with a null conv_id are one conversation; ``window`` is the number of turns
before the span; a turn above the room is a span of its own and is never cut,
with the history that still fits, and without the system turn if that does not
fit, so only a turn that alone exceeds the budget makes a window above it; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agrolens.llm import bpe
from agrolens.llm.common import arrow_map, query, stored

#: role: (opening, closing) control strings; other roles get both marks of ``OTHER``.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]")
#: Rooms of a stretch, which one task packs in a row; only its last span is closed early.
STRETCH = 64


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def count_tokens(path: str | None):
    ranks, _ = bpe.vocabulary(path or bpe.default_path())
    pairs = list(ranks.items())

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        core = tiktoken.Encoding("byte-level", pat_str=bpe.PATTERN, mergeable_ranks=dict(pairs), special_tokens={})
        return pd.Series([len(core.encode_ordinary(t)) for t in texts], dtype="int64")

    return run


def turn_tokens(path: str | None, role: Column, text: Column) -> Column:
    """Tokens that a turn adds to a formatted window, at most.

    The signs that a turn begins and ends with may share pre-tokens with its
    neighbours' and count as a token a byte.  Next to them are letters, where
    a pre-token ends in any context, so the rest counts the same as in the whole.
    """
    p = _part(role, text, F.lit(True))
    whole = F.concat(p["open"], p["body"], p["close"])
    core = F.regexp_replace(whole, r"\A[<\[]+|[>\]]+\z", "")
    return count_tokens(path)(core) + (F.length(whole) - F.length(core)).cast("long")


def _packed(met: DataFrame) -> DataFrame:
    """Adds ``window``: a stretch's turns in order, in spans that sum to ``room`` at most or are one turn."""
    rows = met.withColumn("stretch", F.floor((F.col("upto") - F.col("tokens")) / (F.col("room") * STRETCH)))
    rows = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "place")
    schema = T.StructType([*rows.schema.fields, T.StructField("window", T.LongType())])

    def run(batches):
        of, window, held = None, 0, 0
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            at = []
            for *key, place, tokens, room in zip(*(cols[n].to_pylist() for n in ("conv_id", "stretch", "place", "tokens", "room"))):
                if key != of or held + tokens > room:
                    of, window, held = key, place - 1, 0
                held += tokens
                at.append(window)
            yield cols | {"window": pa.array(at, pa.int64())}

    return arrow_map(rows, run, schema).drop("stretch")


def _prefixes(turns: DataFrame, block: int) -> DataFrame:
    """Adds ``upto``, the tokens of a conversation up to and with a turn, and ``place``, its rank.

    Blocks of turn numbers are summed first; the sums run over a
    conversation's blocks, and the turns over their block.
    """
    turns = turns.withColumn("block", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block))
    sums = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("t"), F.count("*").alias("c"))
    over = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("v"), F.col("block").alias("k"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(over), F.lit(0)).alias("c0"))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.withColumns({"upto": F.sum("tokens").over(within), "place": F.count("*").over(within)})
    met = own.join(sums, own.conv_id.eqNullSafe(F.col("v")) & (own.block == F.col("k")))
    return met.withColumns({"upto": F.col("upto") + F.col("t0"), "place": F.col("place") + F.col("c0")}).drop("v", "k", "t0", "c0", "block")


def windows(conversations: DataFrame, path: str | None = None, budget: int = 1024, history: int = 256, block: int = 1024) -> DataFrame:
    """One row a window: conv_id, window, formatted, n_repeated (leading turns that repeat), loss_spans.

    Spans are of code points in ``formatted``, end exclusive.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", turn_tokens(path, F.col("role"), F.col("text")))
    turns = stored(_prefixes(stored(rows, "chat-tokens"), block), "chat-prefixes")
    # The first turn is the system turn if its role says so; it is counted in every window, unless none can hold it.
    system = turns.where("place = 1 AND role = 'system'").select(F.col("conv_id").alias("s"), F.struct("place", "role", "text").alias("system"), F.col("tokens").alias("fixed"))
    met = turns.join(system, turns.conv_id.eqNullSafe(F.col("s")), "left").drop("s")
    met = met.withColumn("fixed", F.coalesce("fixed", F.lit(0).cast("long")))
    room = F.lit(budget - history) - F.when(F.col("fixed") < budget, F.col("fixed")).otherwise(0)
    met = stored(_packed(met.withColumn("room", F.greatest(room, F.lit(1)))), "chat-turns")  # read four times below; tokens are counted once
    # The system turn and the history get what the span leaves of the budget.
    spent = met.groupBy("conv_id", "window").agg(F.min(F.col("upto") - F.col("tokens")).alias("start"), (F.lit(budget) - F.sum("tokens") - F.first("fixed")).alias("left"))
    turn = F.struct("place", "role", "text")
    own = met.select("conv_id", "window", "system", "fixed", "tokens", turn.alias("t"), F.lit(True).alias("own"))
    # Turns before a span repeat while their tokens fit the allowance.
    spans = spent.where("window > 0 AND left > 0").select(F.col("conv_id").alias("v"), F.col("window").alias("next"), "start", (F.col("start") - F.least("left", F.lit(history))).alias("oldest"))
    # Turns of one token or more: at most ``history`` of them fit, so a turn repeats in a bounded number of windows.
    buckets = F.sequence(F.floor(F.col("oldest") / budget), F.floor(F.col("start") / budget))
    asks = spans.withColumn("bucket", F.explode(buckets))
    gives = met.where("NOT (place = 1 AND role = 'system')").withColumn("begin", F.col("upto") - F.col("tokens")).withColumn("bucket", F.floor(F.col("begin") / budget))
    repeats = gives.join(asks, gives.conv_id.eqNullSafe(asks.v) & (gives.bucket == asks.bucket) & (F.col("begin") >= F.col("oldest")) & (F.col("upto") <= F.col("start")))
    repeated = repeats.select("conv_id", F.col("next").alias("window"), "system", "fixed", "tokens", turn.alias("t"), F.lit(False).alias("own"))
    both = own.unionByName(repeated)
    fits = F.sum(F.when(F.col("own"), F.col("tokens"))) + F.first("fixed") <= budget
    grouped = both.groupBy("conv_id", "window").agg(F.when(fits, F.first("system", True)).alias("system"), F.sort_array(F.collect_list(F.struct("t", "own"))).alias("turns"))
    head = F.when(F.col("system").isNotNull() & (F.col("turns")[0]["t"]["place"] > 1), F.array(F.struct(F.col("system").alias("t"), F.lit(False).alias("own")))).otherwise(F.array().cast(grouped.schema["turns"].dataType))
    grouped = grouped.withColumn("turns", F.concat(head, "turns"))
    parts = F.transform("turns", lambda x: _part(x["t"]["role"], x["t"]["text"], x["own"]))
    grouped = grouped.withColumn("parts", parts)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    loss = F.aggregate("parts", zero, lambda a, p: F.struct(
        (a["at"] + F.length(p["open"]) + F.length(p["body"]) + F.length(p["close"])).alias("at"),
        F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(p["open"])).alias("start"), (a["at"] + F.length(p["open"]) + F.length(p["body"])).alias("end"))))).otherwise(a["spans"]).alias("spans"),
    ))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["open"], p["body"], p["close"])), "")
    return grouped.select("conv_id", "window", text.alias("formatted"), F.size(F.filter("turns", lambda x: ~x["own"])).alias("n_repeated"), loss["spans"].alias("loss_spans"))


def _part(role: Column, text: Column, own: Column) -> Column:
    opening = F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1] + OTHER[2]))
    closing = F.lit(OTHER[3])
    for name, (a, b) in MARKS.items():
        opening = F.when(role == name, F.lit(a)).otherwise(opening)
        closing = F.when(role == name, F.lit(b)).otherwise(closing)
    return F.struct(opening.alias("open"), escaped(text).alias("body"), closing.alias("close"), (own & (role == "assistant")).alias("loss"))


_TURN = r"(?s)<<SYS>>.*?<</SYS>>|\[INST\].*?\[/INST\]|<s>.*?</s>|\[ROLE\].*?\[/ROLE\]\[TURN\].*?\[/TURN\]"


def read_back(formatted: Column) -> Column:
    """The turns of a formatted window: array of (role, text), unescaped."""
    def turn(x: Column) -> Column:
        at = F.locate(OTHER[1] + OTHER[2], x)
        role = unescaped(F.substr(x, F.lit(len(OTHER[0]) + 1), at - len(OTHER[0]) - 1))
        skip, tail = at + len(OTHER[1] + OTHER[2]) - 1, F.lit(len(OTHER[3]))
        for name, (a, b) in MARKS.items():
            hit = F.startswith(x, F.lit(a))
            role = F.when(hit, F.lit(name)).otherwise(role)
            skip = F.when(hit, F.lit(len(a))).otherwise(skip)
            tail = F.when(hit, F.lit(len(b))).otherwise(tail)
        return F.struct(role.alias("role"), unescaped(F.substr(x, skip + 1, F.length(x) - skip - tail)).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0)), turn)


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, text under the loss mask, and sizes.

    A digest of a whole conversation is taken in its order, so one task reads
    a conversation's windows; it holds a batch of them and two hash states.
    """
    back = F.slice(read_back(F.col("formatted")), F.col("n_repeated") + 1, F.greatest(F.size(read_back(F.col("formatted"))), F.lit(1)))
    lost = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.select("conv_id", "window", F.length("formatted").alias("chars"), back.alias("turns"), F.array_join(lost, "").alias("lost"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "window", F.size("turns").cast("long").alias("n"), whole.cast("binary").alias("whole"), F.length("lost").cast("long").alias("k"), F.col("lost").cast("binary").alias("lost"), F.col("chars").cast("long").alias("chars"))
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (rows.schema["conv_id"].dataType, T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType())

    def run(batches):
        of, sums, hashes = None, [0, 0, 0], ()

        def done() -> tuple:
            n, k, chars = sums
            return of[0], n, hashes[0].hexdigest(), k, hashes[1].hexdigest(), chars

        for b in batches:
            ready = []
            for i in range(b.num_rows):
                conv, _, n, whole, k, lost, chars = (b.column(j)[i].as_py() for j in range(b.num_columns))
                if of is None or of[0] != conv:
                    if of is not None:
                        ready.append(done())
                    of, sums, hashes = (conv,), [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
                hashes[0].update(whole)
                hashes[1].update(lost)
                sums = [x + y for x, y in zip(sums, (n, k, chars))]
            if ready:
                yield dict(zip(names, zip(*ready)))
        if of is not None:
            yield dict(zip(names, zip(done())))

    return arrow_map(rows.repartition("conv_id").sortWithinPartitions("conv_id", "window"), run, T.StructType([T.StructField(a, b) for a, b in zip(names, kinds)]))


@query("op6_chat_format")
def op6_chat_format(spark, sf_dir):
    import public_tokenizers

    talks = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], talks.schema)
    return digests(windows(talks.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))
