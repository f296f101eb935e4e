"""Structured Streaming jobs over file streams.

Every job has two parts: what a micro-batch contributes, and how
contributions merge.  ``foreachBatch`` writes a batch's contribution to a
folder named by the batch id, replacing what an earlier attempt left there, so
a retried batch counts once; with a stable ``run`` name a restarted job goes
on from its checkpoint.  Reading merges the folders.

``*_state`` jobs and ``first_seen`` keep their state in Spark's state store instead, bounded by a
watermark or by the number of crops, and do not read their history again; the
merging jobs below are for streams that must not drop a late row.

The merges do not depend on the order of batches, so nothing is lost when
files arrive out of time order: there is no watermark beyond which rows are
dropped.  What lateness means here is stated where it matters: a window is
``closed`` once the latest event seen lies ``lateness`` past its end, and a row
that still comes later is counted and reopens nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolens.functions.columns import lit_d
from agrolens.session import shared_dir
from agrolens.sources import dims

EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                 "value double, props string")


def _event_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    return (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
            .withColumn("ts", F.col("ts").cast("timestamp")))


def _scored(stream: DataFrame) -> DataFrame:
    """FX8 projection as a stream."""
    v = F.floor(F.col("value") * 100 + F.lit(0.5)).cast("bigint")
    actual = F.pmod("user_id", F.lit(22))
    pred = F.when(F.pmod("event_id", F.lit(4)) == 0, F.pmod(F.col("user_id") + 1, F.lit(22))).otherwise(actual)
    return stream.select(
        F.col("event_id").alias("request_id"), "ts", "event_type",
        (F.pmod(v, F.lit(1500)).cast("double") / 1000).alias("latency_s"),
        F.element_at(F.array(*[F.lit(c) for c in dims.CROP_LABELS]), pred.cast("int") + 1).alias("crop"))


LINEITEM_SCHEMA = ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                   "l_quantity double, l_shipdate timestamp_ntz")


def run_stream(stream: DataFrame, name: str, parts: dict[str, Callable[[DataFrame], DataFrame]],
               run: str | None = None) -> dict[str, DataFrame]:
    """Process what is available; return each part's contributions (with ``batch_id``).

    ``parts`` maps an output's name to what a batch contributes to it.
    """
    spark = stream.sparkSession
    base = shared_dir(spark, f"streams/{name}-{run or uuid.uuid4().hex[:12]}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        for part, contribution in parts.items():
            contribution(batch).write.mode("overwrite").parquet(f"{base}/{part}/batch_id={batch_id}")

    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return {part: spark.read.parquet(f"{base}/{part}") for part in parts}


def prediction_counts(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """Prediction count per crop."""
    def count(batch):
        return _scored(batch).groupBy("crop").agg(F.count("*").alias("n"))
    got = run_stream(_event_stream(spark, sf_dir), "prediction_counts", {"out": count}, run)["out"]
    return got.groupBy("crop").agg(F.sum("n").alias("n_predictions"))


def window_counts(spark: SparkSession, sf_dir: str, size: str = "1 hour", lateness: str = "2 hours",
                  run: str | None = None) -> DataFrame:
    """Events per event-time tumbling window and type; every row counts, however late.

    ``closed``: the latest event seen lies ``lateness`` or more past the window's end."""
    def count(batch):
        return batch.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("seen")) \
            .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "seen")
    got = run_stream(_event_stream(spark, sf_dir), "window_counts", {"out": count}, run)["out"]
    latest = got.agg(F.max("seen").alias("_latest"))  # one row
    out = got.groupBy("start", "end", "event_type").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(latest))
    return out.select(F.col("start").cast("timestamp_ntz").alias("window_start"), F.col("end").cast("timestamp_ntz").alias("window_end"),
                      "event_type", "n", (F.col("_latest") >= F.col("end") + F.expr(f"INTERVAL {lateness}")).alias("closed"))


def _stateful(frame: DataFrame, name: str, mode: str, run: str | None) -> str:
    """Run a stateful stream over what is available; each batch's output goes to a folder of its own, so a
    retried batch replaces what it wrote.  Returns the run's folder."""
    base = shared_dir(frame.sparkSession, f"streams/{name}-{run or uuid.uuid4().hex[:12]}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    q = frame.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return base


def prediction_counts_state(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """T2 with state: one running count a crop is kept (22 at most), and each batch writes them all; the last batch is the answer."""
    counts = _scored(_event_stream(spark, sf_dir)).groupBy("crop").agg(F.count("*").alias("n_predictions"))
    got = spark.read.parquet(f"{_stateful(counts, 'prediction_state', 'complete', run)}/out")
    last = got.agg(F.max("batch_id").alias("_last"))  # one row
    return got.crossJoin(F.broadcast(last)).where("batch_id = _last").select("crop", "n_predictions")


def window_counts_state(spark: SparkSession, sf_dir: str, size: str = "1 hour", lateness: str = "2 hours",
                        run: str | None = None) -> DataFrame:
    """T3 with a watermark: counts per event-time window and type.

    A window is in the state until the latest event lies ``lateness`` past its end; then it is
    written once, ``closed``, and leaves the state.  So the state holds the windows of the last ``lateness`` and
    the output one row a window, however long the stream runs.  Rows that come later than that are
    dropped, as Spark counts in ``numRowsDroppedByWatermark``.  Windows still open are read from the state.
    """
    counts = (_event_stream(spark, sf_dir).withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")))
    flat = counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")
    base = _stateful(flat, "window_state", "append", run)
    closed = spark.read.schema("start timestamp, end timestamp, event_type string, n bigint").option("recursiveFileLookup", "true").parquet(f"{base}/out")
    held = spark.read.format("statestore").load(f"{base}/checkpoint")
    value = held.schema["value"].dataType.names[-1]  # the only aggregate
    opened = held.select(F.col("key.window.start").alias("start"), F.col("key.window.end").alias("end"), F.col("key.event_type").alias("event_type"), F.col(f"value.{value}").alias("n"))
    both = closed.withColumn("closed", F.lit(True)).unionByName(opened.withColumn("closed", F.lit(False)))
    return both.select(F.col("start").cast("timestamp_ntz").alias("window_start"), F.col("end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", "closed")


def first_seen(spark: SparkSession, sf_dir: str, lateness: str = "3650 days", run: str | None = None) -> DataFrame:
    """T5 with state: each sample id once, when it is first seen.

    An id is remembered until the latest date lies ``lateness`` past it: a replay within that time is
    dropped and the state is bounded by it.  The given samples span seven years in one file, hence the default.
    """
    ids = _sample_stream(spark, sf_dir).select("sample_id", F.col("date").cast("timestamp").alias("at")).where("at IS NOT NULL")
    once = ids.withWatermark("at", lateness).dropDuplicatesWithinWatermark(["sample_id"]).select("sample_id")
    base = _stateful(once, "first_seen", "append", run)
    return spark.read.schema("sample_id string").option("recursiveFileLookup", "true").parquet(f"{base}/out")


def latency_histogram(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """T4: cumulative latency buckets."""
    def count(batch):
        x = _scored(batch)
        items = [F.struct(F.lit(str(b)).alias("le"), F.count_if(F.col("latency_s") <= lit_d(b)).alias("n")) for b in dims.LATENCY_BUCKETS]
        items.append(F.struct(F.lit("+Inf").alias("le"), F.count("*").alias("n")))
        return x.agg(F.array(*items).alias("b")).select(F.inline("b"))
    got = run_stream(_event_stream(spark, sf_dir), "latency_histogram", {"out": count}, run)["out"]
    return got.groupBy("le").agg(F.sum("n").alias("n"))


def _sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from agrolens.operators.ingest import to_canonical
    from agrolens.sources.fixtures import soil_samples_from
    li = (spark.readStream.schema(LINEITEM_SCHEMA).option("maxFilesPerTrigger", 1)
          .parquet(f"{sf_dir.rstrip('/')}/lineitem*.parquet"))
    return to_canonical(soil_samples_from(spark, li)).withColumnsRenamed(
        {"sample_date": "date", "lat": "latitude", "lon": "longitude"})


def dedupe(spark: SparkSession, sf_dir: str, run: str | None = None) -> DataFrame:
    """T5: one row a sample id, the earliest by date and row key, whatever file it came in."""
    first = F.min(F.struct("date", "row_uid", "target_crop"))

    def earliest(batch):
        return batch.groupBy("sample_id").agg(first.alias("first"))
    got = run_stream(_sample_stream(spark, sf_dir), "dedupe", {"out": earliest}, run)["out"]
    return got.groupBy("sample_id").agg(F.min("first").alias("first")).select("sample_id", "first.*")


def recommend(spark: SparkSession, sf_dir: str, run: str | None = None) -> dict[str, DataFrame]:
    """Score a stream of sample rows.  ``out``: rule top-3 of the accepted rows;
    ``quarantine``: the rejected rows with their violations."""
    from agrolens.operators import rules, serving

    def accepted(batch):
        return rules.rule_top(serving.request_gate(batch).where("accepted"), ["row_uid", "sample_id"])

    def rejected(batch):
        return serving.request_gate(batch).where("NOT accepted").select("row_uid", "sample_id", "violations")
    got = run_stream(_sample_stream(spark, sf_dir), "recommend", {"out": accepted, "quarantine": rejected}, run)
    return {k: v.drop("batch_id") for k, v in got.items()}
