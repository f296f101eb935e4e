"""Streams give the batch answer whatever the order of their files, and a retried batch counts once."""

import os
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from agrolens.plans.common import samples
from agrolens.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """events and lineitem cut by date into five files each, the latest arriving first."""
    base = tmp_path_factory.mktemp("files")
    for name, col in (("events", "ts"), ("lineitem", "l_shipdate")):
        pdf = spark.read.parquet(f"{SF}/{name}.parquet").toPandas().sort_values(col)
        cut = len(pdf) // 5 + 1
        for i, k in enumerate(reversed(range(5))):
            path = f"{base}/{name}{i}.parquet"
            pdf.iloc[k * cut:(k + 1) * cut].to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
            os.utime(path, (1_700_000_000 + i * 100,) * 2)
    return str(base)


def rows(df):
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("job", [jobs.prediction_counts, jobs.window_counts, jobs.latency_histogram, jobs.dedupe])
def test_order_of_files_does_not_matter(spark, shuffled, job):
    assert rows(job(spark, shuffled)) == rows(job(spark, SF))


def test_accepted_and_rejected_are_the_input(spark, shuffled):
    got = jobs.recommend(spark, shuffled)
    n = samples(spark, SF).count()
    assert got["out"].where("rank = 1").count() + got["quarantine"].count() == n
    assert rows(got["quarantine"]) == rows(jobs.recommend(spark, SF)["quarantine"])


def test_dedupe_drops_repeats(spark, shuffled):
    n = samples(spark, SF).select("sample_id").distinct().count()
    assert jobs.dedupe(spark, shuffled).count() == n < samples(spark, SF).count()


def test_retried_batch_and_restart(spark, shuffled):
    first = rows(jobs.window_counts(spark, shuffled, run="again"))
    assert rows(jobs.window_counts(spark, shuffled, run="again")) == first  # goes on from its checkpoint: nothing new
    base = jobs.shared_dir(spark, "streams/window_counts-again")
    commits = f"{base.removeprefix('file://')}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):  # the last batch's commit is lost after its write
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    assert rows(jobs.window_counts(spark, shuffled, run="again")) == first


def test_late_rows_count(spark, shuffled):
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert jobs.window_counts(spark, shuffled).agg(F.sum("n")).first()[0] == n


@pytest.fixture()
def ordered(spark, tmp_path):
    """A folder for event files that come one by one, and a function that adds one."""
    pdf = spark.read.parquet(f"{SF}/events.parquet").toPandas().sort_values("ts").reset_index(drop=True)
    made = []

    def add(part):
        path = f"{tmp_path}/events{len(made)}.parquet"
        part.to_parquet(path, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(path, (1_700_000_000 + len(made) * 100,) * 2)
        made.append(path)

    return str(tmp_path), pdf, add


def test_state_jobs_equal_the_merging_ones(spark):
    assert rows(jobs.window_counts_state(spark, SF)) == rows(jobs.window_counts(spark, SF))
    assert rows(jobs.prediction_counts_state(spark, SF)) == rows(jobs.prediction_counts(spark, SF))


def test_window_state_over_restarts(spark, ordered):
    """Files that come over several runs: counts go on from the state, and closed windows stay as they are."""
    folder, pdf, add = ordered
    third = len(pdf) // 3
    for i in range(3):
        add(pdf.iloc[i * third:(i + 1) * third if i < 2 else len(pdf)])
        got = jobs.window_counts_state(spark, folder, run=f"restart-{os.path.basename(folder)}")
        assert got.groupBy("window_start", "event_type").count().where("count > 1").count() == 0
    assert rows(got) == rows(jobs.window_counts(spark, SF))
    assert got.where("NOT closed").count() < 100 < got.count()  # the state is the last hours only


def test_rows_past_the_watermark_are_dropped_and_others_count(spark, ordered):
    folder, pdf, add = ordered
    half = len(pdf) // 2
    end = pdf.ts.iloc[half - 1]
    slightly = pdf[(pdf.ts > end - pd.Timedelta("90min")) & (pdf.ts <= end)].iloc[:5]  # within two hours: counts
    add(pdf.iloc[:half].drop(slightly.index))
    add(slightly)
    add(pdf.iloc[:7])  # days late, and their windows were closed by the batch before: dropped
    got = jobs.window_counts_state(spark, folder)
    assert got.agg(F.sum("n")).first()[0] == half


def test_lost_commit_counts_once(spark, ordered):
    folder, pdf, add = ordered
    add(pdf.iloc[:500])
    run = f"lost-{os.path.basename(folder)}"
    first = rows(jobs.prediction_counts_state(spark, folder, run=run))
    commits = f"{jobs.shared_dir(spark, f'streams/prediction_state-{run}').removeprefix('file://')}/checkpoint/commits"
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{commits}/{f}"):
            os.remove(f"{commits}/{f}")
    assert rows(jobs.prediction_counts_state(spark, folder, run=run)) == first
    add(pdf.iloc[500:800])
    assert sum(r.n_predictions for r in jobs.prediction_counts_state(spark, folder, run=run).collect()) == 800


def test_replayed_ids_come_once(spark, shuffled):
    got = jobs.first_seen(spark, shuffled)  # five files, the latest first
    want = samples(spark, SF).where("date IS NOT NULL").select("sample_id").distinct()
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
