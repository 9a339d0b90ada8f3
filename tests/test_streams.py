"""Streams over many micro-batches, with late rows, a silent executor and a restart."""

import datetime as dt

import pytest
from oracle import connect
from pyspark.sql import functions as F

from scorelake.plans import telemetry as P
from scorelake.session import scratch_path
from scorelake.streaming import jobs as ST

START = dt.datetime(2024, 5, 1)


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def run_files(spark, files, make, halts):
    """One micro-batch for each list of (executor, seconds); the query ends and starts again after each of ``halts``."""
    src, out, checkpoint = (scratch_path(spark, n) for n in ("src", "out", "checkpoint"))
    for i, rows in enumerate(files):
        spark.createDataFrame([(e, at(s)) for e, s in rows], "executor_id string, ts timestamp").coalesce(1).write.parquet(f"{src}/part={i}")
        if i in halts or i == len(files) - 1:
            stream = spark.readStream.schema("executor_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
            df = make(stream)
            ST.run_available(df, out, checkpoint)
    return [tuple(r) for r in spark.read.schema(df.schema).parquet(out).collect()]


@pytest.mark.parametrize("halts", [(), (1, 3), (0, 1, 2, 3, 4)])
def test_a_silent_executor_is_reported_without_a_next_event(spark, halts):
    files = [
        [("quiet", 0), ("quiet", 30), ("busy", 10), ("busy", 40)],
        [("busy", 80), ("busy", 120), ("quiet", 15)],
        [("busy", 160), ("busy", 600)],  # the watermark passes "quiet" here: it never reports again
        [("quiet", 20), ("busy", 605)],  # too late to count
        [("busy", 640), (None, 610)],
        [("busy", 2000)],
    ]
    found = run_files(spark, files, lambda src: ST.missed_heartbeats(src, 60.0, "100 seconds"), halts)
    want = [
        ("quiet", at(0), at(30), 3, at(90)),
        ("busy", at(10), at(160), 5, at(220)),
        ("busy", at(600), at(640), 3, at(700)),
        (None, at(610), at(610), 1, at(670)),
    ]
    key = lambda r: (r[0] or "", r[1])
    assert sorted(found, key=key) == sorted(want, key=key)


def test_reports_out_of_order_join_spells_within_the_lateness(spark):
    files = [[("a", 0), ("a", 120)], [("a", 60)], [("a", 59.5)], [("z", 1000)], [("z", 1001)]]
    found = run_files(spark, files, lambda src: ST.missed_heartbeats(src, 60.5, "300 seconds"), (2,))
    assert found == [("a", at(0), at(120), 4, at(180.5))]


def test_rows_are_late_in_the_registered_streams():
    """The queries' SQL really drops rows, for both watermarks."""
    con = connect("/root/testdata/sf0.01")
    for marks, end in ((P._marks(f"CASE WHEN b.batch = {P.HALT} THEN {P.HALT - 1} ELSE b.batch - 2 END"), "time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours'"), (P._marks("b.batch - 1"), "ts")):
        total, late = con.execute(f"{P.ARRIVAL}, {marks} SELECT count(*), count(*) FILTER (WHERE mark IS NOT NULL AND {end} <= mark) FROM arrived JOIN marks USING (batch)").fetchone()
        assert total == 10_000 and 100 < late < 1_000


def test_dashboard_windows_close_once(spark):
    files = [[("a", 0), ("a", 200)], [("b", 900)], [("c", 100)], [("d", 5000)], [("e", 5001)]]
    make = lambda src: ST.dashboard_stream(src.withColumn("value", F.lit(1.0)), "5 minutes", ["executor_id"], lateness="5 minutes")
    found = [(r[2], r[3]) for r in run_files(spark, files, make, (1,))]
    # "c" came for a window that the first run had closed.
    assert sorted(found) == [("a", 2), ("b", 1)]


def test_streams_read_tables_of_many_files(spark):
    from scorelake.plans import scoring as SP

    src = scratch_path(spark, "tables")
    vectors = [(i, [float(i == k) for k in range(3)], i % 2) for i in range(30)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{src}/embeddings.parquet")
    events = [(i, START + dt.timedelta(hours=(i * 7) % 40), i % 3, "view", 1.0, None) for i in range(40)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").repartition(4).write.parquet(f"{src}/events.parquet")
    assert sorted(r.signal_id for r in SP.s11(spark, src).collect()) == list(range(30))
    assert SP.t1(spark, src).count() == 30
    assert sum(r.predictions for r in SP.t2(spark, src).collect()) == 30
    # No file makes the rows of another late.
    assert sum(r.n for r in P.t3(spark, src).collect()) == sum(e[1] < START + dt.timedelta(hours=39) for e in events)
