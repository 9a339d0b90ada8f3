"""Metric batches: each once, through failing tasks, replays and commits cut short."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from conftest import ROOT

from scorelake.session import scratch_path
from scorelake.sinks import publish as PB

SCHEMA = "id bigint, value double"


def published(path):
    out = {}
    for folder, _, names in os.walk(f"{path}/{PB.PUBLISHED}"):
        for n in names:
            with open(f"{folder}/{n}") as f:
                out[f"{os.path.basename(folder)}/{n}"] = [json.loads(line) for line in f]
    return out


def test_batches_of_bounded_size(spark):
    path = scratch_path(spark, "metrics")
    PB.publish(spark.range(1000).selectExpr("id", "id / 2 AS value").repartition(3), path, size=300)
    found = published(path)
    assert sorted(r["id"] for rows in found.values() for r in rows) == list(range(1000)) and max(map(len, found.values())) <= 300
    PB.publish(spark.range(0).selectExpr("id", "0D AS value"), path)
    assert PB.read_published(spark, path, SCHEMA).count() == 1000


def test_failing_tasks_leave_each_batch_once():
    """Every first attempt of a task fails after it staged batches: the second one's count, once."""
    script = textwrap.dedent(f"""
        import sys, tempfile
        sys.path.insert(0, {ROOT!r})
        from pyspark import TaskContext
        from scorelake.session import get_session, ship_package
        from scorelake.sinks import publish as PB
        shared = tempfile.mkdtemp(prefix="run-")
        spark = get_session("t", master="local[2,3]", conf={{"spark.ui.enabled": "false", "spark.checkpoint.dir": shared}})
        spark.sparkContext.setLogLevel("OFF")
        ship_package(spark)
        def flaky(batches):
            import pyarrow as pa
            for i, batch in enumerate(batches):
                if i == 2 and TaskContext.get().attemptNumber() == 0:
                    raise RuntimeError("forced")
                yield batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        df = spark.range(0, 1000, 1, 4).selectExpr("id", "id / 2 AS value")
        PB.publish(df.mapInArrow(flaky, "id bigint, value double"), shared + "/batch", size=60)
        df.write.parquet(shared + "/src")
        stream = spark.readStream.schema("id bigint, value double").option("maxFilesPerTrigger", 1).parquet(shared + "/src")
        q = PB.publish_stream(stream.mapInArrow(flaky, "id bigint, value double"), shared + "/stream", shared + "/cp", size=60)
        q.trigger(availableNow=True).start().awaitTermination()
        print("PATH", shared)
    """)
    run = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=180)
    shared = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("PATH")]
    assert shared, run.stderr[-2000:]
    for name, batches in (("batch", 1), ("stream", 4)):
        found = published(f"{shared[0]}/{name}")
        assert sorted(r["id"] for rows in found.values() for r in rows) == list(range(1000))
        assert len({k.split("/")[0] for k in found}) == batches
        assert not os.listdir(f"{shared[0]}/{name}/_staged")


def test_a_failed_write_publishes_nothing(spark):
    path = scratch_path(spark, "metrics")
    bad = spark.range(100).selectExpr("id", "CASE WHEN id = 99 THEN raise_error('forced') ELSE 1D END AS value")
    with pytest.raises(Exception, match="forced"):
        PB.publish(bad, path, size=10)
    # Tasks that were still running at the abort may stage afterwards; nothing reads that.
    assert published(path) == {} and not os.path.exists(f"{path}/{PB.PUBLISHED}")


def test_replayed_and_interrupted_commits(spark, tmp_path):
    """The same micro-batch again adds nothing; moves that were cut short start again."""
    path = str(tmp_path / "metrics")

    def staged(rows):
        stage = PB._Stage({"path": path, "batch_size": "2"})
        folder = f"{path}/_staged/{stage.write_id}/0-0"
        os.makedirs(folder)
        with open(f"{folder}/0.json", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        return stage, [PB.Staged(stage.write_id, 0, [f"{folder}/0.json"], len(rows)), None]

    for _ in range(2):
        stage, messages = staged([{"id": 1}])
        stage.publish(messages, "7")
    assert list(published(path).values()) == [[{"id": 1}]]
    # Batch 8: moved, but not marked when the driver was lost.
    os.makedirs(f"{path}/published/batch=8")
    with open(f"{path}/published/batch=8/5-0.json", "w") as f:
        f.write('{"id": 2}\n')
    stage, messages = staged([{"id": 2}])
    stage.publish(messages, "8")
    assert published(path) == {"batch=7/0-0.json": [{"id": 1}], "batch=8/0-0.json": [{"id": 2}]}
    assert not os.listdir(f"{path}/_staged")
