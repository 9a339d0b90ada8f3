"""Scoring invariants, errors, devices, task rows and the column form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.operators import nets
from scorelake.operators import scoring as SC
from scorelake.operators.registry import Model, ModelRegistry, signal_registry
from scorelake.operators.sets import same_predictions
from scorelake.plans.weights import formula_weights
from scorelake.session import scratch_path

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def signals(spark):
    from scorelake.plans.tables import wide_signals

    return wide_signals(spark, DIR).cache()


@pytest.fixture(scope="module")
def classifier():
    return signal_registry({"ew_classifier": formula_weights("ew_classifier")}).models["ew_classifier"]


def test_batch_size_and_partitions_do_not_matter(signals, classifier):
    base = SC.score(signals, classifier).select("signal_id", "pred")
    for size, parts in ((1, 2), (7, 3), (10_000, 1)):
        other = SC.score(signals.repartition(parts), classifier, batch_size=size).select("signal_id", "pred")
        assert same_predictions(base, other)


def test_weights_survive_storage(spark, signals, classifier):
    path = scratch_path(spark, "w")
    SC.weights_frame(spark, {"ew_classifier": classifier.weights}).write.parquet(path)
    again = signal_registry(SC.load_weights(spark.read.parquet(path))).models["ew_classifier"]
    assert {k: v.shape for k, v in again.weights.items()} == {k: v.shape for k, v in classifier.weights.items()}
    assert same_predictions(SC.score(signals, classifier).select("signal_id", "pred"), SC.score(signals, again).select("signal_id", "pred"))


def test_too_large_weights_are_refused(spark, classifier):
    table = SC.weights_frame(spark, {"m": {"a": np.zeros(100)}})
    with pytest.raises(ValueError, match="more than"):
        SC.load_weights(table, max_bytes=100)


def test_wrong_width_is_an_error(signals, classifier):
    short = signals.withColumn("features", F.slice("features", 1, 127))
    with pytest.raises(Exception, match="validate_shape"):
        SC.score(short, classifier).count()
    missing = signals.withColumn("features", F.when(F.col("signal_id") > 0, F.col("features")))
    with pytest.raises(Exception, match="validate_shape"):
        SC.score(missing, classifier).count()


def test_first_maximum_wins(spark):
    tie = Model("tie", nets.linear, {"fc.weight": np.zeros((3, 2)), "fc.bias": np.array([1.0, 2.0, 2.0])}, (2,), "logits")
    df = spark.createDataFrame([(1, [0.0, 0.0])], "signal_id int, features array<float>")
    row = SC.score(df, tie).first()
    assert row["pred"] == 1 and row["confidence"] == pytest.approx(1 / (2 + np.exp(-1)))


def test_device_choice():
    assert SC.choose_device("hybrid", False) == "cpu" and SC.choose_device("hybrid", True) == "cuda"
    assert SC.choose_device("cpu_only", True) == "cpu" and SC.choose_device("gpu_only", True) == "cuda"
    with pytest.raises(RuntimeError):
        SC.choose_device("gpu_only", False)
    with pytest.raises(ValueError):
        SC.choose_device("tpu", False)


def test_gpu_only_fails_without_a_device(signals, classifier):
    with pytest.raises(Exception, match="gpu_only"):
        SC.score(signals, classifier, device_mode="gpu_only").count()


def test_task_rows_account_for_every_sample(spark, signals):
    registry = signal_registry({n: formula_weights(n) for n in ("threat_prioritizer", "anomaly_detector")})
    preds, tasks = SC.with_task_metrics(signals.repartition(3), registry, scratch_path(spark, "t"), batch_size=100)
    n = signals.count()
    assert preds.count() == n
    got = {r["model"]: r for r in tasks.groupBy("model").agg(F.sum("samples").alias("s"), F.sum("batches").alias("b"), F.count("*").alias("t")).collect()}
    assert {m: r["s"] for m, r in got.items()} == {"threat_prioritizer": n, "anomaly_detector": n}
    assert all(r["t"] == 3 and r["b"] >= 5 for r in got.values())
    assert tasks.where("hostname IS NULL OR pid IS NULL OR device <> 'cpu'").isEmpty()


def test_column_form_agrees(spark, signals, classifier):
    column = SC.score_column(spark, classifier)
    got = {r[0]: r[1] for r in signals.select("signal_id", column("features")).collect()}
    want = {r[0]: r[1] for r in SC.score(signals, classifier).select("signal_id", "logits").collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-5) for k in want)


def test_scores_stay_in_range(signals):
    registry = signal_registry({n: formula_weights(n) for n in ("threat_prioritizer", "anomaly_detector", "rf_fingerprinter")})
    bad = SC.score_all(signals, registry).where(
        (F.col("threat_prioritizer") < 0) | (F.col("threat_prioritizer") > 1) | (F.col("anomaly_detector") < 0)
        | (F.size("rf_fingerprinter") != 32)
    )
    assert bad.isEmpty()


def test_registry_checks(spark):
    registry = ModelRegistry()
    with pytest.raises(ValueError):
        registry.register_model(Model("m", nets.linear, output="boxes"))
    registry.register_model(Model("a", nets.linear, input_shape=(2,), category="signal", memory_mb=3))
    registry.register_model(Model("b", nets.linear, input_shape=(3, 4), category="image", memory_mb=4))
    assert [m.name for m in registry.in_category("image")] == ["b"] and registry.models["b"].width == 12
    assert registry.frame(spark).count() == 2
    with pytest.raises(ValueError, match="same input shape"):
        SC.score_all(spark.range(1), registry)


def test_blobs_are_decoded_in_the_task(spark):
    df = spark.createDataFrame([("a", bytearray(b"\x01\x02")), ("b", bytearray(b"\x05\x00"))], "path string, content binary")
    stub = Model("sum", lambda w, x: x.sum(axis=1), {}, (2,), "score")
    got = {r["path"]: r["output"] for r in SC.score_blobs(df, stub, lambda c: np.frombuffer(c, dtype="uint8")).collect()}
    assert got == {"a": 3.0, "b": 5.0}


def test_mixed_registry_names_models_without_data(spark, signals, classifier):
    registry = SC.ModelRegistry()
    registry.register_model(classifier)
    registry.register_model(SC.Model("wide_sum", lambda w, x: x.sum(axis=1), {}, (3,), "score", "image_classification"))
    registry.register_model(SC.Model("lonely", lambda w, x: x, {}, (5,), "vector", "object_detection"))
    images = spark.createDataFrame([(7, [1.0, 2.0, 3.0]), (8, [0.0, 0.0, 1.0])], "signal_id bigint, features array<double>")
    rows, without = SC.score_registry({"signal": signals, "image_classification": images}, registry)
    assert without == ["lonely"]
    by_model = {r.model: r.n for r in rows.groupBy("model").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert by_model == {classifier.name: signals.count(), "wide_sum": 2}
    assert {r.id: r.score for r in rows.where("model = 'wide_sum'").collect()} == {"7": 6.0, "8": 1.0}


def test_outputs_that_are_not_asked_for_are_not_there(signals, classifier):
    whole = {r.signal_id: r.pred for r in SC.score(signals, classifier).collect()}
    slim = SC.score(signals, classifier, outputs=("pred",))
    assert slim.columns == ["signal_id", "pred"] and {r.signal_id: r.pred for r in slim.collect()} == whole
    with pytest.raises(ValueError, match="outputs"):
        SC.score(signals, classifier, outputs=("nothing",))


def test_highest_version_counts_and_a_layer_twice_is_an_error(spark):
    old, new = {"m": {"w": np.zeros((2, 2))}}, {"m": {"w": np.ones((2, 2))}}
    table = SC.weights_frame(spark, old, version=1).unionByName(SC.weights_frame(spark, new, version=2))
    assert SC.load_weights(table)["m"]["w"].sum() == 4 and SC.load_weights(table, version=1)["m"]["w"].sum() == 0
    with pytest.raises(ValueError, match="stored twice"):
        SC.load_weights(table.unionByName(table))


def test_a_stream_broadcasts_its_weights_once(spark, signals, classifier, tmp_path, monkeypatch):
    from scorelake.streaming import jobs

    source = str(tmp_path / "in")
    signals.repartition(20).write.parquet(source)
    made = []
    real = SC.broadcast_weights
    monkeypatch.setattr(SC, "broadcast_weights", lambda *a: made.append(1) or real(*a))
    stream = spark.readStream.schema(signals.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = jobs.score_batches(stream, [classifier], str(tmp_path / "out"), str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 4 and made == [1]
    assert spark.read.parquet(str(tmp_path / "out")).where("task is null").count() == signals.count()


def test_task_signals_are_those_of_two_joins(spark, capfd):
    """Repeated, missing and null ids and vectors; vectors don't travel with the tasks."""
    from pyspark.sql import functions as F

    from scorelake.plans import tables as T
    from scorelake.session import scratch_path

    src = scratch_path(spark, "tables")
    vectors = [(i, [float(i), 0.5]) for i in range(30)] + [(3, [9.0, 9.0]), (7, None), (None, [1.0, 1.0]), (90, [None, 2.0])]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{src}/embeddings.parquet")
    tasks = [(r, r % 11, r % 37) for r in range(400)] + [(1, None, 2), (2, 2, None), (None, 3, 3)]
    spark.createDataFrame(tasks, "l_orderkey bigint, l_suppkey bigint, l_partkey bigint").repartition(5).write.parquet(f"{src}/lineitem.parquet")
    e, n = T.table(spark, src, "embeddings"), len(vectors)
    t = T.table(spark, src, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_suppkey").alias("executor_id"), F.pmod("l_partkey", F.lit(n)).alias("_i"), F.pmod("l_suppkey", F.lit(n)).alias("_q"))
    joined = t.join(e.selectExpr("vec_id _i", "embedding a"), "_i").join(e.selectExpr("vec_id _q", "embedding b"), "_q").select("run_id", "executor_id", F.concat("a", "b").alias("features"))
    rows = lambda df: sorted(map(repr, df.collect()))
    found = T.task_signals(spark, src)
    assert rows(found) == rows(joined) and found.schema["features"].dataType == joined.schema["features"].dataType
    capfd.readouterr()
    T.task_signals(spark, src).explain()
    assert "Join" not in capfd.readouterr().out
