"""Queries that score vectors, in batch and on streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import nets, training
from ..operators import scoring as SC
from ..operators.evaluation import confusion
from ..operators.matching import match_embeddings, match_near, match_recall
from ..operators.registry import Model, ModelRegistry, signal_registry
from ..operators.runs import accuracy
from ..session import scratch_path
from ..sinks.tables import write_blobs
from ..sources import images as IM
from ..sources.signals import read_blobs, stream_signals
from ..streaming import jobs as ST
from .catalog import Catalog, rnd, rnd_sql
from .tables import LABELS, SIGNALS, signals, stream_path, table, task_signals, wide_signals
from .weights import dense_sql, formula_weights, layer_sql, norm_sql

catalog = Catalog()
query = catalog.query

CENTROIDS = (
    "c AS (SELECT label AS k, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(features))) AS pos, unnest(features)::DOUBLE AS x FROM signals) GROUP BY ALL), "
    "cl AS MATERIALIZED (SELECT k, list(m ORDER BY pos) AS center FROM c GROUP BY k), "
    "d AS (SELECT signal_id, label, features, k, list_dot_product(features::DOUBLE[], center) AS s FROM signals, cl), "
    "preds AS (SELECT signal_id, label, arg_max(k, s) AS pred, 1 / sum(exp(s - top)) AS confidence FROM (SELECT *, max(s) OVER (PARTITION BY signal_id) AS top FROM d) GROUP BY ALL)"
)
HEAD = f"WITH {SIGNALS}, {CENTROIDS}"


def centroid_model(spark, sf_dir) -> Model:
    return training.fit_centroids(signals(spark, sf_dir))


def centroid_preds(spark, sf_dir, **kwargs):
    """Predictions with their labels. The label rides along as an id column, so
    no join is needed to bring it back."""
    out = SC.score(signals(spark, sf_dir), centroid_model(spark, sf_dir), id_cols=("signal_id", "label"), dtype="float64", **kwargs)
    return out.withColumn("correct", F.col("pred") == F.col("label"))


@query("m1_score_vectors", f"{HEAD} SELECT signal_id, pred, {rnd_sql('confidence', 8)} AS confidence FROM preds")
def m1(spark, sf_dir):
    return centroid_preds(spark, sf_dir).select("signal_id", "pred", rnd("confidence", 8).alias("confidence"))


@query("m4_row_at_a_time", f"{HEAD} SELECT signal_id, pred, {rnd_sql('confidence', 8)} AS confidence FROM preds")
def m4(spark, sf_dir):
    return centroid_preds(spark, sf_dir, batch_size=1).select("signal_id", "pred", rnd("confidence", 8).alias("confidence"))


@query("m7_centroid_confusion", f"{HEAD} SELECT label, " + ", ".join(f"count(*) FILTER (WHERE pred = {k}) AS pred_{k}" for k in LABELS) + ", 0::BIGINT AS pred_other FROM preds GROUP BY label")
def m7_confusion(spark, sf_dir):
    return confusion(centroid_preds(spark, sf_dir), LABELS)


@query("a3_model_accuracy", f"{HEAD} SELECT count(*) AS n, count(*) FILTER (WHERE pred = label) AS n_correct, {rnd_sql('count(*) FILTER (WHERE pred = label) / count(*)::DOUBLE', 6)} AS accuracy FROM preds")
def a3_model(spark, sf_dir):
    return accuracy(centroid_preds(spark, sf_dir)).withColumn("accuracy", rnd("accuracy", 6))


TASK_SIGNALS = (
    "w AS (SELECT signal_id, label, list_concat(features, list_reverse(features))::DOUBLE[] AS v FROM signals), "
    "wc AS (SELECT label AS k, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(v))) AS pos, unnest(v) AS x FROM w) GROUP BY ALL), "
    "wcl AS MATERIALIZED (SELECT k, list(m ORDER BY pos) AS center FROM wc GROUP BY k), n AS (SELECT count(*) AS n FROM embeddings), "
    "ts AS (SELECT row_number() OVER () AS rid, l_suppkey AS executor_id, list_concat(i.embedding, q.embedding)::DOUBLE[] AS v FROM lineitem, n "
    "JOIN embeddings i ON i.vec_id = l_partkey % n.n JOIN embeddings q ON q.vec_id = l_suppkey % n.n), "
    "tp AS (SELECT rid, executor_id, arg_max(k, list_dot_product(v, center)) AS pred FROM ts, wcl GROUP BY rid, executor_id)"
)


@query("m1_score_task_signals", f"WITH {SIGNALS}, {TASK_SIGNALS} SELECT executor_id, pred, count(*) AS n FROM tp GROUP BY ALL")
def m1_tasks(spark, sf_dir):
    model = training.fit_centroids(wide_signals(spark, sf_dir))
    out = SC.score(task_signals(spark, sf_dir), model, id_cols=("executor_id",), dtype="float64")
    return out.groupBy("executor_id", "pred").agg(F.count("*").alias("n"))


@query("u5_same_predictions", "SELECT 0::BIGINT AS differing_rows, count(*) AS rows FROM embeddings")
def u5(spark, sf_dir):
    """Predictions must not depend on batch size or on how rows are partitioned."""
    from ..operators.sets import prediction_differences

    one = centroid_preds(spark, sf_dir, batch_size=7).select("signal_id", "pred")
    model = centroid_model(spark, sf_dir)
    spread = signals(spark, sf_dir).repartition(5, "signal_id")
    two = SC.score(spread, model, dtype="float64").select("signal_id", "pred")
    diff = prediction_differences(one, two).agg(F.count("*").alias("differing_rows"))
    return diff.withColumn("rows", two.agg(F.count("*")).scalar())


# -- the signal networks, over 128 values: a vector and its mirror

RELU = "greatest({y}, 0::DOUBLE)"
INPUT = f"{SIGNALS}, x AS (SELECT signal_id, list_concat(features, list_reverse(features))::DOUBLE[] AS v FROM signals)"


def _bn_relu(k: int) -> str:
    return "greatest(" + norm_sql("ew_classifier", f"bn{k}", "{y}") + ", 0::DOUBLE)"


CLASSIFIER, CLASSIFIER_OUT = dense_sql(
    "ew_classifier", [(f"fc{k}", _bn_relu(k)) for k in range(4)] + [("fc4", RELU), ("fc5", "{y}")], "x", "cl_"
)
DENOISER, DENOISER_OUT = dense_sql("signal_denoiser", [(n, RELU) for n in ("enc0", "enc1", "enc2", "dec0", "dec1")] + [("dec2", "tanh({y})")], "x", "dn_")
PRIORITY, PRIORITY_OUT = dense_sql(
    "threat_prioritizer",
    [("proj", "{y}"), ("attn_v", "{y}"), ("attn_out", "{y}"), ("fc0", RELU), ("fc1", RELU), ("fc2", "1 / (1 + exp(-({y})))")],
    "x", "pr_",
)
ANOMALY, ANOMALY_OUT = dense_sql("anomaly_detector", [("enc0", RELU), ("enc1", RELU), ("mu", "{y}"), ("dec0", RELU), ("dec1", RELU), ("dec2", "{y}")], "x", "an_")
SQ_ERROR = "list_sum(list_transform(list_zip(a.v, x.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def net(name: str) -> Model:
    return signal_registry({name: formula_weights(name)}).models[name]


@query("m7_classifier_net", f"WITH {INPUT}, {CLASSIFIER}, e AS (SELECT signal_id, v, list_max(v) AS top FROM {CLASSIFIER_OUT}) "
       f"SELECT signal_id, CAST(list_position(v, top) - 1 AS INTEGER) AS pred, {rnd_sql('1 / list_sum(list_transform(v, lambda z: exp(z - top)))', 6)} AS confidence, "
       f"{rnd_sql('v[1]', 6)} AS first_logit, {rnd_sql('v[8]', 6)} AS last_logit FROM e")
def m7_net(spark, sf_dir):
    out = SC.score(wide_signals(spark, sf_dir), net("ew_classifier"), dtype="float64")
    return out.select("signal_id", "pred", rnd("confidence", 6).alias("confidence"),
                      rnd(F.col("logits")[0], 6).alias("first_logit"), rnd(F.col("logits")[7], 6).alias("last_logit"))


def _long(df, col: str):
    rows = df.select("signal_id", F.posexplode(col).alias("pos", "value"))
    return rows.select("signal_id", F.col("pos").cast("long").alias("pos"), rnd("value", 6).alias("value"))


def _long_sql(source: str) -> str:
    return f"SELECT signal_id, pos, {rnd_sql('value', 6)} AS value FROM (SELECT signal_id, unnest(range(len(v))) AS pos, unnest(v) AS value FROM {source})"


@query("m8_denoise", f"WITH {INPUT}, {DENOISER} " + _long_sql(DENOISER_OUT))
def m8(spark, sf_dir):
    return _long(SC.score(wide_signals(spark, sf_dir), net("signal_denoiser"), dtype="float64"), "output")


@query("m9_priority", f"WITH {INPUT}, {PRIORITY} SELECT signal_id, {rnd_sql('v[1]', 6)} AS priority FROM {PRIORITY_OUT}")
def m9(spark, sf_dir):
    out = SC.score(wide_signals(spark, sf_dir), net("threat_prioritizer"), dtype="float64")
    return out.select("signal_id", rnd("output", 6).alias("priority"))


@query("m11_anomaly", f"WITH {INPUT}, {ANOMALY} SELECT x.signal_id, {rnd_sql(SQ_ERROR, 6)} AS score FROM {ANOMALY_OUT} a JOIN x USING (signal_id)")
def m11(spark, sf_dir):
    out = SC.score(wide_signals(spark, sf_dir), net("anomaly_detector"), dtype="float64")
    return out.select("signal_id", rnd("output", 6).alias("score"))


@query("m11_centroid_residual", f"{HEAD} SELECT signal_id, {rnd_sql('list_sum(list_transform(list_zip(features::DOUBLE[], center), lambda p: (p[1] - p[2]) * (p[1] - p[2])))', 6)} AS residual FROM signals JOIN cl ON label = k")
def m11_centroid(spark, sf_dir):
    table_ = training.centroid_table(signals(spark, sf_dir))
    centers = table_.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "mean"))).alias("c"))
    centers = centers.select("label", F.transform("c", lambda x: x["mean"]).alias("center"))
    joined = signals(spark, sf_dir).join(centers, "label")
    return joined.select("signal_id", rnd(V.sq_error("features", "center"), 6).alias("residual"))


# The convolutions in SQL: ``chan`` lists, per position, the channel values. A
# window is a slice of the zero-padded list, so it runs position by position and
# the weights are listed in that order too.
def _conv_sql(k: int, kernel: int, pad: int, channels: int, source: str) -> str:
    zeros = f"[[0.0::DOUBLE for _ in range({channels})] for _ in range({pad})]"
    act = norm_sql("rf_fingerprinter", f"bn{k}", "greatest(y, 0::DOUBLE)")
    weights = layer_sql("rf_fingerprinter", f"conv{k}", order=f"j % {kernel}, j // {kernel}")
    return (
        f"fw{k} AS MATERIALIZED ({weights}), "
        f"pad{k} AS MATERIALIZED (SELECT signal_id, list_concat({zeros}, chan, {zeros}) AS chan FROM {source}), "
        f"win{k} AS (SELECT signal_id, p.pos, flatten(chan[p.pos + 1:p.pos + {kernel}]) AS v FROM pad{k}, (SELECT unnest(range(128)) AS pos) p), "
        f"act{k} AS (SELECT signal_id, pos, list({act} ORDER BY i) AS v FROM (SELECT signal_id, pos, i, list_dot_product(v, w) + b AS y FROM win{k}, fw{k}) GROUP BY signal_id, pos), "
        f"h{k} AS MATERIALIZED (SELECT signal_id, list(v ORDER BY pos) AS chan FROM act{k} GROUP BY signal_id)"
    )


FINGERPRINT_DENSE, FINGERPRINT_RAW = dense_sql("rf_fingerprinter", [("fc0", RELU), ("fc1", "{y}")], "pooled", "fp_")
FINGERPRINT = ", ".join(
    [
        "h AS (SELECT signal_id, list_transform(v, lambda z: [z]) AS chan FROM x)",
        _conv_sql(0, 7, 3, 1, "h"),
        _conv_sql(1, 5, 2, 32, "h0"),
        _conv_sql(2, 3, 1, 64, "h1"),
        # Means of 16 positions; flattened channel by channel.
        "pools AS (SELECT signal_id, c, pos // 16 AS slot, avg(z) AS z FROM (SELECT signal_id, pos, unnest(range(128)) AS c, unnest(v) AS z FROM act2) GROUP BY ALL)",
        "pooled AS MATERIALIZED (SELECT signal_id, list(z ORDER BY c, slot) AS v FROM pools GROUP BY signal_id)",
        FINGERPRINT_DENSE,
        f"unit AS (SELECT signal_id, list_transform(v, lambda z: z / greatest(n, 1e-12)) AS v FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM {FINGERPRINT_RAW}))",
    ]
)


@query("m10_embedding", f"WITH {INPUT}, {FINGERPRINT} " + _long_sql("unit"))
def m10(spark, sf_dir):
    return _long(SC.score(wide_signals(spark, sf_dir), net("rf_fingerprinter"), dtype="float64"), "output")


@query("m10_embedding_norm", "SELECT vec_id AS signal_id, 32 AS dims, 1.0::DOUBLE AS length FROM embeddings")
def m10_norm(spark, sf_dir):
    out = SC.score(wide_signals(spark, sf_dir), net("rf_fingerprinter"), dtype="float64")
    return out.select("signal_id", F.size("output").alias("dims"), rnd(V.norm("output"), 6).alias("length"))


FOUR = ["ew_classifier", "signal_denoiser", "threat_prioritizer", "anomaly_detector"]


@query("m2_score_all_models", f"WITH {INPUT}, {CLASSIFIER}, {DENOISER}, {PRIORITY}, {ANOMALY} "
       f"SELECT x.signal_id, CAST(list_position(c.v, list_max(c.v)) - 1 AS INTEGER) AS pred, {rnd_sql('list_sum(d.v)', 6)} AS denoised_total, {rnd_sql('p.v[1]', 6)} AS priority, {rnd_sql(SQ_ERROR, 6)} AS anomaly, 1.0::DOUBLE AS embedding_length "
       f"FROM x JOIN {CLASSIFIER_OUT} c USING (signal_id) JOIN {DENOISER_OUT} d USING (signal_id) JOIN {PRIORITY_OUT} p USING (signal_id) JOIN {ANOMALY_OUT} a USING (signal_id)")
def m2(spark, sf_dir):
    registry = signal_registry({n: formula_weights(n) for n in nets.SIGNAL_MODELS})
    out = SC.score_all(wide_signals(spark, sf_dir), registry, dtype="float64")
    total = F.aggregate("signal_denoiser", F.lit(0.0), lambda acc, v: acc + v)
    return out.select(
        "signal_id", F.col("ew_classifier.pred").alias("pred"), rnd(total, 6).alias("denoised_total"), rnd("threat_prioritizer", 6).alias("priority"),
        rnd("anomaly_detector", 6).alias("anomaly"), rnd(V.norm("rf_fingerprinter"), 6).alias("embedding_length"),
    )


MARKS = ["<", ">", "/", "=", '"', "&", ";", "."]  # characters counted by the demo decoder


def _mark_counts_sql() -> str:
    return "[" + ", ".join("(len(html) - len(replace(html, '{}', '')))::DOUBLE".format(m) for m in MARKS) + "]"


STUB = {
    "fc.weight": np.array([[np.sin(i * 8 + j + 1.0) for j in range(8)] for i in range(4)]),
    "fc.bias": np.array([0.5 * i for i in range(4)]),
}
STUB_SQL = ", ".join(
    "list_dot_product(v, [" + ", ".join(f"sin({i * 8 + j + 1}.0::DOUBLE)" for j in range(8)) + f"]) + {0.5 * i}::DOUBLE" for i in range(4)
)


@query("m2_mixed_registry", f"WITH {INPUT}, {CLASSIFIER}, {PRIORITY}, m AS (SELECT page_id, {_mark_counts_sql()} AS v FROM pages), y AS (SELECT page_id, [{STUB_SQL}] AS z FROM m) "
       f"SELECT 'signal' AS category, signal_id AS id, 'ew_classifier' AS model, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred, NULL::DOUBLE AS score, 1::BIGINT AS without_data FROM {CLASSIFIER_OUT} "
       f"UNION ALL SELECT 'signal', signal_id, 'threat_prioritizer', NULL, {rnd_sql('v[1]', 6)}, 1 FROM {PRIORITY_OUT} "
       "UNION ALL SELECT 'image_classification', page_id, 'linear_stub', CAST(list_position(z, list_max(z)) - 1 AS INTEGER), NULL, 1 FROM y")
def m2_mixed(spark, sf_dir):
    """Models of two input shapes in one call, and one whose category has no data."""
    registry = signal_registry({n: formula_weights(n) for n in ("ew_classifier", "threat_prioritizer")})
    registry.register_model(Model("linear_stub", nets.linear, STUB, (8,), "logits", "image_classification"))
    registry.register_model(Model("unused_stub", nets.linear, STUB, (8,), "logits", "object_detection"))
    marks = F.array(*[(F.length("html") - F.length(F.replace("html", F.lit(m), F.lit("")))).cast("double") for m in MARKS])
    images = table(spark, sf_dir, "pages").select(F.col("page_id").alias("signal_id"), marks.alias("features"))
    rows, without = SC.score_registry({"signal": wide_signals(spark, sf_dir), "image_classification": images}, registry, dtype="float64")
    return rows.select("category", F.col("id").cast("long").alias("id"), "model", "pred", rnd("score", 6).alias("score"), F.lit(len(without)).cast("long").alias("without_data"))


@query("m3_score_column", f"WITH {INPUT}, {CLASSIFIER} SELECT signal_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred FROM {CLASSIFIER_OUT}")
def m3(spark, sf_dir):
    classify = SC.score_column(spark, net("ew_classifier"))
    return wide_signals(spark, sf_dir).select("signal_id", V.argmax(classify("features")).alias("pred"))


@query("m6_weights_round_trip", f"WITH {INPUT}, {CLASSIFIER} SELECT signal_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred FROM {CLASSIFIER_OUT}")
def m6(spark, sf_dir):
    """Weights written as a table, read back, and used."""
    path = scratch_path(spark, "weights")
    SC.weights_frame(spark, {"ew_classifier": formula_weights("ew_classifier")}).write.parquet(path)
    registry = signal_registry(SC.load_weights(spark.read.parquet(path), version=1))
    return SC.score(wide_signals(spark, sf_dir), registry.models["ew_classifier"]).select("signal_id", "pred")


@query("m6_highest_version", f"WITH {INPUT}, {CLASSIFIER} SELECT signal_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS pred FROM {CLASSIFIER_OUT}")
def m6_versions(spark, sf_dir):
    """An older version beside the wanted one: without a version the highest counts."""
    path = scratch_path(spark, "weights")
    newer = formula_weights("ew_classifier")
    older = {layer: -2 * data for layer, data in newer.items()}
    SC.weights_frame(spark, {"ew_classifier": newer}, version=2).unionByName(SC.weights_frame(spark, {"ew_classifier": older}, version=1)).write.parquet(path)
    registry = signal_registry(SC.load_weights(spark.read.parquet(path)))
    return SC.score(wide_signals(spark, sf_dir), registry.models["ew_classifier"]).select("signal_id", "pred")


@query("m13_train_classifier", "SELECT count(*) FILTER (WHERE vec_id % 4 = 0) AS n_held_out, count(*) FILTER (WHERE vec_id % 4 <> 0) AS n_trained, true AS above_floor FROM embeddings")
def m13(spark, sf_dir):
    """Train on three rows of four and judge on the fourth.

    The table's own labels don't depend on its vectors, so the label is one that
    the vector determines: which of its first four values is largest. Weights
    are not reproducible bit by bit, so a floor (far above chance) is checked.
    """
    rows = signals(spark, sf_dir).withColumn("label", V.argmax(F.slice("features", 1, 4)))
    held_out = F.col("signal_id") % 4 == 0
    model = training.fit_classifier(rows.where(~held_out), [64, 16, 4])
    trained = rows.where(~held_out).agg(F.count("*")).scalar()
    out = accuracy(training.classify(model, rows.where(held_out)))
    return out.select(F.col("n").alias("n_held_out"), trained.alias("n_trained"), (F.col("accuracy") >= 0.6).alias("above_floor"))


@query("m13_held_out_centroids", f"WITH {SIGNALS}, s AS (SELECT signal_id, features::DOUBLE[] AS f, list_position(features[1:4], list_max(features[1:4])) - 1 AS label FROM signals), "
       "c AS (SELECT label AS k, pos, avg(x) AS m FROM (SELECT label, unnest(range(len(f))) AS pos, unnest(f) AS x FROM s WHERE signal_id % 4 <> 0) GROUP BY ALL), "
       "cl AS MATERIALIZED (SELECT k, list(m ORDER BY pos) AS center FROM c GROUP BY k), "
       "p AS (SELECT signal_id, label, arg_max(k, list_dot_product(f, center)) AS pred FROM s, cl WHERE signal_id % 4 = 0 GROUP BY signal_id, label) "
       f"SELECT label::INTEGER AS label, count(*) AS n, count(*) FILTER (WHERE pred = label) AS n_correct, {rnd_sql('count(*) FILTER (WHERE pred = label) / count(*)', 6)} AS accuracy FROM p GROUP BY label")
def m13_held_out(spark, sf_dir):
    """Trained on three rows of four; what it gets right of the fourth, as numbers for each label."""
    rows = signals(spark, sf_dir).withColumn("label", V.argmax(F.slice("features", 1, 4)))
    held_out = F.col("signal_id") % 4 == 0
    model = training.fit_centroids(rows.where(~held_out))
    scored = SC.score(rows.where(held_out), model, id_cols=("signal_id", "label"), dtype="float64")
    right = F.count_if(F.col("pred") == F.col("label"))
    return scored.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), right.alias("n_correct"), rnd(right / F.count("*"), 6).alias("accuracy"))


@query("m8_reconstructor", "SELECT count(*) AS n, true AS keeps_most FROM embeddings")
def m8_pca(spark, sf_dir):
    """Projection on half the components must keep more than half of the energy."""
    rows = signals(spark, sf_dir)
    model = training.reconstruction_error_model(training.fit_reconstructor(rows, 32))
    out = SC.score(rows, model, dtype="float64")
    return out.agg(F.count("*").alias("n"), (F.avg("output") < 0.5).alias("keeps_most"))


@query("m14_device_mode", "SELECT 'cpu' AS device, count(*) AS samples FROM embeddings")
def m14(spark, sf_dir):
    _, tasks = SC.with_task_metrics(wide_signals(spark, sf_dir), [net("threat_prioritizer")], scratch_path(spark, "scored"), device_mode="hybrid")
    return tasks.groupBy("device").agg(F.sum("samples").alias("samples"))


@query("m15_task_metrics", "SELECT unnest(['ew_classifier', 'threat_prioritizer']) AS model, n AS samples, n AS predictions, true AS timed FROM (SELECT count(*) AS n FROM embeddings)")
def m15(spark, sf_dir):
    """Samples summed over tasks equal the rows scored, for every model."""
    chosen = [net("ew_classifier"), net("threat_prioritizer")]
    preds, tasks = SC.with_task_metrics(wide_signals(spark, sf_dir), chosen, scratch_path(spark, "scored"), batch_size=64)
    out = tasks.groupBy("model").agg(F.sum("samples").alias("samples"), F.bool_and(F.col("inference_time") > 0).alias("timed"))
    return out.withColumn("predictions", preds.agg(F.count("*")).scalar())


def _abs_sum(w, x):
    return np.abs(x).sum(axis=1) * w["gain"]


@query("m16_user_model", f"WITH {SIGNALS} SELECT signal_id, {rnd_sql('3 * list_sum(list_transform(features, lambda v: abs(v::DOUBLE)))', 6)} AS score FROM signals")
def m16(spark, sf_dir):
    registry = ModelRegistry()
    registry.register_model(Model("loudness", _abs_sum, {"gain": np.array([3.0])}, (64,), "score", memory_mb=1.0))
    out = SC.score_all(signals(spark, sf_dir), registry, dtype="float64")
    return out.select("signal_id", rnd("loudness", 6).alias("score"))


@query("m17_match_embeddings", f"WITH {SIGNALS}, d AS (SELECT a.signal_id, b.signal_id AS gallery_id, list_cosine_similarity(a.features::DOUBLE[], b.features::DOUBLE[]) AS s FROM signals a JOIN signals b ON a.signal_id <> b.signal_id) "
       f"SELECT signal_id, gallery_id, {rnd_sql('s', 8)} AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY s DESC, gallery_id) <= 3")
def m17(spark, sf_dir):
    q = signals(spark, sf_dir)
    g = q.select(F.col("signal_id").alias("gallery_id"), "features")
    out = match_embeddings(q, g, 3, skip_self=True)
    return out.select("signal_id", "gallery_id", rnd("similarity", 8).alias("similarity"))


@query("m17_similar_signals", f"WITH {SIGNALS}, g AS (SELECT signal_id AS gallery_id, list_transform(features::DOUBLE[], lambda v, i: CASE WHEN i = 1 THEN -v ELSE v END) AS f FROM signals), "
       "d AS (SELECT signal_id, gallery_id, list_cosine_similarity(features::DOUBLE[], f) AS s FROM signals, g) "
       f"SELECT signal_id, gallery_id, {rnd_sql('s', 8)} AS similarity FROM d WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY s DESC, gallery_id) <= 2")
def m17_similar(spark, sf_dir):
    """Vectors that aren't unit length against a gallery of altered ones, from a floor on."""
    s = signals(spark, sf_dir)
    q = s.withColumn("features", F.transform("features", lambda v: v.cast("double") * (F.col("signal_id") % 5 + 1)))
    g = s.select(F.col("signal_id").alias("gallery_id"), F.transform("features", lambda v, i: F.when(i == 0, -v).otherwise(v)).alias("features"))
    out = match_embeddings(q, g, 2, min_similarity=0.8)
    return out.select("signal_id", "gallery_id", rnd("similarity", 8).alias("similarity"))


# A signal as it is received again: each value scaled by up to three tenths.
RECEIVED = f"WITH {SIGNALS}, r AS (SELECT signal_id, list_transform(features::DOUBLE[], lambda v, i: v * (1 + ((signal_id * 31 + i * 17) % 7 - 3) / 10.0)) AS f FROM signals), " \
    "near AS (SELECT r.signal_id, g.signal_id AS gallery_id, list_cosine_similarity(f, g.features::DOUBLE[]) AS s FROM r, signals g " \
    "QUALIFY row_number() OVER (PARTITION BY r.signal_id ORDER BY s DESC, gallery_id) <= 1)"


def received(spark, sf_dir):
    """Signals with changed values, and the gallery of the signals as they are."""
    s = signals(spark, sf_dir)
    noise = lambda v, i: v.cast("double") * (1 + ((F.col("signal_id") * 31 + (i + 1) * 17) % 7 - 3) / F.lit(10.0))
    return s.withColumn("features", F.transform("features", noise)), s.select(F.col("signal_id").alias("gallery_id"), "features")


@query("m17_probe_match", f"{RECEIVED} SELECT signal_id, gallery_id, {rnd_sql('s', 8)} AS similarity FROM near")
def m17_probe(spark, sf_dir):
    """Small buckets, so that most of the gallery is not looked at."""
    found = match_near(*received(spark, sf_dir), bucket_rows=8)
    return found.select("signal_id", "gallery_id", rnd("similarity", 8).alias("similarity"))


@query("m17_probe_recall", f"{RECEIVED} SELECT count(*) AS n, count(gallery_id) AS n_found, {rnd_sql('count(gallery_id) / count(*)', 4)} AS recall FROM near")
def m17_recall(spark, sf_dir):
    """Recall of the probed search against the exact one, as a number."""
    q, g = received(spark, sf_dir)
    out = match_recall(match_near(q, g, bucket_rows=8), match_embeddings(q, g, min_similarity=0.5))
    return out.select("n", "n_found", rnd("recall").alias("recall"))


# -- stored blobs: bytes are decoded inside the scoring batch

def count_marks(content: bytes) -> np.ndarray:
    return np.array([content.count(m.encode()) for m in MARKS], dtype="float64")


@query("m12_score_blobs", f"WITH x AS (SELECT page_id, {_mark_counts_sql()} AS v FROM pages), y AS (SELECT page_id, [{STUB_SQL}] AS z FROM x) "
       f"SELECT page_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, {rnd_sql('list_max(z)', 6)} AS top_logit FROM y")
def m12(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    stub = Model("linear_stub", nets.linear, STUB, (8,), "logits", "image_classification")
    out = SC.score_blobs(pages, stub, count_marks, id_cols=("page_id",), dtype="float64")
    return out.select("page_id", "pred", rnd(F.array_max("logits"), 6).alias("top_logit"))


# -- encoded images: eight by eight pixels made from a vector's values, every other one a PNG

PIXELS = {
    "fc.weight": np.array([[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(64)] for i in range(5)]),
    "fc.bias": np.array([0.25 * i for i in range(5)]),
}
PIXELS_SQL = ", ".join("list_dot_product(v, [" + ", ".join(f"{((7 * i + 3 * j) % 11 - 5) / 10}::DOUBLE" for j in range(64)) + f"]) + {0.25 * i}::DOUBLE" for i in range(5))


def _drawn(batches):
    """Rows of (vec_id, pixels) as (name, content)."""
    import pyarrow as pa

    for batch in batches:
        ids, pixels = batch.column(0).to_pylist(), [np.array(p, dtype="uint8").reshape(8, 8) for p in batch.column(1).to_pylist()]
        names = [f"{i}.{'png' if i % 2 else 'pgm'}" for i in ids]
        content = [(IM.encode_png if i % 2 else IM.encode_pgm)(p) for i, p in zip(ids, pixels, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(content, pa.binary())], names=["name", "content"])


@query("m12_score_images", "WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: least(255, greatest(0, floor(e::DOUBLE * 127.5 + 128))) / 255.0::DOUBLE * 2 - 1) AS v FROM embeddings), "
       f"y AS (SELECT vec_id, [{PIXELS_SQL}] AS z FROM x) SELECT vec_id || CASE WHEN vec_id % 2 = 1 THEN '.png' ELSE '.pgm' END AS file, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS pred, "
       f"{rnd_sql('list_max(z)', 6)} AS top_logit, 'cpu' AS device FROM y")
def m12_images(spark, sf_dir):
    """Image files written by the executors, read back as binary files, decoded in the scoring batch."""
    pixel = lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 127.5 + 128))).cast("int")
    drawn = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("pixels"))
    path = scratch_path(spark, "images")
    write_blobs(drawn.mapInArrow(_drawn, "name string, content binary"), path).agg(F.sum("length")).collect()
    files = read_blobs(spark, path, "*.p[gn][mg]").withColumn("file", F.element_at(F.split("path", "/"), -1))
    model = Model("pixel_stub", nets.linear, PIXELS, (1, 8, 8), "logits", "image_classification")
    out = SC.score_blobs(files, model, IM.image_input, id_cols=("file",), dtype="float64", device_mode="hybrid")
    return out.select("file", "pred", rnd(F.array_max("logits"), 6).alias("top_logit"), "device")


# -- streams


def signal_stream(spark, sf_dir, max_files: int = 1):
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    src = stream_signals(spark, stream_path(sf_dir, "embeddings"), schema, max_files)
    return src.select(F.col("vec_id").alias("signal_id"), F.col("embedding").alias("features"), "label")


@query("s11_stream_signals", f"WITH {SIGNALS} SELECT signal_id, label, len(features)::INTEGER AS dims FROM signals")
def s11(spark, sf_dir):
    out = scratch_path(spark, "out")
    arrived = signal_stream(spark, sf_dir)
    ST.run_available(arrived, out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(arrived.schema).parquet(out).select("signal_id", "label", F.size("features").alias("dims"))


@query("t1_score_stream", f"{HEAD} SELECT signal_id, pred, {rnd_sql('confidence', 8)} AS confidence FROM preds")
def t1(spark, sf_dir):
    out = scratch_path(spark, "out")
    scored = ST.score_stream(signal_stream(spark, sf_dir), centroid_model(spark, sf_dir), dtype="float64")
    ST.run_available(scored, out, scratch_path(spark, "checkpoint"))
    return spark.read.schema(scored.schema).parquet(out).select("signal_id", "pred", rnd("confidence", 8).alias("confidence"))


@query("t2_score_batches", f"{HEAD} SELECT pred, count(*) AS predictions, (SELECT count(*) FROM embeddings) AS scored FROM preds GROUP BY pred")
def t2(spark, sf_dir):
    out = scratch_path(spark, "out")
    writer = ST.score_batches(signal_stream(spark, sf_dir), [centroid_model(spark, sf_dir)], out, scratch_path(spark, "checkpoint"), dtype="float64")
    writer.trigger(availableNow=True).start().awaitTermination()
    preds, tasks = SC.split_scored(spark.read.parquet(out))
    counts = preds.groupBy(F.col("centroid.pred").alias("pred")).agg(F.count("*").alias("predictions"))
    return counts.withColumn("scored", tasks.agg(F.sum("samples")).scalar())


@query("k6_write_predictions", f"{HEAD} SELECT label, pred, count(*) AS n FROM preds GROUP BY ALL")
def k6(spark, sf_dir):
    from ..sinks.tables import write_predictions

    out = scratch_path(spark, "predictions")
    write_predictions(centroid_preds(spark, sf_dir), out, partition_by=("label",))
    back = spark.read.parquet(out)
    return back.groupBy(F.col("label").cast("int").alias("label"), "pred").agg(F.count("*").alias("n"))
