"""Queries over signal vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.columns import payload_mb
from ..operators.evaluation import confusion, label_histogram
from ..operators.runs import accuracy
from .catalog import Catalog, rnd, rnd_sql
from .tables import HALF, LABELS, SIGNALS, signals, table

catalog = Catalog()
query = catalog.query

CLASSES_SQL = "classes(class_id, class_name, category) AS (VALUES " + ", ".join(
    f"({k}, '{n}', '{c}')" for k, n, c in V.SIGNAL_CLASSES
) + ")"
UNNEST = "SELECT signal_id, unnest(range(len(v))) AS pos, unnest(v) AS value FROM t"


def long_rows(df: DataFrame, col: str, digits: int = 6) -> DataFrame:
    rows = df.select("signal_id", F.posexplode(col).alias("pos", "value"))
    return rows.select("signal_id", F.col("pos").cast("long").alias("pos"), rnd("value", digits).alias("value"))


def long_sql(body: str, digits: int = 6) -> str:
    return f"WITH {SIGNALS}, t AS ({body}), u AS ({UNNEST}) SELECT signal_id, pos, {rnd_sql('value', digits)} AS value FROM u"


@query("s1_read_signals", f"WITH {SIGNALS} SELECT signal_id, label, CAST(len(features) AS BIGINT) AS dims, "
       f"{rnd_sql('list_sum(list_transform(features, lambda x: x::DOUBLE))', 6)} AS total FROM signals")
def s1(spark, sf_dir):
    total = F.aggregate(F.col("features").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return signals(spark, sf_dir).select("signal_id", "label", F.size("features").cast("long").alias("dims"), rnd(total, 6).alias("total"))


@query("p1_split_concat_iq", f"WITH {SIGNALS}, t AS (SELECT signal_id, features[1:{HALF}] AS i_part, features[{HALF + 1}:] AS q_part FROM signals) "
       f"SELECT signal_id, unnest(range({HALF})) AS pos, unnest(i_part)::DOUBLE AS i_value, unnest(q_part)::DOUBLE AS q_value FROM t")
def p1(spark, sf_dir):
    halves = V.split_iq(signals(spark, sf_dir), "features", HALF)
    back = halves.withColumn("whole", V.concat_iq("i_part", "q_part"))
    again = V.split_iq(back.drop("i_part", "q_part"), "whole", HALF)
    rows = again.select("signal_id", F.posexplode(F.arrays_zip("i_part", "q_part")).alias("pos", "z"))
    return rows.select(
        "signal_id", F.col("pos").cast("long").alias("pos"),
        F.col("z.i_part").cast("double").alias("i_value"), F.col("z.q_part").cast("double").alias("q_value"),
    )


# Twice the vector has length 2, so dividing by the length is visible.
_DOUBLED = "list_transform(features, lambda x: 2 * x::DOUBLE)"


@query("p2_l2_normalize", long_sql(
    f"SELECT signal_id, list_transform(d, lambda x: x / n) AS v FROM (SELECT signal_id, {_DOUBLED} AS d, "
    f"sqrt(list_sum(list_transform({_DOUBLED}, lambda y: y * y))) AS n FROM signals)"))
def p2(spark, sf_dir):
    doubled = signals(spark, sf_dir).withColumn("features", F.transform("features", lambda x: x.cast("double") * 2))
    return long_rows(V.l2_normalize(doubled, "features"), "features")


@query("p3_to_wide", f"WITH {SIGNALS} SELECT signal_id, " + ", ".join(
    f"features[{k + 1}] AS {name}" for k, name in enumerate(V.wide_names(2 * HALF))) + " FROM signals")
def p3(spark, sf_dir):
    return V.to_wide(signals(spark, sf_dir).drop("label"), "features", 2 * HALF)


@query("p4_to_array", long_sql("SELECT signal_id, list_transform(features, lambda x: x::DOUBLE) AS v FROM signals"))
def p4(spark, sf_dir):
    wide = V.to_wide(signals(spark, sf_dir).drop("label"), "features", 2 * HALF)
    return long_rows(V.to_array(wide, V.wide_names(2 * HALF)), "features")


# Vectors cut to 60 + label values give both accepted and rejected rows.
@query("p5_validate_shape", f"WITH {SIGNALS}, t AS (SELECT label, len(features[1:60 + label]) AS n FROM signals) "
       "SELECT label, count(*) FILTER (WHERE n = 64) AS good, count(*) FILTER (WHERE n <> 64) AS rejected FROM t GROUP BY label")
def p5(spark, sf_dir):
    cut = signals(spark, sf_dir).withColumn("features", F.slice("features", F.lit(1), F.col("label") + 60))
    good, rejected = V.validate_shape(cut, "features", [8, 8])
    both = good.select("label", F.lit(1).alias("ok")).unionAll(rejected.select("label", F.lit(0).alias("ok")))
    return both.groupBy("label").agg(F.count_if(F.col("ok") == 1).alias("good"), F.count_if(F.col("ok") == 0).alias("rejected"))


@query("p6_decode_labels", f"WITH {SIGNALS}, {CLASSES_SQL} SELECT signal_id, label, class_name, category "
       "FROM signals LEFT JOIN classes ON label = class_id")
def p6(spark, sf_dir):
    decoded = V.decode_labels(signals(spark, sf_dir), V.class_frame(spark))
    return decoded.select("signal_id", "label", "class_name", "category")


@query("p7_argmax", f"WITH {SIGNALS} SELECT signal_id, CAST(list_position(features, list_max(features)) - 1 AS INTEGER) AS pred FROM signals")
def p7(spark, sf_dir):
    return signals(spark, sf_dir).select("signal_id", V.argmax("features").alias("pred"))


_EXPS = (
    "tops AS (SELECT *, list_max(features)::DOUBLE AS top FROM signals), "
    "exps AS (SELECT *, list_transform(features, lambda x: exp(x::DOUBLE - top)) AS e FROM tops), "
    "soft AS (SELECT *, list_sum(e) AS total FROM exps)"
)


@query("p8_softmax", f"WITH {SIGNALS}, {_EXPS}, t AS (SELECT signal_id, list_transform(e, lambda x: x / total) AS v FROM soft), "
       f"u AS ({UNNEST}) SELECT signal_id, pos, {rnd_sql('value', 8)} AS value FROM u")
def p8(spark, sf_dir):
    return long_rows(signals(spark, sf_dir).withColumn("p", V.softmax("features")), "p", 8)


@query("p9_confidence", f"WITH {SIGNALS}, {_EXPS} SELECT signal_id, CAST(list_position(features, list_max(features)) - 1 AS INTEGER) AS pred, "
       f"{rnd_sql('list_max(e) / total', 8)} AS confidence, "
       "list_position(features, list_max(features)) - 1 = label AS correct FROM soft")
def p9(spark, sf_dir):
    out = V.with_confidence(signals(spark, sf_dir), "features")
    return out.select("signal_id", "pred", rnd("confidence", 8).alias("confidence"), "correct")


@query("p10_preview", f"WITH {SIGNALS} SELECT signal_id, array_to_string(list_transform(features[1:8], lambda x: printf('%+.3f', x::DOUBLE)), ' ') AS preview FROM signals")
def p10(spark, sf_dir):
    return signals(spark, sf_dir).select("signal_id", V.preview("features").alias("preview"))


@query("p11_normalize_clamped", long_sql(
    "SELECT signal_id, list_transform(features, lambda x: x::DOUBLE / greatest(sqrt(list_sum(list_transform(features, lambda y: y::DOUBLE * y::DOUBLE))), 1e-12)) AS v FROM signals"))
def p11(spark, sf_dir):
    return long_rows(V.l2_normalize(signals(spark, sf_dir), "features", eps=1e-12), "features")


@query("p12_squared_error", f"WITH {SIGNALS} SELECT signal_id, "
       + rnd_sql(f"list_sum(list_transform(list_zip(features[1:{HALF}], features[{HALF + 1}:]), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))", 6)
       + " AS error FROM signals")
def p12(spark, sf_dir):
    halves = V.split_iq(signals(spark, sf_dir), "features", HALF)
    return halves.select("signal_id", rnd(V.sq_error("i_part", "q_part"), 6).alias("error"))


@query("w6_prefix_sum", f"WITH {SIGNALS}, t AS (SELECT signal_id, features AS v FROM signals), u AS ({UNNEST}) "
       f"SELECT signal_id, pos, {rnd_sql('sum(value::DOUBLE) OVER (PARTITION BY signal_id ORDER BY pos)', 6)} AS value FROM u")
def w6(spark, sf_dir):
    return long_rows(V.prefix_sum(signals(spark, sf_dir), "features"), "prefix")


@query("p20_payload_size", f"SELECT count(*) AS rows, {rnd_sql('sum(len(embedding)) * 4 / 1000000.0', 6)} AS total_mb, "
       f"{rnd_sql('sum(len(embedding)) * 4 / 1000000.0 / 4.0', 6)} AS mb_per_partition FROM embeddings")
def p20(spark, sf_dir):
    out = payload_mb(table(spark, sf_dir, "embeddings"), "embedding", 4)
    return out.select("rows", rnd("total_mb", 6).alias("total_mb"), rnd("mb_per_partition", 6).alias("mb_per_partition"))


@query("a19_label_histogram", f"WITH {SIGNALS}, {CLASSES_SQL} SELECT class_id, count(signal_id) AS n "
       "FROM (SELECT class_id FROM classes UNION ALL SELECT 10) c LEFT JOIN signals ON label = class_id GROUP BY class_id")
def a19(spark, sf_dir):
    classes = V.class_frame(spark).select("class_id").unionAll(spark.range(10, 11).select(F.col("id").cast("int")))
    return label_histogram(signals(spark, sf_dir), classes)


_PRED = f"WITH {SIGNALS}, preds AS (SELECT label, (list_position(features, list_max(features)) - 1) % 10 AS pred FROM signals)"


def _preds(spark, sf_dir) -> DataFrame:
    out = signals(spark, sf_dir).withColumn("pred", F.pmod(V.argmax("features"), F.lit(10)))
    return out.withColumn("correct", F.col("pred") == F.col("label"))


@query("a3_accuracy", f"{_PRED} SELECT label, count(*) AS n, count(*) FILTER (WHERE pred = label) AS n_correct, "
       + rnd_sql("count(*) FILTER (WHERE pred = label) / count(*)::DOUBLE", 6) + " AS accuracy FROM preds GROUP BY label")
def a3(spark, sf_dir):
    return accuracy(_preds(spark, sf_dir), ["label"]).withColumn("accuracy", rnd("accuracy", 6))


@query("a20_confusion", f"{_PRED} SELECT label, " + ", ".join(
    f"count(*) FILTER (WHERE pred = {k}) AS pred_{k}" for k in LABELS[:-1]) + f", count(*) FILTER (WHERE pred = {LABELS[-1]}) AS pred_other FROM preds GROUP BY label")
def a20(spark, sf_dir):
    """The last label isn't declared, so its predictions are the other ones."""
    return confusion(_preds(spark, sf_dir), LABELS[:-1])
