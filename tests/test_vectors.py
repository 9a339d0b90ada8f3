"""Edge rows of the vector functions."""

import math

import pytest
from pyspark.sql import functions as F

from scorelake.functions import vectors as V


@pytest.fixture(scope="module")
def rows(spark):
    data = [(0, [0.0] * 4, 1), (1, [3.0, 4.0, 0.0, 0.0], 9), (2, [1.0, 2.0, 2.0], None), (3, [5.0, 1.0, 5.0, 0.0], 0), (4, None, 2)]
    return spark.createDataFrame(data, "signal_id int, features array<float>, label bigint")


def test_zero_vector_is_unchanged(rows):
    got = {r["signal_id"]: r["features"] for r in V.l2_normalize(rows, "features").collect()}
    assert got[0] == [0.0] * 4
    assert got[1] == pytest.approx([0.6, 0.8, 0.0, 0.0])
    assert got[4] is None


def test_clamped_normalization_of_zero(rows):
    got = {r["signal_id"]: r["features"] for r in V.l2_normalize(rows, "features", eps=1e-12).collect()}
    assert got[0] == [0.0] * 4


def test_validate_shape_splits_every_row(rows):
    good, rejected = V.validate_shape(rows, "features", [2, 2])
    assert {r["signal_id"] for r in good.collect()} == {0, 1, 3}
    assert {r["signal_id"] for r in rejected.collect()} == {2, 4}


def test_unknown_and_missing_labels_stay(spark, rows):
    got = {r["signal_id"]: r["class_name"] for r in V.decode_labels(rows, V.class_frame(spark)).collect()}
    assert got == {0: "Pulsed_Radar", 1: None, 2: None, 3: "CW_Radar", 4: "FMCW_Radar"}


def test_argmax_takes_the_first_maximum(rows):
    got = {r["signal_id"]: r["m"] for r in rows.select("signal_id", V.argmax("features").alias("m")).collect()}
    assert got[3] == 0 and got[1] == 1 and got[0] == 0


def test_softmax_does_not_overflow(spark):
    df = spark.createDataFrame([([1000.0, 1000.0],), ([-1000.0, 0.0],)], "v array<double>")
    first, second = [r["p"] for r in df.select(V.softmax("v").alias("p")).collect()]
    assert first == [0.5, 0.5] and second[1] == 1.0


def test_wide_round_trip(rows):
    full = rows.where(F.size("features") == 4)
    back = V.to_array(V.to_wide(full, "features", 4), V.wide_names(4))
    assert {r["signal_id"]: r["features"] for r in back.collect()} == {r["signal_id"]: r["features"] for r in full.collect()}


def test_preview_and_prefix_sum(rows):
    one = rows.where("signal_id = 1")
    assert one.select(V.preview("features", 2).alias("p")).first()["p"] == "+3.000 +4.000"
    assert V.prefix_sum(one, "features").first()["prefix"] == [3.0, 7.0, 7.0, 7.0]


def test_squared_error_is_a_sum(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>")
    assert df.select(V.sq_error("a", "b").alias("e")).first()["e"] == 13.0
    assert math.isclose(df.select(V.norm("a").alias("n")).first()["n"], math.sqrt(5))
