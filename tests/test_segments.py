"""Ordered operators against plain windows, with one key holding a third of the rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scorelake.operators import ordered as O
from scorelake.operators import segments as S
from scorelake.operators.joins import align_batches


@pytest.fixture(scope="module", autouse=True)
def many_segments(spark):
    """Small data would be merged into one segment; keep them apart here."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.fixture(scope="module")
def rows(spark, many_segments):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 101 == 1, F.lit(None)).otherwise((F.col("id") % 40).cast("string"))
    value = F.when(F.col("id") % 5 == 0, F.lit(7.0)).otherwise((F.xxhash64("id") % 1000).cast("double"))
    return spark.range(6000).select(F.col("id"), key.alias("key"), value.alias("value")).cache()


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_row_index(rows):
    w = Window.partitionBy("key").orderBy("value", "id")
    want = rows.select("id", (F.row_number().over(w) - 1).cast("long").alias("row_idx"))
    same(S.with_row_index(rows, [F.col("value").asc(), F.col("id").asc()], ["key"]).select("id", F.col("row_idx").cast("long")), want)


def test_one_range_exchange_and_no_other_of_the_table(rows, capfd):
    """A hot key spans segments; what is shuffled after them has a row or two for each."""
    order = [F.col("value").asc(), F.col("id").asc()]
    walked = S._walked(rows, ["key"], order, {}, True, None)
    assert walked.where("key = 'hot'").select(S.SEG).distinct().count() > 1
    for out in (S.with_row_index(rows, order, ["key"]), S.lag_over(rows, ["key"], order, {"p": "value"}), S.running_before(rows, ["key"], order, "value")):
        out.explain()
        plan = capfd.readouterr().out
        # Only the segments' edges meet by key, and they are what is broadcast.
        assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and "rangepartitioning" not in plan
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Window") == 1


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_batches_of_any_size_and_all_kinds_of_keys(spark, rows_a_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        key = F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 7 < 4, F.lit(None)).otherwise((F.col("id") % 3).cast("double"))
        few = spark.range(300).select("id", key.alias("k"), (F.col("id") % 2 == 0).alias("b"), F.when(F.col("id") % 5 > 0, (F.xxhash64("id") % 50)).alias("n"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
        few = few.cache()
        w = Window.partitionBy("k", "b").orderBy(F.desc("id"))
        order, upto = [F.col("id").desc()], w.rowsBetween(Window.unboundedPreceding, -1)
        want = few.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("row_idx"))
        same(S.with_row_index(few, order, ["k", "b"]), want)
        want = few.select("*", F.lag("d").over(w).alias("day"), F.lag("k").over(w).alias("prev"))
        same(S.lag_over(few, ["k", "b"], order, {"day": "d", "prev": "k"}), want)
        want = few.select("*", F.count("n").over(upto).alias("prev_n"), F.sum("n").over(upto).alias("prev_sum"), F.max("n").over(upto).alias("prev_max"))
        got = S.running_before(few, ["k", "b"], order, "n")
        assert got.dtypes == want.dtypes
        same(got, want)
        same(S.with_row_index(few, order), few.select("*", (F.lit(299) - F.col("id")).alias("row_idx")))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("rows_a_batch", [3, 10_000])
def test_running_xor(spark, rows, rows_a_batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        some = rows.select("id", "key", F.xxhash64("id").alias("x"), (F.col("id") * 3).alias("y"))
        w = Window.partitionBy("key").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
        want = some.select("*", *[F.coalesce(F.bit_xor(c).over(w), F.lit(0)).alias(f"prev_{c}") for c in ("x", "y")])
        same(S.running_xor_before(some, ["key"], [F.col("id").asc()], ["x", "y"]), want)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_index_keeps_the_columns_asked_for(rows):
    got = S.with_row_index(rows, [F.col("value").asc(), F.col("id").asc()], ["key"], keep=["key", "id"])
    assert got.columns == ["key", "id", "row_idx"]
    same(got, S.with_row_index(rows, [F.col("value").asc(), F.col("id").asc()], ["key"]).select(*got.columns))


def test_no_rows(spark):
    none = spark.range(0).withColumn("k", F.lit("x"))
    order = [F.col("id").asc()]
    assert S.with_row_index(none, order, ["k"]).collect() == S.lag_over(none, ["k"], order, {"p": "id"}).collect() == []
    assert S.running_before(none, ["k"], order, "id").collect() == []


def test_lag(rows):
    w = Window.partitionBy("key").orderBy("value", "id")
    want = rows.select("id", F.lag("value").over(w).alias("p"))
    same(S.lag_over(rows, ["key"], [F.col("value").asc(), F.col("id").asc()], {"p": "value"}).select("id", "p"), want)


def test_running_descending(rows):
    w = Window.partitionBy("key").orderBy(F.desc("value"), "id").rowsBetween(Window.unboundedPreceding, -1)
    want = rows.select("id", F.count("value").over(w).alias("n"), F.sum("value").over(w).alias("s"), F.max("value").over(w).alias("m"))
    got = S.running_before(rows, ["key"], [F.col("value").desc(), F.col("id").asc()], "value")
    same(got.select("id", F.col("prev_n").alias("n"), F.col("prev_sum").alias("s"), F.col("prev_max").alias("m")), want)


def test_ranks_with_a_tie_of_a_fifth_of_the_rows(rows):
    w = Window.partitionBy("key").orderBy(F.desc("value"))
    want = rows.select("id", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"))
    got = O.rank_runs(rows, "key", "value")
    same(got.select("id", F.col("rank").cast("long").alias("r"), F.col("dense_rank").cast("long").alias("d")), want)


@pytest.mark.parametrize("n, p", [(0, 4), (3, 4), (4, 4), (10, 4), (103, 7)])
def test_chunks(spark, n, p):
    got = {r["id"]: r["chunk"] for r in O.chunk(spark.range(n), [F.col("id").asc()], p).collect()}
    size = n // p
    want = {}
    for i in range(p):
        start = i * size
        end = start + size if i < p - 1 else n
        want.update({k: i for k in range(start, end)})
    assert got == want


def test_batches_of_unequal_models(spark):
    lengths = {"a": 10, "b": 4, "c": 9, "d": 0, "e": 4}
    sizes = spark.createDataFrame(list(lengths.items()), "model string, n_rows bigint")
    want = {}
    for n in lengths.values():
        for k in range(-(-n // 4)):
            m, r = want.get(k, (0, 0))
            want[k] = (m + 1, r + min(4, n - 4 * k))
    got = {r["batch_idx"]: (r["models"], r["rows"]) for r in align_batches(sizes, 4).collect()}
    assert got == want


def test_gaps_and_stragglers(spark):
    beats = spark.sql("SELECT 1 AS executor_id, id AS event_id, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0, CAST(id * id AS DECIMAL(8,2))) AS ts FROM range(40)")
    got = O.heartbeat_gaps(beats, 60).select("event_id").collect()
    assert {r[0] for r in got} == {k for k in range(1, 40) if 2 * k - 1 > 60}
    t = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (2, 5.0)], "run_id int, t double")
    assert [(r["run_id"], r["t"]) for r in O.stragglers(t, ["run_id"], "t").collect()] == [(1, 2.0)]
