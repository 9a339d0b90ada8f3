"""Queries with order: chunks, batches, lags, ranks, gaps and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import ordered as O
from ..operators.segments import with_row_index
from ..operators.telemetry import with_metric_batches
from .catalog import Catalog, rnd, rnd_sql
from .runs import RUN_TP, mode_tasks, run_tp
from .tables import MODELS, RUNS, TASK_ORDER, TASK_ORDER_SQL, TASKS, TELEMETRY, models, runs, signals, tasks, telemetry

catalog = Catalog()
query = catalog.query
HEAD = f"WITH {RUNS}, {TASKS}, {MODELS}, {TELEMETRY}"


@query("w1_chunks", f"{HEAD}, n AS (SELECT count(*) AS n FROM runs), i AS (SELECT run_id, row_number() OVER (ORDER BY run_ts, run_id) - 1 AS row_idx FROM runs) "
       "SELECT CAST(CASE WHEN n // 7 > 0 THEN least(row_idx // (n // 7), 6) ELSE 6 END AS INTEGER) AS chunk, count(*) AS n, min(row_idx) AS first_row, max(row_idx) AS last_row, sum(run_id)::BIGINT AS ids FROM i, n GROUP BY chunk")
def w1(spark, sf_dir):
    out = O.chunk(runs(spark, sf_dir).select("run_id", "run_ts"), [F.col("run_ts").asc(), F.col("run_id").asc()], 7)
    return out.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row"), F.sum("run_id").alias("ids")
    )


@query("w1_chunks_few_rows", "SELECT r_regionkey, 6 AS chunk FROM region")
def w1_few(spark, sf_dir):
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    return O.chunk(regions, [F.col("r_regionkey").asc()], 7).select("r_regionkey", "chunk")


@query("p25_batches", f"{HEAD}, i AS (SELECT *, row_number() OVER (ORDER BY {TASK_ORDER_SQL}) - 1 AS row_idx FROM tasks) "
       "SELECT row_idx // 256 AS batch_idx, count(*) AS n, sum(samples)::BIGINT AS samples FROM i GROUP BY 1")
def p25(spark, sf_dir):
    out = J.with_batches(tasks(spark, sf_dir).select(*TASK_ORDER), [F.col(c).asc() for c in TASK_ORDER], 256)
    return out.groupBy("batch_idx").agg(F.count("*").alias("n"), F.sum("samples").alias("samples"))


@query("p25_batches_per_model", f"{HEAD}, i AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY {TASK_ORDER_SQL}) - 1 AS row_idx FROM tasks) "
       "SELECT device, row_idx // 256 AS batch_idx, count(*) AS n, sum(samples)::BIGINT AS samples, (SELECT CAST(ceil(count(*) / 256.0) AS BIGINT) FROM tasks t WHERE t.device = i.device) AS batches FROM i GROUP BY device, 2")
def p25_keys(spark, sf_dir):
    t = tasks(spark, sf_dir).select("device", *TASK_ORDER)
    out = J.with_batches(t, [F.col(c).asc() for c in TASK_ORDER], 256, ["device"])
    out = out.groupBy("device", "batch_idx").agg(F.count("*").alias("n"), F.sum("samples").alias("samples"))
    totals = t.groupBy("device").agg(J.batch_count(F.count("*"), 256).alias("batches"))
    return out.join(totals, "device")


@query("k5_metric_batches", f"{HEAD}, i AS (SELECT metric, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM telemetry) "
       f"SELECT row_idx // 1000 AS batch_no, count(*) AS n, {rnd_sql('sum(value)')} AS total FROM i GROUP BY 1")
def k5(spark, sf_dir):
    out = with_metric_batches(telemetry(spark, sf_dir).select("event_id", "ts", "value"), [F.col("ts").asc(), F.col("event_id").asc()])
    return out.groupBy("batch_no").agg(F.count("*").alias("n"), rnd(F.sum("value")).alias("total"))


@query("w2_cold_warm", f"{HEAD}, o AS (SELECT *, row_number() OVER (PARTITION BY executor_id ORDER BY {TASK_ORDER_SQL}) AS rn FROM tasks), "
       "c AS (SELECT executor_id, max(load_time) FILTER (WHERE rn = 1) AS cold, coalesce(avg(load_time) FILTER (WHERE rn > 1), 0) AS warm FROM o GROUP BY executor_id) "
       f"SELECT executor_id, {rnd_sql('cold', 9)} AS cold_load, {rnd_sql('warm', 9)} AS warm_load, {rnd_sql('CASE WHEN warm > 0 THEN cold / warm ELSE 0 END', 9)} AS cold_warm_ratio FROM c")
def w2(spark, sf_dir):
    out = O.cold_warm(tasks(spark, sf_dir), TASK_ORDER)
    return out.withColumns({c: rnd(c, 9) for c in ("cold_load", "warm_load", "cold_warm_ratio")})


@query("w2_unmeasured_first", f"{HEAD}, o AS (SELECT *, row_number() OVER (PARTITION BY executor_id ORDER BY {TASK_ORDER_SQL}) AS rn FROM tasks), "
       "c AS (SELECT executor_id, coalesce(avg(load_time) FILTER (WHERE rn > 1 AND executor_id % 2 = 0 OR rn > 1), 0) AS warm, "
       "max(load_time) FILTER (WHERE rn = 1 AND executor_id % 2 = 1) AS cold FROM o GROUP BY executor_id) "
       f"SELECT executor_id, {rnd_sql('cold', 9)} AS cold_load, {rnd_sql('warm', 9)} AS warm_load FROM c")
def w2_unmeasured(spark, sf_dir):
    """On every second executor the first load wasn't measured."""
    t = tasks(spark, sf_dir)
    first = t.groupBy("executor_id").agg(F.min(F.struct(*TASK_ORDER)).alias("_first"))
    t = t.join(first, "executor_id")
    is_first = (F.struct(*TASK_ORDER) == F.col("_first")) & (F.col("executor_id") % 2 == 0)
    t = t.withColumn("load_time", F.when(~is_first, F.col("load_time")))
    return O.cold_warm(t, TASK_ORDER).select("executor_id", rnd("cold_load", 9).alias("cold_load"), rnd("warm_load", 9).alias("warm_load"))


TP = f"{HEAD}, {RUN_TP}"


@query("w3_throughput_curve", f"{TP} SELECT run_id, device_mode, samples, {rnd_sql('throughput - lag(throughput) OVER (PARTITION BY device_mode ORDER BY samples, run_id)', 8)} AS change FROM run_tp")
def w3(spark, sf_dir):
    out = O.throughput_curve(run_tp(spark, sf_dir).select("run_id", "device_mode", "samples", "throughput"), ["samples", "run_id"])
    return out.select("run_id", "device_mode", "samples", rnd("change", 8).alias("change"))


@query("w4_rank_runs", f"{TP} SELECT run_id, device_mode, rank() OVER (PARTITION BY device_mode ORDER BY samples DESC) AS rank, dense_rank() OVER (PARTITION BY device_mode ORDER BY samples DESC) AS dense_rank FROM run_tp")
def w4(spark, sf_dir):
    return O.rank_runs(run_tp(spark, sf_dir), value="samples").select("run_id", "device_mode", "rank", "dense_rank")


@query("w5_number_runs", f"{HEAD} SELECT run_id, row_number() OVER (ORDER BY run_ts, run_id) AS run_number FROM runs")
def w5(spark, sf_dir):
    return O.number_runs(runs(spark, sf_dir).select("run_id", "run_ts"), [F.col("run_ts").asc(), F.col("run_id").asc()]).select("run_id", "run_number")


@query("w7_heartbeat_gaps", f"{HEAD}, g AS (SELECT event_id, executor_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY executor_id ORDER BY ts, event_id) AS gap FROM telemetry) "
       f"SELECT event_id, executor_id, {rnd_sql('gap / 1000000.0::DOUBLE', 3)} AS gap_s FROM g WHERE gap > 60000000")
def w7(spark, sf_dir):
    out = O.heartbeat_gaps(telemetry(spark, sf_dir).select("event_id", "executor_id", "ts"), 60)
    return out.select("event_id", "executor_id", rnd("gap_s", 3).alias("gap_s"))


@query("w8_stragglers", f"{HEAD}, m AS (SELECT *, median(inference_time) OVER (PARTITION BY run_id) AS med FROM tasks) SELECT {TASK_ORDER_SQL}, {rnd_sql('med')} AS median_time FROM m WHERE inference_time > 1.5 * med")
def w8(spark, sf_dir):
    out = O.stragglers(tasks(spark, sf_dir), ["run_id"], "inference_time")
    return out.select(*TASK_ORDER, rnd("median_time").alias("median_time"))


@query("w9_regressions", f"{TP}, b AS (SELECT *, max(throughput) OVER (PARTITION BY device_mode ORDER BY run_ts, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS baseline FROM run_tp) "
       f"SELECT run_id, device_mode, {rnd_sql('throughput', 8)} AS throughput, {rnd_sql('baseline', 8)} AS baseline FROM b WHERE throughput < 0.8 * baseline")
def w9(spark, sf_dir):
    out = O.regressions(run_tp(spark, sf_dir).select("run_id", "device_mode", "run_ts", "throughput"), [F.col("run_ts").asc(), F.col("run_id").asc()])
    return out.select("run_id", "device_mode", rnd("throughput", 8).alias("throughput"), rnd("baseline", 8).alias("baseline"))


@query("l1_sorted", f"{HEAD} SELECT node, name, model_id, memory_mb FROM models ORDER BY node, name, model_id")
def l1(spark, sf_dir):
    return O.sorted_by(models(spark, sf_dir).select("node", "name", "model_id", "memory_mb"), "node", "name", "model_id")


@query("l2_first_stages", f"{HEAD} SELECT run_id, count(*) AS tasks FROM tasks GROUP BY run_id ORDER BY run_id LIMIT 20")
def l2(spark, sf_dir):
    stages = tasks(spark, sf_dir).groupBy("run_id").agg(F.count("*").alias("tasks"))
    return O.first_stages(stages, [F.col("run_id").asc()])


@query("l3_top_runs", f"{TP} SELECT device_mode, run_id, samples, row_number() OVER (PARTITION BY device_mode ORDER BY throughput DESC, run_id) AS rn FROM run_tp QUALIFY rn <= 3")
def l3(spark, sf_dir):
    out = O.top_runs(run_tp(spark, sf_dir), 3, [F.col("throughput").desc(), F.col("run_id").asc()])
    return out.select("device_mode", "run_id", "samples", F.col("rn").cast("long").alias("rn"))


# Batch numbers of the signals themselves, as the scoring loop would cut them.
@query("p25_signal_batches", "SELECT vec_id AS signal_id, (row_number() OVER (ORDER BY vec_id) - 1) // 64 AS batch_idx FROM embeddings")
def p25_signals(spark, sf_dir):
    out = J.with_batches(signals(spark, sf_dir).select("signal_id"), [F.col("signal_id").asc()], 64)
    return out.select("signal_id", "batch_idx")


@query("j7_batch_membership", f"{HEAD}, {'mode_tasks AS (SELECT tasks.*, category AS model FROM tasks JOIN models USING (model_id))'}, i AS (SELECT model, (row_number() OVER (PARTITION BY model ORDER BY {TASK_ORDER_SQL}) - 1) // 512 AS batch_idx FROM mode_tasks) "
       "SELECT batch_idx, count(DISTINCT model) AS models, count(*) AS rows FROM i GROUP BY batch_idx")
def j7_rows(spark, sf_dir):
    t = with_row_index(mode_tasks(spark, sf_dir).select("model", *TASK_ORDER), [F.col(c).asc() for c in TASK_ORDER], ["model"])
    t = t.withColumn("batch_idx", F.floor(F.col("row_idx") / 512))
    per = t.groupBy("batch_idx", "model").agg(F.count("*").alias("n"))
    return per.groupBy("batch_idx").agg(F.count("*").alias("models"), F.sum("n").alias("rows"))
