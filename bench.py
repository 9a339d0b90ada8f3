"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query is
run to a sink that reads all rows and keeps none; the best of the timed runs
after one warm-up counts.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from scorelake.operators import nets  # noqa: E402
from scorelake.operators import scoring as SC  # noqa: E402
from scorelake.operators.registry import signal_registry  # noqa: E402
from scorelake.plans import all_queries  # noqa: E402
from scorelake.plans.tables import task_signals, wide_signals  # noqa: E402
from scorelake.plans.weights import formula_weights  # noqa: E402
from scorelake.session import get_session, scratch_path, ship_package  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "2"))

HEADLINE = [
    "m7_centroid_confusion", "m1_score_task_signals", "j10_task_star", "a2_samples_with_total", "a5_executor_summary",
    "a7_model_throughput", "a10_speedup_vs_baseline", "a12_batch_latency", "a16_task_share", "a26_overhead", "a27_bottleneck",
    "a30_dashboard_5min", "a33_task_quantiles", "j5_mode_matrix", "j8_dense_grid", "p25_batches", "u4_missing_models",
    "w3_throughput_curve", "w4_rank_runs", "w7_heartbeat_gaps", "w8_stragglers", "w9_regressions", "w10_placement_largest_first",
    "m17_match_embeddings", "t3_dashboard_stream",
]


def stored_signals(spark, sf_dir):
    """A signal per task, written once to several files before anything is timed."""
    if sf_dir not in _stored:
        _stored[sf_dir] = scratch_path(spark, "task_signals")
        task_signals(spark, sf_dir).select("run_id", F.col("features").cast("array<float>")).repartition(4 * CPUS).write.parquet(_stored[sf_dir])
    return spark.read.parquet(_stored[sf_dir])


_stored: dict[str, str] = {}


def classifier_task_signals(spark, sf_dir):
    """One network over a stored signal table: comparable to the one-classifier figures."""
    model = signal_registry({"ew_classifier": formula_weights("ew_classifier")}).models["ew_classifier"]
    return SC.score(stored_signals(spark, sf_dir), model, id_cols=("run_id",), outputs=("pred", "confidence"))


def five_models_task_signals(spark, sf_dir):
    """All five signal networks, the convolutional one included, over the same table."""
    registry = signal_registry({n: formula_weights(n) for n in nets.SIGNAL_MODELS})
    return SC.score_all(stored_signals(spark, sf_dir), registry, id_cols=("run_id",))


def five_models_signals(spark, sf_dir):
    """All five signal networks in one pass over the signal table."""
    registry = signal_registry({n: formula_weights(n) for n in nets.SIGNAL_MODELS})
    return SC.score_all(wide_signals(spark, sf_dir), registry)


def four_models_task_signals(spark, sf_dir):
    """The four dense networks in one pass over a signal per task."""
    registry = signal_registry({n: formula_weights(n) for n in nets.SIGNAL_MODELS if n != "rf_fingerprinter"})
    return SC.score_all(stored_signals(spark, sf_dir), registry, id_cols=("run_id",))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")  # one BLAS thread per task slot
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    shared = tempfile.mkdtemp(prefix="scorelake-bench-")
    spark = get_session(
        "scorelake-bench",
        master=f"local[{CPUS}]",
        conf={
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": shared,
            # Small files: let one file feed every core instead of shuffling it.
            "spark.sql.files.openCostInBytes": str(256 * 1024),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    catalog = all_queries()
    queries = {n: catalog[n] for n in HEADLINE}
    queries |= {f.__name__: f for f in (classifier_task_signals, five_models_signals, four_models_task_signals, five_models_task_signals)}
    only = sys.argv[1:]
    seconds = {}
    for name, fn in queries.items():
        if only and name not in only:
            continue
        times = []
        for _ in range(RUNS + 1):
            begun = time.perf_counter()
            drain(fn(spark, SF_DIR))
            times.append(time.perf_counter() - begun)
        seconds[name] = round(min(times[1:] or times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    rows = {
        "classifier_task_signals": spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count(),
        "five_models_signals": 5 * spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count(),
        "five_models_task_signals": 5 * spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count(),
        "four_models_task_signals": 4 * spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count(),
    }
    rates = {f"{n}_per_sec": round(rows[n] / seconds[n], 1) for n in rows if n in seconds}
    print(
        json.dumps(
            {
                "metric": "total_time_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "throughput": rates,
            }
        )
    )
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)


if __name__ == "__main__":
    main()
