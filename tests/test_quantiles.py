"""Exact percentiles against numpy."""

import numpy as np
import pytest

from scorelake.operators import quantiles
from scorelake.operators.quantiles import exact_percentiles
from scorelake.operators.runs import latency

QS = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}


@pytest.mark.parametrize("seed, n", [(0, 1), (1, 2), (2, 7), (3, 9_999), (4, 10_001), (5, 60_000)])
def test_percentiles_equal_numpy(spark, seed, n):
    rng = np.random.default_rng(seed)
    values = np.round(rng.lognormal(size=n), 3)
    keys = np.where(rng.random(n) < 0.34, "hot", rng.integers(0, 5, n).astype(str))
    import pandas as pd

    pdf = pd.DataFrame({"k": keys, "v": values})
    got = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(pdf), ["k"], "v", QS).collect()}
    for key, group in pdf.groupby("k"):
        for name, q in QS.items():
            assert got[key][name] == pytest.approx(np.percentile(group["v"], q * 100), abs=1e-12)
    overall = exact_percentiles(spark.createDataFrame(pdf), [], "v", QS).first()
    for name, q in QS.items():
        assert overall[name] == pytest.approx(np.percentile(values, q * 100), abs=1e-12)


def test_one_value_fills_the_group(spark):
    df = spark.range(50_000).selectExpr("CASE WHEN id % 3 = 0 THEN 1.0D ELSE 5.0D END AS v")
    row = exact_percentiles(df, [], "v", {"a": 0.2, "b": 0.5}).first()
    assert (row["a"], row["b"]) == (1.0, 5.0)


def test_latency_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None)], "k string, s double")
    row = latency(df, ["k"], "s").first()
    assert (row["n"], row["avg_ms"], row["p99_ms"]) == (0, 0.0, 0.0)


def test_doubles_of_every_kind(spark):
    """Random bit patterns, subnormal, infinite and neighbouring values, zeros of both signs."""
    rng = np.random.default_rng(7)
    groups = {
        "bits": rng.integers(-(2**63), 2**63 - 1, 3000).view(np.float64),
        "powers": np.array([s * np.nextafter(2.0**e, d) for e in range(-1073, 1023, 37) for d in (0, np.inf) for s in (-1, 1)]),
        "exact": np.array([s * 2.0**e for e in range(-1074, 1024) for s in (-1, 1)]),
        "near": 1.0 + rng.integers(0, 5000, 4000) * 2.0**-52,
        "low": -(rng.integers(0, 300, 1000) * 5e-324),
        "zeros": np.array([0.0, -0.0, 0.0, 5e-324, -5e-324]),
        "ends": np.array([np.inf, -np.inf, 1.7e308, -1.7e308, 1.0, np.inf]),
    }
    groups["bits"] = groups["bits"][~np.isnan(groups["bits"])]
    rows = [(k, float(v)) for k, values in groups.items() for v in values]
    exact = {"min": 0.0, "max": 1.0}
    for k, values in groups.items():
        # Ranks without a fraction, so that nothing is interpolated.
        exact |= {f"{k}_{i}": i / (len(values) - 1) for i in rng.integers(0, len(values), 6).tolist()}
    got = {r["k"]: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", exact).collect()}
    for k, values in groups.items():
        ordered = np.sort(values)
        for name, q in exact.items():
            at = q * (len(values) - 1)
            if float(at).is_integer():
                assert got[k][name] == ordered[int(at)] or np.isnan(got[k][name]) and np.isinf(ordered[int(at)]), (k, name)


def test_nan_is_the_greatest_and_null_keys_are_a_key(spark):
    rows = [(None, 1.0), (None, float("nan")), (None, None), (None, 2.0), ("a", None)]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}).collect()
    assert len(got) == 1 and got[0]["k"] is None and (got[0]["p0"], got[0]["p50"]) == (1.0, 2.0) and np.isnan(got[0]["p100"])


def test_a_hot_key_stays_split(spark, monkeypatch):
    """Five million rows of one key: counts are combined before they move, and no row is sorted by value."""
    plans = []

    def stored(df):
        plans.append(df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")))
        return quantiles.cut_lineage_of(df)

    monkeypatch.setattr(quantiles, "cut_lineage_of", quantiles.cut_lineage, raising=False)
    monkeypatch.setattr(quantiles, "cut_lineage", stored)
    df = spark.range(5_000_000).selectExpr("'hot' AS k", "cast((id * 7919) % 5000011 AS double) / 3 AS v")
    row = exact_percentiles(df, ["k"], "v", QS).first()
    assert not any("rangepartitioning" in p for p in plans)
    assert sum("Range (0, 5000000" in p for p in plans) >= 2
    for p in plans:
        if "Range (0, 5000000" in p:
            # The scan's rows are counted below the first exchange above them, and open buckets are broadcast.
            below = p[p.rindex("Exchange hashpartitioning") :]
            assert "partial_count" in below and "SortMergeJoin" not in p and "Sort " not in below
    values = (np.arange(5_000_000, dtype=np.int64) * 7919 % 5000011) / 3
    for name, q in QS.items():
        assert row[name] == pytest.approx(np.percentile(values, q * 100), abs=1e-9)


def test_stored_sketches_merge_within_their_error(spark):
    """Two hundred sketches of unequal parts, merged; ranks against the exact ones."""
    df = spark.range(400_000).selectExpr("id % 3 AS k", "floor(sqrt(id % 40000)) AS day", "pow(xxhash64(id) % 100000 / 100000D, 3) AS v")
    stored = quantiles.sketch_values(df, ["k", "day"], "v")
    assert stored.selectExpr("max(octet_length(sketch))").first()[0] < 50_000
    said = quantiles.merged_percentiles(stored, ["k"], {"p1": 0.01, "p50": 0.5, "p999": 0.999}).collect()
    pdf = df.toPandas()
    for row in said:
        values = np.sort(pdf.loc[pdf["k"] == row["k"], "v"].to_numpy())
        assert row["n"] == len(values)
        for name, q in (("p1", 0.01), ("p50", 0.5), ("p999", 0.999)):
            rank = np.searchsorted(values, row[name], side="right") / len(values)
            assert abs(rank - q) <= 2 * quantiles.sketch_error(), (name, rank)
