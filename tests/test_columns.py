"""Scalar rules, defaults and time texts."""

from pyspark.sql import functions as F

from scorelake.functions import columns as C
from scorelake.operators import filters as FL
from scorelake.operators.joins import band_of


def test_safe_ratio_never_divides_by_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, -2.0), (1.0, None), (3.0, 2.0)], "x double, t double")
    assert [r[0] for r in df.select(C.safe_ratio("x", "t")).collect()] == [0.0, 0.0, 0.0, 1.5]


def test_host_of_missing(spark):
    df = spark.createDataFrame([("h:1",), (None,), ("",), ("plain",)], "p string")
    assert [r[0] for r in df.select(C.host_of("p")).collect()] == ["h", "unknown", "unknown", "plain"]


def test_time_texts(spark):
    df = spark.createDataFrame([("2026-07-20T01:40:09.113GMT", "2026-07-20T01:40:10.613GMT"), ("2026-07-20T01:40:09.000001", "2026-07-20T01:40:09.500002")], "a string, b string")
    got = [r[0] for r in df.select(C.duration_s(C.parse_time("a"), C.parse_time("b"))).collect()]
    assert got == [1.5, 0.500001]


def test_later_dimensions_win(spark):
    df = spark.sql("SELECT map('r', 'a', 'i', '1') AS x, CAST(NULL AS MAP<STRING, STRING>) AS y, map('r', 'b') AS z")
    assert df.select(C.merge_dims("x", "y", "z").alias("m")).first()["m"] == {"i": "1", "r": "b"}


def test_map_default(spark):
    df = spark.sql("SELECT map('a', 1L) AS m UNION ALL SELECT NULL")
    assert [r[0] for r in df.select(C.map_get("m", "a")).collect()] == [1, 0]
    assert [r[0] for r in df.select(C.map_get("m", "b")).collect()] == [0, 0]


def test_megabytes_keep_their_conventions(spark):
    row = spark.range(1).select(C.mb(F.lit(1_000_000)), C.mb(F.lit(1024 * 1024), binary=True)).first()
    assert tuple(row) == (1.0, 1.0)


def test_run_tag(spark):
    row = spark.range(1).select(C.run_tag(*[F.lit(v) for v in (5000, 50, 10, 4)], mode=F.lit("all"), run_name=F.lit("r"))).first()
    assert row[0] == "r_all_sig5000_img50_det10_p4"


def test_partition_sizing(spark):
    df = spark.createDataFrame([(1,), (3000 * 1024 * 1024,), (299 * 1024 * 1024 * 4,)], "payload_bytes bigint")
    assert [r["partitions"] for r in FL.plan_partitions(df, 4).collect()] == [4, 10, 4]


def test_bands_include_their_upper_limit(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (9.0,)], "x double")
    assert [r[0] for r in df.select(band_of("x", [(1.0, "a"), (2.0, "b"), (None, "c")])).collect()] == ["a", "b", "c"]


def test_filters(spark):
    runs = spark.createDataFrame([(1, [1], None), (2, [], "x"), (3, None, None)], "run_id int, partition_details array<int>, error string")
    assert [r["run_id"] for r in FL.with_details(runs).collect()] == [1]
    assert [r["run_id"] for r in FL.ok_runs(runs).collect()] == [1, 3]


def test_rounding_goes_by_decimal_text(spark):
    df = spark.createDataFrame([(2.675, 0.25, 1.00005)], "ms double, tp double, s double")
    row = df.select(C.round_ms("ms").alias("ms"), C.round_tp("tp").alias("tp"), C.round_s("s").alias("s")).first()
    assert tuple(row) == (2.68, 0.3, 1.0001)


def test_bands_from_a_table(spark, capfd):
    """Overlapping, open, empty and reversed bands of all widths, with a hot value, against a direct loop."""
    import random

    from scorelake.operators.joins import in_bands

    rng = random.Random(4)
    bands = [(i, x := rng.uniform(-50, 50), x + 2.0 ** rng.randint(-40, 6)) for i in range(300)]
    bands += [(900, None, 0.0), (901, 10.0, None), (902, None, None), (903, 5.0, 5.0), (904, 6.0, 2.0), (905, 1e300, 1e301), (906, 7.0, 7.0 + 1e-12), (907, -1e9, 1e9)]
    values = [rng.uniform(-60, 60) for _ in range(400)] + [7.0] * 300 + [None, float("nan"), 0.0, -0.0, 10.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    table = spark.createDataFrame(bands, "band int, low double, high double")
    out = in_bands(df, "v", table)
    want = sorted((i, b) for i, v in enumerate(values) if v is not None and v == v for b, lo, hi in bands if (lo is None or v >= lo) and (hi is None or v < hi))
    assert sorted((r["id"], r["band"]) for r in out.collect()) == want
    assert in_bands(df, "v", table.limit(0)).count() == in_bands(df.limit(0), "v", table).count() == 0


def test_bands_are_counted_without_their_pairs(spark):
    """The same figures as those of the pairs; and bands whose pairs are too many to build."""
    import random

    from pyspark.sql import functions as F

    from scorelake.operators.joins import in_bands

    rng = random.Random(5)
    bands = [(i % 250, x := rng.uniform(-50, 50), x + 2.0 ** rng.randint(-40, 6)) for i in range(300)]
    bands += [(900, None, 0.0), (901, 10.0, None), (902, None, None), (903, 5.0, 5.0), (904, 6.0, 2.0), (905, 1e300, 1e301), (906, 7.0, 7.0 + 1e-12), (907, -1e9, 1e9), (None, 0.0, 3.0), (908, -0.0, 1.0)]
    values = [rng.uniform(-60, 60) for _ in range(400)] + [7.0] * 300 + [None, float("nan"), 0.0, -0.0, 10.0, 1e18, -1e18]
    df, table = spark.createDataFrame([(v,) for v in values], "v double"), spark.createDataFrame(bands, "band int, low double, high double")
    pairs = {r["band"]: (r["n"], r["s"]) for r in in_bands(df, "v", table).groupBy("band").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
    found = {r["band"]: (r["n"], r["total"]) for r in in_bands(df, "v", table, by=["band"]).collect()}
    assert {b: n for b, (n, _) in found.items()} == {b: n for b, (n, _) in pairs.items()}
    # The great values are in bands 901, 902 and those without them only.
    assert all(abs(found[b][1] - s) <= 1e-9 * max(1, abs(s)) for b, (_, s) in pairs.items() if b not in (900, 902))
    assert in_bands(df, "v", table.limit(0), by=["band"]).count() == in_bands(df.limit(0), "v", table, by=["band"]).count() == 0
    many = in_bands(spark.range(200_000).select((F.col("id") % 1000).cast("double").alias("v")), "v", spark.range(100_000).selectExpr("id AS band", "0.0 AS low", "1e6 AS high"), by=["band"])
    assert many.agg(F.sum("n")).first()[0] == 20_000_000_000


def test_a_hundred_thousand_bands_meet_by_cell(spark, capfd):
    from pyspark.sql import functions as F

    from scorelake.operators.joins import in_bands

    bands = spark.range(100_000).select(F.col("id").alias("band"), (F.col("id") / 7).alias("low"), ((F.col("id") + 1) / 7).alias("high"))
    df = spark.range(200_000).select((F.col("id") % 100_000 / 7 + 0.01).alias("v"))
    out = in_bands(df, "v", bands)
    capfd.readouterr()
    out.explain()
    plan = capfd.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    counts = out.groupBy("band").count()
    assert counts.count() == 100_000 and counts.where("count <> 2").count() == 0
