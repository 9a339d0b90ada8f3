"""Nearest gallery rows against brute force, with a hot cluster."""

import numpy as np
import pandas as pd
import pytest

from scorelake.operators import matching as M


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(600, 8))
    base[:200] = base[0] + 0.05 * rng.normal(size=(200, 8))  # a third sits together
    base[5] = base[6]  # an exact duplicate
    return base / np.linalg.norm(base, axis=1, keepdims=True)


def brute(q, g, k, skip_self):
    sims = q @ g.T
    if skip_self:
        np.fill_diagonal(sims, -np.inf)
    best = np.sort(-sims, axis=1)[:, :k]
    return -best


@pytest.mark.parametrize("k, skip_self", [(1, True), (4, False)])
def test_equals_brute_force(spark, monkeypatch, vectors, k, skip_self):
    monkeypatch.setattr(M, "BLOCK_ROWS", 32)
    monkeypatch.setattr(M, "PIVOT_SHARE", 1 / 4)
    q = spark.createDataFrame(pd.DataFrame({"signal_id": np.arange(600), "features": list(vectors)}))
    g = q.withColumnRenamed("signal_id", "gallery_id")
    got = M.match_embeddings(q, g, k, skip_self=skip_self).toPandas()
    assert len(got) == 600 * k
    got = got.sort_values(["signal_id", "similarity"], ascending=[True, False])
    want = brute(vectors, vectors, k, skip_self)
    assert np.allclose(got["similarity"].to_numpy().reshape(600, k), want, atol=1e-9)
    real = (vectors[got["signal_id"]] * vectors[got["gallery_id"]]).sum(axis=1)
    assert np.allclose(real, got["similarity"], atol=1e-9)


def test_empty_gallery(spark, vectors):
    q = spark.createDataFrame(pd.DataFrame({"signal_id": np.arange(5), "features": list(vectors[:5])}))
    assert M.match_embeddings(q, q.withColumnRenamed("signal_id", "gallery_id").limit(0)).count() == 0


def test_lengths_do_not_matter_and_a_floor_holds(spark, vectors):
    scaled = vectors * np.linspace(0.5, 9.0, len(vectors))[:, None]
    scaled[17] = 0
    q = spark.createDataFrame(pd.DataFrame({"signal_id": np.arange(600), "features": list(scaled)}))
    g = q.withColumnRenamed("signal_id", "gallery_id")
    got = M.match_embeddings(q, g, 3, skip_self=True, min_similarity=0.9).toPandas()
    sims = vectors @ vectors.T
    sims[17] = sims[:, 17] = -1
    np.fill_diagonal(sims, -1)
    want = np.minimum((sims >= 0.9).sum(axis=1), 3)
    assert (got.groupby("signal_id").size().reindex(range(600), fill_value=0).to_numpy() == want).all()
    assert (got["similarity"] >= 0.9).all()


def near_frames(spark, rng, n, noise=0.6, asked=300, width=64):
    gallery = rng.normal(size=(n, width))
    gallery /= np.linalg.norm(gallery, axis=1, keepdims=True)
    # Cosines of about 0.86 with the row that was received again, where unrelated rows have 0.5 at most.
    queries = gallery[:asked] + noise * rng.normal(size=(asked, width)) / np.sqrt(width)
    g = spark.createDataFrame(pd.DataFrame({"gallery_id": np.arange(n), "features": list(gallery)}))
    return spark.createDataFrame(pd.DataFrame({"signal_id": np.arange(asked), "features": list(queries)})), g, queries, gallery


def test_recall_of_the_probed_search_holds_and_its_work_does_not_grow(spark, monkeypatch):
    rng, met = np.random.default_rng(5), {}
    visit = M._visit

    def counted(asked, stock, *rest):
        met[size] = asked.join(stock.groupBy("cell", "block").count(), ["cell", "block"]).agg({"count": "sum"}).first()[0] / 300
        return visit(asked, stock, *rest)

    monkeypatch.setattr(M, "_visit", counted)
    for size in (4_000, 32_000):
        q, g, queries, gallery = near_frames(spark, rng, size)
        found = M.match_near(q, g, bucket_rows=64).toPandas().set_index("signal_id")
        sims = queries @ gallery.T / np.linalg.norm(queries, axis=1)[:, None]
        best = sims.argmax(axis=1)
        recall = np.mean([found["gallery_id"].get(i, -1) == b for i, b in enumerate(best)])
        assert recall >= 0.9, (size, recall)
        hit = found.index.to_numpy()
        assert np.allclose(found["similarity"], sims[hit, found["gallery_id"]], atol=1e-9)
    assert met[32_000] < 1.5 * met[4_000] and met[32_000] < 0.7 * 32_000 * M.TABLES


def test_probed_search_of_equal_rows_ties_and_empty_sides(spark, vectors):
    rows = np.concatenate([np.repeat(vectors[:1], 5000, axis=0), vectors])
    g = spark.createDataFrame(pd.DataFrame({"gallery_id": np.arange(len(rows)), "features": list(rows)}))
    q = g.withColumnRenamed("gallery_id", "signal_id").where("signal_id < 40 or signal_id > 5000")
    got = M.match_near(q, g, 3, skip_self=True, min_similarity=0.9999999, bucket_rows=10_000).toPandas()
    for i, best in got.sort_values(["signal_id", "gallery_id"]).groupby("signal_id")["gallery_id"]:
        same = [j for j in (*range(8), 5000) if j != i] if i < 5000 else None
        assert same is None or best.tolist() == same[:3]
    assert set(got["signal_id"]) >= set(range(40)) and (got["signal_id"] != got["gallery_id"]).all()
    assert M.match_near(q, g.limit(0)).count() == M.match_near(q.limit(0), g).count() == 0


def test_probe_order_is_by_the_sum_of_squared_margins():
    rng = np.random.default_rng(2)
    for bits in (1, 2, 5, 9):
        margins = rng.random(bits)
        cost = lambda m: sum(margins[i] ** 2 for i in range(bits) if m >> i & 1)  # noqa: B023, E731
        masks = M.probe_order(margins, 1 << bits)
        assert sorted(masks) == list(range(1 << bits))
        assert np.allclose([cost(m) for m in masks], sorted(cost(m) for m in range(1 << bits)))
        assert M.probe_order(margins, 3) == masks[:3]


def test_recall_counts_what_was_found(spark):
    exact = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 8)], "signal_id bigint, gallery_id bigint")
    row = M.match_recall(exact.where("gallery_id <> 6"), exact).first()
    assert (row["n"], row["n_found"], row["recall"]) == (4, 3, 0.75)
    assert M.match_recall(exact, exact.limit(0)).first()["recall"] == 0.0


def test_copies_of_a_vector_leave_the_hashing_a_few_at_a_time(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    df = spark.range(600, numPartitions=1).select(F.col("id").alias("signal_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i)).alias("features"))
    hashed = M._hashed(df, "signal_id", "features", 16, 6, 10, 32)
    assert hashed.count() == 600 * 6 * 32
    plain = type("Plain", (), {"sparkSession": spark, "mapInArrow": lambda self, run, schema: run})()
    run = M._hashed(plain, "signal_id", "features", 16, 6, 10, 32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array([[float(i + k) for k in range(16)] for i in range(600)], pa.list_(pa.float64()))], names=["signal_id", "features"])
    made = [b.num_rows for b in run([batch])]
    assert sum(made) == 600 * 6 * 32 and max(made) <= 2048


def test_the_best_of_a_row_with_ties_as_by_a_full_sort():
    rng = np.random.default_rng(3)
    ids = rng.permutation(60)
    for k in (1, 2, 5, 59, 60, 90):
        sims = rng.integers(0, 6, (40, 60)) / 5.0
        sims[::3, ::4] = -np.inf
        sims[5] = -np.inf
        order = np.lexsort((np.broadcast_to(ids, sims.shape), -sims), axis=1)[:, :k]
        found, value = M._top(sims, ids, k)
        assert (found == ids[order]).all() and (value == np.take_along_axis(sims, order, axis=1)).all()


def stored_by(monkeypatch):
    """What cut_lineage is asked to store: (plan, stored table), in order."""
    seen, cut = [], M.cut_lineage

    def noted(df):
        seen.append((df._jdf.queryExecution().executedPlan().toString(), cut(df)))
        return seen[-1][1]

    monkeypatch.setattr(M, "cut_lineage", noted)
    return seen


def kept_paths(seen):
    import os

    return [df.__dict__["_stored_path"] for _, df in seen if os.path.isdir(df.__dict__.get("_stored_path", ""))]


def test_exact_search_exchanges_no_vectors_and_leaves_only_its_result(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(11)
    rows = rng.normal(size=(900, 16))
    seen = stored_by(monkeypatch)
    q = spark.createDataFrame(pd.DataFrame({"signal_id": np.arange(900), "features": list(rows)}))
    got = M.match_embeddings(q, q.withColumnRenamed("signal_id", "gallery_id"), 2, skip_self=True)
    exchanges = [line for plan, _ in seen for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and all("hashpartitioning(signal_id" in line for line in exchanges)
    assert not any("CoGroups" in plan for plan, _ in seen)
    assert kept_paths(seen) == [seen[-1][1]._stored_path]
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    found = got.toPandas().sort_values(["signal_id", "similarity"], ascending=[True, False])
    assert np.allclose(found["similarity"].to_numpy().reshape(900, 2), brute(unit, unit, 2, True), atol=1e-12)


def test_probed_search_sends_vectors_a_few_times_and_leaves_only_its_result(spark, monkeypatch):
    sent, visit = [], M._visit

    def counted(asked, stock, *rest):
        sent.append(asked.where("features IS NOT NULL").count())
        return visit(asked, stock, *rest)

    monkeypatch.setattr(M, "_visit", counted)
    seen = stored_by(monkeypatch)
    q, g, queries, gallery = near_frames(spark, np.random.default_rng(8), 16_000)
    found = M.match_near(q, g, bucket_rows=8).toPandas().set_index("signal_id")
    assert 300 * M.TABLES <= sum(sent) < 300 * 40
    assert kept_paths(seen) == [seen[-1][1]._stored_path]
    best = (queries @ gallery.T).argmax(axis=1)
    assert np.mean([found["gallery_id"].get(i, -1) == b for i, b in enumerate(best)]) >= 0.9


@pytest.mark.parametrize("copies", [1 << 18, 1])
def test_probed_search_of_all_buckets_is_exact_in_blocks_and_rounds(spark, monkeypatch, vectors, copies):
    monkeypatch.setattr(M, "BLOCK_ROWS", 16)
    monkeypatch.setattr(M, "_COPIES", copies)
    monkeypatch.setattr(M, "_PAIRS", 100)
    q = spark.createDataFrame(pd.DataFrame({"signal_id": np.arange(600), "features": list(vectors)}))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = M.match_near(q, q.withColumnRenamed("signal_id", "gallery_id"), 3, skip_self=True, tables=2, bucket_rows=100).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = got.sort_values(["signal_id", "similarity"], ascending=[True, False])
    assert np.allclose(got["similarity"].to_numpy().reshape(600, 3), brute(vectors, vectors, 3, True), atol=1e-9)


@pytest.mark.parametrize("skip_self", [True, False])
def test_exact_search_of_equal_rows_repeated_and_missing_ids(spark, monkeypatch, vectors, skip_self):
    monkeypatch.setattr(M, "BLOCK_ROWS", 32)
    rows = [(i % 40 if i < 300 else i, vectors[0] if i < 300 else vectors[i % 600]) for i in range(500)]
    rows += [(7, vectors[0])] * 30 + [(None, vectors[0])] * 2 + [(900, np.zeros(8)), (901, None), (902, np.full(8, np.nan)), (903, [1.0, None] * 4)]
    g = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "gallery_id bigint, features array<double>")
    q = spark.createDataFrame([(7, vectors[0].tolist()), (450, vectors[450].tolist()), (None, vectors[0].tolist()), (2000, [0.0] * 8)], "signal_id bigint, features array<double>")
    got = M.match_embeddings(q, g, 5, skip_self=skip_self).toPandas()
    whole = [(i, v) for i, v in rows[:532]]
    for asked, vector in ((7, vectors[0]), (450, vectors[450]), (None, vectors[0])):
        there = [(-round(float(v @ vector), 9), -1 if i is None else i) for i, v in whole if not (skip_self and i is not None and i == asked)]
        mine = got[got["signal_id"].isna() if asked is None else got["signal_id"] == asked]
        assert sorted((-round(s, 9), -1 if pd.isna(i) else int(i)) for i, s in zip(mine["gallery_id"], mine["similarity"])) == sorted(there)[:5]
    assert len(got) == 15
