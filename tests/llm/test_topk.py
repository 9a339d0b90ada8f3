"""Exact top-k against a sorted list of all products."""

import math
import random

import numpy as np
import pytest
from pyspark.sql.types import StructType

from scorelake.llm import topk

SCHEMA = "vec_id bigint, embedding array<{kind}>, node bigint, v string, block bigint, score double, rank string"
LEAST, MOST = -(2**63), 2**63 - 1


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, *[None] * 5) for i, v in rows], StructType.fromDDL(SCHEMA.format(kind=kind)))


def direct(rows, is_query, k, scale=256):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) or not math.isfinite(scale * x) for x in v):
            return None
        return [math.floor(scale * x) for x in v]

    usable = [(n, i, w) for n, (i, v) in enumerate(rows) if (w := whole(v)) is not None]
    out = []
    for n, i, q in usable:
        if not is_query(i):
            continue
        # zip ends with the shorter one: the rest is zero.
        found = [(min(max(sum(x * y for x, y in zip(q, c, strict=False)), LEAST), MOST), j) for m, j, c in usable if m != n]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(found[:k], 1)]
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def search(df, k, **options):
    return topk.top_products(df.where("vec_id % 5 = 0"), df, k, **options)


def awkward():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    rows += [(100 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)]  # many ties
    rows += [(200 + i, [1.0, 1.0, 1.0]) for i in range(40)]  # one vector many times
    rows += [(5, rows[5][1]), (5, [0.5, 0.5]), (10, rows[10][1]), (10, rows[10][1])]  # repeated rows and ids
    rows += [(None, [2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0]), (None, None), (300, None), (305, []), (310, [0.0, -0.0])]
    return rows + [(315, [math.nan, 1.0]), (320, [math.inf]), (325, [1.0, None]), (330, [1e-300, -1e-300]), (-5, [0.1] * 6)]


@pytest.mark.parametrize("block", [topk.BLOCK_ROWS, 3])
def test_awkward_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "GROUP_BLOCKS", 4)
    monkeypatch.setattr(topk, "VISITORS", 2)
    rows = awkward()
    found = search(frame(spark, rows).repartition(3), 5)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert ordered(found.collect()) == ordered(direct(rows, lambda i: i is not None and i % 5 == 0, 5))


def test_products_beyond_doubles_and_longs(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-2, 200) for _ in range(3)]) for i in range(20)]
    rows += [(20 + i, [rng.uniform(-3e6, 3e6) for _ in range(3)]) for i in range(20)] + [(40, [1.7e308])]
    found = search(frame(spark, rows), 4)
    assert ordered(found.collect()) == ordered(direct(rows, lambda i: i % 5 == 0, 4))


def test_few_or_no_candidates(spark):
    rows = [(0, [1.0]), (5, [2.0]), (6, [0.5])]
    assert ordered(search(frame(spark, rows), 5).collect()) == ordered(direct(rows, lambda i: i % 5 == 0, 5))
    for few in ([(0, [1.0])], [(6, [1.0])], [(0, None)], []):
        assert search(frame(spark, few), 5).collect() == []


def test_one_vector_in_a_third_of_the_rows(spark):
    rng = random.Random(8)
    rows = [(i, [0.25, 0.5, 0.75]) for i in range(400)] + [(400 + i, [rng.random() for _ in range(3)]) for i in range(600)]
    found = search(frame(spark, rows, "float"), 5).collect()
    rows = [(i, np.array(v, dtype=np.float32).astype(float).tolist()) for i, v in rows]
    assert ordered(found) == ordered(direct(rows, lambda i: i % 5 == 0, 5))


def test_bounds_rule_out_most_products_of_clustered_vectors(spark, monkeypatch):
    """The limit is never below a product, and most blocks are never visited."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 8))
    points = np.repeat(middles, 50, axis=0) + rng.normal(scale=0.01, size=(2000, 8))
    points /= np.linalg.norm(points, axis=1)[:, None]
    whole = np.floor(256 * points)
    longest = np.linalg.norm(whole, axis=1).max() * (1 + 1e-12)
    pivots = topk.Pivots(whole, longest, topk.PIVOTS)
    table, asked = pivots.of_candidates(whole), pivots.of_queries(whole[:100])
    lengths = ((whole[:100] / longest) ** 2).sum(axis=1)
    gaps = np.abs(asked[:, None] - table[None]).max(axis=2)
    limit = np.stack([pivots.limit(g, n) for g, n in zip(gaps, lengths, strict=True)]) * longest**2
    exact = whole[:100] @ whole.T
    assert (limit >= exact).all()
    fifth = np.sort(exact, axis=1)[:, -6]
    assert (limit >= fifth[:, None]).mean() < 0.2
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    rows = [(i, v) for i, v in enumerate(points.tolist())]
    assert ordered(search(frame(spark, rows), 5).collect()) == ordered(direct(rows, lambda i: i % 5 == 0, 5))
