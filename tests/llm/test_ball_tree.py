import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.llm import ball_tree, sharded
from tests.llm.oracle import assert_matches_sql

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, part string, score string"


def plain(rows, k, of=50, scale=256):
    """Every query against every other usable row."""
    fine = [(i, n, [math.floor(float(x) * scale) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, n, v in fine:
        if i is None or i % of:
            continue
        met = [(sum(a * b for a, b in zip(v, w)), j) for j, m, w in fine if m != n and len(w) == len(v)]
        met.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(met[:k], 1)]
    return sorted(out, key=str)


def run(spark, rows, k=5, of=50):
    df = spark.createDataFrame([(i, v, 1, "a", "b", "c") for i, v in rows], SCHEMA).repartition(3)
    found = ball_tree.top_k(df, F.col("vec_id") % of == 0, k)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_sql(spread):
    assert_matches_sql(spread, "op11_ball_tree_top_k", "/root/testdata/sf0.01")


def test_many_shards(spread, monkeypatch):
    monkeypatch.setattr(ball_tree, "SHARD_CELLS", 8 * 40)
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(600)]
    rows += [(int(i), rows[7][1]) for i in range(600, 700)]
    assert run(spread, rows, of=20) == plain(rows, 5, of=20)


def test_edges(spread):
    v = [0.5, -0.25, 0.0]
    rows = [
        (0, v), (0, v), (50, v), (50, [0.1, 0.2, 0.3]), (None, v), (None, [1.0, 1.0, 1.0]), (3, None), (100, None),
        (150, [1.0, None, 2.0]), (200, [float("nan"), 0.0, 0.0]), (250, [float("inf"), 0.0, 0.0]), (4, [0.5, -0.25, 0.0]),
        (300, []), (5, []), (350, [1.0] * 2), (6, [-1.0] * 2), (400, [0.0] * 7),
    ]
    assert run(spread, rows) == plain(rows, 5)
    assert run(spread, rows, k=100) == plain(rows, 100)
    assert run(spread, rows, k=1) == plain(rows, 1)
    assert run(spread, []) == []
    assert run(spread, [(1, v), (2, v)]) == []


def test_large_components(spread):
    rows = [(0, [1e6, 1e6]), (1, [3e5, 2e6]), (2, [-1e6, 4.0]), (50, [1e12, -3e11]), (51, [2e12, 5.0]), (52, [2e12, 5.5])]
    got = {(q, j): s for q, _, j, s in run(spread, rows)}
    for q, _, j, s in plain([(i, [float(np.float32(x)) for x in v]) for i, v in rows], 5):
        assert got[q, j] == max(-(2**63), min(2**63 - 1, s))


@pytest.mark.parametrize("spread_out", [0.02, 1.0])
def test_tree(spread_out):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 6)) * 3000
    points = (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 6)) * 3000 * spread_out).astype(np.int64)
    points[100:300] = points[7]
    tree = ball_tree.BallTree(points, leaf=32)
    assert sorted(tree.rows) == list(range(8000))
    who = np.arange(0, 8000, 16)
    q, r, s, taken = tree.search(points[who], who, np.full(len(who), ball_tree.LONG.min), 5)
    truth = points[who] @ points.T
    for i, w in enumerate(who):
        order = [x for x in np.lexsort((np.arange(8000), -truth[i])) if x != w][:5]
        assert sorted(zip(r[q == i], s[q == i])) == sorted((x, truth[i, x]) for x in order)
    # most rows are left out where there is structure
    assert taken < len(who) * 8000 * (0.2 if spread_out < 1 else 1)
    again = tree.search(points[who], who, np.sort(truth, axis=1)[:, -5], 5)
    assert again[3] <= taken


def test_more_shards_only_where_needed(spark):
    got = spark.range(1).select(
        sharded.shards_for(F.lit(0), 100, 10, 8), sharded.shards_for(F.lit(5), 100, 10, 8), sharded.shards_for(F.lit(41), 100, 10, 8),
        sharded.shards_for(F.lit(500), 100, 10, 8), sharded.shards_for(F.lit(5000), 100, 10, 8),
    )
    assert tuple(got.first()) == (1, 1, 5, 8, 50)
