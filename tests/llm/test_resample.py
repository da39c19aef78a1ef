"""Importance resampling: models and draw against plain counts, and held-out labels."""

import math
from collections import Counter

import numpy as np
import pytest

from gleanframe.llm import resample as R
from gleanframe.llm.queries import QUERIES
from pyspark.sql import functions as F


def plain_log_ratio(texts, target, i, buckets, length):
    """Leave-one-out ratio with counters."""
    grams = [Counter(R.n_grams((t or "").encode(), buckets).tolist()) for t in texts]
    raw, tgt = Counter(), Counter()
    for j, g in enumerate(grams):
        if j != i:
            raw.update(g)
            if j in target:
                tgt.update(g)
    side = lambda c, s: sum(n for b, n in c.items() if (b >= buckets) == s)
    total = 0.0
    for b, n in grams[i].items():
        s = b >= buckets
        r = (raw[b] + R.RAW_PRIOR) / (side(raw, s) + R.RAW_PRIOR * buckets)
        p = R.TARGET_PRIOR * buckets
        total += n * math.log((tgt[b] + p * r) / (side(tgt, s) + p) / r)
    n = sum(grams[i].values())
    return total * min(1, length / n) if n else 0.0


def test_weights_and_draw(spread):
    texts = ["good text here", "bad&& text&&", "", None, "good good words " * 30, "other text here"]
    docs = spread.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, log_ratio double")
    target = frozenset({0, 4})
    models = R.fit(docs, target, "doc_id", "text", 64)
    got = {r.doc_id: r.s for r in R.log_ratios(docs, models, target, "doc_id", "text", "s", 20).collect()}
    for i in range(len(texts)):
        assert got[i] == pytest.approx(plain_log_ratio(texts, target, i, 64, 20), abs=1e-9)
    labels = spread.createDataFrame([(0, 1, 0), (4, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = R.resample(docs, labels, k=3).collect()
    keys = sorted((r.draw_key for r in out), reverse=True)
    assert [r.kept for r in out] == [r.draw_key >= keys[2] for r in out]
    kept = R.keep_drawn(docs, labels, k=3)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b"), (2, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in R.resample(docs, labels).collect()] == [True] * 4
    assert R.keep_drawn(docs.limit(0), labels).count() == 0


def test_kth_largest(spread):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=500), np.repeat([1.0, 2.0, 3.0], 40), rng.exponential(size=300) ** 8, np.array([5.0])):
        df = spread.createDataFrame([(float(v),) for v in values], "v double")
        for k in {1, len(values) // 2 or 1, len(values)}:
            assert R.kth_largest(df, "v", k, width=8) == sorted(values, reverse=True)[k - 1]


def test_noise_is_gumbel(spark):
    r = spark.range(20000).select(R.gumbel(F.col("id")).alias("g")).agg(F.avg("g"), F.stddev("g")).first()
    assert abs(r[0] - 0.5772) < 0.03 and abs(r[1] - math.pi / math.sqrt(6)) < 0.03


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op10_importance_resampling"](spark, sf)
    target, _ = R.good_sample(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0), R.LABELLED)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0 and r.doc_id not in target]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.985
    assert sum(bad) / len(bad) < 0.25


def test_held_out_toxic_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id: r.kept for r in QUERIES["op10_importance_resampling"](spark, sf).collect()}
    fitted, held = R.toxic_sample(labels, "doc_id", F.col("toxic") == 1, R.LABELLED)
    target, _ = R.good_sample(labels, "doc_id", (F.col("quality") == 1) & (F.col("toxic") == 0), R.LABELLED)
    assert not set(fitted) & set(held)
    share = {}
    for r in labels.collect():
        if r.doc_id in held and r.doc_id not in target:
            share.setdefault((r.quality, r.toxic), []).append(kept[r.doc_id])
    share = {c: (sum(x) / len(x), len(x)) for c, x in share.items()}
    print(share)
    assert share[1, 1][0] < 0.2 and share[0, 1][0] < 0.1 and share[1, 0][0] > 0.985


def test_few_toxic_words_in_a_long_text(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(3000)) + (" vile" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(100)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.kept for r in R.resample(docs, labels).collect()}
    assert not any(out[i] for i in range(0, 200, 4)) and sum(out.values()) > 100
    assert {r.doc_id for r in R.keep_drawn(docs, labels).collect()} == {i for i in out if out[i]}
