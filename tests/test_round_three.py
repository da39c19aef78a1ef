"""Polygons with holes, exact test values, the exact law of a bootstrap median, robust moments."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanframe.functions import tails
from gleanframe.operators import factor, geo, ranks, sketches

RINGS = "array<array<struct<x:double,y:double>>>"


def box(x, y, w, h):
    return [[(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]]


def shapes(spark, rows):
    return spark.createDataFrame(rows, f"k string, id int, name string, rings {RINGS}").repartition(3)


def as_points(polygons):
    return [[[(p.x, p.y) for p in ring] for ring in polygon] for polygon in polygons]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) / 2


def test_neighbours_of_other_heights_fuse(spread):
    rows = [("a", 2, "second", box(10.0, 0.0, 10.0, 5.0)), ("a", 1, "first", box(0.0, 0.0, 10.0, 10.0)), ("a", 3, None, box(10.0, 5.0, 10.0, 5.0))]
    (got,) = geo.dissolve(shapes(spread, rows), ["k"], ["id", "name"], ["id"]).collect()
    assert (got.k, got.id, got.name) == ("a", 1, "first")
    ((ring,),) = as_points(got.polygons)
    assert len(ring) - 1 == 7 and area(ring) == 200


@pytest.mark.parametrize("cell", [None, 3.0, 100.0])
def test_holes_and_islands(spread, cell):
    # a frame of width 1 around an empty square with an island in it, the island being a frame itself
    def frame(x, y, size):
        return [box(x, y, size, 1.0), box(x, y + size - 1, size, 1.0), box(x, y + 1, 1.0, size - 2), box(x + size - 1, y + 1, 1.0, size - 2)]

    parts = frame(0.0, 0.0, 12.0) + frame(3.0, 3.0, 6.0) + [box(20.0, 0.0, 2.0, 2.0), box(22.0, 2.0, 2.0, 2.0)]
    rows = [("a", i, str(i), r) for i, r in enumerate(parts)] + [("b", 9, "nine", [[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]]), (None, 1, "n", box(0.0, 0.0, 1.0, 1.0)), ("c", 1, "c", None)]
    rows += [("b", 10, "ten", [[(4.0, 0.0), (4.0, 4.0), (2.0, 2.0), (4.0, 0.0)]]), ("b", 11, "x", [[(4.0, 4.0), (0.0, 4.0), (2.0, 2.0), (4.0, 4.0)]])]
    got = {r.k: r for r in geo.dissolve(shapes(spread, rows), ["k"], ["id"], ["id"], cell=cell).collect()}
    polygons = as_points(got["a"].polygons)
    # the last two boxes touch in a corner: one ring that passes it twice
    assert [[area(r) for r in p] for p in polygons] == [[144.0, -100.0], [36.0, -16.0], [8.0]]
    # the slanted neighbours share a corner on the long edge
    assert [[area(r) for r in p] for p in as_points(got["b"].polygons)] == [[16.0]]
    assert got[None].polygons is None and got["c"].polygons is None and got["c"].id == 1
    assert all(r[0] == r[-1] for p in polygons for r in p)


def test_broken_coverages(spread):
    with pytest.raises(geo.BrokenCoverage, match="overlap"):
        geo.dissolve(shapes(spread, [("a", 1, "", box(0.0, 0.0, 2.0, 2.0)), ("a", 2, "", box(0.0, 0.0, 2.0, 2.0))]), ["k"])
    with pytest.raises(geo.BrokenCoverage, match="close"):
        geo.dissolve(shapes(spread, [("a", 1, "", [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]])]), ["k"])
    assert geo.dissolve(shapes(spread, []), ["k"]).count() == 0


def test_stored_polygons(spark, tmp_path):
    shapes(spark, [("a", 1, "", box(0.0, 0.0, 2.0, 2.0)), ("b", 2, "", None)]).write.parquet(str(tmp_path / "p"))
    places = geo.scan_polygons(spark, str(tmp_path / "p"))
    layer = spark.createDataFrame([("a", 3), ("z", 5), (None, 6)], "k string, n long")
    got = {r.k: (r.n, r.rings is None) for r in geo.with_geometry(layer, places, ["k"], fill={"n": 0}).collect()}
    assert got == {"a": (3, False), "b": (0, True)}
    with pytest.raises(TypeError):
        geo.scan_polygons(spark, str(tmp_path / "p"), rings="name")


def test_geometry_is_joined_above_the_aggregate(spark):
    from gleanframe.plans import geo_queries
    from gleanframe.sources.standins import mentions

    sf = "/root/testdata/sf0.001"
    cited = mentions(spark, sf, "area", "name").withColumnRenamed("area", "place").groupBy("place").count()
    plan = geo.with_geometry(cited, geo_queries.stored_places(spark, sf), ["place"])._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    depth = {word: min(len(x) - len(x.lstrip(" :+-")) for x in lines if word in x) for word in ("Aggregate", "rings#")}
    scans = [x for x in lines if "Relation" in x and "rings#" in x]
    # the polygon scan hangs on the top join, beside the aggregate, not below it
    assert len(scans) == 1 and len(scans[0]) - len(scans[0].lstrip(" :+-")) <= depth["Aggregate"] + 6
    assert not any("Aggregate" in x and "rings#" in x for x in lines)


def plain_tail(x, k, j, n):
    up = x * n > k * j
    where = range(x, min(k, j) + 1) if up else range(max(0, k + j - n), x + 1)
    return sum(math.comb(k, i) * math.comb(n - k, j - i) for i in where) / math.comb(n, j)


def test_hypergeometric_tails():
    for n, k, j in [(20, 7, 9), (20, 20, 5), (50, 25, 25), (300, 40, 120), (9, 1, 1), (30, 29, 28)]:
        for x in range(max(0, k + j - n), min(k, j) + 1):
            assert math.exp(tails.log_hypergeometric_tail(x, k, j, n)) == pytest.approx(min(1.0, plain_tail(x, k, j, n)), rel=1e-9)
    # too small for a float, still told apart
    far = [tails.normal_from_log_upper(tails.log_hypergeometric_tail(x, 40_000, 50_000, 100_000)) for x in (20_000, 30_000, 40_000)]
    assert 0 <= far[0] < 0.1 and 100 < far[1] < far[2]
    for z in (0.0, 0.5, 3.0, 20.0, 24.9, 25.1, 40.0, 300.0):
        assert tails.normal_from_log_upper(tails.log_normal_upper(z)) == pytest.approx(z, abs=1e-6)


def test_category_tests_against_plain_sums(spread):
    rng = np.random.default_rng(1)
    rows = [(str(rng.choice(["p", "q", "r"])), str(rng.choice(["u", "v"], p=[0.8, 0.2])), str(rng.choice(["A", "B", "C"]))) for _ in range(120)]
    rows += [("p", "u", "A")] * 25
    counts = factor.profile_counts(spread.createDataFrame(rows, "a string, b string, cls string"), ["a", "b"], "cls")
    got = factor.test_categories(counts, ["a", "b"], "cls").collect()
    assert len(got) == 5 * 3
    n, held = len(rows), {"a": Counter(r[0] for r in rows), "b": Counter(r[1] for r in rows)}
    classes = Counter(r[2] for r in rows)
    for r in got:
        x = sum(row[2] == r.cls and row["ab".index(r["var"])] == r.cat for row in rows)
        k, j = held[r["var"]][r.cat], classes[r.cls]
        p = min(1.0, 2 * plain_tail(x, k, j, n))
        assert r.n == x and r.p_value == pytest.approx(p, rel=1e-9)
        z = tails.normal_quantile(1 - p / 2) if p < 1 else 0.0
        assert abs(r.test_value) == pytest.approx(z, abs=1e-6) and (r.test_value >= 0) == (x * n > k * j or z == 0)
        assert r.chi2_df == (2 * 2 if r["var"] == "a" else 2)


def plain_law(values):
    """All resamples of a small group."""
    n, law = len(values), Counter()
    for draw in itertools.product(range(n), repeat=n):
        law[float(np.median([values[i] for i in draw]))] += 1 / n**n
    return law


def test_bootstrap_median_law(spread):
    groups = {"odd": [3.0, 1.0, 4.0, 1.0, 5.0], "even": [2.0, 7.0, 1.0, 8.0, 2.0, 9.0], "one": [4.0], "two": [1.0, 3.0], "same": [6.0] * 4, "gone": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None), (None, 5.0), ("gone", None)]
    df = spread.createDataFrame(rows, "g string, v double").repartition(3)
    law = {}
    for r in ranks.bootstrap_median_law(df, "g", "v").collect():
        law.setdefault(r.g, {})[r["at"]] = r.p
    assert set(law) == {"odd", "even", "one", "two", "same"}
    for g, got in law.items():
        want = plain_law(groups[g])
        assert set(want) <= set(got) and sum(got.values()) == pytest.approx(1, abs=1e-12)
        for at, p in got.items():
            assert p == pytest.approx(want.get(at, 0.0), abs=1e-12)
    told = {r.g: r for r in ranks.bootstrap_median_exact(df, "g", "v").collect()}
    assert (told["one"].ci_low, told["one"].ci_high, told["one"].boot_sd) == (4.0, 4.0, 0.0)
    assert told["even"].median == 4.5 and told["even"].n == 6


def test_drawn_medians_follow_the_law(spark):
    rng = np.random.default_rng(9)
    rows = [(g, float(v)) for g, n in (("a", 400), ("b", 3001)) for v in np.round(rng.gamma(2, 100, n), 1)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {r.g: r for r in ranks.bootstrap_median_exact(df, "g", "v").collect()}
    law = {}
    for r in ranks.bootstrap_median_law(df, "g", "v").collect():
        law.setdefault(r.g, []).append((r["at"], r.p))
    for r in ranks.bootstrap_median(df, "g", "v", replicates=4000).collect():
        e = exact[r.g]
        assert e.median == r.median and e.n == r.n and sum(p for _, p in law[r.g]) == pytest.approx(1, abs=1e-9)
        # a drawn limit is a value whose chance of being passed is near its own, within five deviations
        for limit, share in ((r.ci_low, 0.025), (r.ci_high, 0.975)):
            slack = 5 * math.sqrt(0.025 * 0.975 / 4000)
            assert sum(p for at, p in law[r.g] if at < limit - 1e-9) <= share + slack
            assert sum(p for at, p in law[r.g] if at <= limit + 1e-9) >= share - slack


def test_robust_moments(spread):
    rng = np.random.default_rng(4)
    points = rng.multivariate_normal([1000.0, -50.0], [[4.0, 1.5], [1.5, 1.0]], 800)
    rows = [("a", float(x), float(y)) for x, y in points] + [("a", 1100.0, 300.0)] * 20 + [("line", float(i), 2.0 * i) for i in range(9)]
    rows += [("one", 1.0, 2.0), ("a", None, 1.0), (None, 1.0, 1.0)]
    got = {r.g: r for r in ranks.robust_moments(spread.createDataFrame(rows, "g string, x double, y double").repartition(4), ["g"], "x", "y", tol=1e-6, rounds=60).collect()}
    a = got["a"]
    x = np.array([r[1:] for r in rows if r[0] == "a" and r[1] is not None])
    centre, cov, w = x.mean(0), np.cov(x.T, bias=True), np.ones(len(x))
    for _ in range(200):
        q = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        w = 1.4 / (1 + q / 5)
        centre = (w[:, None] * x).sum(0) / w.sum()
        cov = ((w[:, None] * (x - centre)).T @ (x - centre)) / w.sum()
    assert a.converged and a.n == 820 and 1 < a.n_rounds < 60
    assert [a.mean_x, a.mean_y] == pytest.approx(centre.tolist(), abs=1e-3)
    assert [a.var_x, a.var_y, a.cov_xy] == pytest.approx((cov * w.sum() / len(x))[[0, 1, 0], [0, 1, 1]].tolist(), rel=1e-3)
    # outliers hardly count, unlike in plain moments
    assert abs(a.mean_x - 1000) < 0.5 < abs(x[:, 0].mean() - 1000)
    assert (got["line"].converged, got["line"].var_x, got["one"].converged, got["one"].n) == (False, None, False, 1)
    # the radius is the square root of twice the F quantile with 2 and n - 1 degrees of freedom
    d = a.n - 1
    assert 1 - (1 + a.radius**2 / d) ** (-d / 2) == pytest.approx(0.95)
    assert ranks.robust_moments(spread.createDataFrame([], "g string, x double, y double"), ["g"], "x", "y").count() == 0


def test_sketches_merge_like_the_rows(spread):
    rng = np.random.default_rng(6)
    rows = [("ab"[i % 2], "xyz"[i % 3], int(rng.integers(20_000)), float(rng.normal())) for i in range(30_000)] + [("a", "x", None, None), (None, "x", 1, 1.0), ("c", "w", 5, None)]
    df = spread.createDataFrame(rows, "g string, h string, id long, v double").repartition(6)
    cells = sketches.sketch_cells(df, ["g", "h"], "id", "v")
    merged = sketches.merge_cells(cells, ["g"])
    got = {r.g: r for r in merged.select("g", "rows", sketches.distinct_estimate().alias("ids"), *[sketches.quantile_estimate(p).alias(f"q{p}") for p in (0.1, 0.5, 0.9)]).collect()}
    for g in ("a", "b"):
        own = [r for r in rows if r[0] == g]
        ids, values = {r[2] for r in own} - {None}, np.sort([r[3] for r in own if r[3] is not None])
        assert got[g].rows == len(own) and abs(got[g].ids - len(ids)) <= sketches.DISTINCT_ERROR * len(ids)
        for p in (0.1, 0.5, 0.9):
            assert abs(np.searchsorted(values, got[g][f"q{p}"]) / len(values) - p) <= sketches.RANK_ERROR + 1e-3
    assert (got[None].ids, got[None]["q0.5"]) == (1, 1.0)
    assert (got["c"].ids, got["c"]["q0.5"]) == (1, None)
    whole = sketches.merge_cells(merged, []).select("rows", sketches.distinct_estimate().alias("ids")).first()
    assert whole.rows == len(rows) and abs(whole.ids - len({r[2] for r in rows} - {None})) <= sketches.DISTINCT_ERROR * 20_000
