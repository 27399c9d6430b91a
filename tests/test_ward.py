import itertools
import math
import random
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardfield import state
from wardfield.functions.arrays import euclidean
from wardfield.operators import cut, inertia, nearest, pairs, tiles, ward
from wardfield.state import written

N = 16


def random_pairs(n, seed):
    rng = random.Random(seed)
    keys = list(itertools.combinations(range(n), 2))
    return {k: rng.random() for k in keys}, {k: rng.random() for k in keys}


def frames(spark, d0, d1, n, scenario="s"):
    rows = [(scenario, i, j, d0[i, j], d1[i, j]) for i, j in d0]
    p = spark.createDataFrame(rows, "scenario string, i long, j long, d0 double, d1 double")
    return spark.createDataFrame([(scenario, i) for i in range(n)], "scenario string, unit long"), written(p, "p")


@pytest.fixture(scope="module")
def given(spark):
    d0, d1 = random_pairs(N, 7)
    units, p = frames(spark, d0, d1, N)
    return d0, d1, units, p


@pytest.fixture(scope="module")
def squared(given):
    return ward.ward_tree(given[2], given[3], [0, 40, 100])


def merges_of(tree, alpha):
    rows = tree.merges.where(F.col("alpha_step") == alpha).collect()
    return sorted(((r["left"], r["right"], r["height"]) for r in rows), key=lambda r: r[2])


def check_merges(tree, d0, d1, mix, alpha):
    want = brute.ward(N, d0, d1, alpha / 100, mix)
    got = merges_of(tree, alpha)
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-9) for g, w in zip(got, want))


@pytest.mark.parametrize("alpha", [0, 40, 100])
def test_squared_tree_equals_sequential_updates(given, squared, alpha):
    check_merges(squared, given[0], given[1], "squared", alpha)


def test_linear_tree_equals_sequential_updates(given):
    check_merges(ward.ward_tree(given[2], given[3], [30], "linear"), given[0], given[1], "linear", 30)


def test_cuts_equal_brute_force(given, squared):
    d0, d1 = given[:2]
    ks = [2, 3, 5, 9, N, N + 4]
    want = {(a, k, u): c for a in (0, 40, 100) for k in ks if k <= N
            for u, c in enumerate(brute.cut(N, brute.ward(N, d0, d1, a / 100, "squared"), k))}
    got = {(r["alpha_step"], r["k"], r["unit"]): r["cluster"] for r in cut.cut_tree(squared, ks).collect()}
    assert got == want


def test_rounds_leave_no_old_states_and_keep_settings(spark, given):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, root = spark.conf.get(key, None), Path(state.state_root(spark).removeprefix("file://"))
    known = set(root.iterdir()) if root.exists() else set()
    ward.ward_tree(given[2], given[3], [30], "squared")
    folders = [f for f in root.iterdir() if f not in known and f.name.startswith("ward-squared")]
    assert len(folders) == 1
    names = [f.name for f in folders[0].iterdir()]
    assert sum(n.startswith("state-") for n in names) <= 1 and any(n.startswith("merges-") for n in names)
    assert spark.conf.get(key, None) == before


def test_inertia_along_the_tree(given, squared):
    d0, d1, _, p = given
    totals = pairs.total_inertia(p)
    t = totals.first()
    heights = {r[0]: r[1] for r in squared.merges.groupBy("alpha_step").agg(F.sum("height")).collect()}
    # Heights of a squared tree add up to the blended total inertia.
    assert math.isclose(heights[40], 0.6 * t["t0"] + 0.4 * t["t1"], rel_tol=1e-9)
    q = {(r["alpha_step"], r["k"]): r for r in inertia.explained_inertia(squared, totals, 6).collect()}
    for a, k in [(0, 2), (40, 4), (100, 6)]:
        label = brute.cut(N, brute.ward(N, d0, d1, a / 100, "squared"), k)
        assert brute.close(q[a, k]["q0"], brute.explained(N, d0, label))
        assert brute.close(q[a, k]["q1"], brute.explained(N, d1, label))
    direct = inertia.explained_inertia_direct(cut.cut_tree(squared, [2, 4, 6]), p, totals, ["alpha_step", "k"])
    for r in direct.collect():
        assert brute.close(r["q0"], q[r["alpha_step"], r["k"]]["q0"])


def test_alpha_ties_go_to_the_smallest_weight(spark):
    q = spark.createDataFrame([("s", a, 2, v, v, v, 1 - v, v) for a, v in [(0, .3), (1, .5), (2, .5 + 1e-15), (3, .4)]],
                              "scenario string, alpha_step int, k int, q0 double, q1 double, q0norm double, q1norm double, tot double")
    got = {r["criterion"]: r["alpha_step"] for r in inertia.alpha_stars(q).collect()}
    assert got == {"ch": 1, "max": 1}


def test_weights_tie_where_rounding_would_part_them(spark):
    near = [(0.0418970255865 + 5e-13 + 2e-15 * ((7 * i) % 5 - 2), a) for i, a in enumerate(range(32, 38))]
    q = spark.createDataFrame([("s", 8, a, v) for v, a in near] + [("s", 8, 31, 0.05)],
                              "scenario string, k int, alpha_step int, value double")
    for parts in (1, 4):
        got = inertia.argmin_alpha(q.repartition(parts), F.col("value")).collect()
        assert [(r["k"], r["alpha_step"]) for r in got] == [(8, 32)]


def test_rounds_keep_the_settings_of_the_caller(spark):
    from wardfield.state import Rounds

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert Rounds(spark, "settings").session.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_sequential_order_on_ties(spark):
    """On a grid of touching cells many distances are zero; the order by smallest ids is fixed."""
    n, d0 = 9, {}
    for i, j in itertools.combinations(range(n), 2):
        d0[i, j] = max(0.0, math.hypot(i // 3 - j // 3, i % 3 - j % 3) - 1)
    units, p = frames(spark, d0, d0, n)
    tree = ward.ward_tree(units, p, [100], order="sequential")
    got = [(r["left"], r["right"]) for r in tree.merges.orderBy("round").collect()]
    assert got == [(a, b) for a, b, _ in brute.ward(n, d0, d0, 1.0, "squared")]


def test_two_units_identical_units_and_a_missing_distance(spark):
    units, p = frames(spark, {(0, 1): 0.0}, {(0, 1): 0.0}, 2)
    assert merges_of(ward.ward_tree(units, p, [50]), 50) == [(0, 1, 0.0)]
    holes = p.withColumn("d0", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="no d0"):
        ward.ward_tree(units, holes, [50])


def test_vector_tree_equals_pair_tree(spark):
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) for _ in range(3)], rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(30)]
    units = spark.createDataFrame(rows, "unit long, x array<double>, lon double, lat double").select(
        F.lit("all").alias("scenario"), "unit", "x", tiles.unit_point().alias("g"))
    met = pairs.unit_pairs(units, ["x", "g"])
    p = written(pairs.range_normalise(met.select(
        "scenario", "i", "j", euclidean(F.col("x_i"), F.col("x_j")).alias("d0"),
        euclidean(F.col("g_i"), F.col("g_j")).alias("d1"))), "p")
    one = ward.ward_tree(units, p, [0, 55])
    two = tiles.ward_tree_vectors(units, [0, 55], block_rows=8)
    cols = ["alpha_step", "left", "right", F.round("height", 10), F.round("dw0", 10), F.round("dw1", 10)]
    assert one.merges.select(cols).exceptAll(two.merges.select(cols)).count() == 0
    assert one.merges.count() == two.merges.count() == 58


def test_pairs_are_complete_in_any_number_of_blocks(spark, monkeypatch):
    units = spark.range(60).select(F.lit("s").alias("scenario"), F.col("id").alias("unit"))
    monkeypatch.setattr(pairs, "PAIR_BLOCK", 7)
    got = pairs.unit_pairs(units, []).select("i", "j")
    assert got.count() == got.distinct().count() == 60 * 59 // 2
    assert got.where("i >= j").count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def brute_nearest(ids, w, v):
    gap = v[:, None] - v[None]
    ward = (gap * gap).sum(2) * (w[:, None] * w[None] / (w[:, None] + w[None]))
    np.fill_diagonal(ward, np.inf)
    return ids[ward.argmin(1)], ward.min(1)


def test_nearest_clusters_are_exact_and_few_pairs_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 2_500
    z, w, ids = rng.standard_normal((n, 4)) + 8 * rng.integers(0, 2, (n, 4)), rng.integers(1, 4, n) / n, np.sort(rng.choice(10 * n, n, replace=False))
    z[:, 0] = np.round(z[:, 0], 1)
    z[700:900], w[700:900] = z[:200], w[:200]
    want, value = brute_nearest(ids, w, z)
    compared, plain = [0], nearest._best_of

    def counted(*a):
        compared[0] += len(a[0]) * len(a[-1]) * nearest.CELL
        return plain(*a)

    monkeypatch.setattr(nearest, "_best_of", counted)
    cells = nearest.Cells.of(ids, w, z)
    best, nbr = cells.unknown()
    nearest.search(cells, cells, best, nbr, np.arange(best.size).reshape(best.shape))
    assert (nbr.ravel()[:n] == want[cells.order]).all() and np.allclose(best.ravel()[:n], value[cells.order], rtol=1e-12)
    many = rng.random((20_000, 3))
    cells, compared[0] = nearest.Cells.of(np.arange(20_000), np.full(20_000, 1.0), many), 0
    nearest.search(cells, cells, *cells.unknown(), np.arange(cells.ids.size).reshape(cells.ids.shape))
    # All pairs once would be half of the square.
    assert compared[0] < 20_000 ** 2 / 10
    monkeypatch.undo()
    clusters = written(spark.createDataFrame([("s", 40, int(i), float(x), (float(x) * v).tolist()) for i, x, v in zip(ids, w, z)],
                                             "scenario string, alpha_step int, unit long, w double, z array<double>"), "c")
    # One factor for all entries, so that the mix is the plain distance.
    rows = tiles.nearest_clusters(clusters, n, 1, {"s": (0.6 ** 0.5, 0.4 ** 0.5)}, block_rows=100).collect()
    got = {r["node"]: r["best"] for r in rows}
    for i, who, x in zip(ids, want, value):
        assert math.isclose(got[i]["ward"], x, rel_tol=1e-9, abs_tol=1e-20) and (got[i]["nbr"] == who or x < 1e-20)


def test_large_vector_tree_is_the_same_with_few_rounds_for_copies(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((30, 2))[np.arange(240) % 30]
    g = rng.standard_normal((240, 3))
    g /= np.linalg.norm(g, axis=1)[:, None]
    units = written(spark.createDataFrame([(i, x[i].tolist(), g[i].tolist()) for i in range(240)], "unit long, x array<double>, g array<double>"), "u")
    d0, d1 = (np.linalg.norm(m[:, None] - m[None], axis=2) for m in (x, g))
    d0, d1 = d0 / d0.max(), d1 / d1.max()
    kept, plain = [], tiles.Rounds.keep
    monkeypatch.setattr(tiles.Rounds, "keep", lambda self, df, name: kept.append(name) or plain(self, df, name))
    monkeypatch.setattr(tiles.small_trees, "FEW", 10)
    found = {}
    for large in (60, 32_768):
        kept.clear()
        monkeypatch.setattr(tiles.small_trees, "LARGE", large)
        tree = tiles.ward_tree_vectors(units, [0, 30], block_rows=64)
        found[large] = {(r["alpha_step"], r["left"], r["right"]): (r["height"], r["dw0"], r["dw1"]) for r in tree.merges.collect()}
        # Seven copies of each vector take no round each.
        assert len([name for name in kept if name.startswith("clusters")]) <= (10 if large == 60 else 0)
    assert found[60].keys() == found[32_768].keys() and len(found[60]) == 2 * 239
    assert np.allclose([found[60][k] for k in found[60]], [found[32_768][k] for k in found[60]], rtol=1e-9, atol=1e-12)
    for a in (0, 30):
        heights = np.sort([v[0] for k, v in found[60].items() if k[0] == a])
        pairs_of = {(i, j): (d0[i, j], d1[i, j]) for i, j in itertools.combinations(range(240), 2)}
        want = brute.ward(240, {k: v[0] for k, v in pairs_of.items()}, {k: v[1] for k, v in pairs_of.items()}, a / 100, "squared") if a else None
        if want:
            assert np.allclose(heights, np.sort([h for _, _, h in want]), rtol=1e-7, atol=1e-12)
