"""Pruned extremes, trees on a neighbour graph, trees finished by one task, rank sums as tables, and joins of hot keys."""

import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardfield.operators import cut, extremes, graph_tree, indices, ranks, reshape, small_trees, tiles, ward
from wardfield.plans.study import VectorStudy
from wardfield.state import written


# ---- extremes ----------------------------------------------------------------

@pytest.mark.parametrize("size,geo,top", [(2, False, 4), (5, True, 256), (40, False, 256)])
def test_extremes_equal_all_pairs(spark, monkeypatch, size, geo, top):
    monkeypatch.setattr(extremes, "TOP", top)
    monkeypatch.setattr(extremes, "CELL", 8)
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, size)) * 3
    v[7] = v[9]
    if geo:
        g = rng.standard_normal((400, 3))
        v = np.c_[v, g / np.linalg.norm(g, axis=1)[:, None]]
    metric = extremes.Metric(size, 0.3, 0.7) if geo else extremes.Metric(size)
    parts = {"by place": (v[:, 0] > 0).astype(int) + 2 * (v[:, 1] > 1), "by chance": rng.integers(0, 3, 400), "one": np.zeros(400, int)}
    rows = [(k, int(c[i]), v[i].tolist()) for k, c in parts.items() for i in range(400)]
    points = spark.createDataFrame(rows, "key string, label int, v array<double>")
    d = metric.between(v, v)
    got = {r["key"]: r for r in extremes.cluster_extremes(points, metric).collect()}
    for k, c in parts.items():
        same = c[:, None] == c[None]
        assert np.isclose(got[k]["max_w"], d[same].max(), rtol=1e-12)
        assert got[k]["min_b"] is None if k == "one" else np.isclose(got[k]["min_b"], d[~same].min(), rtol=1e-12)
        assert got[k]["measured"] <= got[k]["possible"]
    if size == 2:  # in the plane the bounds rule most cells out
        assert got["one"]["measured"] < 0.1 * got["one"]["possible"] and got["by place"]["measured"] < 0.3 * got["by place"]["possible"]
    assert extremes.cluster_extremes(points.where("false"), metric).count() == 0


def test_extremes_write_no_rows_per_pair(spark, monkeypatch):
    monkeypatch.setattr(extremes, "CELL", 2)
    rows_written, plain = [], extremes.written

    def counted(df, label, path=None):
        table = plain(df, label, path)
        rows_written.append(table.count())
        return table

    monkeypatch.setattr(extremes, "written", counted)
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 40))
    v[11] = v[12]
    parts = {"few": np.arange(300) % 3, "many": np.arange(300) // 2}
    points = spark.createDataFrame([(k, int(c[i]), v[i].tolist()) for k, c in parts.items() for i in range(300)], "key string, label int, v array<double>")
    got = {r["key"]: r for r in extremes.cluster_extremes(points, extremes.Metric(40)).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    for k, c in parts.items():
        same = c[:, None] == c[None]
        assert np.isclose(got[k]["max_w"], d[same].max(), rtol=1e-12) and np.isclose(got[k]["min_b"], d[~same].min(), rtol=1e-12)
    # With independent dimensions boxes rule nothing out; still no table holds more rows than there are vectors.
    assert max(rows_written) <= 600


def test_pruned_dunn_equals_tiles(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 3, 1), rng.random()], rng.uniform(-90, 90), rng.uniform(-60, 60), i % 3, i // 40) for i in range(120)]
    units = spark.createDataFrame(rows, "unit long, x array<double>, lon double, lat double, c int, e int").withColumn("g", tiles.unit_point())
    parts = {"c": 40, "e": 0}
    want = {r["key"]: r["value"] for r in tiles.vector_indices(units, parts, ["Dunn", "McClain"]).where("index = 'Dunn'").collect()}
    got = {r["key"]: r["value"] for r in tiles.pruned_dunn(units, parts).collect()}
    # With any weight above 0 both distances are divided by their largest value, which a quotient does not see.
    assert brute.close(got["c"], want["c"]) and brute.close(got["e"], want["e"])


# ---- trees -------------------------------------------------------------------

def vectors(n, seed, groups=9):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, 6)) * 4
    v = centre[rng.integers(0, groups, n)] + rng.standard_normal((n, 6))
    g = v[:, 3:] / np.linalg.norm(v[:, 3:], axis=1)[:, None]
    return v[:, :3], g


def unit_table(spark, sets):
    rows = [(s, i, x[i].tolist(), g[i].tolist()) for s, (x, g) in sets.items() for i in range(len(x))]
    return written(spark.createDataFrame(rows, "scenario string, unit long, x array<double>, g array<double>"), "t-units")


def test_small_trees_are_exact_in_every_scenario(spark):
    sets = {"a": vectors(40, 1), "b": vectors(25, 2)}
    tree = graph_tree.ward_tree_graph(unit_table(spark, sets), [0, 45, 100])
    for s, (x, g) in sets.items():
        n = len(x)
        keys = list(itertools.combinations(range(n), 2))
        raw = [{(i, j): float(np.linalg.norm(m[i] - m[j])) for i, j in keys} for m in (x, g)]
        d0, d1 = ({k: v / max(d.values()) for k, v in d.items()} for d in raw)
        for a in (0, 45, 100):
            got = sorted((r["height"], r["left"], r["right"]) for r in tree.merges.where((F.col("scenario") == s) & (F.col("alpha_step") == a)).collect())
            want = sorted((h, left, right) for left, right, h in brute.ward(n, d0, d1, a / 100, "squared"))
            assert np.allclose([w[0] for w in want], [h[0] for h in got], rtol=1e-9)
            assert [w[1:] for w in want] == [h[1:] for h in got]


def test_graph_tree_is_near_the_exact_one_with_linear_edges(spark):
    steps = [0, 60, 100]
    edges = {}
    for n in (300, 1_000):
        units = unit_table(spark, {"s": vectors(n, 5, 30)})
        tree = graph_tree.ward_tree_graph(units, steps)
        edges[n] = max(e for _, _, e in tree.rounds) / (n * len(steps))
        assert sum(e > 0 for _, _, e in tree.rounds) > 2
        assert [r["count"] for r in tree.merges.groupBy("alpha_step").count().collect()] == [n - 1] * 3
    # Links a cluster have a bound; they do not grow with the units.
    assert edges[1_000] < 1.15 * edges[300] < 2 * graph_tree.SHIFTS * graph_tree.LINKS
    exact = tiles.ward_tree_vectors(units.drop("scenario"), steps)
    for a in steps:
        top = [np.sort([r[0] for r in t.merges.where(F.col("alpha_step") == a).select("height").collect()])[::-1] for t in (tree, exact)]
        left = [1 - np.cumsum(h)[:14] / h.sum() for h in top]
        # Both are greedy, and either may be the better one; the graph leaves at most a tenth more inertia unexplained at any K = 2..15.
        assert (left[0] <= 1.1 * left[1]).all()
    sizes = {r[0] for r in cut.cut_tree(tree, [7]).groupBy("alpha_step", "k").agg(F.countDistinct("cluster")).select("count(DISTINCT cluster)").collect()}
    assert sizes == {7}


def test_edges_of_the_graph_are_never_written(spark, monkeypatch):
    kept, plain = [], graph_tree.Rounds.keep

    def counted(self, df, name):
        table = plain(self, df, name)
        kept.append(table.count())
        return table

    monkeypatch.setattr(graph_tree.Rounds, "keep", counted)
    x, g = vectors(1_300, 7, 20)
    x[400:450], g[400:450] = x[3], g[3]
    tree = graph_tree.ward_tree_graph(unit_table(spark, {"s": (x, g)}), [30])
    # A round keeps a row for each cluster left and each merge: no more than there were units.
    assert max(kept) <= 1_300 and tree.rounds[0][2] > 1_300
    rows = tree.merges.collect()
    assert len({r["right"] for r in rows}) == len(rows) == 1_299 and all(r["left"] < r["right"] for r in rows)
    # The copies are one cluster at no cost.
    assert sum(r["height"] < 1e-20 for r in rows) >= 50
    labels = cut.cut_tree(tree, [5])
    assert labels.count() == 1_300 and labels.select("cluster").distinct().count() == 5
    assert labels.where("unit = 3 or unit between 400 and 449").select("cluster").distinct().count() == 1


def test_copies_and_few_units(spark):
    x, g = vectors(6, 3)
    x[1], g[1] = x[0], g[0]
    same = unit_table(spark, {"s": (np.repeat(x[:1], 5, axis=0), np.repeat(g[:1], 5, axis=0)), "t": (x, g), "one": (x[:1], g[:1])})
    tree = graph_tree.ward_tree_graph(same, [0, 50])
    assert {(r["scenario"], r["count"]) for r in tree.merges.groupBy("scenario", "alpha_step").count().collect()} == {("s", 4), ("t", 5)}


def test_rounds_and_one_task_give_the_same_tree(spark, monkeypatch):
    rng = random.Random(4)
    keys = list(itertools.combinations(range(20), 2))
    rows = [(s, i, j, rng.random(), rng.random()) for s in ("a", "b") for i, j in keys]
    pairs = written(spark.createDataFrame(rows, "scenario string, i long, j long, d0 double, d1 double"), "p")
    units = spark.createDataFrame([(s, i) for s in ("a", "b") for i in range(20)], "scenario string, unit long")

    def merges(steps, mix):
        tree = ward.ward_tree(units, pairs, steps, mix)
        return {(r["scenario"], r["alpha_step"], r["left"], r["right"]): r for r in tree.merges.collect()}

    steps = {"a": [0, 30], "b": [77]}
    for mix in ("squared", "linear"):
        at_once = merges(steps, mix)
        monkeypatch.setattr(small_trees, "FEW", 7)
        by_round = merges(steps, mix)
        monkeypatch.setattr(small_trees, "FEW", 128)
        assert at_once.keys() == by_round.keys() and {k[:2] for k in at_once} == {("a", 0), ("a", 30), ("b", 77)}
        for k, r in at_once.items():
            assert all(brute.close(r[c], by_round[k][c]) for c in ("height", "dw0", "dw1"))


def test_vector_study_needs_no_pairs(spark):
    x, _ = vectors(30, 8)
    rng = np.random.default_rng(1)
    lon, lat = rng.uniform(-180, 180, 30), rng.uniform(-60, 60, 30)
    units = spark.createDataFrame([("s", i, x[i].tolist(), float(lon[i]), float(lat[i])) for i in range(30)],
                                  "scenario string, unit long, x array<double>, lon double, lat double")
    study = VectorStudy(units, k_max=6)
    assert study.stars.count() == 10 and study.inertia_at_stars().count() == 12
    with pytest.raises(ValueError):
        study.pairs
    assert study.cluster_units([(3, 50)]).count() == 30
    q = study.quality.where("alpha_step = 100").orderBy("k").collect()
    g = np.stack([np.cos(np.radians(lat)) * np.cos(np.radians(lon)), np.cos(np.radians(lat)) * np.sin(np.radians(lon)), np.sin(np.radians(lat))], axis=1)
    keys = list(itertools.combinations(range(30), 2))
    d = {(i, j): float(np.linalg.norm(g[i] - g[j])) for i, j in keys}
    for r in q:
        label = brute.cut(30, brute.ward(30, d, {k: v / max(d.values()) for k, v in d.items()}, 1.0, "squared"), r["k"])
        assert brute.close(r["q1"], brute.explained(30, d, label))


# ---- ranks -------------------------------------------------------------------

def test_rank_sums(spark):
    rng = random.Random(6)
    values = {"a": [rng.choice([rng.random(), 0.5, 1e9 * rng.random()]) for _ in range(700)], "b": [3.0] * 9, "c": [1.0, 2.0]}
    table = written(spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "key string, v double"), "v")
    bounds = table.groupBy("key").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    asked = [("a", 1), ("a", 333), ("a", 333), ("a", 700), ("a", 701), ("b", 4), ("c", 0), ("c", 2), ("d", 1)]
    got = {(r["key"], r["rank"]): (r["value"], r["total"]) for r in
           ranks.rank_sums(bounds, spark.createDataFrame(asked, "key string, rank long"), ranks.frame_bins(table)).collect()}
    assert set(got) == {("a", 1), ("a", 333), ("a", 700), ("b", 4), ("c", 2)}
    for (k, r), (value, total) in got.items():
        s = sorted(values[k])
        assert value == s[r - 1] and brute.close(total, sum(s[:r]))


def test_c_index_of_extremes(spark):
    pairs = written(spark.createDataFrame([("s", 0, 1, 1.0, 0.0), ("s", 0, 2, 4.0, 0.0), ("s", 1, 2, 5.0, 0.0)],
                                          "scenario string, i long, j long, d0 double, d1 double"), "p")
    labels = spark.createDataFrame([("s", 0, 2, i, int(i == 2)) for i in range(3)], "scenario string, alpha_step int, k int, unit long, cluster int")
    sums = indices.pair_sums(indices.labelled_pairs(pairs, labels))
    assert indices.c_index(pairs, sums, variant="extremes").first()["value"] == 0.0
    assert indices.c_index(pairs, sums).first()["value"] == 0.0


# ---- joins -------------------------------------------------------------------

def test_a_hot_unit_is_dealt_over_several_tasks(spark):
    boundaries = spark.createDataFrame([(f"c{i}", [i]) for i in range(30)], "code string, parts array<int>")
    rows = [("c3", f"v{i}", float(i)) for i in range(2_700)] + [(f"c{i % 20}", "w", 1.0) for i in range(300)] + [("lost", "w", 1.0), (None, "w", 1.0)]
    panel = spark.createDataFrame(rows, "code string, variable string, value double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = reshape.join_geometry(boundaries, panel)
        sizes = [r["n"] for r in joined.where("code = 'c3'").groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(sizes) > 3 and max(sizes) < 0.6 * 2_700
    got = sorted((r["code"], r["variable"] or "", r["value"] or 0.0) for r in joined.collect())
    assert got == sorted([(c, v, x) for c, v, x in rows if c in {f"c{i}" for i in range(30)}] + [(f"c{i}", "", 0.0) for i in range(20, 30)])
