import itertools
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from wardfield.operators import blocks, compare, indices, tiles
from wardfield.sources import sinks
from wardfield.state import written

N = 24


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    x = [[round(rng.gauss(c % 3, 1), 1) for c in (i, i + 1)] for i in range(N)]
    x[3] = list(x[2])  # identical units
    label = [0 if i == 0 else 1 + i % 3 for i in range(N)]  # cluster 0 has one unit
    other = [i // 9 for i in range(N)]
    d = {(i, j): float(np.linalg.norm(np.subtract(x[i], x[j]))) for i, j in itertools.combinations(range(N), 2)}
    units = spark.createDataFrame([("s", i, x[i], label[i], other[i]) for i in range(N)],
                                  "scenario string, unit long, x array<double>, label int, other int")
    pairs = spark.createDataFrame([("s", i, j, v, 0.0) for (i, j), v in d.items()],
                                  "scenario string, i long, j long, d0 double, d1 double")
    return x, {"label": label, "other": other}, d, written(units, "u"), written(pairs, "p")


def test_five_indices_over_pairs(data, spark):
    x, parts, d, units, pairs = data
    labels = spark.createDataFrame([("s", 0, k, i, p[i]) for k, p in ((4, parts["label"]), (3, parts["other"])) for i in range(N)],
                                   "scenario string, alpha_step int, k int, unit long, cluster int")
    got = {(r["k"], r["index"]): r["value"] for r in indices.five_indices(pairs, units, labels).collect()}
    for k, p in ((4, parts["label"]), (3, parts["other"])):
        want = {**brute.pair_indices(d, p), "Sil": brute.silhouette(N, d, p), "CH": brute.calinski_harabasz(x, p)}
        for name, value in want.items():
            assert brute.close(got[k, name], value), (k, name)


@pytest.mark.parametrize("block_rows", [2048, 5])
def test_tiles_give_the_same_indices(data, block_rows):
    x, parts, d, units, _ = data
    got = {(r["key"], r["index"]): r["value"] for r in
           tiles.vector_indices(units, {"label": 0, "other": 0}, block_rows=block_rows).collect()}
    for key, p in parts.items():
        want = {**brute.pair_indices(d, p), "Sil": brute.silhouette(N, d, p)}
        for name, value in want.items():
            assert brute.close(got[key, name], value), (key, name)


def test_tiles_move_no_unit_once_per_tile(spark, monkeypatch):
    rng = np.random.default_rng(6)
    written_rows, plain = {}, tiles.written

    def counted(df, label, path=None):
        table = plain(df, label, path)
        written_rows[label] = table.count()
        return table

    monkeypatch.setattr(tiles, "written", counted)
    x = rng.standard_normal((400, 3))
    x[5] = x[6]
    units = written(spark.createDataFrame([(i, x[i].tolist(), i % 3, i // 9) for i in range(400)], "unit long, x array<double>, few int, many int"), "u")
    parts = {"few": [i % 3 for i in range(400)], "many": [i // 9 for i in range(400)]}
    d = {(i, j): float(np.linalg.norm(x[i] - x[j])) for i, j in itertools.combinations(range(400), 2)}
    got = {(r["key"], r["index"]): r["value"] for r in
           tiles.vector_indices(units, {"few": 0, "many": 0}, ["Sil", "McClain", "Cindex"], block_rows=20).collect()}
    for key, p in parts.items():
        want = {**brute.pair_indices(d, p), "Sil": brute.silhouette(400, d, p)}
        assert all(brute.close(got[key, name], want[name]) for name in ("Sil", "McClain", "Cindex")), key
    # One row for each unit and cluster however many tiles there are, and none of them where no index asks for it.
    assert written_rows["tile-sums"] <= 400 * (3 + 45) + 2
    tiles.vector_indices(units, {"few": 0, "many": 0}, ["McClain"], block_rows=20).collect()
    assert written_rows["tile-sums"] == 2
    plan = spark._jvm.PythonSQLUtils.explainString(tiles.tile_sums(tiles.packed(units.withColumn("labels", F.array("few")), 400, 20), [(0, 0.0)], (1.0, 1.0))._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan


def test_tiles_blend_places_and_skip_missing_features(spark):
    rng = random.Random(9)
    rows = [(i, [rng.random(), None if i % 5 == 0 else rng.random()], rng.uniform(-90, 90), rng.uniform(-60, 60), i % 3)
            for i in range(15)]
    units = spark.createDataFrame(rows, "unit long, x array<double>, lon double, lat double, c int")
    units = units.withColumn("g", tiles.unit_point())
    got = {r["index"]: r["value"] for r in tiles.vector_indices(units, {"c": 40}, ["Dunn", "McClain"], block_rows=4).collect()}

    def feature(a, b):
        shared = [(p - q) ** 2 for p, q in zip(a, b) if p is not None and q is not None]
        return (sum(shared) * 2 / len(shared)) ** 0.5

    def arc(a, b):
        lo1, la1, lo2, la2 = map(np.radians, (a[2], a[3], b[2], b[3]))
        h = np.sin((la2 - la1) / 2) ** 2 + np.cos(la1) * np.cos(la2) * np.sin((lo2 - lo1) / 2) ** 2
        return 2 * np.arcsin(np.sqrt(h))

    keys = list(itertools.combinations(range(15), 2))
    f = {(i, j): feature(rows[i][1], rows[j][1]) for i, j in keys}
    g = {(i, j): arc(rows[i], rows[j]) for i, j in keys}
    d = {k: 0.6 * f[k] / max(f.values()) + 0.4 * g[k] / max(g.values()) for k in keys}
    want = brute.pair_indices(d, [r[4] for r in rows])
    assert brute.close(got["Dunn"], want["Dunn"]) and brute.close(got["McClain"], want["McClain"])


def test_total_inertia_of_vectors_needs_no_pairs(data):
    _, _, d, units, _ = data
    got = tiles.vector_inertia(units).first()["inertia"]
    assert brute.close(got, sum(v * v for v in d.values()) / N ** 2)


def test_adjusted_rand(spark, data):
    parts = {**data[1], "renamed": [9 - c for c in data[1]["label"]], "one": [1] * N}
    labels = spark.createDataFrame([(k, i, p[i]) for k, p in parts.items() for i in range(N)],
                                   "key string, unit long, cluster int")
    got = {(r["left_key"], r["right_key"]): r["ari"] for r in compare.adjusted_rand(labels).collect()}
    assert len(got) == 16
    assert brute.close(got["label", "other"], brute.adjusted_rand(parts["label"], parts["other"]))
    assert got["label", "other"] == got["other", "label"]
    assert got["label", "renamed"] == got["label", "label"] == got["one", "one"] == 1.0
    assert got["one", "label"] == 0.0


def test_sinks_overwrite(spark, tmp_path):
    ari = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("b", "a", 0.5), ("b", "b", 1.0)],
                                "left_key string, right_key string, ari double")
    for _ in range(2):
        sinks.write_ari(ari, ["a", "b"], str(tmp_path / "ari"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "ari"))
    assert back.count() == 2 and back.columns == ["left_key", "a", "b"]
    prof = spark.createDataFrame([("x", 1, 2.0), ("y", 1, 3.0)], "sheet string, cluster int, mean double")
    for _ in range(2):
        sinks.write_cluster_profiles(prof, str(tmp_path / "prof"))
    assert spark.read.parquet(str(tmp_path / "prof")).where(F.col("sheet") == "y").first()["mean"] == 3.0


def test_c_index_reads_all_pairs_once_for_sums_and_first_bins(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((700, 3)) * 1e-3 + rng.integers(0, 2, (700, 1)) * 40.0
    x[11], x[12, 1] = x[10], np.nan
    label = rng.integers(0, 4, 700)
    rows = [(i, [None if np.isnan(v) else float(v) for v in x[i]], int(label[i])) for i in range(700)]
    units = written(spark.createDataFrame(rows, "unit long, x array<double>, c int"), "u")
    passes, plain = [], tiles._over
    monkeypatch.setattr(tiles, "_over", lambda *a: passes.append(a[2]) or plain(*a))
    got = tiles.vector_indices(units, {"c": 0}, ["Cindex"], block_rows=100).first()["value"]
    shared = ~np.isnan(x[:, None] - x[None])
    gap = np.nan_to_num(x[:, None] - x[None])
    d = np.sqrt((gap * gap).sum(2) * 3 / shared.sum(2))
    d = {(i, j): float(d[i, j]) for i, j in itertools.combinations(range(700), 2)}
    assert brute.close(got, brute.pair_indices(d, list(label))["Cindex"])
    # The same pass gives sums and bins; the others look at values in open bins only.
    assert [("s_w" in schema, "b int" in schema) for schema in passes] == [(True, True)] + [(False, True)] * (len(passes) - 1) and len(passes) <= 4


def test_squared_distances_in_strips_are_those_of_the_whole():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((150, 5)), rng.standard_normal((40, 5))
    b[3] = a[100]
    for hole in (False, True):
        if hole:
            a[7, 2] = np.nan
        got = np.concatenate([d.copy() for _, d in blocks.squared_strips(a, b)])
        assert np.allclose(got, blocks.squared(a, b), rtol=1e-12) and got[100, 3] == 0
