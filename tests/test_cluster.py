import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusfold.operators import cluster, quality
from corpusfold.operators.choose import (
    candidate_ks, check_max_clusters, k_candidates, select_k, sweep_k)
from corpusfold.session import write_shared


def vectors(spark, x, labels=None):
    rows = [(i, [float(v) for v in row], [int(c) for c in labels[i]] if labels is not None else [])
            for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id int, features array<double>, labels array<int>")


def distances(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(2))


def plain_metrics(x, label, power=1):
    d, n, ks = distances(x) ** power, len(x), np.unique(label)
    scores = []
    for i in range(n):
        own = (label == label[i])
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in ks if c != label[i])
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    within = sum(((x[label == c] - x[label == c].mean(0)) ** 2).sum() for c in ks)
    between = sum((label == c).sum() * ((x[label == c].mean(0) - x.mean(0)) ** 2).sum() for c in ks)
    return within, float(np.mean(scores)), between / (len(ks) - 1) / (within / (n - len(ks)))


@pytest.mark.parametrize("method,power", [("exact", 1), ("squared", 2)])
def test_metrics_against_plain_numpy(spark, monkeypatch, method, power):
    monkeypatch.setattr(quality, "TILE_ROWS", 17)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 1, (20, 3)) for c in (0, 2, 1000)])
    labels = np.stack([rng.integers(0, 3, 60), np.r_[np.zeros(59, int), 1], np.repeat([0, 1, 3], 20)], axis=1)
    got = quality.labelling_metrics(vectors(spark, x, labels), [3, 2, 4], silhouette=method).collect()
    for j, row in enumerate(got):
        assert [row.distortion, row.silhouette, row.calinski] == pytest.approx(
            plain_metrics(x, labels[:, j], power), rel=1e-6, abs=1e-7)


def test_squared_silhouette_agrees_with_spark(spark):
    rng = np.random.default_rng(4)
    x, labels = rng.normal(size=(50, 4)), rng.integers(0, 3, (50, 1))
    df = vectors(spark, x, labels).withColumns({"vector": array_to_vector("features"), "prediction": F.col("labels")[0].cast("double")})
    spark_value = ClusteringEvaluator(featuresCol="vector", metricName="silhouette").evaluate(df)
    got = quality.silhouette(df, 3, "squared", cluster="prediction").first().silhouette
    assert got == pytest.approx(spark_value, abs=1e-9)


def test_one_silhouette_at_all_sizes(spark):
    for n in (12, 10_002):
        x, labels = np.random.default_rng(5).normal(size=(n, 2)), np.tile([[0], [1]], (n // 2, 1))
        df = vectors(spark, x, labels)
        squared = quality.labelling_metrics(df, [2], silhouette="squared").first().silhouette
        assert quality.labelling_metrics(df, [2]).first().silhouette == squared


def test_dense_sparse_and_mixed_vectors_give_the_same(spark):
    x = np.random.default_rng(6).normal(size=(30, 5))
    x[x < 0] = 0
    rows = [(i, Vectors.dense(r) if i % 2 else Vectors.sparse(5, {int(j): float(r[j]) for j in np.flatnonzero(r)}),
             [i % 3]) for i, r in enumerate(x)]
    mixed = spark.createDataFrame(rows, ["id", "features", "labels"])
    mixed = mixed.withColumn("labels", F.col("labels").cast("array<int>"))
    a = quality.labelling_metrics(mixed, [3], silhouette="exact").first()
    b = quality.labelling_metrics(vectors(spark, x, np.arange(30)[:, None] % 3), [3], silhouette="exact").first()
    assert list(a) == pytest.approx(list(b))
    centers = x[:4]
    assert [r.cluster for r in cluster.assign(mixed, centers).orderBy("id").collect()] == [
        int(((x[i] - centers) ** 2).sum(1).argmin()) for i in range(30)]


def test_fits_are_local_optima_and_repeatable(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.2, (15, 2)) for c in ((0, 0), (3, 0), (0, 3), (3, 3), (9, 9))])
    df = write_shared(vectors(spark, x).repartition(5), "points")
    fits = cluster.fit_all(df, [2, 5], restarts=6)
    again = cluster.fit_all(df.repartition(3), [5], restarts=6)[0]
    labels = ((x[:, None] - fits[1].centers[None]) ** 2).sum(2).argmin(1)
    assert sorted(np.bincount(labels)) == [15] * 5
    assert fits[1].cost == pytest.approx(plain_metrics(x, labels)[0])
    assert np.allclose(sorted(map(tuple, again.centers)), sorted(map(tuple, fits[1].centers)))
    ml = min(cluster.kmeans(df, 2, seed=s).summary.trainingCost for s in range(3))
    assert fits[0].cost <= ml * 1.0001


def test_restarts_run_in_slices_when_state_is_large(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(40, 3))
    df = write_shared(vectors(spark, x), "points")
    together = cluster.kmeans_best(df, 3, restarts=4)
    monkeypatch.setattr(cluster, "STATE_BYTES", 1)
    assert cluster.kmeans_best(df, 3, restarts=4).cost == pytest.approx(together.cost)


def test_fewer_distinct_rows_than_clusters(spark):
    df = write_shared(vectors(spark, np.array([[0.0, 0.0]] * 5 + [[1.0, 1.0]] * 5)), "points")
    assert cluster.kmeans_best(df, 4, restarts=2).cost == pytest.approx(0.0)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_small_inputs(spark, n):
    x = np.random.default_rng(n).random((n, 10))
    sweep = sweep_k(write_shared(vectors(spark, x), "points"), restarts=2)
    k = select_k(sweep.metrics, sweep.n).first().k
    assert (k == 1) if n <= 2 else (2 <= k < n)


def test_uniform_points_stay_in_range(spark):
    x = np.random.default_rng(0).random((100, 10))
    sweep = sweep_k(write_shared(vectors(spark, x), "points"), restarts=3)
    assert [r.k for r in sweep.metrics.collect()] == list(range(2, 11))
    assert 1 < select_k(sweep.metrics, sweep.n).first().k <= 10


def test_four_tight_groups_reach_the_maximum(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(c, 0.1, (5, 2)) for c in ((0, 0), (1000, 1000), (2000, 2000), (3000, 3000))])
    sweep = sweep_k(write_shared(vectors(spark, x), "points"), max_clusters=4)
    assert select_k(sweep.metrics, sweep.n).first().k == 4


def plain_vote(rows, n):
    ks, dist, sil, cal = zip(*[(r[0], r[1], r[2], r[3]) for r in rows])
    named = [ks[int(np.argmax(sil))], ks[int(np.argmax(cal))]]
    bend = np.diff(dist, 2)
    if len(bend):
        named.append(ks[int(np.argmin(bend))])
    best = max(named, key=lambda k: (named.count(k), -named.index(k)))
    return min(max(best, 2), n - 1)


def test_vote_against_plain_python(spark):
    rng = np.random.default_rng(9)
    for size in (1, 2, 3, 4, 9):
        for _ in range(3):
            rows = [(k, *map(float, rng.integers(0, 4, 3))) for k in range(2, 2 + size)]
            metrics = spark.createDataFrame(rows, quality.METRICS)
            assert select_k(metrics, size + 2).first().k == plain_vote(rows, size + 2), rows


def test_three_way_tie_goes_to_silhouette_and_majority_beats_it(spark):
    tie = spark.createDataFrame([(2, 9.0, 0.9, 1.0), (3, 8.0, 0.1, 9.0), (4, 1.0, 0.1, 1.0), (5, 0.5, 0.1, 1.0),
                                 (6, 0.4, 0.1, 1.0)], quality.METRICS)
    named = {r.priority: r.k for r in k_candidates(tie).collect()}
    assert named[0] == 2 and named[1] == 3 and select_k(tie, 10).first().k == 2
    agree = spark.createDataFrame([(2, 9.0, 0.9, 9.0), (3, 8.0, 0.1, 9.5), (4, 7.5, 0.1, 1.0), (5, 1.0, 0.1, 1.0),
                                   (6, 0.9, 0.1, 1.0)], quality.METRICS)
    assert {r.priority: r.k for r in k_candidates(agree).collect()} == {0: 2, 1: 3, 2: 3}
    assert select_k(agree, 10).first().k == 3


def test_candidates_and_limits():
    assert candidate_ks(100) == list(range(2, 11)) and candidate_ks(4, 10) == [2, 3] and candidate_ks(2) == []
    with pytest.raises(ValueError):
        check_max_clusters(2)


def test_starts_take_few_passes_and_are_no_worse(spark, monkeypatch):
    rng = np.random.default_rng(11)
    data = np.concatenate([rng.normal(c, 1.0, (60, 6)) for c in rng.uniform(-12, 12, (8, 6))])
    df = write_shared(spark.createDataFrame([(v.tolist(),) for v in data], "features array<double>").repartition(4), "blobs")
    passes, draw, weigh = [], cluster._draw, cluster._weigh
    monkeypatch.setattr(cluster, "_draw", lambda *a: passes.append("draw") or draw(*a))
    monkeypatch.setattr(cluster, "_weigh", lambda *a: passes.append("weigh") or weigh(*a))
    points = df.select(*cluster.vector_columns(df), F.xxhash64("features", F.lit(1)).alias("draw"))
    k = 8
    fits = list(cluster._fit_lanes(points, 6, [k], range(10), 1, 100, 1e-4))
    assert len(passes) == 5 and len(fits) == 10

    def plain(seed):
        """k-means++, one centre at a time, then Lloyd."""
        own = np.random.default_rng(seed)
        centers = data[[own.integers(len(data))]]
        while len(centers) < k:
            w = ((data[:, None] - centers) ** 2).sum(2).min(1)
            centers = np.concatenate([centers, data[[own.choice(len(data), p=w / w.sum())]]])
        for _ in range(100):
            label = ((data[:, None] - centers) ** 2).sum(2).argmin(1)
            centers = np.stack([data[label == c].mean(0) if (label == c).any() else centers[c] for c in range(k)])
        return ((data[:, None] - centers) ** 2).sum(2).min(1).sum()

    assert np.mean([f.cost for f in fits]) <= 1.02 * np.mean([plain(seed) for seed in range(10)])


def test_fewer_different_rows_than_centres(spark):
    df = write_shared(spark.createDataFrame([([1.0, 2.0],)] * 7 + [([5.0, 5.0],)] * 2, "features array<double>"), "twos")
    fits = cluster.fit_all(df, [2, 3], restarts=2)
    assert [f.k for f in fits] == [2, 3] and all(f.cost < 1e-9 and np.isfinite(f.centers).all() for f in fits)


def test_sampled_silhouette_keeps_its_bound_and_grows_with_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    data = np.concatenate([rng.normal(c, s, (n, 5)) for c, s, n in ((0, 1, 500), (4, 2, 250), (-3, .5, 40), (9, 1, 5))] + [np.full((120, 5), 2.0)])
    labels = np.repeat(np.arange(5), [500, 250, 40, 5, 120])
    df = write_shared(spark.createDataFrame([(v.tolist(), int(c), [int(c), int(c) % 2]) for v, c in zip(data, labels)],
                                            "features array<double>, cluster int, labels array<int>").repartition(3), "rows")
    exact = [r.silhouette for r in quality.labelling_metrics(df, [5, 2], silhouette="exact").orderBy("k", ascending=False).collect()]
    sizes, drawn = [], quality._drawn_rows
    monkeypatch.setattr(quality, "_drawn_rows", lambda *a: sizes.append(drawn(*a)) or sizes[-1])
    for error, near in ((0.1, 1e-9), (0.3, 0.05), (0.5, 0.1)):
        found = [r.silhouette for r in quality.labelling_metrics(df, [5, 2], silhouette="sampled", error=error).orderBy("k", ascending=False).collect()]
        assert all(abs(a - b) <= min(4 * error / (1 - error), near) for a, b in zip(found, exact))
    # Two samples a run, the first a handful; the last sample is a part of the rows.
    assert len(sizes[-1].x) < 0.8 * len(data) and len(sizes[0].x) < 200
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100)
    with pytest.raises(ValueError):
        quality.silhouette(df, 5, "sampled")


def test_tiles_of_the_exact_silhouette_are_few():
    assert quality._tiles(999, 64, 8) == 1 and quality._tiles(8_000, 64, 8) == 8
    # Every row travels once per tile: 600 times with tiles of 1000 rows.
    assert quality._tiles(600_000, 64, 12) == 19 and quality._tiles(600_000, 4096, 12) == 600


def test_distances_held_at_a_time_are_bounded():
    x = pa.array(list(np.arange(20_000.0).reshape(-1, 2)), pa.list_(pa.float64()))
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.list_(pa.int32())), x], names=["v_idx", "v_val"])
    parts = [v for _, v in quality._few_rows(batch, 2, 1024)]
    assert max(len(v) for v in parts) * 1024 * 8 <= quality.PAIR_BYTES and np.array_equal(np.concatenate(parts).ravel(), np.arange(20_000.0))


@pytest.mark.parametrize("task_bytes", [1, 1 << 30])
def test_sums_of_a_pass_over_blocks_are_those_of_numpy(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(cluster, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(cluster, "BLOCK_BYTES", 1000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 4))
    runs = [x[:3].copy(), x[3:8].copy()]
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v_val array<double>").repartition(4)
    points = cluster.as_blocks(rows.select(F.lit(None).cast("array<int>").alias("v_idx"), "v_val", F.xxhash64("v_val").alias("draw")))
    assert points.count() > 8
    found = cluster._lloyd_pass(points, points.getNumPartitions(), 4, runs)
    points.unpersist()
    slot = 0
    for centers in runs:
        away = ((x[:, None] - centers) ** 2).sum(2)
        for c in range(len(centers)):
            own = away.argmin(1) == c
            n, cost, total = found[slot]
            assert n == own.sum() and np.isclose(cost, away[own, c].sum()) and np.allclose(total, x[own].sum(0))
            slot += 1
    assert found[-1][0] == 500 and np.isclose(found[-1][1], (x * x).sum()) and np.allclose(found[-1][2], x.sum(0))


@pytest.mark.parametrize("dim", [3, 64])
def test_nearest_centres_of_all_runs_against_a_search_for_each_row(dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(500, dim))
    runs = [x[rng.choice(500, k, replace=False)] for k in (1, 2, 5, 9) for _ in range(3)]
    # Of equal centres the first is taken.
    runs.append(np.stack([x[1], x[0], x[0], x[0]]))
    label, least = cluster._nearest(x, runs)
    assert label.shape == least.shape == (len(runs), len(x))
    for own, at, away in zip(runs, label, least):
        d = ((x[:, None] - own) ** 2).sum(2)
        assert np.array_equal(at, d.argmin(1)) and np.allclose(away, d.min(1), atol=1e-9) and (away >= 0).all()
