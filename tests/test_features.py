"""Features, axes and clean-up against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom.functions import kernels
from spikeloom.jobs import recluster, sorting
from spikeloom.operators import features, model


@pytest.fixture(scope="module")
def waves():
    rng = np.random.default_rng(12)
    label = rng.integers(0, 3, 240)
    return label, rng.normal(size=(3, 8))[label] * 3 + rng.normal(size=(240, 8)), np.sort(rng.random(240) * 9000)


@pytest.fixture(scope="module")
def table(spark, waves):
    label, x, time = waves
    rows = [("r", i, float(t), int(c), v.tolist()) for i, (c, v, t) in enumerate(zip(label, x, time))]
    return spark.createDataFrame(rows, "recording_id string, spike_id long, time double, label long, waveform array<double>").repartition(3).cache()


def matrix(df, column):
    return np.array([r[column] for r in df.orderBy("spike_id").collect()])


def test_feature_matrix_and_its_axes(table, waves):
    _, x, time = waves
    t = time / 7200 - (time / 7200).mean()
    expected = np.column_stack([kernels.zscores(kernels.scores(x, 4)), t])
    assert np.allclose(matrix(features.feature_matrix(table, 4), "features"), expected, atol=1e-8)
    # standardised scores have equal variances, so axes are only known up to a turn: spreads and distances are not
    turned, by_hand = matrix(features.pca_time(table, k=4), "pcs"), kernels.scores(expected, 4)
    assert np.allclose(turned.var(axis=0), by_hand.var(axis=0)) and np.allclose(np.cov(turned.T) - np.diag(turned.var(axis=0, ddof=1)), 0, atol=1e-8)
    apart = lambda x: ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.allclose(apart(turned), apart(by_hand), atol=1e-6)


def test_discriminant_axis(table, waves):
    label, x, _ = waves
    stats = features.group_statistics(table, ["recording_id", "label"])
    side = lambda c, tag: stats.filter(F.col("label") == c).select("recording_id", F.col("mean").alias(f"mean_{tag}"), F.col("scatter").alias(f"scatter_{tag}"))
    axis = np.array(features.discriminant_axis(side(0, "a").join(side(1, "b"), "recording_id")).first().axis)
    a, b = x[label == 0], x[label == 1]
    within = sum((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in (a, b))
    by_hand = np.linalg.solve(within, b.mean(axis=0) - a.mean(axis=0))
    assert np.allclose(axis, by_hand / np.linalg.norm(by_hand), atol=1e-8)
    groups = table.select("recording_id", "label").distinct().filter("label = 1").withColumn("group", F.lit("unit"))
    seen = features.time_vs_axis(table, groups).orderBy("spike_id").collect()
    assert [r.group == "unit" for r in seen] == (label == 1).tolist() and len(seen) == 240
    line = np.array([r.x for r in seen])
    rest = x[label != 1]
    spread = (a_ := x[label == 1]).shape[0] and sum((g - g.mean(axis=0)).T @ (g - g.mean(axis=0)) for g in (a_, rest))
    best = np.linalg.solve(spread, a_.mean(axis=0) - rest.mean(axis=0))
    assert abs(np.corrcoef(line, x @ best)[0, 1]) > 1 - 1e-9


def test_projection(table, waves):
    _, x, _ = waves
    assert np.allclose(matrix(features.project(table, lambda m: m[:, :2] ** 2), "projected"), x[:, :2] ** 2)


def test_trimmed_clusters(spark, waves):
    _, x, _ = waves
    x = x.copy()
    x[7] += 60
    rows = [("r", i, float(i), v.tolist(), 0, int(i >= 232)) for i, v in enumerate(x)]
    kept = {r.spike_id for r in sorting.trimmed(spark.createDataFrame(rows, sorting.WINDOWED)).collect()}
    lof = kernels.local_outlier_factor(x[:232], 10)
    assert kept == set(np.argsort(lof, kind="stable")[: 232 - 23].tolist()) and 7 not in kept  # the cluster of eight is too small


def test_cleaned_assignments(spark, waves):
    label, x, time = waves
    wrong = label.copy()
    wrong[::30] = (wrong[::30] + 1) % 3
    rows = [("r", int(c), i, 5, float(t), v.tolist()) for i, (c, v, t) in enumerate(zip(wrong, x, time))]
    subs = spark.createDataFrame(rows, "recording_id string, label long, sub_label long, n long, med_time double, centroid array<double>")
    got = [r.new_label for r in recluster.cleaned_assignments(subs).orderBy("sub_label").collect()]
    t = time / 3600 - (time / 3600).mean()
    by_hand = kernels.knn_vote(kernels.scores(np.column_stack([kernels.zscores(kernels.scores(x, 6)), t]), 6), wrong, 3)
    assert got == by_hand.tolist()


def test_sample_of_clusters(table):
    rows = model.every_kth_of_cluster(table, 10, seed=3).collect()
    assert {(r.spike_id, r.label) for r in rows} == {(r.spike_id, r.label) for r in model.every_kth_of_cluster(table, 10, seed=3).collect()}
    for c in range(3):
        order = [r.spike_id for r in table.filter(F.col("label") == c).orderBy("time").collect()]
        at = sorted(order.index(r.spike_id) for r in rows if r.label == c)
        k = max(1, len(order) // 10)
        assert len(set(np.diff(at))) == 1 and at[1] - at[0] == k and at[0] < k and at[-1] >= len(order) - k


def test_closest_meets_few_points_however_dense(spark):
    """Dense and lonely points, equal ones and equal queries, against every pair; cells are narrowed where points are dense."""
    rng = np.random.default_rng(12)
    p = np.concatenate([rng.normal(size=(3000, 2)) * 0.05, rng.uniform(-6, 6, size=(60, 2))])
    p[7] = p[5] = p[2000]
    q = np.concatenate([rng.normal(size=(40, 2)) * 0.05, rng.uniform(-7, 7, size=(60, 2)), p[[5, 5, 3001]]])
    points = spark.createDataFrame([("r", i, *v) for i, v in enumerate(p.tolist())], "recording_id string, spike_id long, x double, y double")
    queries = spark.createDataFrame([("r", i, *v) for i, v in enumerate(q.tolist())], "recording_id string, query_id long, qx double, qy double")
    found = features.closest(points, queries, 2.0)
    got = {r.query_id: (r.spike_id, r.distance) for r in found.collect()}
    expected = {}
    for i, v in enumerate(q):
        d = np.sqrt((p[:, 0] - v[0]) ** 2 + (p[:, 1] - v[1]) ** 2)
        if d.min() < 2.0:
            expected[i] = (int(d.argmin()), d.min())
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in expected.items()}
    assert all(abs(got[i][1] - expected[i][1]) < 1e-12 for i in got)
    assert found.select("query_id").distinct().count() == found.count() and features.CELL_POINTS < 3000


def test_axes_go_to_the_rows(spark):
    """No shuffle of rows by recording: the axes' table is of known size."""
    rows = spark.range(2000).selectExpr("concat('r', id % 2) AS recording_id", "id AS spike_id", "CAST(id AS double) AS time", "array(rand(1), rand(2), rand(3)) AS waveform")
    for made in (features.principal_scores(rows, 2), features.time_feature(rows)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
