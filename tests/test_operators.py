"""Hand-computed cases of the spike-train operators."""


import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeloom import catalog
from spikeloom.functions import kernels
from spikeloom.jobs import recluster
from spikeloom.operators import align, curate, features, graph, metrics, model, windows
from spikeloom.sources import io


def spikes(spark, times, labels=None, subs=None, recording="r"):
    n = len(times)
    rows = [(recording, float(t), i, (labels or [0] * n)[i], (subs or [0] * n)[i]) for i, t in enumerate(times)]
    return model.spike_table(spark.createDataFrame(rows, "recording_id string, time double, tie long, label long, sub_label long"), "tie")


def test_spikes_are_ordered_and_numbered(spark):
    rows = spark.createDataFrame([("r", 1.0, 10), ("r", 1.5, 15), ("r", 0.5, 5), ("r", 2.0, 20)], "recording_id string, time double, data int")
    got = model.spike_table(rows, "data").orderBy("spike_id").collect()
    assert [(r.spike_id, r.data, r.label) for r in got] == [(0, 5, 0), (1, 10, 0), (2, 15, 0), (3, 20, 0)]
    ranged = model.spike_table_ranged(rows, 3, "data").orderBy("spike_id").collect()
    assert [(r.spike_id, r.data) for r in ranged] == [(r.spike_id, r.data) for r in got]
    assert rows.agg(F.median("time")).first()[0] == 1.25


def test_vector_order_and_centroid(spark):
    rows = spark.createDataFrame([("r", 1.0, [10.0, 0.0]), ("r", 1.5, [15.0, 0.0]), ("r", 0.5, [5.0, 1.0]), ("r", 2.0, [20.0, 1.0])], "recording_id string, time double, waveform array<double>")
    assert model.vector_mean(rows, ["recording_id"]).first().centroid == [12.5, 0.5]


def test_clusters_are_ordered_by_median_time(spark):
    d = spikes(spark, [1, 3, 4, 2, 4, 4.5], [0, 0, 0, 1, 1, 1])
    assert [r.label for r in model.labeled_nodes(d).orderBy("node_id").collect()] == [0, 1]
    d = spikes(spark, [1, 3, 4, 1, 2, 5], [0, 0, 0, 1, 1, 1])
    assert [r.label for r in model.labeled_nodes(d).orderBy("node_id").collect()] == [1, 0]


def test_selections(spark):
    d = spikes(spark, [1, 2, 3, 4])
    assert [r.spike_id for r in model.select_where(d, F.col("time") != 2).orderBy("time").collect()] == [0, 2, 3]
    positions = spark.createDataFrame([("r", 1), ("r", 2)], "recording_id string, spike_id long")
    assert [r.time for r in model.select_positions(d, positions).orderBy("time").collect()] == [2.0, 3.0]
    with pytest.raises(ValueError):
        model.match_several(d, labels=[1], nodes=[1])
    with pytest.raises(Exception, match="matching clusters"):
        model.match_one(model.labeled_nodes(spikes(spark, [1, 2], [0, 1])), F.col("label") >= 0).collect()


def test_positions_of_every_recording(spark):
    d = spikes(spark, [1, 2, 3]).union(spikes(spark, [4, 5], recording="s"))
    positions = spark.createDataFrame([(1,), (1,), (2,)], "spike_id long")
    got = model.select_positions(d, positions)
    assert sorted((r.recording_id, r.spike_id) for r in got.collect()) == [("r", 1), ("r", 2), ("s", 1)]
    plan = catalog.queries()["f2_select_positions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Inner" not in plan and "Cross" not in plan


def test_windows(spark):
    got = lambda t: [(r.window_idx, r.n) for r in windows.duration_windows(spikes(spark, t), 1.0).orderBy("window_idx").collect()]
    assert got([0.5, 1.0, 1.5, 2.0]) == [(0, 1), (1, 2)]
    assert got([0.5, 2.5]) == [(0, 1), (1, 0), (2, 1)]
    assert got([-1.0, 0.5]) == [(0, 1)]
    rows = windows.row_windows(spikes(spark, range(5)), 2).orderBy("first").collect()
    assert [(r.first, r.stop) for r in rows] == [(0, 2), (2, 4), (4, 5)]


def test_hierarchy(spark):
    d = spikes(spark, range(6), [0, 0, 1, -1, 1, 0])
    assert [r.sub_label for r in model.window_hierarchy(d, 3).orderBy("spike_id").collect()] == [0, 0, 1, -1, 4, 3]
    rows = [("r", 0, 0, [1.0]), ("r", 0, 0, [3.0]), ("r", 0, 3, [10.0])]
    waves = spark.createDataFrame(rows, "recording_id string, label long, sub_label long, waveform array<double>")
    assert model.hierarchy_centroids(waves).first().centroid == [6.0]


def test_edits(spark):
    empty = spark.createDataFrame([], "recording_id string, spike_id long, time double, label long")
    new = spark.createDataFrame([("r", 0, 5.0, 7), ("r", 1, 1.0, 8)], "recording_id string, spike_id long, time double, part long")
    assert sorted((r.spike_id, r.label) for r in curate.add_clusters(empty, new).collect()) == [(0, 2), (1, 1)]
    a = spikes(spark, range(3), [0, 1, 4]).select("recording_id", "spike_id", "time", "label")
    two = a.filter("label < 2").select("recording_id", "label")
    assert {r.label for r in curate.merge_clusters(a, two).collect()} == {4, 5}
    assert {r.label for r in curate.merge_clusters(a.filter("label < 2"), two).collect()} == {1}
    assert curate.merge_clusters(a, two).count() == a.count()


def test_edit_log():
    fold = lambda n, log: curate.fold_edits({i: i for i in range(n)}, {i: float(-i) for i in range(n)}, [(a, x, {}) for a, x in log])
    assert fold(4, [("merge", [1, 2]), ("delete", [3]), ("undo", []), ("hide", [0]), ("reveal", []), ("undo", []), ("redo", [])]) == {0: 5, 1: 4, 2: 4, 3: 3}
    assert fold(2, [("delete", [0]), ("restore", [])]) == {0: 0, 1: 1}
    # two hidden clusters come back in the order of their times
    assert fold(3, [("hide", [0]), ("hide", [2]), ("reveal", [])]) == {1: 1, 2: 2, 0: 3}


def test_medians_by_selection(spark, monkeypatch):
    """As F.median: ties, even counts, groups of one, and groups far larger than the sketch keeps."""
    rng = np.random.default_rng(4)
    groups = {"one": [3.5], "two": [1.0, 2.0], "ties": [5.0] * 1001, "mixed": [1.0] * 50 + [2.0] * 50, "many": rng.normal(size=30_000).tolist(), "steps": rng.integers(0, 7, 20_001).astype(float).tolist()}
    rows = spark.createDataFrame([("r", k, float(v)) for k, g in groups.items() for v in g] + [("r", "two", None)], "recording_id string, k string, time double").repartition(5)
    for accuracy in (10_000, 200):
        monkeypatch.setattr(model, "ACCURACY", accuracy)
        got = {r.k: (r.n, r.med_time) for r in model.medians(rows, ["recording_id", "k"]).collect()}
        assert got == {k: (len(g), float(np.median(g))) for k, g in groups.items()}
    counted = model.medians(rows.filter("k = 'many'"), ["recording_id", "k"])
    assert counted.count() == 1


def test_flattened_labels(spark):
    """Labels where they are unique in the recording, else positions in time."""
    rows = [(r, node, label, node * 10 + sub, t) for r, node, label, sub, t in [("u", 0, 7, 0, 9.0), ("u", 0, 7, 1, 8.0), ("u", 1, 4, 0, 1.0), ("v", 0, 7, 0, 9.0), ("v", 0, 7, 1, 8.0), ("v", 1, 7, 0, 1.0)]]
    table = spark.createDataFrame(rows, "recording_id string, node long, label long, sub_label long, time double").withColumn("spike_id", F.col("sub_label"))
    expected = {("u", 0): 7, ("u", 1): 7, ("u", 10): 4, ("v", 0): 1, ("v", 1): 1, ("v", 10): 0}
    for depth in (None, 1, 2):
        assert {(r.recording_id, r.sub_label): r.label for r in model.flatten(table, depth).collect()} == expected
    assert {r.label for r in model.flatten(table, 1, assign_labels=False).collect()} == {0, 1, 10}
    assert model.flatten(table, 0).columns == table.columns


def test_rates_and_violations(spark):
    r = metrics.violations(spikes(spark, [0, 0.0005, 0.1])).first()
    assert (round(r.rate, 9), r.violation_rate) == (30.0, 0.5) and math.isclose(r.chance, 1 - math.exp(-0.03))
    alone = metrics.violations(spikes(spark, [1.0])).first()
    assert alone.rate is None and alone.violation_rate is None


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_ranged_intervals(spark, width):
    rng = np.random.default_rng(3)
    d = spikes(spark, (rng.integers(-200, 200, 300) / 10).tolist(), rng.integers(0, 3, 300).tolist())
    of = lambda df: {r.spike_id: r.isi for r in df.collect()}
    for by_label in (True, False):
        assert of(windows.intervals(d, by_label, width)) == of(windows.intervals(d, by_label))
    plain = d.withColumn("label", F.lit(7).cast("long"))
    assert {r.across for r in windows.marked_intervals(plain, width).collect()} == {False}
    assert windows.marked_intervals(d, width).count() == 299 and windows.marked_intervals(d.limit(0), width).count() == 0


def test_histogram_closes_its_last_bin(spark):
    h = metrics.isi_histogram(spikes(spark, [0.0, 0.25, 0.75, 1.75, 4.0]), high=1.0, bins=4).orderBy("bin").collect()
    assert [r.n for r in h] == [0, 1, 1, 1] and math.isclose(h[3].density, 1 / 3 / 0.25)


def test_alignment_and_psth(spark):
    stimuli = spark.createDataFrame([("r", "playback", 0, 1.0), ("r", "playback", 1, 5.0)], io.STIMULI)
    got = align.align(spikes(spark, [0.5, 1.0, 1.5, 2.0]), stimuli, -0.5, 0.5).orderBy("stim_id", "rel_time").collect()
    assert [(r.stim_id, r.rel_time) for r in got] == [(0, -0.5), (0, 0.0), (1, None)]
    p = align.psth(spikes(spark, [0.2, 1.0, 1.12, 1.63, 1.81, 1.97]), stimuli).collect()
    assert {r.bin for r in p if r.per_trial} == {0, 2, 12, 16, 19} and {r.n_stim for r in p} == {1}


def test_aligned_spikes_are_not_moved_again(spark):
    """One join of the two inputs, stimuli without spikes among its rows."""
    rng = np.random.default_rng(6)
    times, starts = rng.integers(0, 600, 300) / 10, rng.integers(-90, 700, 80) / 10
    stimuli = spark.createDataFrame([("r", "live", i, s) for i, s in enumerate(starts.tolist())], io.STIMULI)
    found = align.align(spikes(spark, times.tolist()).hint("merge"), stimuli, -0.7, 1.1)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(_bucket") <= 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    expected = [(i, round(t - s, 6)) for i, s in enumerate(starts) for t in times if s - 0.7 <= t < s + 1.1]
    expected += [(i, None) for i, s in enumerate(starts) if not any(s - 0.7 <= t < s + 1.1 for t in times)]
    got = [(r.stim_id, None if r.rel_time is None else round(r.rel_time, 6)) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_bin_borders_are_those_of_pairs():
    """Ranks at borders that rounding moves, against every pair."""
    rng = np.random.default_rng(7)
    times, starts = np.unique(rng.integers(0, 30000, 2000) * 0.1 + 2e6), rng.integers(-100, 30000, 300) * 0.1 + 2e6
    high, bins = 90.3, 21
    edges = align._edges(times, starts, high, bins)
    for s, got in zip(starts, np.diff(edges, axis=1)):
        met = times[(times >= s) & (times < s + high) & (times - s <= high)]
        at = np.minimum(np.floor((met - s) * bins / high), bins - 1).astype(int)
        assert got.tolist() == np.bincount(at, minlength=bins).tolist()


def test_psth_counts_a_units_own_stimuli(spark):
    """Against a loop over units and stimuli, with ties and stimuli outside a unit's extent."""
    rng = np.random.default_rng(4)
    times, labels, starts = rng.integers(0, 400, 200) / 10, rng.integers(0, 3, 200), rng.integers(-5, 45, 30).astype(float)
    d = spikes(spark, times.tolist(), labels.tolist())
    stimuli = spark.createDataFrame([("r", "live", i, s) for i, s in enumerate(starts.tolist())], io.STIMULI)
    got = {(r.label, r.bin): (r.n_stim, round(r.per_trial * r.n_stim)) for r in align.psth(d, stimuli, bins=4).collect()}
    expected = {}
    for c in range(3):
        own = times[labels == c]
        kept = starts[(own.min() <= starts) & (starts < own.max())]
        after = [t - s for s in kept for t in own if s <= t < s + 1.0]
        expected |= {(c, b): (len(kept), sum(min(int(x * 4), 3) == b for x in after)) for b in range(4)}
    assert got == expected


def test_two_label_view(spark):
    """As the discriminant (else principal) scores of all rows at once."""
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 4, 300)
    x = rng.normal(size=(300, 5)) + rng.normal(size=(4, 5))[labels] * 3
    rows = [("r", i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x))]
    d = spark.createDataFrame(rows, "recording_id string, spike_id long, label long, waveform array<double>").repartition(3)
    for one, two, expected in ((1, 2, kernels.discriminant(x, np.where(labels == 1, 1, np.where(labels == 2, 2, 3)), 2)), (8, 9, kernels.scores(x, 2))):
        got = features.two_label_view(d, one, two).orderBy("spike_id").collect()
        assert np.allclose([(r.x, r.y) for r in got], expected, atol=1e-6)


def test_vector_zscores(spark):
    rows = [("r", i, [float(i), 5.0, i * i * 1.0]) for i in range(6)] + [("q", 0, [1.0, 2.0, 3.0])]
    got = {(r.recording_id, r.spike_id): r.z for r in features.vector_zscores(spark.createDataFrame(rows, "recording_id string, spike_id long, waveform array<double>")).collect()}
    assert np.allclose([got["r", i] for i in range(6)], kernels.zscores(np.array([v for n, _, v in rows if n == "r"]))) and got["q", 0] == [0.0, 0.0, 0.0]


@pytest.mark.parametrize("held", [2, 1000])
def test_group_statistics_handed_on_early(spark, monkeypatch, held):
    """The same sums however often a task hands on what it holds."""
    monkeypatch.setattr(features, "HELD_GROUPS", held)
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(400, 4)), rng.integers(0, 7, 400)
    d = spark.createDataFrame([("r", int(c), v.tolist()) for c, v in zip(label, x)], "recording_id string, label long, waveform array<double>")
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "30")
    got = {r.label: r for r in features.group_statistics(d, ["recording_id", "label"]).collect()}
    spark.conf.set(rows_a_batch, before)
    for c in range(7):
        g = x[label == c]
        centred = g - g.mean(axis=0)
        assert got[c].n == len(g) and np.allclose(got[c].mean, g.mean(axis=0)) and np.allclose(got[c].scatter, (centred.T @ centred).ravel())
    assert features.group_statistics(d.limit(0), ["recording_id", "label"]).count() == 0


def test_ks(spark):
    rows = [("r", 1, x) for x in (1.0, 2.0, 3.0)] + [("r", 2, x) for x in (2.0, 3.0, 4.0)]
    values = spark.createDataFrame(rows, "recording_id string, side int, x double")
    assert math.isclose(features.ks_statistics(values, ["recording_id"]).first().ks, 1 / 3)


def test_k_core(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]
    rows = [("r", u, v) for u, v in edges] + [("r", v, u) for u, v in edges]
    core = features.k_core(spark.createDataFrame(rows, "recording_id string, u string, v string"), 2)
    assert {r.u for r in core.collect()} == {"a", "b", "c"}


def test_components_become_units(spark):
    edges = spark.createDataFrame([("r", 0, 0, 1, 0), ("r", 1, 0, 2, 1), ("r", 0, 1, 1, 1)], "recording_id string, src_win long, src_label long, dst_win long, dst_label long")
    got = {(r.window_idx, r.win_label): r.label for r in graph.unit_labels(edges).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (2, 1): 0}
    chain = spark.createDataFrame([("r", i, 0, i + 1, 0) for i in range(40)], edges.schema)
    assert graph.unit_labels(chain).count() == 41


def test_sources(spark, tmp_path):
    np.save(tmp_path / "one.npy", np.arange(6.0).reshape(3, 2))
    assert [r.values for r in io.read_arrays(spark, str(tmp_path / "*.npy")).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    np.save(tmp_path / "bad.npy", np.array([{}], dtype=object), allow_pickle=True)
    with pytest.raises(Exception, match="allow_pickle"):
        io.read_arrays(spark, str(tmp_path / "bad.npy")).collect()
    waves = spark.createDataFrame([("a/b c", i, [float(i), 1.0]) for i in range(25)] + [("d", 0, [7.0, 8.0])], "recording_id string, spike_id long, waveform array<double>")
    files = io.write_arrays(waves, str(tmp_path / "arrays"), rows=10).collect()
    assert sorted((r.recording_id, r.first, r.n) for r in files) == [("a/b c", 0, 10), ("a/b c", 10, 10), ("a/b c", 20, 5), ("d", 0, 1)]
    read = io.read_arrays(spark, str(tmp_path / "arrays")).orderBy("recording_id", "row").collect()
    assert [(r.recording_id, r.row, r.values) for r in read] == [("a/b c", i, [float(i), 1.0]) for i in range(25)] + [("d", 0, [7.0, 8.0])]
    (tmp_path / "s.csv").write_text("start_time\n1.5\n2.5\n")
    assert [(r.category, r.start_time) for r in io.read_stimulus_csv(spark, str(tmp_path / "s.csv")).collect()] == [("playback", 1.5), ("playback", 2.5)]
    out = str(tmp_path / "sorted")
    io.write_sorted(spikes(spark, [1, 2]), out)
    io.write_sorted(spikes(spark, [1, 2, 3], recording="q"), out)
    assert spark.read.parquet(out).count() == 5


def test_recluster_in_time(spark):
    rows = [("r", 0, s, 10, float(t), [0.0]) for s, t in enumerate([1, 2, 3, 100, 101, 102])]
    subs = spark.createDataFrame(rows, "recording_id string, label long, sub_label long, n long, med_time double, centroid array<double>")
    got = {r.sub_label: r.part for r in recluster.by_time(subs, 2).collect()}
    assert len({got[0], got[1], got[2]}) == 1 and got[0] != got[3] and got[3] == got[5]
