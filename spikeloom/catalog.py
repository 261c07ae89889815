"""The registered spike-train queries with their SQL twins.

The driver's tables stand in for recordings: `events` gives spike times and labels (a recording an
event type), `embeddings` joined to them gives waveforms, and `lineitem` gives volume and ties.
Intervals there are seconds to minutes, so thresholds are scaled; defaults stay the reference ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.jobs import mixtures, recluster, sort_files, sorting
from spikeloom.operators import align, curate, features, graph, metrics, model, neighbours, windows
from spikeloom.operators.held import held
from spikeloom.operators.model import RECORDING
from spikeloom.sources import io

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REFRACTORY, HIGH, DT = 60.0, 3600.0, 86400.0
#: Spikes of a sorting window: the recordings of the driver's tables are short.
WINDOW = 40

EV = """ev AS (SELECT event_type AS recording_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS time, event_id,
  user_id % 10 AS label, user_id AS sub_label, value FROM events),
sp AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY time, event_id) - 1 AS spike_id FROM ev)"""
WF = EV + """, wf AS (SELECT recording_id, spike_id, time, e.label::BIGINT AS label, spike_id // 20 AS sub_label, embedding::DOUBLE[] AS waveform
  FROM sp JOIN embeddings e ON e.vec_id = sp.event_id),
px AS (SELECT recording_id, label, sub_label, spike_id, pos, waveform[pos + 1] AS x FROM wf, (SELECT unnest(generate_series(0, 63)) AS pos) WHERE pos < len(waveform))"""
ST = """, st AS (SELECT 'train' AS recording_id, CASE event_type WHEN 'purchase' THEN 'playback' ELSE 'live' END AS category, event_id AS stim_id, time AS start_time
  FROM (SELECT event_type, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS time FROM events) WHERE event_type IN ('purchase', 'signup')),
tr AS (SELECT 'train' AS recording_id, event_id AS spike_id, label, time FROM ev WHERE recording_id NOT IN ('purchase', 'signup'))"""
ISI = EV + ", i AS (SELECT *, time - lag(time) OVER (PARTITION BY recording_id, label ORDER BY time, spike_id) AS isi FROM sp)"
MERGED = EV + """, m AS (SELECT * FROM (SELECT *, time - lag(time) OVER w AS isi, lag(label) OVER w <> label AS across FROM sp
  WINDOW w AS (PARTITION BY recording_id ORDER BY time, spike_id)) WHERE isi IS NOT NULL)"""


def spikes_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as spikes: recording by event type, unit by user."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias(RECORDING),
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1e6).alias("time"),
        "event_id", (F.col("user_id") % 10).alias("label"), F.col("user_id").alias("sub_label"), "value",
    )
    return model.spike_table(rows, "event_id")


def spikes_wf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as waveforms of the events with the same id; sub-clusters are runs of 20 spikes."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("event_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("waveform"))
    spikes = spikes_ev(spark, sf_dir).select(RECORDING, "spike_id", "time", "event_id")
    return spikes.join(vectors, "event_id").select(RECORDING, "spike_id", "time", "label", F.floor(F.col("spike_id") / 20).alias("sub_label"), "waveform")


def dense_wf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spikes with waveforms numbered anew in each recording, so that windows of rows are full."""
    return model.spike_table(spikes_wf(spark, sf_dir).select(RECORDING, "time", F.col("spike_id").alias("tie"), "waveform"), "tie").drop("tie", "label")


#: Planted recordings: units, samples of a spike, and spikes of a window.
UNITS, SAMPLES, PLANTED_WINDOW = 3, 12, 400


def planted_wf(spark: SparkSession, sf_dir: str, size: float = 8.0, units: int = UNITS) -> DataFrame:
    """Events as spikes with planted waveforms: a shape of some size for each of a few units (users), which
    drifts over the month, and noise from a hash of event and sample. `unit` is the truth."""
    spikes = spikes_ev(spark, sf_dir).select(RECORDING, "spike_id", "time", "event_id", (F.col("sub_label") % units).alias("unit"))
    month = F.col("time") / (30 * 86400.0)
    noise = lambda i: F.pmod(F.xxhash64("event_id", F.lit(i)), F.lit(1000)) / 1000.0 - 0.5
    sample = lambda i: size * F.sin((F.col("unit") + 1) * (i + 1) * 0.9) + 0.04 * size * month * F.cos((F.col("unit") + 2) * (i + 1) * 0.7) + noise(i) + noise(i + 100)
    return spikes.withColumn("waveform", F.array(*[sample(i) for i in range(SAMPLES)])).drop("event_id")


PLANTED = EV + f""", pl AS (SELECT recording_id, spike_id, sub_label % {UNITS} AS unit, spike_id // {PLANTED_WINDOW} AS window_idx FROM sp),
pw AS (SELECT recording_id, window_idx, unit, count(*) AS n FROM pl GROUP BY 1, 2, 3)"""


#: At this size two units overlap, so that each can still be told in a cluster that holds both.
OVERLAP = 0.22


def planted_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping planted spikes in windows with their units as labels; in every third window units 0 and 2
    have been taken for one cluster."""
    merged = (F.col("window_idx") % 3 == 1) & (F.col("unit") == 2)
    windowed = planted_wf(spark, sf_dir, OVERLAP).withColumn("window_idx", F.floor(F.col("spike_id") / PLANTED_WINDOW))
    return windowed.select(RECORDING, "spike_id", "time", "waveform", "window_idx", F.when(merged, 0).otherwise(F.col("unit")).cast("long").alias("win_label"), "unit")


def found_units(labelled: DataFrame) -> DataFrame:
    """For each planted unit: its spikes, whether over nine tenths of them have one label, and whether
    these make up over nine tenths of that label."""
    cells = labelled.groupBy(RECORDING, "unit", "label").agg(F.count("*").alias("c"))
    whole = cells.groupBy(RECORDING, "label").agg(F.sum("c").alias("of_label"))
    units = cells.groupBy(RECORDING, "unit").agg(F.sum("c").alias("n"), F.max_by("label", "c").alias("label"), F.max("c").alias("c")).join(whole, [RECORDING, "label"])
    return units.select(RECORDING, "unit", "n", (F.col("c") > 0.9 * F.col("n")).alias("together"), (F.col("c") > 0.9 * F.col("of_label")).alias("apart"))


FOUND = f"WITH {PLANTED} SELECT recording_id, unit, sum(n)::BIGINT AS n, true AS together, true AS apart FROM pw GROUP BY 1, 2"


def _scratch(spark: SparkSession, name: str) -> str:
    """A folder for what a query writes and reads again, beside the checkpoints that all executors share."""
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stimuli_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = F.when(F.col(RECORDING) == "purchase", "playback").otherwise("live")
    return spikes_ev(spark, sf_dir).filter(F.col(RECORDING).isin("purchase", "signup")).select(F.lit("train").alias(RECORDING), category.alias("category"), F.col("event_id").alias("stim_id"), F.col("time").alias("start_time"))


def train_ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes_ev(spark, sf_dir).filter(~F.col(RECORDING).isin("purchase", "signup")).select(F.lit("train").alias(RECORDING), F.col("event_id").alias("spike_id"), "label", "time")


def spikes_li(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spikes: many ties in time, a recording a supplier."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.col("l_suppkey").cast("string").alias(RECORDING),
        (F.expr("timestampdiff(SECOND, timestamp_ntz'1992-01-01 00:00:00', l_shipdate)")).cast("double").alias("time"),
        "l_orderkey", "l_linenumber", F.col("l_linenumber").alias("label"), F.col("l_extendedprice").alias("value"),
    )
    return model.spike_table(rows, "l_orderkey", "l_linenumber")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _labels(df: DataFrame, condition: Column) -> DataFrame:
    return df.select(RECORDING, "label").distinct().filter(condition)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spikes_ev(spark, sf_dir).select(RECORDING, "spike_id", "time", "label")


# -- quality, the flagship


@query("unit_quality", ISI + """SELECT recording_id, label, count(*) AS n, round(count(*) / (max(time) - min(time)), 9) AS rate,
  round(count(*) FILTER (isi < 60.0) / count(isi), 6) AS violation_rate, round(1 - exp(-(count(*) / (max(time) - min(time))) * 60.0), 6) AS chance
  FROM i GROUP BY ALL""")  # fmt: skip
def unit_quality(spark, sf):
    return rounded(rounded(metrics.violations(spikes_ev(spark, sf), REFRACTORY), "violation_rate", "chance"), "rate", digits=9)


# -- sources


@query("s1_load_spikes", f"WITH {WF} SELECT recording_id, count(*) AS n, min(len(waveform)) AS samples, round(sum(time), 3) AS times FROM wf GROUP BY 1")
def s1(spark, sf):
    return spikes_wf(spark, sf).groupBy(RECORDING).agg(F.count("*").alias("n"), F.min(F.size("waveform")).cast("long").alias("samples"), F.round(F.sum("time"), 3).alias("times"))


@query("s2_numpy_arrays", f"WITH {WF}, d AS (SELECT recording_id, waveform, row_number() OVER (PARTITION BY recording_id ORDER BY time, spike_id) - 1 AS row FROM wf) SELECT recording_id, row, len(waveform)::BIGINT AS samples, round(list_sum(waveform), 6) AS total FROM d")
def s2(spark, sf):
    path = _scratch(spark, "arrays")
    io.write_arrays(dense_wf(spark, sf), path, rows=40)
    total = F.aggregate("values", F.lit(0.0), lambda t, x: t + x)
    return rounded(io.read_arrays(spark, path).select(RECORDING, "row", F.size("values").cast("long").alias("samples"), total.alias("total")), "total")


@query("s3_stimulus_csv", f"WITH {EV}{ST} SELECT 'recording' AS recording_id, 'playback' AS category, row_number() OVER (ORDER BY start_time) - 1 AS stim_id, round(start_time, 6) AS start_time FROM st")
def s3(spark, sf):
    path = _scratch(spark, "stimuli")
    stimuli_ev(spark, sf).select("start_time").write.option("header", True).csv(path)
    return rounded(io.read_stimulus_csv(spark, path), "start_time")


@query("s5_write_sorted", f"WITH {WF} SELECT recording_id, spike_id, round(time, 6) AS time, label, round(list_sum(waveform), 6) AS total FROM wf")
def s5(spark, sf):
    path = _scratch(spark, "sorted")
    io.write_sorted(spikes_wf(spark, sf), path)
    total = F.aggregate("waveform", F.lit(0.0), lambda t, x: t + x)
    return rounded(spark.read.parquet(path).select(RECORDING, "spike_id", "time", "label", total.alias("total")), "time", "total")


@query("s6_sort_files")
def s6(spark, sf):
    source, target = _scratch(spark, "recordings"), _scratch(spark, "recordings-sorted")
    spikes_wf(spark, sf).select(RECORDING, "spike_id", "time", "waveform", F.col("label").cast("int").alias("label")).write.partitionBy(RECORDING).parquet(source)
    return sort_files.run(spark, source, target, WINDOW).select(RECORDING, "spike_id", "time", "label")


@query("s4_nested_stimuli", f"WITH {EV}{ST} SELECT recording_id, category, row_number() OVER (PARTITION BY category ORDER BY start_time) - 1 AS stim_id, round(start_time, 6) AS start_time FROM st")
def s4(spark, sf):
    s = stimuli_ev(spark, sf)
    nested = s.groupBy(RECORDING, F.floor(F.col("start_time") / DT).alias("day")).agg(*[F.filter(F.collect_list(F.when(F.col("category") == c, F.struct("start_time"))), lambda x: x.isNotNull()).alias(c) for c in ("playback", "live")])
    return rounded(io.stimuli_of_records(nested), "start_time")


# -- construction and properties


@query("d1_spike_table", f"WITH {EV} SELECT recording_id, spike_id, time, label FROM sp")
def d1(spark, sf):
    return spikes_ev(spark, sf).select(RECORDING, "spike_id", "time", "label")


@query("d1_spike_table_ties", """SELECT l_suppkey::VARCHAR AS recording_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS spike_id,
  date_diff('second', TIMESTAMP '1992-01-01', l_shipdate)::DOUBLE AS time, l_linenumber::BIGINT AS label FROM lineitem""")  # fmt: skip
def d1_ties(spark, sf):
    return spikes_li(spark, sf).select(RECORDING, "spike_id", "time", "label")


@query("d1_spike_table_ranged", f"WITH {EV} SELECT recording_id, spike_id, time, label FROM sp")
def d1_ranged(spark, sf):
    rows = spikes_ev(spark, sf).select(RECORDING, "time", "event_id", "label")
    return model.spike_table_ranged(rows, 8, "event_id").select(RECORDING, "spike_id", "time", "label")


@query("d2_timed_table", f"WITH {EV} SELECT recording_id, spike_id::INT AS id, time, value::FLOAT::DOUBLE AS value FROM sp")
def d2(spark, sf):
    return model.timed_table(spikes_ev(spark, sf), {"value": "float"}, "event_id").withColumn("value", F.col("value").cast("double"))


@query("d3_leaf_counts", f"WITH {EV} SELECT recording_id, label, count(DISTINCT sub_label) AS n_sub, count(*) AS n FROM sp GROUP BY 1, 2")
def d3(spark, sf):
    return model.leaf_counts(spikes_ev(spark, sf))


@query("d4_weights", f"WITH {EV} SELECT recording_id, label, sub_label, count(*)::DOUBLE AS weight FROM sp GROUP BY 1, 2, 3")
def d4(spark, sf):
    return model.weights(spikes_ev(spark, sf))


def _long(df: DataFrame, vector: str = "centroid", into: str = "x") -> DataFrame:
    keys = [c for c in (RECORDING, "label", "sub_label", "spike_id") if c in df.columns]
    return df.select(*keys, F.posexplode(vector).alias("pos", into)).withColumn("pos", F.col("pos").cast("long")).withColumn(into, F.round(into, 6))


@query("d5_leaf_centroids", f"WITH {WF} SELECT recording_id, label, sub_label, pos, round(avg(x), 6) AS x FROM px GROUP BY 1, 2, 3, 4")
def d5(spark, sf):
    return _long(model.vector_mean(spikes_wf(spark, sf), [RECORDING, "label", "sub_label"]))


D6 = WF + ", ctr AS (SELECT recording_id, label, pos, avg(m) AS mean FROM (SELECT recording_id, label, sub_label, pos, avg(x) AS m FROM px GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"


@query("d6_hierarchy_centroids", f"WITH {D6} SELECT recording_id, label, pos, round(mean, 6) AS x FROM ctr")
def d6(spark, sf):
    return _long(model.hierarchy_centroids(spikes_wf(spark, sf)))


D7 = EV + """, sub AS (SELECT recording_id, label, sub_label, count(*) AS n, median(time) AS t FROM sp GROUP BY 1, 2, 3),
cl AS (SELECT recording_id, label, median(t) AS med_time, sum(n)::BIGINT AS n, count(*) AS n_sub FROM sub GROUP BY 1, 2),
lf AS (SELECT recording_id, label, median(time) AS leaf_time FROM sp GROUP BY 1, 2),
nd AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY med_time, label) - 1 AS node_id FROM cl)"""


@query("d7_cluster_times", f"WITH {D7} SELECT recording_id, label, round(med_time, 3) AS med_time, n, n_sub, round(leaf_time, 3) AS leaf_time FROM cl JOIN lf USING (recording_id, label)")
def d7(spark, sf):
    return rounded(model.cluster_times(spikes_ev(spark, sf)), "med_time", "leaf_time", digits=3)


@query("d8_ordered_clusters", f"WITH {D7} SELECT recording_id, label, round(med_time, 3) AS med_time, node_id FROM nd")
def d8(spark, sf):
    return rounded(model.ordered_clusters(model.cluster_times(spikes_ev(spark, sf))).select(RECORDING, "label", "med_time", "node_id"), "med_time", digits=3)


@query("d9_labeled_nodes", f"WITH {D7} SELECT recording_id, node_id, label FROM nd")
def d9(spark, sf):
    return model.labeled_nodes(spikes_ev(spark, sf))


@query("d10_lineage", f"WITH {D7} SELECT c.recording_id, c.label, c.n, c.label // 2 AS source_label, s.n AS source_n FROM cl c LEFT JOIN cl s ON s.recording_id = c.recording_id AND s.label = c.label // 2")
def d10(spark, sf):
    clusters = model.cluster_times(spikes_ev(spark, sf)).select(RECORDING, "label", "n")
    derived = clusters.select(RECORDING, "label", F.floor(F.col("label") / 2).alias("source_label"))
    return model.lineage(clusters, derived).select(RECORDING, "label", "n", "source_label", "source_n")


# -- selections


@query("f1_select_mask", f"WITH {EV} SELECT recording_id, spike_id, value FROM sp WHERE value > 50")
def f1(spark, sf):
    return model.select_where(spikes_ev(spark, sf), F.col("value") > 50).select(RECORDING, "spike_id", "value")


@query("f2_select_positions", f"WITH {EV} SELECT recording_id, spike_id, time FROM sp WHERE spike_id IN (SELECT o_custkey FROM orders)")
def f2(spark, sf):
    spikes = spikes_ev(spark, sf)
    positions = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("spike_id"))
    return model.select_positions(spikes, positions).select(RECORDING, "spike_id", "time")


@query("f3_select_clusters", f"WITH {D7} SELECT recording_id, spike_id, label, node AS node_id FROM sp JOIN (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY med_time, label) - 1 AS node FROM cl WHERE label % 3 = 0) USING (recording_id, label)")
def f3(spark, sf):
    spikes = spikes_ev(spark, sf)
    return model.select_clusters(spikes, _labels(spikes, F.col("label") % 3 == 0)).select(RECORDING, "spike_id", "label", "node_id")


@query("f4_split_mask", f"WITH {EV} SELECT recording_id, coalesce(value > 50, false) AS side, count(*) AS n FROM sp GROUP BY 1, 2")
def f4(spark, sf):
    return model.split_where(spikes_ev(spark, sf), F.col("value") > 50).groupBy(RECORDING, "side").agg(F.count("*").alias("n"))


@query("f5_time_split", f"WITH {EV} SELECT recording_id, label, sub_label, time >= 86400 AND time < 864000 AS within, count(*) AS n, round(median(time), 3) AS med_time FROM sp GROUP BY 1, 2, 3, 4")
def f5(spark, sf):
    return rounded(model.time_split(spikes_ev(spark, sf), 86400.0, 864000.0), "med_time", digits=3)


@query("f6_match_several", f"WITH {D7} SELECT recording_id, label, node_id, node_id IN (0, 2) AS matched FROM nd")
def f6(spark, sf):
    return model.match_several(model.labeled_nodes(spikes_ev(spark, sf)), nodes=[0, 2]).select(RECORDING, "label", "node_id", "matched")


@query("f7_match_one", f"WITH {D7} SELECT recording_id, label, node_id FROM nd WHERE node_id = 1")
def f7(spark, sf):
    return model.match_one(model.labeled_nodes(spikes_ev(spark, sf)), F.col("node_id") == 1).select(RECORDING, "label", "node_id")


@query("f8_every_kth", f"WITH {EV} SELECT recording_id, spike_id FROM sp JOIN (SELECT recording_id, greatest(1, count(*) // 100) AS k FROM sp GROUP BY 1) USING (recording_id) WHERE spike_id % k = 0")
def f8(spark, sf):
    return model.every_kth(spikes_ev(spark, sf), 100).select(RECORDING, "spike_id")


@query("f9_cluster_sample", f"""WITH {EV}, k AS (SELECT recording_id, label, greatest(1, count(*) // 20) AS k FROM sp GROUP BY 1, 2),
p AS (SELECT recording_id, label, spike_id, row_number() OVER (PARTITION BY recording_id, label ORDER BY time, spike_id) - 1 AS place FROM sp)
SELECT recording_id, label, spike_id FROM (SELECT *, (('0x' || md5('0|' || recording_id || '|' || label)[1:8])::UBIGINT % k)::BIGINT AS start FROM p JOIN k USING (recording_id, label)) WHERE place >= start AND (place - start) % k = 0""")  # fmt: skip
def f9(spark, sf):
    return model.every_kth_of_cluster(spikes_ev(spark, sf), 20).select(RECORDING, "label", "spike_id")


@query("f10_toggled_labels", f"WITH {EV}, l AS (SELECT DISTINCT recording_id, label FROM sp) SELECT recording_id, label FROM l WHERE (label % 2 = 0) <> (label % 3 = 0)")
def f10(spark, sf):
    spikes = spikes_ev(spark, sf)
    return model.toggled(_labels(spikes, F.col("label") % 2 == 0), _labels(spikes, F.col("label") % 3 == 0))


# -- windows


@query("w1_duration_windows", f"""WITH {EV}, n AS (SELECT recording_id, unnest(generate_series(0, ceil(max(time) / 86400.0)::BIGINT - 1)) AS window_idx FROM sp GROUP BY 1)
SELECT n.recording_id, n.window_idx, n.window_idx * 86400.0::DOUBLE AS start, n.window_idx * 86400.0::DOUBLE + 86400.0::DOUBLE AS stop, count(sp.time) AS n
FROM n LEFT JOIN sp ON sp.recording_id = n.recording_id AND sp.time >= n.window_idx * 86400.0::DOUBLE AND sp.time < n.window_idx * 86400.0::DOUBLE + 86400.0::DOUBLE GROUP BY 1, 2""")  # fmt: skip
def w1(spark, sf):
    return windows.duration_windows(spikes_ev(spark, sf), DT)


@query("w2_row_windows", f"WITH {EV} SELECT recording_id, spike_id // 100 AS window_idx, min(spike_id) AS first, max(spike_id) + 1 AS stop, min(time) AS t_first, max(time) AS t_last FROM sp GROUP BY 1, 2")
def w2(spark, sf):
    return windows.row_windows(spikes_ev(spark, sf), 100)


@query("w3_processing_windows", """WITH sp AS (SELECT l_suppkey::VARCHAR AS recording_id, date_diff('second', TIMESTAMP '1992-01-01', l_shipdate)::DOUBLE AS time, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS spike_id FROM lineitem)
SELECT recording_id, spike_id // 2000 AS window_idx, min(spike_id) AS first, max(spike_id) + 1 AS stop, min(time) AS t_first, max(time) AS t_last FROM sp GROUP BY 1, 2""")  # fmt: skip
def w3(spark, sf):
    return windows.row_windows(spikes_li(spark, sf))


@query("w4_trailing_windows", f"""WITH {EV}, f AS (SELECT recording_id, ceil(max(time) / 86400.0)::BIGINT AS frames FROM sp GROUP BY 1),
h AS (SELECT recording_id, floor(time / 86400.0)::BIGINT AS w, label, count(*) AS n FROM sp GROUP BY 1, 2, 3)
SELECT recording_id, w + lag AS frame, lag::INT AS lag, label, n FROM h JOIN f USING (recording_id), (SELECT unnest([0, 1, 2]) AS lag) WHERE w < frames AND w + lag < frames""")  # fmt: skip
def w4(spark, sf):
    return windows.trailing_windows(spikes_ev(spark, sf), DT, 3)


@query("w5_intervals", f"WITH {ISI} SELECT recording_id, label, spike_id, round(isi, 6) AS isi FROM i")
def w5(spark, sf):
    return rounded(windows.intervals(spikes_ev(spark, sf)).select(RECORDING, "label", "spike_id", "isi"), "isi")


@query("w6_marked_intervals", f"WITH {MERGED} SELECT recording_id, spike_id, round(isi, 6) AS isi, across FROM m")
def w6(spark, sf):
    return rounded(windows.marked_intervals(spikes_ev(spark, sf)).select(RECORDING, "spike_id", "isi", "across"), "isi")


# -- hierarchy


@query("h1_cluster", f"WITH {D7} SELECT recording_id, label, n, round(leaf_time, 3) AS med_time, row_number() OVER (PARTITION BY recording_id ORDER BY leaf_time, label) - 1 AS node_id FROM cl JOIN lf USING (recording_id, label)")
def h1(spark, sf):
    return rounded(model.cluster(spikes_ev(spark, sf)), "med_time", digits=3)


@query("h2_flatten", f"WITH {D7} SELECT recording_id, label, sub_label, n, round(t, 3) AS med_time, row_number() OVER (PARTITION BY recording_id, label ORDER BY t, sub_label) - 1 AS position FROM sub")
def h2(spark, sf):
    return rounded(model.flatten_once(spikes_ev(spark, sf)), "med_time", digits=3)


#: Clusters by unit; in the recording `click` two units each share a label, so that labels repeat there.
NODES = EV + """, t AS (SELECT *, label AS node, CASE WHEN recording_id = 'click' THEN label // 2 ELSE label END AS tag FROM sp),
sub AS (SELECT recording_id, node, tag, sub_label, count(*) AS n, median(time) AS t FROM t GROUP BY 1, 2, 3, 4),
nd AS (SELECT recording_id, node, tag, row_number() OVER (PARTITION BY recording_id ORDER BY median(t), node) - 1 AS place FROM sub GROUP BY 1, 2, 3),
u AS (SELECT recording_id, count(*) > count(DISTINCT tag) AS repeats FROM nd GROUP BY 1),
top AS (SELECT recording_id, node, CASE WHEN repeats THEN place ELSE tag END AS label FROM nd JOIN u USING (recording_id))"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col(RECORDING) == "click", F.floor(F.col("label") / 2)).otherwise(F.col("label"))
    return spikes_ev(spark, sf_dir).select(RECORDING, "spike_id", "time", F.col("label").alias("node"), label.alias("label"), "sub_label")


@query("h2_flatten_depth1", f"WITH {NODES} SELECT recording_id, label, sub_label, n, round(t, 3) AS med_time FROM sub JOIN top USING (recording_id, node)")
def h2_depth1(spark, sf):
    return rounded(model.flatten(_nodes(spark, sf), 1).select(RECORDING, "label", "sub_label", "n", "med_time"), "med_time", digits=3)


@query("h2_flatten_depth2", f"WITH {NODES} SELECT recording_id, spike_id, top.label FROM t JOIN top USING (recording_id, node)")
def h2_depth2(spark, sf):
    return model.flatten(_nodes(spark, sf), 2).select(RECORDING, "spike_id", "label")


@query("h2_flatten_all", f"WITH {NODES} SELECT recording_id, top.label, count(*) AS n, sum(spike_id)::BIGINT AS ids FROM t JOIN top USING (recording_id, node) GROUP BY 1, 2")
def h2_all(spark, sf):
    return model.flatten(_nodes(spark, sf)).groupBy(RECORDING, "label").agg(F.count("*").alias("n"), F.sum("spike_id").alias("ids"))


@query("h2_flatten_lower_labels", f"WITH {NODES} SELECT recording_id, sub_label AS label, sum(n)::BIGINT AS n FROM sub GROUP BY 1, 2")
def h2_lower(spark, sf):
    return model.flatten(_nodes(spark, sf), 1, assign_labels=False).groupBy(RECORDING, "label").agg(F.sum("n").alias("n"))


@query("h3_window_hierarchy", f"""WITH {EV}, w AS (SELECT recording_id, spike_id, spike_id // 100 AS window_idx, CASE WHEN label = 0 THEN -1 ELSE label END AS label FROM sp),
d AS (SELECT recording_id, window_idx, label, row_number() OVER (PARTITION BY recording_id ORDER BY window_idx, label) - 1 AS r FROM (SELECT DISTINCT recording_id, window_idx, label FROM w))
SELECT recording_id, spike_id, window_idx, label, CASE WHEN label = -1 THEN -1 ELSE r END AS sub_label FROM w JOIN d USING (recording_id, window_idx, label)""")  # fmt: skip
def h3(spark, sf):
    spikes = spikes_ev(spark, sf).withColumn("label", F.when(F.col("label") == 0, -1).otherwise(F.col("label")))
    return model.window_hierarchy(spikes, 100).select(RECORDING, "spike_id", "window_idx", "label", "sub_label")


@query("h4_appended_labels", f"""WITH {EV} SELECT recording_id, g AS "group", top + row_number() OVER (PARTITION BY recording_id ORDER BY g) AS label
FROM (SELECT DISTINCT recording_id, sub_label % 7 AS g FROM sp) JOIN (SELECT recording_id, max(label) AS top FROM sp GROUP BY 1) USING (recording_id)""")  # fmt: skip
def h4(spark, sf):
    spikes = spikes_ev(spark, sf)
    return model.appended(spikes, spikes.select(RECORDING, (F.col("sub_label") % 7).alias("group")))


# -- edits


@query("e1_add_clusters", f"""WITH {EV}, b AS (SELECT recording_id, spike_id, time, label FROM sp WHERE label < 5), a AS (SELECT *, sub_label % 3 AS part FROM sp WHERE label >= 5),
r AS (SELECT recording_id, part, row_number() OVER (PARTITION BY recording_id ORDER BY median(time), part) AS k FROM a GROUP BY 1, 2), t AS (SELECT recording_id, max(label) AS top FROM b GROUP BY 1)
SELECT recording_id, spike_id, label FROM b UNION ALL SELECT recording_id, spike_id, coalesce(top, 0) + k FROM a JOIN r USING (recording_id, part) LEFT JOIN t USING (recording_id)""")  # fmt: skip
def e1(spark, sf):
    spikes = spikes_ev(spark, sf)
    base = spikes.filter("label < 5").select(RECORDING, "spike_id", "time", "label")
    return curate.add_clusters(base, spikes.filter("label >= 5").select(RECORDING, "spike_id", "time", (F.col("sub_label") % 3).alias("part"))).drop("time")


@query("e2_delete_clusters", f"WITH {EV} SELECT recording_id, label, count(*) AS n FROM sp WHERE label NOT IN (1, 3) GROUP BY 1, 2")
def e2(spark, sf):
    a = _assigned(spark, sf)
    return curate.delete_clusters(a, _labels(a, F.col("label").isin(1, 3))).groupBy(RECORDING, "label").agg(F.count("*").alias("n"))


@query("e3_merge_clusters", f"WITH {EV}, t AS (SELECT recording_id, max(label) FILTER (label NOT IN (2, 9)) + 1 AS new FROM sp GROUP BY 1) SELECT recording_id, spike_id, CASE WHEN label IN (2, 9) THEN new ELSE label END AS label FROM sp JOIN t USING (recording_id)")
def e3(spark, sf):
    a = _assigned(spark, sf)
    return curate.merge_clusters(a, _labels(a, F.col("label").isin(2, 9))).select(RECORDING, "spike_id", "label")


@query("e4_keep_clusters", f"WITH {EV} SELECT recording_id, label, count(*) AS n FROM sp WHERE label IN (1, 3) GROUP BY 1, 2")
def e4(spark, sf):
    a = _assigned(spark, sf)
    return curate.keep_clusters(a, _labels(a, F.col("label").isin(1, 3))).groupBy(RECORDING, "label").agg(F.count("*").alias("n"))


@query("e5_hide_and_reveal", f"""WITH {EV}, h AS (SELECT recording_id, label, row_number() OVER (PARTITION BY recording_id ORDER BY median(time), label) AS k FROM sp WHERE label IN (0, 4) GROUP BY 1, 2),
t AS (SELECT recording_id, max(label) AS top FROM sp WHERE label NOT IN (0, 4) GROUP BY 1)
SELECT recording_id, spike_id, CASE WHEN h.k IS NULL THEN sp.label ELSE top + h.k END AS label FROM sp LEFT JOIN h USING (recording_id, label) JOIN t USING (recording_id)""")  # fmt: skip
def e5(spark, sf):
    a = _assigned(spark, sf)
    return curate.hide_and_reveal(a, _labels(a, F.col("label").isin(0, 4))).select(RECORDING, "spike_id", "label")


@query("e6_changed_labels", f"WITH {EV}, t AS (SELECT recording_id, max(label) FILTER (label NOT IN (2, 5)) + 1 AS new FROM sp GROUP BY 1) SELECT DISTINCT recording_id, label FROM sp WHERE label IN (2, 5) UNION SELECT recording_id, new FROM t")
def e6(spark, sf):
    a = _assigned(spark, sf)
    return curate.changed_labels(a, curate.merge_clusters(a, _labels(a, F.col("label").isin(2, 5))))


#: A log of edits: action, labels, and whether the pieces of what it deals out are told apart (by even or odd number).
EDITS = [
    ("merge", [1, 2], False), ("delete", [3], False), ("undo", [], False), ("recluster", [5], True), ("hide", [4, 0], False), ("reveal", [], False), ("undo", [], False),
    ("undo", [], False), ("redo", [], False), ("redo", [], False), ("add", [], True), ("keep", [6, 7], False), ("undo", [], False), ("merge", [6, 7, 11], False), ("restore", [2], False), ("undo", [], False),
]


def _replay_sql(edits: list[tuple[str, list[int], bool]], piece: str, label: str) -> str:
    """Versions by recursion over the log; a cluster's new label follows the highest by median time."""
    values = ", ".join(f"({i}, '{a}', {x}::BIGINT[], {str(p).lower()})" for i, (a, x, p) in enumerate(edits, 1))
    return f"""WITH RECURSIVE {EV}, a AS (SELECT recording_id, time, {label} AS label, {piece} AS piece FROM sp), log(seq, action, labels, parted) AS (VALUES {values}),
pt AS (SELECT recording_id, {{'p': piece, 'l': min(label), 't': median(time)}} AS x FROM a GROUP BY recording_id, piece),
run AS (
  SELECT recording_id, 0 AS seq, list(x) AS every, [{{'cur': coalesce(list(x) FILTER (x.l IS NOT NULL), []), 'hid': list(x) FILTER (false)}}] AS versions, [{{'cur': list(x), 'hid': list(x)}}][:0] AS redo FROM pt GROUP BY 1
  UNION ALL
  SELECT recording_id, seq, every,
    CASE WHEN action = 'undo' THEN versions[:greatest(len(versions) - 1, 1)] WHEN action = 'redo' THEN list_concat(versions, redo[len(redo):]) ELSE list_append(versions, CASE
      WHEN action = 'restore' THEN versions[labels[1] + 1] WHEN action = 'delete' THEN {{'cur': kept, 'hid': h}} WHEN action = 'keep' THEN {{'cur': moved, 'hid': h}}
      WHEN action = 'hide' THEN {{'cur': kept, 'hid': list_concat(h, moved)}} WHEN action = 'reveal' THEN {{'cur': list_concat(c, new), 'hid': h[:0]}}
      WHEN action = 'add' THEN {{'cur': list_concat(c, new), 'hid': h}} ELSE {{'cur': list_concat(kept, new), 'hid': h}} END) END,
    CASE WHEN action = 'undo' AND len(versions) > 1 THEN list_append(redo, versions[-1]) WHEN action = 'undo' THEN redo WHEN action = 'redo' THEN redo[:len(redo) - 1] ELSE redo[:0] END
  FROM (SELECT *, list_transform(dealt, lambda x: {{'p': x.p, 'l': top + list_position(list_transform(list_sort(groups), lambda z: z.g), x.g), 't': x.t}}) AS new
    FROM (SELECT *, list_transform(list_distinct(list_transform(dealt, lambda x: x.g)), lambda g: {{'m': list_aggregate(list_transform(list_filter(dealt, lambda y: y.g = g), lambda y: y.t), 'median'), 'g': g}}) AS groups,
          coalesce(list_max(list_transform(CASE WHEN action IN ('reveal', 'add') THEN c ELSE kept END, lambda x: x.l)), 0) AS top
      FROM (SELECT *, list_transform(CASE action WHEN 'reveal' THEN h WHEN 'add' THEN list_filter(every, lambda x: x.l IS NULL AND NOT list_contains(list_transform(list_concat(c, h), lambda y: y.p), x.p)) ELSE moved END,
              lambda x: {{'p': x.p, 'g': CASE WHEN action = 'reveal' THEN x.l WHEN parted THEN x.p % 2 ELSE 0 END, 't': x.t}}) AS dealt
        FROM (SELECT *, list_filter(c, lambda x: NOT list_contains(labels, x.l)) AS kept, list_filter(c, lambda x: list_contains(labels, x.l)) AS moved
          FROM (SELECT recording_id, log.seq, every, versions, redo, action, labels, parted, versions[-1].cur AS c, coalesce(versions[-1].hid, []) AS h FROM run JOIN log ON log.seq = run.seq + 1)))))
), final AS (SELECT recording_id, unnest(versions[-1].cur) AS x FROM run WHERE seq = {len(edits)})
SELECT recording_id, x.l AS label, count(*) AS n FROM a JOIN final USING (recording_id) WHERE x.p = piece GROUP BY 1, 2"""


def _log(a: DataFrame, edits: list[tuple[str, list[int], bool]]) -> DataFrame:
    """The log for each recording; parts name every piece there is."""
    parts = a.groupBy(RECORDING).agg(F.transform(F.collect_set("piece"), lambda p: F.struct(p.alias("piece"), (p % 2).alias("part"))).alias("all"))
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(k).alias("action"), F.array(*[F.lit(x) for x in v]).cast("array<bigint>").alias("labels"), F.lit(p).alias("parted")) for i, (k, v, p) in enumerate(edits)])
    return parts.withColumn("e", F.explode(steps)).select(RECORDING, "e.seq", "e.action", "e.labels", F.when(F.col("e.parted"), F.col("all")).alias("parts"))


FIRST_EDITS = [("merge", [1, 2], False), ("delete", [3], False), ("undo", [], False), ("hide", [4], False), ("reveal", [], False)]


@query("e7_replayed_edits", _replay_sql(FIRST_EDITS, "label", "label"))
def e7(spark, sf):
    a = _assigned(spark, sf).withColumn("piece", F.col("label"))
    return curate.replay(a, _log(a, FIRST_EDITS)).groupBy(RECORDING, "label").agg(F.count("*").alias("n"))


@query("e7_history", _replay_sql(EDITS, "label * 3 + sub_label % 3", "CASE WHEN label < 9 THEN label END"))
def e7_history(spark, sf):
    """Merges, deletions, reclustering, hiding and adding, undone and redone; unit 9 is in no cluster at first."""
    a = spikes_ev(spark, sf).select(RECORDING, "spike_id", "time", F.when(F.col("label") < 9, F.col("label")).alias("label"), (F.col("label") * 3 + F.col("sub_label") % 3).alias("piece"))
    return curate.replay(a, _log(a, EDITS)).groupBy(RECORDING, "label").agg(F.count("*").alias("n"))


@query("e8_tags", f"""WITH {EV}, l AS (SELECT DISTINCT recording_id, label FROM sp), g AS (SELECT recording_id, label, 'SINGLEUNIT' AS tag FROM l WHERE label % 2 = 0 UNION ALL SELECT recording_id, label, 'NOISY' FROM l WHERE label % 3 = 0 AND label <> 6)
SELECT recording_id, label, coalesce(string_agg(tag, ',' ORDER BY tag), '') AS tags FROM l LEFT JOIN g USING (recording_id, label) GROUP BY 1, 2""")  # fmt: skip
def e8(spark, sf):
    a = _assigned(spark, sf)
    tagged = lambda cond, tag: _labels(a, cond).withColumn("tag", F.lit(tag))
    tags = curate.add_tags(tagged(F.col("label") % 2 == 0, "SINGLEUNIT"), tagged(F.col("label") % 3 == 0, "NOISY"))
    return curate.tag_sets(a, curate.remove_tags(tags, tagged(F.col("label") == 6, "NOISY")))


def _subs(spark, sf):
    return model.sub_clusters(spikes_wf(spark, sf))


@query("e9_recluster_shape")
def e9(spark, sf):
    return recluster.by_shape(_subs(spark, sf))


@query("e10_recluster_time")
def e10(spark, sf):
    return recluster.by_time(_subs(spark, sf))


@query("e11_recluster_noise")
def e11(spark, sf):
    return recluster.by_noise(_subs(spark, sf))


@query("e9_e11_reclustered")
def e9_e11(spark, sf):
    """Cluster 1 is split by shape, then 2 by time, then 3 by noise; each edit adds its parts as clusters."""
    spikes = spikes_wf(spark, sf).select(RECORDING, "spike_id", "time", "label", "sub_label")
    for label, split in ((1, recluster.by_shape), (2, recluster.by_time), (3, recluster.by_noise)):
        spikes = recluster.reclustered(spikes, split(_subs(spark, sf).filter(F.col("label") == label)))
    return spikes


@query("e12_cleaned_assignments")
def e12(spark, sf):
    return recluster.cleaned_assignments(_subs(spark, sf))


# -- metrics


@query("q1_firing_rates", f"WITH {EV} SELECT recording_id, label, count(*) AS n, round(count(*) / (max(time) - min(time)), 9) AS rate FROM sp GROUP BY 1, 2")
def q1(spark, sf):
    return rounded(metrics.firing_rates(spikes_ev(spark, sf)), "rate", digits=9)


BAND = D6 + ", sd AS (SELECT recording_id, label, pos, stddev_pop(x) AS std FROM px GROUP BY 1, 2, 3), band AS (SELECT * FROM ctr JOIN sd USING (recording_id, label, pos))"


@query("q2_waveform_band", f"WITH {BAND} SELECT recording_id, label, pos, round(mean, 6) AS mean, round(std, 6) AS std FROM band")
def q2(spark, sf):
    return rounded(metrics.waveform_band(spikes_wf(spark, sf)).withColumn("pos", F.col("pos").cast("long")), "mean", "std")


@query("q3_q4_signal_to_noise", f"WITH {BAND} SELECT recording_id, label, round(CASE WHEN avg(std) <> 0 THEN (max(mean) - min(mean)) / avg(std) END, 6) AS snr, round(max(mean) FILTER (pos = 32), 6) AS amplitude FROM band GROUP BY 1, 2")
def q3(spark, sf):
    return rounded(metrics.signal_to_noise(spikes_wf(spark, sf)), "snr", "amplitude")


@query("q5_q7_violations_default", f"WITH {ISI} SELECT recording_id, label, count(*) AS n, round(count(*) FILTER (isi < 0.001) / count(isi), 6) AS violation_rate, round(1 - exp(-(count(*) / (max(time) - min(time))) * 0.001), 9) AS chance FROM i GROUP BY 1, 2")
def q5(spark, sf):
    return rounded(rounded(metrics.violations(spikes_ev(spark, sf)).drop("rate"), "violation_rate"), "chance", digits=9)


@query("q6_across_violations", f"WITH {MERGED} SELECT recording_id, count(*) AS n_across, round(count(*) FILTER (isi < 60.0) / count(*), 6) AS violation_rate FROM m WHERE across GROUP BY 1")
def q6(spark, sf):
    return rounded(metrics.across_violations(spikes_ev(spark, sf), REFRACTORY), "violation_rate")


@query("q8_isi_histogram", f"""WITH {ISI}, b AS (SELECT recording_id, label, least(floor(isi * 30 / 3600.0), 29)::BIGINT AS bin, count(*) AS n FROM i WHERE isi BETWEEN 0 AND 3600.0 GROUP BY 1, 2, 3),
t AS (SELECT recording_id, label, sum(n) AS total FROM b GROUP BY 1, 2), s AS (SELECT recording_id, label, unnest(generate_series(0, 29)) AS bin FROM (SELECT DISTINCT recording_id, label FROM sp))
SELECT recording_id, label, bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / total / 120.0, 9) AS density FROM s LEFT JOIN b USING (recording_id, label, bin) LEFT JOIN t USING (recording_id, label)""")  # fmt: skip
def q8(spark, sf):
    return rounded(metrics.isi_histogram(spikes_ev(spark, sf), HIGH), "density", digits=9)


@query("q9_stacked_histogram", f"""WITH {MERGED}, b AS (SELECT recording_id, least(floor(isi * 30 / 3600.0), 29)::BIGINT AS bin, count(*) FILTER (across) AS a, count(*) FILTER (NOT across) AS w FROM m WHERE isi BETWEEN 0 AND 3600.0 GROUP BY 1, 2),
t AS (SELECT recording_id, sum(a + w) AS total FROM b GROUP BY 1), s AS (SELECT recording_id, unnest(generate_series(0, 29)) AS bin FROM (SELECT DISTINCT recording_id FROM sp))
SELECT recording_id, bin, round(coalesce(a, 0) / total / 120.0, 9) AS density_across, round(coalesce(w, 0) / total / 120.0, 9) AS density_within FROM s LEFT JOIN b USING (recording_id, bin) LEFT JOIN t USING (recording_id)""")  # fmt: skip
def q9(spark, sf):
    return rounded(metrics.stacked_histogram(spikes_ev(spark, sf), HIGH), "density_across", "density_within", digits=9)


#: The fit in SQL: damped Gauss-Newton steps by recursion, from one over the mean; each takes the first of the halved steps that lowers the cost.
FITS = """, b AS (SELECT recording_id, label, least(floor(isi * 100 / 86400.0), 99)::BIGINT AS bin, count(*) AS n FROM i WHERE isi BETWEEN 0 AND 86400.0 GROUP BY 1, 2, 3),
t AS (SELECT recording_id, label, sum(n) AS total FROM b GROUP BY 1, 2), s AS (SELECT recording_id, label, unnest(generate_series(0, 99)) AS bin FROM (SELECT DISTINCT recording_id, label FROM sp)),
h AS (SELECT recording_id, label, list([(bin + 0.5) * 864.0, coalesce(n, 0) / total / 864.0] ORDER BY bin) AS p FROM s LEFT JOIN b USING (recording_id, label, bin) JOIN t USING (recording_id, label) WHERE (bin + 0.5) * 864.0 > 3600.0 GROUP BY 1, 2),
fit AS (
  SELECT recording_id, label, p, 0 AS k, list_sum(list_transform(p, lambda x: x[2])) / greatest(list_sum(list_transform(p, lambda x: x[1] * x[2])), 1e-12) AS r FROM h WHERE list_sum(list_transform(p, lambda x: x[2])) > 0
  UNION ALL
  SELECT recording_id, label, p, k + 1, coalesce(list_filter(list_transform(range(40), lambda j: r + step / 2.0 ** j), lambda c: c > 0 AND list_sum(list_transform(p, lambda x: (x[2] - c * exp(-c * x[1])) ** 2)) <= cost)[1], r)
  FROM (SELECT *, list_sum(list_transform(p, lambda x: (x[2] - r * exp(-r * x[1])) ** 2)) AS cost,
      list_sum(list_transform(p, lambda x: exp(-r * x[1]) * (1 - r * x[1]) * (x[2] - r * exp(-r * x[1])))) / list_sum(list_transform(p, lambda x: (exp(-r * x[1]) * (1 - r * x[1])) ** 2)) AS step FROM fit WHERE k < 200)
), u AS (SELECT recording_id, label, count(*) FILTER (isi < 60.0) AS n_short, max(time) - min(time) AS duration FROM i GROUP BY 1, 2),
e AS (SELECT recording_id, label, n_short, r, r * duration AS m FROM u LEFT JOIN (SELECT * FROM fit WHERE k = 200) USING (recording_id, label))
SELECT recording_id, label, n_short, round(r, 9) AS fit_rate, round(n_short / m, 6) AS q_index, round(exp(n_short * ln(m) - m - lgamma(n_short + 1)), 6) AS chance FROM e"""


@query("q10_q11_interval_fits", "WITH RECURSIVE " + ISI + FITS)
def q10(spark, sf):
    found = recluster.interval_fits(spikes_ev(spark, sf), HIGH * 24, skip=HIGH, short=REFRACTORY)
    return rounded(rounded(found, "q_index", "chance"), "fit_rate", digits=9)


@query("q12_cluster_cards", f"WITH {EV} SELECT recording_id, label, count(*) AS n, count(DISTINCT sub_label) AS n_sub FROM sp GROUP BY 1, 2")
def q12(spark, sf):
    return metrics.cluster_cards(spikes_ev(spark, sf)).orderBy(RECORDING, F.desc("label"))


@query("q13_centroid_extent", f"WITH {D6} SELECT recording_id, round(min(mean), 6) AS low, round(max(mean), 6) AS high FROM ctr GROUP BY 1")
def q13(spark, sf):
    return rounded(metrics.centroid_extent(spikes_wf(spark, sf)), "low", "high")


@query("q14_projection_histogram", f"""WITH {EV}, e AS (SELECT recording_id, min(value) AS lo, max(value) AS hi FROM sp GROUP BY 1)
SELECT recording_id, label, least(floor((value - lo) * 100 / (hi - lo)), 99)::BIGINT AS bin, count(*) AS n FROM sp JOIN e USING (recording_id) GROUP BY 1, 2, 3""")  # fmt: skip
def q14(spark, sf):
    return metrics.projection_histogram(spikes_ev(spark, sf), "value")


@query("q15_recording_extent", f"WITH {EV} SELECT recording_id, min(time) AS t_first, max(time) AS t_last, round(max(abs(value)) * 1.2, 6) AS \"limit\" FROM sp GROUP BY 1")
def q15(spark, sf):
    return rounded(metrics.recording_extent(spikes_ev(spark, sf), "value"), "limit")


# -- stimuli


@query("a1_align", f"WITH {EV}{ST} SELECT st.stim_id, st.category, tr.spike_id, tr.label, round(tr.time - st.start_time, 6) AS rel_time FROM st LEFT JOIN tr ON tr.time >= st.start_time - 60.0 AND tr.time < st.start_time + 60.0")
def a1(spark, sf):
    return rounded(align.align(train_ev(spark, sf), stimuli_ev(spark, sf), -60.0, 60.0).select("stim_id", "category", "spike_id", "label", "rel_time"), "rel_time")


KEPT = EV + ST + ", x AS (SELECT recording_id, label, min(time) AS t0, max(time) AS t1 FROM tr GROUP BY 1, 2), kept AS (SELECT x.label, st.* FROM st JOIN x USING (recording_id) WHERE t0 <= start_time AND start_time < t1)"


@query("a2_kept_stimuli", f"WITH {KEPT} SELECT label, category, count(*) AS n FROM kept GROUP BY 1, 2")
def a2(spark, sf):
    return align.kept_stimuli(train_ev(spark, sf), stimuli_ev(spark, sf)).groupBy("label", "category").agg(F.count("*").alias("n"))


def _psth_sql(by: str) -> str:
    return f"""WITH {KEPT}, n AS (SELECT label{by}, count(*) AS n_stim FROM kept GROUP BY ALL),
h AS (SELECT kept.label{by}, least(floor((time - start_time) * 20 / 3600.0), 19)::BIGINT AS bin, count(*) AS c FROM kept JOIN tr ON tr.label = kept.label AND tr.time >= start_time - 3600.0 AND tr.time < start_time + 3600.0 AND tr.time - start_time BETWEEN 0 AND 3600.0 GROUP BY ALL),
s AS (SELECT *, unnest(generate_series(0, 19)) AS bin FROM n)
SELECT label{by}, bin, n_stim, round(coalesce(c, 0) / n_stim, 6) AS per_trial FROM s LEFT JOIN h USING (label, bin{by})"""


@query("a3_psth", _psth_sql(""))
def a3(spark, sf):
    return rounded(align.psth(train_ev(spark, sf), stimuli_ev(spark, sf), high=HIGH).drop(RECORDING), "per_trial")


@query("a4_psth_by_category", _psth_sql(", category"))
def a4(spark, sf):
    return rounded(align.psth(train_ev(spark, sf), stimuli_ev(spark, sf), ("category",), high=HIGH).drop(RECORDING), "per_trial")


# -- features


@query("m1_principal_scores")
def m1(spark, sf):
    return features.principal_scores(spikes_wf(spark, sf), 3).select(RECORDING, "spike_id", "pcs")


@query("m2_whitened_scores")
def m2(spark, sf):
    return features.principal_scores(spikes_wf(spark, sf), 3, whiten=True).select(RECORDING, "spike_id", "pcs")


@query("m3_vector_zscores", f"""WITH {WF}, m AS (SELECT recording_id, pos, avg(x) AS m, stddev_pop(x) AS s FROM px GROUP BY 1, 2)
SELECT recording_id, spike_id, pos, round(CASE WHEN s > 0 THEN (x - m) / s ELSE 0 END, 6) AS z FROM px JOIN m USING (recording_id, pos)""")  # fmt: skip
def m3(spark, sf):
    return _long(features.vector_zscores(spikes_wf(spark, sf)), "z", "z")


@query("m4_time_feature", f"WITH {EV} SELECT recording_id, spike_id, round(time / 7200.0 - avg(time / 7200.0) OVER (PARTITION BY recording_id), 6) AS t FROM sp")
def m4(spark, sf):
    return rounded(features.time_feature(spikes_ev(spark, sf)).select(RECORDING, "spike_id", "t"), "t")


@query("m5_feature_matrix")
def m5(spark, sf):
    return features.feature_matrix(spikes_wf(spark, sf), 4).select(RECORDING, "spike_id", "features")


@query("m6_pca_time")
def m6(spark, sf):
    return features.pca_time(spikes_wf(spark, sf), k=4).select(RECORDING, "spike_id", "pcs")


@query("m7_discriminant_axis")
def m7(spark, sf):
    stats = features.group_statistics(spikes_wf(spark, sf), [RECORDING, "label"])
    a = stats.select(RECORDING, F.col("label").alias("a"), F.col("mean").alias("mean_a"), F.col("scatter").alias("scatter_a"))
    b = stats.select(RECORDING, (F.col("label") - 1).alias("a"), F.col("mean").alias("mean_b"), F.col("scatter").alias("scatter_b"))
    return features.discriminant_axis(a.join(b, [RECORDING, "a"])).select(RECORDING, "a", "axis")


@query("m8_two_label_view")
def m8(spark, sf):
    return features.two_label_view(_subs(spark, sf).select(RECORDING, F.col("sub_label").alias("spike_id"), "label", F.col("centroid").alias("waveform")), 1, 2)


@query("m9_inliers", f"""WITH {EV}, m AS (SELECT recording_id, label, count(*) AS n, avg(time) AS m, stddev_pop(time) AS s FROM sp GROUP BY 1, 2)
SELECT recording_id, label, n <= 4 OR CASE WHEN s > 0 THEN abs(time - m) / s ELSE 0 END < 1.5 AS inlier, count(*) AS n FROM sp JOIN m USING (recording_id, label) GROUP BY ALL""".replace("count(*) AS n FROM sp JOIN", "count(*) AS rows FROM sp JOIN"))  # fmt: skip
def m9(spark, sf):
    return features.inliers_1d(spikes_ev(spark, sf), limit=1.5).groupBy(RECORDING, "label", "inlier").agg(F.count("*").alias("rows"))


#: Spikes of a block in neighbour queries: the recordings of the driver's tables are short.
NEIGHBOUR_BLOCK = 40
PAIRS = """, d AS (SELECT a.recording_id, a.spike_id, b.spike_id AS other, b.label, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) ** 2)) AS d2
  FROM v a JOIN v b USING (recording_id) WHERE a.spike_id <> b.spike_id),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, spike_id ORDER BY d2, other) AS r FROM d))"""


@query("m10_smoothed_labels", WF + ", v AS (SELECT recording_id, spike_id, label, waveform AS v FROM wf)" + PAIRS + """, k AS (SELECT recording_id, CASE WHEN count(*) <= 20 THEN 1 ELSE 19 END AS k FROM v GROUP BY 1),
votes AS (SELECT recording_id, spike_id, label FROM v UNION ALL SELECT recording_id, spike_id, nn.label FROM nn JOIN k USING (recording_id) WHERE r <= k),
c AS (SELECT recording_id, spike_id, label, count(*) AS n FROM votes GROUP BY 1, 2, 3)
SELECT recording_id, spike_id, label FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, spike_id ORDER BY n DESC, label) AS r FROM c) WHERE r = 1""")  # fmt: skip
def m10(spark, sf):
    return neighbours.smoothed_labels(spikes_wf(spark, sf), block=NEIGHBOUR_BLOCK)


@query("m11_closest", f"""WITH {EV}, q AS (SELECT recording_id, spike_id AS query_id, time / 86400.0 AS qx, value / 10.0 AS qy FROM sp WHERE spike_id % 50 = 0),
p AS (SELECT recording_id, spike_id, time / 86400.0 AS x, value / 10.0 AS y FROM sp WHERE spike_id % 50 <> 0),
d AS (SELECT recording_id, query_id, spike_id, sqrt((x - qx) ** 2 + (y - qy) ** 2) AS distance FROM q JOIN p USING (recording_id))
SELECT recording_id, query_id, spike_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, query_id ORDER BY distance, spike_id) AS r FROM d WHERE distance < 1.0) WHERE r = 1""")  # fmt: skip
def m11(spark, sf):
    at = spikes_ev(spark, sf).select(RECORDING, "spike_id", (F.col("time") / 86400.0).alias("x"), (F.col("value") / 10.0).alias("y"))
    queries = at.filter("spike_id % 50 = 0").select(RECORDING, F.col("spike_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    return rounded(features.closest(at.filter("spike_id % 50 <> 0"), queries, 1.0), "distance")


@query("m12_outlier_factors")
def m12(spark, sf):
    return neighbours.outlier_factors(features.principal_scores(spikes_wf(spark, sf), 2), "pcs", block=NEIGHBOUR_BLOCK)


@query("m12_outlier_factors_plane", EV + ", v AS (SELECT recording_id, spike_id, label, [time / 86400.0, value / 10.0] AS v FROM sp)" + PAIRS + """, near AS (SELECT recording_id, spike_id, other, r, sqrt(d2) AS d FROM nn WHERE r <= 20),
lim AS (SELECT recording_id, spike_id AS other, max(d) AS far FROM near GROUP BY 1, 2),
den AS (SELECT recording_id, spike_id, 1 / (avg(greatest(d, far)) + 1e-10) AS density FROM near JOIN lim USING (recording_id, other) GROUP BY 1, 2)
SELECT near.recording_id, near.spike_id, round(avg(o.density) / any_value(s.density), 6) AS lof FROM near JOIN den o ON o.recording_id = near.recording_id AND o.spike_id = near.other
JOIN den s ON s.recording_id = near.recording_id AND s.spike_id = near.spike_id GROUP BY 1, 2""")  # fmt: skip
def m12_plane(spark, sf):
    at = spikes_ev(spark, sf).select(RECORDING, "spike_id", F.array(F.col("time") / 86400.0, F.col("value") / 10.0).alias("at"))
    return rounded(neighbours.outlier_factors(at, "at", block=500), "lof")


@query("m13_trimmed_clusters")
def m13(spark, sf):
    return sorting.trimmed(sorting.cluster_windows(dense_wf(spark, sf), WINDOW)).drop("waveform")


@query("m14_ks", f"""WITH {EV}, v AS (SELECT recording_id, label // 2 AS pair, 1 + label % 2 AS side, value AS x FROM sp), n AS (SELECT recording_id, pair, count(*) FILTER (side = 1) AS na, count(*) FILTER (side = 2) AS nb FROM v GROUP BY 1, 2),
r AS (SELECT recording_id, pair, x, count(*) FILTER (side = 1) OVER w AS fa, count(*) FILTER (side = 2) OVER w AS fb FROM v WINDOW w AS (PARTITION BY recording_id, pair ORDER BY x))
SELECT recording_id, pair, round(max(abs(fa / na - fb / nb)), 6) AS ks FROM r JOIN n USING (recording_id, pair) GROUP BY 1, 2""")  # fmt: skip
def m14(spark, sf):
    values = spikes_ev(spark, sf).select(RECORDING, F.floor(F.col("label") / 2).alias("pair"), (F.col("label") % 2 + 1).alias("side"), F.col("value").alias("x"))
    return rounded(features.ks_statistics(values, [RECORDING, "pair"]), "ks")


@query("m15_mixture", FOUND)
def m15(spark, sf):
    """Mixtures of up to six components on the planted recordings' scores find the units."""
    spikes = planted_wf(spark, sf).transform(held)
    scored = features.principal_scores(spikes, 3, whiten=True).select(RECORDING, "spike_id", "pcs").transform(held)
    parts = mixtures.grouped(scored, [RECORDING], "pcs", 6, 0, size=PLANTED_WINDOW).withColumnRenamed("part", "label")
    return found_units(parts.join(spikes.select(RECORDING, "spike_id", "unit"), [RECORDING, "spike_id"]))


@query("m16_guided_reassignment", f"WITH {EV}, w AS (SELECT recording_id, spike_id // {PLANTED_WINDOW} AS window_idx, sub_label % 2 AS unit, count(*) AS n FROM sp GROUP BY 1, 2, 3), l AS (SELECT recording_id, max(window_idx) AS last FROM w GROUP BY 1) SELECT recording_id, window_idx, count(*) AS parts, true AS pure FROM w JOIN l USING (recording_id) WHERE window_idx < last GROUP BY 1, 2")
def m16(spark, sf):
    """Whole windows of two units with a guide that is wrong on every tenth spike: parts, and whether each is one unit."""
    guide = F.when(F.col("spike_id") % 10 == 0, 1 - F.col("unit")).otherwise(F.col("unit"))
    windowed = planted_wf(spark, sf, units=2).withColumn("window_idx", F.floor(F.col("spike_id") / PLANTED_WINDOW)).withColumn("win_label", guide).transform(held)
    parts = sorting.guided_reassignment(windowed, 2).join(windowed.select(RECORDING, "spike_id", "unit"), [RECORDING, "spike_id"])
    cells = parts.groupBy(RECORDING, "window_idx", "part", "unit").agg(F.count("*").alias("c")).groupBy(RECORDING, "window_idx", "part").agg((F.max("c") >= 0.99 * F.sum("c")).alias("pure"))
    found = cells.groupBy(RECORDING, "window_idx").agg(F.count("*").alias("parts"), F.bool_and("pure").alias("pure"))
    return found.withColumn("_last", F.max("window_idx").over(Window.partitionBy(RECORDING))).filter("window_idx < _last").drop("_last")


@query("m17_k_core")
def m17(spark, sf):
    s = spikes_ev(spark, sf)
    pairs = s.select(RECORDING, F.col("sub_label").alias("u"), (F.col("sub_label") % 97 + F.col("label")).alias("v")).filter("u <> v").distinct()
    return features.k_core(pairs.unionByName(pairs.select(RECORDING, F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), 2)


@query("m18_time_vs_axis")
def m18(spark, sf):
    rows = spikes_wf(spark, sf)
    groups = rows.select(RECORDING, "label").distinct().filter("label = 1").withColumn("group", F.lit("unit"))
    return features.time_vs_axis(rows, groups)


@query("m19_projection")
def m19(spark, sf):
    return features.project(spikes_wf(spark, sf), lambda x: x[:, :2] - x[:, 2:4]).select(RECORDING, "spike_id", "projected")


# -- sorting


@query("p1_reference_map")
def p1(spark, sf):
    return sorting.reference_map(dense_wf(spark, sf)).select(RECORDING, "spike_id", "map")


def _windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = sorting.reference_map(dense_wf(spark, sf_dir))
    return sorting.cluster_windows(mapped, WINDOW).transform(held)


@query("p2_p3_cluster_windows")
def p2(spark, sf):
    return _windowed(spark, sf).drop("waveform")


@query("p4_link_windows")
def p4(spark, sf):
    return sorting.link_windows(_windowed(spark, sf))


@query("p5_unmerge")
def p5(spark, sf):
    return sorting.unmerge(_windowed(spark, sf)).drop("waveform")


@query("p4_link_planted", f"""WITH {PLANTED} SELECT recording_id, a.window_idx AS src_win, a.unit AS src_label, a.window_idx + 1 AS dst_win, a.unit AS dst_label
FROM pw a JOIN pw b USING (recording_id, unit) WHERE b.window_idx = a.window_idx + 1 AND a.n >= 10 AND b.n >= 10""")  # fmt: skip
def p4_planted(spark, sf):
    windowed = planted_wf(spark, sf).withColumn("window_idx", F.floor(F.col("spike_id") / PLANTED_WINDOW)).withColumnRenamed("unit", "win_label").transform(held)
    return sorting.link_windows(windowed).drop("ks")


@query("p5_unmerge_planted", f"WITH {PLANTED}, l AS (SELECT recording_id, max(window_idx) AS w FROM pw GROUP BY 1) SELECT recording_id, window_idx, count(*) AS units, count(*) AS labels, true AS pure FROM pw JOIN l USING (recording_id) WHERE window_idx < w GROUP BY 1, 2")
def p5_planted(spark, sf):
    """Units, labels and purity (over seven tenths) of each whole window after the clusters of several units are split."""
    windowed = planted_windows(spark, sf).transform(held)
    split = sorting.unmerge(windowed.drop("unit")).select(RECORDING, "spike_id", "window_idx", "win_label").join(windowed.select(RECORDING, "spike_id", "unit"), [RECORDING, "spike_id"])
    cells = split.groupBy(RECORDING, "window_idx", "win_label", "unit").agg(F.count("*").alias("c"))
    labels = cells.groupBy(RECORDING, "window_idx", "win_label").agg((F.max("c") > 0.7 * F.sum("c")).alias("pure"))
    found = labels.groupBy(RECORDING, "window_idx").agg(F.count("*").alias("labels"), F.bool_and("pure").alias("pure"))
    units = split.groupBy(RECORDING, "window_idx").agg(F.countDistinct("unit").alias("units"))
    last = Window.partitionBy(RECORDING)
    whole = units.join(found, [RECORDING, "window_idx"]).withColumn("_last", F.max("window_idx").over(last))
    return whole.filter("window_idx < _last").select(RECORDING, "window_idx", "units", "labels", "pure")


EDGES = EV + """, c AS (SELECT recording_id, floor(time / 86400)::BIGINT AS src_win, label AS src_label, count(*) AS n FROM sp GROUP BY 1, 2, 3),
e AS (SELECT recording_id, src_win, src_label, src_win + 1 AS dst_win, (src_label + n) % 10 AS dst_label FROM c WHERE n % 3 <> 0),
nodes AS (SELECT recording_id, src_win AS w, src_label AS l FROM e UNION SELECT recording_id, dst_win, dst_label FROM e),
step AS (SELECT recording_id, src_win AS w, src_label AS l, dst_win AS w2, dst_label AS l2 FROM e UNION SELECT recording_id, dst_win, dst_label, src_win, src_label FROM e),
reach AS (SELECT recording_id, w, l, w AS rw, l AS rl FROM nodes UNION SELECT r.recording_id, r.w, r.l, s.w2, s.l2 FROM reach r JOIN step s ON s.recording_id = r.recording_id AND s.w = r.rw AND s.l = r.rl),
roots AS (SELECT recording_id, w, l, min(rw * 10 + rl) AS root FROM reach GROUP BY 1, 2, 3),
firsts AS (SELECT e.recording_id, root, min((src_win * 10 + src_label) * 10000 + dst_win * 10 + dst_label) AS f FROM e JOIN roots r ON r.recording_id = e.recording_id AND r.w = src_win AND r.l = src_label GROUP BY 1, 2),
sizes AS (SELECT recording_id, root FROM roots GROUP BY 1, 2 HAVING count(*) >= 3),
named AS (SELECT recording_id, root, row_number() OVER (PARTITION BY recording_id ORDER BY f) - 1 AS label FROM sizes JOIN firsts USING (recording_id, root))"""


@query("p6_unit_labels", "WITH RECURSIVE " + EDGES + " SELECT recording_id, w AS window_idx, l AS win_label, label FROM roots JOIN named USING (recording_id, root)")
def p6(spark, sf):
    nodes = spikes_ev(spark, sf).groupBy(RECORDING, F.floor(F.col("time") / DT).alias("src_win"), F.col("label").alias("src_label")).agg(F.count("*").alias("n"))
    edges = nodes.filter("n % 3 <> 0").select(RECORDING, "src_win", "src_label", (F.col("src_win") + 1).alias("dst_win"), ((F.col("src_label") + F.col("n")) % 10).alias("dst_label"))
    return graph.unit_labels(edges.transform(held))


@query("p7_leftovers")
def p7(spark, sf):
    mapped = sorting.reference_map(dense_wf(spark, sf)).transform(held)
    return sorting.leftovers(mapped, sorting.sort_once(mapped, WINDOW).transform(held), WINDOW)


@query("p8_remainder")
def p8(spark, sf):
    spikes = dense_wf(spark, sf)
    return sorting.remainder(spikes, spikes.select(RECORDING, "spike_id", F.lit(-1).cast("long").alias("label")), block=WINDOW)


@query("p8_remainder_planted", FOUND)
def p8_planted(spark, sf):
    spikes = planted_wf(spark, sf).transform(held)
    labels = sorting.remainder(spikes.drop("unit"), spikes.select(RECORDING, "spike_id", F.lit(-1).cast("long").alias("label")), block=PLANTED_WINDOW)
    return found_units(labels.join(spikes.select(RECORDING, "spike_id", "unit"), [RECORDING, "spike_id"]))


@query("p9_sort_planted", FOUND)
def p9_planted(spark, sf):
    spikes = planted_wf(spark, sf).transform(held)
    return found_units(sorting.sort(spikes, PLANTED_WINDOW))


@query("p9_sort")
def p9(spark, sf):
    return sorting.sort(dense_wf(spark, sf).transform(held), WINDOW).select(RECORDING, "spike_id", "time", "label")


def queries() -> dict[str, Query]:
    return {name: _ready(f) for name, f in QUERIES.items()}


def _ready(f: Query) -> Query:
    """Iterative jobs cut lineage by checkpoints: the folder is the session's, a temporary one only
    where none is named (tests)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not spark.sparkContext.getCheckpointDir():
            import tempfile

            named = spark.conf.get("spark.checkpoint.dir", None)
            if not named and not spark.sparkContext.master.startswith("local"):
                raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spikeloom-"))
        return f(spark, sf_dir)

    return run


def oracle_sql() -> dict[str, str]:
    return {name: sql if sql.lstrip().upper().startswith(("WITH", "SELECT")) else f"WITH {sql}" for name, sql in SQL.items()}
