"""Spike tables, clusters, filters and hierarchies; everything is keyed by recording_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.operators.held import held

RECORDING = "recording_id"


def _by_time(*ties: str, within: tuple[str, ...] = ()) -> Window:
    return Window.partitionBy(RECORDING, *within).orderBy("time", *ties)


def spike_table(rows: DataFrame, *ties: str) -> DataFrame:
    """Spikes in time order: spike_id is the 0-based rank in the recording, label defaults to 0."""
    label = F.coalesce(F.col("label"), F.lit(0)) if "label" in rows.columns else F.lit(0)
    return rows.withColumn("spike_id", (F.row_number().over(_by_time(*ties)) - 1).cast("long")).withColumn("label", label.cast("long"))


def spike_table_ranged(rows: DataFrame, partitions: int, *ties: str) -> DataFrame:
    """The same for recordings too large for one task: rows are dealt by time range, ranked inside
    each range, and shifted by the counts of the ranges before. Written out once by the caller's
    checkpoint, since range borders come from a sample."""
    dealt = rows.repartitionByRange(partitions, RECORDING, "time", *ties).withColumn("_part", F.spark_partition_id())
    dealt = dealt.transform(held)
    counts = dealt.groupBy(RECORDING, "_part").count()
    before = Window.partitionBy(RECORDING).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(RECORDING, "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(RECORDING, "_part").orderBy("time", *ties)
    ranked = dealt.withColumn("_rank", F.row_number().over(inside) - 1).join(offsets, [RECORDING, "_part"])
    label = F.coalesce(F.col("label"), F.lit(0)) if "label" in rows.columns else F.lit(0)
    return ranked.withColumn("spike_id", F.col("_rank") + F.col("_offset")).withColumn("label", label.cast("long")).drop("_part", "_rank", "_offset")


def timed_table(rows: DataFrame, columns: dict[str, str], *ties: str) -> DataFrame:
    """A table with declared columns and types, in time order with ids."""
    typed = rows.select(RECORDING, F.col("time").cast("double").alias("time"), *ties, *[F.col(c).cast(kind).alias(c) for c, kind in columns.items()])
    return typed.withColumn("id", (F.row_number().over(_by_time(*ties)) - 1).cast("int")).select(RECORDING, "id", "time", *columns)


# -- node properties


def leaf_counts(spikes: DataFrame) -> DataFrame:
    """Children and leaves of every cluster."""
    return spikes.groupBy(RECORDING, "label").agg(F.countDistinct("sub_label").alias("n_sub"), F.count("*").alias("n"))


def weights(spikes: DataFrame) -> DataFrame:
    """The leaf count of every sub-cluster, as its weight in the cluster."""
    return spikes.groupBy(RECORDING, "label", "sub_label").agg(F.count("*").cast("double").alias("weight"))


def vector_mean(rows: DataFrame, keys: list[str], vector: str = "waveform", into: str = "centroid") -> DataFrame:
    """The element-wise mean: one partial sum a position and group before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p")).select(*keys, F.transform("p", lambda s: s["x"]).alias(into))


#: The sketch that finds where a median lies is at most n / ACCURACY ranks off.
ACCURACY = 10_000


def medians(rows: DataFrame, keys: list[str], value: str = "time", into: str = "med_time") -> DataFrame:
    """keys, n and the exact median of each group, of any size, by selection: a mergeable sketch gives
    two values that hold the middle ranks between them, and only what lies there is counted value by
    value; of the rest a group hands on two numbers. So a task never holds a group. Null values don't
    count; a group without any other has no row."""
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    margin = 4 / ACCURACY
    around = known.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], ACCURACY).alias("_ends"))
    low, high = F.col("_ends")[0], F.col("_ends")[1]
    slot = F.when((F.col("_v") >= low) & (F.col("_v") <= high), F.col("_v"))
    counts = known.join(around, keys).groupBy(*keys, "n", slot.alias("_slot")).agg(F.count("*").alias("_c"), F.sum((F.col("_v") < low).cast("long")).alias("_low"))
    # the row without a slot stands first and counts what is below
    passed = F.sum(F.when(F.col("_slot").isNull(), F.col("_low")).otherwise(F.col("_c"))).over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_slot")))
    run = counts.withColumn("_to", passed)
    at = lambda rank: F.max(F.when(F.col("_slot").isNotNull() & (F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")), F.col("_slot")))
    return run.groupBy(*keys, "n").agg((0.5 * at(F.floor((F.col("n") - 1) / 2)) + 0.5 * at(F.floor(F.col("n") / 2))).alias(into)).select(*keys, "n", into)


def sub_clusters(spikes: DataFrame) -> DataFrame:
    """Count, median time and centroid of every sub-cluster."""
    keys = [RECORDING, "label", "sub_label"]
    return medians(spikes, keys).join(vector_mean(spikes, keys), keys)


def hierarchy_centroids(spikes: DataFrame) -> DataFrame:
    """The unweighted mean of the sub-clusters' means."""
    inner = vector_mean(spikes, [RECORDING, "label", "sub_label"])
    return vector_mean(inner, [RECORDING, "label"], "centroid")


def cluster_times(spikes: DataFrame) -> DataFrame:
    """Median time, and the median of the sub-clusters' medians."""
    keys = [RECORDING, "label"]
    inner = medians(spikes, [*keys, "sub_label"], into="t")
    sizes = inner.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("n_sub"))
    nested = medians(inner.drop("n"), keys, "t").drop("n")
    return nested.join(sizes, keys).join(medians(spikes, keys, into="leaf_time").drop("n"), keys)


def ordered_clusters(times: DataFrame) -> DataFrame:
    """node_id: the rank by median time, then label."""
    order = Window.partitionBy(RECORDING).orderBy("med_time", "label")
    return times.withColumn("node_id", (F.row_number().over(order) - 1).cast("long"))


def labeled_nodes(spikes: DataFrame) -> DataFrame:
    return ordered_clusters(cluster_times(spikes)).select(RECORDING, "node_id", "label")


def lineage(clusters: DataFrame, derived: DataFrame) -> DataFrame:
    """Clusters with what they were derived from: (recording_id, label, source_label)."""
    sources = clusters.select(RECORDING, F.col("label").alias("source_label"), F.col("n").alias("source_n"))
    return clusters.join(derived, [RECORDING, "label"], "left").join(sources, [RECORDING, "source_label"], "left")


# -- selections


def select_where(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.filter(condition)


def select_positions(rows: DataFrame, positions: DataFrame, by: str = "spike_id") -> DataFrame:
    """Rows at the given positions (recording_id and position; without recording_id they hold for every
    recording); Spark picks the join by size."""
    keys = [RECORDING, by] if RECORDING in positions.columns else [by]
    return rows.join(positions.select(*keys).distinct(), keys, "left_semi")


def select_clusters(spikes: DataFrame, labels: DataFrame) -> DataFrame:
    """The spikes of whole clusters, with new node ids."""
    chosen = spikes.join(labels.select(RECORDING, "label").distinct(), [RECORDING, "label"], "left_semi")
    nodes = labeled_nodes(chosen)
    return chosen.join(nodes, [RECORDING, "label"])


def split_where(rows: DataFrame, condition: Column) -> DataFrame:
    """Both parts in one pass, told apart by `side`."""
    return rows.withColumn("side", F.coalesce(condition, F.lit(False)))


def time_split(spikes: DataFrame, start: float, stop: float) -> DataFrame:
    """Sub-clusters cut into what lies in [start, stop) and the rest; empty parts don't appear."""
    inside = (F.col("time") >= start) & (F.col("time") < stop)
    return medians(spikes.withColumn("within", inside), [RECORDING, "label", "sub_label", "within"])


def match_several(clusters: DataFrame, labels: list[int] | None = None, nodes: list[int] | None = None, members: DataFrame | None = None) -> DataFrame:
    """Clusters with a flag `matched`; exactly one of the three ways must be given."""
    if sum(x is not None for x in (labels, nodes, members)) != 1:
        raise ValueError("give labels, nodes or members, one of them")
    if members is not None:
        keys = members.select(RECORDING, "label").distinct().withColumn("_hit", F.lit(True))
        return clusters.join(keys, [RECORDING, "label"], "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")
    column, values = ("label", labels) if labels is not None else ("node_id", nodes)
    return clusters.withColumn("matched", F.col(column).isin(values))


def match_one(clusters: DataFrame, condition: Column) -> DataFrame:
    """The one cluster of each recording that fits; the job fails where there are several or none."""
    counted = clusters.groupBy(RECORDING).agg(F.sum(F.coalesce(condition, F.lit(False)).cast("int")).alias("_n"))
    checked = counted.select(RECORDING, F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("matching clusters: "), F.col("_n").cast("string")))).alias("_one"))
    return clusters.filter(condition).join(checked.filter("_one"), RECORDING).drop("_one")


def every_kth(rows: DataFrame, most: int, position: str = "spike_id") -> DataFrame:
    """Every k-th row, k = max(1, n div most), counted in each recording."""
    counts = rows.groupBy(RECORDING).agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("_k"))
    return rows.join(counts, RECORDING).filter(F.col(position) % F.col("_k") == 0).drop("_k")


def every_kth_of_cluster(spikes: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Of each cluster every k-th spike, from a start that a seeded hash (MD5) of the cluster gives."""
    keys = [RECORDING, "label"]
    counts = spikes.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.count("*") / most)).alias("_k"))
    position = F.row_number().over(Window.partitionBy(*keys).orderBy("time", "spike_id")) - 1
    placed = spikes.withColumn("_at", position).join(counts, keys)
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(c).cast("string") for c in keys]).cast("binary"))
    start = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_k")
    return placed.filter((F.col("_at") >= start) & (F.pmod(F.col("_at") - start, F.col("_k")) == 0)).drop("_at", "_k")


def toggled(selected: DataFrame, toggles: DataFrame) -> DataFrame:
    """Labels selected after toggling: those in exactly one of the two tables."""
    both = selected.select(RECORDING, "label").distinct().unionByName(toggles.select(RECORDING, "label").distinct())
    return both.groupBy(RECORDING, "label").count().filter("count = 1").drop("count")


# -- hierarchy


def cluster(spikes: DataFrame) -> DataFrame:
    """Clusters of a label column: count, median time, and order by it."""
    return ordered_clusters(medians(spikes, [RECORDING, "label"]))


def node_labels(spikes: DataFrame) -> DataFrame:
    """recording_id, node and `top`: the label that a flattened row of the node carries. That is the
    node's own label where the recording's labels are unique, else the node's position in time."""
    node = "node" if "node" in spikes.columns else "label"
    keys = [RECORDING, node]
    times = medians(medians(spikes, [*keys, "sub_label"], into="t").drop("n"), keys, "t").drop("n")
    labels = spikes.groupBy(*keys).agg(F.min("label").alias("_label"))
    every = Window.partitionBy(RECORDING)
    placed = times.join(labels, keys).withColumn("_at", F.row_number().over(every.orderBy("med_time", node)) - 1)
    repeats = placed.groupBy(RECORDING).agg((F.count("*") > F.countDistinct("_label")).alias("_repeat"))
    return placed.join(repeats, RECORDING).select(*keys, F.when(F.col("_repeat"), F.col("_at")).otherwise(F.col("_label")).cast("long").alias("top"))


def flatten(spikes: DataFrame, depth: int | None = None, assign_labels: bool = True) -> DataFrame:
    """A hierarchy of clusters, sub-clusters and spikes flattened: to sub-clusters (depth 1: counts and
    median times), to spikes (depth 2, or None for the lowest there is), or not at all (depth 0). Rows
    carry their cluster's label as node_labels gives it; without assign_labels they keep the lower one
    (a sub-cluster's, or a spike's in `spike_label`). A column `node` tells clusters apart that share a
    label; without it, clusters are labels."""
    if depth == 0:
        return spikes
    node = "node" if "node" in spikes.columns else "label"
    keys = [RECORDING, *dict.fromkeys((node, "label")), "sub_label"]
    if depth == 1:
        rows, lower = medians(spikes, keys), F.col("sub_label")
    else:
        lower = F.col("spike_label") if "spike_label" in spikes.columns else F.lit(0)
        rows = spikes.select(*keys, "spike_id", "time", *(["spike_label"] if "spike_label" in spikes.columns else []))
    if not assign_labels:
        return rows.withColumn("label", lower.cast("long"))
    top = node_labels(spikes)
    return rows.join(top, [RECORDING, node]).withColumn("label", F.col("top")).drop("top")


def flatten_once(spikes: DataFrame) -> DataFrame:
    """Sub-clusters as rows, with their cluster's label and the order by time in it."""
    order = Window.partitionBy(RECORDING, "label").orderBy("med_time", "sub_label")
    return medians(spikes, [RECORDING, "label", "sub_label"]).withColumn("position", (F.row_number().over(order) - 1).cast("long"))


def window_hierarchy(spikes: DataFrame, step: int = 2000) -> DataFrame:
    """A fresh sub-label for each label of each window of `step` spikes; all spikes labelled -1 share
    the sub-label -1, but their place still takes a number."""
    windowed = spikes.withColumn("window_idx", F.floor(F.col("spike_id") / step))
    pairs = windowed.select(RECORDING, "window_idx", "label").distinct()
    order = Window.partitionBy(RECORDING).orderBy("window_idx", "label")
    numbered = pairs.withColumn("sub_label", F.when(F.col("label") == -1, -1).otherwise(F.row_number().over(order) - 1).cast("long"))
    return windowed.drop("sub_label").join(numbered, [RECORDING, "window_idx", "label"])


def appended(existing: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups (recording_id, group) relabelled to max(existing) + 1, + 2, ... in order."""
    highest = existing.groupBy(RECORDING).agg(F.max("label").alias("_top"))
    order = Window.partitionBy(RECORDING).orderBy("group")
    ranked = groups.select(RECORDING, "group").distinct().withColumn("_rank", F.row_number().over(order))
    return ranked.join(highest, RECORDING, "left").select(RECORDING, "group", (F.coalesce("_top", F.lit(0)) + F.col("_rank")).alias("label"))


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
