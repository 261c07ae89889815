"""Reclustering, clean-up and interval fits, on sub-clusters; no group grows with the recording."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.functions import kernels
from spikeloom.jobs import mixtures
from spikeloom.operators import curate, features, model, neighbours
from spikeloom.operators.held import held
from spikeloom.operators.metrics import intervals, isi_histogram
from spikeloom.operators.model import RECORDING

CLUSTER = (RECORDING, "label")
#: Intervals of a cluster's times whose weights and means stand for its sub-clusters in k-means.
TIME_BINS = 4096


def _by_time(parted: DataFrame, subs: DataFrame) -> DataFrame:
    """Parts (recording_id, label, sub_label, part) numbered by the median of their sub-clusters' times."""
    parted = parted.transform(held)
    times = model.medians(parted.join(subs.select(*CLUSTER, "sub_label", "med_time"), [*CLUSTER, "sub_label"]), [*CLUSTER, "part"], "med_time", "_t").drop("n")
    rank = F.row_number().over(Window.partitionBy(*CLUSTER).orderBy("_t", "part")) - 1
    ranked = times.select(*CLUSTER, "part", rank.cast("long").alias("_rank"))
    return parted.join(ranked, [*CLUSTER, "part"]).select(*CLUSTER, "sub_label", F.col("_rank").alias("part"))


def by_shape(subs: DataFrame, parts: int = 4) -> DataFrame:
    """Parts of each cluster by the shape of its sub-clusters' centroids: a mixture on its principal
    scores, fitted by sums over blocks of sub-clusters; two sub-clusters or fewer stay together."""
    subs = subs.select(*CLUSTER, "sub_label", "med_time", "centroid").transform(held)
    scored = features.principal_scores(subs, 6, "centroid", keys=CLUSTER).transform(held)
    return _by_time(mixtures.grouped(scored, list(CLUSTER), "pcs", parts, 0, order="sub_label", starts=1, dips=False, least=3), subs)


def by_time(subs: DataFrame, parts: int = 3) -> DataFrame:
    """Parts of each cluster by weighted k-means of its sub-clusters' times; times two deviations off
    make a part of their own. The centres come from a summary: weight and mean time of each of
    TIME_BINS intervals."""
    subs = subs.select(*CLUSTER, "sub_label", "n", "med_time").transform(held)
    flagged = features.inliers_1d(subs, "med_time")
    extents = flagged.filter("inlier").groupBy(*CLUSTER).agg(F.min("med_time").alias("_low"), F.max("med_time").alias("_high"))
    share = (F.col("med_time") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300))
    binned = flagged.filter("inlier").join(extents, list(CLUSTER)).withColumn("_bin", F.floor(share * TIME_BINS))
    weight = F.sum("n").cast("double")
    bins = binned.groupBy(*CLUSTER, "_bin").agg(weight.alias("w"), (F.sum(F.col("n") * F.col("med_time")) / weight).alias("t"))

    def centres(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", kind="stable")
        return pd.DataFrame({**{c: [g[c].iat[0]] for c in CLUSTER}, "centres": [kernels.kmeans_centres_1d(g["t"].to_numpy(), g["w"].to_numpy(), parts)]})

    found = bins.groupBy(*CLUSTER).applyInPandas(centres, f"{RECORDING} string, label long, centres array<double>")
    away = F.transform("centres", lambda c: F.abs(F.col("med_time") - c))
    near = F.array_position(away, F.array_min(away)) - 1
    return _by_time(flagged.join(found, list(CLUSTER)).select(*CLUSTER, "sub_label", F.when(F.col("inlier"), near).otherwise(parts).cast("long").alias("part")), subs)


def by_noise(subs: DataFrame) -> DataFrame:
    """Inliers and outliers of each cluster, by the largest standardised one of two principal scores;
    with three sub-clusters or fewer each is a part, with four all are inliers."""
    subs = subs.select(*CLUSTER, "sub_label", "med_time", "centroid").transform(held)
    scored = features.principal_scores(subs, 2, "centroid", keys=CLUSTER).transform(held)
    sizes = scored.groupBy(*CLUSTER).agg(F.count("*").alias("_n"), *[F.sqrt(F.avg(F.col("pcs")[i] ** 2)).alias(f"_s{i}") for i in range(2)])
    z = [F.when(F.col(f"_s{i}") > 0, F.abs(F.col("pcs")[i]) / F.col(f"_s{i}")).otherwise(0.0) for i in range(2)]
    first = F.row_number().over(Window.partitionBy(*CLUSTER, F.col("_n") <= 3).orderBy("sub_label")) - 1
    few = scored.join(sizes.filter("_n <= 3"), list(CLUSTER)).select(*CLUSTER, "sub_label", first.cast("long").alias("part"))
    many = scored.join(sizes.filter("_n > 3"), list(CLUSTER)).select(*CLUSTER, "sub_label", ((F.col("_n") > 4) & (F.greatest(*z) >= 2)).cast("long").alias("part"))
    return _by_time(few.unionByName(many), subs)


def reclustered(assignments: DataFrame, parts: DataFrame) -> DataFrame:
    """The edit: clusters that have parts (recording_id, label, sub_label, part) are taken out, and their
    parts come back as new clusters, labelled after the highest that is left, in order of median time."""
    chosen = parts.select(RECORDING, "label").distinct()
    moved = assignments.join(parts, [RECORDING, "label", "sub_label"]).withColumn("part", F.struct("label", "part"))
    return curate.add_clusters(curate.delete_clusters(assignments, chosen), moved)


def cleaned_assignments(subs: DataFrame, k: int = 3, pcs: int = 6, scale: float = 3600.0, block: int = neighbours.BLOCK) -> DataFrame:
    """Sub-clusters with the majority label of their nearest ones in the recording, on principal scores
    and time."""
    number = F.row_number().over(Window.partitionBy(RECORDING).orderBy("sub_label", "label")).cast("long")
    rows = subs.select(RECORDING, "sub_label", number.alias("spike_id"), "label", F.col("med_time").alias("time"), F.col("centroid").alias("waveform")).transform(held)
    rows = features.pca_time(rows, scale, pcs).transform(held)
    voted = neighbours.smoothed_labels(rows, "pcs", k, block).withColumnRenamed("label", "new_label")
    return rows.join(voted, [RECORDING, "spike_id"]).select(RECORDING, "sub_label", "label", "new_label")


def interval_fits(spikes: DataFrame, high: float = 0.1, bins: int = 100, skip: float = 0.01, short: float = 0.002) -> DataFrame:
    """The exponential rate of each unit's interval density beyond `skip`, the Q index (short intervals
    over rate * duration) and the Poisson chance of just so many; null where nothing can be fitted."""
    unit = [RECORDING, "label"]
    histogram = isi_histogram(spikes, high, bins).groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("bin", "density"))).alias("h"))
    counts = intervals(spikes).groupBy(*unit).agg(F.sum(F.coalesce((F.col("isi") < short).cast("long"), F.lit(0))).alias("n_short"), (F.max("time") - F.min("time")).alias("duration"))

    @F.pandas_udf("fit_rate double, q_index double, chance double")
    def fit(h: pd.Series, n_short: pd.Series, duration: pd.Series) -> pd.DataFrame:
        rows = []
        for bars, k, seconds in zip(h, n_short, duration):
            density = np.array([np.nan if b["density"] is None else b["density"] for b in bars])
            centres = (np.array([b["bin"] for b in bars]) + 0.5) * high / bins
            used = centres > skip
            found = kernels.exponential_rate(centres[used], density[used])
            expected = 0.0 if found is None or not seconds else found * seconds
            chance = math.exp(k * math.log(expected) - expected - math.lgamma(k + 1)) if expected > 0 else None
            rows.append((found, k / expected if expected > 0 else None, chance))
        return pd.DataFrame(rows, columns=["fit_rate", "q_index", "chance"]).astype("float64")

    return histogram.join(counts, unit).select(*unit, "n_short", fit("h", "n_short", "duration").alias("f")).select(*unit, "n_short", "f.*")
