"""Unit quality: rates, waveform bands, intervals and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.operators.model import RECORDING, hierarchy_centroids
from spikeloom.operators.windows import intervals, marked_intervals

UNIT = [RECORDING, "label"]


def _ratio(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.when(b != 0, a / b)


def rate() -> Column:
    return _ratio(F.count("*"), F.max("time") - F.min("time"))


def firing_rates(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy(*UNIT).agg(F.count("*").alias("n"), rate().alias("rate"))


def waveform_band(spikes: DataFrame) -> DataFrame:
    """Position, mean over sub-clusters and population deviation over spikes."""
    std = spikes.select(*UNIT, F.posexplode("waveform").alias("pos", "x")).groupBy(*UNIT, "pos").agg(F.stddev_pop("x").alias("std"))
    mean = hierarchy_centroids(spikes).select(*UNIT, F.posexplode("centroid").alias("pos", "mean"))
    return mean.join(std, [*UNIT, "pos"])


def signal_to_noise(spikes: DataFrame) -> DataFrame:
    """Height of the mean waveform over its mean deviation, and the value at the middle sample."""
    band = waveform_band(spikes)
    return band.groupBy(*UNIT).agg(
        _ratio(F.max("mean") - F.min("mean"), F.avg("std")).alias("snr"),
        F.element_at(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]), F.floor(F.count("*") / 2).cast("int") + 1).alias("amplitude"),
    )


def violations(spikes: DataFrame, refractory: float = 0.001) -> DataFrame:
    """Share of intervals under the refractory time, and its chance level 1 - exp(-rate * time)."""
    found = intervals(spikes).groupBy(*UNIT).agg(
        F.count("*").alias("n"), rate().alias("rate"), _ratio(F.sum((F.col("isi") < refractory).cast("int")), F.count("isi")).alias("violation_rate")
    )
    return found.withColumn("chance", 1 - F.exp(-F.col("rate") * refractory))


def across_violations(spikes: DataFrame, refractory: float = 0.001) -> DataFrame:
    """Of the intervals across two units, the share under the refractory time, by recording."""
    marked = marked_intervals(spikes).filter("across")
    return marked.groupBy(RECORDING).agg(F.count("*").alias("n_across"), _ratio(F.sum((F.col("isi") < refractory).cast("int")), F.count("*")).alias("violation_rate"))


def bin_index(value: Column, low: float, high: float, bins: int) -> Column:
    """The bin of a value in [low, high], the last bin closed; null outside."""
    at = F.least(F.floor((value - low) * bins / (high - low)), F.lit(bins - 1))
    return F.when((value >= low) & (value <= high), at)


def spine(keys: DataFrame, bins: int) -> DataFrame:
    return keys.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))


def isi_histogram(spikes: DataFrame, high: float = 0.1, bins: int = 30) -> DataFrame:
    """Density of the intervals in [0, high] of each unit; units without any have null densities."""
    found = intervals(spikes).withColumn("bin", bin_index(F.col("isi"), 0.0, high, bins)).filter("bin IS NOT NULL")
    counts = found.groupBy(*UNIT, "bin").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*UNIT).agg(F.sum("n").alias("total"))
    full = spine(spikes.select(*UNIT).distinct(), bins).join(counts, [*UNIT, "bin"], "left").join(totals, UNIT, "left")
    return full.select(*UNIT, "bin", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total") / (high / bins)).alias("density"))


def stacked_histogram(spikes: DataFrame, high: float = 0.1, bins: int = 30) -> DataFrame:
    """Intervals within and across units, with one density for both."""
    found = marked_intervals(spikes).withColumn("bin", bin_index(F.col("isi"), 0.0, high, bins)).filter("bin IS NOT NULL")
    counts = found.groupBy(RECORDING, "bin").agg(F.sum(F.col("across").cast("int")).alias("n_across"), F.sum((~F.col("across")).cast("int")).alias("n_within"))
    totals = counts.groupBy(RECORDING).agg(F.sum(F.col("n_across") + F.col("n_within")).alias("total"))
    full = spine(spikes.select(RECORDING).distinct(), bins).join(counts, [RECORDING, "bin"], "left").join(totals, RECORDING, "left")
    density = lambda c: (F.coalesce(c, F.lit(0)) / F.col("total") / (high / bins)).alias(c.replace("n_", "density_"))
    return full.select(RECORDING, "bin", density("n_across"), density("n_within"))


def cluster_cards(spikes: DataFrame) -> DataFrame:
    return spikes.groupBy(*UNIT).agg(F.count("*").alias("n"), F.countDistinct("sub_label").alias("n_sub"))


def centroid_extent(spikes: DataFrame) -> DataFrame:
    """Least and greatest sample over all centroids of a recording."""
    return hierarchy_centroids(spikes).groupBy(RECORDING).agg(F.min(F.array_min("centroid")).alias("low"), F.max(F.array_max("centroid")).alias("high"))


def projection_histogram(rows: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Counts of a projection by label on the recording's joint range, the last bin closed."""
    extent = rows.groupBy(RECORDING).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    width = F.col("_high") - F.col("_low")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) * bins / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.join(extent, RECORDING).withColumn("bin", at.cast("long")).groupBy(*UNIT, "bin").agg(F.count("*").alias("n"))


def recording_extent(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(RECORDING).agg(F.min("time").alias("t_first"), F.max("time").alias("t_last"), (F.max(F.abs(value)) * 1.2).alias("limit"))
