"""Time windows, row windows and inter-spike intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RECORDING = "recording_id"


def duration_windows(spikes: DataFrame, dt: float) -> DataFrame:
    """Half-open windows [i*dt, i*dt + dt) from 0 to the last spike, empty ones too: one row a window.

    Spikes before 0 belong to none, nor does a last spike exactly on the last border. The quotient
    only proposes a window; its neighbours are tried against the borders as computed, so that
    rounding at a border decides as the borders do.
    """
    spine = spikes.groupBy(RECORDING).agg(F.max("time").alias("last")).select(RECORDING, F.ceil(F.col("last") / dt).alias("n"))
    spine = spine.filter("n > 0").select(RECORDING, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("window_idx"))
    held = in_windows(spikes, dt).groupBy(RECORDING, "window_idx").agg(F.count("*").alias("n"))
    start = F.col("window_idx") * F.lit(dt)
    joined = spine.join(held, [RECORDING, "window_idx"], "left")
    return joined.select(RECORDING, "window_idx", start.alias("start"), (start + dt).alias("stop"), F.coalesce("n", F.lit(0)).alias("n"))


def in_windows(spikes: DataFrame, dt: float) -> DataFrame:
    """Spikes from 0 on with the window whose borders, as computed, hold them."""
    guess = F.floor(F.col("time") / dt)
    tried = spikes.filter("time >= 0").withColumn("window_idx", F.explode(F.array(guess - 1, guess, guess + 1)))
    start = F.col("window_idx") * F.lit(dt)
    return tried.filter((F.col("time") >= start) & (F.col("time") < start + dt))


def row_windows(spikes: DataFrame, rows: int = 2000) -> DataFrame:
    """Windows of so many consecutive spikes, the last one short: first and after-last position, times."""
    windowed = spikes.withColumn("window_idx", F.floor(F.col("spike_id") / rows))
    return windowed.groupBy(RECORDING, "window_idx").agg(
        F.min("spike_id").alias("first"), (F.max("spike_id") + 1).alias("stop"), F.min("time").alias("t_first"), F.max("time").alias("t_last")
    )


def trailing_windows(spikes: DataFrame, dt: float, lags: int) -> DataFrame:
    """Frames: frame f shows the windows f, f-1, ... f-lags+1 of each label; counts by lag."""
    frames = duration_windows(spikes, dt).groupBy(RECORDING).agg(F.count("*").alias("frames"))
    held = in_windows(spikes, dt).groupBy(RECORDING, "window_idx", "label").agg(F.count("*").alias("n"))
    shown = held.withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1)))).join(frames, RECORDING)
    return shown.withColumn("frame", F.col("window_idx") + F.col("lag")).filter("window_idx < frames AND frame < frames").select(RECORDING, "frame", "lag", "label", "n")


def with_previous(spikes: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Spikes with `_previous`, time and label of the spike before of the same keys. A task orders the
    spikes of `width` seconds of a key; the first of these takes over the last of the range before."""
    spike = F.struct("time", "label")
    dealt = spikes.withColumn("_range", F.floor(F.col("time") / width))
    ends = dealt.groupBy(*keys, "_range").agg(F.max_by(spike, F.struct("time", "spike_id")).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))).drop("_last")
    carried = carried.select(*[F.col(c).alias(f"_of_{c}") for c in (*keys, "_range")], "_carried")
    inside = Window.partitionBy(*keys, "_range").orderBy("time", "spike_id")
    met = dealt.withColumn("_inside", F.lag(spike).over(inside)).join(carried, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*keys, "_range")])
    return met.withColumn("_previous", F.coalesce("_inside", "_carried")).drop("_range", "_inside", *carried.columns)


def intervals(spikes: DataFrame, by_label: bool = True, width: float | None = None) -> DataFrame:
    """Each spike with the time since the one before, of its label or of the whole recording. With a
    width, no task orders more than a range of so many seconds: for trains too long for one task."""
    keys = [RECORDING, *(["label"] if by_label else [])]
    if width:
        return with_previous(spikes, keys, width).withColumn("isi", F.col("time") - F.col("_previous.time")).drop("_previous")
    return spikes.withColumn("isi", F.col("time") - F.lag("time").over(Window.partitionBy(*keys).orderBy("time", "spike_id")))


def marked_intervals(spikes: DataFrame, width: float = 3600.0) -> DataFrame:
    """Intervals of the merged train, each within one label or across two; ordered by ranges of `width`
    seconds, since a merged train may be a large part of all spikes."""
    marked = with_previous(spikes, [RECORDING], width).withColumn("isi", F.col("time") - F.col("_previous.time"))
    return marked.withColumn("across", F.col("_previous.label") != F.col("label")).drop("_previous").filter(F.col("isi").isNotNull())
