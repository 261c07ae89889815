"""Features, projections, outliers and graph pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.functions import kernels
from spikeloom.operators.held import held
from spikeloom.operators.model import RECORDING


def principal_axes(rows: DataFrame, k: int, vector: str = "waveform", keys: tuple[str, ...] = (RECORDING,)) -> DataFrame:
    """Of each recording (or group of the keys): its first k principal axes, the scores of its mean, and
    the scores' deviations (ddof 1). Its sums are all that moves; signs are fixed by each axis' largest
    loading."""

    @F.pandas_udf("axes array<array<double>>, centre array<double>, deviation array<double>")
    def solve(n: pd.Series, mean: pd.Series, scatter: pd.Series) -> pd.DataFrame:
        out = []
        for count, m, sums in zip(n, mean, scatter):
            value, axes = np.linalg.eigh(np.asarray(sums).reshape(len(m), len(m)))
            value, axes = value[::-1][:k], axes[:, ::-1][:, :k]
            sign = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
            axes = axes * np.where(sign == 0, 1, sign)
            out.append((axes.T.tolist(), (np.asarray(m) @ axes).tolist(), np.sqrt(np.maximum(value, 0) / max(count - 1, 1)).tolist()))
        return pd.DataFrame(out, columns=["axes", "centre", "deviation"])

    return group_statistics(rows, list(keys), vector).select(*keys, solve("n", "mean", "scatter").alias("f")).select(*keys, "f.*")


def principal_scores(rows: DataFrame, k: int, vector: str = "waveform", fit_on: DataFrame | None = None, whiten: bool = False, into: str = "pcs", keys: tuple[str, ...] = (RECORDING,)) -> DataFrame:
    """Centred scores on the first k principal axes of the row's recording (or of its rows in `fit_on`).
    Axes are held, as other small tables by recording are that meet all rows: only a table of known size
    goes to the rows; else a recording's rows would all go to one task."""
    fitted = principal_axes(rows if fit_on is None else fit_on, k, vector, keys)
    fitted = fitted.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("axes", "centre", "deviation")]).transform(held)
    scores = F.zip_with("_axes", "_centre", lambda axis, centre: dot(F.col(vector), axis) - centre)
    if whiten:
        scores = F.zip_with(scores, "_deviation", lambda x, d: x / F.when(d > 0, d).otherwise(1.0))
    return rows.join(fitted, list(keys), "left").withColumn(into, scores).drop("_axes", "_centre", "_deviation")


def vector_zscores(rows: DataFrame, vector: str = "waveform", into: str = "z") -> DataFrame:
    """Each position standardised over its recording by the population deviation; 0 where constant."""
    long = rows.select(RECORDING, F.posexplode(vector).alias("pos", "x"))
    moments = long.groupBy(RECORDING, "pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    moments = moments.groupBy(RECORDING).agg(F.array_sort(F.collect_list(F.struct("pos", "m", "s"))).alias("_moments"))
    z = F.zip_with(vector, F.slice("_moments", 1, F.size(vector)), lambda x, m: F.when(m["s"] > 0, (x - m["m"]) / m["s"]).otherwise(0.0))
    return rows.filter(F.size(vector) > 0).join(moments, RECORDING).select(RECORDING, "spike_id", z.alias(into))


def time_feature(rows: DataFrame, scale: float = 7200.0, into: str = "t") -> DataFrame:
    """time / scale, centred in each recording."""
    means = rows.groupBy(RECORDING).agg(F.avg(F.col("time") / scale).alias("_m")).transform(held)
    return rows.join(means, RECORDING).withColumn(into, F.col("time") / scale - F.col("_m")).drop("_m")


def feature_matrix(rows: DataFrame, k: int = 6, scale: float = 7200.0) -> DataFrame:
    """Standardised principal scores with the time feature, as one array `features`."""
    with_scores = principal_scores(rows, k)
    moments = with_scores.groupBy(RECORDING).agg(*[f(F.col("pcs")[i]).alias(f"_{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).transform(held)
    z = [F.when(F.col(f"_s{i}") > 0, (F.col("pcs")[i] - F.col(f"_m{i}")) / F.col(f"_s{i}")).otherwise(0.0) for i in range(k)]
    joined = time_feature(with_scores, scale).join(moments, RECORDING)
    return joined.withColumn("features", F.array(*z, "t")).drop(*moments.columns[1:], "t", "pcs")


def pca_time(rows: DataFrame, scale: float = 7200.0, k: int = 6) -> DataFrame:
    """The feature matrix turned to its own principal axes."""
    return principal_scores(feature_matrix(rows, k, scale), k, "features")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Groups whose sums a task keeps at once; with 64 samples a group takes 33 KB.
HELD_GROUPS = 1000
STATISTICS = "n long, mean array<double>, scatter array<double>"


def group_statistics(rows: DataFrame, keys: list[str], vector: str = "waveform") -> DataFrame:
    """Count, mean and scatter matrix of each group; partial sums a task, added up by group. A task
    hands on what it holds when it has sums of `HELD_GROUPS` groups."""
    columns = [*keys, vector]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    partial = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, s array<double>, q array<double>"

    def sums(batches):
        held: dict[tuple, list] = {}
        table = lambda: pd.DataFrame([(*key, *parts) for key, parts in held.items()], columns=[*keys, "n", "s", "q"])
        for batch in batches:
            for key, g in batch.groupby(keys, sort=False, dropna=False):
                x = np.stack(g[vector].to_numpy())
                parts = [len(x), x.sum(axis=0), (x.T @ x).ravel()]
                before = held.get(key)
                held[key] = parts if before is None else [a + b for a, b in zip(before, parts)]
            if len(held) >= HELD_GROUPS:
                yield table()
                held = {}
        yield table()

    def total(g: pd.DataFrame) -> pd.DataFrame:
        n, s, q = int(g["n"].sum()), np.stack(g["s"].to_numpy()).sum(axis=0), np.stack(g["q"].to_numpy()).sum(axis=0)
        mean = s / n
        return pd.DataFrame({**{k: [g[k].iat[0]] for k in keys}, "n": [n], "mean": [mean], "scatter": [q - n * np.outer(mean, mean).ravel()]})

    added = rows.select(*columns).mapInPandas(sums, partial)
    return added.groupBy(*keys).applyInPandas(total, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + STATISTICS)


def discriminant_axis(pairs: DataFrame) -> DataFrame:
    """Adds `axis` to rows with the statistics of two groups (mean_a, scatter_a, mean_b, scatter_b)."""

    @F.pandas_udf("array<double>")
    def axis(ma: pd.Series, sa: pd.Series, mb: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([kernels.fisher_axis(np.asarray(a), np.asarray(c), (np.asarray(b) + np.asarray(d)).reshape(len(a), len(a))) for a, b, c, d in zip(ma, sa, mb, sb)])

    return pairs.withColumn("axis", axis("mean_a", "scatter_a", "mean_b", "scatter_b"))


def two_label_view(rows: DataFrame, one: int, two: int) -> DataFrame:
    """Rows relabelled 1, 2 and 3 (other) with a two-dimensional view: discriminant axes if all three
    occur, else principal ones. Axes come from the three sides' statistics, of which alone a recording's
    task sees."""
    marked = rows.withColumn("side", F.when(F.col("label") == one, 1).when(F.col("label") == two, 2).otherwise(3))
    sides = group_statistics(marked, [RECORDING, "side"]).groupBy(RECORDING).agg(F.array_sort(F.collect_list(F.struct("side", "n", "mean", "scatter"))).alias("sides"))

    @F.pandas_udf("axes array<array<double>>, centre array<double>")
    def solve(recordings: pd.Series) -> pd.DataFrame:
        out = []
        for found in recordings:
            n, means = np.array([s["n"] for s in found], "float64"), np.stack([s["mean"] for s in found])
            scatter = sum(np.asarray(s["scatter"]).reshape(means.shape[1], -1) for s in found)
            axes = kernels.group_axes(n, means, scatter, 2)
            out.append((axes.T.tolist(), ((n @ means / n.sum()) @ axes).tolist()))
        return pd.DataFrame(out, columns=["axes", "centre"])

    axes = sides.select(RECORDING, solve("sides").alias("f")).select(RECORDING, "f.*")
    at = lambda i: F.when(F.size("axes") > i, dot(F.col("waveform"), F.get("axes", F.lit(i))) - F.get("centre", F.lit(i))).otherwise(0.0)
    return marked.join(axes, RECORDING).select(RECORDING, "spike_id", "side", at(0).alias("x"), at(1).alias("y"))


def inliers_1d(rows: DataFrame, value: str = "time", limit: float = 2.0, keys: tuple[str, ...] = (RECORDING, "label")) -> DataFrame:
    """Flag of rows within `limit` population deviations of their group's mean; groups of four or fewer
    rows are all inliers."""
    moments = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = F.when(F.col("_s") > 0, F.abs(F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return rows.join(moments, list(keys)).withColumn("inlier", (F.col("_n") <= 4) | (z < limit)).drop("_n", "_m", "_s")


#: Points of a grid cell that a query may meet; of a finer grid's cell in the width, at most so many steps.
CELL_POINTS, STEPS = 64, 12


def closest(points: DataFrame, queries: DataFrame, limit: float = 5.0) -> DataFrame:
    """For each query (recording_id, query_id, qx, qy) its nearest point within the limit, ties to the
    smallest spike_id. Equal points, and equal queries, are one. Both sides meet on grid cells, first on
    cells so narrow that the fullest holds about CELL_POINTS; queries without a point within a cell's
    width go on to cells four times as wide, up to the limit. A query that goes on lies where points are
    rare, so the pairs grow with the queries."""
    distinct = points.groupBy(RECORDING, "x", "y").agg(F.min("spike_id").alias("spike_id")).transform(held)
    same = queries.select(RECORDING, "query_id", "qx", "qy").transform(held)
    asked = same.select(RECORDING, "qx", "qy").distinct().transform(held)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    d = F.sqrt((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2)
    cell = lambda c, width: F.floor(F.col(c) / width)
    width, steps = limit, 0
    while steps < STEPS:
        fullest = distinct.groupBy(RECORDING, cell("x", width), cell("y", width)).count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= CELL_POINTS:
            break
        width, steps = width / 4, steps + 1
    found = []
    for step in range(steps, -1, -1):
        width = limit / 4**step
        spread = asked.withColumn("_i", F.explode(F.transform(around, lambda k: cell("qx", width) + k))).withColumn("_j", F.explode(F.transform(around, lambda k: cell("qy", width) + k)))
        dealt = distinct.withColumn("_i", cell("x", width)).withColumn("_j", cell("y", width))
        met = spread.join(dealt, [RECORDING, "_i", "_j"]).withColumn("distance", d).filter(F.col("distance") < width)
        near = met.groupBy(RECORDING, "qx", "qy").agg(F.min(F.struct("distance", "spike_id")).alias("m")).transform(held)
        found.append(near)
        if step:
            asked = asked.join(near, [RECORDING, "qx", "qy"], "left_anti").transform(held)
            if asked.isEmpty():
                break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return same.join(every, [RECORDING, "qx", "qy"]).select(RECORDING, "query_id", "m.spike_id", "m.distance")


def ks_statistics(values: DataFrame, keys: list[str]) -> DataFrame:
    """The two-sample Kolmogorov-Smirnov statistic of each key's values x with side 1 or 2."""
    by_value = values.groupBy(*keys, "x").agg(F.sum((F.col("side") == 1).cast("long")).alias("a"), F.sum((F.col("side") == 2).cast("long")).alias("b"))
    totals = by_value.groupBy(*keys).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    so_far = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    run = by_value.withColumn("fa", F.sum("a").over(so_far)).withColumn("fb", F.sum("b").over(so_far)).join(totals, keys)
    return run.groupBy(*keys).agg(F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))).alias("ks"))


def k_core(edges: DataFrame, least: int) -> DataFrame:
    """Edges (recording_id, u, v; both directions) left after nodes of degree under `least` are taken
    away again and again."""
    before = None
    while True:
        degree = edges.groupBy(RECORDING, "u").count().filter(F.col("count") >= least)
        strong = degree.select(RECORDING, "u")
        edges = edges.join(strong, [RECORDING, "u"], "left_semi").join(strong.withColumnRenamed("u", "v"), [RECORDING, "v"], "left_semi").select(RECORDING, "u", "v")
        edges = edges.transform(held)
        now = edges.count()
        if now == before:
            return edges
        before = now


def time_vs_axis(rows: DataFrame, groups: DataFrame, background: str = "background") -> DataFrame:
    """(group, time, x) of clusters against a background set, on their discriminant (else first
    principal) axis; groups: recording_id, label, group."""
    named = rows.join(groups, [RECORDING, "label"], "left").withColumn("group", F.coalesce("group", F.lit(background)))
    stats = group_statistics(named.select(RECORDING, (F.col("group") == background).alias("back"), "waveform"), [RECORDING, "back"])
    side = lambda back, tag: stats.filter(F.col("back") == back).select(RECORDING, F.col("mean").alias(f"mean_{tag}"), F.col("scatter").alias(f"scatter_{tag}"))
    axes = discriminant_axis(side(True, "a").join(side(False, "b"), RECORDING)).select(RECORDING, "axis")
    return named.join(axes, RECORDING).select(RECORDING, "group", "spike_id", "time", dot(F.col("waveform"), F.col("axis")).alias("x"))


def project(rows: DataFrame, function, vector: str = "waveform", into: str = "projected") -> DataFrame:
    """A user's NumPy function, from a matrix to a matrix with as many rows, over the vector column."""

    @F.pandas_udf("array<double>")
    def apply(vectors: pd.Series) -> pd.Series:
        out = np.asarray(function(np.stack(vectors.to_numpy())), "float64") if len(vectors) else np.zeros((0, 1))
        return pd.Series(list(out.reshape(len(vectors), -1)))

    return rows.withColumn(into, apply(vector))
