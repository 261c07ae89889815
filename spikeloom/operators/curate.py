"""Curation: edits as small label maps joined to assignments (recording_id, spike_id, label)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.operators.model import RECORDING, medians

UNIT = [RECORDING, "label"]


def _top(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy(RECORDING).agg(F.max("label").alias("_top"))


def add_clusters(assignments: DataFrame, new: DataFrame) -> DataFrame:
    """Adds the clusters of `new` (with column `part`): labels follow the highest one, in the order of
    median time; in an empty set the first is 1."""
    times = medians(new, [RECORDING, "part"], into="_t").drop("n")
    rank = F.row_number().over(Window.partitionBy(RECORDING).orderBy("_t", "part"))
    numbered = times.withColumn("_rank", rank).join(_top(assignments), RECORDING, "left")
    labels = numbered.select(RECORDING, "part", (F.coalesce("_top", F.lit(0)) + F.col("_rank")).alias("label"))
    return assignments.unionByName(new.drop("label").join(labels, [RECORDING, "part"]).select(assignments.columns))


def delete_clusters(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    return assignments.join(labels.select(*UNIT).distinct(), UNIT, "left_anti")


def keep_clusters(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    return assignments.join(labels.select(*UNIT).distinct(), UNIT, "left_semi")


def merge_clusters(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """The chosen clusters become one, labelled after the highest of the remaining (1 if none)."""
    chosen = labels.select(*UNIT).distinct().withColumn("_chosen", F.lit(True))
    present = assignments.select(*UNIT).distinct().join(chosen, UNIT, "left")
    new = present.groupBy(RECORDING).agg((F.coalesce(F.max(F.when(F.col("_chosen").isNull(), F.col("label"))), F.lit(0)) + 1).alias("_new"))
    moved = present.filter("_chosen").join(new, RECORDING).select(*UNIT, "_new")
    return assignments.join(moved, UNIT, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def hide_and_reveal(assignments: DataFrame, hidden: DataFrame) -> DataFrame:
    """Clusters hidden and then revealed again: they come back with new labels at the end."""
    away = keep_clusters(assignments, hidden).withColumn("part", F.col("label"))
    return add_clusters(delete_clusters(assignments, hidden), away)


def changed_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Labels in one version only, or with other members; members are compared by a digest that sums up."""

    def digest(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*UNIT).agg(F.struct(F.count("*"), F.bit_xor(F.xxhash64("spike_id"))).alias(name))

    both = digest(old, "o").join(digest(new, "n"), UNIT, "full_outer")
    return both.filter(~F.col("o").eqNullSafe(F.col("n"))).select(*UNIT)


# -- history


def _new_labels(top: int, groups: dict, times: dict[int, float]) -> dict[int, int]:
    """Labels after `top` for groups of pieces, in the order of the median of their pieces' times, then
    of their names: label of each piece."""
    order = sorted(groups, key=lambda g: (float(np.median([times[p] for p in groups[g]])), g))
    return {p: top + 1 + i for i, g in enumerate(order) for p in groups[g]}


def _grouped(labels: dict[int, int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for piece, label in labels.items():
        out.setdefault(label, []).append(piece)
    return out


def fold_edits(first: dict[int, int | None], times: dict[int, float], edits: list[tuple[str, list[int], dict[int, int]]]) -> dict[int, int]:
    """The final label of each piece after a log of edits (action, labels, parts); pieces without one
    are in no cluster.

    A version is a map from pieces to labels, with the map of what is hidden; an edit makes a version
    of the last one, so undo and redo hold for every kind. merge, delete, keep and hide name labels;
    reveal brings back all that is hidden; recluster takes labels and deals their pieces out by
    `parts`, pieces it doesn't name staying together as part -1; add gives pieces that are in no
    cluster, nor hidden, to new clusters by `parts`; restore names the number of a version (0, the
    first, if none). New labels follow the highest, in the order of median time."""
    versions = [({p: x for p, x in first.items() if x is not None}, {})]
    redo: list = []
    for action, chosen, parts in edits:
        now, hidden = versions[-1]
        if action == "undo":
            if len(versions) > 1:
                redo.append(versions.pop())
            continue
        if action == "redo":
            if redo:
                versions.append(redo.pop())
            continue
        redo = []
        kept = {p: x for p, x in now.items() if x not in chosen}
        moved = {p: x for p, x in now.items() if x in chosen}
        top = max(kept.values(), default=0)
        if action == "restore":
            made = versions[min(chosen[0] if chosen else 0, len(versions) - 1)]
        elif action == "delete":
            made = kept, hidden
        elif action == "keep":
            made = moved, hidden
        elif action == "merge":
            made = {**kept, **{p: top + 1 for p in moved}}, hidden
        elif action == "hide":
            made = kept, {**hidden, **moved}
        elif action == "reveal":
            made = {**now, **_new_labels(max(now.values(), default=0), _grouped(hidden), times)}, {}
        elif action == "recluster":
            made = {**kept, **_new_labels(top, _grouped({p: parts.get(p, -1) for p in moved}), times)}, hidden
        elif action == "add":
            free = {p: x for p, x in parts.items() if p in times and p not in now and p not in hidden}
            made = {**now, **_new_labels(max(now.values(), default=0), _grouped(free), times)}, hidden
        else:
            raise ValueError(f"unknown action {action}")
        versions.append(made)
    return versions[-1][0]


def replay(assignments: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies each recording's log of edits (recording_id, seq, action, labels; also parts, an array of
    (piece, part), for recluster and add) to assignments (recording_id, spike_id, time, label).

    What an edit may move apart are pieces: a column `piece` (sub-clusters, say) or, without one,
    labels. Spikes with a null label are in no cluster until an edit adds their piece. The log and the
    pieces of a recording are small; the spikes only meet the resulting map."""
    piece = F.col("piece") if "piece" in assignments.columns else F.col("label")
    placed = assignments.withColumn("_piece", piece.cast("long"))
    times = medians(placed, [RECORDING, "_piece"], into="_t").drop("n")
    pieces = placed.groupBy(RECORDING, "_piece").agg(F.min("label").alias("_label")).join(times, [RECORDING, "_piece"])
    pieces = pieces.groupBy(RECORDING).agg(F.array_sort(F.collect_list(F.struct("_piece", "_label", "_t"))).alias("pieces"))
    parts = F.col("parts") if "parts" in edits.columns else F.lit(None).cast("array<struct<piece:bigint,part:bigint>>")
    logs = edits.withColumn("parts", parts).groupBy(RECORDING).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "labels", "parts"))).alias("log"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for recording, present, log in batch[[RECORDING, "pieces", "log"]].itertuples(index=False):
                first = {int(p["_piece"]): None if p["_label"] is None else int(p["_label"]) for p in present}
                seconds = {int(p["_piece"]): float(p["_t"]) for p in present}
                whole = lambda x: [] if x is None else x
                steps = [(e["action"], [int(x) for x in whole(e["labels"])], {int(x["piece"]): int(x["part"]) for x in whole(e["parts"])}) for e in whole(log)]
                rows += [(recording, p, x) for p, x in fold_edits(first, seconds, steps).items()]
            yield pd.DataFrame(rows, columns=[RECORDING, "_piece", "_new"])

    moved = pieces.join(logs, RECORDING, "left").mapInPandas(fold, f"{RECORDING} string, _piece long, _new long")
    return placed.join(moved, [RECORDING, "_piece"]).withColumn("label", F.col("_new")).drop("_new", "_piece")


# -- tags

TAGS = ("SINGLEUNIT", "MULTIUNIT", "NOISY", "STAR", "AUDITORY", "NONAUDITORY")


def add_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    return tags.unionByName(new).distinct()


def remove_tags(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone, [*UNIT, "tag"], "left_anti")


def tag_sets(assignments: DataFrame, tags: DataFrame) -> DataFrame:
    """The tags of the labels present; a derived cluster has a new label and so has none."""
    present = assignments.select(*UNIT).distinct()
    return present.join(tags, UNIT, "left").groupBy(*UNIT).agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))
