"""Random logs of edits against a model that keeps a snapshot of every version, spike by spike."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from spikeloom.operators import curate

PIECES = 8
labels = st.lists(st.integers(0, 12), max_size=3)
edit = st.one_of(
    st.tuples(st.sampled_from(["merge", "delete", "keep", "hide", "recluster"]), labels),
    st.tuples(st.sampled_from(["undo", "undo", "redo", "reveal", "add", "restore"]), st.just([])),
)


def snapshots(first, times, log):
    """Clusters as sets of pieces under labels; every version is a whole copy."""

    def added(clusters, new):
        top = max(clusters, default=0)
        new = sorted(new, key=lambda c: (float(np.median([times[p] for p in c[1]])), c[0]))
        return {**clusters, **{top + 1 + i: members for i, (_, members) in enumerate(new)}}

    start = {}
    for piece, label in first.items():
        if label is not None:
            start[label] = start.get(label, frozenset()) | {piece}
    stack, redo = [(start, [])], []
    for action, chosen, parts in log:
        clusters, hidden = stack[-1]
        taken = {x: m for x, m in clusters.items() if x in chosen}
        rest = {x: m for x, m in clusters.items() if x not in chosen}
        everything = frozenset().union(*taken.values()) if taken else frozenset()
        if action == "undo":
            if len(stack) > 1:
                redo.append(stack.pop())
            continue
        if action == "redo":
            if redo:
                stack.append(redo.pop())
            continue
        redo = []
        if action == "merge":
            new = added(rest, [(0, everything)]) if taken else rest, hidden
        elif action == "delete":
            new = rest, hidden
        elif action == "keep":
            new = taken, hidden
        elif action == "hide":
            new = rest, [*hidden, *taken.items()]
        elif action == "reveal":
            # clusters hidden under one label, one after the other, are one cluster again
            by_label = {}
            for x, m in hidden:
                by_label[x] = by_label.get(x, frozenset()) | m
            new = added(clusters, list(by_label.items())), []
        elif action == "restore":
            new = stack[0]
        else:
            free = frozenset(times) - frozenset().union(*clusters.values(), *[m for _, m in hidden]) if action == "add" else everything
            groups = {}
            for p in free:
                groups[parts[p]] = groups.get(parts[p], frozenset()) | {p}
            new = added(clusters if action == "add" else rest, list(groups.items())), hidden
        stack.append(new)
    return {p: x for x, members in stack[-1][0].items() for p in members}


@given(st.lists(edit, max_size=14), st.lists(st.one_of(st.none(), st.integers(0, 4)), min_size=PIECES, max_size=PIECES), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_logs_are_those_of_snapshots(log, start, random):
    times = {p: float(random.randint(0, 5)) for p in range(PIECES)}
    parts = {p: random.randint(0, 2) for p in range(PIECES)}
    steps = [(a, x, parts) for a, x in log]
    first = dict(enumerate(start))
    assert curate.fold_edits(first, times, steps) == snapshots(first, times, steps)


def test_spikes_follow_their_pieces(spark):
    rows = [("r", i, float(i), i // 4 if i < 12 else None, i // 2) for i in range(16)]
    spikes = spark.createDataFrame(rows, "recording_id string, spike_id long, time double, label long, piece long")
    every = [(p, p % 2) for p in range(8)]
    log = [("r", 0, "recluster", [0], every), ("r", 1, "undo", None, None), ("r", 2, "redo", None, None), ("r", 3, "add", None, every)]
    edits = spark.createDataFrame(log, "recording_id string, seq long, action string, labels array<long>, parts array<struct<piece:long,part:long>>")
    got = {r.spike_id: r.label for r in curate.replay(spikes, edits).collect()}
    assert got == {0: 3, 1: 3, 2: 4, 3: 4, **{i: i // 4 for i in range(4, 12)}, 12: 5, 13: 5, 14: 6, 15: 6}
