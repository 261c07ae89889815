"""Quality classifier: a generalised additive model with pairwise interactions.

Each text gives a few numbers. Every number is cut into bins, and cyclic boosting learns one lookup
table a number: round after round each takes its turn, a shallow tree over its bins is fitted to
the current gradient, and a small part of it is added to its table. Then the pairs of numbers with
the largest remaining gain get two-dimensional tables the same way. A score is the sum of the
looked-up entries, so scoring is a few vectorised additions by bin.

Labels come only from rows outside the held-out fifth, and at most `TRAIN_ROWS` of them (those with
the smallest hashes of their ids); every document is scored.

Defined results: a null text counts as empty and is scored like any other; texts are taken whole;
repeated rows give repeated results; documents without a label are scored; null labels are left
out, and of several labels of a document the mean decides; of several labelled texts of one id the
one with the smallest measures is learned from; without labels every score is 0.5; a
null id is never held out; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import keyed
from spikeloom.llm.quality_rules import Doc

TRAIN_ROWS = 20_000
BINS, PAIR_BINS = 32, 12
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
RATE = 0.1
THRESHOLD = 0.3

FEATURES = (
    "words", "word_length", "symbols", "bars", "capitals", "exclamations", "digits", "stops", "beyond_ascii",
    "repeated_windows", "same_as_before", "distinct_words", "repeated_lines", "words_a_line", "longest_word",
)


def measures(text: str | None) -> list[float]:
    d = Doc(text)
    w, raw = d.words, d.raw
    n, chars, lines = len(w), max(1, d.get("word_chars")), d.get("n_lines")
    bars = raw.count(b"|")
    letters = d.get("n_capitals") + d.get("n_small")
    return [
        np.log1p(n),
        chars / max(1, n),
        (d.get("n_symbols") - bars) / chars,
        bars / chars,
        d.get("n_capitals") / max(1, letters),
        raw.count(b"!") / chars,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / chars,
        (raw.count(b".") + raw.count(b",")) / max(1, n),
        (len(raw) - len(d.text)) / chars,
        d.get("n_repeat_words") / max(1, n),
        sum(map(bytes.__eq__, w, w[1:])) / max(1, n),
        len(set(w)) / max(1, n),
        d.get("n_dup_lines") / max(1, lines),
        np.log1p(n / max(1, lines)),
        np.log1p(max(map(len, w), default=0)),
    ]


def bin_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(gradient: np.ndarray, hessian: np.ndarray, leaves: int) -> np.ndarray:
    """A tree over ordered bins with so many leaves at most: the value of each bin."""
    value, cuts = np.zeros(len(gradient)), [(0, len(gradient))]
    score = lambda g, h: g * g / (h + 1.0)
    while len(cuts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(cuts):
            if b - a < 2:
                continue
            g, h = np.cumsum(gradient[a:b]), np.cumsum(hessian[a:b])
            gain = score(g[:-1], h[:-1]) + score(g[-1] - g[:-1], h[-1] - h[:-1]) - score(g[-1], h[-1])
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], (k, a + i + 1))
        if best[1] is None:
            break
        k, at = best[1]
        a, b = cuts[k]
        cuts[k : k + 1] = [(a, at), (at, b)]
    for a, b in cuts:
        value[a:b] = gradient[a:b].sum() / (hessian[a:b].sum() + 1.0)
    return value


def _step2(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree over two ordered sets of bins: one cut along the first, then one in each part along
    the second. The value of each cell, and the gain."""
    best, value = 0.0, np.zeros_like(gradient)
    score = lambda g, h: g * g / (h + 1.0)
    for turned in (False, True):
        g, h = (gradient.T, hessian.T) if turned else (gradient, hessian)
        upto_g, upto_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        total = score(upto_g[-1, -1], upto_h[-1, -1])
        for i in range(len(g) - 1):
            parts = []
            for a, b in ((upto_g[i], upto_h[i]), (upto_g[-1] - upto_g[i], upto_h[-1] - upto_h[i])):
                gains = score(a, b) + score(a[-1] - a, b[-1] - b)
                j = int(np.argmax(gains))
                parts.append((float(gains[j]), j))
            gain = parts[0][0] + parts[1][0] - total
            if gain > best + 1e-9:
                best, cells = gain, np.zeros_like(g)
                for rows, (_, j) in ((slice(0, i + 1), parts[0]), (slice(i + 1, None), parts[1])):
                    for columns in (slice(0, j + 1), slice(j + 1, None)):
                        cells[rows, columns] = g[rows, columns].sum() / (h[rows, columns].sum() + 1.0)
                value = cells.T if turned else cells
    return value, best


@dataclass
class AdditiveModel:
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], "right") for a, b, _ in self.pairs for j in (a, b)}
        for a, b, table in self.pairs:
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """The model of rows of measures and their labels, 0 or 1."""
    if len(y) == 0:
        return AdditiveModel()
    base = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(start=float(np.log(base / (1 - base))))
    if y.min() == y.max():
        return model
    total = np.full(len(y), model.start)
    model.edges = [bin_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    slopes = lambda: ((p := 1 / (1 + np.exp(-total))), y - p, p * (1 - p))[1:]
    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables):
            gradient, hessian = slopes()
            step = RATE * _step(np.bincount(b, gradient, len(table)), np.bincount(b, hessian, len(table)), 3)
            table += step
            total += step[b]
    model.pair_edges = [bin_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]

    def grid(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        rows, columns = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        return np.bincount(coarse[a] * columns + coarse[b], weights, rows * columns).reshape(rows, columns)

    gradient, hessian = slopes()
    gains = sorted(((_step2(grid(a, b, gradient), grid(a, b, hessian))[1], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            gradient, hessian = slopes()
            step = RATE * _step2(grid(a, b, gradient), grid(a, b, hessian))[0]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """The model of at most `train_rows` labelled documents outside the held-out fifth."""
    known = keyed(labels, id=doc_id, label=label).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    gauge = F.pandas_udf(lambda texts: pd.Series([measures(t) for t in texts]), "array<double>")
    # the labels are at most train_rows rows of two numbers: small enough to broadcast
    measured = keyed(docs, id=doc_id, text=text).join(F.broadcast(known), "id").select("id", "label", gauge("text").alias("x"))
    rows = measured.groupBy("id", "label").agg(F.min("x").alias("x")).collect()  # one row a label, so train_rows at most
    rows.sort(key=lambda r: (r["id"], r["x"]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows]))


def scorer(model: AdditiveModel):
    """A function from a text column to its score."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([measures(t) for t in texts]).reshape(len(texts), len(FEATURES))))

    return score


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    score = scorer(train(docs, labels, doc_id, text))
    scored = keyed(docs, doc_id=doc_id, text=text).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
