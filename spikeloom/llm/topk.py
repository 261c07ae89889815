"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector is cut into segments at several resolutions; of each segment only the mean and the
deviation are kept. With them |q - x|^2 has a lower bound (per segment, length times the squared
differences of means and of deviations), and so q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 has an upper
one: the sum of length * (mean * mean + deviation * deviation). From coarse to fine, pairs whose
bound is below the query's k-th best score so far are dropped; exact products are computed for the
survivors alone. Nothing is approximate: a dropped pair cannot be among the best.

Vectors are ordered by their coarse statistics, so that a block of neighbours has narrow ones. All
queries first meet one pilot block, the one of the greatest norms; its k-th best scores are floors
that every later task shares. Of every other block a summary is broadcast to the queries: the range
of each segment's mean, and its greatest deviation. A query is sent to a block only if the bound
from that summary reaches its floor. What a task finds is each query's few best of a block, and
these meet in one ranking.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do
rows with a null id; vectors are compared with those of the same length only (empty ones score 0);
rows that share an id are candidates each for itself, but none of them for a query of that id, and
queries that share an id are ranked as one; ties go to the smaller id; scores outside the range of a
long are clipped to it; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.llm.common import Shelf, cut, keyed

K = 5
SCALE = 256
SEGMENTS = (1, 4, 16)
#: Rows of a block of candidates, and queries that meet it at a time.
BLOCK = 8192
STRIP = 512
#: Summaries of so many blocks at most are broadcast (some hundred bytes each); with more, a block
#: holds more vectors.
MAX_BLOCKS = 20_000
LONG = np.iinfo("int64")

PACKED = "block long, width int, ids binary, vectors binary, summary array<double>"
PAIR = "query_id long, vec_id long, score long"


def quantized(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * flat.astype("float64"))


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, weighted so that a product of two rows is the bound."""
    if vectors.shape[1] == 0:
        return np.zeros((len(vectors), 1))
    parts = []
    for s in np.array_split(np.arange(vectors.shape[1]), min(segments, vectors.shape[1])):
        weight = math.sqrt(len(s))
        parts += [vectors[:, s].mean(axis=1) * weight, vectors[:, s].std(axis=1) * weight]
    return np.stack(parts, axis=1)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of rows in pairs."""
    if queries.size == 0:
        return np.zeros(len(queries), "int64")
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", queries, vectors).astype("int64")
    exact = [sum(int(a) * int(b) for a, b in zip(q, v)) for q, v in zip(queries, vectors)]
    return np.array([min(max(x, LONG.min), LONG.max) for x in exact], "int64")


def summary(vectors: np.ndarray) -> np.ndarray:
    """Of a block: the least and greatest mean and the greatest deviation of each finest segment, weighted."""
    parts = statistics(vectors, SEGMENTS[-1])
    means, deviations = parts[:, 0::2], parts[:, 1::2]
    if not deviations.shape[1]:
        return np.zeros(0)
    return np.concatenate([means.min(axis=0), means.max(axis=0), deviations.max(axis=0)])


def bound_of_block(queries: np.ndarray, of: np.ndarray) -> np.ndarray:
    """An upper bound of the queries' products with all vectors of the block with this summary."""
    if not len(of):
        return np.zeros(len(queries))
    parts = statistics(queries, SEGMENTS[-1])
    low, high, deviation = np.split(of, 3)
    return np.maximum(parts[:, 0::2] * low, parts[:, 0::2] * high).sum(axis=1) + parts[:, 1::2] @ deviation


def slack(queries: np.ndarray, longest: float) -> np.ndarray:
    """What rounding may take from a bound."""
    return 0.5 + 1e-9 * np.sqrt((queries**2).sum(axis=1)) * longest


def best_of_block(ids: np.ndarray, queries: np.ndarray, to_ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of each query's k best in the block, if not below its floor."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    levels = [statistics(vectors, s) for s in SEGMENTS]
    longest = np.sqrt((vectors**2).sum(axis=1).max(initial=0.0))
    exact_as_float = max(np.abs(queries).max(initial=0.0), 1.0) * max(np.abs(vectors).max(initial=0.0), 1.0) * max(queries.shape[1], 1) < 2.0**53
    for at in range(0, len(ids), STRIP):
        q = queries[at : at + STRIP]
        least = floor[at : at + STRIP].astype("float64")
        least[floor[at : at + STRIP] == LONG.min] = -np.inf  # no floor yet: scores below any long count too
        least -= slack(q, longest)
        alive = np.ones((len(q), len(to_ids)), bool)
        for s, level in zip(SEGMENTS, levels):
            alive &= statistics(q, s) @ level.T >= least[:, None]
            if not alive.any():
                break
        alive &= ids[at : at + STRIP, None] != to_ids[None, :]
        if exact_as_float and alive.mean() > 0.05:  # many survivors: one product of matrices costs less than picking them
            scores = np.where(alive, q @ vectors.T, -np.inf)
            few = min(k, scores.shape[1])
            # all that reach the k-th best score, so that ties are settled by id later
            worst = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few]
            r, c = np.nonzero((scores >= np.maximum(worst, least)[:, None]) & alive)
            found.append((r + at, c, scores[r, c].astype("int64")))
            continue
        rows, columns = np.nonzero(alive)
        for part in range(0, len(rows), 1 << 16):
            r, c = rows[part : part + (1 << 16)], columns[part : part + (1 << 16)]
            score = products(q[r], vectors[c])
            enough = score >= least[r]
            found.append((r[enough] + at, c[enough], score[enough]))
    if not found:
        return (np.zeros(0, "int64"),) * 3
    rows, columns, scores = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((to_ids[columns], ~scores, rows))  # ~ turns the order of longs around, the least one too
    rows, columns, scores = rows[order], columns[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    return rows[keep], columns[keep], scores[keep]


# -- the jobs


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<f8").reshape(len(ids), row["width"])


def _pack(block_rows: int):
    """Rows of one partition, as they come, in blocks of one vector length."""

    def packed(block: int, width: int, ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        values = [[block], [width], [ids.astype("<i8").tobytes()], [vectors.astype("<f8").tobytes()], [summary(vectors).tolist()]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
        names = ["block", "width", "ids", "vectors", "summary"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

    def pack(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            widths, ids, lists = batch.column("width").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy(), batch.column("vector")
            for width in np.unique(widths).tolist():
                of = np.flatnonzero(widths == width)
                flat = lists.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False)
                held = waiting.setdefault(width, [])
                held.append((ids[of], quantized(flat).reshape(len(of), width)))
                if sum(len(i) for i, _ in held) >= block_rows:
                    all_ids, all_vectors = (np.concatenate(x) for x in zip(*waiting.pop(width)))
                    for at in range(0, len(all_ids), block_rows):
                        yield packed(number, width, all_ids[at : at + block_rows], all_vectors[at : at + block_rows])
                        number += 1
        for width, held in waiting.items():
            all_ids, all_vectors = (np.concatenate(x) for x in zip(*held))
            yield packed(number, width, all_ids, all_vectors)
            number += 1

    return pack


def _floors(pilots: dict[int, tuple[np.ndarray, np.ndarray]], k: int):
    """Each query's k-th best score in the pilot block of its length."""

    def floors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, queries = _unpacked(row)
                to_ids, vectors = pilots[row["width"]]
                floor = np.full(len(ids), LONG.min)
                rows, _, scores = best_of_block(ids, queries, to_ids, vectors, floor, k)
                last = np.flatnonzero(np.r_[rows[1:] != rows[:-1], True]) if len(rows) else np.zeros(0, "int64")
                enough = np.bincount(rows, minlength=len(ids))[rows[last]] >= k if len(rows) else last
                floor[rows[last][enough]] = scores[last][enough]
                values = [pa.array([row["width"]], pa.int32()), *[pa.array([v]) for v in (row["ids"], row["vectors"], floor.astype("<i8").tobytes())]]
                yield pa.RecordBatch.from_arrays(values, ["width", "ids", "vectors", "floors"])

    return floors


def _asks(blocks: list[tuple[int, int, np.ndarray]]):
    """The queries of a block that may find something in each block of candidates."""

    def asks(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, queries = _unpacked(row)
                floor = np.frombuffer(row["floors"], "<i8")
                for block, width, of in blocks:
                    if width != row["width"]:
                        continue
                    longest = float(np.sqrt((np.maximum(of[: len(of) // 3] ** 2, of[len(of) // 3 : 2 * len(of) // 3] ** 2) + of[2 * len(of) // 3 :] ** 2).sum()))
                    may = (floor == LONG.min) | (bound_of_block(queries, of) >= floor.astype("float64") - slack(queries, longest))
                    if may.any():
                        values = (block, ids[may].astype("<i8").tobytes(), queries[may].astype("<f8").tobytes(), floor[may].tobytes())
                        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["block", "q_ids", "q_vectors", "floors"])

    return asks


def _search(k: int):
    def search(batches):
        for batch in batches:
            for row in batch.to_pylist():
                to_ids, vectors = _unpacked(row)
                ids = np.frombuffer(row["q_ids"], "<i8")
                queries = np.frombuffer(row["q_vectors"], "<f8").reshape(len(ids), row["width"])
                rows, columns, scores = best_of_block(ids, queries, to_ids, vectors, np.frombuffer(row["floors"], "<i8"), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(to_ids[columns]), pa.array(scores)], ["query_id", "vec_id", "score"])

    return search


def search_exact(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best; is_query is a condition on `vec_id`."""
    spark = vectors.sparkSession
    shelf = Shelf(spark)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = keyed(vectors, vec_id=vec_id, vector=vector).filter(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite)
    size = F.size("vector")
    # the order of blocks: length, norm in coarse steps, means of quarters; the id splits equal vectors
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
    quarters = [F.aggregate(F.slice("vector", F.floor(size * i / 4).cast("int") + 1, F.greatest(F.ceil(size / 4).cast("int"), F.lit(0))), F.lit(0.0), lambda t, x: t + x.cast("double")) for i in range(4)]
    rows = rows.select("vec_id", "vector", size.alias("width"), F.round(F.log2(norm + 1e-9)).alias("norm"), F.array(*[F.signum(x) for x in quarters]).alias("signs"))
    n = rows.count()
    block_rows = max(BLOCK, math.ceil(n / MAX_BLOCKS))
    batch_rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_rows)

    def ordered(some: DataFrame, count: int) -> DataFrame:
        parts = some.repartitionByRange(max(1, math.ceil(count / block_rows)), "width", "norm", "signs", F.xxhash64("vec_id"))
        return parts.select("vec_id", "vector", "width").mapInArrow(_pack(block_rows), PACKED)

    try:
        spark.conf.set(batch_rows, "1024")
        blocks = shelf.put(ordered(rows, n), "blocks")
        asking = shelf.put(ordered(rows.filter(is_query), max(1, rows.filter(is_query).count())), "asking")
        spark.conf.set(batch_rows, "4")  # from here on a row is a packed block, some MB
        known = [(r["block"], r["width"], np.array(r["summary"])) for r in blocks.select("block", "width", "summary").collect()]  # MAX_BLOCKS or little more
        longest: dict[int, tuple[float, int]] = {}
        for block, width, of in known:
            reach = float(np.abs(of).max(initial=0.0))
            longest[width] = max(longest.get(width, (-1.0, 0)), (reach, block))
        chosen = [block for _, block in longest.values()]
        pilots = {r["width"]: _unpacked(r.asDict()) for r in blocks.filter(F.col("block").isin(chosen)).collect()}  # one block a length
        floored = shelf.put(asking.mapInArrow(_floors(pilots, k), "width int, ids binary, vectors binary, floors binary"), "floored")
        asked = shelf.put(floored.mapInArrow(_asks(known), "block long, q_ids binary, q_vectors binary, floors binary"), "asked")
        pairs = asked.join(blocks.drop("summary"), "block")
        best = cut(pairs.select("width", "ids", "vectors", "q_ids", "q_vectors", "floors").mapInArrow(_search(k), PAIR))
    finally:
        spark.conf.set(batch_rows, before)
    for name in ("blocks", "asking", "floored", "asked"):
        shelf.drop(name)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
