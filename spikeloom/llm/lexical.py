"""Ranked lexical search, score at a time over impact-ordered postings.

The index is a table with one row for each block of documents: their ids and lengths, and for every
term its postings (document's place in the block, occurrences). Blocks are filled where documents
are read, to a bounded number of postings, so building the index moves no row; the corpus' counts
(documents, terms, a term's documents) are sums over it.

A search takes all its queries to every block, in groups of bounded size. In a block each term's
postings are ordered by their exact impact, the highest first, and equal impacts form a group. A
query walks the groups of all its terms in descending order of weighted impact, level by level,
adding to one sum a document. After each level, what a document may still gain is bounded by the
next group of each term. The walk stops only when no document can reach the query's k-th best sum
(or a floor from blocks searched before) that hasn't reached it within that bound; the few that can
are the candidates, and their scores are completed from the postings not yet walked. So the result is
exact. A share of the blocks is searched first; its k-th best scores are the floors of the others.

Defined results: a null text has no terms; a document or query without terms gets no rank; rows that
share an id are documents (or queries) each for itself; equal scores are ranked by ascending id,
null ids last; a text of any length is one document; an empty table gives no rows; other columns are
ignored. Scores are exact 64-bit integers.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spikeloom.llm.common import Shelf, keyed

K = 20
#: For each byte of a text in UTF-8: letters and digits of ASCII stay (A-Z in lower case), and so does
#: whatever is beyond ASCII; all else separates terms.
TERM_BYTES = bytes(b if chr(b).isdigit() or chr(b).islower() or b >= 0x80 else b + 32 if chr(b).isupper() else 0x20 for b in range(128)) + bytes(range(128, 256))
#: Postings and documents of a block, at most (a longer document is a block of its own).
BLOCK_POSTINGS = 1 << 20
BLOCK_DOCUMENTS = 16_384
#: Characters of the queries that a task holds at once; more queries are searched in groups.
QUERY_CHARS = 4 << 20
#: One in so many blocks is searched first.
PILOT = 16
#: Times the cost of walking a posting that looking one up takes, about.
LOOK_UP = 4

#: A row of the index is a block of some MB. Sizes are looked at after each row (not after a hundred) and a row
#: group is about one block: a task holds that many blocks when it writes or reads, whatever the size of its file.
ROW_GROUPS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}

BLOCKS = "ids array<long>, sizes array<int>, terms array<string>, ends array<int>, docs array<int>, tfs array<int>"
HIT = "query int, doc_id long, score long"

# the score: w * ((SCALE * tf) div (1000 * tf + 12 * m)), m = 100 - 25 + ((25 * n * N) div L)
SCALE, TF, LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 12, 75, 25


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TERM_BYTES).split()


# -- the index


class Numbers(dict):
    """Numbers of terms in the order in which they are first seen."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n


class Block:
    """Documents and postings while a block is filled."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.numbers = Numbers()
        self.terms, self.docs, self.tfs = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, size: int, counts: Counter) -> None:
        self.terms.extend(map(self.numbers.__getitem__, counts))
        self.tfs.extend(counts.values())
        self.docs.extend([len(self.ids)] * len(counts))
        self.ids.append(doc_id)
        self.sizes.append(size)

    def row(self) -> pd.DataFrame:
        """Documents are numbered by ascending id, nulls last: the order of ties."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), "int32")
        place[order] = np.arange(len(order))
        terms = np.frombuffer(self.terms, "int32")
        docs = place[np.frombuffer(self.docs, "int32")]
        by_term = np.lexsort((docs, terms))
        ends = np.cumsum(np.bincount(terms, minlength=len(self.numbers)), dtype="int32")
        names = b" ".join(self.numbers).decode("utf-8", "surrogatepass").split(" ")
        row = [self.ids[i] for i in order], [self.sizes[i] for i in order], names, ends, docs[by_term], np.frombuffer(self.tfs, "int32")[by_term]
        return pd.DataFrame([row], columns=["ids", "sizes", "terms", "ends", "docs", "tfs"])


def index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents with at least one term, and their postings."""

    def fill(batches):
        block = Block()
        for batch in batches:
            for d, t in zip(batch["doc_id"].astype(object), batch["text"]):
                words = terms_of(t)
                if not words:
                    continue
                counts = Counter(words)
                if block.ids and (len(block.terms) + len(counts) > BLOCK_POSTINGS or len(block.ids) >= BLOCK_DOCUMENTS):
                    yield block.row()
                    block = Block()
                block.add(None if pd.isna(d) else int(d), len(words), counts)
        if block.ids:
            yield block.row()

    return keyed(docs, doc_id=doc_id, text=text).mapInPandas(fill, BLOCKS)


def document_counts(blocks: DataFrame) -> DataFrame:
    """term and df, in how many documents it occurs."""
    spans = F.arrays_zip("terms", F.zip_with("ends", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0)))), lambda a, b: a - b).alias("df"))
    return blocks.select(F.explode(spans).alias("s")).groupBy(F.col("s.terms").alias("term")).agg(F.sum("s.df").alias("df"))


def corpus_counts(blocks: DataFrame) -> tuple[int, int]:
    """Documents with terms, and all their terms."""
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)
    row = blocks.agg(F.sum(F.size("ids")), F.sum(total)).first()
    return int(row[0] or 0), int(row[1] or 0)


# -- the search in one block


class Impacts:
    """A block's postings by term, ordered by impact, with the groups of equal impact."""

    def __init__(self, sizes: np.ndarray, terms: list[str], ends: np.ndarray, docs: np.ndarray, tfs: np.ndarray, n_docs: int, n_terms: int):
        self.n = len(sizes)
        m = FLAT + (SLOPE * sizes.astype("int64") * n_docs) // n_terms
        self.at = {t: i for i, t in enumerate(terms)}
        self.ends = np.concatenate([[0], ends])
        self.docs, self.tfs, self.m = docs, tfs.astype("int64"), m
        self.sorted: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, term: str):
        """Impacts in descending order and their documents; the groups' impacts and ends; documents by place with impacts."""
        if term not in self.sorted:
            i = self.at[term]
            docs, tf = self.docs[self.ends[i] : self.ends[i + 1]], self.tfs[self.ends[i] : self.ends[i + 1]]
            impact = (SCALE * tf) // (TF * tf + LENGTH * self.m[docs])
            order = np.argsort(-impact, kind="stable")
            down = impact[order]
            ends = np.append(np.flatnonzero(np.diff(down)) + 1, len(down))
            self.sorted[term] = (down, docs[order], down[ends - 1], ends, (docs, impact))
        return self.sorted[term]


def best_of_block(block: Impacts, query: list[tuple[str, int]], floor: int, k: int, work: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the query's k best documents of the block with a score above 0 and of at least the floor.

    query: terms with the weight times the number of occurrences. work, if given, gets the postings
    walked and all postings of the query's terms."""
    lists = [(w, *block.of(t)) for t, w in query if t in block.at and w > 0]
    if not lists:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    sums = np.zeros(block.n, "int64")
    done = [0] * len(lists)  # groups walked
    least = max(floor, 1)
    level = max(w * int(groups[0]) for w, _, _, groups, _, _ in lists)
    while True:
        level = level * 7 // 10
        for i, (w, impacts, docs, groups, ends, _) in enumerate(lists):
            to = int(np.searchsorted(-groups, -(level / w), "right"))
            if to > done[i]:
                a, b = (int(ends[done[i] - 1]) if done[i] else 0), int(ends[to - 1])
                sums[docs[a:b]] += w * impacts[a:b]  # a document occurs once in a term's postings
                done[i] = to
        rest = sum(w * int(groups[d]) for (w, _, _, groups, _, _), d in zip(lists, done) if d < len(groups))
        if rest == 0:
            candidates = np.flatnonzero(sums >= least)
            break
        best = max(least, int(np.partition(sums, block.n - k)[block.n - k])) if block.n > k else least
        if rest < best:  # so no document that hasn't been met yet, with a sum of 0, can be among the best
            candidates = np.flatnonzero(sums + rest >= best)
            # looking candidates up must cost less than to walk on
            left = sum(len(docs) - (int(ends[d - 1]) if d else 0) for (_, _, docs, _, ends, _), d in zip(lists, done))
            if LOOK_UP * len(candidates) * sum(d < len(groups) for (_, _, _, groups, _, _), d in zip(lists, done)) <= left:
                break
    if work is not None:
        work[0] += sum(int(ends[d - 1]) if d else 0 for (_, _, _, _, ends, _), d in zip(lists, done))
        work[1] += sum(len(docs) for _, _, docs, _, _, _ in lists)
    scores = sums[candidates]
    for (w, _, _, groups, _, (docs, impact)), d in zip(lists, done):
        if d < len(groups) and len(candidates):
            i = np.minimum(np.searchsorted(docs, candidates), len(docs) - 1)
            there = (docs[i] == candidates) & (impact[i] < groups[d - 1] if d else True)
            scores = scores + np.where(there, w * impact[i], 0)
    kept = scores >= least
    candidates, scores = candidates[kept], scores[kept]
    order = np.lexsort((candidates, -scores))[:k]
    return candidates[order], scores[order]


# -- the operator


def _hits(blocks: DataFrame, queries: list[list[tuple[str, int]]], floors: list[int], counts: tuple[int, int], k: int) -> DataFrame:
    """Each query's k best of every block, if not below its floor."""

    def find(batches):
        for batch in batches:
            for ids, sizes, terms, ends, docs, tfs in batch[["ids", "sizes", "terms", "ends", "docs", "tfs"]].itertuples(index=False):
                block, out = Impacts(np.asarray(sizes), list(terms), np.asarray(ends), np.asarray(docs), np.asarray(tfs), *counts), []
                for q, query in enumerate(queries):
                    places, scores = best_of_block(block, query, floors[q], k)
                    out += [(q, None if ids[p] is None or np.isnan(ids[p]) else int(ids[p]), int(s)) for p, s in zip(places.tolist(), scores.tolist())]
                yield pd.DataFrame(out, columns=["query", "doc_id", "score"]).astype({"query": "int32", "doc_id": "Int64", "score": "int64"})

    return blocks.select("ids", "sizes", "terms", "ends", "docs", "tfs").mapInPandas(find, HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_index(blocks: DataFrame, items: DataFrame, item_id: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents of an index."""
    spark = blocks.sparkSession
    shelf = Shelf(spark)

    @F.pandas_udf("array<struct<term:string,times:int>>")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series([[(w.decode("utf-8", "surrogatepass"), n) for w, n in Counter(terms_of(t)).items()] for t in texts])

    asked = keyed(items, item_id=item_id, text=text).withColumn("query", F.monotonically_increasing_id())
    asked = shelf.put(asked.select("query", "item_id", F.length("text").alias("chars"), counted("text").alias("words")), "queries")
    n_docs, n_terms = corpus_counts(blocks)
    if not n_terms:
        return _empty(spark, asked)
    words = asked.select("query", F.inline("words"))
    known = document_counts(blocks).join(words.select("term").distinct(), "term")
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    weighed = shelf.put(words.join(known, "term").select("query", "term", (weight * F.col("times")).alias("w")), "words")
    # of words: about 16 bytes each in a task besides their characters
    groups = max(1, math.ceil((asked.agg(F.sum("chars")).first()[0] or 0) / QUERY_CHARS))
    out = None
    for g in range(groups):
        in_group = F.pmod(F.xxhash64("query"), F.lit(groups)) == g
        rows = weighed.filter(in_group).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("words")).collect()
        queries = [[(x["term"], x["w"]) for x in r["words"]] for r in rows]
        names = spark.createDataFrame([(i, r["query"]) for i, r in enumerate(rows)], "query int, item long")
        pilot = F.pmod(F.xxhash64("ids"), F.lit(PILOT)) == 0
        first = shelf.put(_ranked(_hits(blocks.filter(pilot), queries, [1] * len(queries), (n_docs, n_terms), k), k).drop("rank"), f"pilot{g}")
        floors = [1] * len(queries)
        for r in first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).collect():
            floors[r["query"]] = r["score"]
        others = _hits(blocks.filter(~pilot), queries, floors, (n_docs, n_terms), k)
        ranked = _ranked(first.unionByName(others), k).join(F.broadcast(names), "query").select("item", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out.join(asked.select(F.col("query").alias("item"), "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _empty(spark, asked: DataFrame) -> DataFrame:
    return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K) -> DataFrame:
    """Indexes the documents and ranks them for each item."""
    blocks = Shelf(docs.sparkSession).put(index(docs, doc_id, text), "index", **ROW_GROUPS)
    return search_index(blocks, items, item_id, item_text, k)
