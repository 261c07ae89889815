"""Best-fit packing by a grouping genetic algorithm, distributed as islands.

Documents become token pieces (tokens and a closing id, cut only where longer than a sequence).
Pieces are dealt at random into blocks of bounded size. On each block several islands evolve a
population of packings: crossover injects whole well-filled bins of one parent into another,
removes the bins that then hold a piece twice, and best-fits the displaced pieces, the longest
first; mutation empties the worst-filled bins. After every epoch each island's best packings
migrate to the next island. The best packing of a block is taken. A block wastes less than one
sequence more than its own optimum, so dealing the pieces costs at most one sequence in
`BLOCK_PIECES` pieces, and no task ever holds more than a block.

Defined results: a null text counts as empty and is one piece of length 1 (the closing id); texts
are tokenized whole; repeated rows are packed each for itself; an empty table gives no rows; null
ids are carried through; other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spikeloom.llm.common import Shelf, cut, keyed

SEQUENCE = 2048
CLOSING_ID = 0
BLOCK_PIECES = 6144
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 20
POPULATION = 6
ELITES = 2


class ByteTokenizer:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit integers.

    The rank file holds the same vocabulary, and its encoder is several times faster. Two kinds of
    text are left to the tokenizers library: those with the string of an added token, which it gives,
    and those on which the fast encoder's pattern gives up (runs of about a million white-space
    characters).
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as file:
            table = {base64.b64decode(k): int(v) for k, v in map(bytes.split, file)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> np.ndarray:
        if not any(t in text for t in self.added):
            with contextlib.suppress(ValueError):
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


Vocabulary = tuple[str, str, str]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: Vocabulary) -> ByteTokenizer:
    return ByteTokenizer(*vocabulary)


def default_vocabulary() -> Vocabulary:
    """The tokenizer's file, the same vocabulary as ranks, and its pre-tokenizing pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def cut_pieces(length: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences, but for a shorter first one."""
    first = length % size or min(length, size)
    return [(0, first), *((s, size) for s in range(first, length, size))]


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    vocabulary = vocabulary or default_vocabulary()
    docs = keyed(docs, doc_id=doc_id, text=text)
    closing = np.array([CLOSING_ID], "<u4")

    @F.pandas_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def cut_up(texts: pd.Series) -> pd.Series:
        encode, out = tokenizer(vocabulary).encode, []
        for t in texts:
            ids = np.concatenate([encode(t or ""), closing])
            out.append([(k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_pieces(len(ids), size))])
        return pd.Series(out)

    return docs.select("doc_id", F.inline(cut_up("text")))


# -- packings of one block: an array that gives each piece its bin


def _refit(assign: np.ndarray, fills: list[int], loose: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, list[int]]:
    """Put the loose pieces into the bins, the longest first, each where it leaves least room."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    free = 0  # bit r: some bin has room for exactly r
    for b, f in enumerate(fills):
        r = size - f
        if r:
            room[r].append(b)
            free |= 1 << r
    for i in loose.tolist():
        s = int(sizes[i])
        fitting = free >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free &= ~(1 << r)
            fills[b] += s
        else:
            b, r = len(fills), size
            fills.append(s)
        assign[i] = b
        r -= s
        if r:
            room[r].append(b)
            free |= 1 << r
    return assign, fills


def _packed(assign: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins numbered without gaps, and their fills."""
    _, assign = np.unique(assign, return_inverse=True)
    return assign.astype("int32"), np.bincount(assign, weights=sizes).astype("int64")


def fitness(fills: np.ndarray, size: int) -> tuple[int, float]:
    """Fewer bins are better; of as many, those with fuller ones."""
    return -len(fills), float(np.mean((fills / size) ** 2)) if len(fills) else 0.0


def evolve(sizes: np.ndarray, start: list[np.ndarray], seed: int, size: int = SEQUENCE, generations: int = GENERATIONS, population: int = POPULATION) -> list[np.ndarray]:
    """Packings of the pieces from the best down, evolved from those given."""
    rng = np.random.default_rng(seed)
    n = len(sizes)
    if n == 0:
        return [np.zeros(0, "int32")]
    least = -(-int(sizes.sum()) // size)
    group = []
    for k in range(population):
        if k < len(start):
            assign = start[k]
        else:
            # the first of an island's own is plain best-fit decreasing, the others are shaken
            order = np.argsort(-sizes * (1 + 0.1 * k * rng.random(n)), kind="stable")
            assign, _ = _refit(np.zeros(n, "int32"), [], order, sizes, size)
        assign, fills = _packed(assign, sizes)
        group.append((fitness(fills, size), assign, fills))
    group.sort(key=lambda x: x[0], reverse=True)
    for _ in range(generations):
        if -group[0][0][0] <= least:
            break
        for k in range(population):
            (_, mother, fills), (_, father, from_fills) = group[k], group[int(rng.integers(population))]
            # whole bins of the father, the well-filled ones first, with some chance
            chosen = rng.random(len(from_fills)) < np.where(from_fills >= size - 8, 0.3, 0.05)
            injected = chosen[father]
            hit = np.zeros(len(fills), bool)
            hit[mother[injected]] = True  # bins that would hold a piece twice
            hit |= rng.random(len(fills)) < np.where(fills < np.quantile(fills, 0.03), 0.7, 0.01)
            loose = hit[mother] & ~injected
            kept = ~hit[mother] & ~injected
            child = np.full(n, -1, "int64")
            child[kept] = mother[kept]
            child[injected] = len(fills) + father[injected]
            settled = kept | injected
            _, child[settled] = np.unique(child[settled], return_inverse=True)
            child_fills = np.bincount(child[settled], weights=sizes[settled]).astype("int64").tolist() if settled.any() else []
            order = np.flatnonzero(loose)
            order = order[np.argsort(-sizes[order], kind="stable")]
            child, _ = _refit(child.astype("int32"), child_fills, order, sizes, size)
            child, child_fills = _packed(child, sizes)
            scored = (fitness(child_fills, size), child, child_fills)
            if scored[0] > group[k][0]:
                group[k] = scored
        group.sort(key=lambda x: x[0], reverse=True)
    return [assign for _, assign, _ in group]


STATE = "block long, island int, lengths array<long>, elites array<binary>"


def _evolve_states(states: DataFrame, epoch: int, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            out = []
            for block, island, lengths, elites in batch[["block", "island", "lengths", "elites"]].itertuples(index=False):
                sizes = np.asarray(lengths, "int64")
                start = [np.frombuffer(e, "<i4") for e in ([] if elites is None else elites)]
                seed = (int(block) * 1_000_003 + int(island) * 101 + epoch) % 2**32
                best = evolve(sizes, start, seed, size)[:ELITES]
                out.append((block, island, lengths, [b.astype("<i4").tobytes() for b in best]))
            yield pd.DataFrame(out, columns=["block", "island", "lengths", "elites"])

    return states.mapInPandas(run, STATE)


def pack(found: DataFrame, size: int = SEQUENCE, block_pieces: int = BLOCK_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The pieces' rows with sequence_id and offset; needs a column length of at most `size`."""
    spark = found.sparkSession
    shelf = Shelf(spark)
    rows = shelf.put(found.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") >= size
    blocks = max(1, math.ceil(rows.filter(~whole).count() / block_pieces))
    dealt = rows.filter(~whole).withColumn("_block", F.pmod(F.xxhash64("_item"), F.lit(blocks)))

    lengths = dealt.groupBy(F.col("_block").alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_item", "length"))), lambda x: x["length"]).alias("lengths"))
    states = lengths.select("block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "lengths", F.lit(None).cast("array<binary>").alias("elites"))
    # an island's search is much work on little data: a task each
    states = states.repartition(min(blocks * islands, 4096), "block", "island")
    for epoch in range(epochs):
        states = cut(_evolve_states(states, epoch, size))
        if epoch + 1 < epochs:
            migrants = states.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("elites", 1, 1).alias("came"))
            states = states.join(migrants, ["block", "island"]).select("block", "island", "lengths", F.concat("came", "elites").alias("elites"))
            states = states.repartition(min(blocks * islands, 4096), "block", "island")
    best = states.select(F.col("block").alias("_block"), F.col("elites")[0].alias("elite"))

    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(pieces_of_block: pd.DataFrame, packings: pd.DataFrame) -> pd.DataFrame:
        p = pieces_of_block.sort_values("_item", kind="stable")
        sizes = p["length"].to_numpy("int64")
        options = [np.frombuffer(e, "<i4") for e in packings["elite"]]
        assign = max(options, key=lambda a: fitness(_packed(a, sizes)[1], size))
        p = p.assign(sequence_id=int(p["_block"].iat[0]) * 2 * block_pieces * 4 + assign)
        p = p.sort_values(["sequence_id", "_item"], kind="stable")
        p["offset"] = p.groupby("sequence_id")["length"].cumsum() - p["length"]
        return p[[*names, "sequence_id", "offset"]]

    placed = dealt.groupBy("_block").cogroup(best.groupBy("_block")).applyInPandas(place, schema)
    alone = rows.filter(whole).withColumn("sequence_id", -1 - F.col("_item")).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(alone).drop("_item")


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: Vocabulary | None = None, size: int = SEQUENCE) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return pack(pieces(docs, doc_id, text, vocabulary, size), size)
