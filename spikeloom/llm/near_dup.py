"""Near-duplicate documents by bottom-k sketches from one hash function.

Every shingle is hashed once; a document's sketch is its `SKETCH` smallest hashes. Documents with
equal shingle sets are one class from then on. Inverted lists of the retained values generate the
overlaps:

* a value that few classes retain (at most `RARE`) gives all pairs of its list; of a sketch the
  first `PROBES` such values are listed;
* values that many classes retain would give quadratic lists. They matter only to classes that
  consist of them mostly, for at a similarity of s a class whose other values are more than 1 - s
  of it shares some of those too (classes with many common values list all their others). Of each
  such list every member is paired with three hubs; after the first components are known, what a
  list still has outside its hub's component is compared with the whole list, block by block, on
  full sets; of the links between two blocks a spanning forest comes out.

Candidates must fit in size and pass the estimate from the sketch of their union; links are then
confirmed on full shingle sets. First one candidate a class is confirmed; of the others only those
remain whose ends aren't in one component yet. A pair at the very threshold is missed with a
chance of under 1e-5, one of higher similarity with far less.

Defined results: a text that is null or has no words has no shingles and is linked with nothing (its
component is its own id); with fewer words than a shingle the whole sequence is one; texts are taken
whole; rows with equal texts are linked; rows with a null id take no part and have a null component;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import Shelf, cut, keyed
from spikeloom.llm.components import components, forest_roots

WORDS = 5
PERCENT = 75
SKETCH = 48
PROBES, COMMON_PROBES = 16, 8
RARE = 32
BLOCK = 256
#: So many common values at most are looked up in a set that the plan holds; more are joined.
FEW = 5_000
#: Estimates below this share of the union's sketch are dropped (the threshold is 0.75).
LIKELY = 0.4
#: The share of common values in a sketch is an estimate: classes join long lists from so much below
#: the threshold. At a true share of 0.75, 20 or more of 48 are common but for a chance of 3e-7.
SLACK = 0.35

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes of 63 bits."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, six white spaces
    if not tokens:
        return np.zeros(0, "int64")
    w = np.array(list(map(xxhash.xxh3_64_intdigest, tokens)), "uint64")
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, "uint64")
    for i in range(n):
        h = _mixed(h * _STEP + w[i : len(w) - n + 1 + i])
    return np.unique((h >> np.uint64(1)).astype("int64"))


SKETCHED = "n long, key long, sketch array<long>"


def _sketcher(words: int):
    @F.pandas_udf(SKETCHED)
    def sketch(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in sets], "key": [_key(s) for s in sets], "sketch": [s[:SKETCH] for s in sets]})

    return sketch


def _key(shingles: np.ndarray) -> int:
    """A hash of a whole set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) >> 1


def _whole_sets(words: int):
    @F.pandas_udf("key long, shingles array<long>")
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"key": [_key(s) for s in found], "shingles": found})

    return sets


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def _likely(a: Column, b: Column) -> Column:
    """The estimate of the similarity from the sketch of the union, as a condition."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return both >= F.lit(LIKELY) * F.size(union)


def _pairs_of_lists(lists: DataFrame, percent: int) -> DataFrame:
    """All pairs of each short list that fit in size."""
    pairs = F.flatten(F.transform("list", lambda x, i: F.transform(F.slice("list", i + 2, F.size("list")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    found = lists.select(F.explode(pairs).alias("p")).select("p.x", "p.y")
    found = found.filter(_sizes_fit(F.col("x.n"), F.col("y.n"), percent))
    ordered = F.col("x.key") < F.col("y.key")
    return found.select(F.when(ordered, F.col("x.key")).otherwise(F.col("y.key")).alias("a"), F.when(ordered, F.col("y.key")).otherwise(F.col("x.key")).alias("b"), (F.col("x.plain") & F.col("y.plain")).alias("plain"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("shared", shared)
    return joined.filter(100 * F.col("shared") >= percent * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b")


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """Members of a list in blocks of about BLOCK, one row each, with their full sets."""
    sizes = rows.groupBy("value").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = rows.join(sizes, "value").withColumn("block", F.pmod(F.xxhash64("key"), "blocks"))
    packed = dealt.groupBy("value", "block").agg(F.collect_list(F.struct("key", "root", "shingles")).alias(name))
    return packed.select("value", name)


def links_of_blocks(a: list, b: list, percent: int, columns: int = 1 << 14) -> set[tuple[int, int]]:
    """Confirmed links between two blocks of (key, root, shingles): as many as it takes to connect
    what is connected (a spanning forest). Overlaps of all pairs are a product of 0-1 matrices."""
    values = np.concatenate([x["shingles"] for x in (*a, *b)])
    kinds, codes = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x["shingles"]) for x in (*a, *b)])
    shared = np.zeros((len(a), len(b)), "float32")
    for at in range(0, len(kinds), columns):
        held = (codes >= at) & (codes < at + columns)
        matrix = np.zeros((len(a) + len(b), min(columns, len(kinds) - at)), "float32")
        matrix[owner[held], codes[held] - at] = 1
        shared += matrix[: len(a)] @ matrix[len(a) :].T
    sizes = np.array([len(x["shingles"]) for x in (*a, *b)], "float32")
    root = np.array([x["root"] for x in (*a, *b)])
    linked = 100 * shared >= percent * (sizes[: len(a), None] + sizes[None, len(a) :] - shared)
    linked &= root[: len(a), None] != root[None, len(a) :]
    above = {int(r): int(r) for r in root}

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    found = set()
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked))):
        r, t = top(int(a[i]["root"])), top(int(b[j]["root"]))
        if r != t:  # a link between what is connected already tells nothing new
            above[max(r, t)] = min(r, t)
            found.add((min(a[i]["key"], b[j]["key"]), max(a[i]["key"], b[j]["key"])))
    return found


def _stray_links(strays: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of what is outside its list's main component with all of the list, block by block."""

    def meet(batches):
        for batch in batches:
            found = set()
            for a, b in zip(batch["strays"], batch["others"]):
                found |= links_of_blocks(list(a), list(b), percent)
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    asked = strays.select("value").distinct()
    others = _packed(members.join(asked, "value", "left_semi").select("value", "key", "root").join(sets, "key"), "others")
    pairs = _packed(strays.select("value", "key", "root").join(sets, "key"), "strays").join(others, "value").drop("value")
    spark, batch_rows = members.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch_rows)
    spark.conf.set(batch_rows, "4")  # a row is two blocks of sets, some MB
    try:
        return cut(pairs.repartition(F.xxhash64("strays.key", "others.key")).mapInPandas(meet, "a long, b long").distinct())
    finally:
        spark.conf.set(batch_rows, before)


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    docs = keyed(docs, doc_id=doc_id, text=text)
    rows = shelf.put(docs.select("doc_id", _sketcher(words)("text").alias("s")).select("doc_id", "s.*"), "rows")
    classes = shelf.put(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    # values by how many classes retain them
    retained = classes.select("key", F.explode("sketch").alias("value"))
    common = cut(retained.groupBy("value").count().filter(F.col("count") > RARE).select("value"))
    if common.count() <= FEW:  # a set in the plan: no sketch moves
        values = ", ".join(str(r["value"]) for r in common.collect()) or "NULL"
        split = classes.withColumn("common", F.expr(f"filter(sketch, x -> x IN ({values}))"))
    else:
        held = retained.join(common, "value").groupBy("key").agg(F.collect_list("value").alias("common"))
        split = classes.join(held, "key", "left").withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    split = split.select("key", "n", "sketch", F.array_sort("common").alias("common"), F.array_except("sketch", "common").alias("rare"))
    split = shelf.put(split, "split")

    share = F.size("common") / F.size("sketch")

    # short lists: all pairs
    listed = split.select(F.struct("key", "n", (F.size("common") == 0).alias("plain")).alias("c"), F.explode(F.slice("rare", 1, F.when(share >= 0.3, SKETCH).otherwise(PROBES))).alias("value"))
    lists = listed.groupBy("value").agg(F.collect_list("c").alias("list")).filter(F.size("list") > 1)  # at most RARE long
    overlaps = _pairs_of_lists(lists, percent).groupBy("a", "b").agg(F.count("*").alias("overlap"), F.first("plain").alias("plain"))
    short = overlaps.filter((F.col("overlap") > 1) | ~F.col("plain")).select("a", "b")

    # long lists: members of large groups, each with the list's hubs
    grouped = split.filter(share >= F.when(F.col("n") <= SKETCH, percent / 100).otherwise(percent / 100 - SLACK)).withColumn("share", share)
    probes = F.explode(F.slice("common", 1, COMMON_PROBES)).alias("value")
    members = shelf.put(grouped.select("key", "n", "share", probes), "members")
    hubs = members.groupBy("value").agg(
        F.min(F.struct(-F.col("share"), "n", "key"))["key"].alias("first"),
        F.min(F.struct(F.xxhash64("key"), "key"))["key"].alias("second"),
        F.min(F.struct("n", "key"))["key"].alias("third"),
        F.count("*").alias("length"),
    )
    hubs = cut(hubs.filter("length > 1"))
    met = members.select("value", "key").join(hubs, "value").select("key", F.explode(F.array_distinct(F.array("first", "second", "third"))).alias("hub")).filter("key <> hub")
    starred = met.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()

    sketches = split.select("key", "n", "sketch")
    sides = [sketches.select(F.col("key").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab"]
    candidates = short.unionByName(starred).distinct().join(sides[0], "a").join(sides[1], "b")
    candidates = candidates.filter(_sizes_fit(F.col("na"), F.col("nb"), percent) & _likely(F.col("sa"), F.col("sb"))).select("a", "b")
    candidates = shelf.put(candidates, "candidates")

    # full sets of the classes that have a candidate or are in a long list
    asked = candidates.select(F.explode(F.array("a", "b")).alias("key")).unionByName(members.select("key")).distinct()
    ids = asked.join(classes.select("key", "doc_id"), "key").select("doc_id")
    whole = docs.join(ids, "doc_id", "left_semi").select(_whole_sets(words)("text").alias("w")).select("w.*")
    sets = shelf.put(whole.groupBy("key").agg(F.first("shingles").alias("shingles")), "sets")

    # one candidate a class, then what is still apart
    one = candidates.groupBy("b").agg(F.min("a").alias("a"))
    trees = forest_roots(_confirmed(one, sets, percent).select(F.col("b").alias("node"), F.col("a").alias("parent")))
    rooted = lambda df, k: df.join(trees.select(F.col("node").alias(k), F.col("root").alias(f"r{k}")), k, "left").withColumn(f"r{k}", F.coalesce(f"r{k}", k))
    apart = rooted(rooted(candidates, "a"), "b").filter("ra <> rb").select("a", "b")
    placed = rooted(members.select("value", "key"), "key").select("value", "key", F.col("rkey").alias("root"))
    centre = rooted(hubs.select("value", F.col("first").alias("hub")), "hub").select("value", F.col("rhub").alias("centre"))
    strays = placed.join(centre, "value").filter("root <> centre").drop("centre")
    more = _confirmed(apart, sets, percent).unionByName(_stray_links(strays, placed, sets, percent))
    between = cut(rooted(rooted(more, "a"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b").distinct())
    merged = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))

    # back to documents: the least id of a component over all its classes
    nodes = rooted(classes.select("key", "doc_id"), "key").withColumnRenamed("rkey", "root").join(merged, "root", "left").withColumn("root", F.coalesce("top", "root"))
    least = nodes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = cut(nodes.join(least, "root").select("key", "component_id"))
    for name in ("classes", "split", "members", "candidates", "sets"):
        shelf.drop(name)
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key")).join(of_class, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
