"""URL rules through a Bloom filter cascade, in DataFrame functions only.

The first filter encodes the listed keys. Over the complete universe of keys that the corpus can
ask for, it has some false positives; a second filter encodes these, a third one those listed keys
that the second wrongly holds, and so on until a level has no false positive. Asking the levels in
order then gives exact membership for every key of the universe, without a join: each page tests
a few computed keys against small literals.

A page's keys are, for every shape (host labels, path length) that the rules have, its last labels
joined with the start of its path; the longest key that is listed is the page's rule. A second
cascade tells the blocking rules from the others.

Pages without a rule are judged by a third cascade, over a list of blocked domains: its universe are
the hosts of all pages with all domains above them, and a page is blocked if one of these is listed.
The list is a table; `named_domains` makes one from the corpus's own hosts, by words in their names.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and is
allowed; texts of any length are taken whole; repeated rows give repeated results; an empty table,
rule list or domain list works, and domains that no page has change nothing; other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import Shelf, keyed

#: (verdict, host, path): the longest rule that fits decides.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

#: Words in a host's name that put it on the list of `named_domains`.
BLOCKED_WORDS = (
    "adult", "ads", "bet", "bets", "betting", "casino", "escort", "gambling", "lottery", "malware", "phishing",
    "pills", "poker", "porn", "sex", "slots", "spam", "viagra", "warez", "xxx",
)

#: A filter travels as a literal in the plan; a longer list than fits is refused, never cut.
MAX_WORDS = 1 << 20


class Level:
    """One Bloom filter: `bits` positions in 64-bit words, `hashes` positions a key."""

    def __init__(self, number: int, keys: int, rate: float):
        self.number = number
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = 64 * max(1, math.ceil(keys * self.hashes / math.log(2) / 64))
        if self.bits // 64 > MAX_WORDS:
            raise ValueError(f"{keys} keys need {self.bits // 64} words; a literal filter holds {MAX_WORDS}")
        self.words: Column | None = None

    def positions(self, key: Column) -> Column:
        first, step = (F.pmod(F.xxhash64(F.lit(2 * self.number + i), key), F.lit(self.bits).cast("long")) for i in (0, 1))
        return F.array(*[F.pmod(first + F.lit(i) * step, F.lit(self.bits).cast("long")) for i in range(self.hashes)])

    def fill(self, keys: DataFrame) -> Level:
        """Set the bits of the keys; bits are or-ed together on the executors, words come here."""
        rows = (
            keys.select(F.explode(self.positions(F.col("key"))).alias("at"))
            .groupBy((F.col("at") / 64).cast("int").alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits"))
            .collect()  # at most MAX_WORDS rows, by the check above
        )
        words = [0] * (self.bits // 64)
        for r in rows:
            words[r["word"]] = r["bits"]
        self.words = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
        return self

    def holds(self, key: Column) -> Column:
        found = F.transform(self.positions(key), lambda at: F.getbit(F.element_at(self.words, (at / 64).cast("int") + 1), (at % 64).cast("int")) == 1)
        return F.forall(found, lambda x: x)


class Cascade:
    """Exact membership for every key of the universe it was built over."""

    def __init__(self, universe: DataFrame):
        """universe: key string, listed boolean; keys may repeat, one listed row lists the key."""
        shelf = Shelf(universe.sparkSession)
        keys = shelf.put(universe.groupBy("key").agg(F.max("listed").alias("listed")), "keys")
        counts = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count("*").alias("n")).collect()}
        listed, others = counts.get(True, 0), counts.get(False, 0)
        self.levels: list[Level] = []
        side, mine, theirs = True, listed, others
        while mine:  # the keys still to tell apart, held by every level so far
            rate = 0.5 if self.levels else min(0.5, max(mine, 1) / (math.sqrt(2) * max(theirs, 1)))
            left = keys
            for level in self.levels:  # each side has passed all the other side's filters
                left = left.filter((F.col("listed") == F.lit(level.number % 2 == 0)) | level.holds(F.col("key")))
            level = Level(len(self.levels), mine, rate).fill(left.filter(F.col("listed") == F.lit(side)))
            self.levels.append(level)
            wrong = left.filter((F.col("listed") != F.lit(side)) & level.holds(F.col("key"))).count()
            side, mine, theirs = not side, wrong, mine
        shelf.drop("keys")

    def lists(self, key: Column) -> Column:
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):  # the first level that doesn't hold the key decides
            verdict = F.when(~level.holds(key), F.lit(level.number % 2 == 1)).otherwise(verdict)
        return verdict


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def page_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a page, as (length, labels, key), for each shape that the page is large enough for."""
    labels = F.size(F.split(host, "\\."))
    keys = []
    for n, size in shapes:
        key = F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size))
        keys.append(F.when((labels >= n) & (F.length(path) >= size), F.struct(F.length(key).alias("length"), F.lit(n).alias("labels"), key.alias("key"))))
    if not keys:
        return F.array().cast("array<struct<length:int,labels:int,key:string>>")
    return F.filter(F.array(*keys), lambda x: x.isNotNull())


def domains(host: Column) -> Column:
    """The host and all domains above it, but for the last label alone; none of an empty host."""
    labels = F.size(F.split(host, "\\."))
    counts = F.sequence(F.least(F.lit(2), labels), labels)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(counts, lambda n: F.call_function("substring_index", host, F.lit("."), -n)))


def named_domains(pages: DataFrame, url: str = "url", words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """domain: the corpus's hosts of which a label, or a part of one between hyphens, is one of the words."""
    host = host_and_path(F.col("url"))[0]
    return keyed(pages, url=url).select(host.alias("domain")).distinct().filter(F.col("domain").rlike(r"(?:^|[.-])(?:" + "|".join(words) + r")(?:[.-]|$)"))


def judge_urls(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, blocked_domains: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page; without a rule a page is blocked if its host
    or a domain above it is one of `blocked_domains` (a column `domain`)."""
    spark = pages.sparkSession
    host, path = host_and_path(F.col("url"))
    shapes = sorted({(len(h.split(".")), len(p)) for _, h, p in rules})
    parts = keyed(pages, page_id=page_id, url=url).select("page_id", host.alias("host"), path.alias("path"))
    keyed_pages = parts.withColumn("keys", page_keys(F.col("host"), F.col("path"), shapes))

    def rule_rows(flags: list[tuple[str, bool]]) -> DataFrame:
        return spark.createDataFrame(flags, "key string, listed boolean")

    asked = keyed_pages.select(F.explode("keys").alias("k")).select(F.col("k.key").alias("key"), F.lit(False).alias("listed"))
    listed = Cascade(asked.unionByName(rule_rows([(h + p, True) for _, h, p in rules])))
    blocked = Cascade(rule_rows([(h + p, v == "block") for v, h, p in rules]))
    best = F.array_max(F.filter(F.col("keys"), lambda k: listed.lists(k["key"])))
    found = keyed_pages.withColumn("rule", best["key"])
    unruled = F.lit(False)
    if blocked_domains is not None:
        above = keyed_pages.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key"), F.lit(False).alias("listed"))
        named = blocked_domains.filter("domain IS NOT NULL").select(F.col("domain").alias("key"), F.lit(True).alias("listed"))
        by_domain = Cascade(above.unionByName(named))
        unruled = F.exists(domains(F.col("host")), by_domain.lists)
    verdict = F.when(F.when(F.col("rule").isNotNull(), blocked.lists(F.col("rule"))).otherwise(unruled), F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
