"""Quality rules as a short-circuit cascade.

Every rule looks at one document's text. On a bounded sample of documents the cost (seconds) and the
selectivity (share rejected) of each rule are measured in place: the rule with the most rejections
per cost goes first, the others are measured again on what it lets through, with its measures at
hand, and so on. A document that one rule rejects is not shown to the next, and a measure that no
rule has asked for is never computed. The order changes the work, never the verdict: a document is
kept iff no rule rejects it.

Defined results: a null text counts as empty (no words, fails the base rule of ten words); very
long texts are taken whole; repeated rows give repeated results; an empty table gives no rows;
null ids are carried through; other columns of the input are ignored.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import keyed

#: Documents on which cost and selectivity are measured (at most).
SAMPLE_ROWS = 400

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = b"abcdefghijklmnopqrstuvwxyz"


class Doc:
    """One text with its measures, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.raw = self.text.encode("utf-8", "surrogatepass")
        self._words: list[bytes] | None = None
        self._got: dict[str, int] = {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()  # bytes split at exactly space and \t to \r
        return self._words

    def copy(self) -> Doc:
        """The same text with the measures known so far."""
        other = copy(self)
        other._got = dict(self._got)
        return other

    def get(self, name: str) -> int:
        if name not in self._got:
            self._got[name] = MEASURES[name](self)
        return self._got[name]


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def _lines(d: Doc) -> list[bytes]:
    return [x for x in d.raw.split(b"\n") if x.strip(SPACES)]


def _dup_lines(d: Doc) -> int:
    lines = _lines(d)
    return len(lines) - len(set(lines))


def _repeat_words(d: Doc, width: int = 5) -> int:
    """Words covered by a window of `width` words whose content occurs at least twice."""
    w = d.words
    if len(w) <= width:
        return 0
    grams = list(zip(*(w[i:] for i in range(width))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    starts = np.fromiter((counts[g] > 1 for g in grams), bool, len(grams))
    covered = np.zeros(len(w), bool)
    for i in range(width):
        covered[i : i + len(grams)] |= starts
    return int(covered.sum())


def _top_word(d: Doc) -> int:
    """How often the most common word occurs."""
    return max(Counter(d.words).values(), default=0)


MEASURES: dict[str, Callable[[Doc], int]] = {
    "n_words": lambda d: len(d.words),
    "word_chars": lambda d: len(d.text) - _count(d.raw, SPACES),
    "n_symbols": lambda d: _count(d.raw, SYMBOLS),
    "n_lines": lambda d: len(_lines(d)),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_capitals": lambda d: _count(d.raw, CAPITALS),
    "n_small": lambda d: _count(d.raw, SMALL),
    "n_top_word": _top_word,
    "n_open_lines": lambda d: sum(x.rstrip(SPACES).endswith((b"...", "…".encode())) for x in _lines(d)),
}

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: The cascade's rules; each says whether it rejects a document. Integer arithmetic throughout.
RULES: dict[str, Callable[[Doc], bool]] = {
    "few_words": lambda d: d.get("n_words") < 10,
    "repeated_words": lambda d: 100 * d.get("n_repeat_words") > 20 * d.get("n_words"),
    "symbols": lambda d: 100 * d.get("n_symbols") > 8 * d.get("word_chars"),
    "shouting": lambda d: d.get("n_capitals") > d.get("n_small"),
    "word_length": lambda d: d.get("word_chars") > 15 * d.get("n_words") or d.get("word_chars") < 2 * d.get("n_words"),
    "repeated_lines": lambda d: 100 * d.get("n_dup_lines") > 50 * d.get("n_lines"),
    "one_word": lambda d: 100 * d.get("n_top_word") > 30 * d.get("n_words"),
    "open_lines": lambda d: 100 * d.get("n_open_lines") > 30 * d.get("n_lines"),
}

#: The rules that the base verdict is made of.
BASE_RULES = ("few_words", "repeated_words")


def order_by_worth(docs: list[Doc], rules: tuple[str, ...], clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, int, float]]:
    """(rule, rejected, seconds) in the cascade's order, each measured on what the earlier ones let through."""
    left, todo, found = list(docs), list(rules), []
    while todo:
        tried = []
        for name in todo:
            copies = [d.copy() for d in left]
            began = clock()
            rejected = [RULES[name](d) for d in copies]
            # one half of a rejection is added, so that rules which rejected nothing still go by cost
            seconds = max(clock() - began, 1e-9)
            tried.append(((sum(rejected) + 0.5) / seconds, name, rejected, seconds, copies))
        _, name, rejected, seconds, copies = max(tried, key=lambda x: (x[0], x[1]))
        found.append((name, sum(rejected), seconds))
        left = [d for d, gone in zip(copies, rejected) if not gone]
        todo.remove(name)
    return found


def plan(docs: DataFrame, text: str = "text", rules: tuple[str, ...] = tuple(RULES), sample_rows: int = SAMPLE_ROWS, measures: tuple[str, ...] = ()) -> list[str]:
    """The rules in the order of rejection per cost, as measured on at most `sample_rows` documents.

    `measures` are those that are computed for every document anyway, and cost a rule nothing."""
    texts = keyed(docs, text=text)
    rows = texts.count()
    share = min(1.0, 2.0 * sample_rows / max(rows, 1))
    sample = texts.sample(fraction=share, seed=17).limit(sample_rows)

    def measure(batches):
        seen = [Doc(t) for batch in batches for t in batch["text"]]  # the sample: sample_rows at most
        for d in seen:
            for m in measures:
                d.get(m)
        order = order_by_worth(seen, rules) if seen else []
        yield pd.DataFrame([(i, *x) for i, x in enumerate(order)], columns=["place", "rule", "rejected", "seconds"])

    found = sample.coalesce(1).mapInPandas(measure, "place int, rule string, rejected long, seconds double").collect()  # one row a rule
    order = [r["rule"] for r in sorted(found)]
    return order or list(rules)


def cascade(order: list[str], measures: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """A function from a text column to a struct: kept, rejected_by and the measures asked for, with
    base_failed if these make it known."""
    known = set(BASE) <= set(measures)
    schema = "".join(f"{m} long, " for m in measures) + "base_failed boolean, " * known + "kept boolean, rejected_by string"

    @F.pandas_udf(schema)
    def judge(texts: pd.Series) -> pd.DataFrame:
        docs = [Doc(t) for t in texts]
        out = pd.DataFrame({m: np.array([d.get(m) for d in docs], "int64") for m in measures})
        if known:
            out["base_failed"] = np.array([any(RULES[name](d) for name in BASE_RULES) for d in docs], bool)
        rejected_by: list[str | None] = [None] * len(docs)
        left = list(range(len(docs)))
        for name in order:  # only what every earlier rule let through reaches this one
            rule = RULES[name]
            passed = []
            for i in left:
                if rule(docs[i]):
                    rejected_by[i] = name
                else:
                    passed.append(i)
            left = passed
        kept = np.zeros(len(docs), bool)
        kept[left] = True
        out["kept"], out["rejected_by"] = kept, rejected_by
        return out

    return judge


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", measures: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept and rejected_by of every document, with the measures asked for."""
    judge = cascade(plan(docs, text, measures=measures), measures)
    return keyed(docs, doc_id=doc_id, text=text).select("doc_id", judge("text").alias("j")).select("doc_id", "j.*")
