"""Fill-in-middle forms of documents, with boundaries found on big integers.

A text becomes a Latin-1 byte a code point, `bytes.translate` turns these bytes into the digits of
class masks, and each mask is read as one integer whose bit i stands for code point i. Shifts and
boolean operations on whole masks then mark where units begin, `bit_count` gives their number, and
the k-th of them is selected by halving: the count of the lower half tells in which half it lies.
A text is cut at two drawn units, and its parts are written in another order behind sentinels.

Units are lines (each with its line feed) or words (each with the white space behind it; white space
before the first word is a unit). The draw depends on the seed and the document's id alone: the
first four groups of eight hex digits of sha256("seed:id") give the two cuts, whether a document is
turned (share `rate` of 100), and its form (share `spm_rate` of 100: suffix first).

Defined results: a null text counts as empty; an empty text, and one that holds a sentinel, stays
plain, with null part lengths; a null id is drawn as an empty string; repeated rows give equal rows;
texts of any length are cut whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import keyed

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORM = "n long, form string, prefix_chars long, middle_chars long, output string"


def _digits(chosen: bytes) -> bytes:
    """A table for translate: the digit 1 for these bytes, else 0."""
    return bytes(0x31 if b in chosen else 0x30 for b in range(256))


LINE_FEED = _digits(b"\n")
SPACE = _digits(b"\t\n\v\f\r ")


def class_mask(text: str, table: bytes) -> int:
    """Bit i is set where code point i is in the table's class; all classes are of ASCII characters."""
    return int(text.encode("latin-1", "replace").translate(table)[::-1] or b"0", 2)


def starts_of_lines(text: str) -> int:
    whole = (1 << len(text)) - 1
    return (class_mask(text, LINE_FEED) << 1 | 1) & whole


def starts_of_words(text: str) -> int:
    whole = (1 << len(text)) - 1
    space = class_mask(text, SPACE)
    return (~space & space << 1 | 1) & whole


UNITS = {"line": starts_of_lines, "word": starts_of_words}


def select(mask: int, rank: int, size: int) -> int:
    """The place of the set bit with this rank, from 0, in a mask of so many bits."""
    at = 0
    while size > 1:
        half = size >> 1
        low = mask & (1 << half) - 1
        below = low.bit_count()
        if rank < below:
            mask, size = low, half
        else:
            mask, size, rank, at = mask >> half, size - half, rank - below, at + half
    return at


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[i : i + 8], 16) for i in (0, 8, 16, 24))


def turn(text: str, doc_id: object, seed: int, rate: int, spm_rate: int, unit: str = "line") -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, and the output."""
    starts = UNITS[unit](text)
    n = starts.bit_count()
    one, two, turned, suffix_first = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or turned % 100 >= rate:
        return n, PLAIN, None, None, text
    a, b = (len(text) if k == n else select(starts, k, len(text)) for k in sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if suffix_first % 100 < spm_rate:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text again, from an output and its form. No text with a sentinel is turned, so the first
    occurrence of each is the one that was written."""
    if form == PLAIN:
        return output
    first, rest = output[3:].split(PREFIX if form == SPM else SUFFIX, 1)
    second, middle = rest.split(MIDDLE, 1)
    return second + middle + first if form == SPM else first + middle + second


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 0, rate: int = 50, spm_rate: int = 50, unit: str = "line") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every document."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")

    @F.pandas_udf(FORM)
    def turned(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [turn(t or "", None if d is None else d, seed, rate, spm_rate, unit) for d, t in zip(ids, texts)]
        return pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    docs = keyed(docs, doc_id=doc_id, text=text)
    return docs.select("doc_id", turned(F.col("doc_id").cast("string"), "text").alias("f")).select("doc_id", "f.*")


def restored(output: Column, form: Column) -> Column:
    """The texts of outputs."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restore(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)
