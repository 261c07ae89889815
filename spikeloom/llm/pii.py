"""Personal data by aggregated weak supervision.

Four base kinds are found by fixed patterns with checks (e-mail, IPv4 address, card, phone); these
spans always stay. Looser patterns propose further spans: unprefixed phone numbers, spelled-out
e-mail addresses, card-like and national numbers, IBANs and IPv6 addresses, secrets (keys, tokens,
passwords), names of persons and street addresses. Every proposed span, base ones too, is shown to
labelers (strict pattern, checksum or, for secrets, mix of characters, gazetteer of words nearby,
gazetteer of issuers, domains, token formats, given names and street words, edges, surroundings),
which vote for, against or not at all.

The vote patterns of the whole corpus are counted on the executors. Expectation-maximisation on
these counts estimates how reliable each labeler is and, with that, how likely each pattern is
personal data; a logistic classifier over votes, kind and shape is trained on these estimates, and
decides on every proposed span. Patterns, not spans, travel to the driver: their number has a bound
that doesn't depend on the corpus (kinds x 3^labelers x shapes).

Defined results: a null text counts as empty; texts are taken whole, in linear time; repeated rows
give repeated results; an empty table gives no rows; null ids are carried through; other columns
are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import keyed

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ipv6", "national_id", "secret", "person", "address")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{2,63})+", re.I)
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

DIGIT = re.compile("[0-9]")
ASSIGNED_WORDS = ("key", "secret", "token", "passw", "pwd", "passphrase", "bearer", "authorization")
ASSIGNED = re.compile(
    r"(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|private[_-]?key|secret|token|passwor[dt]|passwd|pwd|passphrase|bearer|authorization)"
    r"[\"']?(?:\s{0,4}[:=]>?\s{0,4}|\s{1,4})[\"']?([^\s\"'<>,;]{8,})",
    re.I,
)
RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{24,}(?![A-Za-z0-9_+/=-])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")
KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----")
KEY_BODY = re.compile(r"[A-Za-z0-9+/=\s:,-]*")
WORD_NAME = "[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,30}"
TITLES = ("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Sr")
TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra?)\.? {WORD_NAME}(?:[ -]{WORD_NAME}){{0,2}}")
STREET_WORDS = (
    " Street", " St", " Ave", " Road", " Rd", " Lane", " Ln", " Drive", " Boulevard", " Blvd", " Court", " Square", " Terrace", "straße ", "strasse ", "gasse ", "allee ", "platz ",
    " rue ", " avenue ", " boulevard ", " place ", " allée ", " impasse ", "Calle ", "Avenida ", "Plaza ", "Paseo ",
)
STREET = re.compile(
    rf"(?<![\w.])[0-9]{{1,5}}[a-z]?,? (?:{WORD_NAME} ){{1,3}}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)(?!\w)"
    rf"|(?<!\w)[A-ZÄÖÜ][a-zäöüß-]{{1,30}}(?:straße|strasse|gasse|allee|platz) [0-9]{{1,4}}[a-z]?(?!\w)"
    rf"|(?<![\w.])[0-9]{{1,4}}(?: bis)?,? (?:rue|avenue|boulevard|place|allée|impasse) (?:de la |de l'|du |des |de )?{WORD_NAME}(?:[ -]{WORD_NAME}){{0,2}}"
    rf"|(?<!\w)(?:Calle|Avenida|Plaza|Paseo) (?:de la |del |de )?{WORD_NAME}(?: {WORD_NAME}){{0,2}},? [0-9]{{1,4}}(?!\w)"
)

#: Words that announce personal data, in lower case.
NEARBY = re.compile(
    r"\b(?:e-?mail|mail|phone|tel|telephone|call|fax|mobile|card|visa|mastercard|iban|account|ssn|ip|address|contact|name|signed|sincerely|regards|born|"
    r"lives?|resident|street|adresse|dirección|token|key|secret|passwor[dt]|passwd|pwd|bearer|authorization|credentials?|login)\b"
)
DOMAINS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu"}
#: How keys and tokens of well-known services begin.
TOKEN_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AIza", "sk_live_", "sk_test_", "sk-", "rk_live_", "npm_", "pypi-", "SG.", "eyJ", "-----BEGIN")
#: Common given names in English, German, French and Spanish.
GIVEN_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah "
    "Charles Karen Daniel Nancy Matthew Lisa Anthony Margaret Mark Sandra Paul Emily Andrew Michelle Peter Laura Hans Klaus Jürgen "
    "Wolfgang Stefan Andreas Sabine Petra Monika Ursula Heike Anna Jean Pierre Michel Philippe Jacques Marie Nathalie Isabelle Sylvie "
    "Catherine François José Antonio Manuel Francisco Juan Carlos Luis Javier María Carmen Josefa Isabel Ana Pilar Lucía".split()
)
NAMED = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(GIVEN_NAMES))}) {WORD_NAME}(?:[ -]{WORD_NAME})?")

LABELERS = ("pattern", "checksum", "words_nearby", "issuer", "edges", "surroundings")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    end = last = 0
    for m in DOMAIN.finditer(text):
        at, floor = m.start(), max(end, last)
        start = floor + len(text[floor:at].rstrip(LOCAL))  # the run of local characters before the @
        last = at + 1
        if start < at:
            end = m.end()
            yield start, end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """Digit groups of 13 to 19 digits: start, end, digits."""
    long = [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 13]
    return [(a, b, d) for a, b in long if 13 <= len(d := _digits(text[a:b])) <= 19]


def base_spans(text: str, numbers: list[tuple[int, int, str]] | None = None) -> list[tuple[str, int, int]]:
    """The spans of the four base kinds, by kind and then start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    out += [("card", a, b) for a, b, d in (_numbers(text) if numbers is None else numbers) if len(d) >= 16 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def _private_keys(text: str) -> list[tuple[int, int]]:
    """From each begin marker to the next end marker, if what lies between is a key's; markers in any
    number and order are looked at once."""
    ends = [m.span() for m in KEY_END.finditer(text)]
    out, body, at = [], 0, 0  # body: how far the run of a key's characters goes that was looked at last
    for m in KEY_BEGIN.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            at += 1
        if at == len(ends):
            break
        if out and m.start() < out[-1][1]:
            continue
        body = body if m.end() <= body else KEY_BODY.match(text, m.end()).end()
        if ends[at][0] <= body:
            out.append((m.start(), ends[at][1]))
    return out


def loose_spans(text: str, numbers: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """Proposals of the looser patterns."""
    out = []
    lower = text.lower()
    holds = lambda of, some: any(x in of for x in some)  # noqa: E731  a cheap look before a costly pattern
    if "(at)" in lower or "[at]" in lower or " at " in lower and " dot " in lower:
        out += [("email", m.start(), m.end()) for m in SPELLED.finditer(text)]
    words = text.split()
    if DIGIT.search(text):
        out += [("card", a, b) for a, b, _ in numbers]
        out += [("phone", m.start(), m.end()) for m in LOCAL_PHONE.finditer(text)]
        if "-" in text:
            out += [("national_id", m.start(), m.end()) for m in NATIONAL.finditer(text)]
        out += [("iban", m.start(), m.end()) for m in IBAN.finditer(text)]
        if holds(text, STREET_WORDS):
            out += [("address", *m.span()) for m in STREET.finditer(text)]
        if max(map(len, words), default=0) >= 24:
            out += [("secret", *m.span()) for m in RUN.finditer(text)]
    if text.count(":") >= 7:
        out += [("ipv6", m.start(), m.end()) for m in IPV6.finditer(text)]
    if holds(lower, ASSIGNED_WORDS):
        out += [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    if "eyJ" in text:
        out += [("secret", *m.span()) for m in JWT.finditer(text)]
    if "-----BEGIN" in text:
        out += [("secret", *span) for span in _private_keys(text)]
    if holds(text, TITLES):
        out += [("person", *m.span()) for m in TITLED.finditer(text)]
    if not GIVEN_NAMES.isdisjoint(words) or not GIVEN_NAMES.isdisjoint(w.lstrip("\"'([{<-*_") for w in words if not w[0].isalnum()):
        out += [("person", *m.span()) for m in NAMED.finditer(text)]
    return list(dict.fromkeys(out))


def _mixed(found: str) -> int:
    """What the characters of a would-be secret say: keys mix digits and letters without a pattern."""
    digits, letters = sum("0" <= c <= "9" for c in found), sum(c.isalpha() for c in found)
    if not digits or not letters or len(set(found)) < 8:
        return -1
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(found, found[1:]))
    return 1 if changes >= 4 and len(set(found)) >= 10 else 0


def _iban_valid(found: str) -> bool:
    found = found.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """What each labeler says of a span: 1, 0 or -1."""
    found = text[start:end]
    digits = _digits(found)
    pattern = 1 if is_base else (-1 if kind in ("card", "ip") else 0)
    checksum = issuer = 0
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
        issuer = 1 if digits[0] in "3456" and 13 <= len(digits) <= 16 else -1
    elif kind == "iban":
        checksum = 1 if _iban_valid(found) else -1
    elif kind == "ip":
        checksum = 1
        issuer = -1 if digits[:1] == "0" or found.startswith("127.") else 1
    elif kind == "email":
        issuer = 1 if re.split(r"[.\s\])]", found.lower())[-1] in DOMAINS else 0
    elif kind == "phone":
        issuer = 1 if 10 <= len(digits) <= 13 else -1
    elif kind == "national_id":
        issuer = -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "secret":
        checksum = 1 if found.startswith("-----BEGIN") else _mixed(found)
        issuer = 1 if found.startswith(TOKEN_STARTS) else 0
    elif kind == "person":
        issuer = 1 if GIVEN_NAMES.intersection(found.replace("-", " ").split()) else 0
        checksum = 1 if len(found.split()) > 1 else -1
    elif kind == "address":
        issuer = 1  # its street word
    before, after = text[max(0, start - 32) : start], text[end : end + 32]
    nearby = 1 if NEARBY.search(before.lower()) else 0
    glued = before[-1:].isalnum() or after[:1].isalnum()
    around = before + after
    dense = 3 * sum("0" <= c <= "9" for c in around) > len(around)
    if kind == "secret" and nearby == 0:  # a run without a word that announces it: a checksum, a name of a file
        pattern = -1
    return pattern, checksum, nearby, issuer, -1 if glued else 1, -1 if dense else 1


def shape(text: str, start: int, end: int) -> int:
    """0 to 5: whether the span is short, medium or long, and whether it has separators."""
    n = end - start
    return (0 if n < 12 else 1 if n < 18 else 2) * 2 + (1 if re.search(r"[^A-Za-z0-9]", text[start:end]) else 0)


def proposals(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...], int]]:
    """Base spans, and loose ones that overlap none of them: kind, start, end, is_base, votes, shape."""
    numbers = _numbers(text)
    base = base_spans(text, numbers)
    spans = [(k, a, b, True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken], "int64")
    reach = np.maximum.accumulate(np.array([b for _, b in taken], "int64")) if taken else starts
    for k, a, b in loose_spans(text, numbers):
        i = int(np.searchsorted(starts, b)) if taken else 0
        if i == 0 or reach[i - 1] <= a:
            spans.append((k, a, b, False))
    return [(k, a, b, is_base, votes(text, k, a, b, is_base), shape(text, a, b)) for k, a, b, is_base in spans]


# -- what is learned from the counts of vote patterns


@dataclass
class SpanModel:
    """reliability[labeler][vote + 1][class]; weights of the span classifier."""

    reliability: np.ndarray = field(default_factory=lambda: np.full((len(LABELERS), 3, 2), 1 / 3))
    weights: np.ndarray | None = None

    def accepts(self, kind: str, vote: tuple[int, ...], shaped: int) -> bool:
        if self.weights is None:
            return sum(vote) > 0
        return float(encoded(kind, vote, shaped) @ self.weights) >= 0.0


def encoded(kind: str, vote: tuple[int, ...], shaped: int) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(vote) + 6)
    x[0] = 1
    x[1 + KINDS.index(kind)] = 1
    for i, v in enumerate(vote):
        if v:
            x[1 + len(KINDS) + 2 * i + (v > 0)] = 1
    x[1 + len(KINDS) + 2 * len(vote) + shaped] = 1
    return x


def aggregate(vote: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: the chance of each vote pattern to be personal data, and the
    labelers' reliabilities. It starts from the majority, which also fixes which class is which."""
    chance = 1 / (1 + np.exp(-1.5 * vote.sum(axis=1)))
    for _ in range(rounds):
        weight = np.stack([(1 - chance) * count, chance * count])
        prior = (weight.sum(axis=1) + 1) / (count.sum() + 2)
        reliability = np.stack([np.stack([(weight * (vote[:, j] == v)).sum(axis=1) + 0.5 for v in (-1, 0, 1)]) / (weight.sum(axis=1) + 1.5) for j in range(vote.shape[1])])
        logs = np.log(prior)[:, None] + sum(np.log(reliability[j][vote[:, j] + 1]).T for j in range(vote.shape[1]))
        chance = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    return chance, reliability


def train_classifier(x: np.ndarray, chance: np.ndarray, count: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression on soft labels, by Newton's method."""
    w, weight = np.zeros(x.shape[1]), count / count.sum() * min(count.sum(), 1e6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (chance - p)) - 0.1 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def learn(docs: DataFrame, text: str = "text") -> SpanModel:
    """The model from the vote patterns of all documents."""

    @F.pandas_udf("array<string>")
    def patterns(texts: pd.Series) -> pd.Series:
        return pd.Series([[f"{k}|{','.join(map(str, v))}|{s}" for k, _, _, _, v, s in proposals(t or "")] for t in texts])

    counted = keyed(docs, text=text).select(F.explode(patterns("text")).alias("p")).groupBy("p").count().collect()  # kinds x 3^labelers x shapes at most
    if not counted:
        return SpanModel()
    rows = sorted((r["p"].split("|"), r["count"]) for r in counted)
    kind = [p[0] for p, _ in rows]
    vote = np.array([[int(v) for v in p[1].split(",")] for p, _ in rows])
    shaped = [int(p[2]) for p, _ in rows]
    count = np.array([n for _, n in rows], "float64")
    chance, reliability = aggregate(vote, count)
    x = np.stack([encoded(k, tuple(v), s) for k, v, s in zip(kind, vote.tolist(), shaped)])
    return SpanModel(reliability, train_classifier(x, chance, count))


def find(text: str, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans; each by kind and then start."""
    base, added = [], []
    for k, a, b, is_base, v, s in proposals(text):
        if is_base:
            base.append((k, a, b))
        elif model.accepts(k, v, s):
            added.append((k, a, b))
    end, extra = 0, []
    for k, a, b in sorted(added, key=lambda x: (x[1], -x[2], x[0])):
        if a >= end:
            extra.append((k, a, b))
            end = b
    return base, sorted(base + extra, key=lambda x: (KINDS.index(x[0]), x[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping ones the first by start stands."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += (text[end:a], f"<{k.upper()}>")
        end = max(end, b)
    return "".join(out) + text[end:]


def detector(model: SpanModel):
    """A function from a text column to a struct of counts, base_sha256, spans and their number."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")
    def detect(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            base, spans = find(t or "", model)
            counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return detect


def redactor(model: SpanModel):
    """A function from a text column to the text without its personal data; null stays null."""

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else redacted(t, find(t, model)[1]) for t in texts], dtype=object)

    return redact


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts and digest, all spans of every document and how many they are."""
    found = detector(learn(docs, text))
    return keyed(docs, doc_id=doc_id, text=text).select("doc_id", found("text").alias("f")).select("doc_id", "f.*")
