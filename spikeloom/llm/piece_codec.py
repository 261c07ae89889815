"""SentencePiece encoding and decoding for merge-type models, by backtracking.

The encoder never runs a merge queue over a text. For every position it takes the longest piece
that an Aho-Corasick automaton finds there; a piece may follow another only if re-merging the two
pieces' characters gives just these two pieces back (checked once a pair and remembered); where
nothing fits, it steps back to the next shorter piece, and a bitfield keeps the positions from
which no valid rest exists, so that none is tried twice.

A text is taken in chunks, each a space with the word after it: no piece of a merge model with a
whitespace prefix holds a space after another character (checked on loading), so no piece spans
two chunks. Characters without a piece of their own end a run and become byte pieces. Pieces that
are only spaces all have the same score in such models; runs of spaces are merged by that score's
rule (the leftmost first).

Defined results: a null text counts as empty and has no ids; texts are taken whole; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from functools import lru_cache
from itertools import chain

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spikeloom.llm.common import keyed

SPACE = "▁"
#: Entries that a worker's chunk memory holds; it is emptied when full.
MEMORY = 500_000

UNKNOWN, CONTROL, USER, UNUSED, BYTE = 2, 3, 4, 5, 6


def _fields(raw: bytes):
    """(field number, value) of a protocol buffer message: varints as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        number, wire = key >> 3, key & 7
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, raw[at : at + size]
        at += size


class PieceModel:
    """The pieces of a model file, with the encoder and the decoder."""

    def __init__(self, path: str):
        self.pieces: list[str] = []
        scores: list[float] = []
        kinds: list[int] = []
        with open(path, "rb") as file:
            message = file.read()
        normalizer: dict[int, object] = {}
        for number, value in _fields(message):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                kinds.append(piece.get(3, 1))
            elif number == 3:
                normalizer = dict(_fields(value))
        if normalizer.get(1) != b"identity" or normalizer.get(4, 1) != 0 or not normalizer.get(3, 1) or USER in kinds:
            raise ValueError("only merge models with identity normalization, a dummy prefix and no user-defined pieces")
        self.id_of = {p: i for i, p in enumerate(self.pieces) if kinds[i] == 1}
        self.score = {p: scores[i] for p, i in self.id_of.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece holds a space after another character")
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == BYTE}
        self.id_byte = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.plain = [b"" if kinds[i] in (CONTROL, UNKNOWN, BYTE) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.as_text = [str(i) for i in range(len(self.pieces))]
        self.table = [self.id_byte.get(i, p) for i, p in enumerate(self.plain)]
        # single characters stand before all merges, then the merges from the best score down
        order = sorted((p for p in self.id_of if len(p) == 1 or p.strip(SPACE)), key=lambda p: (len(p) > 1, -self.score[p], self.id_of[p]))
        self.rank = {p: i for i, p in enumerate(order)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in order:
            if len(p) == 1 or self._halve(p):
                self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self._pairs: dict[tuple[str, str], bool] = {}
        self._shorter: dict[str, str | None] = {}
        self._spaces: dict[int, list[int]] = {}
        self._words: dict[str, tuple[int, ...]] = {}
        self._bare: dict[str, tuple[int, ...]] = {}
        self.characters = frozenset(p for p in self.id_of if len(p) == 1)

    # -- re-merging

    def _halve(self, piece: str) -> bool:
        """Note the two parts of a piece's last merge; false if merging its characters doesn't end in it."""
        parts, rank = list(piece), self.rank
        while len(parts) > 2:
            best = where = None
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if where is None:
                return False
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        self.halves[piece] = (parts[0], parts[1])
        return True

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives these two: their merges are undone, the latest
        first, and at each state no merge over the border may come before the one undone."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self._remerge(left, right)
        return known

    def _remerge(self, left: str, right: str) -> bool:
        rank, halves = self.rank, self.halves
        bound = len(rank)
        while True:
            over = rank.get(left + right)
            if over is not None and over < bound:
                return False
            a, b = rank[left] if len(left) > 1 else -1, rank[right] if len(right) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:  # of equal merges the one further left came first, so an equal one over the border is later
                bound, left = a, halves[left][1]
            else:
                bound, right = b + 1, halves[right][0]

    def shorter(self, piece: str) -> str | None:
        """The longest piece that is a proper prefix of this one."""
        if piece not in self._shorter:
            self._shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.halves), None)
        return self._shorter[piece]

    # -- encoding

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a run of known characters."""
        longest = [0] * len(text)
        for end, size in self.automaton.iter(text):
            longest[end + 1 - size] = size  # ends come in order: the last one is the longest
        failed = bytearray(len(text) // 8 + 1)
        taken: list[str] = []
        at, piece, whole, known = 0, text[: longest[0]], len(text), self._pairs.get
        while at < whole:
            end = at + len(piece)
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = not taken or known((taken[-1], piece))
                if fits or fits is None and self.compatible(taken[-1], piece):
                    taken.append(piece)
                    at = end
                    if at < whole:
                        piece = text[at : at + longest[at]]
                    continue
            piece = self.shorter(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                piece = taken.pop()
                at -= len(piece)
        return taken

    def _run(self, text: str) -> list[int]:
        """The ids of a string: known runs by backtracking, other characters as byte pieces."""
        if self.characters.issuperset(text):
            return [self.id_of[p] for p in self.backtrack(text)]
        ids: list[int] = []
        start = 0
        for i, c in enumerate(text):
            if c not in self.id_of:
                if i > start:
                    ids += [self.id_of[p] for p in self.backtrack(text[start:i])]
                ids += [self.byte_id[b] for b in c.encode()]
                start = i + 1
        if start < len(text):
            ids += [self.id_of[p] for p in self.backtrack(text[start:])]
        return ids

    def spaces(self, n: int) -> list[int]:
        """The ids of n spaces: all their merges have one score, so the leftmost goes first."""
        ids = self._spaces.get(n)
        if ids is None:
            size = [1] * n
            before, after = list(range(-1, n - 1)), [*range(1, n), -1]
            heap = [(i, i + 1, 2) for i in range(n - 1) if SPACE * 2 in self.id_of]
            while heap:
                left, right, total = heapq.heappop(heap)
                if not size[left] or not size[right] or size[left] + size[right] != total or after[left] != right:
                    continue
                size[left], size[right] = total, 0
                after[left] = after[right]
                if after[left] >= 0:
                    before[after[left]] = left
                for x, y in ((before[left], left), (left, after[left])):
                    if x >= 0 and y >= 0 and SPACE * (size[x] + size[y]) in self.id_of:
                        heapq.heappush(heap, (x, y, size[x] + size[y]))
            ids = [self.id_of[SPACE * s] for s in size if s]
            if n <= 64:
                self._spaces[n] = ids
        return ids

    def _fresh(self, word: str, prefix: str) -> tuple[int, ...]:
        if "\n" in word and "\n" not in self.id_of:  # a character without a piece: both sides stand alone
            first, *rest = word.split("\n")
            newline = [self.byte_id[10]]
            ids = list(self.word(first) if prefix else self.bare(first))
            for line in rest:
                ids += newline
                ids += self.bare(line)
            return tuple(ids)
        if word[-1:] in ",." and len(word) > 1 and word[-2] not in ",.":  # if it can follow, the rest is as without it
            ids = self.word(word[:-1]) if prefix else self.bare(word[:-1])
            if self.pieces[ids[-1]] in self.rank and self.compatible(self.pieces[ids[-1]], word[-1]):
                return (*ids, self.id_of[word[-1]])
        return tuple(self._run(prefix + word))

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of one space and the word after it."""
        ids = self._words.get(word)
        if ids is None:
            ids = self._fresh(word, SPACE)
            if len(word) <= 64 and "\n" not in word:
                self._words[word] = ids
        return ids

    def bare(self, word: str) -> tuple[int, ...]:
        ids = self._bare.get(word)
        if ids is None:
            ids = self._fresh(word, "") if word else ()
            if len(word) <= 64 and "\n" not in word:
                self._bare[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if not text:
            return ids
        for memory in (self._words, self._bare, self._pairs):
            if len(memory) > MEMORY:
                memory.clear()
        words = text.replace(SPACE, " ").split(" ")
        if "" not in words:
            found = list(map(self._words.get, words))
            if None in found:
                for i, f in enumerate(found):
                    if f is None:
                        found[i] = self.word(words[i])
            return list(chain.from_iterable(found))
        known, add, run = self._words, ids.extend, 0
        for word in words:
            if not word:
                run += 1
            elif run:
                first = self.word(word)
                single = self.id_of[SPACE]
                if first[0] == single and len(first) > 1:
                    add(self.spaces(run + 1))
                    add(first[1:])
                else:
                    add(self.spaces(run))
                    add(first)
                run = 0
            else:
                found = known.get(word)
                add(self.word(word) if found is None else found)
        if run:
            add(self.spaces(run))
        return ids

    # -- decoding

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, spaces restored, the dummy prefix taken off; bytes that are no UTF-8 become U+FFFD, one each."""
        raw = b"".join(map(self.table.__getitem__, ids))
        if ids and self.pieces[ids[0]].startswith(SPACE):
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, at = [], 0
            while at < len(raw):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(raw[at : at + n].decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�")
                    at += 1
            return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_decode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; with_ids adds ids and decoded."""
    path = path or default_model()
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    @F.pandas_udf(schema)
    def both(texts: pd.Series) -> pd.DataFrame:
        codec = model(path)
        name, rows = codec.as_text.__getitem__, []
        for t in texts:
            ids = codec.encode(t)
            decoded = codec.decode(ids)
            row = (len(ids), hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
            rows.append(row + ((ids, decoded) if with_ids else ()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return keyed(docs, doc_id=doc_id, text=text).select("doc_id", both("text").alias("b")).select("doc_id", "b.*")
