"""Token ids of whole texts by byte-pair encoding, exact, without running merges.

Each pre-token of a text is encoded by dynamic programming over its prefixes. All vocabulary tokens
that end at a position come from a suffix-matching automaton over the vocabulary; exactly one of
them can be the last token of the encoding of that prefix, namely the one whose pair with the last
token of the prefix before it is compatible: no merge of the greedy procedure would have crossed
their border. That last token is stored for every prefix, and the ids are read off backwards.

Pre-tokens repeat very often, so each Python worker remembers the ids of short ones; the memory is
only a cache of bounded size and decides nothing.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import ship

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

# The white space of the pre-token pattern, and the pattern itself for all texts and for ASCII.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_PATTERN = (
    r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

#: Pre-tokens longer than this are not remembered, and this many are remembered at most.
CACHED_CHARS, CACHED_WORDS = 40, 400_000


class Encoder:
    """Ids of texts by one vocabulary of ranked byte tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: t for t, r in self.rank.items()}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, r in self.rank.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.size = {r: len(t) for t, r in self.rank.items()}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], bool] = {}
        self.reachable: dict[int, bool] = {}

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes and tokens no merge makes."""
        if rank not in self.halves:
            parts = [self.rank[bytes([b])] for b in self.token[rank]] if self.size[rank] > 1 else []
            while len(parts) > 2:
                best, at = rank, -1
                for i in range(len(parts) - 1):
                    r = self.rank.get(self.token[parts[i]] + self.token[parts[i + 1]], rank)
                    if r < best:
                        best, at = r, i
                if at < 0:
                    break
                parts[at : at + 2] = [best]
            self.halves[rank] = tuple(parts) if len(parts) == 2 else None
        return self.halves[rank]

    def _reachable(self, rank: int) -> bool:
        """Whether any merge makes this token at all."""
        alive = self.reachable[rank] = self.size[rank] == 1 or self._halves(rank) is not None
        return alive

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` may stand side by side in an encoding.

        Undoes the merges of both tokens, latest first, and looks whether the pieces at the border
        would have been merged with each other before the next merge on either side took place.
        """
        key = (left, right)
        known = self.joined.get(key)
        if known is None:
            known = self._compatible(left, right)
            if len(self.joined) < 4_000_000:
                self.joined[key] = known
        return known

    def _compatible(self, left: int, right: int) -> bool:
        done_left = done_right = 1 << 60  # the rank of the merge that ends the life of each border piece
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            # of equal ranks the leftmost merge comes first: a merge across precedes one inside the right token
            if across is not None and across < done_left and across <= done_right:
                return False
            a, b = self._halves(left), self._halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                done_left, left = left, a[1]
            elif a is None or right > left:
                done_right, right = right, b[0]
            else:  # equal tokens: the merge inside the right one is the later of the two
                done_right, right = right, b[0]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        whole = self.rank.get(word)
        if whole is not None and self._reachable(whole):
            return (whole,)
        n = len(word)
        last = [-1] * (n + 1)
        size, joined, reachable = self.size, self.joined, self.reachable
        for end, rank in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size[rank]
            if start:
                before = last[start]
                if before < 0:
                    continue
                fits = joined.get((before, rank))
                if fits is None:
                    fits = self.compatible(before, rank)
                if not fits:
                    continue
            alive = reachable.get(rank)
            if alive if alive is not None else self._reachable(rank):
                last[end] = rank
        ids = []
        while n:
            ids.append(last[n])
            n -= size[last[n]]
        return tuple(reversed(ids))


class _Words(dict):
    """Ids of pre-tokens as packed 32-bit integers, computed when first met."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encoder.encode_word(word.encode("utf-8")), dtype=np.int32).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(Encoder(path))


_ASCII = re.compile(ASCII_PATTERN)
_ANY = regex.compile(PATTERN)
#: Long texts are cut into pieces of about so many characters, so that one text's words never lie in memory at once.
PIECE = 1 << 20


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end where a word character is followed by a blank: no pre-token spans such a border.

    A pre-token holds a blank only at its start or among blanks, so a cut between a non-blank and a
    blank is safe.
    """
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut < len(text) and not (text[cut] in " \n" and not text[cut - 1].isspace()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def encode_text(text: str | None, words: _Words) -> bytes:
    """The ids of a text as packed 32-bit integers."""
    if not text:
        return b""
    find, get = (_ASCII if text.isascii() else _ANY).findall, words.__getitem__
    if len(text) <= PIECE:
        return b"".join(map(get, find(text)))
    return b"".join(b"".join(map(get, find(p))) for p in _pieces(text))


#: Rows encoded before a batch of ids is handed on.
ROWS_OUT = 512


def encode_column(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ``ids`` ARRAY<INT> of every row, without special tokens; no shuffle.

    Defined results: null and empty texts give an empty list; text that looks like a special token
    is ordinary text; repeated rows and null keys stay as they are; very long texts are encoded
    whole, piece by piece; other columns are ignored; an empty table gives no rows.
    """
    ship(df.sparkSession)
    path = path or os.path.join(TOKENIZERS, VOCABULARY)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                ids = [encode_text(t.as_py(), words) for t in part.column(1)]
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
                values = np.frombuffer(b"".join(ids), dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    return df.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")
