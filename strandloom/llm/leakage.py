"""Passages of evaluation items inside a training corpus, by suffix arrays over shards of the corpus.

Texts become sequences of words, words become 64-bit codes. A shard is one batch of corpus rows; its
suffix array holds the word positions in order of the words that follow, ``WORDS`` deep. Every
suffix of every item is looked up by binary search, which narrows an interval of the array word by
word; what is left after ``WORDS`` words are the places of verbatim matches, and matches that can't
be extended to the left are followed to their full length.

Only positions whose first three words begin some item suffix are put into a shard's array: no
search would ever enter the part left out. Shards are independent, so the corpus is never shuffled;
only (document, item) hits are.

The items are the query side. They are taken in blocks of bounded size, each of which goes once over
the corpus, so what is sent to the executors at a time stays bounded however many items there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.lookalike import skeleton
from strandloom.session import cut_lineage, ship

#: Consecutive words in common that make a case.
WORDS = 13
#: Words that decide whether a corpus position enters the suffix array.
OPENING = 3
#: Bytes of item texts in one block.
BLOCK_BYTES = 8 << 20
#: Bytes of corpus text coded at a time.
CHUNK = 2 << 20
BITMAP_BITS = 22
#: Matched places that are looked at together, and blocks of items that go over the corpus together.
PLACES, BLOCKS = 1 << 20, 8

_LETTERS = np.zeros(256, dtype=np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789_":
    _LETTERS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _LETTERS[_c] = _c + 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def normal_bytes(text: str | None) -> bytes:
    """A text in its consistent form, as bytes; letters outside ASCII separate words."""
    if not text:
        return b""
    return text.encode() if text.isascii() else skeleton(text).lower().encode("utf-8")


@dataclass
class Words:
    """Words of a run of texts: code, first and last byte, and number of the text of each."""

    buffer: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray

    def spell(self, first: int, n: int) -> list[bytes]:
        return [self.buffer[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n], strict=True)]


def words_of(texts: list[bytes]) -> Words:
    """Words of all texts; a word never spans two texts."""
    joined = b"\n".join(texts)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    letters = _LETTERS[np.frombuffer(joined, dtype=np.uint8)]
    inside = np.empty(len(letters) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = letters != 0
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    codes = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        # words are coded in stretches of about CHUNK bytes; a longer word is a stretch of its own
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK, side="right")))
        low, high = starts[at], ends[to - 1]
        place = np.arange(high - low, dtype=np.int64) - np.repeat(
            starts[at:to] - low, np.diff(np.append(starts[at:to], high))
        )
        terms = (letters[low:high].astype(np.uint64) + np.uint64(1)) * _mix((place.astype(np.uint64) + np.uint64(1)) * _BASE)
        terms[letters[low:high] == 0] = 0
        codes[at:to] = np.add.reduceat(terms, starts[at:to] - low)
        at = to
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    return Words(letters, _mix(codes), starts, ends, owner)


def _openings(codes: np.ndarray) -> np.ndarray:
    """A code of the first words of every suffix that has that many."""
    n = max(0, len(codes) - OPENING + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(OPENING):
        out = _mix(out * _BASE + codes[i : i + n])
    return out


def _suffixes(words: Words) -> np.ndarray:
    """Positions with at least WORDS words left in their own text."""
    n = len(words.codes) - WORDS + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(words.owner[:n] == words.owner[WORDS - 1 :])


def _bitmap(openings: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << BITMAP_BITS, dtype=bool)
    bits[(openings >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
    return bits


class Items:
    """The suffixes of a block of items."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.words = words_of([normal_bytes(t) for t in texts])
        self.at = _suffixes(self.words)
        self.openings = np.unique(_openings(self.words.codes)[self.at]) if len(self.at) else np.empty(0, np.uint64)
        self.bitmap = _bitmap(self.openings)


def suffix_array(words: Words, items: Items) -> np.ndarray:
    """Positions of the shard in order of the WORDS words at each, of those that an item could open."""
    at = _suffixes(words)
    if not len(at) or not len(items.openings):
        return np.empty(0, dtype=np.int64)
    opening = _openings(words.codes)[at]
    at = at[items.bitmap[(opening >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]]
    if not len(at):
        return at
    opening = _openings(words.codes)[at] if len(at) < len(opening) // 4 else opening[items.bitmap[(opening >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)]]
    found = np.searchsorted(items.openings, opening)
    at = at[items.openings[np.minimum(found, len(items.openings) - 1)] == opening]
    return at[np.lexsort([words.codes[at + d] for d in range(WORDS - 1, -1, -1)])]


def _bisect(column: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, after: bool) -> np.ndarray:
    """For each i the first place in column[low[i]:high[i]], which is sorted, not before (or after) key[i]."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        value = column[np.minimum(middle, len(column) - 1)]
        right = open_ & ((value <= key) if after else (value < key))
        low = np.where(right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)


def matches(words: Words, array: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item position, low, high): the stretch of the suffix array that begins with the WORDS words at each item position."""
    live = items.at if len(array) else items.at[:0]
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(array), dtype=np.int64)
    for d in range(WORDS):
        if not len(live):
            break
        column, key = words.codes[array + d], items.words.codes[live + d]
        low, high = _bisect(column, low, high, key, False), _bisect(column, low, high, key, True)
        keep = low < high
        live, low, high = live[keep], low[keep], high[keep]
    return live, low, high


def _runs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, place) of all places of the stretches [low, high), so many at a time; a stretch may be divided."""
    sizes = high - low
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    for first in range(0, total, PLACES):
        n = np.arange(first, min(first + PLACES, total))
        which = np.searchsorted(ends, n, side="right")
        yield which, low[which] + n - (ends - sizes)[which]


def search(words: Words, array: np.ndarray, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(corpus position, item position) of all verbatim matches of WORDS words, so many at a time."""
    live, low, high = matches(words, array, items)
    for which, place in _runs(low, high):
        yield array[place], live[which]


def owners(words: Words, array: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(text, item) that have WORDS words in common.

    Stretches of the array for different words don't overlap, so the texts of all stretches are as many
    as the array is long, however often a passage is repeated; of each stretch only distinct texts and
    items are combined. The words of a pair are compared letter by letter.
    """
    live, low, high = matches(words, array, items)
    found: set[tuple[int, int]] = set()
    if not len(live):
        return found
    stretch, first, of = np.unique(low, return_index=True, return_inverse=True)
    distinct = lambda owner, part: np.unique(part * (int(owner.max()) + 1) + owner, return_index=True)[1]
    item = items.words.owner[live]
    mine = distinct(item, of)
    texts = []
    for which, place in _runs(stretch, high[first]):
        keep = distinct(words.owner[array[place]], which)
        texts.append((which[keep], array[place[keep]]))
    part, here = np.concatenate([t[0] for t in texts]), np.concatenate([t[1] for t in texts])
    # each text of a stretch meets each item of it
    order = mine[np.argsort(of[mine], kind="stable")]
    begin, end = np.searchsorted(of[order], part, "left"), np.searchsorted(of[order], part, "right")
    for which, place in _runs(begin, end):
        i, j = here[which], live[order[place]]
        pair = words.owner[i].astype(np.int64) * (len(items.ids) + 1) + items.words.owner[j]
        for t in np.unique(pair, return_index=True)[1].tolist():
            key = (int(words.owner[i[t]]), int(items.words.owner[j[t]]))
            if key in found:
                continue
            if words.spell(int(i[t]), WORDS) == items.words.spell(int(j[t]), WORDS):
                found.add(key)
                continue
            for u in np.flatnonzero(pair == pair[t]).tolist():  # equal codes of different words: another place may do
                if words.spell(int(i[u]), WORDS) == items.words.spell(int(j[u]), WORDS):
                    found.add(key)
                    break
    return found


def longest(words: Words, items: Items, here: np.ndarray, there: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, word, item word, words) of every match that extends on neither side; spelled out and compared."""
    own, other = words, items.words
    before_here, before_there = np.maximum(here - 1, 0), np.maximum(there - 1, 0)
    extends = (
        (here > 0) & (there > 0)
        & (own.owner[before_here] == own.owner[here]) & (other.owner[before_there] == other.owner[there])
        & (own.codes[before_here] == other.codes[before_there])
    )
    for i, j in zip(here[~extends].tolist(), there[~extends].tolist(), strict=True):
        a = int(np.searchsorted(own.owner, own.owner[i], side="right")) - i
        b = int(np.searchsorted(other.owner, other.owner[j], side="right")) - j
        n = min(a, b)
        differ = np.flatnonzero(own.codes[i : i + n] != other.codes[j : j + n])
        n = int(differ[0]) if len(differ) else n
        if n >= WORDS and own.spell(i, n) == other.spell(j, n):
            yield int(own.owner[i]), int(other.owner[j]), int(i - np.searchsorted(own.owner, own.owner[i])), int(j - np.searchsorted(other.owner, other.owner[j])), n


def _shards(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of a batch in shards of a few chunks of text; a text is never divided."""
    first, texts, size = 0, [], 0
    for i, t in enumerate(batch.column(1)):
        text = normal_bytes(t.as_py())
        if texts and size + len(text) > 4 * CHUNK:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(text)
        size += len(text)
    if texts:
        yield first, texts


def _blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES of text."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total * 2 // BLOCK_BYTES))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        rows = part.collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


PASSAGES = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint"
PAIRS = "doc_id bigint, item_id bigint"


def _passages(words: Words, block: Items) -> list[tuple]:
    found = search(words, suffix_array(words, block), block)
    return [(doc, block.ids[item], at, item_at, n) for here, there in found for doc, item, at, item_at, n in longest(words, block, here, there)]


def _pairs(words: Words, block: Items) -> list[tuple]:
    return [(doc, block.ids[item]) for doc, item in sorted(owners(words, suffix_array(words, block), block))]


def _scan(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, text: str, look, schema: str) -> DataFrame:
    """What ``look`` finds in each shard for each block of items; the corpus is read once for BLOCKS blocks."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(F.col(doc_key).isNotNull()).select(F.col(doc_key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    wanted = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    names = [f.split()[0] for f in schema.split(", ")]
    found, held = None, []

    def over(held: list) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0)
                for first, texts in _shards(batch):
                    words = words_of(texts)
                    for shared in held:
                        if hits := look(words, shared.value):
                            columns = list(zip(*hits, strict=True))
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + d for d in columns[0]])), *[pa.array(c, pa.int64()) for c in columns[1:]]], names=names)

        # stored at once, so that the blocks needn't stay with the executors
        part = cut_lineage(rows.mapInArrow(run, schema))
        for shared in held:
            shared.destroy()
        return part

    for block in _blocks(wanted):
        held.append(spark.sparkContext.broadcast(block))
        if len(held) == BLOCKS:
            part, held = over(held), []
            found = part if found is None else found.unionByName(part)
    if held:
        part = over(held)
        found = part if found is None else found.unionByName(part)
    return found


def leaked_passages(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Every maximal passage of at least WORDS words that a document and an item share.

    Defined results: null and empty texts, texts of fewer words, and rows with a null key share
    nothing; repeated rows give repeated passages; very long texts are searched whole; empty tables
    give no rows; other columns are ignored.
    """
    return _scan(docs, items, doc_key, item_key, text, _passages, PASSAGES)


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Each document and item that share at least WORDS consecutive words, once. Defined results as for passages."""
    return _scan(docs, items, doc_key, item_key, text, _pairs, PAIRS).distinct()


def clean_corpus(docs: DataFrame, leaked: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The corpus without the documents that leak any item."""
    return docs.join(leaked.select(F.col("doc_id").alias(doc_key)).distinct(), doc_key, "left_anti")
