"""One consistent form for texts that look the same but are written with other characters.

``skeleton`` is the plain form: ignorable characters go, compatibility forms and accents are
composed, blanks become one kind of blank, and every letter drawn like an ASCII letter becomes that
letter. ``Canonical`` is the readable form: each token spans a lattice of all letters that its
letters could be meant as, and a Viterbi search takes the path that is most likely under character
n-grams of each script, with a high price for a change of script inside a token. So a Latin word
with smuggled Cyrillic letters becomes Latin, and a genuine Cyrillic word stays Cyrillic although
most of its letters have Latin twins.

Both forms make the same texts equal. A lattice is built from whole look-alike classes and thus
depends on the skeleton only, so equal skeletons give equal canonical forms; and a path never
leaves its classes, so equal canonical forms have equal skeletons.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.buckets import bucket_pairs, linked_pairs
from strandloom.session import cut_lineage, ship

# Letters of other scripts and alphabets that are drawn like an ASCII letter, script by script.
# Letters that are merely like one (Cyrillic ge and r, Greek sigma and o) are other letters here; a table that
# holds them too can be read from the public Unicode file.
CYRILLIC = {
    "a": "а", "c": "с", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "ј", "l": "ӏ", "o": "о", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵ",
    "w": "ԝ", "x": "х", "y": "уү", "A": "А", "B": "В", "C": "С", "E": "Е", "G": "Ԍ", "H": "Н", "I": "ІӀ", "J": "Ј", "K": "К", "M": "М", "O": "О", "P": "Р",
    "Q": "Ԛ", "S": "Ѕ", "T": "Т", "V": "Ѵ", "W": "Ԝ", "X": "Х", "Y": "Ү",
}
GREEK = {
    "c": "ϲ", "j": "ϳ", "o": "ο", "p": "ρ", "v": "ν", "A": "Α", "B": "Β", "C": "Ϲ", "E": "Ε", "F": "Ϝ", "H": "Η",
    "I": "Ι", "J": "Ϳ", "K": "Κ", "M": "ΜϺ", "N": "Ν", "O": "Ο", "P": "Ρ", "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ",
}
ARMENIAN = {"h": "հ", "n": "ո", "o": "օ", "u": "ս", "O": "Օ", "S": "Տ", "U": "Ս"}
CHEROKEE = {
    "b": "Ꮟ", "c": "ꮯ", "d": "Ꮷ", "h": "Ꮒ", "i": "Ꭵꭵ", "s": "ꮪ", "v": "ꮩ", "w": "ꮃ", "z": "ꮓ", "A": "Ꭺ", "B": "Ᏼ", "C": "Ꮯ", "D": "Ꭰ", "E": "Ꭼ",
    "G": "ᏀᏳ", "H": "Ꮋ", "J": "Ꭻ", "K": "Ꮶ", "L": "Ꮮ", "M": "Ꮇ", "P": "Ꮲ", "R": "ᎡᏒ", "S": "ᏕᏚ", "T": "Ꭲ", "U": "Ꮜ", "V": "Ꮩ", "W": "ᎳᏔ", "Y": "ᎩᎽ", "Z": "Ꮓ",
}
LISU = {
    "d": "ꓒ", "A": "ꓮ", "B": "ꓐ", "C": "ꓚ", "D": "ꓓ", "E": "ꓰ", "F": "ꓝ", "G": "ꓖ", "H": "ꓧ", "I": "ꓲ", "J": "ꓙ", "K": "ꓗ", "L": "ꓡ", "M": "ꓟ", "N": "ꓠ",
    "O": "ꓳ", "P": "ꓑ", "R": "ꓣ", "S": "ꓢ", "T": "ꓔ", "U": "ꓴ", "V": "ꓦ", "W": "ꓪ", "X": "ꓫ", "Y": "ꓬ", "Z": "ꓜ",
}
COPTIC = {
    "c": "ⲥ", "o": "ⲟ", "p": "ⲣ", "B": "Ⲃ", "C": "Ⲥ", "H": "Ⲏ", "I": "Ⲓ", "K": "Ⲕ", "M": "Ⲙ", "N": "Ⲛ", "O": "Ⲟ", "P": "Ⲣ", "T": "Ⲧ", "X": "Ⲭ", "Y": "Ⲩ", "Z": "Ⲍ",
}
LATIN = {"a": "ɑ", "c": "ᴄ", "g": "ɡ", "o": "ᴏ", "s": "ꜱ", "u": "ᴜ", "v": "ᴠ", "w": "ᴡ", "z": "ᴢ"}

SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "cherokee", "lisu", "coptic")
#: All of them: ASCII letter to the letters drawn like it.
LOOKALIKES: dict[str, str] = {}
for _table in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC, LATIN):
    for _letter, _others in _table.items():
        LOOKALIKES[_letter] = LOOKALIKES.get(_letter, "") + _others


def read_confusables(lines: Iterable[str]) -> dict[str, str]:
    """A look-alike table from lines of the public Unicode file of confusable characters.

    Only letters whose prototype is one ASCII letter are taken. The result goes into ``use_table``.
    """
    table: dict[str, str] = {}
    for line in lines:
        fields = [f.strip() for f in line.lstrip("\ufeff").split("#")[0].split(";")]
        if len(fields) < 2 or " " in fields[0] or " " in fields[1] or not fields[1]:
            continue
        letter, prototype = chr(int(fields[0], 16)), chr(int(fields[1], 16))
        if prototype.isascii() and prototype.isalpha() and not letter.isascii() and unicodedata.category(letter)[0] == "L":
            table[prototype] = table.get(prototype, "") + letter
    return table


TO_ASCII = {ord(x): a for a, others in LOOKALIKES.items() for x in others}
#: Those that a compatibility form would make another letter of: they are looked at before.
FIRST = {c: a for c, a in TO_ASCII.items() if unicodedata.normalize("NFKC", chr(c)) != chr(c)}
#: All letters of a class, by the ASCII letter that stands for it; that letter first.
CLASS = {a: a + others for a, others in LOOKALIKES.items()}


def use_table(table: dict[str, str]) -> None:
    """Adds look-alikes to the table, in this process: call it before the package is shipped."""
    for a, others in table.items():
        new = "".join(x for x in others if ord(x) not in TO_ASCII)
        CLASS[a] = CLASS.get(a, a) + new
        TO_ASCII.update((ord(x), a) for x in new)
        FIRST.update((ord(x), a) for x in new if unicodedata.normalize("NFKC", x) != x)


_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_SPACES = regex.compile(r"\p{Zs}")
# A run of letters and marks that isn't all ASCII; possessive, so that long runs are passed once.
_TOKEN = regex.compile(r"(?<![\p{L}\p{M}])[A-Za-z]*+(?=[^\x00-\x7f])[\p{L}\p{M}]++")
# Divides a text into what lies between such runs (even places) and the runs (odd places).
_PARTS = regex.compile(f"({_TOKEN.pattern})")

# Prices of the search, in nats.
SCRIPT_CHANGE = 12.0
UNSEEN = 9.0
#: A token that begins in another script than Latin.
OTHER_START = 0.1
#: Readings of tokens up to this length are remembered, this many of them.
REMEMBERED_LETTERS, REMEMBERED_TOKENS = 64, 100_000

_ASCII_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Number of an ASCII letter by its byte, from 1; 0 for all other bytes. A pair of them is a number under PAIR_CODES.
_LETTER_CODE = np.zeros(256, np.int64)
_LETTER_CODE[list(_ASCII_LETTERS.encode())] = range(1, 53)
PAIR_CODES = 53 * 53
#: Bytes of a text whose pairs are numbered at once; the text is read to its end piece by piece.
PIECE = 1 << 20


def fold(text: str) -> str:
    """Compatibility and accent forms made one, ignorable characters dropped, blanks made plain."""
    text = unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))
    return _SPACES.sub(" ", _IGNORABLE.sub("", text))


def skeleton(text: str) -> str:
    """The plain form; ASCII texts are their own skeleton."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", fold(text.translate(FIRST)).translate(TO_ASCII))


@lru_cache(maxsize=1 << 16)
def script_of(letter: str) -> str:
    """Script of a letter by the first word of its name, as far as the search tells scripts apart."""
    script = unicodedata.name(letter, "").split(" ")[0].lower()
    return script if script in SCRIPTS else "other"


class Canonical:
    """The search over look-alike lattices, with n-gram counts of letter pairs inside tokens."""

    def __init__(self, pairs: dict[str, int]):
        first, total = Counter(), Counter()
        for pair, n in pairs.items():
            first[pair[0]] += n
            total[script_of(pair[0])] += n
        # a pair that was seen never costs more than one that wasn't, however large the table
        self.price = {p: min(UNSEEN, math.log(first[p[0]] + 64) - math.log(n + 0.5)) for p, n in pairs.items()}
        # the first letter of a token costs by its share of the letters of its script, so that what follows a rare twin weighs little
        self.start = {c: min(UNSEEN, math.log(total[script_of(c)] + 64) - math.log(n + 0.5)) for c, n in first.items()}
        self.memory: dict[str, str] = {}

    def token(self, token: str) -> str:
        """The most likely reading of a token given by its skeleton.

        A skeleton all in ASCII has a reading all in Latin, which no n-gram of another script may
        outweigh: it is taken without a search, so ASCII texts are their own canonical form.
        """
        if token.isascii():
            return token
        known = self.memory.get(token)
        if known is None:
            known = self._search(token)
            if len(token) <= REMEMBERED_LETTERS and len(self.memory) < REMEMBERED_TOKENS:
                self.memory[token] = known
        return known

    def _search(self, token: str) -> str:
        """Viterbi over the lattice: the cheapest path to every letter of every place, then back along it."""
        before: dict[str, float] = {}
        steps: list[dict[str, str]] = []
        for c in token:
            mark = unicodedata.category(c)[0] == "M"
            here, step = {}, {}
            for x in c if mark else CLASS.get(c, c):
                script = script_of(x)
                best, back = self.start.get(x, UNSEEN) + (0.0 if script in ("latin", "other") else OTHER_START), ""
                if before:
                    best = math.inf
                    for y, price in before.items():
                        price += self.price.get(y + x, UNSEEN)
                        if not mark and script_of(y) != script:
                            price += SCRIPT_CHANGE
                        if price < best:  # ties: the letter named first in its class
                            best, back = price, y
                here[x], step[x] = best, back
            before = here
            steps.append(step)
        letter = min(before, key=before.get)
        path = []
        for step in reversed(steps):
            path.append(letter)
            letter = step[letter]
        return "".join(reversed(path))

    def text(self, text: str) -> str:
        """The canonical form of a text."""
        if text.isascii():
            return text
        return _TOKEN.sub(lambda m: self.token(m.group()), skeleton(text))

    def readings(self, text: str) -> tuple[str, int, int]:
        """(canonical form, tokens with letters outside ASCII, those of them that are read otherwise than written)."""
        form, written = self.text(text), _TOKEN.findall(fold(text))
        return form, len(written), sum(self.token(skeleton(t)) != unicodedata.normalize("NFC", t) for t in written)


def _ascii_pairs(text: bytes) -> np.ndarray:
    """How often each pair of ASCII letters stands side by side; pairs with another byte are under the codes that hold a 0."""
    counts = np.zeros(PAIR_CODES, np.int64)
    for at in range(0, len(text), PIECE):
        codes = _LETTER_CODE[np.frombuffer(text[at : at + PIECE + 1], np.uint8)]
        counts += np.bincount(codes[:-1] * 53 + codes[1:], minlength=PAIR_CODES)
    return counts


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter pairs inside runs of letters that are written in one script, of each batch; runs all in ASCII are Latin."""
    for batch in batches:
        pairs: Counter = Counter()
        tokens: Counter = Counter()
        ascii_pairs = np.zeros(PAIR_CODES, np.int64)
        for t in batch.column(0):
            if (text := t.as_py()) is None:
                continue
            if not text.isascii():
                parts = _PARTS.split(fold(text))
                tokens.update(parts[1::2])
                text = " ".join(parts[::2])
            ascii_pairs += _ascii_pairs(text.encode())
        for code in np.flatnonzero(ascii_pairs):
            a, b = divmod(int(code), 53)
            if a and b:
                pairs[_ASCII_LETTERS[a - 1] + _ASCII_LETTERS[b - 1]] = int(ascii_pairs[code])
        for token, n in tokens.items():
            scripts = {script_of(c) for c in token if unicodedata.category(c)[0] == "L"}
            if len(scripts) == 1 and scripts != {"other"}:
                for a, b in zip(token, token[1:], strict=False):
                    pairs[a + b] += n
        yield pa.RecordBatch.from_pydict({"pair": list(pairs), "n": list(pairs.values())}, schema=pa.schema([("pair", pa.string()), ("n", pa.int64())]))


def fit_ngrams(docs: DataFrame, text: str = "text") -> Canonical:
    """Letter-pair counts over all texts, plain ASCII ones included: most of what Latin words look like stands there.

    What comes to the driver is a table of pairs of letters of one of SCRIPTS: by the numbers of their
    letters (about 1,400 Latin ones, fewer of each other) at most some 3 million, a few thousand in
    practice, whatever the corpus.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(text)).mapInArrow(_count_pairs, "pair string, n bigint")
    return Canonical({r["pair"]: r["n"] for r in rows.groupBy("pair").agg(F.sum("n").alias("n")).collect()})


def canonical_column(docs: DataFrame, key: str, text: str, model: Canonical) -> DataFrame:
    """``key``, ``form`` of every row; null stays null and empty stays empty. ASCII rows never leave the JVM."""
    ship(docs.sparkSession)
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text).alias("form"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [shared.value.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string())], names=[key, "form"])

    other = F.col("form").rlike("[^\\x00-\\x7F]")
    return rows.where(other.isNull() | ~other).unionByName(
        rows.where(other).mapInArrow(run, f"`{key}` {key_type}, form string")
    )


def canonical_forms(docs: DataFrame, key: str, text: str, model: Canonical | None = None) -> DataFrame:
    """key, form, n_tokens, n_mended of the rows with letters outside ASCII.

    ``form`` is the most likely reading of the text; ``n_tokens`` counts its tokens with letters outside
    ASCII, ``n_mended`` those that the search reads otherwise than they are written.

    Defined results: rows with null, empty or plain ASCII texts aren't listed, since they are their own
    form; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.where(F.col(text).rlike("[^\\x00-\\x7F]")).select(F.col(key), F.col(text))
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_ngrams(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.readings(t.as_py()) for t in batch.column(1)]
            forms, tokens, mended = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forms, pa.string()), pa.array(tokens, pa.int64()), pa.array(mended, pa.int64())], names=[key, "form", "n_tokens", "n_mended"])

    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, form string, n_tokens bigint, n_mended bigint")


def lookalike_pairs(docs: DataFrame, key: str, text: str, model: Canonical | None = None) -> DataFrame:
    """Pairs (doc_a < doc_b) of rows whose texts differ as stored but have one canonical form.

    Texts are compared by SHA-256 of the form and of the stored text. Equal stored texts are made
    one before forms are joined, so a crowd of copies is joined once and only its result rows are
    written. Forms held by ASCII texts alone are dropped first: two ASCII texts are never look-alikes.

    Defined results: null and empty texts are no cases; rows with a null key are left out; a key
    that occurs twice with one text counts once; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("doc"), F.col(text).alias("text"))
    model = model or fit_ngrams(rows)
    other = rows.where(F.col("text").rlike("[^\\x00-\\x7F]"))
    raw = other.select(F.struct("doc", F.sha2("text", 256).alias("raw")).alias("id"), "text")
    forms = canonical_column(raw, "id", "text", model).select(
        "id.doc", "id.raw", F.sha2("form", 256).alias("form"), F.lit(True).alias("changed")
    )
    forms = cut_lineage(forms.where(F.length("form") > 0))
    plain = rows.where(~F.col("text").rlike("[^\\x00-\\x7F]")).select("doc", F.sha2("text", 256).alias("raw"))
    plain = plain.select("doc", "raw", F.col("raw").alias("form"))
    # ASCII texts matter where their form is also the form of another text
    plain = plain.join(forms.select("form").distinct(), "form", "left_semi")
    members = forms.select("doc", "raw", "form").unionByName(plain.select("doc", "raw", "form")).distinct()
    classes = members.select("form", "raw").distinct()
    many = classes.groupBy("form").count().where(F.col("count") > 1).select("form")
    members = cut_lineage(members.join(many, "form", "left_semi"))
    # a text has one form, so classes and their pairs are distinct as they come; crowds of copies meet part by part
    classes = members.select("form", "raw").distinct()
    linked = cut_lineage(bucket_pairs(classes, ["form"], "raw", apart=True, once=True))
    pairs = linked_pairs(linked, "a", "b", members, "raw", "doc").where(F.col("x") != F.col("y"))
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
