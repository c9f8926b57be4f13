"""Sequences as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 15 letters of nucleotide sequences, the gap, and their complements.
LETTERS, COMPLEMENTS = "ACGTYRWSKMDVHBN-", "TGCARYWSMKHBDVN-"


def complement(seq: Column) -> Column:
    return F.translate(seq, LETTERS, COMPLEMENTS)


def reverse_complement(seq: Column) -> Column:
    """The other strand; letters outside the alphabet stay as they are (validate first)."""
    return F.reverse(complement(seq))


def is_valid(seq: Column, gaps: bool = False, alphabet: str | None = None) -> Column:
    """Whether all letters belong to the alphabet; null stays null."""
    letters = alphabet if alphabet is not None else LETTERS[:15] + ("\\-" if gaps else "")
    return seq.rlike(f"^[{letters}]*$")


def checked(seq: Column, gaps: bool = False) -> Column:
    """The sequence, or an error that shows its beginning."""
    return F.when(is_valid(seq, gaps), seq).otherwise(F.raise_error(F.concat(F.lit("letter outside the alphabet in "), F.substring(seq, 1, 40))))


def rotate_left(seq: Column, k: Column) -> Column:
    n = F.length(seq)
    by = F.when(n > 0, F.pmod(k, n)).otherwise(0)
    return F.concat(seq.substr(by + 1, n), seq.substr(F.lit(1), by))


def rotate_right(seq: Column, k: Column) -> Column:
    return rotate_left(seq, -k)


def count_n(seq: Column, start: Column, end: Column) -> Column:
    """Number of N in [start, end)."""
    part = seq.substr(start + 1, end - start)
    return F.length(part) - F.length(F.replace(part, F.lit("N"), F.lit("")))


def integer_hash(x: Column, mask: int) -> Column:
    """Invertible hash of an integer within ``mask`` + 1 values, for masks below 2^31."""
    m = F.lit(mask).cast("bigint")
    x = x.cast("bigint")
    cut = lambda v: v.bitwiseAND(m)
    x = cut(cut(F.bitwise_not(x)) + F.shiftleft(x, 21))
    x = x.bitwiseXOR(F.shiftright(x, 24))
    x = cut(x + F.shiftleft(x, 3) + F.shiftleft(x, 8))
    x = x.bitwiseXOR(F.shiftright(x, 14))
    x = cut(x + F.shiftleft(x, 2) + F.shiftleft(x, 4))
    x = x.bitwiseXOR(F.shiftright(x, 28))
    return cut(x + F.shiftleft(x, 31))


def content_id(*parts: Column) -> Column:
    """An opaque 64-bit id of contents, as a decimal string."""
    return F.conv(F.hex(F.xxhash64(*parts)), 16, 10)


def describe(path_name: Column, block_id: Column, start: Column, end: Column, strand: Column) -> Column:
    """JSON description of a node in exports."""
    return F.to_json(
        F.struct(path_name.alias("path_name"), block_id.alias("block_id"), start.alias("start"), end.alias("end"), strand.alias("strand")),
        {"ignoreNullFields": "false"},
    )
