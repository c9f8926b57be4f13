"""Minimizer sketches and sketch distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.seq import integer_hash
from strandloom.operators.buckets import bucket_pairs
from strandloom.session import ship

WORD, WINDOW = 15, 100

# Two-bit codes of letters; T and U are one letter.
_CODE = np.full(256, 4, dtype=np.uint8)
for _letters, _n in (("Aa", 0), ("Cc", 1), ("Gg", 2), ("TtUu", 3)):
    for _c in _letters:
        _CODE[ord(_c)] = _n


def invertible_hash(x: np.ndarray, mask: int) -> np.ndarray:
    """The hash of ``functions.seq.integer_hash`` on unsigned 64-bit arrays, for masks of any width."""
    m = np.uint64(mask)
    s = np.uint64
    x = (~x + (x << s(21))) & m
    x = x ^ (x >> s(24))
    x = (x + (x << s(3)) + (x << s(8))) & m
    x = x ^ (x >> s(14))
    x = (x + (x << s(2)) + (x << s(4))) & m
    x = x ^ (x >> s(28))
    return (x + (x << s(31))) & m


def word_hashes(seq: str, k: int = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the last letter, forward) of the canonical word of every window of k plain letters.

    A word equal to its own reverse complement has no direction and is left out.
    """
    code = _CODE[np.frombuffer(seq.encode("utf-8", "replace"), dtype=np.uint8)]
    n = len(code) - k + 1
    none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool)
    if n <= 0:
        return none
    there = np.zeros(n, dtype=np.uint64)
    back = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        letter = (code[i : i + n] & 3).astype(np.uint64)
        there = (there << np.uint64(2)) | letter
        back |= (np.uint64(3) - letter) << np.uint64(2 * i)
    bad = np.concatenate(([0], np.cumsum(code > 3)))
    ok = (bad[k:] == bad[:-k]) & (there != back)
    forward = there < back
    word = np.where(forward, there, back)
    at = np.flatnonzero(ok)
    return invertible_hash(word[at], (1 << (2 * k)) - 1), at + k - 1, forward[at]


def word_codes(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, place of the first letter) of every window of k plain letters as written, k at most 32."""
    code = _CODE[np.frombuffer(seq.encode("utf-8", "replace"), dtype=np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = (out << np.uint64(2)) | (code[i : i + n] & 3).astype(np.uint64)
    bad = np.concatenate(([0], np.cumsum(code > 3)))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    return out[at], at


def minimizers(seq: str | None, k: int = WORD, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, forward) of the least words of all stretches of w consecutive words; ties are all kept.

    A sequence with fewer words than a stretch has its least word as its sketch.
    """
    hashed, at, forward = word_hashes(seq or "", k)
    if not len(hashed):
        return hashed, at, forward
    if len(hashed) <= w:
        keep = hashed == hashed.min()
        return hashed[keep], at[keep], forward[keep]
    view = np.lib.stride_tricks.sliding_window_view(hashed, w)
    least = view.min(axis=1)
    edge = np.zeros(w - 1, dtype=np.uint64)
    chosen = np.lib.stride_tricks.sliding_window_view(np.concatenate((edge, least, edge)), w).max(axis=1)
    keep = chosen == hashed
    return hashed[keep], at[keep], forward[keep]


def sketch(sequences: DataFrame, key: str, seq: str, k: int = WORD, w: int = WINDOW) -> DataFrame:
    """key, value, locus, forward: the minimizers of each sequence; no shuffle.

    Sequences that are null or too short have none. Words with letters other than A, C, G, T, U are
    skipped.
    """
    ship(sequences.sparkSession)
    kind = sequences.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [minimizers(s.as_py(), k, w) for s in part.column(1)]
                rows = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                join = lambda i, t: np.concatenate([f[i] for f in found]).astype(t) if found else np.empty(0, t)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows)), pa.array(join(0, np.int64)), pa.array(join(1, np.int32)), pa.array(join(2, bool))],
                    names=[key, "value", "locus", "forward"],
                )

    return sequences.select(F.col(key), F.col(seq)).mapInArrow(run, f"`{key}` {kind}, value bigint, locus int, forward boolean")


def native_sketch(sequences: DataFrame, key: str, seq: str, k: int = WORD, w: int = WINDOW) -> DataFrame:
    """key, value: the same values for sequences of plain letters, by generators and windows of the engine."""
    digits = F.translate(F.upper(seq), "ACGTU", "01233")
    words = sequences.select(key, digits.alias("d"), F.posexplode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(seq) - k + 1))).alias("at", "p"))
    words = words.where(F.length("d") >= k).select(key, "at", F.substring("d", F.col("p"), F.lit(k)).alias("word"))
    code = lambda c: F.conv(c, 4, 10).cast("bigint")
    there, back = code(F.col("word")), code(F.reverse(F.translate("word", "0123", "3210")))
    hashed = words.where(there != back).select(key, "at", integer_hash(F.least(there, back), (1 << (2 * k)) - 1).alias("h"))
    order = Window.partitionBy(key).orderBy("at")
    numbered = hashed.withColumns({"r": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy(key))})
    least = numbered.withColumn("value", F.min("h").over(order.rowsBetween(1 - w, 0)))
    return least.where((F.col("r") >= w) | ((F.col("n") < w) & (F.col("r") == F.col("n")))).select(key, "value").distinct()


def sketch_distances(sketches: DataFrame, key: str, order: str | None = None, group: list[str] | None = None) -> DataFrame:
    """a, b, shared, distance for all a < b of a group: 1 - shared / size of the sketch of a.

    Pairs that share nothing are not listed; their distance is 1. The denominator is the sketch of the
    sequence that comes first in ``key`` order, so the measure is no Jaccard.
    """
    by = group or []
    values = sketches.select(*by, F.col(key).alias("k"), "value").dropna().distinct()
    sizes = values.groupBy(*by, "k").agg(F.count("*").alias("size"))
    # a minimizer of very many sequences is met part by part
    member = values.select(*by, "value", F.struct(*by, "k").alias("m"))
    pairs = bucket_pairs(member, [*by, "value"], "m", once=True, counted=True)
    shared = pairs.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.k").alias("a"), F.col("b.k").alias("b"), "shared")
    sized = shared.join(sizes.withColumnRenamed("k", "a"), [*by, "a"])
    return sized.select(*by, "a", "b", "shared", (1 - F.col("shared") / F.col("size")).alias("distance"))
