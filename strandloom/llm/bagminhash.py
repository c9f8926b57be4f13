"""Near-duplicate records by BagMinHash: weighted-Jaccard signatures, bands, exact verification.

A record is a bag of its k-letter windows. Every element carries Poisson processes whose points are
a function of the element alone: one process for each octave (2^j, 2^(j+1)] of the weight axis (and
one for (0, 1]), whose rate is the octave's length. A point has a time, a signature slot, and a
place inside its octave, read off by halving the octave until it is clear on which side of the
element's weight the point lies. The signature keeps in each slot the element and point of the
earliest time among the points below the weights, so two records agree in a slot with probability
sum(min) / sum(max) of their weights. Points are drawn in order of time and an element stops as soon
as its next point is later than the latest slot, so the cost is about one or two points an element.

Records whose letters are the same are made one before anything is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.buckets import bucket_pairs, linked_pairs
from strandloom.session import cut_lineage, ship

#: Letters of a window, and the least similarity of a pair.
WINDOW, SIMILARITY = 16, 0.5
#: Slots of a signature, slots of a band, and bands that a candidate has in common. A pair at similarity 0.5
#: is missed with the probability of fewer than 2 of 64 bands at 0.5^2 each, 2e-7; of pairs at similarity 0.1,
#: 13 % are candidates.
SLOTS, BAND, COMMON = 128, 2, 2
#: Windows of which signatures are computed together, and windows of records that verification remembers.
TOGETHER, REMEMBERED = 1 << 19, 1 << 22

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i
for _i, _c in enumerate(b"acgt"):
    _CODE[_c] = _i

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(seq: str | None, k: int = WINDOW) -> np.ndarray:
    """Codes of all windows of k letters A, C, G, T, two bits a letter (k at most 32)."""
    return _windows([seq], k)[0]


def _windows(seqs: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sequence) of the windows of all sequences, in order; no window spans two of them."""
    texts = [(s or "").encode("utf-8", "replace") for s in seqs]
    code = _CODE[np.frombuffer(b"\n".join(texts), dtype=np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    have, width, out, done = code.astype(np.uint64), 1, None, 0
    while True:  # words of k letters by doubling
        if k & width:
            m = len(code) - done - width + 1
            out = have[:m] if out is None else (out[:m] << np.uint64(2 * width)) | have[done : done + m]
            done += width
        if width * 2 > k:
            break
        have = (have[:-width] << np.uint64(2 * width)) | have[width:]
        width *= 2
    bad = np.concatenate(([0], np.cumsum(code > 3, dtype=np.int32)))
    at = np.flatnonzero(bad[k:] == bad[:-k])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return out[at], np.searchsorted(ends, at, side="right")


def bag(seq: str | None, weighted: bool, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows and their weights: their number, or 1 each for plain sets."""
    values, counts = np.unique(windows(seq, k), return_counts=True)
    return values, (counts if weighted else np.ones_like(counts)).astype(np.float64)


def _weights(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, owner, weight): equal windows of one owner made one element of their number."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])))) if len(values) else np.empty(0, np.int64)
    return values[first], owner[first], np.diff(np.append(first, len(values))).astype(np.float64)


def signature(values: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signature: of each slot the hash of its earliest point; zeros for an empty bag."""
    return signatures(values, weights, np.zeros(len(values), dtype=np.int64), 1, slots)[0]


def signatures(values: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """The signatures of ``n`` bags at once; ``owner`` names the bag of each element, which may repeat."""
    times = np.full(n * slots, np.inf)
    marks = np.full(n * slots, _NONE)
    if not len(values):
        return np.zeros((n, slots), dtype=np.uint64)
    top = max(0, int(np.ceil(np.log2(max(1.0, float(weights.max()))))))
    for octave in range(top + 1):
        low, high = (0.0, 1.0) if octave == 0 else (2.0 ** (octave - 1), 2.0**octave)
        take = weights > low
        seeds = _mix(values[take] * _GOLD + np.uint64(octave + 1))
        inside, bags = weights[take], owner[take]
        at = np.zeros(len(seeds))
        step = 0
        while len(seeds):
            step += 1
            draw = _mix(seeds + np.uint64(step * int(_GOLD) % 2**64))
            at = at - np.log1p(-(draw >> np.uint64(11)).astype(np.float64) / 2.0**53) / (high - low)
            keep = at <= times.reshape(n, slots).max(1)[bags]
            if not keep.all():
                seeds, inside, bags, at, draw = seeds[keep], inside[keep], bags[keep], at[keep], draw[keep]
            slot_draw = _mix(draw ^ np.uint64(0x5851F42D4C957F2D))
            slot = bags * slots + (slot_draw % np.uint64(slots)).astype(np.int64)
            better = at <= times[slot]
            partial = better & (inside < high)
            if partial.any():
                better[partial] = _lies_below(_mix(slot_draw[partial] + _GOLD), inside[partial], low, high)
            slot, when, mark = slot[better], at[better], draw[better]
            before = times[slot]
            np.minimum.at(times, slot, when)
            won = when == times[slot]
            slot, mark, sooner = slot[won], mark[won], (when < before)[won]
            marks[slot[sooner]] = _NONE
            np.minimum.at(marks, slot, mark)
    marks[np.isinf(times)] = 0
    return marks.reshape(n, slots)


def _lies_below(bits: np.ndarray, weight: np.ndarray, low: float, high: float) -> np.ndarray:
    """Whether each point, placed by halving (low, high] along its bits, lies below the weight."""
    a, b = np.full(len(bits), low), np.full(len(bits), high)
    for i in range(52):
        open_ = (a < weight) & (weight < b)
        if not open_.any():
            break
        middle = (a + b) / 2
        upper = ((bits >> np.uint64(i)) & np.uint64(1)).astype(bool)
        a = np.where(open_ & upper, middle, a)
        b = np.where(open_ & ~upper, middle, b)
    return b <= weight


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """(sum of the smaller weights, sum of the larger weights) of two bags."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = float(np.minimum(a[1][i], b[1][j]).sum())
    return common, float(a[1].sum() + b[1].sum()) - common


def near_pairs(
    records: DataFrame,
    key: str,
    seq: str,
    least: float = SIMILARITY,
    weighted: bool = False,
    delivered: str | None = None,
    k: int = WINDOW,
    slots: int = SLOTS,
    band: int = BAND,
    common: int = COMMON,
) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of every record, and the links between classes.

    members (rec, class_id, n_windows) has one row per record with a non-empty bag, repeated windows
    counted each time, classes being records of the same letters, named by their least key; links (class_a, class_b, common, total)
    has each pair of classes whose similarity is ``least`` or more.

    Defined results: letters are upper-cased; windows with other letters than A, C, G, T don't
    count; null, empty and short sequences are in no class; a key delivered several times counts in
    its latest version by ``delivered`` (ties: the greatest sequence); rows with a null key are left
    out; empty tables give no rows; other columns are ignored.
    """
    ship(records.sparkSession)
    rows = records.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("rec"),
        F.upper(seq).alias("seq"),
        (F.col(delivered) if delivered else F.lit(0)).alias("at"),
    )
    latest = rows.groupBy("rec").agg(F.max(F.struct("at", "seq")).alias("last")).select("rec", "last.seq")
    latest = cut_lineage(latest.where(F.length("seq") >= k).withColumn("sha", F.unhex(F.sha2("seq", 256))))
    named = latest.groupBy("sha").agg(F.min("rec").alias("class_id"))
    # signatures and numbers of windows come from one reading of the sequences
    classes = cut_lineage(
        named.join(latest.select(F.col("rec").alias("class_id"), "seq"), "class_id").select("sha", "class_id", "seq")
        .mapInArrow(_signer(k, weighted, slots, band), "sha binary, class_id bigint, seq string, n_windows bigint, marks array<bigint>")
    )
    members = cut_lineage(latest.select("rec", "sha").join(classes.select("sha", "class_id", "n_windows"), "sha").select("rec", "class_id", "n_windows"))
    banded = classes.select("class_id", F.explode("marks").alias("mark"))
    candidates = bucket_pairs(banded, ["mark"], "class_id", once=True, least=common)
    sides = candidates.join(classes.select(F.col("class_id").alias("a"), F.col("seq").alias("seq_a")), "a").join(
        classes.select(F.col("class_id").alias("b"), F.col("seq").alias("seq_b")), "b"
    )
    links = sides.select("a", "b", "seq_a", "seq_b").mapInArrow(
        _verifier(k, weighted, least), "class_a bigint, class_b bigint, common double, total double"
    )
    return members, cut_lineage(links)


def _signer(k: int, weighted: bool, slots: int, band: int):
    """Number of windows and band hashes of each record with any windows; a hash names its band too."""
    bands = slots // band

    def groups(seqs: list[str]) -> Iterator[tuple[int, int]]:
        first, size = 0, 0
        for i, s in enumerate(seqs):
            if i > first and size + len(s) > TOGETHER:
                yield first, i
                first, size = i, 0
            size += len(s)
        if len(seqs) > first:
            yield first, len(seqs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(2).to_pylist()
            for a, b in groups(seqs):
                values, owner = _windows(seqs[a:b], k)
                numbers = np.bincount(owner, minlength=b - a)
                values, owner, weights = _weights(values, owner) if weighted else (values, owner, np.ones(len(values)))
                marks = signatures(values, weights, owner, b - a, slots)
                joined = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * _GOLD, (b - a, 1))
                for i in range(band):
                    joined = _mix(joined * _GOLD + marks[:, i::band][:, :bands] + np.uint64(1))
                keep = np.flatnonzero(numbers)
                flat = pa.array(joined.view(np.int64)[keep].ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
                part = batch.slice(a, b - a).take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers[keep], pa.int64()), lists], names=["sha", "class_id", "seq", "n_windows", "marks"])

    return run


def _verifier(k: int, weighted: bool, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def bag_of(name: int, seq) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if name not in known:
                if held > REMEMBERED:
                    known.clear()
                    held = 0
                known[name] = bag(seq.as_py(), weighted, k)
                held += len(known[name][0])
            return known[name]

        for batch in batches:
            out: list[tuple] = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns[:2]], *batch.columns[2:], strict=True):
                left, right = bag_of(a, x), bag_of(b, y)
                common, total = similarity(left, right)
                if common >= least * total:
                    out.append((a, b, common, total))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                names=["class_a", "class_b", "common", "total"],
            )

    return run


def expand_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (rec_a < rec_b) of records: of linked classes, and of one class."""
    classes = members.select(F.col("class_id").alias("c"), "rec")
    # copies of one text may be a third of all records: they are paired part by part
    across = linked_pairs(links, "class_a", "class_b", classes, "c", "rec")
    within = bucket_pairs(classes, ["c"], "rec", apart=True, once=True)
    across = across.select(F.least("x", "y").alias("rec_a"), F.greatest("x", "y").alias("rec_b"))
    return across.unionByName(within.select(F.col("a").alias("rec_a"), F.col("b").alias("rec_b")))
