"""All-vs-all local matches between block consensus sequences: seed, chain, extend.

The engine finds which blocks of a graph share a minimizer; only such pairs are looked at. For a pair
the shared words become anchors, anchors that keep order and distance become chains, and each chain
becomes one match: words match exactly, what lies between is aligned in a band, and both ends are
extended as long as the score doesn't fall far below its best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.seq import COMPLEMENTS, LETTERS
from strandloom.operators.buckets import bucket_pairs
from strandloom.operators.align import align, letter_masks
from strandloom.operators.sketch import minimizers, sketch
from strandloom.session import ship

#: Sensitivity presets: (word, stretch of words that one minimizer stands for, longest gap in a chain).
#: The gap is the reference's. Unrelated stretches inside a gap divide a chain by the fall of their score.
PRESETS = {"5": (19, 19, 10_000), "10": (15, 10, 10_000), "20": (13, 6, 10_000)}
DROP = 40
#: Fall of the score inside a gap that divides a chain; the indel that the gap needs anyway costs nothing.
GAP_DROP = 200

_COMPLEMENT = str.maketrans(LETTERS, COMPLEMENTS)

SCHEMA = (
    "graph_id bigint, q_name string, q_len int, q_start int, q_end int, r_name string, r_len int, r_start int, r_end int, "
    "matches int, length int, forward boolean, cigar array<struct<op:string,len:int>>, divergence double"
)
ARROW = pa.schema(
    [("graph_id", pa.int64()), ("q_name", pa.string()), ("q_len", pa.int32()), ("q_start", pa.int32()), ("q_end", pa.int32()), ("r_name", pa.string()),
     ("r_len", pa.int32()), ("r_start", pa.int32()), ("r_end", pa.int32()), ("matches", pa.int32()), ("length", pa.int32()),
     ("forward", pa.bool_()), ("cigar", pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())]))), ("divergence", pa.float64())]
)


def reverse_complement(seq: str) -> str:
    return seq.translate(_COMPLEMENT)[::-1]


def shared_words(q: str, r: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in q, place in r) of shared minimizers that stand in one direction on both."""
    hq, pq, fq = minimizers(q, k, w)
    hr, pr, fr = minimizers(r, k, w)
    order = np.argsort(hr, kind="stable")
    low, high = np.searchsorted(hr[order], hq, "left"), np.searchsorted(hr[order], hq, "right")
    n = high - low
    i = np.repeat(np.arange(len(hq)), n)
    j = order[np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())] if n.sum() else np.empty(0, np.int64)
    same = fq[i] == fr[j]
    return (pq[i] - k + 1)[same], (pr[j] - k + 1)[same]


def chains(qa: np.ndarray, ra: np.ndarray, k: int, gap: int) -> list[list[int]]:
    """Anchors in chains that rise on both sequences, best chain first; an anchor is in one chain.

    Every anchor within ``gap`` letters on both sides can be the one before. On one diagonal the
    nearest is the best, and what lies before that one too is no better than by way of it, so only
    anchors between the two are left to look at: few, unless nothing is near on the diagonal.
    """
    order = np.lexsort((qa, ra))
    q, r = qa[order].astype(np.int64), ra[order].astype(np.int64)
    n = len(q)
    best, back = np.full(n, float(k)), np.full(n, -1)
    by_q = np.lexsort((r, q))
    q_sorted = q[by_q]
    near = np.full(n, -1)  # the anchor before on the same diagonal
    by_diagonal = np.lexsort((r, q - r))
    x, y = by_diagonal[:-1], by_diagonal[1:]
    close = ((q - r)[x] == (q - r)[y]) & (r[y] - r[x] <= gap)
    near[y[close]] = x[close]
    from_q, from_r = np.where(near >= 0, q[near], q - gap), np.where(near >= 0, r[near], r - gap)
    r_low, r_high = np.searchsorted(r, from_r, "left"), np.searchsorted(r, r, "left")
    q_low, q_high = np.searchsorted(q_sorted, from_q, "left"), np.searchsorted(q_sorted, q, "left")
    for i in range(n):
        j = int(near[i])
        if j >= 0:
            best[i], back[i] = max(best[i], best[j] + min(int(r[i] - r[j]), k)), j
        for at in (np.arange(r_low[i], r_high[i]), by_q[q_low[i] : q_high[i]]) if j >= 0 else (np.arange(r_low[i], r_high[i]),):
            if not len(at):
                continue
            dq, dr = q[i] - q[at], r[i] - r[at]
            ok = (dq > 0) & (dr > 0) & (dq <= gap) & (dr <= gap)
            if ok.any():
                gain = np.minimum(np.minimum(dq, dr), k) - 0.05 * np.abs(dq - dr) - 0.5 * (dq != dr)
                total = np.where(ok, best[at] + gain, -np.inf)
                t = int(np.argmax(total))
                if total[t] > best[i]:
                    best[i], back[i] = total[t], at[t]
    used = np.zeros(n, dtype=bool)
    out = []
    for i in np.argsort(-best, kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(int(order[i]))
            i = int(back[i])
        if chain:
            out.append(chain[::-1])
    return out


def _extension(a: np.ndarray, b: np.ndarray) -> int:
    """Letters by which an end grows without gaps until the score is DROP below its best."""
    n = min(len(a), len(b))
    size = 1000
    while True:  # most ends stop soon, so few letters are looked at first
        m = min(n, size)
        total = np.cumsum(np.where((a[:m] & b[:m]) > 0, 1, -4))
        top = np.maximum.accumulate(np.maximum(total, 0))
        stop = np.flatnonzero(top - total > DROP)
        if len(stop) or m == n:
            break
        size *= 8
    total = total[: stop[0]] if len(stop) else total
    return int(np.argmax(total)) + 1 if len(total) and total.max() > 0 else 0


def _falls(a: np.ndarray, b: np.ndarray, ops: list[tuple[str, int]]) -> bool:
    """Whether the score of aligned letters (reference, query) falls by more than GAP_DROP below its best."""
    needed = abs(len(a) - len(b))
    longer = "D" if len(a) > len(b) else "I"
    i = j = score = best = 0
    for op, n in ops:
        if op == "M":
            total = score + np.cumsum(np.where((a[i : i + n] & b[j : j + n]) > 0, 1, -4))
            top = np.maximum.accumulate(np.maximum(total, best))
            if (top - total).max() > GAP_DROP:
                return True
            score, best = int(total[-1]), int(top[-1])
            i, j = i + n, j + n
            continue
        free = min(n, needed) if op == longer else 0
        needed -= free
        if n > free:
            score -= min(6 + 2 * (n - free), 26 + n - free)
        if best - score > GAP_DROP:
            return True
        i, j = i + n * (op == "D"), j + n * (op == "I")
    return False


def _push(ops: list[list], op: str, n: int) -> None:
    if n <= 0:
        return
    if ops and ops[-1][0] == op:
        ops[-1][1] += n
    else:
        ops.append([op, n])


def chain_matches(q: str, r: str, mq: np.ndarray, mr: np.ndarray, qa: np.ndarray, ra: np.ndarray, chain: list[int], k: int) -> list[dict]:
    """The matches of one chain on two sequences of the same direction, divided where a gap holds unrelated letters.

    ``mq`` and ``mr`` are the letter masks of the sequences.
    """
    out: list[dict] = []
    ops: list[list] = []
    qs = rs = qe = re_ = 0

    def begin(x: int, y: int) -> None:
        nonlocal ops, qs, rs, qe, re_
        grown = _extension(mq[qe:x][::-1], mr[re_:y][::-1])  # not into the match before
        ops, qs, rs = [], x - grown, y - grown
        qe, re_ = qs, rs

    def close(x: int, y: int) -> None:
        nonlocal qe, re_
        grown = _extension(mq[qe:x], mr[re_:y])
        _push(ops, "M", grown)
        qe, re_ = qe + grown, re_ + grown
        i, j, equal, aligned = qs, rs, 0, 0
        for op, n in ops:
            if op == "M":
                equal += int(((mq[i : i + n] & mr[j : j + n]) > 0).sum())
                aligned += n
            i += n if op in "MI" else 0
            j += n if op in "MD" else 0
        out.append({
            "q_start": qs, "q_end": qe, "r_start": rs, "r_end": re_, "matches": aligned, "length": sum(n for _, n in ops),
            "cigar": [{"op": o, "len": n} for o, n in ops], "divergence": 1 - equal / aligned if aligned else 1.0,
        })

    begin(int(qa[chain[0]]), int(ra[chain[0]]))
    for c in chain:
        x, y = int(qa[c]), int(ra[c])
        if x + k <= qe or y + k <= re_:
            continue
        dq, dr = x - qe, y - re_
        if dq < 0 or dr < 0:  # the word overlaps the last one: what is left of it must lie on the same diagonal
            if dq != dr:
                continue
            dq = dr = 0
            x, y = qe, re_
            n = int(qa[c]) + k - qe
        else:
            n = k
            if dq == dr and dq < 4 * k:
                _push(ops, "M", dq)
            else:
                between = align(r[re_:y], q[qe:x], 0, abs(dq - dr))
                if _falls(mr[re_:y], mq[qe:x], between):
                    close(x, y)
                    begin(x, y)
                    between = [("M", x - qe)]
                for op, m in between:
                    _push(ops, op, m)
        _push(ops, "M", n)
        qe, re_ = x + n, y + n
    close(len(q), len(r))
    return out


class _Taken:
    """Places of both sequences that matches so far align, by diagonal (query place less reference place)."""

    def __init__(self) -> None:
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, m: dict) -> None:
        for diagonal, a, b in self._runs(m):
            self.runs.setdefault(diagonal, []).append((a, b))

    def holds(self, x: int, y: int, n: int) -> bool:
        return any(a <= x and x + n <= b for a, b in self.runs.get(x - y, ()))

    def new(self, m: dict) -> int:
        """Aligned letters of a match that no match so far aligns to the same letters."""
        total = 0
        for diagonal, a, b in self._runs(m):
            free = np.ones(b - a, dtype=bool)
            for c, d in self.runs.get(diagonal, ()):
                free[max(c - a, 0) : max(d - a, 0)] = False
            total += int(free.sum())
        return total

    @staticmethod
    def _runs(m: dict) -> Iterator[tuple[int, int, int]]:
        i, j = m["q_start"], m["r_start"]
        for o in m["cigar"]:
            if o["op"] == "M":
                yield i - j, i, i + o["len"]
            i += o["len"] if o["op"] in "MI" else 0
            j += o["len"] if o["op"] in "MD" else 0


def pair_matches(q: str, r: str, k: int, w: int, gap: int, least: int) -> list[dict]:
    """All matches of ``least`` aligned letters and more of a pair, in both directions.

    A match needs so many letters that no better one aligns to the same letters; a repeat at other
    places inside a better match is a match of its own.
    """
    out = []
    for forward in (True, False):
        s = q if forward else reverse_complement(q)
        qa, ra = shared_words(s, r, k, w)
        mq, mr = letter_masks(s), letter_masks(r)
        taken = _Taken()
        for chain in chains(qa, ra, k, gap):
            chain = [c for c in chain if not taken.holds(int(qa[c]), int(ra[c]), k)]
            if not chain:
                continue  # what a better chain left over on its own path
            for m in chain_matches(s, r, mq, mr, qa, ra, chain, k):
                if m["matches"] < least or taken.new(m) < least:
                    continue
                taken.add(m)
                if not forward:
                    m["q_start"], m["q_end"] = len(q) - m["q_end"], len(q) - m["q_start"]
                out.append(m | {"forward": forward, "q_len": len(q), "r_len": len(r)})
    return out


def find_matches(blocks: DataFrame, least: int = 100, preset: str = "10", word: int | None = None) -> DataFrame:
    """Matches between different blocks of each graph; of a pair the greater id is the reference.

    ``word`` takes the place of the preset's word length.

    Cigars of reverse matches run along the reference. Names are block ids.
    """
    ship(blocks.sparkSession)
    k, w, gap = PRESETS[preset]
    k = word or k
    named = blocks.select("graph_id", "block_id", "consensus").withColumn("key", F.struct("graph_id", "block_id"))
    words = sketch(named, "key", "consensus", k, w).select("key.graph_id", "key", "value").distinct()
    # a word of very many blocks is met part by part
    pairs = bucket_pairs(words, ["graph_id", "value"], "key", once=True)
    pairs = pairs.select("a.graph_id", F.col("a.block_id").alias("q_name"), F.col("b.block_id").alias("r_name"))
    seqs = blocks.select("graph_id", F.col("block_id").alias("q_name"), F.col("consensus").alias("q"))
    refs = blocks.select("graph_id", F.col("block_id").alias("r_name"), F.col("consensus").alias("r"))
    sides = pairs.join(seqs, ["graph_id", "q_name"]).join(refs, ["graph_id", "r_name"]).select("graph_id", "q_name", "r_name", "q", "r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                for m in pair_matches(p["q"], p["r"], k, w, gap, least):
                    rows.append(m | {"graph_id": p["graph_id"], "q_name": p["q_name"], "r_name": p["r_name"]})
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return sides.mapInArrow(run, SCHEMA)
