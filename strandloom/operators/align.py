"""Banded alignment of a sequence to a consensus and the edits read off it.

Affine gaps with an extension price of zero, free gaps at both ends, gaps as far left as possible.
The band is given by the mean shift of the expected edit and a width; it is doubled while the best
path touches its border.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

# Scores of the alignment and its attempts.
MATCH, MISMATCH, GAP_OPEN, UNKNOWN = 3, -1, 6, 2
EXTRA_BAND, ATTEMPTS = 5, 4
D_OPEN, I_OPEN = 4, 8
#: Sequences from this length on are aligned between words that stand once in both; the letters of a word.
LONG, WORD = 2_000, 24
#: Cells of one matrix; two stretches without common words that need more are one deletion and one insertion.
CELLS = 1 << 26

# The plain letters that each ambiguity letter stands for.
AMBIGUITY = {
    "A": "A", "C": "C", "G": "G", "T": "T", "Y": "CT", "R": "AG", "W": "AT", "S": "CG",
    "K": "GT", "M": "AC", "D": "AGT", "V": "ACG", "H": "ACT", "B": "CGT", "N": "ACGT",
}
_MASK = np.zeros(256, dtype=np.uint8)
for _c, _s in AMBIGUITY.items():
    _MASK[ord(_c)] = _MASK[ord(_c.lower())] = sum(1 << "ACGT".index(x) for x in _s)
_N = _MASK[ord("N")]


def letter_masks(seq: str) -> np.ndarray:
    return _MASK[np.frombuffer(seq.encode("ascii"), dtype=np.uint8)]


def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Match score of letters that can mean the same, mismatch score otherwise; N has its own."""
    s = np.where((a & b) > 0, MATCH, MISMATCH)
    return np.where((a == _N) | (b == _N), UNKNOWN, s)


def mean_shift(consensus_len: int, dels: list[tuple[int, int]], inss: list[tuple[int, str]]) -> tuple[int, int]:
    """(mean shift, width) of the band that an edit's indels ask for.

    The shift at a consensus place is letters deleted less letters inserted before it.
    """
    events = sorted([(p, n) for p, n in dels] + [(p, -len(s)) for p, s in inss])
    if not events or not consensus_len:
        return 0, 0
    at, shift, area, shifts = 0, 0, 0.0, []
    for p, n in events:
        area += shift * (p - at)
        at, shift = p, shift + n
        shifts.append(shift)
    area += shift * (consensus_len - at)
    mean = round(area / consensus_len)
    return mean, max(abs(s - mean) for s in [0, *shifts])


def _banded(ref: np.ndarray, qry: np.ndarray, shift: int, band: int) -> tuple[list[tuple[str, int]], bool, int]:
    """(operations, touched, score): M, D (letter of ref only), I (letter of qry only).

    Row i of the matrix is i letters of ref; its columns are the places i - shift - band to
    i - shift + band of qry, and all places next to the ends that free end gaps reach.
    """
    n, m = len(ref), len(qry)
    low = np.clip(np.arange(n + 1) - shift - band, 0, m)
    high = np.clip(np.arange(n + 1) - shift + band, 0, m)
    low[0], high[n] = 0, m
    low, high = np.minimum.accumulate(low[::-1])[::-1], np.maximum.accumulate(high)
    width = int((high - low).max()) + 1
    none = -(1 << 28)
    # best score of a path into each cell of the last row, and of one that ends in a gap in qry (D)
    last = np.full(width, none, dtype=np.int32)
    # of every cell one byte: the last step (1 match, 2 D, 3 I), and whether a D or an I is opened here
    back = np.zeros((n + 1, width), dtype=np.uint8)
    last[: high[0] - low[0] + 1] = 0
    back[0, 1 : high[0] - low[0] + 1] = 3
    gap_d = np.full(width, none, dtype=np.int32)
    for i in range(1, n + 1):
        a, b, pa, pb = low[i], high[i], low[i - 1], high[i - 1]
        cols = np.arange(a, b + 1)
        k = len(cols)
        up, diag = np.full(k, none, np.int32), np.full(k, none, np.int32)
        gap_before = np.full(k, none, np.int32)
        inside = (cols >= pa) & (cols <= pb)
        up[inside] = last[cols[inside] - pa]
        gap_before[inside] = gap_d[cols[inside] - pa]
        behind = (cols - 1 >= pa) & (cols - 1 <= pb)
        diag[behind] = last[cols[behind] - 1 - pa] + score(ref[i - 1], qry[cols[behind] - 1])
        price = np.where(cols == m, 0, GAP_OPEN) if m else np.zeros(k, np.int32)  # free behind the query's end
        price = np.where(cols == 0, 0, price)  # and before its start
        opened = up - price
        gap_now = np.maximum(opened, gap_before)
        flags = (opened >= gap_before).astype(np.uint8) * D_OPEN
        here = np.where(diag >= gap_now, diag, gap_now)
        step = np.where(diag >= gap_now, 1, 2).astype(np.int8)
        # gaps in ref run along the row: extension is free, so the best start is a running maximum
        price_i = 0 if i == n else GAP_OPEN
        start = here - price_i
        run = np.maximum.accumulate(start)
        before = np.concatenate(([none], run[:-1])).astype(np.int32)
        better = before > here
        here = np.where(better, before, here)
        step[better] = 3
        # a gap is opened where the running maximum took its value
        flags[1:] |= (start[:-1] >= run[:-1]).astype(np.uint8) * I_OPEN
        back[i, :k] = step.astype(np.uint8) | flags
        last = np.full(width, none, dtype=np.int32)
        last[:k] = here
        gap_d = np.full(width, none, dtype=np.int32)
        gap_d[:k] = gap_now
    i, j = n, m
    ops: list[tuple[str, int]] = []
    touched = False

    def put(op: str) -> None:
        if ops and ops[-1][0] == op:
            ops[-1] = (op, ops[-1][1] + 1)
        else:
            ops.append((op, 1))

    total = int(last[m - low[n]])
    while i > 0 or j > 0:
        if i == 0:
            put("I")
            j -= 1
            continue
        c = j - low[i]
        if (j == low[i] and low[i] > 0) or (j == high[i] and high[i] < m):
            touched = True
        step = back[i, c] & 3
        if step == 1:
            put("M")
            i, j = i - 1, j - 1
        elif step == 2:
            while True:
                opened = back[i, j - low[i]] & D_OPEN
                put("D")
                i -= 1
                if opened or i == 0:
                    break
        else:
            while True:
                opened = back[i, j - low[i]] & I_OPEN
                put("I")
                j -= 1
                if opened or j == 0:
                    break
    return ops[::-1], touched, total


def align(ref: str, qry: str, shift: int = 0, band: int = EXTRA_BAND, attempts: int = ATTEMPTS) -> list[tuple[str, int]]:
    """Operations of the alignment of ``qry`` to ``ref``; the band grows while the path touches it."""
    if not ref or not qry:
        return [("D", len(ref))] * bool(ref) + [("I", len(qry))] * bool(qry)
    r, q = letter_masks(ref), letter_masks(qry)
    if len(ref) == len(qry) and ref == qry:
        return [("M", len(ref))]
    band = max(band, 1)
    for attempt in range(attempts):
        ops, touched, _ = _banded(r, q, shift, band)
        if not touched:
            break
        if attempt < attempts - 1:
            band = max(2 * band, 1, abs(shift))
    return ops


def _common_words(ref: str, qry: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in ref, place in qry) of words that stand once in each, as a longest chain that rises on both."""
    from strandloom.operators.sketch import word_codes

    (rw, rp), (qw, qp) = word_codes(ref, k), word_codes(qry, k)
    once = lambda w, p: (u := np.unique(w, return_index=True, return_counts=True), (u[0][u[2] == 1], p[u[1][u[2] == 1]]))[1]
    (rw, rp), (qw, qp) = once(rw, rp), once(qw, qp)
    _, i, j = np.intersect1d(rw, qw, assume_unique=True, return_indices=True)
    order = np.argsort(rp[i])
    x, y = rp[i][order], qp[j][order]
    if not len(x) or (np.diff(y) > 0).all():
        return x, y
    tails: list[int] = []  # the longest rising chain by patience sorting
    ends: list[int] = []
    back = np.full(len(y), -1)
    for n, v in enumerate(y.tolist()):
        at = bisect_left(tails, v)
        back[n] = ends[at - 1] if at else -1
        if at == len(tails):
            tails.append(v)
            ends.append(n)
        else:
            tails[at], ends[at] = v, n
    chain, n = [], ends[-1]
    while n >= 0:
        chain.append(n)
        n = int(back[n])
    return x[chain[::-1]], y[chain[::-1]]


def align_long(ref: str, qry: str, k: int = WORD) -> list[tuple[str, int]]:
    """Operations of the alignment of long sequences: common words match, what lies between is aligned by itself.

    Time and memory grow with the stretches between words, not with the product of the lengths.
    """
    x, y = _common_words(ref, qry, k)
    ops: list[list] = []

    def put(op: str, n: int) -> None:
        if n and ops and ops[-1][0] == op:
            ops[-1][1] += n
        elif n:
            ops.append([op, n])

    i = j = 0
    # words of one diagonal that touch are one stretch
    if len(x):
        same = (np.diff(x) == np.diff(y)) & (np.diff(x) <= k)
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        final = np.append(first[1:] - 1, len(x) - 1)
        stretches = list(zip(x[first].tolist(), y[first].tolist(), (x[final] - x[first] + k).tolist(), strict=True))
    else:
        stretches = []
    for a, b, n in [*stretches, (len(ref), len(qry), 0)]:
        skip = max(i - a, j - b, 0)  # a stretch may begin inside the last one on another diagonal
        if n and skip >= n:
            continue
        a, b, n = a + skip, b + skip, n - skip
        r, q = ref[i:a], qry[j:b]
        if len(r) == len(q) and (len(r) < 4 * k and a < len(ref) and i > 0 or r == q):
            put("M", len(r))
        elif min(len(r), len(q)) * max(len(r), 1) <= CELLS:
            for op, m in align(r, q, 0, max(abs(len(r) - len(q)), EXTRA_BAND)):
                put(op, m)
        elif k > 12:  # shorter words may stand in both
            for op, m in align_long(r, q, k - 6):
                put(op, m)
        else:
            put("D", len(r))
            put("I", len(q))
        put("M", n)
        i, j = a + n, b + n
    return [(op, n) for op, n in ops]


def edit_of(ref: str, qry: str, ops: list[tuple[str, int]]) -> dict[str, list]:
    """The Edit that makes ``qry`` of ``ref``: insertions stand before the place that follows them."""
    i = j = 0
    subs, dels, inss = [], [], []
    for op, n in ops:
        if op == "M":
            a, b = np.frombuffer(ref[i : i + n].encode("ascii"), dtype=np.uint8), np.frombuffer(qry[j : j + n].encode("ascii"), dtype=np.uint8)
            subs += [{"pos": i + x, "alt": qry[j + x]} for x in np.flatnonzero(a != b).tolist()]
            i, j = i + n, j + n
        elif op == "D":
            dels.append({"pos": i, "len": n})
            i += n
        else:
            inss.append({"pos": i, "seq": qry[j : j + n]})
            j += n
    return {"subs": subs, "dels": dels, "inss": inss}


def realign(ref: str, qry: str, shift: int = 0, band: int = EXTRA_BAND, extra: int = EXTRA_BAND, attempts: int = ATTEMPTS) -> dict[str, list]:
    """The Edit of ``qry`` against ``ref`` by banded alignment; an empty sequence is one deletion."""
    if not qry:
        return {"subs": [], "dels": [{"pos": 0, "len": len(ref)}] if ref else [], "inss": []}
    if min(len(ref), len(qry)) >= LONG:
        return edit_of(ref, qry, align_long(ref, qry))
    return edit_of(ref, qry, align(ref, qry, shift, band + extra, attempts))


def apply(ref: str, edit: dict[str, list]) -> str:
    """The sequence an Edit makes of ``ref``."""
    slots = list(ref)
    for s in edit["subs"]:
        slots[s["pos"]] = s["alt"]
    for d in edit["dels"]:
        slots[d["pos"] : d["pos"] + d["len"]] = [""] * d["len"]
    before = [""] * (len(ref) + 1)
    for x in edit["inss"]:
        before[x["pos"]] += x["seq"]
    return "".join(b + s for b, s in zip(before, [*slots, ""], strict=True))
