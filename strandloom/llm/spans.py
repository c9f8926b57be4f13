"""Long exact spans shared between records, by prefix-partitioned suffix trees.

A span is shared if the same LENGTH letters stand in at least one other record. Suffixes are divided
by their prefixes into groups that fit into memory, and the part of the suffix tree of each group is
built from its sorted suffixes: neighbours in that order with the number of letters they have in
common are the tree, a stretch of neighbours with d letters in common being a node of depth d.

Not every suffix is needed. Each window of LENGTH letters has ANCHOR-letter sub-words, and the one
of least hash is the window's anchor; equal windows have equal anchors at equal places. So only
suffixes at anchors (about two in LENGTH - ANCHOR + 2 positions) are sent, each with the letters
before it, and every window is seen in the group of its anchor. A group has two trees then: of the
suffixes at the anchor, and of the letters before it read backwards. A maximal repeat through the
anchor is a node of depth d of the first tree met with a node of depth b of the second, whose common
leaves come from two records; with b + d = LENGTH it is a shared window.

Prefixes have variable length. They begin with the ANCHOR letters of the anchor. A group of more than
GROUP suffixes is first made one row per different surroundings (the prefix is all letters around the
anchor), with the least and greatest record of each, combined on the map side; if as many are left
that the group still doesn't fit, its prefixes become whole windows, whose node needs no memory at
all: two records of a window are a partial aggregate. The bound on a group is the same for tables
of any size, and nothing about groups goes to the driver.

Records of the same letters are made one first: all their windows are shared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.session import cut_lineage, ship

LENGTH, ANCHOR = 80, 24
#: Suffixes of a group that is read in memory, and suffixes whose trees are read together.
GROUP, TOGETHER = 20_000, 50_000
#: Letters read at a time, overlapping by LENGTH.
PIECE = 1 << 20

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, (_c, _d) in enumerate(zip(b"ACGT", b"acgt", strict=True)):
    _CODE[_c] = _CODE[_d] = _i

_NONE = np.uint64(2**64 - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(code: np.ndarray, k: int) -> np.ndarray:
    """Two-bit codes of all k-letter words (k at most 32), by doubling; words with other letters hold garbage."""
    have, width, out, done = (code & 3).astype(np.uint64), 1, None, 0
    while True:
        if k & width:
            n = len(code) - done - width + 1
            out = have if out is None else (out[:n] << np.uint64(2 * width)) | have[done : done + n]
            done += width
        if width * 2 > k:
            return out[: len(code) - k + 1]
        n = len(have) - width
        have = (have[:n] << np.uint64(2 * width)) | have[width : width + n]
        width *= 2


def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best (minimum or maximum) of every w neighbours, by doubling."""
    have, width = x, 1
    while width * 2 <= w:
        have = best(have[:-width], have[width:])
        width *= 2
    rest = w - width
    return best(have[: len(have) - rest], have[rest:]) if rest else have


def anchors(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, letters) of the anchors of all windows of valid letters."""
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    if len(code) < LENGTH:
        return none
    words = _packed(code, ANCHOR)
    bad = np.concatenate(([0], np.cumsum(code > 3)))
    hashed = _mix(words ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(1)
    hashed[bad[ANCHOR:] != bad[:-ANCHOR]] = _NONE
    least = _sliding(hashed, LENGTH - ANCHOR + 1, np.minimum)
    least[bad[LENGTH:] != bad[:-LENGTH]] = 0  # no window of valid letters here
    edge = np.zeros(LENGTH - ANCHOR, dtype=np.uint64)
    chosen = _sliding(np.concatenate((edge, least, edge)), LENGTH - ANCHOR + 1, np.maximum)
    at = np.flatnonzero((chosen == hashed) & (hashed != _NONE))
    return at, words[at]


LEFT = LENGTH - ANCHOR  # letters kept before an anchor
SPAN = LEFT + LENGTH  # letters kept around it


def contexts(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters around each anchor as bytes: valid letters before and after it, then SPAN letters at two bits each."""
    padded = np.concatenate((np.full(LEFT, 4, np.uint8), code, np.full(LENGTH, 4, np.uint8)))
    around = np.lib.stride_tricks.sliding_window_view(padded, SPAN)[at]
    bad = around > 3
    left = np.where(bad[:, :LEFT].any(1), np.argmax(bad[:, :LEFT][:, ::-1], 1), LEFT)
    right = np.where(bad[:, LEFT:].any(1), np.argmax(bad[:, LEFT:], 1), LENGTH)
    two = (around & 3).reshape(len(at), SPAN // 4, 4)
    packed = (two[:, :, 0] << 6) | (two[:, :, 1] << 4) | (two[:, :, 2] << 2) | two[:, :, 3]
    return np.concatenate((left[:, None].astype(np.uint8), right[:, None].astype(np.uint8), packed.astype(np.uint8)), axis=1)


def _unpacked(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, letters) of contexts."""
    body = raw[:, 2:]
    letters = np.stack([(body >> s) & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(raw), SPAN)
    return raw[:, 0].astype(np.int64), raw[:, 1].astype(np.int64), letters


def _sortable(letters: np.ndarray) -> list[np.ndarray]:
    """Rows of letters as 64-bit words of 32 letters each, the first word first; their order is that of the letters."""
    n, width = letters.shape
    padded = np.zeros((n, -(-width // 32) * 32), dtype=np.uint8)
    padded[:, :width] = letters
    four = padded.reshape(n, -1, 4)
    packed = (four[:, :, 0] << 6) | (four[:, :, 1] << 4) | (four[:, :, 2] << 2) | four[:, :, 3]
    words = np.ascontiguousarray(packed).view(">u8").astype(np.uint64)
    return [words[:, i] for i in range(words.shape[1])]


class Tree:
    """The tree of texts of equal length inside groups: their order, and how many letters neighbours have in common."""

    def __init__(self, group: np.ndarray, letters: np.ndarray):
        self.order = np.lexsort((*_sortable(letters)[::-1], group))
        rows, g = letters[self.order], group[self.order]
        differ = rows[1:] != rows[:-1]
        common = np.where(differ.any(1), differ.argmax(1), letters.shape[1])
        self.common = np.concatenate(([-1], np.where(g[1:] == g[:-1], common, -1))).astype(np.int16)

    def nodes(self, depth: int) -> np.ndarray:
        """Of each text the node of ``depth`` above it: neighbours with so many letters in common are under one."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out

    def closest(self) -> np.ndarray:
        """Of each text the depth of its parent: letters in common with any other text of its group."""
        out = np.empty(len(self.order), dtype=np.int64)
        out[self.order] = np.maximum(self.common, np.append(self.common[1:], -1))
        return np.maximum(out, 0)


def _extremes(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, least a, greatest b of the key of each) in order of keys."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(begins, len(key)))
    return order, np.repeat(np.minimum.reduceat(a[order], begins), sizes), np.repeat(np.maximum.reduceat(b[order], begins), sizes)


def maximal_repeats(group: np.ndarray, a: np.ndarray, b: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, least, greatest letters before the anchor) of the rows with a window shared between owners.

    ``a`` and ``b`` are the least and the greatest owner of a row (one row may stand for several
    suffixes with the same letters around). All windows of a row that are shared contain its anchor,
    so what they cover is one stretch.
    """
    left, right, letters = _unpacked(raw)
    after, before = Tree(group, letters[:, LEFT:]), Tree(group, letters[:, LEFT - 1 :: -1])
    n = len(raw)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    # rows of one leaf in both trees; if they have two owners, all their windows are shared
    leaf = (after.nodes(LENGTH) * (n + 1) + before.nodes(LEFT)) * (LENGTH + 1) * (LENGTH + 1) + left * (LENGTH + 1) + right
    order, least, greatest = _extremes(leaf, a, b)
    whole = order[(least != greatest) & (left[order] + right[order] >= LENGTH)]
    low[whole], high[whole] = LENGTH - right[whole], left[whole]
    # the others need a node above their leaf: only where both parents are deep enough, and in groups with such rows
    deep = np.minimum(after.closest(), right) + np.minimum(before.closest(), left) >= LENGTH
    open_ = deep & (high < 0)
    groups = np.zeros(int(group.max()) + 1, dtype=bool)
    groups[group[open_]] = True
    deep &= groups[group]
    if open_.any():
        for letters_before in range(LEFT + 1):
            depth = LENGTH - letters_before
            rows = np.flatnonzero(deep & (left >= letters_before) & (right >= depth))
            if len(rows) < 2:
                continue
            order, least, greatest = _extremes(after.nodes(depth)[rows] * (n + 1) + before.nodes(letters_before)[rows], a[rows], b[rows])
            hit = rows[order[least != greatest]]
            low[hit] = np.minimum(low[hit], letters_before)
            high[hit] = np.maximum(high[hit], letters_before)
    found = np.flatnonzero(high >= 0)
    return found, low[found], high[found]


def _letters(seq: str) -> np.ndarray:
    """A code for each character of the sequence; characters outside ASCII are no valid letters."""
    if seq.isascii():
        return _CODE[np.frombuffer(seq.encode(), dtype=np.uint8)]
    return _CODE[np.minimum(np.frombuffer(seq.encode("utf-32-le"), dtype=np.uint32), 255)]


def _pieces(seq: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(offset, codes, anchors, their letters) of a sequence, piece by piece; a window lies whole in some piece.

    Anchors that two pieces name are named once; anchors depend on windows alone, and a window
    of two pieces has the same anchors in both.
    """
    code = _letters(seq)
    if len(code) <= 2 * PIECE:
        yield 0, code, *anchors(code)
        return
    last = -1
    for at in range(0, len(code), PIECE):
        place, words = anchors(code[at : at + PIECE + LENGTH])
        keep = place + at > last
        place, words = place[keep], words[keep]
        if len(place):
            last = int(place[-1]) + at
            low, high = max(0, at - LENGTH), min(len(code), at + PIECE + 2 * LENGTH)
            yield low, code[low:high], place + at - low, words


def _anchor_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seq in batch.column(0):
            for _, _, _, words in _pieces(seq.as_py()):
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64))], names=["anchor"])


def _merge_small(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _suffix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of anchor suffixes: (anchor, owner, place, context)."""

    def rows() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, seq in zip(batch.column(0), batch.column(1), strict=True):
                for offset, code, at, words in _pieces(seq.as_py()):
                    if len(at):
                        yield _row_batch(words, owner, at + offset, contexts(code, at))

    return _merge_small(rows())


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of distinct contexts: (anchor, context, before, window, a, b), a and b being the outermost owners."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            width = 2 + SPAN // 4
            raw = np.frombuffer(b"".join(c.as_py() for c in part.column(1)), dtype=np.uint8).reshape(-1, width)
            left, right, letters = _unpacked(raw)
            for before in range(LEFT + 1):
                keep = np.flatnonzero((left >= before) & (right >= LENGTH - before))
                if len(keep):
                    two = letters[keep, LEFT - before : LEFT - before + LENGTH].reshape(len(keep), LENGTH // 4, 4)
                    packed = ((two[:, :, 0] << 6) | (two[:, :, 1] << 4) | (two[:, :, 2] << 2) | two[:, :, 3]).astype(np.uint8)
                    window = pa.array([p.tobytes() for p in packed], pa.binary())
                    rows = part.take(pa.array(keep))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), pa.array(np.full(len(keep), before, dtype=np.int32)), window, rows.column(2), rows.column(3)],
                        names=["anchor", "context", "before", "window", "a", "b"],
                    )


def _large_groups(suffixes: DataFrame, group: int) -> DataFrame:
    """Shared intervals of suffixes whose groups are too large, without ever holding a group.

    Equal surroundings become one row with the least and greatest owner, on the map side first, so
    copies cost nothing here. Groups that fit then are read as trees; those that still don't are
    expanded into windows, whose owners are combined the same way.
    """
    key = ["anchor", "context"]
    distinct = cut_lineage(suffixes.groupBy(*key).agg(F.min("owner").alias("a"), F.max("owner").alias("b")))
    many = cut_lineage(distinct.groupBy("anchor").count().where(F.col("count") > group).select("anchor"))
    fits = distinct.join(many, "anchor", "left_anti")
    shared = fits.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_merged_trees, "anchor bigint, context binary, low int, high int")
    if not many.isEmpty():
        windows = distinct.join(many, "anchor", "left_semi").mapInArrow(_window_rows, "anchor bigint, context binary, before int, window binary, a binary, b binary")
        nodes = windows.groupBy("window").agg(F.min("a").alias("least"), F.max("b").alias("greatest")).where("least <> greatest")
        found = windows.join(nodes.select("window"), "window", "left_semi").groupBy(*key).agg(F.min("before").alias("low"), F.max("before").alias("high"))
        shared = shared.unionByName(found)
    hits = suffixes.join(shared, key)
    return hits.select("owner", (F.col("place") - F.col("high")).alias("low"), (F.col("place") - F.col("low") + LENGTH).alias("high"))


_ROW = pa.schema([("anchor", pa.int64()), ("owner", pa.binary()), ("place", pa.int64()), ("context", pa.binary())])


def _row_batch(words: np.ndarray, owner, place: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    n, width = raw.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32)).buffers()[1]
    data = pa.py_buffer(np.ascontiguousarray(raw).tobytes())
    name = owner.as_py()
    owners = pa.BinaryArray.from_buffers(
        pa.binary(), n, [None, pa.array(np.arange(0, (n + 1) * len(name), len(name), dtype=np.int32)).buffers()[1], pa.py_buffer(name * n)]
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(words.view(np.int64)), owners, pa.array(place, pa.int64()), pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, data])], schema=_ROW
    )


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by anchor, whole groups together; a group has at most GROUP rows, so little is held over."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            anchor = table["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], side="left"))
            if cut:
                yield table.slice(0, cut)
                held, n = table.slice(cut).to_batches(), table.num_rows - cut
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _plain(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _repeats_of(table: pa.Table, least: str, greatest: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of the rows of whole groups with shared windows; groups of one owner are left out first."""
    anchor = table["anchor"].to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    sizes = np.diff(np.append(begins, len(anchor)))
    names = _plain(table[least]) if least == greatest else pa.concat_arrays([_plain(table[least]), _plain(table[greatest])])
    codes = names.dictionary_encode().indices.to_numpy().astype(np.int64)
    a, b = codes[: len(anchor)], codes[-len(anchor) :]
    several = np.repeat(np.minimum.reduceat(np.minimum(a, b), begins) != np.maximum.reduceat(np.maximum(a, b), begins), sizes)
    keep = np.flatnonzero(several)
    if not len(keep):
        return keep, keep, keep
    context = _plain(table["context"]).take(pa.array(keep))
    raw = np.frombuffer(context.buffers()[2], dtype=np.uint8)[: len(keep) * (2 + SPAN // 4)].reshape(len(keep), -1)
    number = np.repeat(np.arange(len(begins)), sizes)[keep]
    found, low, high = maximal_repeats(number, np.minimum(a, b)[keep], np.maximum(a, b)[keep], raw)
    return keep[found], low, high


def _read_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of shared letters from suffixes sorted by anchor."""
    for table in _whole_groups(batches):
        found, low, high = _repeats_of(table, "owner", "owner")
        if len(found):
            place = table["place"].to_numpy()[found]
            yield pa.RecordBatch.from_arrays([_plain(table["owner"]).take(pa.array(found)), pa.array(place - high), pa.array(place - low + LENGTH)], names=["owner", "low", "high"])


def _merged_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of letters before the anchor of shared windows, from rows of distinct surroundings sorted by anchor."""
    for table in _whole_groups(batches):
        found, low, high = _repeats_of(table, "a", "b")
        if len(found):
            rows = pa.array(found)
            yield pa.RecordBatch.from_arrays(
                [_plain(table["anchor"]).take(rows), _plain(table["context"]).take(rows), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["anchor", "context", "low", "high"]
            )


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of records that have a copy: the runs of valid letters of LENGTH and more."""
    for batch in batches:
        owners, lows, highs = [], [], []
        for owner, seq in zip(batch.column(0), batch.column(1), strict=True):
            valid = np.concatenate(([0], (_letters(seq.as_py()) < 4).astype(np.int8), [0]))
            steps = np.diff(valid)
            for a, b in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
                if b - a >= LENGTH:
                    owners.append(owner.as_py())
                    lows.append(a)
                    highs.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(owners, pa.binary()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names=["owner", "low", "high"])


def merge_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal stretches of overlapping or touching [low, high) under each key."""
    order = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__new", F.when(before.isNull() | (F.col("low") > before), 1).otherwise(0))
    marked = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__run").agg(F.min("low").alias("span_start"), F.max("high").alias("span_end")).drop("__run")


def shared_spans(records: DataFrame, group: int = GROUP) -> DataFrame:
    """Maximal stretches of each record that windows shared with other records cover.

    ``records`` has record_kind, record_id and seq, a record once. Gives record_kind, record_id,
    span_start, span_end.

    Defined results: letters are upper-cased; a window with any other letter than A, C, G, T is not
    shared; null, empty and short sequences have no spans; a repeat inside one record is no case;
    empty tables give no rows; other columns are ignored.
    """
    ship(records.sparkSession)
    rows = records.where(F.length("seq") >= LENGTH).select(
        "record_kind", "record_id", F.upper("seq").alias("seq"), F.unhex(F.substring(F.sha2(F.upper("seq"), 256), 1, 32)).alias("owner")
    )
    distinct = cut_lineage(rows.groupBy("owner").agg(F.count("*").alias("copies"), F.first("seq").alias("seq")))
    frequent = distinct.select("seq").mapInArrow(lambda b: _merge_small(_anchor_letters(b)), "anchor bigint").groupBy("anchor").count()
    large = cut_lineage(frequent.where(F.col("count") > group).select("anchor"))
    found = "owner binary, low bigint, high bigint"
    suffixes = distinct.select("owner", "seq").mapInArrow(_suffix_rows, "anchor bigint, owner binary, place bigint, context binary")
    whole = distinct.where("copies > 1").select("owner", "seq").mapInArrow(_whole_runs, found)
    intervals = whole
    if not large.isEmpty():
        sent = cut_lineage(suffixes)
        suffixes = sent.join(large, "anchor", "left_anti")
        intervals = whole.unionByName(_large_groups(sent.join(large, "anchor", "left_semi"), group))
    intervals = intervals.unionByName(suffixes.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_read_trees, found))
    spans = merge_intervals(intervals, ["owner"])
    return rows.select("record_kind", "record_id", "owner").join(spans, "owner").select("record_kind", "record_id", "span_start", "span_end")
