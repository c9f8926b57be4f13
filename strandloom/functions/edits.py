"""Edits against a block consensus as Column expressions.

An Edit is STRUCT<subs, dels, inss>; a deletion covers [pos, pos + len), an insertion stands before
consensus position ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.seq import reverse_complement
from strandloom.tables import EDIT_TYPES


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + value(x))


def _spliced(consensus: Column, edit: Column, gaps: bool, insertions: bool) -> Column:
    """The consensus cut at the edits and joined again: one piece per edit, not one per letter."""
    marks = F.transform(edit["subs"], lambda s: F.struct(s["pos"].alias("pos"), F.lit(1).alias("rank"), F.lit(1).alias("len"), s["alt"].alias("text")))
    dels = F.transform(
        edit["dels"],
        lambda d: F.struct(d["pos"].alias("pos"), F.lit(1).alias("rank"), d["len"].alias("len"), (F.repeat(F.lit("-"), d["len"]) if gaps else F.lit("")).alias("text")),
    )
    marks = F.concat(marks, dels)
    if insertions:
        # several insertions at one place stand in the order of their letters
        marks = F.concat(marks, F.transform(edit["inss"], lambda i: F.struct(i["pos"].alias("pos"), F.lit(0).alias("rank"), F.lit(0).alias("len"), i["seq"].alias("text"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    done = F.aggregate(
        F.array_sort(marks),
        start,
        lambda a, m: F.struct(
            F.greatest(a["at"], m["pos"] + m["len"]).alias("at"),
            F.concat(a["parts"], F.array(consensus.substr(a["at"] + 1, F.greatest(F.lit(0), m["pos"] - a["at"])), m["text"])).alias("parts"),
        ),
        lambda a: F.concat(a["parts"], F.array(consensus.substr(a["at"] + 1, F.length(consensus)))),
    )
    return F.array_join(done, "")


def apply_edit(consensus: Column, edit: Column) -> Column:
    """The node's own sequence (X2, X4). A substitution inside a deletion is not valid (X11)."""
    return _spliced(consensus, edit, gaps=False, insertions=True)


def apply_aligned(consensus: Column, edit: Column) -> Column:
    """The node's row of the alignment: deletions as gaps, insertions left out."""
    return _spliced(consensus, edit, gaps=True, insertions=False)


def inserted(edit: Column) -> Column:
    return _sum(edit["inss"], lambda i: F.length(i["seq"]))


def deleted(edit: Column) -> Column:
    return _sum(edit["dels"], lambda d: d["len"])


def node_length(consensus_len: Column, edit: Column) -> Column:
    return consensus_len + inserted(edit) - deleted(edit)


def aligned_count(consensus_len: Column, edit: Column) -> Column:
    return consensus_len - deleted(edit)


def is_unaligned(consensus_len: Column, edit: Column) -> Column:
    """No letter of the consensus is left; insertions may be there."""
    return aligned_count(consensus_len, edit) == 0


def is_empty(consensus_len: Column, edit: Column) -> Column:
    """Nothing is left at all."""
    return is_unaligned(consensus_len, edit) & (F.size(edit["inss"]) == 0)


def leading_deleted(edit: Column) -> Column:
    return _sum(F.filter(edit["dels"], lambda d: d["pos"] == 0), lambda d: d["len"])


def trailing_deleted(consensus_len: Column, edit: Column) -> Column:
    return _sum(F.filter(edit["dels"], lambda d: (d["pos"] + d["len"] == consensus_len) & (d["pos"] > 0)), lambda d: d["len"])


def leading_inserted(edit: Column) -> Column:
    return _sum(F.filter(edit["inss"], lambda i: i["pos"] == 0), lambda i: F.length(i["seq"]))


def trailing_inserted(consensus_len: Column, edit: Column) -> Column:
    return _sum(F.filter(edit["inss"], lambda i: (i["pos"] == consensus_len) & (i["pos"] > 0)), lambda i: F.length(i["seq"]))


def reverse_edit(consensus_len: Column, edit: Column) -> Column:
    """The same edit against the reverse complement of the consensus."""
    n = consensus_len
    return F.struct(
        F.array_sort(F.transform(edit["subs"], lambda s: F.struct((n - s["pos"] - 1).alias("pos"), reverse_complement(s["alt"]).alias("alt")))).alias("subs"),
        F.array_sort(F.transform(edit["dels"], lambda d: F.struct((n - d["pos"] - d["len"]).alias("pos"), d["len"].alias("len")))).alias("dels"),
        F.array_sort(F.transform(edit["inss"], lambda i: F.struct((n - i["pos"]).alias("pos"), reverse_complement(i["seq"]).alias("seq")))).alias("inss"),
    )


def shift_edit(edit: Column, by: Column) -> Column:
    return F.struct(
        F.transform(edit["subs"], lambda s: F.struct((s["pos"] + by).alias("pos"), s["alt"].alias("alt"))).alias("subs"),
        F.transform(edit["dels"], lambda d: F.struct((d["pos"] + by).alias("pos"), d["len"].alias("len"))).alias("dels"),
        F.transform(edit["inss"], lambda i: F.struct((i["pos"] + by).alias("pos"), i["seq"].alias("seq"))).alias("inss"),
    )


def concat_edits(left: Column, left_len: Column, right: Column) -> Column:
    """Edits of two consensus sequences laid end to end; insertions that meet at the border become one."""
    moved = shift_edit(right, left_len)
    at = lambda inss: F.filter(inss, lambda i: i["pos"] == left_len)
    border = F.concat_ws("", F.transform(at(left["inss"]), lambda i: i["seq"]), F.transform(at(moved["inss"]), lambda i: i["seq"]))
    joined = F.when(F.length(border) > 0, F.array(F.struct(left_len.cast("int").alias("pos"), border.alias("seq")))).otherwise(F.array().cast(EDIT_TYPES["inss"]))
    off = lambda inss: F.filter(inss, lambda i: i["pos"] != left_len)
    return F.struct(
        F.concat(left["subs"], moved["subs"]).alias("subs"),
        F.concat(left["dels"], moved["dels"]).alias("dels"),
        F.concat(off(left["inss"]), joined, off(moved["inss"])).alias("inss"),
    )


def slice_edit(edit: Column, start: Column, end: Column, consensus_len: Column) -> Column:
    """The part of an edit inside [start, end), with positions from its start.

    Deletions are clipped. An insertion belongs to the interval whose start is its place; one at the
    end of the block to the last interval.
    """
    subs = F.filter(edit["subs"], lambda s: (s["pos"] >= start) & (s["pos"] < end))
    dels = F.filter(edit["dels"], lambda d: (d["pos"] < end) & (d["pos"] + d["len"] > start))
    inss = F.filter(edit["inss"], lambda i: (i["pos"] >= start) & ((i["pos"] < end) | ((end == consensus_len) & (i["pos"] == end))))
    clipped = F.transform(
        dels,
        lambda d: F.struct(
            (F.greatest(d["pos"], start) - start).cast("int").alias("pos"), (F.least(d["pos"] + d["len"], end) - F.greatest(d["pos"], start)).cast("int").alias("len")
        ),
    )
    return F.struct(
        F.transform(subs, lambda s: F.struct((s["pos"] - start).cast("int").alias("pos"), s["alt"].alias("alt"))).alias("subs"),
        clipped.alias("dels"),
        F.transform(inss, lambda i: F.struct((i["pos"] - start).cast("int").alias("pos"), i["seq"].alias("seq"))).alias("inss"),
    )


def node_offset(edit: Column, at: Column) -> Column:
    """Letters of the node before consensus position ``at``, insertions at ``at`` left out."""
    gone = _sum(F.filter(edit["dels"], lambda d: d["pos"] < at), lambda d: F.least(d["pos"] + d["len"], at) - d["pos"])
    come = _sum(F.filter(edit["inss"], lambda i: i["pos"] < at), lambda i: F.length(i["seq"]))
    return at - gone + come


def node_interval(edit: Column, start: Column, end: Column, consensus_len: Column) -> tuple[Column, Column]:
    """Places of a consensus interval in the node; insertions at the block's end belong to the last interval."""
    tail = _sum(F.filter(edit["inss"], lambda i: i["pos"] == consensus_len), lambda i: F.length(i["seq"]))
    return node_offset(edit, start), node_offset(edit, end) + F.when(end == consensus_len, tail).otherwise(0)


def new_position(old_start: Column, old_end: Column, low: Column, high: Column, forward: Column, path_len: Column, circular: Column) -> tuple[Column, Column]:
    """Place on the path of a node's part [low, high); on circular paths modulo the length."""
    start = F.when(forward, old_start + low).otherwise(old_end - high)
    end = F.when(forward, old_start + high).otherwise(old_end - low)
    wrap = lambda x: F.when(circular, F.pmod(x, path_len)).otherwise(x)
    return wrap(start), wrap(end)


def problems(consensus_len: Column, edit: Column) -> Column:
    """Names of the rules that an edit breaks (X11)."""
    subs, dels, inss = edit["subs"], edit["dels"], edit["inss"]
    places = F.transform(subs, lambda s: s["pos"])
    ordered = F.array_sort(F.transform(dels, lambda d: F.struct(d["pos"].alias("pos"), (d["pos"] + d["len"]).alias("end"))))
    overlap = F.aggregate(
        ordered,
        F.struct(F.lit(-1).alias("end"), F.lit(False).alias("bad")),
        lambda a, d: F.struct(F.greatest(a["end"], d["end"]).alias("end"), (a["bad"] | (d["pos"] < a["end"])).alias("bad")),
        lambda a: a["bad"],
    )
    inside = F.exists(subs, lambda s: F.exists(dels, lambda d: (s["pos"] >= d["pos"]) & (s["pos"] < d["pos"] + d["len"])))
    rules = {
        "substitution out of bounds": F.exists(subs, lambda s: (s["pos"] < 0) | (s["pos"] >= consensus_len)),
        "substitution by a gap": F.exists(subs, lambda s: s["alt"] == "-"),
        "two substitutions at one place": F.size(F.array_distinct(places)) != F.size(places),
        "substitution inside a deletion": inside,
        "deletion out of bounds": F.exists(dels, lambda d: (d["pos"] < 0) | (d["pos"] + d["len"] > consensus_len)),
        "empty deletion": F.exists(dels, lambda d: d["len"] <= 0),
        "deletions overlap": overlap,
        "insertion out of bounds": F.exists(inss, lambda i: (i["pos"] < 0) | (i["pos"] > consensus_len)),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def reconcile_substitution(edit: Column, pos: Column, old: Column, new: Column) -> Column:
    """An edit after consensus position ``pos`` changed from ``old`` to ``new``."""
    mine = F.filter(edit["subs"], lambda s: s["pos"] == pos)
    others = F.filter(edit["subs"], lambda s: s["pos"] != pos)
    gone = F.exists(edit["dels"], lambda d: (pos >= d["pos"]) & (pos < d["pos"] + d["len"]))
    back = F.array(F.struct(pos.cast("int").alias("pos"), old.alias("alt")))
    subs = (
        F.when((F.size(mine) == 0) & gone, others)
        .when(F.size(mine) == 0, F.array_sort(F.concat(others, back)))
        .when((F.size(mine) == 1) & gone, F.raise_error(F.lit("a substitution inside a deletion")).cast(EDIT_TYPES["subs"]))
        .when(F.size(mine) == 1, F.when(F.get(mine, F.lit(0))["alt"] == new, others).otherwise(edit["subs"]))
        .otherwise(F.raise_error(F.lit("two substitutions at one place")).cast(EDIT_TYPES["subs"]))
    )
    return F.struct(subs.alias("subs"), edit["dels"].alias("dels"), edit["inss"].alias("inss"))
