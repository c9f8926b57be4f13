"""Pairwise matches between blocks: energy, filters, intervals, anchors."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions import cigar as cg
from strandloom.functions.seq import count_n
from strandloom.operators.components import connected_components
from strandloom.session import ship

ALPHA, BETA = 100.0, 10.0


def energy(alpha: float = ALPHA, beta: float = BETA) -> Column:
    """Energy of a match from its own columns: -matches + alpha * cuts + beta * divergence * matches."""
    end = lambda c: F.when(c, 1).otherwise(0)
    cuts = (
        F.lit(4)
        - end(F.col("q_start") == 0)
        - end(F.col("q_end") == F.col("q_len"))
        - end(F.col("r_start") == 0)
        - end(F.col("r_end") == F.col("r_len"))
    )
    return -F.col("matches") + alpha * cuts + beta * F.coalesce(F.col("divergence"), F.lit(0.0)) * F.col("matches")


def energy_by_length(threshold: int, alpha: float = ALPHA, beta: float = BETA) -> Column:
    """The older form: matches shorter than the threshold are never taken."""
    return F.when(F.col("matches") < threshold, F.lit(float("inf"))).otherwise(energy(alpha, beta))


def candidates(matches: DataFrame, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """Matches of two different blocks with negative energy (F1, F2)."""
    return matches.where(F.col("q_name") != F.col("r_name")).withColumn("energy", energy(alpha, beta)).where(F.col("energy") < 0)


def greedy(matches: DataFrame) -> DataFrame:
    """Matches taken in order of energy as long as they overlap nothing taken on either block.

    Whether a match is taken depends only on matches of its own component (blocks joined by
    matches), so each component is a group of its own. Ties are broken by names and starts.
    """
    ship(matches.sparkSession)
    ids = matches.select(F.col("q_name").alias("vertex")).unionByName(matches.select(F.col("r_name").alias("vertex"))).withColumn("all", F.lit(0))
    parts = connected_components(ids, matches.select(F.lit(0).alias("all"), F.col("q_name").alias("a"), F.col("r_name").alias("b")), ["all"])
    grouped = matches.join(parts.select(F.col("vertex").alias("q_name"), "component"), "q_name").select(*matches.columns, "component")

    columns = list(matches.columns)

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["energy", "q_name", "q_start", "r_name", "r_start"], kind="stable")
        used: dict[str, tuple[list[int], list[int]]] = {}  # starts and ends of what is taken of a block, in order
        kept = []

        def free(name: str, s: int, e: int) -> bool:
            starts, ends = used.get(name, ((), ()))
            i = bisect_right(starts, s)
            return (i == 0 or ends[i - 1] <= s) and (i == len(starts) or starts[i] >= e)

        for i, m in enumerate(pdf[["q_name", "q_start", "q_end", "r_name", "r_start", "r_end"]].itertuples(index=False)):
            sides = ((m.q_name, m.q_start, m.q_end), (m.r_name, m.r_start, m.r_end))
            if all(free(*side) for side in sides):
                kept.append(i)
                for name, s, e in sides:
                    starts, ends = used.setdefault(name, ([], []))
                    at = bisect_right(starts, s)
                    starts.insert(at, s)
                    ends.insert(at, e)
        return pdf.iloc[kept][columns]

    return grouped.groupBy("component").applyInPandas(take, matches.schema)


def block_intervals(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each block divided into its hits and the gaps between them: block, start, end, aligned."""
    order = Window.partitionBy("block").orderBy("start")
    before = F.coalesce(F.lag("end").over(order), F.lit(0))
    lead_in = hits.select("block", before.alias("start"), F.col("start").alias("end"), F.lit(False).alias("aligned"))
    last = hits.groupBy("block").agg(F.max("end").alias("start"))
    tail = lengths.join(last, "block", "left").select("block", F.coalesce("start", F.lit(0)).alias("start"), F.col("len").alias("end"), F.lit(False).alias("aligned"))
    whole = hits.select("block", "start", "end", F.lit(True).alias("aligned")).unionByName(lead_in).unionByName(tail)
    return whole.where(F.col("end") > F.col("start"))


def refine_intervals(intervals: DataFrame, threshold: int) -> DataFrame:
    """Gaps shorter than the threshold go to the longer neighbour, ties to the left one."""
    order = Window.partitionBy("block").orderBy("start")
    size = F.col("end") - F.col("start")
    near = intervals.withColumns(
        {"size": size, "before": F.coalesce(F.lag(size).over(order), F.lit(-1)), "after": F.coalesce(F.lead(size).over(order), F.lit(-1)), "n": F.row_number().over(order)}
    )
    alone = (F.col("before") < 0) & (F.col("after") < 0)
    target = F.when(F.col("aligned") | (F.col("size") >= threshold) | alone, F.col("n")).when(
        F.col("before") >= F.col("after"), F.col("n") - 1
    ).otherwise(F.col("n") + 1)
    moved = near.withColumn("target", target)
    own = F.col("n") == F.col("target")
    return moved.groupBy("block", "target").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max(F.when(own, F.col("aligned"))).alias("aligned"),
        F.sum(F.when(F.col("n") < F.col("target"), F.col("size")).otherwise(0)).alias("extend_left"),
        F.sum(F.when(F.col("n") > F.col("target"), F.col("size")).otherwise(0)).alias("extend_right"),
    ).drop("target")


def anchors(matches: DataFrame, blocks: DataFrame) -> DataFrame:
    """Which side of each match is the anchor: the deeper block, then the one with fewer N, then the reference.

    ``blocks`` has name, depth, consensus.
    """
    q = blocks.select(F.col("name").alias("q_name"), F.col("depth").alias("q_depth"), F.col("consensus").alias("q_seq"))
    r = blocks.select(F.col("name").alias("r_name"), F.col("depth").alias("r_depth"), F.col("consensus").alias("r_seq"))
    joined = matches.join(q, "q_name").join(r, "r_name")
    qn = count_n(F.col("q_seq"), F.col("q_start"), F.col("q_end"))
    rn = count_n(F.col("r_seq"), F.col("r_start"), F.col("r_end"))
    side = F.when(F.col("q_depth") > F.col("r_depth"), "qry").when(F.col("q_depth") < F.col("r_depth"), "ref").when(qn < rn, "qry").otherwise("ref")
    return joined.withColumn("anchor", side).select(*matches.columns, "anchor")


def hits_of_blocks(matches: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each match seen from both its blocks (J3, G12): block, start, end, is_anchor, orientation, cigar, new_block, and ``keys``.

    The cigar of the query side has its roles swapped, and is read backwards if the match is reverse.
    """
    new_id = F.conv(F.hex(F.xxhash64("q_name", "q_start", "q_end", "r_name", "r_start", "r_end")), 16, 10)
    keyed = matches.withColumn("new_block", new_id)
    ref = keyed.select(
        F.col("r_name").alias("block"), F.col("r_start").alias("start"), F.col("r_end").alias("end"),
        (F.col("anchor") == "ref").alias("is_anchor"), "forward", "cigar", "new_block", *(keys or []),
    )
    turned = F.when(F.col("forward"), F.col("cigar")).otherwise(cg.invert(F.col("cigar")))
    qry = keyed.select(
        F.col("q_name").alias("block"), F.col("q_start").alias("start"), F.col("q_end").alias("end"),
        (F.col("anchor") == "qry").alias("is_anchor"), "forward", cg.swap_sides(turned).alias("cigar"), "new_block", *(keys or []),
    )
    return ref.unionByName(qry)


def keep_groups(ops: list[tuple[str, int]], threshold: int) -> list[tuple[int, int]]:
    """Index ranges of a cigar between indels of ``threshold`` and more, trimmed to matches, with as many matched letters."""
    groups: list[tuple[int, int]] = []
    start, last, matched, gap = None, None, 0, {"I": 0, "D": 0}

    def close() -> None:
        if start is not None and matched >= threshold:
            groups.append((start, last + 1))

    for i, (op, n) in enumerate(ops):
        if op in "M=X":
            if start is None:
                start = i
            last, matched, gap = i, matched + n, {"I": 0, "D": 0}
        elif op in gap:
            gap[op] += n
            if start is not None and max(gap.values()) >= threshold:
                close()
                start, matched = None, 0
    close()
    return groups


SPLIT_FIELDS = ("q_start", "q_end", "r_start", "r_end", "matches", "length")


def split_match(m: dict, threshold: int) -> list[dict]:
    """The parts of one match between long indels, with short overhangs at block ends absorbed."""
    ops = [(o["op"], o["len"]) for o in m["cigar"]]
    q = r = 0
    starts = []
    for op, n in ops:
        starts.append((q, r))
        q += n if op in "M=XI" else 0
        r += n if op in "M=XD" else 0
    starts.append((q, r))
    out = []
    for a, b in keep_groups(ops, threshold):
        (qa, ra), (qb, rb) = starts[a], starts[b]
        part = ops[a:b]
        forward = m["forward"]
        qs, qe = (m["q_start"] + qa, m["q_start"] + qb) if forward else (m["q_end"] - qb, m["q_end"] - qa)
        new = dict(m, q_start=qs, q_end=qe, r_start=m["r_start"] + ra, r_end=m["r_start"] + rb)
        # an overhang shorter than the threshold at the end of a block joins the match as an indel
        left, right = new["r_start"], m["r_len"] - new["r_end"]
        if 0 < left < threshold:
            part, new["r_start"] = [("D", left), *part], 0
        if 0 < right < threshold:
            part, new["r_end"] = [*part, ("D", right)], m["r_len"]
        left, right = new["q_start"], m["q_len"] - new["q_end"]
        if 0 < left < threshold:
            part, new["q_start"] = ([("I", left), *part] if forward else [*part, ("I", left)]), 0
        if 0 < right < threshold:
            part, new["q_end"] = ([*part, ("I", right)] if forward else [("I", right), *part]), m["q_len"]
        new["matches"] = sum(n for op, n in part if op in "M=X")
        new["length"] = sum(n for _, n in part)
        new["cigar"] = [{"op": op, "len": n} for op, n in part]
        out.append(new)
    return out


def split_matches(matches: DataFrame, threshold: int) -> DataFrame:
    """All matches divided at long indels; rows are independent, so no shuffle."""
    ship(matches.sparkSession)
    names = list(matches.columns)

    def run(frames):
        for batch in frames:
            rows = [p for m in batch.to_pylist() for p in split_match(m, threshold)]
            yield pa.RecordBatch.from_pylist([{n: p[n] for n in names} for p in rows], schema=batch.schema)

    return matches.mapInArrow(run, matches.schema)
