"""Majority edits of blocks and the new consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.edits import apply_edit
from strandloom.operators.quality import runs
from strandloom.tables import EDIT_TYPES, Graphs


def _depth(g: Graphs) -> DataFrame:
    """Number of alignment rows of each block; a strict majority is more than half of it, rounded down (T4)."""
    return g.alignments.groupBy("graph_id", "block_id").agg(F.count("*").alias("depth"))


def _majority(counted: DataFrame, g: Graphs) -> DataFrame:
    return counted.join(_depth(g), ["graph_id", "block_id"]).where(F.col("n") > F.floor(F.col("depth") / 2)).drop("depth")


def majority_substitutions(g: Graphs) -> DataFrame:
    """graph, block, pos, alt of substitutions that most nodes have."""
    subs = g.alignments.select("graph_id", "block_id", F.explode("edit.subs").alias("s"))
    counted = subs.groupBy("graph_id", "block_id", F.col("s.pos").alias("pos"), F.col("s.alt").alias("alt")).agg(F.count("*").alias("n"))
    return _majority(counted, g).select("graph_id", "block_id", "pos", "alt", "n")


def majority_deletions(g: Graphs) -> DataFrame:
    """graph, block, start, end of the runs of positions that most nodes lack (A10)."""
    dels = g.alignments.select("graph_id", "block_id", F.explode("edit.dels").alias("d")).where("d.len > 0")
    places = dels.select("graph_id", "block_id", F.explode(F.sequence(F.col("d.pos"), F.col("d.pos") + F.col("d.len") - 1)).alias("pos"))
    counted = places.groupBy("graph_id", "block_id", "pos").agg(F.count("*").alias("n"))
    return runs(_majority(counted, g), ["graph_id", "block_id"])


def majority_insertions(g: Graphs) -> DataFrame:
    """graph, block, pos, seq of insertions that most nodes have letter for letter."""
    inss = g.alignments.select("graph_id", "block_id", F.explode("edit.inss").alias("i"))
    counted = inss.groupBy("graph_id", "block_id", F.col("i.pos").alias("pos"), F.col("i.seq").alias("seq")).agg(F.count("*").alias("n"))
    return _majority(counted, g).select("graph_id", "block_id", "pos", "seq", "n")


def new_consensus(g: Graphs) -> DataFrame:
    """graph, block, kind, old, consensus, subs of the blocks whose consensus the majority changes.

    ``kind`` is ``indel`` (all nodes must be aligned anew), or ``substitution`` (edits can be mended).
    """
    key = ["graph_id", "block_id"]
    subs = majority_substitutions(g).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "alt"))).alias("subs"))
    dels = majority_deletions(g).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("pos"), (F.col("end") - F.col("start")).cast("int").alias("len")))).alias("dels"))
    inss = majority_insertions(g).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "seq"))).alias("inss"))
    joined = subs.join(dels, key, "full_outer").join(inss, key, "full_outer")
    lists = {k: F.coalesce(F.col(k), F.array().cast(t)).alias(k) for k, t in EDIT_TYPES.items()}
    edits = joined.select(*key, F.struct(*lists.values()).alias("edit"), (F.col("dels").isNotNull() | F.col("inss").isNotNull()).alias("indel"))
    # a substitution that is deleted as well goes with the deletion
    gone = lambda s: F.exists("edit.dels", lambda d: (s["pos"] >= d["pos"]) & (s["pos"] < d["pos"] + d["len"]))
    clean = F.struct(F.filter("edit.subs", lambda s: ~gone(s)).alias("subs"), F.col("edit.dels").alias("dels"), F.col("edit.inss").alias("inss"))
    blocks = g.blocks.select(*key, "consensus").join(edits, key)
    return blocks.select(
        *key,
        F.when(F.col("indel"), "indel").otherwise("substitution").alias("kind"),
        F.col("consensus").alias("old"),
        apply_edit(F.col("consensus"), clean).alias("consensus"),
        clean["subs"].alias("subs"),
    )
