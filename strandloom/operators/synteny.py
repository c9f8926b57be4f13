"""Minimal synteny units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.operators.components import connected_components
from strandloom.operators.walks import filter_walks, rotate_walks, text_canonical, steps
from strandloom.session import cut_lineage
from strandloom.tables import Graphs


def mergers(walks: DataFrame) -> DataFrame:
    """Edges of the walks that occur as often as both their blocks: the two never part."""
    e = text_canonical(steps(walks, wrap_single=False)).where(F.col("left.block_id") != F.col("right.block_id"))
    ends = e.select("graph_id", "edge", F.least("left.block_id", "right.block_id").alias("a"), F.greatest("left.block_id", "right.block_id").alias("b"))
    counts = ends.groupBy("graph_id", "edge", "a", "b").agg(F.count("*").alias("n"))
    depth = walks.groupBy("graph_id", "block_id").agg(F.count("*").alias("d"))
    return (
        counts.join(depth.select("graph_id", F.col("block_id").alias("a"), F.col("d").alias("da")), ["graph_id", "a"])
        .join(depth.select("graph_id", F.col("block_id").alias("b"), F.col("d").alias("db")), ["graph_id", "b"])
        .where((F.col("n") == F.col("da")) & (F.col("n") == F.col("db")))
        .select("graph_id", "a", "b")
    )


def synteny_units(g: Graphs, core: DataFrame) -> DataFrame:
    """graph, block, unit (its least block), unit_len, label (MSU_0 is the longest; ties: the least block)."""
    walks = cut_lineage(filter_walks(g.walks, core))
    parts = connected_components(
        walks.select("graph_id", F.col("block_id").alias("vertex")), mergers(walks), ["graph_id"]
    ).select("graph_id", F.col("vertex").alias("block_id"), F.col("component").alias("unit"))
    sized = parts.join(g.block_lengths, ["graph_id", "block_id"])
    units = sized.groupBy("graph_id", "unit").agg(F.sum("len").alias("unit_len"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.col("unit_len").desc(), "unit")) - 1
    return parts.join(units.withColumn("label", F.concat(F.lit("MSU_"), rank)), ["graph_id", "unit"]).select("graph_id", "block_id", "unit", "unit_len", "label")


def unit_walks(g: Graphs, units: DataFrame, core: DataFrame, rotate: bool = False) -> DataFrame:
    """Walks over units: graph, path, ord, label, fwd. A unit's run of blocks is one step.

    Each unit is represented by its least block. With ``rotate`` all walks must be circular; they
    begin at the longest unit, and units that point backwards more often than forwards are flipped.
    """
    walks = filter_walks(g.walks, core)
    heads = units.where(F.col("block_id") == F.col("unit")).select("graph_id", "block_id", "label", "unit_len")
    reduced = filter_walks(walks, heads)
    if rotate:
        if not reduced.where(~F.col("circular")).isEmpty():
            raise ValueError("walks can only be rotated if all paths are circular")
        focal = heads.where(F.col("label") == "MSU_0").select("graph_id", "block_id")
        reduced = rotate_walks(reduced, focal)
    named = reduced.join(heads.select("graph_id", "block_id", "label"), ["graph_id", "block_id"])
    if rotate:
        net = named.groupBy("graph_id", "label").agg(F.sum(F.when(F.col("fwd"), 1).otherwise(-1)).alias("net"))
        named = named.join(net, ["graph_id", "label"]).withColumn("fwd", F.when(F.col("net") < 0, ~F.col("fwd")).otherwise(F.col("fwd")))
    return named.select("graph_id", "path_id", "ord", "label", "fwd")
