"""Referential and positional checks of graphs as a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.functions.edits import problems
from strandloom.operators.walks import along_path
from strandloom.tables import Graphs


def gaps(g: Graphs) -> DataFrame:
    """Neighbouring places that don't meet, the last and the first of circular paths included."""
    w = g.walks
    first = F.first(F.struct("node_id", "pos_start")).over(along_path())
    nxt = F.coalesce(F.lead(F.struct("node_id", "pos_start")).over(along_path()), F.when(F.col("circular"), first))
    joined = w.withColumn("next", nxt).where(F.col("next").isNotNull() & (F.col("next.pos_start") != F.col("pos_end")))
    return joined.select("graph_id", "path_id", "node_id", F.col("next.node_id").alias("next_node"), "pos_end", F.col("next.pos_start").alias("next_start"))


def report(g: Graphs) -> DataFrame:
    """graph_id, rule, subject: everything about a graph that breaks its invariants."""
    nodes, places = g.nodes, g.path_nodes
    edits = g.alignments
    by_block = g.blocks.select("graph_id", "block_id")
    row = lambda df, rule, subject: df.select("graph_id", F.lit(rule).alias("rule"), F.col(subject).alias("subject"))
    known = nodes.select("graph_id", "node_id")
    found = [
        row(places.join(known, ["graph_id", "node_id"], "left_anti"), "path names an unknown node", "node_id"),
        row(nodes.join(places.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti"), "node in no walk", "node_id"),
        row(nodes.where(F.col("block_id").isNull()), "node without block", "node_id"),
        row(nodes.where(F.col("block_id").isNotNull()).join(by_block, ["graph_id", "block_id"], "left_anti"), "node of an unknown block", "node_id"),
        row(nodes.join(g.paths.select("graph_id", "path_id"), ["graph_id", "path_id"], "left_anti"), "node of an unknown path", "node_id"),
        row(edits.join(known, ["graph_id", "node_id"], "left_anti"), "edit of an unknown node", "node_id"),
        row(by_block.join(nodes.select("graph_id", "block_id"), ["graph_id", "block_id"], "left_anti"), "block without nodes", "block_id"),
        row(gaps(g), "places that don't meet", "node_id"),
    ]
    broken = edits.select("graph_id", "node_id", F.explode(problems(F.length("consensus"), F.col("edit"))).alias("rule"))
    found.append(broken.select("graph_id", "rule", F.col("node_id").alias("subject")))
    return reduce(DataFrame.unionByName, found)


def overlaps(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap, found along the order of starts.

    Only intervals that begin before a running greatest end are joined, on the key and a grid of
    the axis, so a range join never becomes a nested loop.
    """
    grid = F.sequence(F.floor(F.col("start") / GRID), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / GRID))
    cells = intervals.where(F.col("end") > F.col("start")).select(*by, "id", "start", "end", F.explode(grid).alias("cell"))
    a = cells.select(*by, "cell", F.col("id").alias("id_a"), F.col("start").alias("sa"), F.col("end").alias("ea"))
    b = cells.select(*by, "cell", F.col("id").alias("id_b"), F.col("start").alias("sb"), F.col("end").alias("eb"))
    met = a.join(b, [*by, "cell"]).where((F.col("ea") > F.col("sb")) & (F.col("sa") < F.col("eb")) & (F.col("id_a") < F.col("id_b")))
    # a pair is reported in the one cell in which its overlap begins
    return met.where(F.col("cell") == F.floor(F.greatest("sa", "sb") / GRID)).select(*by, "id_a", "id_b")


GRID = 1_024


def runs(positions: DataFrame, by: list[str]) -> DataFrame:
    """Consecutive positions as half-open intervals."""
    order = Window.partitionBy(*by).orderBy("pos")
    marked = positions.select(*by, "pos").distinct().withColumn("__run", F.col("pos") - F.row_number().over(order))
    return marked.groupBy(*by, "__run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).drop("__run")
