"""Consecutive places of walks: edges in both canonical forms, filtered and rotated walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandloom.tables import id_number



def along_path():
    """Places of a path in walk order."""
    return Window.partitionBy("graph_id", "path_id").orderBy("ord")


def whole_path():
    """All places of a path."""
    return Window.partitionBy("graph_id", "path_id")


def oriented(block: Column, fwd: Column) -> Column:
    """Text id of an oriented block."""
    return F.concat(block, F.when(fwd, F.lit("_f")).otherwise(F.lit("_r")))


def inverse_edge(left: Column, right: Column) -> tuple[Column, Column]:
    """The same edge read from the other strand: (not right, not left) (Q18)."""
    flip = lambda x: F.struct(x["block_id"].alias("block_id"), (~x["fwd"]).alias("fwd"))
    return flip(right), flip(left)


def steps(walks: DataFrame, wrap_single: bool) -> DataFrame:
    """Every place of a walk with the next one: ``left`` and ``right`` STRUCT<block_id, fwd>.

    Circular walks also go from the last place to the first; a walk of one place only if
    ``wrap_single`` (the graph export does so, the walk algebra does not).
    """
    here = F.struct("block_id", "fwd")
    nxt, first = F.lead(here).over(along_path()), F.first(here).over(along_path())
    wraps = F.col("circular") if wrap_single else F.col("circular") & (F.lag("ord").over(along_path()).isNotNull())
    joined = walks.withColumn("left", here).withColumn("right", F.coalesce(nxt, F.when(wraps, first)))
    return joined.where(F.col("right").isNotNull()).select("graph_id", "path_id", "ord", "left", "right")


def graph_canonical(edges: DataFrame) -> DataFrame:
    """Canonical form of the graph export: smaller number first; of equal ids the forward one first."""
    a, b = id_number(F.col("left.block_id")), id_number(F.col("right.block_id"))
    keep = (a < b) | ((a == b) & F.col("left.fwd"))
    il, ir = inverse_edge(F.col("left"), F.col("right"))
    return edges.withColumns({"left": F.when(keep, F.col("left")).otherwise(il), "right": F.when(keep, F.col("right")).otherwise(ir)})


def edge_text(left: Column, right: Column) -> Column:
    return F.concat_ws("__", oriented(left["block_id"], left["fwd"]), oriented(right["block_id"], right["fwd"]))


def text_canonical(edges: DataFrame) -> DataFrame:
    """``edge``: the lesser text of the edge and its inverse; ``natural``: whether it is the edge itself."""
    own = edge_text(F.col("left"), F.col("right"))
    other = edge_text(*inverse_edge(F.col("left"), F.col("right")))
    return edges.withColumns({"edge": F.least(own, other), "natural": own <= other})


def graph_links(walks: DataFrame) -> DataFrame:
    """Edges with their number of occurrences, in the form of the graph export."""
    e = graph_canonical(steps(walks, wrap_single=True))
    return e.groupBy("graph_id", "left", "right").agg(F.count("*").alias("count")).select(
        "graph_id",
        F.col("left.block_id").alias("block_1"),
        F.col("left.fwd").alias("fwd_1"),
        F.col("right.block_id").alias("block_2"),
        F.col("right.fwd").alias("fwd_2"),
        "count",
    )


def edge_counts(walks: DataFrame) -> DataFrame:
    """Edges with their number of occurrences under their text key."""
    e = text_canonical(steps(walks, wrap_single=False))
    return e.groupBy("graph_id", "edge").agg(F.count("*").alias("count"))


def transitive_edges(walks: DataFrame) -> DataFrame:
    """Edges that occur as often as both their blocks, which differ."""
    depth = walks.groupBy("graph_id", "block_id").agg(F.count("*").alias("depth"))
    links = graph_links(walks).where(F.col("block_1") != F.col("block_2"))
    return (
        links.join(depth.select("graph_id", F.col("block_id").alias("block_1"), F.col("depth").alias("d1")), ["graph_id", "block_1"])
        .join(depth.select("graph_id", F.col("block_id").alias("block_2"), F.col("depth").alias("d2")), ["graph_id", "block_2"])
        .where((F.col("count") == F.col("d1")) & (F.col("count") == F.col("d2")))
        .select("graph_id", "block_1", "fwd_1", "block_2", "fwd_2", "count")
    )


def filter_walks(walks: DataFrame, keep: DataFrame) -> DataFrame:
    """Places whose (graph, block) is in ``keep``; order and circularity stay, places are numbered anew."""
    kept = walks.join(keep.select("graph_id", "block_id").distinct(), ["graph_id", "block_id"], "left_semi")
    return kept.withColumn("ord", F.row_number().over(along_path()) - 1)


def rotate_walks(walks: DataFrame, focal: DataFrame) -> DataFrame:
    """Each circular walk begun at the focal block of its graph, forward.

    ``focal`` has (graph_id, block_id), one per graph. A walk that holds the block only in reverse is
    reverse-complemented first. Walks without it are left out. Of several places the first counts.
    """
    marked = walks.join(focal.select("graph_id", F.col("block_id").alias("focal")), "graph_id")
    mine = F.col("block_id") == F.col("focal")
    n = F.count("*").over(whole_path())
    forward_at = F.min(F.when(mine & F.col("fwd"), F.col("ord"))).over(whole_path())
    reverse_at = F.max(F.when(mine & ~F.col("fwd"), F.col("ord"))).over(whole_path())
    dense = marked.withColumn("ord", F.row_number().over(along_path()) - 1)
    placed = dense.select("*", n.alias("n"), forward_at.alias("f"), reverse_at.alias("r"))
    turned = placed.where(F.col("f").isNotNull() | F.col("r").isNotNull()).withColumns(
        {
            "ord": F.when(F.col("f").isNotNull(), F.pmod(F.col("ord") - F.col("f"), F.col("n"))).otherwise(
                F.pmod(F.col("r") - F.col("ord"), F.col("n"))
            ),
            "fwd": F.when(F.col("f").isNotNull(), F.col("fwd")).otherwise(~F.col("fwd")),
        }
    )
    return turned.drop("n", "f", "r", "focal")


def walk_categories(walks: DataFrame) -> DataFrame:
    """Equal walks of a graph with the number of paths that take them."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block_id", "fwd"))), lambda s: oriented(s["block_id"], s["fwd"])), ",")
    each = walks.groupBy("graph_id", "path_id").agg(text.alias("walk"))
    return each.groupBy("graph_id", F.sha2("walk", 256).alias("walk_key")).agg(
        F.count("*").alias("count"), F.min("path_id").alias("first_path"), F.array_sort(F.collect_list("path_id")).alias("paths")
    )
